"""Joins through shared word n-grams: the inverted-index join, containment and Jaccard similarity.

Both sides are exploded into distinct hashed grams and joined on the gram, so no side is held in memory;
pairs are counted with a partial aggregate. A gram that very many documents share is split by adaptive
execution. Hashes are 64 bits; ``exact`` keeps the grams themselves as keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..llm.common import bits_at, bits_for
from .graph import checkpointed, tune


def exploded(df: DataFrame, key: str, text: str, n: int, exact: bool = False) -> DataFrame:
    """(key, g, size): each distinct gram of each text, and how many the text has."""
    # Words are a column of their own and the explode an outer one: else the words would be found anew for
    # each gram, within the gram expression or in the filter that is inferred from an inner explode.
    words = df.select(key, t.words(text).alias("__w"))
    grams = words.select(key, (t.ngrams if exact else t.ngram_hashes)(F.col("__w"), n).alias("__g"))
    return grams.select(key, F.size("__g").cast("long").alias("size"), F.explode_outer("__g").alias("g")).where(F.col("g").isNotNull())


def shared_grams(a: DataFrame, b: DataFrame, a_key: str, b_key: str) -> DataFrame:
    """(a_key, b_key, shared, a_size, b_size) of pairs with a gram in common."""
    left = a.select(a_key, "g", F.col("size").alias("a_size"))
    right = b.select(b_key, "g", F.col("size").alias("b_size"))
    return left.join(right, "g").groupBy(a_key, b_key).agg(
        F.count(F.lit(1)).alias("shared"), F.first("a_size").alias("a_size"), F.first("b_size").alias("b_size")
    )


def containment():
    return F.col("shared") / F.least("a_size", "b_size")


def jaccard():
    return F.col("shared") / (F.col("a_size") + F.col("b_size") - F.col("shared"))


def gram_sets(worded: DataFrame, n: int) -> DataFrame:
    """worded(key, w) as (key, g): the sorted distinct 64-bit hashes of the n-word sequences of each array of words, empty
    for fewer words. Words are hashed once each; a batch's sequences are made of these numbers at once."""
    tune(worded.sparkSession)
    key = worded.columns[0]
    hashed = worded.select(key, F.transform("w", lambda x: F.xxhash64(x)).alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            h = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            row, ends = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes)
            starts = np.flatnonzero(np.arange(len(h)) + n <= ends[row]) if len(h) else np.zeros(0, np.int64)
            g = np.zeros(len(starts), np.uint64)
            for i in range(n):
                g = (g + h[starts + i]) * np.uint64(0x9E3779B97F4A7C15)
                g ^= g >> np.uint64(29)
            row = row[starts]
            order = np.lexsort((g.view(np.int64), row))
            row, g = row[order], g[order]
            new = np.ones(len(g), bool)
            new[1:] = (row[1:] != row[:-1]) | (g[1:] != g[:-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), lists_of(g[new].view(np.int64), row[new], len(sizes))], [key, "g"])

    return hashed.mapInArrow(run, f"{key} {worded.schema[key].dataType.simpleString()}, g array<long>")


def lists_of(values: np.ndarray, row: np.ndarray, rows: int) -> pa.ListArray:
    """Values as lists, one for each of ``rows`` rows; row: the rows' numbers, in order."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def shared_only(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of sets(key, g), a written table of arrays of distinct 64-bit hashes: (key, size, g) with a row for each hash that
    more than one row has, size being that of the whole array; and (g, often) of these, a written table.

    Only numbers are counted by a shuffle. A bit table of the shared ones (128 MB at most) then tells in the rows which
    others are surely met once; what it lets through is joined exactly.
    """
    key = sets.columns[0]
    often = checkpointed(sets.select(F.explode("g").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("often")).where("often > 1"))
    size = bits_for(often.count())
    bits = bits_at(often, F.pmod("g", F.lit(1 << size)), size)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            sizes = batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            g = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            at = g & ((1 << size) - 1)
            hit = np.flatnonzero(table[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            row = np.repeat(np.arange(len(sizes)), sizes)[hit]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(sizes[row]), pa.array(g[hit])], [key, "size", "g"])

    tune(sets.sparkSession)
    likely = sets.mapInArrow(told, f"{key} {sets.schema[key].dataType.simpleString()}, size long, g long")
    return likely.join(often.select("g"), "g", "left_semi").select(key, "size", "g"), often
