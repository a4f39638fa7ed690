"""Containment of many strings in few texts, by a suffix array of the texts."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def suffix_array(text: str) -> np.ndarray:
    """Starts of all suffixes in order, by doubling: suffixes are ranked by their first 1, 2, 4, ... characters."""
    rank = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) + 1
    n, width = len(rank), 1
    order = np.argsort(rank, kind="stable")
    while width < n:
        after = np.zeros(n, np.int64)
        after[: n - width] = rank[width:]
        key = rank * (int(rank.max()) + 2) + after if rank.max() < 1 << 31 else None
        order = np.lexsort((after, rank)) if key is None else np.argsort(key, kind="stable")
        ahead, behind = rank[order], after[order]
        new = np.concatenate([[1], 1 + np.cumsum((ahead[1:] != ahead[:-1]) | (behind[1:] != behind[:-1]))])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n:
            break
        width *= 2
    return order.astype(np.int32 if n < 1 << 31 else np.int64)


def stands_in(text: str, starts: np.ndarray, part: str) -> bool:
    """Whether ``part`` stands in the text: one binary search among its suffixes."""
    low, high, m = 0, len(starts), len(part)
    while low < high:
        middle = (low + high) // 2
        at = int(starts[middle])
        if text[at : at + m] < part:
            low = middle + 1
        else:
            high = middle
    return low < len(starts) and text.startswith(part, int(starts[low]))


def chunks(texts: DataFrame, column: str, most: int):
    """The texts, joined by NUL, in parts of about ``most`` characters (a longer text is a part of its own); one part
    is in the driver's memory at a time."""
    held, size = [], 0
    for row in texts.where(F.col(column).isNotNull()).select(column).toLocalIterator():
        if held and size + len(row[0]) > most:
            yield "\0".join(held)
            held, size = [], 0
        held.append(row[0])
        size += len(row[0]) + 1
    if held:
        yield "\0".join(held)


def contained(spark: SparkSession, part: Column, texts: DataFrame, column: str, most: int = 4 << 20) -> Column:
    """Whether the string ``part`` stands in one of ``texts``, the smaller side: its characters are ordered once, in chunks
    that are broadcast, and each string is placed by a binary search in each chunk. Work is in proportion to the
    strings, however they begin and however many are alike. Null for null; strings with NUL stand in no text."""

    def found_in(chunk: str) -> Column:
        held = spark.sparkContext.broadcast((chunk, suffix_array(chunk)))

        @F.pandas_udf("boolean")
        def found(parts: pd.Series) -> pd.Series:
            text, starts = held.value
            return pd.Series([None if p is None else "\0" not in p and stands_in(text, starts, p) for p in parts], dtype=object)

        return found(part)

    return reduce(lambda a, b: a | b, (found_in(c) for c in chunks(texts, column, most)), part.isNotNull() & F.lit(False))
