"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

Patterns are the windows of ten words of each benchmark item (an item of fewer words is one pattern).
Patterns of one length are searched together. At a text position the last block of two words decides:
a word that no pattern has lets the search skip the whole length, a block that no pattern has one less,
any other block its least distance from a pattern's end. At distance zero the block is a suffix of some
patterns; the bucket of that suffix lists them and each is compared word by word.

The benchmark goes to the workers in chunks of bounded size (``chunk_bytes`` of text, one chunk for any
usual benchmark); each further chunk is one more pass over the written result of the pass before, so that one
chunk is in memory at a time. An item is never split. Documents are never shuffled.

Null and empty texts have no words and no hits; items without words have no pattern; an item with a null
id hits words but is not listed. Very long texts are searched whole, in linear time. Repeated documents are
judged each by itself; of repeated items every id is listed once. With an empty benchmark nothing is hit; an
empty table of documents gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .word_cache import hold

WINDOW = 10
#: A-Z to a-z; all that is no letter, digit or non-ASCII byte to a space
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TO_WORDS).split()


class WuManber:
    """Search for many word sequences of one length."""

    def __init__(self, length: int):
        self.length, self.words, self.shift = length, {}, {}
        self.buckets: dict[object, list[tuple[list[bytes], int]]] = {}
        self.block = min(2, length)
        self.known: dict[tuple[bytes, ...], int] = {}

    def add(self, pattern: list[bytes]) -> int:
        """Number of the pattern; equal patterns have one number."""
        key = tuple(pattern)
        number = self.known.get(key)
        if number is not None:
            return number
        number = self.known[key] = len(self.known)
        m, numbers = self.length, [self.words.setdefault(w, len(self.words)) for w in pattern]
        for end in range(self.block - 1, m):
            block = self._key(numbers, end)
            self.shift[block] = min(self.shift.get(block, m), m - 1 - end)
        self.buckets.setdefault(self._key(numbers, m - 1), []).append((pattern, number))
        return number

    def _key(self, numbers: list[int], end: int) -> int:
        return numbers[end] if self.block == 1 else numbers[end - 1] << 32 | numbers[end]

    def find(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """(first word, pattern) of every occurrence, in order."""
        m, n, position, get, two = self.length, len(words), self.length - 1, self.words.get, self.block == 2
        shift = self.shift
        while position < n:
            block = get(words[position])
            if block is None:
                position += m
                continue
            if two:
                before = get(words[position - 1])
                if before is None:
                    position += m - 1
                    continue
                block |= before << 32
            step = shift.get(block, m - 1 if two else m)
            if step:
                position += step
                continue
            start = position - m + 1
            here = words[start : position + 1]
            for pattern, number in self.buckets[block]:
                if pattern == here:
                    yield start, number
            position += 1


class Benchmark:
    """All patterns of some items."""

    def __init__(self, items: Iterable[tuple[int | None, bytes | None]], window: int = WINDOW):
        self.searches: dict[int, WuManber] = {}
        self.items: dict[tuple[int, int], set[int | None]] = {}
        for item_id, text in items:
            words = words_of(text)
            length = min(window, len(words))
            if not length:
                continue
            search = self.searches.setdefault(length, WuManber(length))
            for i in range(len(words) - length + 1):
                self.items.setdefault((length, search.add(words[i : i + length])), set()).add(item_id)

    def spans(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged spans of hit words (end exclusive), and the ids of items that occur."""
        found, items = [], set()
        for length, search in self.searches.items():
            for start, number in search.find(words):
                found.append((start, start + length))
                items |= self.items[length, number]
        return merge_spans(found), {i for i in items if i is not None}


def merge_spans(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    chunk_bytes: int = 4 << 20,
    names: tuple[str, str, str] = ("n_words", "hit_spans", "hit_items"),
) -> DataFrame:
    """docs(..., text) with three columns: number of words, hit spans (array<struct<start,end>> of words) and
    hit items (array<long>, ascending). They are called ``names`` and replace columns so called, in whatever
    case; all other columns are kept."""
    spark = docs.sparkSession
    common.tune(spark)
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-int(size) // chunk_bytes))
    kinds = ("long", "array<struct<start:long,end:long>>", "array<long>")
    fields = [T.StructField(n, T._parse_datatype_string(k)) for n, k in zip(names, kinds)]
    out = docs
    for k in range(chunks):
        chosen = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks)) == k) if chunks > 1 else benchmark
        rows = chosen.select(F.col("item_id").cast("long"), "text").collect()
        shared = spark.sparkContext.broadcast([(r[0], None if r[1] is None else r[1].encode()) for r in rows])
        if k:  # one chunk in memory at a time
            out = common.materialize(out, "decontaminate")
        out = common.with_columns(out, ["text", *names[1:]] if k else "text", fields, _search(shared, window))
    return out


def _search(shared, window: int):
    def task():
        hold("decontaminate", lambda: None)
        patterns = Benchmark(shared.value, window)

        def found(texts: pa.Array, *before: pa.Array) -> list[pa.Array]:
            counts, spans, items = [], [], []
            earlier = zip(*(x.to_pylist() for x in before)) if before else repeat(((), ()))
            for text, (old_spans, old_items) in zip(texts.cast(pa.binary()), earlier):
                words = words_of(text.as_py())
                hit, of = patterns.spans(words)
                if old_spans:
                    hit = merge_spans([*hit, *((s["start"], s["end"]) for s in old_spans)])
                counts.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in hit])
                items.append(sorted(of.union(old_items)))
            return [
                pa.array(counts, pa.int64()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                pa.array(items, pa.list_(pa.int64())),
            ]

        return found

    return task


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, common.table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    listed = F.array_join(F.array_sort(F.transform("hit_items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    )


_WORDS_SQL = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

OP4_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS_SQL} AS w FROM documents),
items AS (SELECT item_id, w, least(10, len(w)) AS m FROM (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark) WHERE len(w) > 0),
patterns AS (
  SELECT DISTINCT item_id, m, array_to_string(w[p:p + m - 1], ' ') AS s
  FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM items)),
lengths AS (SELECT DISTINCT m FROM patterns),
windows AS (
  SELECT r, m, p, array_to_string(w[p:p + m - 1], ' ') AS s
  FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM docs, lengths WHERE len(w) >= m)),
found AS (SELECT r, p, windows.m, item_id FROM windows JOIN patterns ON windows.m = patterns.m AND windows.s = patterns.s),
hits AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + m)) AS q FROM found) GROUP BY r),
ids AS (
  SELECT r, count(*) AS n, string_agg(i, ',' ORDER BY i) AS s
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM found WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hits.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(ids.n, 0) AS BIGINT) AS n_items, sha256(coalesce(ids.s, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN ids USING (r)
"""

QUERIES = {"op4_decontaminate": op4_decontaminate}
ORACLES = {"op4_decontaminate": OP4_SQL}
