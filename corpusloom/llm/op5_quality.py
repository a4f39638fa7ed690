"""Quality classifier: histogram gradient-boosted trees over document statistics.

``document_statistics`` describes a text by shares and counts of characters, words and lines; no label,
language, source or id enters. Trees are fitted on the driver to a bounded sample of labelled documents
(``max_rows``, a documented parameter; chosen by a hash of doc_id, alike at every size), flattened into
arrays and applied batch by batch: a narrow pass over whole texts.

Fitting uses only documents whose crc32 of doc_id (as text) is no multiple of five; the others are held
out. A doc_id with several labels counts with the lowest, one with several texts with the least
statistics. Null labels are ignored. Null and empty texts are scored like any other (all statistics
zero). Without labels every score is one half. Very long texts are read whole, in linear time. Repeated rows
are scored each by itself, an empty table gives an empty one. Columns of documents beside doc_id and text take
no part; ``score`` keeps them.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .boosted_trees import FlatTrees, fit
from .word_cache import hold

THRESHOLD, CHUNK = 0.3, 1 << 24
_SIGNS = b"!?.,;:|%$&#*=+-_/\\<>()[]{}\"'@~^`"


def document_statistics(data: bytes) -> list[float]:
    """Statistics of a text in UTF-8."""
    words = data.split()
    n, n_words = len(data), len(words)
    if not n_words:
        return [0.0] * WIDTH
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper, lower = int(counts[65:91].sum()), int(counts[97:123].sum())
    wide = int(counts[128:].sum())
    letters = upper + lower + wide
    spaces = int(counts[9:14].sum() + counts[32])
    signs = counts[list(_SIGNS)]
    lengths = np.fromiter(map(len, words), np.int64, n_words)
    seen = Counter(words)
    most = seen.most_common(3)
    pairs = len(set(zip(words, words[1:])))
    lines = [x for x in data.split(b"\n") if x.strip()]
    packed = sum(len(zlib.compress(data[i : i + CHUNK], 1)) for i in range(0, n, CHUNK))
    inside = n - spaces
    twice = sum(map(bytes.__eq__, words, words[1:]))
    ends = [w[-1] for w in words]
    return [
        np.log1p(n),
        np.log1p(n_words),
        letters / n,
        upper / max(1, upper + lower),
        int(counts[48:58].sum()) / n,
        wide / n,
        spaces / n,
        int(counts[10]) / n_words,
        int(counts[:9].sum() + counts[14:32].sum() + counts[127]) / n,
        (inside - letters - int(counts[48:58].sum())) / n_words,
        *(signs / n_words),
        float(signs.max()) / n_words,
        float(lengths.mean()),
        float(lengths.std()),
        float(lengths.max()),
        float((lengths <= 3).mean()),
        float((lengths >= 12).mean()),
        len(seen) / n_words,
        most[0][1] / n_words,
        sum(c for _, c in most) / n_words,
        len(seen) / n_words**0.75,
        pairs / max(1, n_words - 1),
        twice / n_words,
        np.log1p(len(lines)),
        len(set(lines)) / max(1, len(lines)),
        n_words / max(1, len(lines)),
        sum(x.rstrip()[-1:] in b".!?" for x in lines) / max(1, len(lines)),
        sum(c == 46 for c in ends) / n_words,
        sum(c < 48 and c not in (44, 46) for c in ends) / n_words,
        packed / n,
    ]


WIDTH = 0
WIDTH = len(document_statistics(b"a"))


def _held_out(doc_id):
    """crc32 of a null doc_id is taken as that of the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(5)) == 0


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of about ``max_rows`` labelled documents that aren't held out, or of all if
    there are fewer. Only these documents reach Python; only their statistics reach the driver."""
    known = (
        labels.where("doc_id is not null and quality in (0, 1)")
        .where(~_held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").cast("int").alias("label"))
    )
    n = known.count()
    if n > max_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) < int((1 << 20) * max_rows / n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("quality", lambda: None)
        for batch in batches:
            stats = [document_statistics(t.as_py() or b"") for t in batch.column(2).cast(pa.binary())]
            columns = [batch.column(0), batch.column(1), pa.array(stats, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "label", "stats"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id").select("doc_id", "label", "text")
    found = chosen.mapInArrow(run, "doc_id long, label int, stats array<double>")
    rows = found.groupBy("doc_id", "label").agg(F.min("stats").alias("stats")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    stats = np.array([r["stats"] for r in rows], float).reshape(len(rows), WIDTH)
    return stats, np.array([r["label"] for r in rows], float)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, **parameters) -> FlatTrees:
    common.tune(docs.sparkSession)
    return fit(*training_rows(docs, labels, max_rows), **parameters)


def score(docs: DataFrame, trees: FlatTrees, out: str = "score") -> DataFrame:
    """docs(..., text) with the probability of good quality in column ``out`` (replaced if there is one, in
    whatever case; all other columns are kept)."""
    common.tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def task():
        hold("quality", lambda: None)
        model = shared.value

        def scores(texts: pa.Array) -> list[pa.Array]:
            stats = [document_statistics(t.as_py() or b"") for t in texts.cast(pa.binary())]
            return [pa.array(model.scores(np.array(stats, float).reshape(len(stats), WIDTH)), pa.float64())]

        return scores

    return common.with_columns(docs, "text", [T.StructField(out, T.DoubleType())], task)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, common.table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", _held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


QUERIES = {"op5_quality": op5_quality}
ORACLES: dict[str, str] = {}
