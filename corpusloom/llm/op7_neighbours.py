"""Approximate nearest neighbours by collision counting.

Vectors are scaled to length one, so that the nearest by distance are those of the largest cosine. Each of
``lines`` projections orders a block's vectors in a sorted array. A query opens a window around its own place
in every array, ``width`` radii to either side; a vector inside the window collides there. Vectors that
collide on ``needed`` lines or more are verified by their exact cosine. Windows are widened over the same
arrays (virtual rehashing) until k vectors are verified, and then to the distance of the k-th best of them:
any nearer vector has been verified by then, but for the chance ``miss``.

Collision probabilities. The lines are scaled orthonormal bases, so the difference of two vectors at distance
r is about normal with deviation r on each line, and the squares over a whole basis add up exactly. A vector
at the radius collides on a line with p = P(|N| <= width), and its number of collisions over a basis of d
lines has the variance d * (p (1 - p) - (2 width phi(width))^2 / 2), much less than that of independent
lines. ``needed`` is the mean less as many deviations as ``miss`` allows. With 128 lines in 64 dimensions a
random vector, at distance 1.41, then passes the windows of a radius of 1.15 in about one case of twenty. No
cap ends a search: what collides often enough is verified.

A counting pass touches, for each line, the vectors inside the window or those outside, whichever are fewer.

Rows are dealt into blocks by a hash of vec_id, at most about ``block`` vectors each. The queries are sent to
every block by the same shuffle and arrive sorted behind its vectors, so a task indexes a block once, reads
queries as a stream, and gives out the k best of each; only those are merged. Nothing goes through the
driver. A query meets every block, so the work is the number of queries times the number of vectors times
the lines' smaller sides; only the share that is verified shrinks.

Equal vectors are one entry that keeps its k + 1 smallest ids, as no more can be among the k nearest of any
query. Vectors that are null, zero, or hold null or non-finite components take no part, as queries or as
candidates; vectors of another dimension than a query's are no candidates of it. Rows that repeat a vec_id
are made one vector (the least, compared as arrays) before indexing; null vec_ids take no part. Fewer than k
candidates: all of them. Ties go to the smaller vec_id. Other columns are ignored, whatever their names. An
empty table gives an empty table. Scores are computed in double precision from the vectors as given.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .word_cache import hold

FOUND = "query_id long, vec_id long, score double, verified long"


def scaled_bases(dimension: int, lines: int, seed: int) -> np.ndarray:
    """``lines`` directions (columns) of length sqrt(dimension), orthogonal within each whole basis."""
    rng = np.random.default_rng(seed)
    bases = [np.linalg.qr(rng.standard_normal((dimension, dimension)))[0] for _ in range(-(-lines // dimension))]
    return np.concatenate(bases, 1)[:, :lines] * math.sqrt(dimension)


def collisions_needed(dimension: int, lines: int, width: float, miss: float) -> int:
    """Collisions that a vector at the radius reaches but for the chance ``miss``."""
    p = math.erf(width / math.sqrt(2))
    density = math.exp(-width * width / 2) / math.sqrt(2 * math.pi)
    variance = 0.0
    for first in range(0, lines, dimension):
        size = min(dimension, lines - first)
        variance += size * max(0.0, p * (1 - p) - size / dimension * (2 * width * density) ** 2 / 2)
    low, high = 0.0, 8.0
    for _ in range(60):  # deviations d with P(N > d) = miss
        middle = (low + high) / 2
        low, high = (middle, high) if math.erfc(middle / math.sqrt(2)) / 2 > miss else (low, middle)
    return max(1, math.floor(lines * p - low * math.sqrt(variance)))


class CollisionIndex:
    """Sorted projections of one block of vectors of one dimension."""

    def __init__(
        self, ids: np.ndarray, vectors: np.ndarray, k: int, lines: int = 128, width: float = 1.6, miss: float = 0.05, seed: int = 7
    ):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        _, first, group = np.unique(vectors.view(f"V{vectors.shape[1] * 8}").ravel(), return_index=True, return_inverse=True)
        self.k, self.width, self.vectors = k, width, vectors[first]
        self.lengths = np.sqrt((self.vectors * self.vectors).sum(1))
        by_group = np.argsort(group, kind="stable")
        starts = np.searchsorted(group[by_group], np.arange(len(first) + 1))
        self.members = [ids[by_group[a : min(b, a + k + 1)]] for a, b in zip(starts[:-1], starts[1:])]
        dimension, n = vectors.shape[1], len(first)
        self.needed = collisions_needed(dimension, lines, width, miss)
        self.lines = scaled_bases(dimension, lines, seed)
        unit = self.vectors / self.lengths[:, None]
        places = (unit @ self.lines).T
        self.order = np.argsort(places, axis=1, kind="stable")
        # one array of all lines, each shifted to a range of its own, so that one search serves them all
        self.step = 4 * math.sqrt(dimension) + 16 * width
        self.shift = np.arange(lines) * self.step
        self.sorted = (np.take_along_axis(places, self.order, 1) + self.shift[:, None]).ravel()
        self.first = np.arange(lines) * n
        self.start = self._usual_radius(unit)

    def _usual_radius(self, unit: np.ndarray, sample: int = 64) -> float:
        """A low estimate of the k-th neighbour's distance, from some of the block's own vectors."""
        n = len(unit)
        if n <= self.k + 1:
            return 0.1
        cosines = unit[:: max(1, n // sample)] @ unit.T
        kth = np.partition(cosines, n - self.k - 1, axis=1)[:, n - self.k - 1]
        return float(min(2.0, max(0.01, np.quantile(np.sqrt(np.maximum(0.0, 2 - 2 * kth)), 0.25))))

    def nearest(self, query_id: int, query: np.ndarray) -> tuple[list[tuple[float, int]], int]:
        """(cosine, vec_id) of the k nearest found, nearest first, the query's own id left out; and how many
        vectors were verified."""
        n, order = len(self.vectors), self.order
        length = np.sqrt((query * query).sum())
        at = (query / length) @ self.lines + self.shift
        base, count, open_ = 0, np.zeros(n, np.int64), np.ones(n, bool)
        low = high = None
        best: list[tuple[float, int]] = []
        radius = self.start
        while True:
            reach = min(self.width * radius, self.step / 4)
            a = np.searchsorted(self.sorted, at - reach) - self.first
            b = np.searchsorted(self.sorted, at + reach, side="right") - self.first
            np.clip(a, 0, n, out=a)
            np.clip(b, 0, n, out=b)
            more, less = [], []
            if low is None:
                for line, i, j in zip(order, a.tolist(), b.tolist()):
                    if 2 * (j - i) > n:
                        base += 1
                        less += [line[:i], line[j:]]
                    else:
                        more.append(line[i:j])
            else:
                for line, i, before, after, j in zip(order, a.tolist(), low.tolist(), high.tolist(), b.tolist()):
                    more += [line[i:before], line[after:j]]
            low, high = a, b
            if more:
                count += np.bincount(np.concatenate(more), minlength=n)
            if less:
                count -= np.bincount(np.concatenate(less), minlength=n)
            # beyond any distance of two unit vectors the rest is verified as well
            found = np.flatnonzero((count >= self.needed - base) & open_ if radius <= 2 else open_)
            if len(found):
                open_[found] = False
                scores = (self.vectors[found] * query).sum(1) / (self.lengths[found] * length)
                if len(found) > self.k + 1:  # ties with the last are kept
                    edge = np.partition(scores, -(self.k + 1))[-(self.k + 1)]
                    found, scores = found[scores >= edge], scores[scores >= edge]
                best += [(s, i) for s, f in zip(scores.tolist(), found.tolist()) for i in self.members[f].tolist() if i != query_id]
                best.sort(key=lambda x: (-x[0], x[1]))
                del best[self.k :]
            if radius > 2:
                return best, n
            if len(best) < self.k:
                radius *= 1.2
                continue
            farthest = math.sqrt(max(0.0, 2 - 2 * best[-1][0]))
            if farthest <= radius:
                return best, n - int(open_.sum())
            radius = farthest


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id long, v array<float or double>) of the rows that take part."""
    v = F.col("embedding")
    if vectors.schema["embedding"].dataType != T.ArrayType(T.FloatType(), True):
        v = v.cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & whole
    )


def once_each(vectors: DataFrame) -> DataFrame:
    """One row, the least, of each vec_id. Only ids are shuffled, and the vectors of those that repeat."""
    again = common.materialize(vectors.groupBy("vec_id").count().where("count > 1").select("vec_id"), "repeated-ids")
    if again.isEmpty():
        return vectors
    least = vectors.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("v").alias("v"))
    return common.materialize(vectors.join(again, "vec_id", "left_anti").unionByName(least), "vectors")


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 1 << 15, least_block: int = 1 << 12, **index
) -> DataFrame:
    """(query_id, rank, vec_id, score, verified) of the k nearest vectors(vec_id, v) of each of
    queries(vec_id, v); verified: how many vectors were compared exactly for the query. A written table of the
    shared folder."""
    spark = vectors.sparkSession
    # repeats of a vec_id would take places of other vectors, in a task or among the k best
    vectors, queries = once_each(vectors), queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    n = vectors.count()
    # small tables are cut for the sake of parallel work
    blocks = max(1, -(-n // block), min(2 * spark.sparkContext.defaultParallelism, -(-n // least_block)))
    own = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = vectors.select(own.alias("block"), F.lit(False).alias("asks"), "vec_id", "v").unionByName(
        queries.select(every.alias("block"), F.lit(True).alias("asks"), "vec_id", "v")
    )
    common.tune(spark)
    found = common.materialize(
        dealt.repartition(blocks, "block").sortWithinPartitions("block", "asks").mapInArrow(_search(k, index), FOUND), "neighbours"
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.where("vec_id is not null").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    verified = found.groupBy("query_id").agg(F.sum("verified").alias("verified"))
    chosen = ranked.drop("verified").join(verified, "query_id").select("query_id", "rank", "vec_id", "score", "verified")
    out = common.materialize(chosen, "nearest")
    common.drop_tables(found)
    return out


def _rows(batch: pa.RecordBatch, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of some rows, for each dimension."""
    part = batch.take(pa.array(rows))
    ids, lists = np.asarray(part.column(2)), part.column(3)
    sizes = np.diff(np.asarray(lists.offsets))
    flat = np.asarray(lists.flatten(), dtype=float)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    for size in np.unique(sizes).tolist():
        of = np.flatnonzero(sizes == size)
        yield ids[of], flat[starts[of][:, None] + np.arange(size)]


def _search(k: int, parameters: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("neighbours", lambda: None)
        block, held, indexes = None, {}, None
        for batch in batches:
            blocks, asks = np.asarray(batch.column(0)), np.asarray(batch.column(1).cast(pa.int8()))
            out: list[tuple[int, int | None, float | None, int]] = []
            # runs of one block, vectors before queries
            cuts = np.flatnonzero((blocks[1:] != blocks[:-1]) | (asks[1:] != asks[:-1])) + 1
            for rows in np.split(np.arange(len(blocks)), cuts):
                if not len(rows):
                    continue
                if blocks[rows[0]] != block:
                    block, held, indexes = blocks[rows[0]], {}, None
                if not asks[rows[0]]:
                    for ids, vectors in _rows(batch, rows):
                        held.setdefault(vectors.shape[1], []).append((ids, vectors))
                    continue
                if indexes is None:
                    indexes = {
                        size: CollisionIndex(*(np.concatenate(x) for x in zip(*parts)), k, **parameters) for size, parts in held.items()
                    }
                    held = {}
                for ids, vectors in _rows(batch, rows):
                    index = indexes.get(vectors.shape[1])
                    for query_id, query in zip(ids.tolist(), vectors if index else ()):
                        best, verified = index.nearest(query_id, query)
                        out += [(query_id, i, s, 0) for s, i in best]
                        out.append((query_id, None, None, verified))
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64())
            names = ["query_id", "vec_id", "score", "verified"]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kind) for c, kind in enumerate(kinds)], names)

    return run


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(common.table(spark, sf_dir, "embeddings"))
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))


QUERIES = {"op7_neighbours": op7_neighbours}
ORACLES: dict[str, str] = {}
