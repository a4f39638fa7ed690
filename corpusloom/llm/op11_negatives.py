"""Hard negatives, mined through a pivot table.

Components become whole numbers (floor(scale * x)); a row's score for an anchor is their inner product. A row x gets
one more component, sqrt(M - |x|^2), with M the largest squared length of all rows, and an anchor q gets a zero:
then the squared distance of the two is |q|^2 + M - 2 * score, so nearness orders rows as scores do. Distances to
``pivots`` rows are the pivot table: |d(q, p) - d(x, p)| <= d(q, x) <= d(q, p) + d(x, p) brackets every score from above
and below. What the brackets cannot rule out is checked exactly.

Brackets work on three levels: of cells (the rows nearest to one pivot), before an anchor is sent anywhere; of groups of
256 rows, and of rows, in the task. Positives of an anchor are its best rows of the same label; what they must reach
is first told by a bounded sample of rows. Their scores give each positive a window, and the negatives are the best rows of
other labels in it: rows whose bracket misses all windows of an anchor are ruled out, as are those below what the sample
already offers for each window. So pruning depends on how the rows lie (on evenly spread directions the triangle
inequality tells little), the results don't.

Rows are dealt by cell, and cells by a hash of vec_id into blocks of bounded bytes, so that very many equal vectors are
several tasks; anchors go to the blocks they can't rule out by the same shuffle and stream past a block's rows. A task
gives out only the best rows of each anchor (and positive). Pivots are chosen, farthest first, from the sample
(``sample`` rows of smallest hash, documented bound); every row is in the table. Nothing else goes through the driver
than one row for each pair of pivots.

Rows with a null vec_id or label, a null vector, or a null or non-finite component take no part, nor do vectors of a squared
length of 2 ** 62 or more, whose scores 64 bits can't hold. Vectors of unequal length are compared as if the shorter
one ended in zeros; empty and zero vectors score 0. Rows that repeat a vec_id are one (the least label, then vector).
Anchors without a row of their label, and windows without rows, give nothing; fewer than asked for: all of them. Ties go
to the smaller vec_id. Other columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .word_cache import hold

GROUP = 256


def usable(rows: DataFrame, label: Column, scale: int = 256) -> DataFrame:
    """(vec_id long, label long, v array<long>) of the rows that take part, one for each vec_id."""
    v = F.col("embedding").cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    taken = rows.where(F.col("vec_id").isNotNull() & label.isNotNull() & F.col("embedding").isNotNull() & F.coalesce(whole, F.lit(False)))
    numbers = taken.select(
        F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.transform(v, lambda x: F.floor(x * F.lit(float(scale)))).alias("v")
    )
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    numbers = numbers.withColumn("square", squares).where(F.col("square") < float(1 << 62))
    again = common.materialize(numbers.groupBy("vec_id").count().where("count > 1").select("vec_id"), "repeated-ids")
    if again.isEmpty():
        return numbers
    least = numbers.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("label", "v", "square")).alias("x"))
    once = numbers.join(again, "vec_id", "left_anti").unionByName(least.select("vec_id", "x.*"))
    return common.materialize(once, "vectors")


class Space:
    """Pivots and what turns scores into distances. Immutable and small: it goes with the tasks."""

    def __init__(self, sample: pa.Table, dimension: int, most: float, pivots: int):
        self.dimension, self.most = max(1, dimension), most * (1 + 1e-9) + 1
        #: whole numbers below 2 ** 53 are exact as doubles, so are all their sums here
        self.kind = np.float64 if self.most < 1 << 53 else np.int64
        self.ids, self.labels = np.asarray(sample["vec_id"]), np.asarray(sample["label"])
        self.sample = self.matrix(sample["v"].combine_chunks())
        chosen, far = [], np.full(len(self.ids), np.inf)
        lifted = self.lifted(self.sample)
        while len(chosen) < min(pivots, len(self.ids)) and far.max() > 0:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, ((lifted - lifted[chosen[-1]]) ** 2).sum(1))
        self.pivots = lifted[chosen]
        self.square = (self.pivots * self.pivots).sum(1)

    def matrix(self, lists: pa.Array) -> np.ndarray:
        """Vectors as rows, filled up with zeros."""
        sizes = np.diff(np.asarray(lists.offsets))
        flat = np.asarray(lists.flatten()).astype(self.kind)
        if len(sizes) and (sizes == self.dimension).all():
            return flat.reshape(len(sizes), self.dimension)
        out = np.zeros((len(sizes), self.dimension), self.kind)
        out[np.arange(self.dimension) < sizes[:, None]] = flat
        return out

    def lifted(self, rows: np.ndarray) -> np.ndarray:
        rows = rows.astype(float)
        return np.hstack([rows, np.sqrt(np.maximum(0.0, self.most - (rows * rows).sum(1)))[:, None]])

    def distances(self, lifted: np.ndarray) -> np.ndarray:
        """Pivot table: a row's distances to all pivots."""
        squares = (lifted * lifted).sum(1)[:, None] + self.square - 2 * lifted @ self.pivots.T
        return np.sqrt(np.maximum(0.0, squares))

    def asked(self, q: np.ndarray) -> tuple[np.ndarray, float]:
        """Distances of an anchor (with a zero) to the pivots, and |q|^2 + M."""
        own = np.append(q.astype(float), 0.0)[None]
        return self.distances(own)[0], float((own * own).sum()) + self.most

    def open(self, least: np.ndarray, most: np.ndarray, asked: tuple[np.ndarray, float], low: float, high: float) -> np.ndarray:
        """Which rows, or groups of distances from ``least`` to ``most``, may have a score in [low, high]."""
        own, whole = asked
        # squared distances carry rounding of about 1e-15 of 4 M; near zero the root makes it larger
        slack = 1e-6 * whole + 1
        near = np.maximum(np.maximum(least - own, own - most).max(1), 0.0)
        far = (most + own).min(1)
        return ((whole - near * near) / 2 >= low - slack) & ((whole - far * far) / 2 <= high + slack)


class Block:
    """The rows of one block, by label, in groups."""

    def __init__(self, space: Space, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray):
        table = space.distances(space.lifted(rows))
        order = np.lexsort((table.min(1), table.argmin(1), labels))
        self.space, self.ids, self.labels, self.rows, self.table = space, ids[order], labels[order], rows[order], table[order]
        starts = np.arange(0, len(ids), GROUP)
        self.least, self.most = np.minimum.reduceat(self.table, starts), np.maximum.reduceat(self.table, starts)
        self.first, self.last = self.labels[starts], self.labels[np.minimum(starts + GROUP, len(ids)) - 1]

    def scores(self, q: np.ndarray, label: int, same: bool, low: float, high: float, own_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the rows of the same or of other labels that may score in [low, high]; exact scores."""
        asked = self.space.asked(q)
        fits = (self.first <= label) & (self.last >= label) if same else (self.first != label) | (self.last != label)
        groups = np.flatnonzero(fits & self.space.open(self.least, self.most, asked, low, high))
        rows = (groups[:, None] * GROUP + np.arange(GROUP)).ravel()
        rows = rows[rows < len(self.ids)]
        rows = rows[((self.labels[rows] == label) == same) & (self.ids[rows] != own_id)]
        table = self.table[rows]
        rows = rows[self.space.open(table, table, asked, low, high)]
        return self.ids[rows], self.rows[rows] @ q


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> Iterator[tuple[int, int]]:
    """(id, score) of the k highest scores, ties by id."""
    if len(ids) > k:
        edge = np.partition(scores, -k)[-k]
        ids, scores = ids[scores >= edge], scores[scores >= edge]
    order = np.lexsort((ids, -scores))[:k]
    return zip(ids[order].tolist(), (int(s) for s in scores[order]))


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """Whole numbers s with low * score <= 100 * s <= high * score."""
    return -(-low * score // 100), high * score // 100


def _cells(space: Space) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("negatives", lambda: None)
        for batch in batches:
            table = space.distances(space.lifted(space.matrix(batch.column(2))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(table.argmin(1), pa.int32())], ["vec_id", "label", "v", "cell"])

    return run


def _ranges(space: Space) -> Callable:
    """For each cell the smallest and largest distance to each pivot, of one task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("negatives", lambda: None)
        n = len(space.pivots)
        least, most, count = np.full((n, n), np.inf), np.full((n, n), -np.inf), np.zeros(n, np.int64)
        for batch in batches:
            table, cells = space.distances(space.lifted(space.matrix(batch.column(0)))), np.asarray(batch.column(1))
            np.minimum.at(least, cells, table)
            np.maximum.at(most, cells, table)
            count += np.bincount(cells, minlength=n)
        cell, pivot = np.divmod(np.arange(n * n), n)
        kept = np.flatnonzero(count[cell])
        columns = [cell, pivot, least.ravel(), most.ravel(), count[cell]]
        yield pa.RecordBatch.from_arrays([pa.array(c[kept]) for c in columns], ["cell", "pivot", "least", "most", "n"])

    return run


class _Search:
    """What an anchor asks for: its best positives, or the best negatives in its positives' windows."""

    def __init__(self, space: Space, low: int = 50, high: int = 95, positives: int = 5, negatives: int = 3):
        self.space, self.low, self.high, self.positives, self.negatives = space, low, high, positives, negatives

    def bounds(self, anchor: int, label: int, q: np.ndarray, found: list | None) -> tuple[float, float]:
        """Scores between which an anchor's rows lie, as far as the sample tells."""
        space = self.space
        mine = space.ids != anchor
        scores = space.sample @ q
        if found is None:
            told = scores[mine & (space.labels == label)]
            k = self.positives
            return (float(np.partition(told, -k)[-k]) if len(told) >= k else -np.inf), np.inf
        told, k, lows, highs = scores[mine & (space.labels != label)], self.negatives, [], []
        for p in found:
            a, b = window(p["score"], self.low, self.high)
            if a <= b:
                inside = told[(told >= a) & (told <= b)]
                lows.append(float(np.partition(inside, -k)[-k]) if len(inside) >= k else a)
                highs.append(b)
        return min(lows, default=np.inf), max(highs, default=-np.inf)

    def cells(self, least: np.ndarray, most: np.ndarray) -> Callable:
        """Adds to each anchor (vec_id, label, v, found) the cells it can't rule out, and its bounds."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hold("negatives", lambda: None)
            for batch in batches:
                asks = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), self.space.matrix(batch.column(2)), batch.column(3).to_pylist())
                bounds = [self.bounds(*x) for x in asks]
                open_ = [
                    np.flatnonzero(self.space.open(least, most, self.space.asked(q), *b)).astype(np.int32) if b[0] <= b[1] else []
                    for q, b in zip(self.space.matrix(batch.column(2)), bounds)
                ]
                low, high = (pa.array([float(b[i]) for b in bounds], pa.float64()) for i in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, low, high, pa.array(open_, pa.list_(pa.int32()))], ["vec_id", "label", "v", "found", "low", "high", "cells"]
                )

        return run

    def blocks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a block, then the anchors that ask it: (cell, slice, asks, vec_id, label, v, found, low, high)."""
        hold("negatives", lambda: None)
        of, held, block = None, [], None
        for batch in batches:
            keys = [np.asarray(batch.column(i)).astype(np.int64) for i in (0, 1)] + [np.asarray(batch.column(2).cast(pa.int8()))]
            change = np.any([k[1:] != k[:-1] for k in keys], axis=0)
            out: list[tuple] = []
            for rows in np.split(np.arange(batch.num_rows), np.flatnonzero(change) + 1):
                if not len(rows):
                    continue
                part, now = batch.slice(rows[0], len(rows)), (keys[0][rows[0]], keys[1][rows[0]])
                if now != of:
                    of, held, block = now, [], None
                ids, labels, vectors = np.asarray(part.column(3)), np.asarray(part.column(4)), self.space.matrix(part.column(5))
                if not keys[2][rows[0]]:
                    held.append((ids, labels, vectors))
                    continue
                if block is None and held:
                    block, held = Block(self.space, *(np.concatenate(x) for x in zip(*held))), []
                if block is not None:
                    asks = zip(ids.tolist(), labels.tolist(), vectors, *(part.column(i).to_pylist() for i in (6, 7, 8)))
                    for ask in asks:
                        out += self.answer(block, *ask)
            names = ["anchor_id", "positive_id", "positive_score", "vec_id", "score"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(5)], names)

    def answer(self, block: Block, anchor: int, label: int, q: np.ndarray, found: list | None, low: float, high: float) -> Iterator[tuple]:
        ids, scores = block.scores(q, label, found is None, low, high, anchor)
        if found is None:
            yield from ((anchor, None, None, i, s) for i, s in best(ids, scores, self.positives))
            return
        for p in found:
            a, b = window(p["score"], self.low, self.high)
            inside = (scores >= a) & (scores <= b)
            yield from ((anchor, p["vec_id"], p["score"], i, s) for i, s in best(ids[inside], scores[inside], self.negatives))


FOUND = "array<struct<vec_id: long, score: long>>"


def hard_negatives(
    rows: DataFrame, anchors: Column, low: int = 50, high: int = 95, positives: int = 5, negatives: int = 3,
    pivots: int = 32, sample: int = 2048, block: int = 1 << 15,
) -> DataFrame:
    """rows(vec_id, label, v, square) of ``usable`` -> anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score: for each row that ``anchors`` holds of, and each of its ``positives`` best rows of the same label, the
    ``negatives`` best rows of other labels that score from ``low`` to ``high`` percent of the positive."""
    spark = rows.sparkSession
    common.tune(spark)
    about = rows.agg(F.max(F.size("v")).alias("d"), F.max("square").alias("m"), F.count(F.lit(1)).alias("n")).first()
    none = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not about["n"]:
        return spark.createDataFrame([], none)
    chosen = rows.select("vec_id", "label", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    space = Space(chosen, about["d"], about["m"], pivots)
    celled = common.materialize(rows.select("vec_id", "label", "v").mapInArrow(_cells(space), "vec_id long, label long, v array<long>, cell int"), "cells")
    ranges = celled.select("v", "cell").mapInArrow(_ranges(space), "cell long, pivot long, least double, most double, n long")
    told = ranges.groupBy("cell", "pivot").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.sum("n").alias("n")).toArrow()
    n = len(space.pivots)
    least, most, counts = np.full((n, n), np.inf), np.full((n, n), -np.inf), np.zeros(n, np.int64)
    at = (told["cell"].to_numpy(), told["pivot"].to_numpy())
    least[at], most[at], counts[at[0]] = told["least"].to_numpy(), told["most"].to_numpy(), told["n"].to_numpy()
    size = max(GROUP, min(block, (1 << 22) // space.dimension))
    slices = spark.createDataFrame([(c, int(-(-k // size))) for c, k in enumerate(counts.tolist()) if k], "cell int, slices int")
    search = _Search(space, low, high, positives, negatives)

    def answered(asks: DataFrame) -> DataFrame:
        marked = asks.mapInArrow(search.cells(least, most), f"vec_id long, label long, v array<long>, found {FOUND}, low double, high double, cells array<int>")
        sent = marked.select("*", F.explode("cells").alias("cell")).join(F.broadcast(slices), "cell")
        sent = sent.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).withColumn("asks", F.lit(True))
        held = celled.join(F.broadcast(slices), "cell").withColumn("slice", F.pmod(F.xxhash64("vec_id"), F.col("slices")).cast("int"))
        held = held.withColumns({"asks": F.lit(False), "found": F.lit(None).cast(FOUND), "low": F.lit(0.0), "high": F.lit(0.0)})
        names = ["cell", "slice", "asks", "vec_id", "label", "v", "found", "low", "high"]
        dealt = held.select(names).unionByName(sent.select(names)).repartition("cell", "slice").sortWithinPartitions("cell", "slice", "asks")
        return dealt.mapInArrow(search.blocks, "anchor_id long, positive_id long, positive_score long, vec_id long, score long")

    def ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    asking = celled.where(anchors).select("vec_id", "label", "v")
    first = ranked(answered(asking.withColumn("found", F.lit(None).cast(FOUND))), ["anchor_id"], positives)
    kept = first.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("vec_id", "score")).alias("found"))
    kept = common.materialize(kept, "positives")
    second = ranked(answered(asking.join(kept, "vec_id").select("vec_id", "label", "v", "found")), ["anchor_id", "positive_id"], negatives)
    out = common.materialize(
        second.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")),
        "negatives",
    )
    common.drop_tables(celled, kept)
    return out


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(usable(common.table(spark, sf_dir, "embeddings"), label), F.col("vec_id") % 50 == 0)


SQL = """
WITH e AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT * FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
  s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY rank <= 3
"""

QUERIES = {"op11_negatives": op11_negatives}
ORACLES = {"op11_negatives": SQL}
