"""Paired bootstrap over groups: exact multinomial resamples without a row for each row and resample."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def slice_counts(seed: int, sizes: list[int], place: int, resamples: int) -> np.ndarray:
    """How many of sum(sizes) draws fall in slice ``place``, for each resample. The draws are split at each node of a binary
    tree over the slices, binomially by the nodes' sizes, so that the counts of all slices are one multinomial
    draw, and a task needs the nodes above its slice only."""
    node, low, high, drawn = 1, 0, len(sizes), np.full(resamples, sum(sizes), np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        left, whole = sum(sizes[low:middle]), sum(sizes[low:high])
        share = np.random.default_rng([seed, 0, node]).binomial(drawn, left / whole if whole else 0.0)
        if place < middle:
            node, high, drawn = 2 * node, middle, share
        else:
            node, low, drawn = 2 * node + 1, middle, drawn - share
    return drawn


def slice_sums(seed: int, place: int, values: np.ndarray, drawn: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """For each resample the sum of so many values, drawn with replacement. Where few values are distinct, how often each is
    drawn is one multinomial draw: the same distribution, and no work for each row."""
    rng, out = np.random.default_rng([seed, 1, place]), np.zeros(len(drawn))
    distinct, copies = np.unique(values, return_counts=True)
    if len(distinct) and 4 * len(distinct) <= drawn.mean():
        step = max(1, most // len(distinct))
        for first in range(0, len(drawn), step):
            out[first : first + step] = rng.multinomial(drawn[first : first + step], copies / len(values)) @ distinct
        return out
    ends, first = np.cumsum(drawn), 0
    while first < len(drawn):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, side="right")))
        part = drawn[first:last]
        picked = values[rng.integers(0, len(values), int(part.sum()))] if len(values) else np.zeros(0)
        out[first:last] = np.bincount(np.repeat(np.arange(len(part)), part), weights=picked, minlength=len(part))
        first = last
    return out


def paired_interval(df: DataFrame, group: str, value: str, resamples: int = 10_000, seed: int = 3407, level: float = 0.95, slices: int = 64) -> DataFrame:
    """One row (n, mean, low, high, wins, losses, ties): the mean over groups of a group's mean paired difference
    ``value``, and the percentile interval of its bootstrap, groups drawn with replacement.

    Groups are dealt into slices by hash and put in order there. How many draws fall in a slice follows from the slices'
    sizes (one small row each), so a task draws within its slice and gives out one partial sum for each resample: at
    most slices * resamples numbers are shuffled, whatever the rows. A task holds the means of its slice's groups.
    Null groups and differences take no part; nothing in, no row out. The same seed gives the same resamples on any
    cluster.
    """
    unit = df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(F.col(group).cast("string").alias("unit"))
    means = unit.agg(F.avg(F.col(value).cast("double")).alias("d")).withColumn("slice", F.pmod(F.xxhash64("unit"), F.lit(slices)).cast("int"))
    found = {r["slice"]: r["n"] for r in means.groupBy("slice").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = [found.get(i, 0) for i in range(slices)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held = None, []

        def sums() -> pa.RecordBatch:
            drawn = slice_counts(seed, sizes, place, resamples)
            total = slice_sums(seed, place, np.concatenate(held), drawn)
            return pa.RecordBatch.from_arrays([pa.array(np.arange(resamples)), pa.array(total)], ["resample", "total"])

        for batch in batches:
            at, values = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for part in np.split(np.arange(len(at)), np.flatnonzero(at[1:] != at[:-1]) + 1):
                if len(part) and at[part[0]] != place:
                    if held:
                        yield sums()
                    place, held = int(at[part[0]]), []
                held.append(values[part])
        if held:
            yield sums()

    dealt = means.repartition(slices, "slice").sortWithinPartitions("slice", "unit").select("slice", "d")
    totals = dealt.mapInArrow(run, "resample long, total double").groupBy("resample").agg(F.sum("total").alias("total"))
    boots = totals.agg(F.array_sort(F.collect_list(F.col("total") / sum(sizes))).alias("boots")) if sum(sizes) else None
    told = means.agg(
        F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean"), *[F.count(F.when(c, 1)).alias(k) for k, c in (("wins", F.col("d") > 0), ("losses", F.col("d") < 0), ("ties", F.col("d") == 0))]
    )
    if boots is None:
        return told.select("n", "mean", F.lit(0.0).alias("low"), F.lit(0.0).alias("high"), "wins", "losses", "ties").where("n > 0")
    edge = (1 - level) / 2
    ends = [F.get("boots", F.lit(int(q * resamples))).alias(k) for k, q in (("low", edge), ("high", 1 - edge))]
    return told.crossJoin(boots.select(*ends)).select("n", "mean", "low", "high", "wins", "losses", "ties")
