"""Deterministic sampling and splitting by hash order. No random generator: the order of sha256 (or md5) of
a salted id stands in for a seeded shuffle, gives the same rows on any engine, and needs no state."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import first_by, hash_row_number


def hash_rank(salt: str, *parts) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(salt), *[F.col(p).cast("string") for p in parts]), 256)


def top_by_hash(df: DataFrame, k: int, salt: str, id_column: str) -> DataFrame:
    """The k rows of smallest hash: a bounded heap in each task, then one merge."""
    return df.withColumn("__h", hash_rank(salt, id_column)).orderBy("__h", id_column).limit(k).drop("__h")


def top_by_hash_per_group(df: DataFrame, k: int, salt: str, group: list[str], id_column: str) -> DataFrame:
    return first_by(df.withColumn("__h", hash_rank(salt, id_column)), group, ["__h", id_column], k).drop("__h")


def stratified_split(df: DataFrame, strata: list[str], id_column: str, shares: dict[str, float], salt: str, rest: str = "train", least: int = 0) -> DataFrame:
    """df with ``split``: in each stratum, by hash order, round-half-even(n * share) rows, at least
    ``least``, go to each named split in turn; the others to ``rest``."""
    out = hash_row_number(df, strata, hash_rank(salt, *strata, id_column), id_column, "__i", "__n")
    end, split = F.lit(0).cast("long"), None
    for name, share in shares.items():
        end = end + F.greatest(F.lit(least).cast("long"), F.bround(F.col("__n") * share).cast("long"))
        split = F.when(F.col("__i") <= end, name) if split is None else split.when(F.col("__i") <= end, name)
    return out.withColumn("split", split.otherwise(rest)).drop("__i", "__n")


def weighted_mixture(df: DataFrame, group: str, weights: dict[str, float], id_column: str, salt: str) -> DataFrame:
    """The largest sample without replacement in which groups stand in the ratio of their weights."""
    weight = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v))])
    counts = df.where(F.col(group).isin(list(weights))).groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    scaled = counts.withColumn("__w", weight[F.col(group)])
    scale = scaled.agg(F.min(F.col("__n") / F.col("__w")).alias("__s"))
    quotas = scaled.crossJoin(F.broadcast(scale)).select(
        group, F.least(F.col("__n"), F.greatest(F.lit(1).cast("long"), F.bround(F.col("__s") * F.col("__w"), 0).cast("long"))).alias("__q")
    )
    ranked = hash_row_number(df, [group], hash_rank(salt, id_column), id_column, "__i")
    return ranked.join(F.broadcast(quotas), group).where(F.col("__i") <= F.col("__q")).drop("__i", "__q")


def largest_remainder(shares: DataFrame, name: str, weight: str, total: int) -> DataFrame:
    """(name, quota): floors of total * weight / sum, the rest to the largest fractions, then by name."""
    everything = Window.partitionBy()
    exact = F.col(weight) * total / F.sum(weight).over(everything)
    parts = shares.select(name, F.floor(exact).alias("__f"), (exact - F.floor(exact)).alias("__r"))
    place = F.row_number().over(Window.orderBy(F.desc("__r"), name))
    left = F.lit(total) - F.sum("__f").over(everything)
    return parts.select(name, (F.col("__f") + F.when(place <= left, 1).otherwise(0)).cast("long").alias("quota"))


def doubly_capped(df: DataFrame, most_a: int, most_b: int) -> DataFrame:
    """(category, doc_id) that the greedy rule keeps of df(category, doc_id, a, b, h): in the order of h a row is
    kept unless its category has ``most_a`` kept rows of its a, or ``most_b`` of its b.

    Few rows of a category can be kept, and only they go to the one task that applies the rule. Of one (a, b)
    only the first ``most_a`` rows matter: both counts only grow, so a row after as many is refused like one of
    them or meets a full a. With c classes b in all, no more than most_b * c rows are kept, hence no more
    than most_b * c / most_a values of a are full, and of those no more than most_b * c rows stand in one b; of
    one b only the first most_b * (c + 1) rows matter. Exact; bounded by the number of classes b.
    """
    order = ["h", "doc_id"]
    classes = df.agg(F.count_distinct("b").alias("c")).first()["c"] + 1
    few = first_by(df, ["category", "a", "b"], order, most_a)
    few = first_by(few, ["category", "b"], order, most_b * (classes + 1))

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        category, seen_a, seen_b = None, Counter(), Counter()
        for batch in batches:
            keep = []
            for row in batch.itertuples(index=False):
                if row.category != category:
                    category, seen_a, seen_b = row.category, Counter(), Counter()
                if seen_a[row.a] < most_a and seen_b[row.b] < most_b:
                    seen_a[row.a] += 1
                    seen_b[row.b] += 1
                    keep.append((row.category, row.doc_id))
            yield pd.DataFrame(keep, columns=["category", "doc_id"])

    return few.repartition("category").sortWithinPartitions("category", *order).mapInPandas(choose, "category string, doc_id long")
