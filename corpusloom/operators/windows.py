"""Ranking and sequence operators. A running total over a whole table is taken in two levels, so that no
task holds more than one range of the order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOTS = 64


def ordered_prefix(df: DataFrame, order: Column, value: Column, out: str = "before", ties: str | None = None, slots: int = SLOTS) -> DataFrame:
    """df with the sum of ``value`` over all rows before each row in the order (hex string column ``order``,
    evenly spread such as a hash; then ``ties``). Rows are dealt by the first two hex digits, summed
    within, and each slot starts at the total of the slots before: 256 rows meet in one task."""
    keyed = df.withColumn("__order", order).withColumn("__value", value).withColumn("__slot", F.substring("__order", 1, 2))
    totals = keyed.groupBy("__slot").agg(F.sum("__value").alias("__t"))
    starts = totals.select(
        "__slot", F.coalesce(F.sum("__t").over(Window.orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start")
    )
    sort = [F.col("__order"), *([F.col(ties)] if ties else [])]
    within = F.sum("__value").over(Window.partitionBy("__slot").orderBy(*sort).rowsBetween(Window.unboundedPreceding, -1))
    return (
        keyed.withColumn("__within", F.coalesce(within, F.lit(0)))
        .join(F.broadcast(starts), "__slot")
        .withColumn(out, F.col("__start") + F.col("__within"))
        .drop("__order", "__value", "__slot", "__within", "__start")
    )


def hash_row_number(df: DataFrame, by: list[str], order: Column, ties: str, out: str, total: str | None = None) -> DataFrame:
    """df with each row's number (from 1) in its group by an evenly spread hex order, and the group's size.

    Like ``row_number``, but a group is ranked in 256 slots by the first two digits of the order, each
    starting at the count of the slots before. A group with a third of all rows is thus 256 tasks' work,
    not one's. Null groups are groups.
    """
    keyed = df.withColumn("__order", order).withColumn("__slot", F.substring("__order", 1, 2))
    counts = keyed.groupBy(*by, "__slot").agg(F.count(F.lit(1)).alias("__c"))
    group = Window.partitionBy(*by)
    before = F.sum("__c").over(group.orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1))
    names = [f"__by{i}" for i in range(len(by))]
    starts = counts.select(
        *[F.col(c).alias(n) for c, n in zip(by, names)],
        F.col("__slot").alias("__of"),
        F.coalesce(before, F.lit(0)).alias("__start"),
        F.sum("__c").over(group).alias("__total"),
    )
    same = F.col("__slot") == F.col("__of")
    for c, n in zip(by, names):
        same = same & F.col(c).eqNullSafe(F.col(n))
    place = F.row_number().over(Window.partitionBy(*by, "__slot").orderBy("__order", ties))
    ranked = keyed.withColumn("__place", place).join(starts, same).withColumn(out, (F.col("__start") + F.col("__place")).cast("long"))
    if total:
        ranked = ranked.withColumn(total, F.col("__total"))
    return ranked.drop("__order", "__slot", "__of", "__start", "__total", "__place", *names)


def hash_running_sum(df: DataFrame, by: list[str], order: Column, ties: str, value: str, out: str) -> DataFrame:
    """df with the sum of ``value`` from the first row of its group to this one, by an evenly spread hex order
    (then ``ties``), in two levels as in ``hash_row_number``: a group is 256 tasks' work."""
    keyed = df.withColumn("__order", order).withColumn("__slot", F.substring("__order", 1, 2))
    sums = keyed.groupBy(*by, "__slot").agg(F.sum(value).alias("__s"))
    before = F.sum("__s").over(Window.partitionBy(*by).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1))
    names = [f"__by{i}" for i in range(len(by))]
    starts = sums.select(
        *[F.col(c).alias(n) for c, n in zip(by, names)], F.col("__slot").alias("__of"), F.coalesce(before, F.lit(0)).alias("__start")
    )
    within = F.sum(value).over(Window.partitionBy(*by, "__slot").orderBy("__order", ties).rowsBetween(Window.unboundedPreceding, 0))
    same = F.col("__slot") == F.col("__of")
    for c, n in zip(by, names):
        same = same & F.col(c).eqNullSafe(F.col(n))
    summed = keyed.withColumn("__within", within).join(starts, same).withColumn(out, F.col("__start") + F.col("__within"))
    return summed.drop("__order", "__slot", "__of", "__start", "__within", *names)


def value_row_number(df: DataFrame, by: list[str], value: Column, ties: str, out: str, total: str | None = None, slots: int = SLOTS) -> DataFrame:
    """df with each row's number (from 1) in its group by ``value``, then the number ``ties``, and the group's size.

    A group is ranked in parts: rows of one value and one range of ``ties`` (``slots`` ranges, from quantiles
    of the whole column). Each part starts at the count of the parts before, which a window over the counts
    gives; rows are sorted within their part only. So a group with a third of all rows is not one task's
    work, nor is a value that very many of them share; a task that orders counts sees one row for each
    value and range. Null groups and values are values, nulls first.
    """
    bounds = df.stat.approxQuantile(ties, [i / slots for i in range(1, slots)], 0.002) if slots > 1 else []
    # few distinct bounds are literals of the plan
    part = sum((F.when(F.col(ties) > b, 1).otherwise(0) for b in sorted(set(bounds))), F.lit(0))
    keyed = df.withColumn("__value", value).withColumn("__part", part)
    counts = keyed.groupBy(*by, "__value", "__part").agg(F.count(F.lit(1)).alias("__c"))
    group = Window.partitionBy(*by)
    before = F.sum("__c").over(group.orderBy("__value", "__part").rowsBetween(Window.unboundedPreceding, -1))
    names = [f"__by{i}" for i in range(len(by))]
    starts = counts.select(
        *[F.col(c).alias(n) for c, n in zip(by, names)],
        F.col("__value").alias("__v"),
        F.col("__part").alias("__p"),
        F.coalesce(before, F.lit(0)).alias("__start"),
        F.sum("__c").over(group).alias("__total"),
    )
    same = (F.col("__part") == F.col("__p")) & F.col("__value").eqNullSafe(F.col("__v"))
    for c, n in zip(by, names):
        same = same & F.col(c).eqNullSafe(F.col(n))
    place = F.row_number().over(Window.partitionBy(*by, "__value", "__part").orderBy(ties))
    ranked = keyed.withColumn("__place", place).join(starts, same).withColumn(out, (F.col("__start") + F.col("__place")).cast("long"))
    if total:
        ranked = ranked.withColumn(total, F.col("__total"))
    return ranked.drop("__value", "__part", "__v", "__p", "__start", "__total", "__place", *names)


def first_by(df: DataFrame, key: list, order: list, n: int = 1) -> DataFrame:
    """The first n rows of each key in the order, which must be total."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def tie_corrected_rank(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """df with the mean rank (from 1) of its value in its group: one row a value is ranked, not the rows."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__c"))
    before = F.sum("__c").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    names = [f"__k{i}" for i in range(len(by) + 1)]
    ranks = counts.select(
        *[F.col(c).alias(n) for c, n in zip([*by, value], names)], (F.coalesce(before, F.lit(0)) + 1 + (F.col("__c") - 1) / 2).alias(out)
    )
    same = F.lit(True)
    for c, n in zip([*by, value], names):
        same = same & F.col(c).eqNullSafe(F.col(n))
    return df.join(ranks, same).drop(*names)
