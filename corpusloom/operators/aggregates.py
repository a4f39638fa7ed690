"""Aggregations: percentile rules, diversity, profiles, comparisons of nested reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import linear, nearest


def stats_linear(df: DataFrame, value: str, by: list[str] | tuple = ()) -> DataFrame:
    """Count, total, mean, deviations, linear percentiles and coefficient of variation per group. Percentiles are exact,
    by counting passes (``quantiles``)."""
    out = df.groupBy(*by).agg(
        F.count(value).alias("n"),
        F.sum(F.col(value).cast("double")).alias("total"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std_pop"),
        F.stddev_samp(value).alias("std_samp"),
        F.min(F.col(value).cast("double")).alias("min"),
        F.max(F.col(value).cast("double")).alias("max"),
    )
    p = linear(df, value, {"p10": 0.1, "median": 0.5, "p90": 0.9, "p95": 0.95}, list(by)).drop("n")
    keys = [f"__of{i}" for i in range(len(by))]
    same = F.lit(True)
    for c, k in zip(by, keys):
        same = same & F.col(c).eqNullSafe(F.col(k))
    out = out.join(p.withColumnsRenamed(dict(zip(by, keys))), same, "left").drop(*keys)
    return out.withColumn("cv", F.col("std_pop") / F.nullif(F.col("mean"), F.lit(0.0)))


#: place (from 0) of quantile q among n sorted values, by five rules
RANK_RULES: dict[str, Callable[[Column, float], Column]] = {
    "floor": lambda n, q: F.floor((n - 1) * q),
    "round": lambda n, q: F.bround((n - 1) * q).cast("long"),
    "scaled": lambda n, q: F.least(F.floor(n * q), n - 1),
    "ceil": lambda n, q: F.greatest(F.ceil(n * q) - 1, F.lit(0)),
    "half": lambda n, q: F.floor(n / 2),
}


def stats_nearest(df: DataFrame, value: str, quantile: float, by: list[str]) -> DataFrame:
    """Value at the quantile per group by each rule, exactly, by counting passes (``quantiles``)."""
    return nearest(df, value, {name: lambda n, r=rule: r(n, quantile) for name, rule in RANK_RULES.items()}, by)


def diversity(df: DataFrame, category: str, by: list[str]) -> DataFrame:
    """Shannon entropy in nats, effective number of categories, largest share."""
    counts = df.groupBy(*by, category).agg(F.count(F.lit(1)).alias("__n"))
    totals = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__t"))
    p = F.col("__n") / F.col("__t")
    out = counts.join(totals, by) if by else counts.crossJoin(totals)
    out = out.groupBy(*by).agg(F.sum(-p * F.log(p)).alias("entropy"), F.max(p).alias("largest"))
    return out.withColumn("effective", F.exp("entropy"))


def column_profile(df: DataFrame) -> DataFrame:
    """One row per column: nulls, empty strings, distinct values, least and greatest length as text."""
    aggregates = []
    for name in df.columns:
        c, text = F.col(name), F.col(name).cast("string")
        aggregates.append(
            F.struct(
                F.lit(name).alias("column"),
                F.count(F.when(c.isNull(), 1)).alias("nulls"),
                F.count(F.when(text == "", 1)).alias("empty"),
                F.count_distinct(c).alias("distinct"),
                F.min(F.length(text)).cast("long").alias("shortest"),
                F.max(F.length(text)).cast("long").alias("longest"),
            ).alias(name)
        )
    return df.agg(F.array(*aggregates).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def structural_delta(base: DataFrame, other: DataFrame, path: str, value: str) -> DataFrame:
    """Rows (path, base, other, delta) over the union of paths of two flattened reports."""
    a = base.select(path, F.col(value).alias("base"))
    b = other.select(path, F.col(value).alias("other"))
    return a.join(b, path, "full").withColumn("delta", F.col("other") - F.col("base"))
