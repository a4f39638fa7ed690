"""Exact order statistics by counting passes: no task holds a group's values, however many differ."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import checkpointed, drop

CUTS, FEW = 64, 2048


def select_ranks(df: DataFrame, value: str, by: list[str], places: Callable[[Column], list[Column]], few: int = FEW) -> DataFrame:
    """(by..., n, place, v): of each group the number of its values that aren't null, and its value at each of the places
    (from 0, in ascending order) that ``places`` makes of n. Null groups are groups; groups without values aren't returned.

    Each pass cuts the range in which a wanted place lies at 64 values, counts what falls between them (with partial
    sums), and goes on in the part that holds the place; a range of one value is found, and one of at most ``few`` rows
    is gathered and sorted. The cuts come from a sketch, the counts are exact: a poor cut costs a pass, never a wrong
    value. A pass reads the table once for the cuts and once for the counts, and leaves about a 64th of the rows.
    """
    keys = [f"__by{i}" for i in range(len(by))]
    data = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(value).alias("v")).where("v is not null")
    wanted = data.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    wanted = wanted.select("*", F.explode(F.array_distinct(F.array(*[p.cast("long") for p in places(F.col("n"))]))).alias("place"))
    kind = data.schema["v"].dataType
    none = F.lit(None).cast(kind)
    open_ = checkpointed(wanted.select(*keys, "n", "place", F.lit(0).cast("long").alias("before"), F.col("n").alias("inside"), none.alias("low"), none.alias("high")))
    names = [f"{k}o" for k in keys]

    def same(left: DataFrame, right: DataFrame, more: Column | None = None, how: str = "inner") -> DataFrame:
        """left joined with right on the group, null groups included; right's keys go."""
        other = right.withColumnsRenamed(dict(zip(keys, names)))
        on = F.lit(True) if more is None else more
        for k, o in zip(keys, names):
            on = on & F.col(k).eqNullSafe(F.col(o))
        return left.join(other, on, how).drop(*names)

    done, scratch = [], [open_]
    within = (F.col("low").isNull() | (F.col("v") >= F.col("low"))) & (F.col("high").isNull() | (F.col("v") <= F.col("high")))
    while True:
        near = same(data, open_.where(F.col("inside") <= few), within).groupBy(*keys, "n", "place", "before").agg(F.array_sort(F.collect_list("v")).alias("x"))
        done.append(checkpointed(near.select(*keys, "n", "place", F.get("x", (F.col("place") - F.col("before")).cast("int")).alias("v"))))
        far = open_.where(F.col("inside") > few)
        if far.isEmpty():
            break
        cuts = same(data, far, within).groupBy(*keys, "place").agg(F.percentile_approx("v", [i / CUTS for i in range(1, CUTS)], F.lit(1000)).alias("cuts"))
        asked = checkpointed(same(far, cuts.withColumnRenamed("place", "placeo"), F.col("place") == F.col("placeo")).drop("placeo"))
        part = F.size(F.filter("cuts", lambda c: c < F.col("v")))
        counts = same(data, asked, within).withColumn("part", part).groupBy(*keys, "n", "place", "before", "part")
        counts = counts.agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("low"), F.max("v").alias("high"))
        order = Window.partitionBy(*keys, "place").orderBy("part")  # 64 rows at most
        ranked = counts.withColumn("start", F.col("before") + F.sum("c").over(order) - F.col("c"))
        hit = checkpointed(ranked.where((F.col("place") >= F.col("start")) & (F.col("place") < F.col("start") + F.col("c"))))
        done.append(hit.where("low = high").select(*keys, "n", "place", F.col("low").alias("v")))
        open_ = checkpointed(hit.where("low <> high").select(*keys, "n", "place", F.col("start").alias("before"), F.col("c").alias("inside"), "low", "high"))
        drop(asked)
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    return out.withColumnsRenamed(dict(zip(keys, by)))


def linear(df: DataFrame, value: str, quantiles: dict[str, float], by: list[str]) -> DataFrame:
    """(by..., n, a column for each name): percentiles between neighbours by linear interpolation."""
    at = lambda n, q: (n - 1) * F.lit(float(q))
    found = select_ranks(df, value, by, lambda n: [p for q in quantiles.values() for p in (F.floor(at(n, q)), F.ceil(at(n, q)))])
    pick = lambda place: F.max(F.when(F.col("place") == place, F.col("v").cast("double")))
    out = []
    for name, q in quantiles.items():
        place = at(F.col("n"), q)
        low, high = pick(F.floor(place)), pick(F.ceil(place))
        share = F.max(place - F.floor(place))
        out.append((low + (high - low) * share).alias(name))
    return found.groupBy(*by, "n").agg(*out)


def nearest(df: DataFrame, value: str, rules: dict[str, Callable[[Column], Column]], by: list[str]) -> DataFrame:
    """(by..., a column for each rule): the value at the place that the rule makes of n."""
    found = select_ranks(df, value, by, lambda n: [rule(n) for rule in rules.values()])
    picks = [F.max(F.when(F.col("place") == rule(F.col("n")).cast("long"), F.col("v"))).alias(name) for name, rule in rules.items()]
    return found.groupBy(*by).agg(*picks)
