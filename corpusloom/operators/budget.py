"""Greedy selection under a budget for each group, in rounds that follow the logarithm of the budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import checkpointed, drop
from .windows import hash_running_sum


def budgeted(df: DataFrame, group: str, id_column: str, size: str, order: str, budget: int) -> DataFrame:
    """(id, group) of the rows that the greedy rule keeps: in the order of a group's rows (hex string ``order``, evenly
    spread, then the id) each is kept whose size the rest of the group's budget still holds. Sizes are whole numbers
    from 0 on; rows of other or null sizes, and of null ids, take no part; null groups are one group.

    A round looks at all open rows of a group that has r left. Rows of at most r / 2 are small; their prefix sums, in
    two levels, tell the first place where more than r / 2 would be taken, and the first larger row that fits behind
    the small ones before it. Up to the earlier of the two places all small rows are kept and no large one; the row
    at that place is kept, too; and less than r / 2 is left. So the budget halves in each round: a group of any
    number of rows is done after log2(budget) + 1 rounds, each of which reads what is still open and fits.
    """
    rows = df.select(F.col(id_column).alias("id"), F.col(group).alias("grp"), F.col(size).cast("long").alias("n"), F.col(order).alias("at"))
    rows = rows.where(F.col("n").between(0, budget) & F.col("id").isNotNull())
    open_ = checkpointed(rows.withColumn("left", F.lit(budget).cast("long")))
    parts = []
    while not open_.isEmpty():
        small = F.col("n") * 2 <= F.col("left")
        summed = hash_running_sum(open_.withColumn("small", F.when(small, F.col("n")).otherwise(0)), ["grp"], F.col("at"), "id", "small", "taken")
        summed = checkpointed(summed.select("id", "grp", "n", "at", "left", "taken"))
        halved = small & (F.col("taken") * 2 > F.col("left"))
        fits = ~small & (F.col("taken") + F.col("n") <= F.col("left"))
        place = F.struct("at", "id")
        first = summed.where(halved | fits).groupBy("grp").agg(F.min(F.struct(place.alias("place"), (F.col("taken") + F.when(fits, F.col("n")).otherwise(0)).alias("taken"))).alias("x"))
        stops = checkpointed(first.select(F.col("grp").alias("of"), F.col("x.place").alias("stop"), F.col("x.taken").alias("used")))
        marked = summed.join(stops, F.col("grp").eqNullSafe(F.col("of")), "left").drop("of")
        kept = F.when(F.col("stop").isNull(), small).otherwise((small & (place < F.col("stop"))) | (place == F.col("stop")))
        parts.append(checkpointed(marked.where(kept).select("id", "grp")))
        later = marked.where(F.col("stop").isNotNull() & (place > F.col("stop"))).withColumn("left", F.col("left") - F.col("used"))
        following = checkpointed(later.where(F.col("n") <= F.col("left")).select("id", "grp", "n", "at", "left"))
        drop(open_, summed, stops)
        open_ = following
    drop(open_)
    out = parts[0] if parts else rows.limit(0)
    for part in parts[1:]:
        out = out.union(part)
    return out.select(F.col("id").alias(id_column), F.col("grp").alias(group))
