"""Answer scoring and paired statistics over tables of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t


def bag_overlap(df: DataFrame, key: list[str], a: str, b: str) -> DataFrame:
    """(key, shared, a_size, b_size) of two arrays of terms, as multisets: counted by aggregates, so that long
    texts need no map in one row."""
    one = df.select(*key, F.explode(a).alias("x")).groupBy(*key, "x").agg(F.count(F.lit(1)).alias("na"))
    two = df.select(*key, F.explode(b).alias("x")).groupBy(*key, "x").agg(F.count(F.lit(1)).alias("nb"))
    shared = one.join(two, [*key, "x"]).groupBy(*key).agg(F.sum(F.least("na", "nb")).alias("shared"))
    sizes = df.select(*key, F.size(a).cast("long").alias("a_size"), F.size(b).cast("long").alias("b_size"))
    return sizes.join(shared, key, "left").fillna(0, ["shared"])


def f1(shared: Column, a: Column, b: Column) -> Column:
    """2 * shared / (a + b); two empty sides agree."""
    return F.when((a == 0) & (b == 0), F.lit(1.0)).otherwise(2.0 * shared / F.nullif(a + b, F.lit(0)))


def mcnemar(df: DataFrame, a: str, b: str) -> DataFrame:
    """Contingency of two boolean columns and the continuity-corrected statistic (null without discordance)."""
    one, two = F.col(a).cast("int"), F.col(b).cast("int")
    counts = df.agg(
        F.sum(one * two).alias("both"), F.sum(one * (1 - two)).alias("only_a"), F.sum((1 - one) * two).alias("only_b"), F.sum((1 - one) * (1 - two)).alias("neither")
    )
    difference = F.abs(F.col("only_a") - F.col("only_b")) - 1
    return counts.withColumn("statistic", difference * difference / F.nullif(F.col("only_a") + F.col("only_b"), F.lit(0)))


def bootstrap(df: DataFrame, value: str, id_column: str, resamples: int = 200) -> DataFrame:
    """Mean of ``value`` in each of ``resamples`` Poisson resamples: each row weighs 0, 1, 2 or 3 by a
    hash of (resample, id), so that rows need no common index and one pass with a partial aggregate does."""
    digest = F.conv(F.substring(F.md5(F.concat_ws(":", "rep", F.col(id_column).cast("string"))), 1, 8), 16, 10).cast("long") % 1000
    weight = F.when(digest < 368, 0).when(digest < 736, 1).when(digest < 920, 2).otherwise(3)
    reps = df.select(id_column, value, F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("rep")).withColumn("w", weight)
    return reps.groupBy("rep").agg((F.sum(F.col("w") * F.col(value)) / F.nullif(F.sum("w"), F.lit(0))).alias("mean"))


def confusion(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Per gold label: tp, fp, fn and f1 (zero where undefined)."""
    long = df.select(F.col(gold).alias("g"), F.col(predicted).alias("p"))
    tp = long.where("g = p").groupBy(F.col("g").alias("label")).agg(F.count(F.lit(1)).alias("tp"))
    n = long.groupBy(F.col("g").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    m = long.groupBy(F.col("p").alias("label")).agg(F.count(F.lit(1)).alias("m"))
    out = n.join(m, "label", "left").join(tp, "label", "left").fillna(0, ["m", "tp"])
    return out.select(
        "label", "tp", (F.col("m") - F.col("tp")).alias("fp"), (F.col("n") - F.col("tp")).alias("fn"), (2.0 * F.col("tp") / (F.col("n") + F.col("m"))).alias("f1")
    )


def argmax(scores: Column) -> Column:
    """Place (from 0) of the first largest score."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("long")


def softmax(scores: Column, temperature: float = 1.0) -> Column:
    top = F.array_max(scores)
    e = F.transform(scores, lambda x: F.exp((x - top) / temperature))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def calibration(df: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """Expected calibration error: bins of equal width, weighted by their rows."""
    binned = df.groupBy(F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("c"), F.avg(F.col(correct).cast("int")).alias("a")
    )
    return binned.agg((F.sum(F.col("n") * F.abs(F.col("c") - F.col("a"))) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def has_span(where: Column, span: Column) -> Column:
    """Whether the words of ``span`` stand in ``where`` as whole words in a row."""
    return F.contains(F.concat(F.lit(" "), t.norm_words(where), F.lit(" ")), F.concat(F.lit(" "), t.norm_words(span), F.lit(" ")))


def average_over(df: DataFrame, by: str, value: str) -> DataFrame:
    """Mean per group and its difference to the first group in order."""
    g = df.groupBy(by).agg(F.avg(value).alias("mean"))
    return g.withColumn("delta", F.col("mean") - F.first("mean").over(Window.partitionBy().orderBy(by)))
