"""Queries of the window operators (W)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import windows as w
from ..registry import operator, table
from . import sql as s

RANK = "sha256('salt:' || doc_id)"


def rank():
    return F.sha2(F.concat(F.lit("salt:"), F.col("doc_id").cast("string")), 256)


@operator(
    "w01_running_total_budget",
    f"""SELECT doc_id, CAST(b AS BIGINT) AS before FROM (SELECT doc_id, coalesce(sum(n_chars) OVER (ORDER BY {RANK}, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b,
    (SELECT sum(n_chars) FROM documents) AS total FROM documents) WHERE b < total * 0.3""",
)
def w01(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    total = docs.agg(F.sum("n_chars").alias("total"))
    out = w.ordered_prefix(docs, rank(), F.col("n_chars"), "before", "doc_id").crossJoin(F.broadcast(total))
    return out.where(F.col("before") < F.col("total") * 0.3).select("doc_id", F.col("before").cast("long").alias("before"))


@operator(
    "w02_batched_cumulative",
    """SELECT o_custkey, block, CAST(n AS BIGINT) AS n, round(sum(total) OVER (PARTITION BY o_custkey ORDER BY block), 2) AS running FROM (
    SELECT o_custkey, (rn - 1) // 8 AS block, count(*) AS n, sum(o_totalprice) AS total FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) GROUP BY ALL)""",
)
def w02(spark, d):
    o = table(spark, d, "orders").withColumn("rn", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    b = o.groupBy("o_custkey", F.floor((F.col("rn") - 1) / 8).alias("block")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))
    running = F.sum("total").over(Window.partitionBy("o_custkey").orderBy("block"))
    return b.select("o_custkey", "block", "n", F.round(running, 2).alias("running"))


@operator(
    "w03_argmin_closest",
    """SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY abs(c / target - 1), l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM (
    SELECT *, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS c, sum(l_quantity) OVER (PARTITION BY l_orderkey) / 2 AS target FROM lineitem)) WHERE k = 1""",
)
def w03(spark, d):
    key = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    by = Window.partitionBy("l_orderkey")
    c = F.sum("l_quantity").over(by.orderBy(*key).rowsBetween(Window.unboundedPreceding, 0))
    lines = table(spark, d, "lineitem").withColumn("c", c).withColumn("target", F.sum("l_quantity").over(by) / 2)
    return w.first_by(lines, ["l_orderkey"], [F.abs(F.col("c") / F.col("target") - 1), *key]).select("l_orderkey", "l_linenumber")


@operator(
    "w04_tie_corrected_rank",
    "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2 AS rank FROM part",
)
def w04(spark, d):
    return w.tie_corrected_rank(table(spark, d, "part"), ["p_brand"], "p_size", "rank").select("p_partkey", "rank")


@operator(
    "w05_first_occurrence_dedup",
    f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY {s.blank('lower(text)')}",
)
def w05(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2(t.blank(F.lower("text")), 256).alias("h"))
    return docs.groupBy("h").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@operator(
    "w06_length_quartile_bands",
    "SELECT doc_id, CAST(floor((row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) - 1) * 4 / count(*) OVER (PARTITION BY lang)) AS BIGINT) AS band FROM documents",
)
def w06(spark, d):
    docs = w.value_row_number(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), ["lang"], F.col("n_chars"), "doc_id", "i", "n")
    return docs.select("doc_id", F.floor((F.col("i") - 1) * 4 / F.col("n")).alias("band"))


@operator(
    "w07_evenly_spaced_pick",
    """SELECT source, k, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents)
    JOIN (SELECT unnest(range(5)) AS k) ON i = CAST(floor((k + 0.5) * n / 5) AS BIGINT)""",
)
def w07(spark, d):
    docs = w.value_row_number(table(spark, d, "documents").select("doc_id", "source", "n_chars"), ["source"], F.col("n_chars"), "doc_id", "i", "n")
    docs = docs.withColumn("i", F.col("i") - 1)
    picks = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.struct(k.cast("long").alias("k"), F.floor((k + 0.5) * F.col("n") / 5).alias("p")))
    hit = F.filter(picks, lambda x: x["p"] == F.col("i"))
    return docs.select("source", "doc_id", F.explode(hit).alias("x")).select("source", F.col("x.k").alias("k"), "doc_id")


@operator(
    "w08_adjacent_quantile_window",
    """SELECT DISTINCT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents)
    JOIN (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]) AS q) ON abs(i - floor((n - 1) * q)) <= 2""",
)
def w08(spark, d):
    docs = w.value_row_number(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), ["lang"], F.col("n_chars"), "doc_id", "i", "n")
    docs = docs.withColumn("i", F.col("i") - 1)
    marks = F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)])
    return docs.where(F.exists(marks, lambda x: F.abs(F.col("i") - F.floor((F.col("n") - 1) * x)) <= 2)).select("lang", "doc_id")


@operator(
    "w09_score_band_extremes",
    """SELECT band, doc_id FROM (SELECT doc_id, unnest(list_filter([CASE WHEN a <= 10 THEN 'shortest' END, CASE WHEN b <= 10 THEN 'longest' END], lambda x: x IS NOT NULL)) AS band
    FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS a, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS b FROM documents))""",
)
def w09(spark, d):
    """Each task keeps ten rows a language before the rows meet."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    shortest = w.first_by(docs, ["lang"], ["n_chars", "doc_id"], 10).select(F.lit("shortest").alias("band"), "doc_id")
    longest = w.first_by(docs, ["lang"], [F.desc("n_chars"), "doc_id"], 10).select(F.lit("longest").alias("band"), "doc_id")
    return shortest.union(longest)


@operator(
    "w10_token_windows",
    f"""SELECT doc_id, CAST(p AS BIGINT) AS start, CAST(len(w[p:p + 127]) AS BIGINT) AS n FROM (SELECT doc_id, w, unnest(range(1, len(w), 127)) AS p FROM (SELECT doc_id, {s.words('text')} AS w FROM documents) WHERE len(w) > 1)""",
)
def w10(spark, d):
    docs = table(spark, d, "documents").select("doc_id", t.words("text").alias("w")).where(F.size("w") > 1)
    starts = F.sequence(F.lit(1), F.size("w") - 1, F.lit(127))
    return docs.select("doc_id", F.size("w").alias("m"), F.explode(starts).alias("p")).select(
        "doc_id", F.col("p").cast("long").alias("start"), F.least(F.lit(128), F.col("m") - F.col("p") + 1).cast("long").alias("n")
    )


@operator(
    "w11_latin_square_assignment",
    "SELECT conv_id, p AS position, (row_number() OVER (PARTITION BY p ORDER BY md5(CAST(conv_id AS VARCHAR)), conv_id) + p) % 3 AS arm FROM (SELECT DISTINCT conv_id FROM conversations), (SELECT unnest([0, 1, 2]::BIGINT[]) AS p)",
)
def w11(spark, d):
    c = table(spark, d, "conversations").select("conv_id").distinct().select("conv_id", F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)])).alias("position"))
    ranked = w.hash_row_number(c, ["position"], F.md5(F.col("conv_id").cast("string")), "conv_id", "rn")
    return ranked.select("conv_id", "position", F.pmod(F.col("rn") + F.col("position"), F.lit(3)).alias("arm"))
