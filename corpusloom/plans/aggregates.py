"""Queries of the aggregations (A)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import aggregates as a
from ..registry import operator, table
from . import sql as s

N = "CAST(count(*) AS BIGINT)"


@operator("a01_count_by", f"SELECT lang, source, {N} AS n FROM documents GROUP BY ALL")
def a01(spark, d):
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))


@operator(
    "a02_duplicate_excess",
    "SELECT CAST(sum(n - 1) AS BIGINT) AS excess, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS keys FROM (SELECT count(*) AS n FROM documents GROUP BY text)",
)
def a02(spark, d):
    n = table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.sum(F.col("n") - 1).alias("excess"), F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).cast("long").alias("keys"))


_PAIRS = """SELECT u.text AS prompt, r.text AS answer FROM conversations u JOIN conversations r ON u.conv_id = r.conv_id AND r.turn = u.turn + 1
  WHERE u.role = 'user' AND r.role = 'assistant'"""


def prompt_answers(spark, d):
    c = table(spark, d, "conversations")
    u = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))
    r = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return u.join(r, ["conv_id", "turn"]).select("prompt", "answer")


@operator(
    "a03_conflicting_duplicates",
    f"""SELECT CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS repeated, CAST(sum(CASE WHEN n > 1 AND k > 1 THEN 1 ELSE 0 END) AS BIGINT) AS conflicting,
    CAST(max(n) AS BIGINT) AS largest FROM (SELECT prompt, count(*) AS n, count(DISTINCT answer) AS k FROM ({_PAIRS}) GROUP BY prompt)""",
)
def a03(spark, d):
    g = prompt_answers(spark, d).groupBy("prompt").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("answer").alias("k"))
    return g.agg(
        F.sum(F.expr("case when n > 1 then 1 else 0 end")).alias("repeated"),
        F.sum(F.expr("case when n > 1 and k > 1 then 1 else 0 end")).alias("conflicting"),
        F.max("n").alias("largest"),
    )


@operator("a04_cross_source_duplicates", "SELECT sha256(text) AS h, count(DISTINCT source) AS sources FROM documents GROUP BY text HAVING count(DISTINCT source) > 1")
def a04(spark, d):
    g = table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.count_distinct("source").alias("sources"))
    return g.where("sources > 1")


def _linear_sql(value: str, by: str, frm: str) -> str:
    q = ", ".join(f"round(quantile_cont({value}, {p}), 6) AS {n}" for p, n in ((0.1, "p10"), (0.5, "median"), (0.9, "p90"), (0.95, "p95")))
    return f"""SELECT {by}, count({value}) AS n, round(sum({value}), 4) AS total, round(avg({value}), 6) AS mean, round(stddev_pop({value}), 6) AS std_pop,
    round(stddev_samp({value}), 6) AS std_samp, CAST(min({value}) AS DOUBLE) AS min, CAST(max({value}) AS DOUBLE) AS max, {q},
    round(stddev_pop({value}) / nullif(avg({value}), 0), 6) AS cv FROM {frm}"""


def _rounded(df):
    six = ("mean", "std_pop", "std_samp", "p10", "median", "p90", "p95", "cv")
    return df.withColumns({c: F.round(c, 6) for c in six} | {"total": F.round("total", 4)})


@operator("a05_stats_linear", _linear_sql("CAST(n_chars AS DOUBLE)", "lang", "documents GROUP BY lang"))
def a05(spark, d):
    return _rounded(a.stats_linear(table(spark, d, "documents").withColumn("n_chars", F.col("n_chars").cast("double")), "n_chars", ["lang"]))


_RULES = {
    "floor": "floor((n - 1) * 0.9)",
    "round": "round_even((n - 1) * 0.9, 0)",
    "scaled": "least(floor(n * 0.9), n - 1)",
    "ceil": "greatest(ceil(n * 0.9) - 1, 0)",
    "half": "n // 2",
}


@operator(
    "a06_stats_nearest_rank",
    "SELECT source, " + ", ".join(f'max(CASE WHEN i = {r} THEN v END) AS "{k}"' for k, r in _RULES.items())
    + " FROM (SELECT source, n_chars AS v, row_number() OVER (PARTITION BY source ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents) GROUP BY source",
)
def a06(spark, d):
    return a.stats_nearest(table(spark, d, "documents"), "n_chars", 0.9, ["source"])


@operator(
    "a07_diversity_entropy",
    """SELECT lang, round(sum(-p * ln(p)), 6) AS entropy, round(max(p), 6) AS largest, round(exp(sum(-p * ln(p))), 6) AS effective
    FROM (SELECT lang, source, count(*) / sum(count(*)) OVER (PARTITION BY lang) AS p FROM documents GROUP BY lang, source) GROUP BY lang""",
)
def a07(spark, d):
    out = a.diversity(table(spark, d, "documents"), "source", ["lang"])
    return out.select("lang", *[F.round(c, 6).alias(c) for c in ("entropy", "largest", "effective")])


@operator(
    "a08_grouping_sets_profile",
    f"""SELECT coalesce(l_returnflag, 'all') AS flag, coalesce(l_linestatus, 'all') AS status, {N} AS n, round(avg(l_quantity), 6) AS mean,
    round(max(l_extendedprice), 2) AS most FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""",
)
def a08(spark, d):
    g = table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus")
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean"), F.round(F.max("l_extendedprice"), 2).alias("most")).select(
        F.coalesce("l_returnflag", F.lit("all")).alias("flag"), F.coalesce("l_linestatus", F.lit("all")).alias("status"), "n", "mean", "most"
    )


@operator(
    "a09_multi_key_stats",
    f"""SELECT lang, source, CAST(grouping(lang) * 2 + grouping(source) AS BIGINT) AS level, {N} AS n, CAST(max(n_chars) AS BIGINT) AS most
    FROM documents GROUP BY GROUPING SETS ((lang), (source), (lang, source))""",
)
def a09(spark, d):
    g = table(spark, d, "documents").groupingSets([["lang"], ["source"], ["lang", "source"]], "lang", "source")
    return g.agg(F.grouping_id().cast("long").alias("level"), F.count(F.lit(1)).alias("n"), F.max("n_chars").alias("most"))


_HOST_TOKENS = f"SELECT {s.host('url')} AS host, len({s.words('html')}) AS n FROM pages"


@operator("a10_weighted_token_sums", f"SELECT host, CAST(sum(n) AS BIGINT) AS tokens, {N} AS pages FROM ({_HOST_TOKENS}) GROUP BY host")
def a10(spark, d):
    p = table(spark, d, "pages").select(t.host("url").alias("host"), F.size(t.words("html")).cast("long").alias("n"))
    return p.groupBy("host").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("pages"))


@operator(
    "a11_micro_then_macro",
    "SELECT round(avg(acc), 6) AS macro, CAST(count(*) AS BIGINT) AS groups FROM (SELECT d.source, avg(CAST(l.quality = 1 AS INTEGER)) AS acc FROM labels l JOIN documents d USING (doc_id) GROUP BY d.source)",
)
def a11(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    per = j.groupBy("source").agg(F.avg((F.col("quality") == 1).cast("int")).alias("acc"))
    return per.agg(F.round(F.avg("acc"), 6).alias("macro"), F.count(F.lit(1)).alias("groups"))


@operator(
    "a12_token_weighted_mean",
    "SELECT event_type, round(exp(sum(abs(value)) / sum(1 + user_id % 7) / 100), 6) AS perplexity FROM events GROUP BY event_type",
)
def a12(spark, d):
    ratio = F.sum(F.abs("value")) / F.sum(1 + F.col("user_id") % 7)
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.exp(ratio / 100), 6).alias("perplexity"))


def _profile_sql(name: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(*) FILTER (WHERE CAST({c} AS VARCHAR) = '') AS empty,
        count(DISTINCT {c}) AS "distinct", CAST(min(length(CAST({c} AS VARCHAR))) AS BIGINT) AS shortest, CAST(max(length(CAST({c} AS VARCHAR))) AS BIGINT) AS longest FROM {name}"""
        for c in columns
    )


@operator("a13_column_profile", _profile_sql("documents", ["doc_id", "text", "lang", "source", "n_chars"]))
def a13(spark, d):
    return a.column_profile(table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars"))


@operator(
    "a14_conditional_rates",
    """SELECT lang, round(avg(CASE WHEN n_chars >= 2000 THEN CAST(quality = 1 AS INTEGER) END), 6) AS long_rate,
    round(avg(CASE WHEN n_chars < 20 THEN CAST(quality = 1 AS INTEGER) END), 6) AS tiny_rate FROM documents JOIN labels USING (doc_id) GROUP BY lang""",
)
def a14(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    good = (F.col("quality") == 1).cast("int")
    return j.groupBy("lang").agg(
        F.round(F.avg(F.when(F.col("n_chars") >= 2000, good)), 6).alias("long_rate"),
        F.round(F.avg(F.when(F.col("n_chars") < 20, good)), 6).alias("tiny_rate"),
    )


@operator(
    "a15_max_severity",
    """SELECT user_id, max_by(event_type, o) AS worst, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS kinds
    FROM (SELECT user_id, event_type, length(event_type) * 100 + ascii(event_type) AS o FROM events) GROUP BY user_id""",
)
def a15(spark, d):
    o = F.length("event_type") * 100 + F.ascii("event_type")
    g = table(spark, d, "events").groupBy("user_id")
    return g.agg(
        F.max(F.struct(o.alias("o"), "event_type"))["event_type"].alias("worst"), F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("kinds")
    )


@operator(
    "a16_group_variants_collapse",
    """SELECT lang, source, CAST(count(*) AS BIGINT) AS variants, array_to_string(list_sort(list_distinct(flatten(list(r)))), ',') AS reasons
    FROM (SELECT lang, source, list_filter([CASE WHEN n_chars < 500 THEN 'short' END, CASE WHEN n_chars > 5000 THEN 'long' END, CASE WHEN contains(text, '|') THEN 'table' END], lambda x: x IS NOT NULL) AS r FROM documents) GROUP BY lang, source""",
)
def a16(spark, d):
    r = F.array_compact(
        F.array(F.when(F.col("n_chars") < 500, "short"), F.when(F.col("n_chars") > 5000, "long"), F.when(F.contains("text", F.lit("|")), "table"))
    )
    docs = table(spark, d, "documents").select("lang", "source", r.alias("r"))
    reasons = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("r")))), ",")
    return docs.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("variants"), reasons.alias("reasons"))


@operator("a17_share_of_total", "SELECT source, round(sum(n_chars) / sum(sum(n_chars)) OVER (), 6) AS share FROM documents GROUP BY source")
def a17(spark, d):
    g = table(spark, d, "documents").groupBy("source").agg(F.sum("n_chars").alias("n"))
    return g.select("source", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))


@operator(
    "a18_structural_delta",
    """WITH b AS (SELECT lang || '/' || source AS path, avg(n_chars) AS v FROM documents WHERE doc_id % 2 = 0 GROUP BY ALL),
    c AS (SELECT lang || '/' || source AS path, avg(n_chars) AS v FROM documents WHERE doc_id % 2 = 1 GROUP BY ALL)
    SELECT path, round(b.v, 6) AS base, round(c.v, 6) AS other, round(c.v - b.v, 6) AS delta FROM b FULL JOIN c USING (path)""",
)
def a18(spark, d):
    docs = table(spark, d, "documents").select(F.concat_ws("/", "lang", "source").alias("path"), "n_chars", (F.col("doc_id") % 2).alias("arm"))
    mean = docs.groupBy("path", "arm").agg(F.avg("n_chars").alias("v"))
    out = a.structural_delta(mean.where("arm = 0"), mean.where("arm = 1"), "path", "v")
    return out.select("path", *[F.round(c, 6).alias(c) for c in ("base", "other", "delta")])


@operator(
    "a19_exposure_reconcile",
    """SELECT o_orderkey, CAST(sum(l_linenumber) AS BIGINT) AS seen, CAST(max(o_custkey % 28) AS BIGINT) AS logged, sum(l_linenumber) = max(o_custkey % 28) AS agrees
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""",
)
def a19(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_linenumber").alias("seen"))
    logged = table(spark, d, "orders").groupBy("o_orderkey").agg(F.max(F.col("o_custkey") % 28).alias("logged"))
    return lines.join(logged, "o_orderkey").withColumn("agrees", F.col("seen") == F.col("logged"))


_ARMS = ("de", "en", "es", "fr")


@operator(
    "a20_metric_pivot_report",
    "SELECT metric, " + ", ".join(f"round(max(CASE WHEN lang = '{x}' THEN v END) * 100, 4) AS {x}" for x in _ARMS)
    + """ FROM (SELECT 'long' AS metric, lang, avg(CAST(n_chars > 2000 AS INTEGER)) AS v FROM documents GROUP BY lang
    UNION ALL SELECT 'short', lang, avg(CAST(n_chars < 500 AS INTEGER)) FROM documents GROUP BY lang) GROUP BY metric""",
)
def a20(spark, d):
    g = table(spark, d, "documents").groupBy("lang").agg(F.avg((F.col("n_chars") > 2000).cast("int")).alias("long"), F.avg((F.col("n_chars") < 500).cast("int")).alias("short"))
    rows = g.unpivot(["lang"], ["long", "short"], "metric", "v")
    return rows.groupBy("metric").pivot("lang", list(_ARMS)).agg(F.round(F.first("v") * 100, 4))
