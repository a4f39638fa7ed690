"""Queries of scoring and statistics (M). No table holds model outputs: predictions are derived from the
tables by fixed rules, so these queries test the arithmetic."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import quantiles
from ..operators import scoring as m
from ..operators.bootstrap import paired_interval
from ..registry import operator, table
from . import sql as s

_W = s.words("text")
# gold: the first thirty words; prediction: the same without every (2 + item_id % 5)-th word
_GOLD = f"SELECT item_id, w[1:30] AS gold, list_filter(w[1:30], lambda x, i: i % (2 + item_id % 5) <> 0) AS predicted FROM (SELECT item_id, {_W} AS w FROM benchmark)"


def answers(spark, d):
    w = F.slice(t.words("text"), 1, 30)
    b = table(spark, d, "benchmark").select("item_id", w.alias("gold"))
    return b.withColumn("predicted", F.filter("gold", lambda x, i: (i + 1) % (2 + F.col("item_id") % 5) != 0))


@operator(
    "m01_gec_exact_match",
    f"""SELECT item_id, gold = predicted AS exact, CAST(len(predicted) AS BIGINT) > 2 * len(gold) AS verbose, len(predicted) = 0 AS empty FROM ({_GOLD})""",
)
def m01(spark, d):
    return answers(spark, d).select(
        "item_id", (F.col("gold") == F.col("predicted")).alias("exact"), (F.size("predicted") > 2 * F.size("gold")).alias("verbose"), (F.size("predicted") == 0).alias("empty")
    )


def _bag_sql(source: str, a: str, b: str, key: str = "item_id") -> str:
    count = lambda x: f"(SELECT {key}, x, count(*) AS n FROM (SELECT {key}, unnest({x}) AS x FROM ({source})) GROUP BY ALL)"
    return f"""SELECT s.{key}, coalesce(m, 0) AS shared, CAST(len(s.{a}) AS BIGINT) AS a_size, CAST(len(s.{b}) AS BIGINT) AS b_size FROM ({source}) s
    LEFT JOIN (SELECT p.{key}, CAST(sum(least(p.n, q.n)) AS BIGINT) AS m FROM {count(a)} p JOIN {count(b)} q ON p.{key} = q.{key} AND p.x = q.x GROUP BY p.{key}) c USING ({key})"""


_F1 = "CASE WHEN a_size = 0 AND b_size = 0 THEN 1.0 ELSE 2.0 * shared / nullif(a_size + b_size, 0) END"


@operator("m02_qa_em_f1", f"SELECT item_id, round(CAST({_F1} AS DOUBLE), 6) AS f1 FROM ({_bag_sql(_GOLD, 'gold', 'predicted')})")
def m02(spark, d):
    o = m.bag_overlap(answers(spark, d), ["item_id"], "gold", "predicted")
    return o.select("item_id", F.round(m.f1(F.col("shared"), F.col("a_size"), F.col("b_size")), 6).alias("f1"))


def _grams(w: str, n: int) -> str:
    return s.ngram_list(w, n)


_NGRAMS = f"SELECT item_id, {', '.join(f'{_grams(x, n)} AS {x}{n}' for x in ('gold', 'predicted') for n in (1, 2, 3, 4))} FROM ({_GOLD})"


@operator(
    "m03_bleu_chrf",
    f"""WITH g AS ({_NGRAMS}), {", ".join(f"c{n} AS (SELECT CAST(sum(shared) AS DOUBLE) AS s, CAST(sum(b_size) AS DOUBLE) AS t, CAST(sum(a_size) AS DOUBLE) AS r FROM ({_bag_sql('SELECT * FROM g', f'gold{n}', f'predicted{n}')}))" for n in (1, 2, 3, 4))}
    SELECT round(100 * exp((ln(c1.s / c1.t) + ln(c2.s / c2.t) + ln(c3.s / c3.t) + ln(c4.s / c4.t)) / 4) * least(1, exp(1 - c1.r / c1.t)), 6) AS bleu, round(100 * 5 * (c2.s / c2.t) * (c2.s / c2.r) / (4 * (c2.s / c2.t) + c2.s / c2.r), 6) AS f_beta FROM c1, c2, c3, c4""",
)
def m03(spark, d):
    """Corpus BLEU over words (no smoothing, brevity penalty) and F-beta (beta 2) of bigrams."""
    a = answers(spark, d)
    parts = None
    for n in (1, 2, 3, 4):
        g = a.select("item_id", t.ngram_list(F.col("gold"), n).alias("a"), t.ngram_list(F.col("predicted"), n).alias("b"))
        o = m.bag_overlap(g, ["item_id"], "a", "b").agg(
            F.sum("shared").cast("double").alias(f"s{n}"), F.sum("b_size").cast("double").alias(f"t{n}"), F.sum("a_size").cast("double").alias(f"r{n}")
        )
        parts = o if parts is None else parts.crossJoin(o)
    logs = sum((F.log(F.col(f"s{n}") / F.col(f"t{n}")) for n in (2, 3, 4)), F.log(F.col("s1") / F.col("t1")))
    p, r = F.col("s2") / F.col("t2"), F.col("s2") / F.col("r2")
    return parts.select(
        F.round(100 * F.exp(logs / 4) * F.least(F.lit(1.0), F.exp(1 - F.col("r1") / F.col("t1"))), 6).alias("bleu"), F.round(100 * 5 * p * r / (4 * p + r), 6).alias("f_beta")
    )


@operator(
    "m04_rouge",
    f"""WITH g AS ({_NGRAMS}) SELECT item_id, round(CAST(x.f AS DOUBLE), 6) AS rouge1, round(CAST(y.f AS DOUBLE), 6) AS rouge2 FROM (SELECT item_id, {_F1} AS f FROM ({_bag_sql('SELECT * FROM g', 'gold1', 'predicted1')})) x
    JOIN (SELECT item_id, {_F1} AS f FROM ({_bag_sql('SELECT * FROM g', 'gold2', 'predicted2')})) y USING (item_id)""",
)
def m04(spark, d):
    a = answers(spark, d)
    out = None
    for n in (1, 2):
        g = a.select("item_id", t.ngram_list(F.col("gold"), n).alias("a"), t.ngram_list(F.col("predicted"), n).alias("b"))
        o = m.bag_overlap(g, ["item_id"], "a", "b")
        o = o.select("item_id", F.round(m.f1(F.col("shared"), F.col("a_size"), F.col("b_size")), 6).alias(f"rouge{n}"))
        out = o if out is None else out.join(o, "item_id")
    return out


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by rows of bits: one addition over all of ``a`` for each
    element of ``b``."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    whole = (1 << len(a)) - 1
    row = whole
    for y in b:
        hit = row & places.get(y, 0)
        row = (row + hit | row - hit) & whole
    return len(a) - row.bit_count()


@operator("m04_rouge_l")
def m04_l(spark, d):
    """ROUGE-L of words: the longest common subsequence against both lengths."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            f = [2 * lcs(list(a), list(b)) / max(1, len(a) + len(b)) for a, b in zip(batch["gold"], batch["predicted"])]
            yield pd.DataFrame({"item_id": batch["item_id"], "rouge_l": [round(x, 6) for x in f]})

    return answers(spark, d).mapInPandas(run, "item_id long, rouge_l double")


_OPTIONS = "SELECT vec_id, list_transform(embedding[1:4], lambda x: CAST(x AS DOUBLE)) AS scores, CAST(label % 4 AS BIGINT) AS gold FROM embeddings"
_ARGMAX = "CAST(list_position(scores, list_max(scores)) - 1 AS BIGINT)"


def options(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.slice("embedding", 1, 4).cast("array<double>").alias("scores"), (F.col("label") % 4).cast("long").alias("gold"))


@operator(
    "m05_position_bias",
    f"""SELECT choice, predicted, gold, round(predicted / sum(predicted) OVER (), 6) AS rate FROM (SELECT choice, CAST(sum(p) AS BIGINT) AS predicted, CAST(sum(g) AS BIGINT) AS gold FROM (
    SELECT {_ARGMAX} AS choice, 1 AS p, 0 AS g FROM ({_OPTIONS}) UNION ALL SELECT gold, 0, 1 FROM ({_OPTIONS})) GROUP BY choice)""",
)
def m05(spark, d):
    o = options(spark, d)
    one = o.select(m.argmax(F.col("scores")).alias("choice"), F.lit(1).alias("p"), F.lit(0).alias("g"))
    two = o.select(F.col("gold").alias("choice"), F.lit(0).alias("p"), F.lit(1).alias("g"))
    c = one.union(two).groupBy("choice").agg(F.sum("p").alias("predicted"), F.sum("g").alias("gold"))
    return c.withColumn("rate", F.round(F.col("predicted") / F.sum("predicted").over(Window.partitionBy()), 6))


@operator(
    "m06_mcnemar",
    """SELECT *, power(abs(only_a - only_b) - 1, 2) / nullif(only_a + only_b, 0) AS statistic FROM (SELECT CAST(sum(a * b) AS BIGINT) AS both, CAST(sum(a * (1 - b)) AS BIGINT) AS only_a, CAST(sum((1 - a) * b) AS BIGINT) AS only_b,
    CAST(sum((1 - a) * (1 - b)) AS BIGINT) AS neither FROM (SELECT quality AS a, 1 - toxic AS b FROM labels))""",
)
def m06(spark, d):
    l = table(spark, d, "labels").select((F.col("quality") == 1).alias("a"), (F.col("toxic") == 0).alias("b"))
    return m.mcnemar(l, "a", "b")


_HASH = "('0x' || substr(md5('rep' || ':' || rep || ':' || doc_id), 1, 8))::BIGINT % 1000"


@operator(
    "m07_paired_bootstrap",
    f"""SELECT rep, round(sum(w * v) / nullif(sum(w), 0), 6) AS mean FROM (SELECT rep, quality - toxic AS v, CASE WHEN h < 368 THEN 0 WHEN h < 736 THEN 1 WHEN h < 920 THEN 2 ELSE 3 END AS w FROM (
    SELECT rep, quality, toxic, ('0x' || substr(md5(rep || ':' || doc_id), 1, 8))::BIGINT % 1000 AS h FROM labels, (SELECT unnest(range(200)) AS rep))) GROUP BY rep""",
)
def m07(spark, d):
    l = table(spark, d, "labels").select("doc_id", (F.col("quality") - F.col("toxic")).alias("v"))
    return m.bootstrap(l, "v", "doc_id", 200).select(F.col("rep").cast("long").alias("rep"), F.round("mean", 6).alias("mean"))


@operator("m07_paired_interval")
def m07_interval(spark, d):
    """Mean difference of discount and tax over orders, with the 95 % interval of 10,000 resamples of orders."""
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("unit"), (F.col("l_discount") - F.col("l_tax")).alias("difference"))
    found = paired_interval(l, "unit", "difference")
    return found.withColumns({c: F.round(c, 8) for c in ("mean", "low", "high")})


_GP = f"SELECT gold AS g, {_ARGMAX} AS p FROM ({_OPTIONS})"


@operator(
    "m08_confusion_accuracy_macro_f1",
    f"""SELECT label, tp, m - tp AS fp, n - tp AS fn, round(2.0 * tp / (n + m), 6) AS f1 FROM (SELECT g AS label, count(*) AS n, CAST(sum(CAST(g = p AS INTEGER)) AS BIGINT) AS tp, (SELECT count(*) FROM ({_GP}) x WHERE x.p = y.g) AS m FROM ({_GP}) y GROUP BY g)""",
)
def m08(spark, d):
    gp = options(spark, d).select("gold", m.argmax(F.col("scores")).alias("predicted"))
    return m.confusion(gp, "gold", "predicted").withColumn("f1", F.round("f1", 6))


@operator(
    "m09_masked_argmax",
    f"SELECT vec_id, CAST(list_position(x, list_max(x)) - 1 AS BIGINT) AS choice FROM (SELECT vec_id, list_transform(scores, lambda v, i: CASE WHEN (vec_id + i) % 3 = 0 THEN -1e300 ELSE v END) AS x FROM ({_OPTIONS}))",
)
def m09(spark, d):
    o = options(spark, d)
    x = F.transform("scores", lambda v, i: F.when((F.col("vec_id") + i + 1) % 3 == 0, F.lit(-1e300)).otherwise(v))
    return o.select("vec_id", m.argmax(x).alias("choice"))


@operator(
    "m10_softmax_calibration",
    f"""WITH e AS (SELECT vec_id, gold, scores, list_transform(scores, lambda v: exp((v - list_max(scores)) / 0.5)) AS x FROM ({_OPTIONS})),
    c AS (SELECT list_max(x) / list_sum(x) AS conf, CAST({_ARGMAX} = gold AS INTEGER) AS ok FROM e), b AS (SELECT least(floor(conf * 10), 9) AS bin, count(*) AS n, avg(conf) AS c, avg(ok) AS a FROM c GROUP BY bin)
    SELECT round(sum(n * abs(c - a)) / sum(n), 6) AS ece, CAST(sum(n) AS BIGINT) AS n FROM b""",
)
def m10(spark, d):
    o = options(spark, d).select(F.array_max(m.softmax(F.col("scores"), 0.5)).alias("conf"), (m.argmax(F.col("scores")) == F.col("gold")).alias("ok"))
    return m.calibration(o, "conf", "ok").select(F.round("ece", 6).alias("ece"), "n")


@operator(
    "m11_likelihood_preference",
    "SELECT label, CAST(sum(CAST(a > b AS INTEGER)) AS BIGINT) AS preferred, CAST(sum(CAST(a = b AS INTEGER)) AS BIGINT) AS ties, count(*) AS n FROM (SELECT label, embedding[1] AS a, embedding[2] AS b FROM embeddings) GROUP BY label",
)
def m11(spark, d):
    e = table(spark, d, "embeddings").select("label", F.col("embedding")[0].alias("a"), F.col("embedding")[1].alias("b"))
    return e.groupBy("label").agg(F.sum((F.col("a") > F.col("b")).cast("long")).alias("preferred"), F.sum((F.col("a") == F.col("b")).cast("long")).alias("ties"), F.count(F.lit(1)).alias("n"))


_T = s.norm_words("text")


@operator(
    "m12_reference_span_match",
    f"""SELECT conv_id, turn, contains(' ' || x || ' ', ' the ') AS anywhere, contains(' ' || {s.norm_words('substr(text, 1, 300)')} || ' ', ' of the ') AS early FROM (SELECT conv_id, turn, text, {_T} AS x FROM conversations)""",
)
def m12(spark, d):
    return table(spark, d, "conversations").select(
        "conv_id", "turn", m.has_span(F.col("text"), F.lit("the")).alias("anywhere"), m.has_span(F.substring("text", 1, 300), F.lit("Of the!")).alias("early")
    )


@operator(
    "m13_termination_health",
    "SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90, max(value) AS most FROM events GROUP BY event_type",
)
def m13(spark, d):
    events = table(spark, d, "events")
    p = quantiles.linear(events, "value", {"median": 0.5, "p90": 0.9}, ["event_type"]).drop("n")
    g = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("most"))
    # a type without values has no percentiles
    p = p.withColumnRenamed("event_type", "type")
    j = g.join(p, F.col("event_type").eqNullSafe(F.col("type")), "left")
    return j.select("event_type", "n", F.round("median", 6).alias("median"), F.round("p90", 6).alias("p90"), "most")


_ARM_RATE = "SELECT source, avg(CAST(n_chars > 1500 AS INTEGER)) AS r FROM documents WHERE " + s.bucket("doc_id::VARCHAR", 2) + " = {} GROUP BY source"


@operator(
    "m14_regression_flags",
    f"""SELECT source, round(b.r - a.r, 6) AS delta, a.r - b.r > 0.05 + 1e-10 AS group_drop, avg(a.r) OVER () - avg(b.r) OVER () > 0.02 + 1e-10 AS macro_drop FROM ({_ARM_RATE.format(0)}) a JOIN ({_ARM_RATE.format(1)}) b USING (source)""",
)
def m14(spark, d):
    docs = table(spark, d, "documents").groupBy("source", t.bucket("doc_id", modulus=2).alias("arm")).agg(F.avg((F.col("n_chars") > 1500).cast("int")).alias("r"))
    a, b = docs.where("arm = 0").select("source", F.col("r").alias("x")), docs.where("arm = 1").select("source", F.col("r").alias("y"))
    whole = Window.partitionBy()
    return a.join(b, "source").select(
        "source", F.round(F.col("y") - F.col("x"), 6).alias("delta"), (F.col("x") - F.col("y") > 0.05 + 1e-10).alias("group_drop"),
        (F.avg("x").over(whole) - F.avg("y").over(whole) > 0.02 + 1e-10).alias("macro_drop"),
    )


@operator(
    "m15_reproducibility_diff",
    f"SELECT count(*) AS n, CAST(sum(CAST(gold = predicted AS INTEGER)) AS BIGINT) AS equal_text, CAST(sum(CAST(len(gold) = len(predicted) AS INTEGER)) AS BIGINT) AS equal_length FROM ({_GOLD})",
)
def m15(spark, d):
    a = answers(spark, d)
    return a.agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("gold") == F.col("predicted")).cast("long")).alias("equal_text"), F.sum((F.size("gold") == F.size("predicted")).cast("long")).alias("equal_length")
    )


_REPORT = """SELECT user_id, list(struct_pack(outcome := CASE WHEN value > 80 THEN 'failed' ELSE 'passed' END, assertion := event_type = 'click')) AS r, min(event_id) % 2 AS rc FROM events GROUP BY user_id"""


@operator(
    "m16_fault_kill_matrix",
    f"""SELECT user_id, len(list_filter(r, lambda x: x.outcome = 'failed')) = 0 AS valid, rc = 1 AND len(list_filter(r, lambda x: x.outcome = 'failed' AND x.assertion)) > 0 AND len(list_filter(r, lambda x: x.outcome = 'failed' AND NOT x.assertion)) = 0 AS killed FROM ({_REPORT})""",
)
def m16(spark, d):
    """Reports are lists of outcomes per user: valid if all pass, killed if only assertions failed."""
    one = F.struct(F.when(F.col("value") > 80, "failed").otherwise("passed").alias("outcome"), (F.col("event_type") == "click").alias("assertion"))
    g = table(spark, d, "events").groupBy("user_id").agg(F.collect_list(one).alias("r"), (F.min("event_id") % 2).alias("rc"))
    failed = F.filter("r", lambda x: x["outcome"] == "failed")
    killed = (F.col("rc") == 1) & F.exists(failed, lambda x: x["assertion"]) & F.forall(failed, lambda x: x["assertion"])
    return g.select("user_id", F.forall("r", lambda x: x["outcome"] == "passed").alias("valid"), killed.alias("killed"))
