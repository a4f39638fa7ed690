"""Queries of gates and reports in full: misfits of language (P17), checked exclusion (P20), label-balanced mixtures (K05),
constraints on answers (V09), preferences by pair and category (H05, H06)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import sampling as k
from ..operators.windows import hash_row_number
from ..registry import operator, table
from . import sql as s
from .quality import STOPWORDS
from .review import _RANKS, ranks
from .sampling import _MIX_SQL, MIX, _h

_W = s.words("text")
_SHARE = {lang: f"len(list_filter(w, lambda x: list_contains({listed}, x)))" for lang, listed in STOPWORDS.items()}


#: every fourth document claims the other language
_CLAIMED = "CASE WHEN doc_id % 4 = 0 AND lang = 'en' THEN 'de' WHEN doc_id % 4 = 0 AND lang = 'de' THEN 'en' ELSE lang END"


@operator(
    "p17_language_misfit",
    f"""SELECT doc_id, lang, len(w) AS words, {_SHARE['en']} AS en, {_SHARE['de']} AS de FROM (SELECT doc_id, {_CLAIMED} AS lang, {_W} AS w FROM documents)
    WHERE len(w) >= 12 AND (lang = 'en' AND {_SHARE['de']} > {_SHARE['en']} OR lang = 'de' AND {_SHARE['en']} > {_SHARE['de']})""",
)
def p17_misfit(spark, d):
    """Documents of twelve words or more that have more stop words of the other language than of the one they claim."""
    docs = table(spark, d, "documents").select("doc_id", F.expr(_CLAIMED).alias("lang"), t.words("text").alias("w"))

    def count(listed):
        return F.size(F.filter("w", lambda x: x.isin(listed)))

    told = docs.select("doc_id", "lang", F.size("w").alias("words"), *[count(v).alias(c) for c, v in STOPWORDS.items()])
    wrong = ((F.col("lang") == "en") & (F.col("de") > F.col("en"))) | ((F.col("lang") == "de") & (F.col("en") > F.col("de")))
    return told.where((F.col("words") >= 12) & wrong)


@operator(
    "p20_exclusion_counts",
    """WITH l AS (SELECT DISTINCT CASE WHEN quality = 0 THEN doc_id ELSE doc_id + 1000000000 END AS doc_id FROM labels WHERE toxic = 1 OR quality = 0),
    f AS (SELECT count(*) AS n FROM documents SEMI JOIN l USING (doc_id))
    SELECT (SELECT count(*) FROM l) AS listed, (SELECT count(*) FROM l SEMI JOIN documents USING (doc_id)) AS found, (SELECT count(*) FROM l ANTI JOIN documents USING (doc_id)) AS missing,
    (SELECT n FROM f) AS excluded, (SELECT count(*) FROM documents) - (SELECT n FROM f) AS kept""",
)
def p20_counts(spark, d):
    """An exclusion list, some of whose ids no document has, held against the documents: all must exist, so a caller
    refuses where ``missing`` is not 0."""
    bad = table(spark, d, "labels").where("toxic = 1 or quality = 0")
    listed = bad.select(F.when(F.col("quality") == 0, F.col("doc_id")).otherwise(F.col("doc_id") + 1_000_000_000).alias("doc_id")).distinct()
    per = table(spark, d, "documents").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    j = per.join(listed.withColumn("listed", F.lit(True)), "doc_id", "full")
    count = lambda c: F.count(F.when(c, 1))
    rows = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    on = F.coalesce("listed", F.lit(False))
    return j.agg(count(on).alias("listed"), count(on & F.col("n").isNotNull()).alias("found"), count(on & F.col("n").isNull()).alias("missing"), rows(on).alias("excluded"), rows(~on).alias("kept"))


@operator(
    "k05_label_balanced_mixture",
    f"""WITH c AS (SELECT lang, count(*) AS n, {_MIX_SQL} AS w FROM documents WHERE lang IN ('en', 'de', 'fr') GROUP BY lang),
    q AS (SELECT lang, least(n, greatest(1, round_even((SELECT min(n / w) FROM c) * w, 0))) AS quota FROM c),
    r AS (SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY {_h('robin', 'doc_id')}, doc_id) AS turn FROM documents),
    o AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY turn, {_h('label', 'source')}, source) AS place FROM r)
    SELECT lang, doc_id, place FROM o JOIN q USING (lang) WHERE place <= quota""",
)
def k05_balanced(spark, d):
    """The mixture's quotas, filled by turns of the labels (here the sources) of each language: one row of each, in hash
    order of the labels, while they last.

    A row's place is the number of rows of earlier turns, and of labels before its own in its turn. Both follow from
    the labels' sizes, so rows are ranked within their label only, in slots.
    """
    docs = table(spark, d, "documents").where(F.col("lang").isin(list(MIX))).select("lang", "source", "doc_id")
    sizes = docs.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("order", F.row_number().over(Window.partitionBy("lang").orderBy(k.hash_rank("label", "source"), "source")))
    w = F.when(F.col("lang") == "en", MIX["en"]).when(F.col("lang") == "de", MIX["de"]).otherwise(MIX["fr"])
    langs = sizes.groupBy("lang").agg(F.sum("n").alias("all")).withColumn("w", w)
    scale = langs.agg(F.min(F.col("all") / F.col("w")).alias("scale"))
    quota = F.least(F.col("all").cast("double"), F.greatest(F.lit(1.0), F.bround(F.col("scale") * F.col("w"))))
    quotas = langs.crossJoin(F.broadcast(scale)).select("lang", quota.alias("quota"))
    turned = hash_row_number(docs, ["lang", "source"], k.hash_rank("robin", "doc_id"), "doc_id", "turn").join(sizes.select("lang", "source", "order"), ["lang", "source"])
    # rows of a turn, of a label up to each: counts of (language, turn, label order), never of rows
    marks = turned.groupBy("lang", "turn").agg(F.count(F.lit(1)).alias("c"), F.sort_array(F.collect_list("order")).alias("orders"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("lang").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marks = marks.select("lang", "turn", before.alias("before"), "orders")
    placed = turned.join(marks, ["lang", "turn"]).select("lang", "doc_id", (F.col("before") + F.array_position("orders", F.col("order"))).cast("long").alias("place"))
    return placed.join(quotas, "lang").where("place <= quota").select("lang", "doc_id", "place")


#: name, and the condition on an answer's words w, sentences, bullets, paragraphs and text
_CONSTRAINTS = (
    ("50 to 80 words", "w BETWEEN 50 AND 80"),
    ("120 words at most, no question", "w <= 120 AND q = 0"),
    ("three sentences at most", "s <= 3"),
    ("one sentence", "s = 1"),
    ("exactly three bullets", "b = 3"),
    ("begins as asked, one paragraph", "k AND p = 1"),
    ("valid JSON", "j"),
)
_ANSWER = "CASE (conv_id + turn) % 5 WHEN 0 THEN 'In short: ' || text WHEN 1 THEN '- ' || text || chr(10) || '- b' || chr(10) || '- c' WHEN 2 THEN '[\"' || turn || '\"]' WHEN 3 THEN text || chr(10) || chr(10) || text || '?' ELSE text END"


@operator(
    "v09_constraint_results",
    f"""WITH a AS (SELECT conv_id, turn, {_ANSWER} AS x FROM conversations),
    m AS (SELECT conv_id, turn, len(regexp_extract_all(x, '[\\p{{L}}\\p{{N}}_]+(?:[’''-][\\p{{L}}\\p{{N}}_]+)*')) AS w, len(regexp_extract_all(x, '[.!?](?:\\s|$)')) AS s, len(regexp_extract_all(x, '(?m)^- ')) AS b,
      len(list_filter(regexp_split_to_array(x, '\\n\\s*\\n'), lambda y: trim(y) <> '')) AS p, length(x) - length(replace(x, '?', '')) AS q, starts_with(x, 'In short:') AS k, TRY_CAST(x AS JSON) IS NOT NULL AS j FROM a)
    {" UNION ALL ".join(f"SELECT conv_id, turn, '{name}' AS constraint_name, {rule} AS passed FROM m" for name, rule in _CONSTRAINTS)}""",
)
def v09_results(spark, d):
    """Each constraint on each answer: words, sentences, bullets, paragraphs, prefix, JSON. Answers are turns, some with a
    prefix, as bullets, as JSON or twice over."""
    n = (F.col("conv_id") + F.col("turn")) % 5
    x = F.col("text")
    answer = (
        F.when(n == 0, F.concat(F.lit("In short: "), x)).when(n == 1, F.concat(F.lit("- "), x, F.lit("\n- b\n- c"))).when(n == 2, F.concat(F.lit('["'), F.col("turn").cast("string"), F.lit('"]')))
        .when(n == 3, F.concat(x, F.lit("\n\n"), x, F.lit("?"))).otherwise(x)
    )
    count = lambda pattern: F.size(F.regexp_extract_all("x", F.lit(pattern), F.lit(0)))
    m = table(spark, d, "conversations").select("conv_id", "turn", answer.alias("x")).select(
        "conv_id", "turn", count(r"[\p{L}\p{N}_]+(?:[’'-][\p{L}\p{N}_]+)*").alias("w"), count(r"[.!?](?:\s|$)").alias("s"), count("(?m)^- ").alias("b"),
        F.size(F.filter(F.split("x", r"\n\s*\n"), lambda y: F.trim(y) != "")).alias("p"), (F.length("x") - F.length(F.replace("x", F.lit("?"), F.lit("")))).alias("q"),
        F.startswith("x", F.lit("In short:")).alias("k"), F.expr("try_parse_json(x) is not null").alias("j"),
    )
    checks = F.array(*[F.struct(F.lit(name).alias("constraint_name"), F.expr(rule).alias("passed")) for name, rule in _CONSTRAINTS])
    return m.select("conv_id", "turn", F.explode(checks).alias("c")).select("conv_id", "turn", "c.*")


@operator(
    "h05_pairwise_preferences",
    f"""SELECT a.arm AS first, b.arm AS second, count(*) FILTER (a.rank < b.rank) AS first_preferred, count(*) FILTER (a.rank = b.rank) AS tied, count(*) FILTER (a.rank > b.rank) AS second_preferred
    FROM ({_RANKS}) a JOIN ({_RANKS}) b ON a.conv_id = b.conv_id AND a.arm < b.arm GROUP BY ALL""",
)
def h05_pairs(spark, d):
    r = ranks(spark, d)
    j = r.toDF("conv_id", "first", "x").join(r.toDF("conv_id", "second", "y"), "conv_id").where("first < second")
    count = lambda c: F.count(F.when(c, 1))
    x, y = F.col("x"), F.col("y")
    return j.groupBy("first", "second").agg(count(x < y).alias("first_preferred"), count(x == y).alias("tied"), count(x > y).alias("second_preferred"))


_CATEGORY = "CASE conv_id % 3 WHEN 0 THEN 'arithmetic' WHEN 1 THEN 'rewriting' ELSE 'reasoning' END"


@operator(
    "h06_scores_by_category",
    f"""WITH r AS ({_RANKS}), p AS (SELECT a.conv_id, a.arm, sum(CASE WHEN a.rank < b.rank THEN 1.0 WHEN a.rank = b.rank THEN 0.5 ELSE 0 END) AS points, 1 + count(*) FILTER (b.rank < a.rank) + count(*) FILTER (b.rank = a.rank) / 2.0 AS mean_rank,
      count(*) FILTER (b.rank < a.rank) = 0 AS top FROM r a JOIN r b ON a.conv_id = b.conv_id AND a.arm <> b.arm GROUP BY a.conv_id, a.arm),
    c AS (SELECT *, {_CATEGORY} AS category FROM p UNION ALL SELECT *, 'all' FROM p)
    SELECT category, arm, count(*) AS n, round(CAST(sum(points) / (2 * count(*)) AS DOUBLE), 6) AS score, round(CAST(avg(mean_rank) AS DOUBLE), 6) AS mean_rank, count(*) FILTER (top) AS top_including_ties FROM c GROUP BY ALL""",
)
def h06_categories(spark, d):
    """Pairwise score, mean rank with ties shared, and cases in which no other arm is better, for all and by category."""
    r = ranks(spark, d)
    j = r.join(r.toDF("conv_id", "other", "its"), "conv_id").where("arm <> other")
    less, same = F.col("rank") < F.col("its"), F.col("rank") == F.col("its")
    more = F.sum((F.col("its") < F.col("rank")).cast("int"))
    p = j.groupBy("conv_id", "arm").agg(
        F.sum(F.when(less, 1.0).when(same, 0.5).otherwise(0.0)).alias("points"), (1 + more + F.sum(same.cast("int")) / 2.0).alias("mean_rank"), (more == 0).alias("top")
    )
    n = F.col("conv_id") % 3
    category = F.when(n == 0, "arithmetic").when(n == 1, "rewriting").otherwise("reasoning")
    c = p.select("*", F.explode(F.array(category, F.lit("all"))).alias("category"))
    return c.groupBy("category", "arm").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("points") / (2 * F.count(F.lit(1))), 6).alias("score"), F.round(F.avg("mean_rank"), 6).alias("mean_rank"),
        F.count(F.when(F.col("top"), 1)).alias("top_including_ties"),
    )
