"""Queries of the joins (J)."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import text as t
from ..operators import graph as gr
from ..operators import grams as g
from ..operators.similarity import nearest_by_jaccard
from ..operators.windows import first_by
from ..registry import operator, table
from . import sql as s


@operator(
    "j01_keyed_equi_join_strict",
    """SELECT CAST(count(*) FILTER (WHERE l.doc_id IS NULL) AS BIGINT) AS unlabelled, CAST(count(*) FILTER (WHERE d.doc_id IS NULL) AS BIGINT) AS unknown, CAST(count(*) FILTER (WHERE l.doc_id = d.doc_id) AS BIGINT) AS matched
    FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id""",
)
def j01(spark, d):
    a = table(spark, d, "documents").select(F.col("doc_id").alias("x"))
    b = table(spark, d, "labels").select(F.col("doc_id").alias("y"))
    j = a.join(b, F.col("x") == F.col("y"), "full")
    return j.agg(
        F.count(F.when(F.col("y").isNull(), 1)).alias("unlabelled"), F.count(F.when(F.col("x").isNull(), 1)).alias("unknown"), F.count(F.when(F.col("x") == F.col("y"), 1)).alias("matched")
    )


_ARM = "SELECT conv_id, role, n, sha256(first) AS h FROM (SELECT conv_id, role, count(*) AS n, min(text) AS first FROM conversations GROUP BY conv_id, role)"


@operator(
    "j02_paired_arm_join",
    f"SELECT conv_id, u.n AS base, r.n AS candidate, u.h = r.h AS same FROM (SELECT * FROM ({_ARM}) WHERE role = 'user') u JOIN (SELECT * FROM ({_ARM}) WHERE role = 'assistant') r USING (conv_id)",
)
def j02(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.min("text"), 256).alias("h"))
    u = c.where("role = 'user'").select("conv_id", F.col("n").alias("base"), F.col("h").alias("hu"))
    r = c.where("role = 'assistant'").select("conv_id", F.col("n").alias("candidate"), F.col("h").alias("hr"))
    return u.join(r, "conv_id").select("conv_id", "base", "candidate", F.col("hu").eqNullSafe(F.col("hr")).alias("same"))


_NORM = s.norm_words("text")


@operator(
    "j03_semi_join_protected",
    f"SELECT doc_id FROM documents WHERE {_NORM} IN (SELECT {_NORM} FROM documents WHERE doc_id % 50 = 0) AND doc_id % 50 <> 0",
)
def j03(spark, d):
    """Documents whose normal form is that of a protected one (ids divisible by 50 stand for the set)."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2(t.norm_words("text"), 256).alias("h"))
    return docs.where("doc_id % 50 <> 0").join(docs.where("doc_id % 50 = 0").select("h"), "h", "left_semi").select("doc_id")


def gram_sql(name: str, key: str, n: int) -> str:
    return f"SELECT {key}, len(l) AS size, unnest(l) AS g FROM (SELECT {key}, {s.ngrams('w', n)} AS l FROM (SELECT {key}, {s.words('text')} AS w FROM {name}))"


@operator(
    "j04_inverted_index_join",
    f"""SELECT doc_id, item_id, count(*) AS shared FROM ({gram_sql('documents', 'doc_id', 5)}) a JOIN ({gram_sql('benchmark', 'item_id', 5)}) b USING (g) GROUP BY doc_id, item_id""",
)
def j04(spark, d):
    a = g.exploded(table(spark, d, "documents"), "doc_id", "text", 5)
    b = g.exploded(table(spark, d, "benchmark"), "item_id", "text", 5)
    return g.shared_grams(a, b, "doc_id", "item_id").select("doc_id", "item_id", "shared")


_B = f"SELECT item_id, len(w) AS n, unnest(w) AS g FROM (SELECT item_id, list_distinct({s.words('text')}) AS w FROM benchmark)"


@operator(
    "j05_all_pairs_theta_join",
    f"""SELECT a.item_id AS a, b.item_id AS b, round(count(*) / (max(a.n) + max(b.n) - count(*)), 6) AS jaccard FROM ({_B}) a JOIN ({_B}) b ON a.g = b.g AND a.item_id < b.item_id
    GROUP BY ALL HAVING count(*) / (max(a.n) + max(b.n) - count(*)) > 0.05""",
)
def j05(spark, d):
    w = table(spark, d, "benchmark").select("item_id", F.array_distinct(t.words("text")).alias("w"))
    one = w.select("item_id", F.size("w").alias("size"), F.explode("w").alias("g"))
    pairs = g.shared_grams(one.withColumnRenamed("item_id", "a"), one.withColumnRenamed("item_id", "b"), "a", "b").where("a < b")
    return pairs.select("a", "b", F.round(g.jaccard(), 6).alias("jaccard")).where(g.jaccard() > 0.05)


_NUMS = "list_distinct(list_filter(list_transform(regexp_extract_all(text, '[0-9][0-9.,]*'), lambda x: regexp_replace(x, '[.,]', '', 'g')), lambda x: length(x) >= 2))"
_ENTS = "list_distinct(list_transform(regexp_extract_all(text, '[a-z,] ([A-Z][a-z]{3,})', 1), lambda x: lower(x)))"


@operator(
    "j06_union_of_signals_join",
    f"""WITH a AS (SELECT doc_id, {_NUMS} AS n, {_ENTS} AS e FROM documents), b AS (SELECT item_id, {_NUMS} AS n, {_ENTS} AS e FROM benchmark),
    n AS (SELECT doc_id, item_id, len(list_intersect(a.n, b.n)) AS shared, len(list_distinct(list_concat(a.n, b.n))) AS whole, len(list_intersect(a.e, b.e)) AS entities FROM a, b WHERE list_has_any(a.n, b.n)),
    x AS (SELECT doc_id, item_id, count(*) / least(max(ax.size), max(bx.size)) AS c FROM ({gram_sql('documents', 'doc_id', 5)}) ax JOIN ({gram_sql('benchmark', 'item_id', 5)}) bx USING (g) GROUP BY ALL),
    f AS (SELECT doc_id, item_id, coalesce(c, 0) >= 0.15 AS by_text, coalesce(shared >= 2 AND shared / whole >= 0.5, FALSE) AS by_numbers, coalesce(entities >= 2, FALSE) AS by_entities FROM n FULL JOIN x USING (doc_id, item_id))
    SELECT * FROM f WHERE by_text OR by_numbers OR by_entities""",
)
def j06(spark, d):
    """All documents against the benchmark by three signals: shared 5-grams; two shared numbers that make half
    of both's; one shared number and two shared names. Names are compared for pairs that share a number."""
    side = lambda name, key: table(spark, d, name).select(F.col(key), "text")
    a, b = side("documents", "doc_id"), side("benchmark", "item_id")
    text = g.shared_grams(g.exploded(a, "doc_id", "text", 5), g.exploded(b, "item_id", "text", 5), "doc_id", "item_id")
    names = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit("[a-z,] ([A-Z][a-z]{3,})"), F.lit(1)), F.lower))
    signs = lambda x, key, n, e: x.select(key, F.array_distinct(t.numbers("text")).alias(n), names.alias(e)).where(F.size(n) > 0)
    x, y = signs(a, "doc_id", "an", "ae"), signs(b, "item_id", "bn", "be")
    pairs = (
        x.select("doc_id", F.explode("an").alias("g"))
        .join(y.select("item_id", F.explode("bn").alias("g")), "g")
        .groupBy("doc_id", "item_id")
        .agg(F.count(F.lit(1)).alias("shared"))
    )
    n = pairs.join(x, "doc_id").join(y, "item_id").select(
        "doc_id", "item_id", "shared", F.size(F.array_union("an", "bn")).alias("whole"), F.size(F.array_intersect("ae", "be")).alias("entities")
    )
    no = F.lit(False)
    found = n.join(text.select("doc_id", "item_id", g.containment().alias("c")), ["doc_id", "item_id"], "full").select(
        "doc_id", "item_id",
        F.coalesce(F.col("c") >= 0.15, no).alias("by_text"),
        F.coalesce((F.col("shared") >= 2) & (F.col("shared") / F.col("whole") >= 0.5), no).alias("by_numbers"),
        F.coalesce(F.col("entities") >= 2, no).alias("by_entities"),
    )
    return found.where("by_text or by_numbers or by_entities")


_TOP = f"""SELECT doc_id, item_id, shared FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY shared DESC, item_id) AS i FROM (
    SELECT doc_id, item_id, count(*) AS shared FROM ({gram_sql('documents', 'doc_id', 3)}) a JOIN ({gram_sql('benchmark', 'item_id', 3)}) b USING (g) GROUP BY doc_id, item_id)) WHERE i <= 10"""


@operator(
    "j07_topk_candidate_join",
    f"""WITH t AS ({_TOP}), e AS (SELECT doc_id, item_id, TRUE AS exact FROM (SELECT doc_id, {_NORM} AS x FROM documents) JOIN (SELECT item_id, {_NORM} AS x FROM benchmark) USING (x) WHERE x <> '')
    SELECT doc_id, item_id, coalesce(shared, 0) AS shared, coalesce(exact, FALSE) AS exact FROM t FULL JOIN e USING (doc_id, item_id)""",
)
def j07(spark, d):
    """The ten items that share most trigrams with a document, and all items that equal it when normalised."""
    return candidates(spark, d)


def candidates(spark, d):
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark")
    pairs = g.shared_grams(g.exploded(docs, "doc_id", "text", 3), g.exploded(items, "item_id", "text", 3), "doc_id", "item_id")
    top = first_by(pairs, ["doc_id"], [F.desc("shared"), F.col("item_id")], 10).select("doc_id", "item_id", "shared")
    form = lambda df, key: df.select(key, F.when(t.norm_words("text") != "", F.sha2(t.norm_words("text"), 256)).alias("h"))
    exact = form(docs, "doc_id").join(form(items, "item_id"), "h").select("doc_id", "item_id", F.lit(True).alias("exact"))
    return top.join(exact, ["doc_id", "item_id"], "full").select(
        "doc_id", "item_id", F.coalesce("shared", F.lit(0).cast("long")).alias("shared"), F.coalesce("exact", F.lit(False)).alias("exact")
    )


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Sequence similarity of two texts; null where a cheap upper bound rules 0.65 out."""
    out = []
    for x, y in zip(a, b):
        match = difflib.SequenceMatcher(None, x, y)
        out.append(match.ratio() if match.real_quick_ratio() >= 0.65 and match.quick_ratio() >= 0.65 else None)
    return pd.Series(out, dtype="float64")


@operator("j07_verified_candidates")
def j07_verified(spark, d):
    """The candidates that are equal, or alike by 0.65 in sequence. Texts whose lengths alone rule that out are
    not compared."""
    texts = lambda name, key, out: table(spark, d, name).select(key, t.norm_words("text").alias(out))
    pairs = candidates(spark, d).join(texts("benchmark", "item_id", "y"), "item_id").join(texts("documents", "doc_id", "x"), "doc_id")
    least, whole = F.least(F.length("x"), F.length("y")), F.length("x") + F.length("y")
    near = pairs.where(F.col("exact") | (2 * least >= 0.65 * whole)).withColumn("similarity", similarity("x", "y"))
    return near.where("exact or similarity >= 0.65").select("doc_id", "item_id", "exact", F.round("similarity", 3).alias("similarity"))


@operator(
    "j08_nearest_neighbour_join",
    f"""SELECT a, b, round(j, 6) AS jaccard FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY j DESC, b) AS i FROM (
    SELECT a.item_id AS a, b.item_id AS b, count(*) / (max(a.n) + max(b.n) - count(*)) AS j FROM ({_B}) a JOIN ({_B}) b ON a.g = b.g AND a.item_id <> b.item_id GROUP BY ALL)) WHERE i <= 3""",
)
def j08(spark, d):
    w = table(spark, d, "benchmark").select("item_id", F.array_distinct(t.words("text")).alias("w"))
    one = w.select("item_id", F.size("w").alias("size"), F.explode("w").alias("g"))
    pairs = g.shared_grams(one.withColumnRenamed("item_id", "a"), one.withColumnRenamed("item_id", "b"), "a", "b").where("a <> b")
    best = first_by(pairs.withColumn("j", g.jaccard()), ["a"], [F.desc("j"), F.col("b")], 3)
    return best.select("a", "b", F.round("j", 6).alias("jaccard"))


@operator(
    "j08_nearest_training_rows",
    f"""WITH e AS (SELECT item_id, list_distinct({s.words('text')}) AS w FROM benchmark), t AS (SELECT doc_id, list_distinct({s.words('text')}) AS w FROM documents),
    x AS (SELECT item_id, len(w) AS n, unnest(w) AS g FROM e), y AS (SELECT doc_id, len(w) AS n, unnest(w) AS g FROM t)
    SELECT item_id, doc_id, round(j, 6) AS jaccard FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY j DESC, doc_id) AS i FROM (
    SELECT item_id, doc_id, count(*) / (max(x.n) + max(y.n) - count(*)) AS j FROM x JOIN y USING (g) GROUP BY ALL)) WHERE i <= 3""",
)
def j08_training(spark, d):
    """The three documents (training rows) nearest to each benchmark item (evaluation row) by distinct words."""
    asking = table(spark, d, "benchmark").select(F.col("item_id").alias("a"), F.array_distinct(t.words("text")).alias("g"))
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("b"), F.array_distinct(t.words("text")).alias("g"))
    found = nearest_by_jaccard(asking, rows, 3)
    return found.select(F.col("a").alias("item_id"), F.col("b").alias("doc_id"), F.round("jaccard", 6).alias("jaccard"))


@operator(
    "j09_self_fanout_join",
    """SELECT conv_id, turn, k AS direction, CASE WHEN starts_with(k, 'a') THEN text ELSE lower(text) END AS source, CASE WHEN ends_with(k, 'a') THEN role ELSE upper(role) END AS target
    FROM conversations, (SELECT unnest(['a-a', 'a-b', 'b-a', 'b-b']) AS k)""",
)
def j09(spark, d):
    directions = F.explode(F.array(*[F.lit(x) for x in ("a-a", "a-b", "b-a", "b-b")]))
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", "text", directions.alias("direction"))
    return c.select(
        "conv_id", "turn", "direction",
        F.when(F.startswith("direction", F.lit("a")), F.col("text")).otherwise(F.lower("text")).alias("source"),
        F.when(F.endswith("direction", F.lit("a")), F.col("role")).otherwise(F.upper("role")).alias("target"),
    )


@operator(
    "j10_overlay_upsert",
    "SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), d.lang) AS value, l.doc_id IS NOT NULL AS replaced FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
)
def j10(spark, d):
    new = table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("new"), F.lit(True).alias("hit"))
    return table(spark, d, "documents").join(new, "doc_id", "left").select("doc_id", F.coalesce("new", "lang").alias("value"), F.coalesce("hit", F.lit(False)).alias("replaced"))


@operator(
    "j11_blind_key_decode_join",
    f"SELECT conv_id, label, CASE WHEN (label = 'A') = ({s.bucket('conv_id::VARCHAR', 2)} = 0) THEN 'base' ELSE 'candidate' END AS model FROM (SELECT DISTINCT conv_id FROM conversations), (SELECT unnest(['A', 'B']) AS label)",
)
def j11(spark, d):
    c = table(spark, d, "conversations").select("conv_id").distinct()
    key = c.select("conv_id", F.when(t.bucket("conv_id", modulus=2) == 0, F.array(F.lit("base"), F.lit("candidate"))).otherwise(F.array(F.lit("candidate"), F.lit("base"))).alias("models"))
    return key.select("conv_id", F.posexplode("models").alias("i", "model")).select("conv_id", F.when(F.col("i") == 0, "A").otherwise("B").alias("label"), "model")


_DAG = "SELECT p_partkey AS id, p_partkey // 2 AS parent FROM part WHERE p_partkey // 2 >= 1 UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey // 3 >= 1"


def tasks(spark, d):
    """Parts as tasks: one depends on the parts at a half and a third of its key, and edits the files of its
    brand and size, whose paths are spelled in several ways."""
    n = F.col("p_partkey")
    parents = F.array_distinct(F.filter(F.array(F.floor(n / 2), F.floor(n / 3)), lambda x: x >= 1))
    spelled = F.when(n % 3 == 0, F.concat(F.lit("src\\"), "p_brand", F.lit("\\./"))).when(n % 3 == 1, F.concat(F.lit("src/x/../"), F.upper("p_brand"), F.lit("//")))
    path = F.concat(spelled.otherwise(F.concat(F.lit("./src/"), "p_brand", F.lit("/"))), F.col("p_size").cast("string"))
    return table(spark, d, "part").select(n.alias("id"), parents.alias("depends_on"), F.array(path).alias("implementation_files"), n.alias("place"))


@operator("j12_dag_closure_join", f"WITH RECURSIVE e AS ({_DAG}), r(id, ancestor) AS (SELECT id, parent FROM e UNION SELECT r.id, e.parent FROM r JOIN e ON r.ancestor = e.id) SELECT id, ancestor FROM r")
def j12(spark, d):
    return gr.closure(gr.dependencies(tasks(spark, d)))


@operator(
    "j13_conflict_pair_join",
    f"""WITH RECURSIVE e AS ({_DAG}), r(id, ancestor) AS (SELECT id, parent FROM e UNION SELECT r.id, e.parent FROM r JOIN e ON r.ancestor = e.id)
    SELECT a.p_partkey AS a, b.p_partkey AS b, 'src/' || lower(a.p_brand) || '/' || a.p_size AS file FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey
    ANTI JOIN r ON r.id = b.p_partkey AND r.ancestor = a.p_partkey""",
)
def j13(spark, d):
    return gr.conflicts(tasks(spark, d)).select(F.col("left").alias("a"), F.col("right").alias("b"), F.array_join("files", ",").alias("file"))


@operator(
    "j14_three_way_merge",
    """SELECT l.doc_id, CASE WHEN l.quality = c.old THEN 'applied' WHEN l.quality = c.new THEN 'already' ELSE 'preserved' END AS outcome, CASE WHEN l.quality = c.old THEN c.new ELSE l.quality END AS value
    FROM labels l JOIN (SELECT doc_id, CAST(doc_id % 2 AS INTEGER) AS old, CAST((doc_id + 1) % 3 AS INTEGER) AS new FROM labels) c USING (doc_id)""",
)
def j14(spark, d):
    stored = table(spark, d, "labels").select("doc_id", "quality")
    change = stored.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("old"), ((F.col("doc_id") + 1) % 3).cast("int").alias("new"))
    outcome = F.when(F.col("quality") == F.col("old"), "applied").when(F.col("quality") == F.col("new"), "already").otherwise("preserved")
    j = stored.join(change, "doc_id")
    return j.select("doc_id", outcome.alias("outcome"), F.when(F.col("quality") == F.col("old"), F.col("new")).otherwise(F.col("quality")).alias("value"))
