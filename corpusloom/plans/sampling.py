"""Queries of sampling and splitting (K) and set operations (U)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import sampling as k
from ..operators.budget import budgeted
from ..operators.windows import first_by, hash_row_number, hash_running_sum, ordered_prefix, value_row_number
from ..registry import operator, table
from . import sql as s


def _h(salt: str, *parts: str) -> str:
    return "sha256(concat_ws(':', '" + salt + "', " + ", ".join(parts) + "))"


@operator("k01_hash_rank_topk", f"SELECT doc_id FROM documents ORDER BY {_h('pool', 'doc_id')}, doc_id LIMIT 100")
def k01(spark, d):
    return k.top_by_hash(table(spark, d, "documents").select("doc_id"), 100, "pool", "doc_id")


@operator(
    "k02_hash_rank_topk_per_group",
    f"SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY {_h('g', 'doc_id')}, doc_id) AS i FROM documents) WHERE i <= 10",
)
def k02(spark, d):
    return k.top_by_hash_per_group(table(spark, d, "documents").select("source", "doc_id"), 10, "g", ["source"], "doc_id")


def _split_sql(salt: str, least: int, shares: dict, strata: str) -> str:
    end, cases = "0", ""
    for name, share in shares.items():
        end = f"{end} + greatest({least}, round_even(n * {share}, 0))"
        cases += f" WHEN i <= {end} THEN '{name}'"
    return f"""SELECT doc_id, CASE{cases} ELSE 'train' END AS split FROM (SELECT doc_id, row_number() OVER (PARTITION BY {strata} ORDER BY {_h(salt, strata, 'doc_id')}, doc_id) AS i,
    count(*) OVER (PARTITION BY {strata}) AS n FROM documents)"""


@operator("k03_hash_stratified_split", _split_sql("split", 0, {"validation": 0.1, "test": 0.1}, "lang, source"))
def k03(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    return k.stratified_split(docs, ["lang", "source"], "doc_id", {"validation": 0.1, "test": 0.1}, "split").select("doc_id", "split")


@operator("k04_stratified_split_min1", _split_sql("min1", 1, {"validation": 0.1, "calibration": 0.05}, "source"))
def k04(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    return k.stratified_split(docs, ["source"], "doc_id", {"validation": 0.1, "calibration": 0.05}, "min1", least=1).select("doc_id", "split")


MIX = {"en": 0.5, "de": 0.3, "fr": 0.2}
_MIX_SQL = "CASE lang " + " ".join(f"WHEN '{a}' THEN CAST({w} AS DOUBLE)" for a, w in MIX.items()) + " END"


@operator(
    "k05_weighted_mixture",
    f"""WITH c AS (SELECT lang, count(*) AS n, {_MIX_SQL} AS w FROM documents WHERE lang IN ('en', 'de', 'fr') GROUP BY lang),
    q AS (SELECT lang, least(n, greatest(1, round_even((SELECT min(n / w) FROM c) * w, 0))) AS quota FROM c)
    SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY {_h('mix', 'doc_id')}, doc_id) AS i FROM documents) JOIN q USING (lang) WHERE i <= quota""",
)
def k05(spark, d):
    return k.weighted_mixture(table(spark, d, "documents").select("lang", "doc_id"), "lang", MIX, "doc_id", "mix").select("lang", "doc_id")


@operator(
    "k06_largest_remainder_quota",
    """WITH c AS (SELECT source, CAST(count(*) AS DOUBLE) AS n FROM documents GROUP BY source), e AS (SELECT source, n * 333 / sum(n) OVER () AS x FROM c),
    p AS (SELECT source, floor(x) AS f, row_number() OVER (ORDER BY x - floor(x) DESC, source) AS i, 333 - sum(floor(x)) OVER () AS l FROM e)
    SELECT source, CAST(f + CASE WHEN i <= l THEN 1 ELSE 0 END AS BIGINT) AS quota FROM p""",
)
def k06(spark, d):
    counts = table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return k.largest_remainder(counts, "source", "n", 333)


@operator(
    "k07_balanced_subset",
    f"""SELECT quality, doc_id FROM (SELECT quality, doc_id, row_number() OVER (PARTITION BY quality ORDER BY {_h('bal', 'doc_id')}, doc_id) AS i FROM labels)
    WHERE i <= (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY quality))""",
)
def k07(spark, d):
    labels = table(spark, d, "labels")
    least = labels.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("least"))
    ranked = hash_row_number(labels, ["quality"], k.hash_rank("bal", "doc_id"), "doc_id", "i")
    return ranked.crossJoin(F.broadcast(least)).where("i <= least").select("quality", "doc_id")


@operator(
    "k08_capped_select",
    f"""SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source, f ORDER BY {_h('cap', 'doc_id')}, doc_id) AS i
    FROM (SELECT source, doc_id, array_to_string({s.words('text')}[1:1], ' ') AS f FROM documents)) WHERE i <= 2""",
)
def k08(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", F.array_join(F.slice(t.words("text"), 1, 1), " ").alias("f"))
    return k.top_by_hash_per_group(docs, 2, "cap", ["source", "f"], "doc_id").select("source", "doc_id")


CAPPED_SCHEMA = "category string, doc_id long"


@operator("k08_capped_greedy_select")
def k08_exact(spark, d):
    """Two caps at once, in hash order: at most two rows per first word and three per length class in each
    source."""
    docs = table(spark, d, "documents").select(
        F.col("source").alias("category"), "doc_id", F.array_join(F.slice(t.words("text"), 1, 1), " ").alias("a"),
        F.floor(F.log10(F.col("n_chars") + 1) * 4).alias("b"), k.hash_rank("greedy", "doc_id").alias("h"),
    )
    return k.doubly_capped(docs, 2, 3)


_HOSTS = f"SELECT page_id, {s.host('url')} AS host, length(html) AS n FROM pages"


@operator(
    "k09_host_cap_running_sum",
    f"""SELECT page_id, host FROM (SELECT page_id, host, n, sum(n) OVER (PARTITION BY host ORDER BY {_h('host', 'page_id')}, page_id ROWS UNBOUNDED PRECEDING) AS c FROM ({_HOSTS})) WHERE c <= 20000""",
)
def k09(spark, d):
    p = table(spark, d, "pages").select("page_id", t.host("url").alias("host"), F.length("html").alias("n"))
    c = hash_running_sum(p, ["host"], k.hash_rank("host", "page_id"), "page_id", "n", "c")
    return c.where("c <= 20000").select("page_id", "host")


@operator("k09_host_cap_greedy")
def k09_exact(spark, d):
    """Exact greedy cap: a page that would exceed its host's budget is skipped and later, shorter ones may
    still fit."""
    p = table(spark, d, "pages").select("page_id", t.host("url").alias("host"), F.length("html").cast("long").alias("n"), k.hash_rank("host", "page_id").alias("h"))
    return budgeted(p, "host", "page_id", "n", "h", 20000)


@operator(
    "k10_one_per_source_group",
    f"SELECT {_h('one', 'doc_id')} AS h, doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY {s.blank('lower(text)')} ORDER BY {_h('one', 'doc_id')}, doc_id) AS i FROM documents) WHERE i = 1",
)
def k10(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2(t.blank(F.lower("text")), 256).alias("g"), k.hash_rank("one", "doc_id").alias("h"))
    return docs.groupBy("g").agg(F.min(F.struct("h", "doc_id")).alias("x")).select("x.*")


@operator(
    "k11_round_robin_interleave",
    "SELECT doc_id, row_number() OVER (ORDER BY i, source) AS position FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents) WHERE i <= 20",
)
def k11(spark, d):
    """The first 20 rows of each source take turns (a report of bounded size, ranked in one task)."""
    docs = first_by(table(spark, d, "documents").select("doc_id", "source"), ["source"], ["doc_id"], 20)
    i = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return docs.withColumn("i", i).select("doc_id", F.row_number().over(Window.orderBy("i", "source")).cast("long").alias("position"))


@operator(
    "k12_category_representatives",
    """SELECT DISTINCT doc_id FROM (SELECT min(doc_id) AS doc_id FROM documents GROUP BY lang, source UNION ALL
    SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents) WHERE i = (n - 1) // 2)""",
)
def k12(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    middle = value_row_number(docs, ["lang"], F.col("n_chars"), "doc_id", "i", "n").where("i - 1 = (n - 1) div 2")
    return docs.groupBy("lang", "source").agg(F.min("doc_id").alias("doc_id")).select("doc_id").union(middle.select("doc_id")).distinct()


@operator(
    "k13_epoch_permutation",
    f"SELECT source, epoch, doc_id, row_number() OVER (PARTITION BY source, epoch ORDER BY {_h('e', 'epoch', 'doc_id')}, doc_id) AS position FROM documents, (SELECT unnest([0, 1, 2]) AS epoch)",
)
def k13(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("epoch"))
    ranked = hash_row_number(docs, ["source", "epoch"], k.hash_rank("e", "epoch", "doc_id"), "doc_id", "position")
    return ranked.select("source", "epoch", "doc_id", "position")


@operator("k14_source_family_split", f"SELECT doc_id, source, CASE WHEN {s.bucket('source', 10)} < 2 THEN 'test' ELSE 'train' END AS split FROM documents")
def k14(spark, d):
    return table(spark, d, "documents").select("doc_id", "source", F.when(t.bucket("source", modulus=10) < 2, "test").otherwise("train").alias("split"))


@operator(
    "k15_diagnostic_prefix",
    """SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN i <= 2 THEN 0 ELSE 1 END, lang, doc_id) AS position
    FROM (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS i FROM documents)""",
)
def k15(spark, d):
    """Two rows of each language come first. Which two a task knows for its own rows; only they meet."""
    docs = table(spark, d, "documents").select("source", "lang", "doc_id")
    first = first_by(docs, ["source", "lang"], ["doc_id"], 2).select(F.col("doc_id").alias("chosen"))
    marked = docs.join(first, F.col("doc_id") == F.col("chosen"), "left")
    order = F.struct(F.col("chosen").isNull().cast("int").alias("later"), "lang")
    return value_row_number(marked, ["source"], order, "doc_id", "position").select("source", "doc_id", "position")


@operator(
    "u01_union_concat",
    "SELECT 'doc' AS kind, doc_id AS id, lang, NULL::VARCHAR AS role, n_chars FROM documents UNION ALL SELECT 'turn', conv_id, NULL, role, length(text) FROM conversations",
)
def u01(spark, d):
    a = table(spark, d, "documents").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), "lang", "n_chars")
    b = table(spark, d, "conversations").select(F.lit("turn").alias("kind"), F.col("conv_id").alias("id"), "role", F.length("text").cast("long").alias("n_chars"))
    return a.unionByName(b, allowMissingColumns=True)


@operator("u02_intersection_gate", "SELECT sha256(text) AS h FROM documents WHERE doc_id % 5 = 0 INTERSECT SELECT sha256(text) FROM documents WHERE doc_id % 5 <> 0")
def u02(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return docs.where("doc_id % 5 = 0").select("h").intersect(docs.where("doc_id % 5 <> 0").select("h"))


@operator("u03_multiset_difference", "SELECT l_suppkey FROM lineitem WHERE l_linestatus = 'O' EXCEPT ALL SELECT l_suppkey FROM lineitem WHERE l_linestatus = 'F'")
def u03(spark, d):
    lines = table(spark, d, "lineitem")
    return lines.where("l_linestatus = 'O'").select("l_suppkey").exceptAll(lines.where("l_linestatus = 'F'").select("l_suppkey"))


@operator(
    "u04_symmetric_difference_schema",
    """WITH a AS (SELECT column_name AS c FROM (DESCRIBE SELECT * FROM documents)), b AS (SELECT column_name AS c FROM (DESCRIBE SELECT * FROM pages))
    SELECT c AS column, 'left' AS side FROM a ANTI JOIN b USING (c) UNION ALL SELECT c, 'right' FROM b ANTI JOIN a USING (c)""",
)
def u04(spark, d):
    """Columns that only one of two tables has."""
    a, b = set(table(spark, d, "documents").columns), set(table(spark, d, "pages").columns)
    rows = [(c, "left" if c in a else "right") for c in sorted(a ^ b)]
    return spark.createDataFrame(rows, "column string, side string")


_FROZEN = "sha256('frozen:' || doc_id)"


@operator(
    "u05_frozen_superset_prefix",
    f"""WITH d AS (SELECT doc_id, {_FROZEN} AS h FROM documents), old AS (SELECT doc_id, row_number() OVER (ORDER BY h, doc_id) AS i FROM d WHERE h < '8'),
    new AS (SELECT doc_id, row_number() OVER (ORDER BY h, doc_id) AS i FROM d WHERE h < 'c')
    SELECT count(*) AS frozen, count(new.i) AS kept, CAST(sum(CASE WHEN new.i = old.i THEN 1 ELSE 0 END) AS BIGINT) AS same_place FROM old LEFT JOIN new USING (doc_id)""",
)
def u05(spark, d):
    """Places of a frozen selection (half of all ids, by hash) in its extension (three quarters): of how many
    rows, how many are kept, and how many stand at their place."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2(F.concat(F.lit("frozen:"), F.col("doc_id").cast("string")), 256).alias("h"))
    placed = lambda end, name: ordered_prefix(docs.where(F.col("h") < end), F.col("h"), F.lit(1), name, "doc_id").select("doc_id", name)
    both = placed("8", "old").join(placed("c", "new"), "doc_id", "left")
    same = F.sum(F.coalesce((F.col("old") == F.col("new")).cast("long"), F.lit(0)))
    return both.agg(F.count(F.lit(1)).alias("frozen"), F.count("new").alias("kept"), same.alias("same_place"))
