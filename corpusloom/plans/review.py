"""Queries of human-review and preference operators (H) and of validation gates (V). Reviews aren't among the
tables; ranks and answers are derived from them by fixed rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import quality as q
from ..operators.windows import value_row_number
from ..registry import operator, table
from . import sql as s

CASES = "(SELECT DISTINCT conv_id FROM conversations)"


def cases(spark, d):
    return table(spark, d, "conversations").select("conv_id").distinct()


@operator(
    "h01_blind_pair_pack",
    f"SELECT conv_id, b = 1 AS swapped, CASE WHEN b = 1 THEN 'candidate' ELSE 'base' END AS a_is FROM (SELECT conv_id, {s.bucket('conv_id::VARCHAR', 2)} AS b FROM {CASES})",
)
def h01(spark, d):
    b = t.bucket("conv_id", modulus=2)
    return cases(spark, d).select("conv_id", (b == 1).alias("swapped"), F.when(b == 1, "candidate").otherwise("base").alias("a_is"))


@operator(
    "h02_blind_three_way",
    f"""SELECT conv_id, arm, substr('XYZ', CAST(row_number() OVER (PARTITION BY conv_id ORDER BY md5(arm || ':' || conv_id), arm) AS INTEGER), 1) AS label FROM {CASES}, (SELECT unnest(['base', 'first', 'second']) AS arm)""",
)
def h02(spark, d):
    arms = cases(spark, d).select("conv_id", F.explode(F.array(*[F.lit(x) for x in ("base", "first", "second")])).alias("arm"))
    i = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.md5(F.concat_ws(":", "arm", F.col("conv_id").cast("string"))), "arm"))
    return arms.select("conv_id", "arm", F.substring(F.lit("XYZ"), i, F.lit(1)).alias("label"))


_PAIRS = "SELECT a.conv_id, a.turn, a.text AS x, b.text AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"


def neighbours(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", F.col("text").alias("x")).join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("y")), ["conv_id", "turn"])


@operator(
    "h03_length_delta_columns",
    f"SELECT conv_id, turn, CAST(length(y) - length(x) AS BIGINT) AS delta, round(length(y) / nullif(length(x), 0), 4) AS ratio, CASE WHEN length(y) < length(x) THEN 'second' WHEN length(y) > length(x) THEN 'first' ELSE 'tie' END AS shorter FROM ({_PAIRS})",
)
def h03(spark, d):
    x, y = F.length("x"), F.length("y")
    return neighbours(spark, d).select(
        "conv_id", "turn", (y - x).cast("long").alias("delta"), F.round(y / F.nullif(x, F.lit(0)), 4).alias("ratio"),
        F.when(y < x, "second").when(y > x, "first").otherwise("tie").alias("shorter"),
    )


#: a ranking such as A>B=C of each case, from its id
_RANKING = "CASE conv_id % 4 WHEN 0 THEN 'A>B>C' WHEN 1 THEN 'B=C>A' WHEN 2 THEN 'C>A=B' ELSE 'A=B=C' END"
_RANKS = f"SELECT conv_id, unnest(string_split(g, '=')) AS arm, i AS rank FROM (SELECT conv_id, unnest(string_split(r, '>')) AS g, unnest(range(1, len(string_split(r, '>')) + 1)) AS i FROM (SELECT conv_id, {_RANKING} AS r FROM {CASES}))"


def ranks(spark, d):
    k = F.col("conv_id") % 4
    r = F.when(k == 0, "A>B>C").when(k == 1, "B=C>A").when(k == 2, "C>A=B").otherwise("A=B=C")
    groups = cases(spark, d).select("conv_id", F.posexplode(F.split(r, ">")).alias("i", "g"))
    return groups.select("conv_id", F.explode(F.split("g", "=")).alias("arm"), (F.col("i") + 1).cast("long").alias("rank"))


@operator("h04_ranking_parse", _RANKS)
def h04(spark, d):
    return ranks(spark, d)


@operator(
    "h05_preference_aggregate",
    f"""SELECT arm, CAST(sum(CAST(rank = 1 AND n = 1 AS INTEGER)) AS BIGINT) AS sole_best, CAST(sum(CAST(rank = 1 AND n > 1 AS INTEGER)) AS BIGINT) AS tied_best, count(*) AS cases
    FROM (SELECT *, sum(CAST(rank = 1 AS INTEGER)) OVER (PARTITION BY conv_id) AS n FROM ({_RANKS})) GROUP BY arm""",
)
def h05(spark, d):
    r = ranks(spark, d).withColumn("n", F.sum((F.col("rank") == 1).cast("int")).over(Window.partitionBy("conv_id")))
    return r.groupBy("arm").agg(
        F.sum(F.expr("case when rank = 1 and n = 1 then 1 else 0 end")).alias("sole_best"),
        F.sum(F.expr("case when rank = 1 and n > 1 then 1 else 0 end")).alias("tied_best"),
        F.count(F.lit(1)).alias("cases"),
    )


@operator(
    "h06_pairwise_preference_score",
    f"""SELECT a.arm, round(sum(CASE WHEN a.rank < b.rank THEN 1.0 WHEN a.rank = b.rank THEN 0.5 ELSE 0 END) / count(*), 6) AS score, round(avg(a.rank), 6) AS mean_rank FROM ({_RANKS}) a JOIN ({_RANKS}) b ON a.conv_id = b.conv_id AND a.arm <> b.arm GROUP BY a.arm""",
)
def h06(spark, d):
    r = ranks(spark, d)
    j = r.join(r.toDF("conv_id", "other", "other_rank"), "conv_id").where("arm <> other")
    points = F.when(F.col("rank") < F.col("other_rank"), 1.0).when(F.col("rank") == F.col("other_rank"), 0.5).otherwise(0.0)
    return j.groupBy("arm").agg(F.round(F.sum(points) / F.count(F.lit(1)), 6).alias("score"), F.round(F.avg("rank"), 6).alias("mean_rank"))


@operator(
    "h07_graded_win_loss",
    """SELECT CAST(sum(CAST(a > b AS INTEGER)) AS BIGINT) AS wins, CAST(sum(CAST(a < b AS INTEGER)) AS BIGINT) AS losses, CAST(sum(CAST(a = b AS INTEGER)) AS BIGINT) AS ties, round(100 * (avg(a) - avg(b)), 6) AS delta_pp
    FROM (SELECT (doc_id % 3) / 2 AS a, ((doc_id // 3) % 3) / 2 AS b FROM documents)""",
)
def h07(spark, d):
    g = table(spark, d, "documents").select(((F.col("doc_id") % 3) / 2).alias("a"), ((F.floor(F.col("doc_id") / 3) % 3) / 2).alias("b"))
    count = lambda c: F.sum(c.cast("long"))
    return g.agg(
        count(F.col("a") > F.col("b")).alias("wins"), count(F.col("a") < F.col("b")).alias("losses"), count(F.col("a") == F.col("b")).alias("ties"),
        F.round(100 * (F.avg("a") - F.avg("b")), 6).alias("delta_pp"),
    )


_DECISION = "CASE WHEN quality = 0 THEN 'reject' WHEN toxic = 1 THEN 'edit' ELSE 'accept' END"


@operator(
    "h08_decision_application",
    f"SELECT doc_id, decision, sha256(CASE WHEN decision = 'edit' THEN '[edited] ' || text ELSE text END) AS h FROM (SELECT d.doc_id, text, {_DECISION} AS decision FROM documents d JOIN labels USING (doc_id)) WHERE decision <> 'reject'",
)
def h08(spark, d):
    decision = F.when(F.col("quality") == 0, "reject").when(F.col("toxic") == 1, "edit").otherwise("accept")
    j = table(spark, d, "documents").select("doc_id", "text").join(table(spark, d, "labels").select("doc_id", decision.alias("decision")), "doc_id")
    text = F.when(F.col("decision") == "edit", F.concat(F.lit("[edited] "), "text")).otherwise(F.col("text"))
    return j.where("decision <> 'reject'").select("doc_id", "decision", F.sha2(text, 256).alias("h"))


@operator(
    "h09_approval_rules",
    "SELECT doc_id, array_to_string(list_filter([CASE WHEN quality <> 1 THEN 'quality' END, CASE WHEN toxic <> 0 THEN 'toxic' END, CASE WHEN doc_id % 4 = 0 THEN 'unsigned' END], lambda x: x IS NOT NULL), ',') AS blockers FROM labels",
)
def h09(spark, d):
    b = q.flags(("quality", F.col("quality") != 1), ("toxic", F.col("toxic") != 0), ("unsigned", F.col("doc_id") % 4 == 0))
    return table(spark, d, "labels").select("doc_id", F.array_join(b, ",").alias("blockers"))


@operator("h10_agreement_rate", "SELECT round(avg(CAST(a = b AS INTEGER)), 6) AS agreement, count(a = b) AS pairs FROM (SELECT quality AS a, CASE WHEN doc_id % 5 <> 0 THEN 1 - toxic END AS b FROM labels)")
def h10(spark, d):
    same = F.col("quality") == F.when(F.col("doc_id") % 5 != 0, 1 - F.col("toxic"))
    return table(spark, d, "labels").agg(F.round(F.avg(same.cast("int")), 6).alias("agreement"), F.count(same).alias("pairs"))


@operator("h11_edit_count_by_category", f"SELECT role, count(*) AS n, CAST(sum(CAST({s.norm_words('text')} <> lower(text) AS INTEGER)) AS BIGINT) AS edited FROM conversations GROUP BY role")
def h11(spark, d):
    edited = (t.norm_words("text") != F.lower("text")).cast("long")
    return table(spark, d, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum(edited).alias("edited"))


@operator("h12_review_stratified_queue", "SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY source, doc_id) AS position, '' AS owner FROM documents")
def h12(spark, d):
    docs = value_row_number(table(spark, d, "documents").select("lang", "doc_id", "source"), ["lang"], F.col("source"), "doc_id", "position")
    return docs.select("lang", "doc_id", "position", F.lit("").alias("owner"))


# -- gates: rows are violations


@operator(
    "v01_row_shape_gate",
    """SELECT conv_id, unnest(list_filter([CASE WHEN first <> 'system' THEN 'no_system' END, CASE WHEN last <> 'assistant' THEN 'open_end' END, CASE WHEN n < 2 THEN 'short' END], lambda x: x IS NOT NULL)) AS violation
    FROM (SELECT conv_id, arg_min(role, turn) AS first, arg_max(role, turn) AS last, count(*) AS n FROM conversations GROUP BY conv_id)""",
)
def v01(spark, d):
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.min_by("role", "turn").alias("first"), F.max_by("role", "turn").alias("last"), F.count(F.lit(1)).alias("n"))
    return g.select("conv_id", F.explode(q.flags(("no_system", F.col("first") != "system"), ("open_end", F.col("last") != "assistant"), ("short", F.col("n") < 2))).alias("violation"))


@operator("v02_uniqueness_gate", "SELECT 'url' AS key, url AS value, count(*) AS n FROM pages GROUP BY url HAVING count(*) > 1 UNION ALL SELECT 'text', sha256(text), count(*) FROM documents GROUP BY text HAVING count(*) > 1")
def v02(spark, d):
    a = table(spark, d, "pages").select(F.lit("url").alias("key"), F.col("url").alias("value"))
    b = table(spark, d, "documents").select(F.lit("text").alias("key"), F.sha2("text", 256).alias("value"))
    return a.union(b).groupBy("key", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@operator(
    "v03_completeness_gate",
    "SELECT coalesce(e.lang, a.lang) AS lang, coalesce(n, 0) AS found, coalesce(want, 0) AS expected FROM (SELECT unnest(['en', 'de', 'it']) AS lang, 250 AS want) e FULL JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY lang) a ON e.lang = a.lang WHERE coalesce(n, 0) <> coalesce(want, 0)",
)
def v03(spark, d):
    want = spark.createDataFrame([("en", 250), ("de", 250), ("it", 250)], "lang string, expected int")
    have = table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("found"))
    return want.join(have, "lang", "full").fillna(0, ["found", "expected"]).where("found <> expected")


@operator(
    "v04_split_isolation_gate",
    "SELECT sha256(text) AS h, count(DISTINCT doc_id % 3) AS splits FROM documents GROUP BY text HAVING count(DISTINCT doc_id % 3) > 1",
)
def v04(spark, d):
    g = table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.count_distinct(F.col("doc_id") % 3).alias("splits"))
    return g.where("splits > 1")


@operator(
    "v05_cross_variant_consistency",
    "SELECT o_custkey, count(DISTINCT o_orderpriority) AS priorities, count(DISTINCT o_orderstatus) AS statuses FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) > 1",
)
def v05(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.count_distinct("o_orderpriority").alias("priorities"), F.count_distinct("o_orderstatus").alias("statuses"))
    return g.where("statuses > 1")


@operator("v06_reviewed_exception_allowlist", "SELECT doc_id FROM labels WHERE quality = 0 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def v06(spark, d):
    l = table(spark, d, "labels")
    return l.where("quality = 0").select("doc_id").join(l.where("toxic = 1").select("doc_id"), "doc_id", "left_anti")


_REASONED = f"SELECT conv_id, turn, CASE WHEN conv_id % 7 = 0 THEN ' ' ELSE x END AS x, CASE WHEN conv_id % 3 = 0 THEN y || chr(10) || x WHEN conv_id % 5 = 0 THEN x ELSE y END AS y FROM ({_PAIRS})"


@operator(
    "v07_reasoning_separation",
    f"""SELECT conv_id, turn, CASE WHEN trim(x) = '' THEN 'missing' WHEN x = y THEN 'equal' ELSE 'contained' END AS violation FROM ({_REASONED})
    WHERE trim(x) = '' OR contains(y, x)""",
)
def v07(spark, d):
    """A turn stands for reasoning, the next for the answer; some answers quote all of it, some are it, some
    reasonings are blank."""
    n, x = F.col("conv_id"), F.when(F.col("conv_id") % 7 == 0, " ").otherwise(F.col("x"))
    y = F.when(n % 3 == 0, F.concat("y", F.lit("\n"), "x")).when(n % 5 == 0, F.col("x")).otherwise(F.col("y"))
    rows = neighbours(spark, d).select("conv_id", "turn", x.alias("x"), y.alias("y"))
    missing = F.trim("x") == ""
    violation = F.when(missing, "missing").when(F.col("x") == F.col("y"), "equal").otherwise("contained")
    return rows.where(missing | F.contains("y", F.col("x"))).select("conv_id", "turn", violation.alias("violation"))


_MARKUP = r"(<\|[a-z_]+\|>|</?think>|!!|%%%)"


@operator("v08_forbidden_markup", f"SELECT doc_id, regexp_extract(text, '{_MARKUP}') AS mark FROM documents WHERE regexp_matches(text, '{_MARKUP}')")
def v08(spark, d):
    return table(spark, d, "documents").where(F.col("text").rlike(_MARKUP)).select("doc_id", F.regexp_extract("text", _MARKUP, 0).alias("mark"))


@operator(
    "v09_constraint_checks",
    f"""SELECT event_id, TRY_CAST(props AS JSON) IS NOT NULL AS json, length(props) BETWEEN 5 AND 40 AS band FROM events""",
)
def v09(spark, d):
    return table(spark, d, "events").select("event_id", F.expr("try_parse_json(props) is not null").alias("json"), F.length("props").between(5, 40).alias("band"))


#: labels of a text's words: the first half is the prompt (-100), the rest is supervised
_MASK = f"SELECT doc_id, len(w) AS n, list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i * 2 <= len(w) THEN -100 ELSE i END) AS labels FROM (SELECT doc_id, {s.words('text')} AS w FROM documents)"


def masks(spark, d):
    n = F.size("w")
    places = F.when(n == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), n))
    w = table(spark, d, "documents").select("doc_id", t.words("text").alias("w"))
    return w.select("doc_id", n.cast("long").alias("n"), F.transform(places, lambda i: F.when(i * 2 <= n, F.lit(-100)).otherwise(i)).alias("labels"))


@operator(
    "v10_label_mask_audit",
    f"SELECT doc_id, CAST(len(list_filter(labels, lambda x: x = -100)) AS BIGINT) AS masked, CAST(len(list_filter(labels, lambda x: x <> -100)) AS BIGINT) AS supervised, len(labels) = n AS whole FROM ({_MASK})",
)
def v10(spark, d):
    return masks(spark, d).select(
        "doc_id", F.size(F.filter("labels", lambda x: x == -100)).cast("long").alias("masked"), F.size(F.filter("labels", lambda x: x != -100)).cast("long").alias("supervised"),
        (F.size("labels") == F.col("n")).alias("whole"),
    )


@operator("v11_rationale_mask_arm", f"SELECT doc_id, CAST(list_sum(list_transform(labels, lambda x: CASE WHEN x % 3 = 0 THEN -100 ELSE x END)) AS BIGINT) AS checksum FROM ({_MASK}) WHERE n > 0")
def v11(spark, d):
    arm = F.transform("labels", lambda x: F.when(x % 3 == 0, F.lit(-100)).otherwise(x))
    return masks(spark, d).where("n > 0").select("doc_id", F.aggregate(arm, F.lit(0).cast("long"), lambda a, x: a + x).alias("checksum"))


@operator(
    "v12_left_right_padding",
    "SELECT vec_id, CAST(len(x) AS BIGINT) AS width, x[1] AS head, x[8] AS tail FROM (SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN list_concat(list_resize([]::BIGINT[], 8 - k, 0::BIGINT), range(1, k + 1)) ELSE list_concat(range(1, k + 1), list_resize([]::BIGINT[], 8 - k, 0::BIGINT)) END AS x FROM (SELECT vec_id, 1 + vec_id % 8 AS k FROM embeddings))",
)
def v12(spark, d):
    k = 1 + F.col("vec_id") % 8
    body, pad = F.sequence(F.lit(1).cast("long"), k), F.array_repeat(F.lit(0).cast("long"), (8 - k).cast("int"))
    x = F.when(F.col("vec_id") % 2 == 0, F.concat(pad, body)).otherwise(F.concat(body, pad))
    return table(spark, d, "embeddings").select("vec_id", x.alias("x")).select("vec_id", F.size("x").cast("long").alias("width"), F.col("x")[0].alias("head"), F.col("x")[7].alias("tail"))


@operator("v13_protocol_parity", "SELECT 'configs' AS arm, CAST(count(DISTINCT sha256(role)) AS INTEGER) AS n FROM conversations WHERE turn = 0")
def v13(spark, d):
    first = table(spark, d, "conversations").where("turn = 0")
    return first.agg(F.count_distinct(F.sha2("role", 256)).cast("int").alias("n")).select(F.lit("configs").alias("arm"), "n")


MASTER = "doc_id bigint, lang string, text string, source string, n_chars int, license string"
_MASTER_SQL = ", ".join(f"({i}, '{x.split()[0]}', '{x.split()[1]}')" for i, x in enumerate(MASTER.split(", ")))
_FOUND_SQL = """SELECT row_number() OVER () - 1 AS place, column_name AS field, CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' ELSE lower(column_type) END AS kind
    FROM (DESCRIBE SELECT * FROM documents)"""


def schema_drift(schema, master) -> list[tuple]:
    """(field, drift, master's, found) of every difference of two headers: missing and extra fields, other
    types, other places."""
    want = {f.name: (i, f.dataType.simpleString()) for i, f in enumerate(master.fields)}
    have = {f.name: (i, f.dataType.simpleString()) for i, f in enumerate(schema.fields)}
    out = [(k, "missing", want[k][1], None) for k in want.keys() - have.keys()]
    out += [(k, "extra", None, have[k][1]) for k in have.keys() - want.keys()]
    for k in want.keys() & have.keys():
        out += [(k, "type", want[k][1], have[k][1])] * (want[k][1] != have[k][1])
        out += [(k, "place", str(want[k][0]), str(have[k][0]))] * (want[k][0] != have[k][0])
    return sorted(out, key=lambda x: x[:2])


@operator(
    "v14_schema_drift_by_header",
    f"""WITH m(place, field, kind) AS (VALUES {_MASTER_SQL}), h AS ({_FOUND_SQL})
    SELECT field, drift, master, found FROM (
    SELECT m.field, 'missing' AS drift, m.kind AS master, NULL::VARCHAR AS found FROM m ANTI JOIN h USING (field) UNION ALL SELECT h.field, 'extra', NULL, h.kind FROM h ANTI JOIN m USING (field)
    UNION ALL SELECT field, 'type', m.kind, h.kind FROM m JOIN h USING (field) WHERE m.kind <> h.kind
    UNION ALL SELECT field, 'place', CAST(m.place AS VARCHAR), CAST(h.place AS VARCHAR) FROM m JOIN h USING (field) WHERE m.place <> h.place)""",
)
def v14(spark, d):
    """The header of documents against a master header that it departs from in four ways."""
    from pyspark.sql.types import _parse_datatype_string

    rows = schema_drift(table(spark, d, "documents").schema, _parse_datatype_string(MASTER))
    return spark.createDataFrame(rows, "field string, drift string, master string, found string")


@operator("v15_balance_gate", "SELECT label, count(*) AS n FROM embeddings GROUP BY label HAVING count(*) <> (SELECT count(*) // count(DISTINCT label) FROM embeddings)")
def v15(spark, d):
    e = table(spark, d, "embeddings")
    even = e.agg(F.floor(F.count(F.lit(1)) / F.count_distinct("label")).alias("even"))
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(even)).where("n <> even").select("label", "n")


@operator("v16_packed_length_gate", f"SELECT doc_id, CAST(len({s.words('text')}) AS BIGINT) AS n FROM documents WHERE len({s.words('text')}) > 2000")
def v16(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(t.words("text")).cast("long").alias("n")).where("n > 2000")


@operator(
    "v17_meta_text_scan",
    """SELECT conv_id, turn, i AS line FROM (SELECT conv_id, turn, i, l, sum(CAST(contains(l, '|') AS INTEGER)) OVER (PARTITION BY conv_id, turn ORDER BY i) % 2 AS open FROM (
    SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM conversations)) WHERE open = 0 AND regexp_matches(l, '(?i)that|avec|nicht')""",
)
def v17(spark, d):
    lines = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("p", "l"))
    open_ = F.sum(F.contains("l", F.lit("|")).cast("int")).over(Window.partitionBy("conv_id", "turn").orderBy("p")) % 2
    return lines.withColumn("open", open_).where((F.col("open") == 0) & F.col("l").rlike("(?i)that|avec|nicht")).select("conv_id", "turn", (F.col("p") + 1).cast("long").alias("line"))


@operator("v18_requirement_numbering", "SELECT doc_id FROM (SELECT doc_id, regexp_extract('test_r' || (doc_id % 6) || '_x', 'test_r([0-9]+)_', 1) AS r FROM documents) WHERE NOT list_contains(['0', '1', '2', '3', '4'], r)")
def v18(spark, d):
    r = F.regexp_extract(F.concat(F.lit("test_r"), (F.col("doc_id") % 6).cast("string"), F.lit("_x")), "test_r([0-9]+)_", 1)
    return table(spark, d, "documents").where(~r.isin("0", "1", "2", "3", "4")).select("doc_id")


@operator(
    "v19_row_metadata_audit",
    """SELECT reason, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN NOT regexp_matches(md5(url) || substr(md5(html), 1, 8), '^[0-9a-f]{40}$') THEN 'revision' END, CASE WHEN NOT contains(html, 'License') THEN 'no_license' END], lambda x: x IS NOT NULL)) AS reason FROM pages) GROUP BY reason""",
)
def v19(spark, d):
    revision = F.concat(F.md5("url"), F.substring(F.md5("html"), 1, 8))
    r = q.flags(("revision", ~revision.rlike("^[0-9a-f]{40}$")), ("no_license", ~F.contains("html", F.lit("License"))))
    return table(spark, d, "pages").select(F.explode(r).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
