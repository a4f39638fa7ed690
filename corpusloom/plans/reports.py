"""Queries of reports in full: position bias with its flag (M05), argmax over valid options (M09), finish reasons (M13),
divergence of two runs (M15), faults killed in order (M16), agreement of variants (V05), flags of reasoning tags (P12), blind
packs with placeholders (H02), decisions of one reviewer (H08), a manifest by file (S11)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import scoring as m
from ..registry import operator, table
from ..sources import readers
from . import sql as s
from .review import CASES, cases
from .scoring import _ARGMAX, _OPTIONS, options

_SKEWED = "SELECT vec_id, gold, CASE WHEN vec_id % 4 <> 0 THEN list_prepend(9.0, scores[2:4]) ELSE scores END AS scores FROM (" + _OPTIONS + ")"


@operator(
    "m05_position_flag",
    f"""WITH c AS (SELECT {_ARGMAX} AS p, gold AS g FROM ({_SKEWED})), r AS (SELECT k, (SELECT count(*) FROM c WHERE p = k) / (SELECT count(*) FROM c) AS predicted, (SELECT count(*) FROM c WHERE g = k) / (SELECT count(*) FROM c) AS gold FROM (SELECT unnest(range(4)) AS k))
    SELECT round(max(predicted), 6) AS most_predicted, round(max(gold), 6) AS most_gold, max(predicted) > 0.6 AND max(predicted) > 1.5 * max(gold) AS biased FROM r""",
)
def m05_flag(spark, d):
    """Whether one place is predicted in more than 0.6 of the rows and 1.5 times as often as the commonest gold one, of
    options whose first one is made the best in three rows of four."""
    skewed = F.when(F.col("vec_id") % 4 != 0, F.concat(F.array(F.lit(9.0)), F.slice("scores", 2, 3))).otherwise(F.col("scores"))
    c = options(spark, d).select(m.argmax(skewed).alias("p"), F.col("gold").alias("g"))
    long = c.select(F.explode(F.array(F.struct(F.col("p").alias("k"), F.lit(1).alias("p"), F.lit(0).alias("g")), F.struct(F.col("g").alias("k"), F.lit(0).alias("p"), F.lit(1).alias("g")))).alias("x"))
    by = long.groupBy("x.k").agg(F.sum("x.p").alias("p"), F.sum("x.g").alias("g"))
    whole = by.agg(F.max("p").alias("p"), F.max("g").alias("g"), F.sum("p").alias("n"))
    p, g = F.col("p") / F.col("n"), F.col("g") / F.col("n")
    return whole.select(F.round(p, 6).alias("most_predicted"), F.round(g, 6).alias("most_gold"), ((p > 0.6) & (p > 1.5 * g)).alias("biased"))


_VALID = "(vec_id + i) % 3 <> 0"


@operator(
    "m09_valid_argmax",
    f"""WITH v AS (SELECT vec_id, gold, scores, list_transform(scores, lambda x, i: {_VALID} AND vec_id % 7 <> 0) AS ok FROM ({_OPTIONS})),
    x AS (SELECT vec_id, gold, ok, CASE WHEN vec_id % 5 = 0 THEN gold ELSE list_position(list_transform(scores, lambda x, i: CASE WHEN ok[i] THEN x ELSE -1e300 END), list_max(list_transform(scores, lambda x, i: CASE WHEN ok[i] THEN x ELSE -1e300 END))) - 1 END AS target FROM v WHERE list_contains(ok, true))
    SELECT vec_id, CAST(target AS BIGINT) AS target FROM x WHERE ok[target + 1]""",
)
def m09_valid(spark, d):
    """Target of each row among its valid options: an explicit one (every fifth row), else the best. Rows without a valid
    option, or whose explicit target isn't valid, are dropped."""
    o = options(spark, d)
    valid = F.transform("scores", lambda x, i: ((F.col("vec_id") + i + 1) % 3 != 0) & (F.col("vec_id") % 7 != 0))
    o = o.withColumn("ok", valid)
    masked = F.transform("scores", lambda x, i: F.when(F.get("ok", i), x).otherwise(F.lit(-1e300)))
    target = F.when(F.col("vec_id") % 5 == 0, F.col("gold")).otherwise(m.argmax(masked))
    return o.where(F.array_contains("ok", True)).select("vec_id", target.alias("target"), "ok").where(F.get("ok", F.col("target").cast("int"))).select("vec_id", "target")


@operator(
    "m13_finish_reasons",
    """SELECT event_type, reason, n, round(n / sum(n) OVER (PARTITION BY event_type), 6) AS share, exposed FROM (SELECT event_type, CASE WHEN value >= 90 THEN 'cap' WHEN value < 1 THEN 'exact_loop' ELSE 'eos' END AS reason,
    count(*) AS n, count(*) FILTER (regexp_matches(props, '"k": [0-9]0\\}')) AS exposed FROM events GROUP BY ALL)""",
)
def m13_reasons(spark, d):
    """Events as answers: how they end by type, with shares, and how many expose a tag (a key of two digits that ends in 0)."""
    reason = F.when(F.col("value") >= 90, "cap").when(F.col("value") < 1, "exact_loop").otherwise("eos")
    g = table(spark, d, "events").groupBy("event_type", reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("props").rlike(r'"k": [0-9]0\}'), 1)).alias("exposed"))
    return g.select("event_type", "reason", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("event_type")), 6).alias("share"), "exposed")


_RUNS = f"SELECT item_id, w AS a, CASE WHEN item_id % 3 = 0 THEN w[1:len(w) // 2] || ['changed'] || w[len(w) // 2 + 1:] WHEN item_id % 7 = 0 THEN w[1:5] ELSE w END AS b FROM (SELECT item_id, {s.words('text')} AS w FROM benchmark)"


@operator(
    "m15_divergence",
    f"""SELECT item_id, a = b AS equal, len(a) = len(b) AS equal_length, CASE WHEN a = b THEN NULL ELSE coalesce(list_min(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] <> b[i])) - 1, least(len(a), len(b))) END AS first_difference,
    round(CASE WHEN a = b THEN 0 ELSE 1 - coalesce(list_min(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] <> b[i])) - 1, least(len(a), len(b))) / greatest(len(a), len(b)) END, 6) AS diverged FROM ({_RUNS})""",
)
def m15_divergence(spark, d):
    """Two runs of the same items: equality, where they first differ, and the share of the longer one from there on."""
    w = table(spark, d, "benchmark").select("item_id", t.words("text").alias("a"))
    half, rest = F.floor(F.size("a") / 2).cast("int"), F.size("a")
    changed = F.concat(F.slice("a", F.lit(1), half), F.array(F.lit("changed")), F.slice("a", half + 1, F.greatest(rest - half, F.lit(0))))
    runs = w.withColumn("b", F.when(F.col("item_id") % 3 == 0, changed).when(F.col("item_id") % 7 == 0, F.slice("a", 1, 5)).otherwise(F.col("a")))
    differ = F.array_position(F.transform(F.slice(F.arrays_zip("a", "b"), F.lit(1), F.least(F.size("a"), F.size("b"))), lambda x: x["a"] != x["b"]), True)
    first = F.when(differ > 0, differ - 1).otherwise(F.least(F.size("a"), F.size("b")).cast("long"))
    equal = F.col("a") == F.col("b")
    share = F.when(equal, 0.0).otherwise(1 - first / F.greatest(F.size("a"), F.size("b")))
    return runs.select("item_id", equal.alias("equal"), (F.size("a") == F.size("b")).alias("equal_length"), F.when(~equal, first).alias("first_difference"), F.round(share, 6).alias("diverged"))


_ROWS = "SELECT user_id, event_id // 2 AS name, event_id, value, event_type FROM events"


@operator(
    "m16_killed_in_order",
    f"""WITH r AS (SELECT user_id, list(name ORDER BY event_id) AS names, list(CASE WHEN value > 97 THEN 'failed' ELSE 'passed' END ORDER BY event_id) AS reference,
      list(CASE WHEN value > 80 THEN 'failed' ELSE 'passed' END ORDER BY event_id) AS mutant, list(CASE WHEN user_id % 5 = 0 THEN -name ELSE name END ORDER BY CASE WHEN user_id % 3 = 0 THEN -event_id ELSE event_id END) AS ran,
      count(*) FILTER (value > 80 AND event_type = 'click') AS assertions, count(*) FILTER (value > 80 AND event_type = 'error') AS others FROM ({_ROWS}) GROUP BY user_id)
    SELECT user_id, NOT list_contains(reference, 'failed') AS valid, user_id % 4 <> 0 AND names = ran AND assertions > 0 AND others = 0 AS killed FROM r""",
)
def m16_order(spark, d):
    """A user's events as a suite: valid where the reference passes fully; a mutant is killed where the run ends with 1, the
    tests ran in the reference's order, and an assertion failed but nothing else."""
    e = table(spark, d, "events").withColumn("name", F.floor(F.col("event_id") / 2))
    turned = F.when(F.col("user_id") % 3 == 0, -F.col("event_id")).otherwise(F.col("event_id"))
    other = F.when(F.col("user_id") % 5 == 0, -F.col("name")).otherwise(F.col("name"))
    listed = lambda order, x: F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), x.alias("x")))), lambda r: r["x"])
    count = lambda c: F.count(F.when(c, 1))
    fails = F.col("value") > 80
    g = e.groupBy("user_id").agg(
        listed(F.col("event_id"), F.col("name")).alias("names"), listed(turned, other).alias("ran"), count(F.col("value") > 97).alias("broken"),
        count(fails & (F.col("event_type") == "click")).alias("assertions"), count(fails & (F.col("event_type") == "error")).alias("others"),
    )
    killed = (F.col("user_id") % 4 != 0) & (F.col("names") == F.col("ran")) & (F.col("assertions") > 0) & (F.col("others") == 0)
    return g.select("user_id", (F.col("broken") == 0).alias("valid"), killed.alias("killed"))


_VARIANTS = "SELECT conv_id, turn % 2 AS output, turn // 2 AS input, CASE WHEN conv_id % 4 = 0 THEN 'same' WHEN conv_id % 4 = 1 THEN 'out' || (turn % 2) ELSE md5(text) END AS base, CASE WHEN conv_id % 3 = 0 THEN 'answer' ELSE md5(text) END AS answer FROM conversations WHERE turn < 4"


@operator(
    "v05_variant_agreement",
    f"""SELECT conv_id, count(*) AS variants, count(DISTINCT base) = 1 AS one_base, max(CASE WHEN output = 0 AND input = 0 THEN answer END) = max(CASE WHEN output = 0 AND input = 1 THEN answer END) AS first_agrees,
    max(CASE WHEN output = 1 AND input = 0 THEN answer END) = max(CASE WHEN output = 1 AND input = 1 THEN answer END) AS second_agrees FROM ({_VARIANTS}) GROUP BY conv_id""",
)
def v05_variants(spark, d):
    """Up to four turns of a conversation as the variants of one row (two inputs by two outputs): whether they share their
    base, and whether each output is the same for both inputs (null where one is missing)."""
    c = table(spark, d, "conversations").where("turn < 4")
    k = F.col("conv_id")
    base = F.when(k % 4 == 0, "same").when(k % 4 == 1, F.concat(F.lit("out"), (F.col("turn") % 2).cast("string"))).otherwise(F.md5("text"))
    v = c.select("conv_id", (F.col("turn") % 2).alias("output"), F.floor(F.col("turn") / 2).alias("input"), base.alias("base"), F.when(k % 3 == 0, "answer").otherwise(F.md5("text")).alias("answer"))
    of = lambda out, given: F.max(F.when((F.col("output") == out) & (F.col("input") == given), F.col("answer")))
    return v.groupBy("conv_id").agg(F.count(F.lit(1)).alias("variants"), (F.count_distinct("base") == 1).alias("one_base"), (of(0, 0) == of(0, 1)).alias("first_agrees"), (of(1, 0) == of(1, 1)).alias("second_agrees"))


_TAGGED = "CASE (conv_id + turn) % 6 WHEN 0 THEN '<think>' || text || '</think>' WHEN 1 THEN '<think>' || text WHEN 2 THEN text || '</think>' WHEN 3 THEN '<think>a</think><think>b</think>' || text ELSE text END"


@operator(
    "p12_reasoning_flags",
    f"""WITH x AS (SELECT conv_id, turn, {_TAGGED} AS x FROM conversations), c AS (SELECT *, (length(x) - length(replace(x, '<think>', ''))) // 7 AS o, (length(x) - length(replace(x, '</think>', ''))) // 8 AS e FROM x)
    SELECT conv_id, turn, o > 0 OR e > 0 AS present, o <> e AS unbalanced, o > 1 AS several FROM c""",
)
def p12_reasoning(spark, d):
    """Reasoning tags of turns, some of which are planted: present, unbalanced, several."""
    n, x = (F.col("conv_id") + F.col("turn")) % 6, F.col("text")
    o, e = F.lit("<think>"), F.lit("</think>")
    made = F.when(n == 0, F.concat(o, x, e)).when(n == 1, F.concat(o, x)).when(n == 2, F.concat(x, e)).when(n == 3, F.concat(F.lit("<think>a</think><think>b</think>"), x)).otherwise(x)
    c = table(spark, d, "conversations").select("conv_id", "turn", made.alias("x"))
    count = lambda tag, size: F.floor((F.length("x") - F.length(F.replace("x", tag, F.lit("")))) / size)
    opens, ends = count(o, 7), count(e, 8)
    return c.select("conv_id", "turn", ((opens > 0) | (ends > 0)).alias("present"), (opens != ends).alias("unbalanced"), (opens > 1).alias("several"))


@operator(
    "h02_blind_texts",
    f"""WITH a AS (SELECT conv_id, arm, substr('XYZ', CAST(row_number() OVER (PARTITION BY conv_id ORDER BY md5(arm || ':' || conv_id), arm) AS INTEGER), 1) AS label FROM {CASES}, (SELECT unnest(['base', 'first', 'second']) AS arm))
    SELECT a.conv_id, label, CASE WHEN c.text IS NULL OR trim(c.text) = '' THEN '[incomplete]' ELSE regexp_replace('<think>' || arm || '</think>' || c.text, '(?s)<think>.*?</think>', '', 'g') END AS shown
    FROM a LEFT JOIN conversations c ON c.conv_id = a.conv_id AND c.turn = CASE arm WHEN 'base' THEN 1 WHEN 'first' THEN 3 ELSE 5 END""",
)
def h02_texts(spark, d):
    """What a reviewer sees under X, Y and Z: the answers without their rationale, a placeholder where there is none."""
    arms = cases(spark, d).select("conv_id", F.explode(F.array(*[F.struct(F.lit(x).alias("arm"), F.lit(k).alias("turn")) for x, k in (("base", 1), ("first", 3), ("second", 5))])).alias("a")).select("conv_id", "a.*")
    i = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.md5(F.concat_ws(":", "arm", F.col("conv_id").cast("string"))), "arm"))
    arms = arms.withColumn("label", F.substring(F.lit("XYZ"), i, F.lit(1)))
    j = arms.join(table(spark, d, "conversations").select("conv_id", "turn", "text"), ["conv_id", "turn"], "left")
    clean = F.regexp_replace(F.concat(F.lit("<think>"), "arm", F.lit("</think>"), "text"), "(?s)<think>.*?</think>", "")
    return j.select("conv_id", "label", F.when(F.col("text").isNull() | (F.trim("text") == ""), "[incomplete]").otherwise(clean).alias("shown"))


_REVIEWS = "SELECT doc_id, 'r1' AS reviewer, doc_id % 5 <> 0 AS submitted, quality FROM labels UNION ALL SELECT doc_id, 'r2', doc_id % 7 = 0, toxic FROM labels"


@operator(
    "h08_one_reviewer",
    f"""WITH n AS (SELECT doc_id, count(*) FILTER (submitted) AS n, max(CASE WHEN submitted THEN quality END) AS q FROM ({_REVIEWS}) GROUP BY doc_id)
    SELECT CASE WHEN n = 0 THEN 'unreviewed' WHEN n > 1 THEN 'several reviewers' WHEN q = 1 THEN 'accept' ELSE 'reject' END AS outcome, count(*) AS n FROM n GROUP BY ALL""",
)
def h08_reviewer(spark, d):
    """Decisions count only where exactly one reviewer has submitted."""
    l = table(spark, d, "labels")
    one = l.select("doc_id", (F.col("doc_id") % 5 != 0).alias("submitted"), "quality")
    two = l.select("doc_id", (F.col("doc_id") % 7 == 0).alias("submitted"), F.col("toxic").alias("quality"))
    n = one.union(two).groupBy("doc_id").agg(F.count(F.when(F.col("submitted"), 1)).alias("k"), F.max(F.when(F.col("submitted"), F.col("quality"))).alias("q"))
    outcome = F.when(F.col("k") == 0, "unreviewed").when(F.col("k") > 1, "several reviewers").when(F.col("q") == 1, "accept").otherwise("reject")
    return n.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@operator(
    "s11_file_manifest",
    "SELECT lang AS part, count(*) AS rows, min(doc_id) AS first_id, max(doc_id) AS last_id, CAST(sum(n_chars) AS BIGINT) AS characters, CAST(sum(('0x' || substr(sha256(text), 1, 8))::BIGINT) AS BIGINT) AS digest FROM documents GROUP BY lang",
)
def s11_files(spark, d):
    """Documents written by language, and what a manifest says of each part: rows, ids, characters and the sum of its texts'
    hashes (32 bits each), which needs no order and no list of them."""
    path = readers.scratch(spark, "parts")
    table(spark, d, "documents").select("doc_id", "text", "n_chars", F.col("lang").alias("part")).write.partitionBy("part").parquet(path)
    back = spark.read.parquet(path)
    digest = F.sum(F.conv(F.substring(F.sha2("text", 256), 1, 8), 16, 10).cast("long"))
    return back.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.sum("n_chars").alias("characters"), digest.alias("digest"))


_KEYS = ("lang", "band", "kind")
_ARMS = "SELECT lang, n_chars // 4000 AS band, CASE WHEN doc_id % 50 = 1 THEN 'other' ELSE 'same' END AS kind FROM documents"


@operator(
    "v13_protocol_keys",
    " UNION ALL ".join(
        f"SELECT '{key}' AS field, config, count(DISTINCT CAST({key} AS VARCHAR)) = 1 AS same, count(DISTINCT CAST({key} AS VARCHAR)) AS n FROM (SELECT lang AS config, lang, CAST(band > 1 AS INTEGER) AS band, kind FROM ({_ARMS})) GROUP BY config"
        for key in _KEYS
    ),
)
def v13_keys(spark, d):
    """Per configuration (here a language) and listed field: whether all rows of all arms agree on it."""
    docs = table(spark, d, "documents")
    kind = F.when(F.col("doc_id") % 50 == 1, "other").otherwise("same")
    rows = docs.select(F.col("lang").alias("config"), "lang", (F.floor(F.col("n_chars") / 4000) > 1).cast("int").alias("band"), kind.alias("kind"))
    long = rows.select("config", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in _KEYS])).alias("x")).select("config", "x.*")
    return long.groupBy("field", "config").agg((F.count_distinct("value") == 1).alias("same"), F.count_distinct("value").alias("n")).select("field", "config", "same", "n")


_PAGES = "SELECT CASE WHEN page_id % 40 = 3 THEN page_id - 1 ELSE page_id END AS id, md5(url) || CASE WHEN page_id % 9 = 0 THEN 'zz' ELSE substr(md5(html), 1, 8) END AS revision, contains(html, 'License') OR page_id % 3 = 0 AS licensed FROM pages"


@operator(
    "v19_metadata_faults",
    f"""WITH p AS ({_PAGES}), i AS (SELECT id FROM p GROUP BY id HAVING count(*) > 1)
    SELECT id, 'duplicate_id' AS fault, count(*) AS n FROM p SEMI JOIN i USING (id) GROUP BY id
    UNION ALL SELECT id, 'revision', count(*) FROM p WHERE NOT regexp_matches(revision, '^[0-9a-f]{{40}}$') GROUP BY id
    UNION ALL SELECT id, 'license', count(*) FROM p WHERE NOT licensed GROUP BY id""",
)
def v19_faults(spark, d):
    """Rows by id: ids that come more than once, revisions that aren't 40 hex digits, licenses that are open."""
    n = F.col("page_id")
    revision = F.concat(F.md5("url"), F.when(n % 9 == 0, "zz").otherwise(F.substring(F.md5("html"), 1, 8)))
    p = table(spark, d, "pages").select(
        F.when(n % 40 == 3, n - 1).otherwise(n).alias("id"), (~revision.rlike("^[0-9a-f]{40}$")).alias("revision"), (~(F.contains("html", F.lit("License")) | (n % 3 == 0))).alias("license")
    )
    g = p.groupBy("id").agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("revision"), 1)).alias("revision"), F.count(F.when(F.col("license"), 1)).alias("license"))
    faults = F.array(*[F.struct(F.lit(k).alias("fault"), c.alias("n")) for k, c in (("duplicate_id", F.when(F.col("rows") > 1, F.col("rows")).otherwise(0)), ("revision", F.col("revision")), ("license", F.col("license")))])
    return g.select("id", F.explode(faults).alias("x")).select("id", "x.*").where("n > 0")
