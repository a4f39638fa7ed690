"""Queries of the scalar functions (N)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators.graph import tune
from ..registry import operator, table
from . import sql as s

W = s.words("text")


def _docs(spark, d):
    return table(spark, d, "documents")


def _batched(spark, d):
    """The documents, for functions that run in Python: what a worker holds at once is bounded in rows and bytes."""
    tune(spark)
    return _docs(spark, d)


@operator("n01_norm_nfc_ws", f"SELECT doc_id, sha256({s.blank('text')}) AS h FROM documents")
def n01(spark, d):
    return _batched(spark, d).select("doc_id", F.sha2(t.blank(t.nfc("text")), 256).alias("h"))


@operator("n02_norm_nfc_casefold_ws", f"SELECT doc_id, sha256({s.blank(s.fold('text'))}) AS h FROM documents")
def n02(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2(t.norm_ws_fold("text"), 256).alias("h"))


@operator("n03_norm_nfkc_casefold_ws", f"SELECT doc_id, sha256({s.blank(s.fold('text'))}) AS h FROM documents")
def n03(spark, d):
    return _batched(spark, d).select("doc_id", F.sha2(t.nfkc_casefold("text"), 256).alias("h"))


@operator("n04_norm_words", f"SELECT doc_id, sha256({s.norm_words('text')}) AS h, CAST(len({W}) AS BIGINT) AS n FROM documents")
def n04(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2(t.norm_words("text"), 256).alias("h"), F.size(t.words("text")).cast("long").alias("n"))


@operator("n05_norm_turkish", f"SELECT doc_id, sha256({s.blank('''lower(translate(text, 'Iİ', 'ıi'))''')}) AS h FROM documents")
def n05(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2(t.norm_turkish("text"), 256).alias("h"))




def _no_article(x: str) -> str:
    edge = r"[^\p{L}\p{N}_]"
    return f"regexp_replace({x}, '({edge})(a|an|the)({edge})', '\\1 \\3', 'g')"


def answer_sql(x: str) -> str:
    """A text as answers are compared; neighbours share an edge, hence articles go twice."""
    padded = f"' ' || lower({x}) || ' '"
    return s.blank(f"regexp_replace({_no_article(_no_article(padded))}, '[!-/:-@\\[-`{{-~]', '', 'g')")


_ANSWER = answer_sql("text")


@operator("n06_norm_squad", f"SELECT item_id, {_ANSWER} AS x FROM benchmark")
def n06(spark, d):
    return table(spark, d, "benchmark").select("item_id", t.norm_answer("text").alias("x"))


_MASKED = s.blank(r"regexp_replace(regexp_replace(lower(text), '[0-9]+', '<num>', 'g'), '[^\p{L}\p{N}_<>]+', ' ', 'g')")


@operator("n07_norm_numbers_masked", f"SELECT doc_id, sha256({_MASKED}) AS h FROM documents")
def n07(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2(t.norm_numbers("text"), 256).alias("h"))


@operator("n08_template_fingerprint", f"SELECT f, count(*) AS n FROM (SELECT array_to_string(string_split({_MASKED}, ' ')[1:8], ' ') AS f FROM documents) GROUP BY f")
def n08(spark, d):
    return _docs(spark, d).select(t.fingerprint("text").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n"))


@operator("n09_strip_instruction_wrapper", r"SELECT doc_id, sha256(regexp_replace(text, '^(?:The|Of|And|Und|De)\s*', '')) AS h FROM documents")
def n09(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2(t.strip_wrapper("text", "The|Of|And|Und|De"), 256).alias("h"))


@operator(
    "n10_word_ngrams",
    f"SELECT doc_id, CAST(len({s.ngrams('w', 3)}) AS BIGINT) AS g3, CAST(len({s.ngrams('w', 8)}) AS BIGINT) AS g8 FROM (SELECT doc_id, {W} AS w FROM documents)",
)
def n10(spark, d):
    docs = _docs(spark, d).select("doc_id", t.words("text").alias("w"))
    return docs.select("doc_id", *[F.size(t.ngrams(F.col("w"), n)).cast("long").alias(f"g{n}") for n in (3, 8)])


_NUMBERS = "list_filter(list_transform(regexp_extract_all(text, '[0-9][0-9.,]*'), lambda x: regexp_replace(x, '[.,]', '', 'g')), lambda x: length(x) >= 2)"


@operator("n11_nontrivial_numbers", f"SELECT doc_id, array_to_string({_NUMBERS}, ' ') AS numbers FROM documents")
def n11(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(t.numbers("text"), " ").alias("numbers"))


@operator(
    "n12_locale_number_multiset",
    """SELECT v, count(*) AS n FROM (SELECT CAST(replace(replace(x, '.', ''), ',', '.') AS DECIMAL(38, 4)) AS v FROM (
    SELECT unnest(regexp_extract_all(replace(CAST(round(o_totalprice, 2) AS VARCHAR), '.', ','), '[0-9]+,[0-9]+')) AS x FROM orders)) GROUP BY v""",
)
def n12(spark, d):
    written = F.replace(F.round("o_totalprice", 2).cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(","))
    found = table(spark, d, "orders").select(F.explode(F.regexp_extract_all(written, F.lit("[0-9]+,[0-9]+"), F.lit(0))).alias("x"))
    v = F.translate("x", ",", ".").cast("decimal(38,4)")
    return found.select(v.alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))


@operator(
    "n13_capitalized_entities",
    r"SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '[a-z,] ([A-Z][a-z]{3,})', 1), lambda x: lower(x)))), ' ') AS entities FROM documents",
)
def n13(spark, d):
    found = F.regexp_extract_all("text", F.lit("[a-z,] ([A-Z][a-z]{3,})"), F.lit(1))
    return _docs(spark, d).select("doc_id", F.array_join(F.array_sort(F.array_distinct(F.transform(found, F.lower))), " ").alias("entities"))


@operator(
    "n14_terminal_numeric_parse",
    "SELECT doc_id, TRY_CAST(replace(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)?')[-1], ',', '.') AS DOUBLE) AS value FROM documents",
)
def n14(spark, d):
    found = F.regexp_extract_all("text", F.lit("[0-9]+(?:[.,][0-9]+)?"), F.lit(0))
    return _docs(spark, d).select("doc_id", F.translate(F.try_element_at(found, F.lit(-1)), ",", ".").try_cast("double").alias("value"))


_RAW_SQL = """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '<think>FINAL: ' || chr(CAST(65 + doc_id % 4 AS INTEGER)) || '</think>' || text WHEN 3 THEN '<think>FINAL: A</think>' || text || ' FINAL: ' || chr(CAST(65 + doc_id % 4 AS INTEGER)) || '.'
    WHEN 4 THEN '</think>' || replace(replace(replace(text, 'A', 'a'), 'C', 'c'), 'D', 'd') || ' B' ELSE text END AS raw FROM documents"""


@operator(
    "n15_choice_extract",
    f"""SELECT doc_id, CASE WHEN len(f) > 0 THEN f[-1] WHEN len(r) > 0 THEN r[-1] WHEN len(l) = 1 THEN l[1] END AS choice,
    CASE WHEN len(f) > 0 THEN 'final' WHEN len(r) > 0 THEN 'final_raw' WHEN len(l) = 1 THEN 'letter' ELSE 'failed' END AS method
    FROM (SELECT doc_id, regexp_extract_all(answer, 'FINAL: ([A-D])', 1) AS f, regexp_extract_all(raw, 'FINAL: ([A-D])', 1) AS r,
    list_filter(regexp_split_to_array(answer, '[^A-Za-z0-9_]+'), lambda x: x IN ('A', 'B', 'C', 'D')) AS l
    FROM (SELECT doc_id, raw, CASE WHEN contains(raw, '</think>') THEN substr(raw, strpos(raw, '</think>') + 8) ELSE raw END AS answer FROM ({_RAW_SQL})))""",
)
def n15(spark, d):
    """The last FINAL of the answer, or else of the whole output, or else the only letter that stands alone.
    Whole texts stand for answers, some with a choice after them or in the reasoning before them."""
    n, text = F.col("doc_id"), F.col("text")
    letter = F.char(F.lit(65) + n % 4)
    raw = (
        F.when(n % 6 == 0, F.concat(F.lit("<think>FINAL: "), letter, F.lit("</think>"), text))
        .when(n % 6 == 3, F.concat(F.lit("<think>FINAL: A</think>"), text, F.lit(" FINAL: "), letter, F.lit(".")))
        .when(n % 6 == 4, F.concat(F.lit("</think>"), F.translate(text, "ACD", "acd"), F.lit(" B")))
        .otherwise(text)
    )
    place = F.instr("raw", "</think>")
    docs = _docs(spark, d).select("doc_id", raw.alias("raw")).withColumn("answer", F.when(place > 0, F.expr("substring(raw, instr(raw, '</think>') + 8)")).otherwise(F.col("raw")))
    final = lambda x: F.regexp_extract_all(x, F.lit("FINAL: ([A-D])"), F.lit(1))
    found = docs.select(
        "doc_id", final("answer").alias("f"), final("raw").alias("r"),
        F.filter(F.split("answer", "[^A-Za-z0-9_]+"), lambda x: x.isin("A", "B", "C", "D")).alias("l"),
    )
    last = lambda x: F.try_element_at(x, F.lit(-1))
    return found.select(
        "doc_id",
        F.coalesce(last("f"), last("r"), F.when(F.size("l") == 1, last("l"))).alias("choice"),
        F.when(F.size("f") > 0, "final").when(F.size("r") > 0, "final_raw").when(F.size("l") == 1, "letter").otherwise("failed").alias("method"),
    )


def _entities_sql(x: str) -> str:
    for name, sign in t.ENTITIES:
        x = f"replace({x}, '{name}', '{sign.replace(chr(39), chr(39) * 2)}')"
    return x


@operator("n16_html_to_text", f"SELECT page_id, {s.blank(_entities_sql('''regexp_replace(html, '<[^>]*>', ' ', 'g')'''))} AS x FROM pages")
def n16(spark, d):
    return table(spark, d, "pages").select("page_id", t.html_text("html").alias("x"))


@operator("n17_script_form_extract", r"SELECT doc_id, nullif(regexp_extract(text, '^([A-Za-zÀ-ÿ]+)', 1), '') AS form FROM documents")
def n17(spark, d):
    return _docs(spark, d).select("doc_id", F.nullif(F.regexp_extract("text", "^([A-Za-zÀ-ÿ]+)", 1), F.lit("")).alias("form"))


@operator(
    "n18_ordered_unique_variants",
    f"SELECT doc_id, CAST(len(v) AS BIGINT) AS n, array_to_string(list_filter(v, lambda x: x <> ''), '|') AS variants FROM (SELECT doc_id, list_filter(v, lambda x, i: list_position(v, x) = i) AS v FROM (SELECT doc_id, list_transform(string_split(text, '|'), lambda x: {s.blank('x')}) AS v FROM documents))",
)
def n18(spark, d):
    v = F.array_distinct(F.transform(F.split("text", r"\|"), t.blank))
    return _docs(spark, d).select("doc_id", F.size(v).cast("long").alias("n"), F.array_join(F.filter(v, lambda x: x != ""), "|").alias("variants"))


@operator(
    "n19_sentence_split_dup",
    f"SELECT sha256(x) AS h, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest({s.sentences('text')}) AS x FROM documents) WHERE length(x) >= 40 GROUP BY x HAVING count(DISTINCT doc_id) > 1",
)
def n19(spark, d):
    x = _docs(spark, d).select("doc_id", F.explode(t.sentences("text")).alias("x")).where(F.length("x") >= 40)
    g = x.select("doc_id", F.sha2("x", 256).alias("h")).groupBy("h").agg(F.count_distinct("doc_id").alias("docs"))
    return g.where("docs > 1")


@operator(
    "n20_template_regex_repair",
    r"SELECT doc_id, CAST(len(regexp_extract_all(text, '!!+')) AS BIGINT) AS marks, CAST(len(regexp_extract_all(text, '(\w)[%&$#*]{3}')) AS BIGINT) AS noise, sha256(regexp_replace(regexp_replace(text, '!!+', '!', 'g'), '(\w)[%&$#*]{3}', '\1', 'g')) AS h FROM documents",
)
def n20(spark, d):
    fixed = F.regexp_replace(F.regexp_replace("text", "!!+", "!"), r"(\w)[%&$#*]{3}", "$1")
    return _docs(spark, d).select(
        "doc_id", F.regexp_count("text", F.lit("!!+")).cast("long").alias("marks"), F.regexp_count("text", F.lit(r"(\w)[%&$#*]{3}")).cast("long").alias("noise"), F.sha2(fixed, 256).alias("h")
    )


@operator(
    "n21_prompt_parse_render",
    "SELECT conv_id, turn, regexp_extract(x, '(?s)^Source: (.*)\\nQuestion: (.*)$', 1) AS source, 'Q=' || regexp_extract(x, '(?s)^Source: (.*)\\nQuestion: (.*)$', 2) AS rendered FROM (SELECT conv_id, turn, 'Source: ' || role || chr(10) || 'Question: ' || text AS x FROM conversations)",
)
def n21(spark, d):
    x = F.concat(F.lit("Source: "), "role", F.lit("\nQuestion: "), "text")
    p = r"(?s)^Source: (.*)\nQuestion: (.*)$"
    return table(spark, d, "conversations").select(
        "conv_id", "turn", F.regexp_extract(x, p, 1).alias("source"), F.concat(F.lit("Q="), F.regexp_extract(x, p, 2)).alias("rendered")
    )


@operator("n22_canonical_json_hash", """SELECT doc_id, sha256('{"lang":"' || lang || '","n_chars":' || n_chars || ',"source":"' || source || '"}') AS h FROM documents""")
def n22(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2(F.to_json(F.struct("lang", "n_chars", "source")), 256).alias("h"))


@operator("n23_stable_identity", "SELECT doc_id, sha256(concat_ws('/', source, lang, doc_id)) AS identity FROM documents")
def n23(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")), 256).alias("identity"))


@operator("n24_path_normalize", r"SELECT page_id, regexp_replace(regexp_replace(replace(lower(regexp_extract(url, '://[^/]*(/[^?#]*)', 1)) || '\x/./y', '\', '/'), '/\./', '/', 'g'), '//+', '/', 'g') AS path FROM pages")
def n24(spark, d):
    p = F.concat(F.lower(F.regexp_extract("url", "://[^/]*(/[^?#]*)", 1)), F.lit("\\x/./y"))
    fixed = F.regexp_replace(F.regexp_replace(F.replace(p, F.lit("\\"), F.lit("/")), r"/\./", "/"), "//+", "/")
    return table(spark, d, "pages").select("page_id", fixed.alias("path"))


@operator(
    "n25_patch_path_parse",
    r"SELECT suffix, count(*) AS n FROM (SELECT regexp_extract(l, '\.([a-z]+)$', 1) AS suffix FROM (SELECT unnest(string_split('+++ b/' || source || '/' || lang || '.txt' || chr(10) || '+++ b/x.' || lang, chr(10))) AS l FROM documents) WHERE starts_with(l, '+++ b/')) GROUP BY suffix",
)
def n25(spark, d):
    patch = F.concat(F.lit("+++ b/"), "source", F.lit("/"), "lang", F.lit(".txt\n+++ b/x."), "lang")
    l = _docs(spark, d).select(F.explode(F.split(patch, "\n")).alias("l")).where(F.startswith("l", F.lit("+++ b/")))
    return l.select(F.regexp_extract("l", r"\.([a-z]+)$", 1).alias("suffix")).groupBy("suffix").agg(F.count(F.lit(1)).alias("n"))


@operator(
    "n26_clock_arithmetic",
    "SELECT event_id, lpad(CAST(m // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(m % 60 AS VARCHAR), 2, '0') AS clock FROM (SELECT event_id, (hour(ts) * 60 + minute(ts) + user_id * 7) % 1440 AS m FROM events)",
)
def n26(spark, d):
    m = F.pmod(F.hour("ts") * 60 + F.minute("ts") + F.col("user_id") * 7, F.lit(1440))
    return table(spark, d, "events").select("event_id", F.format_string("%02d:%02d", F.floor(m / 60), F.pmod(m, F.lit(60))).alias("clock"))


@operator(
    "n27_exact_rational_checks",
    "SELECT o_orderkey, CAST(count(*) AS BIGINT) AS lines, CAST(sum(CAST(l_quantity AS BIGINT) * l_linenumber) AS BIGINT) AS numerator, sum(CAST(l_quantity AS BIGINT) * l_linenumber) * 2 >= count(*) * 100 AS above FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey",
)
def n27(spark, d):
    """Fractions are compared by cross multiplication of whole numbers."""
    x = F.sum(F.col("l_quantity").cast("long") * F.col("l_linenumber"))
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"))
    lines = g.agg(F.count(F.lit(1)).alias("lines"), x.alias("numerator"))
    return table(spark, d, "orders").select("o_orderkey").join(lines, "o_orderkey").withColumn("above", F.col("numerator") * 2 >= F.col("lines") * 100)


@operator(
    "n28_conversation_views",
    """SELECT conv_id, CAST(len(list_distinct(list_append(v, array_to_string(v, chr(10))))) AS BIGINT) AS views, sha256(array_to_string(v, chr(10))) AS transcript
    FROM (SELECT conv_id, list(text ORDER BY turn) AS v FROM conversations GROUP BY conv_id)""",
)
def n28(spark, d):
    v = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    g = table(spark, d, "conversations").groupBy("conv_id").agg(v.alias("v"))
    whole = F.array_join("v", "\n")
    return g.select("conv_id", F.size(F.array_distinct(F.array_append("v", whole))).cast("long").alias("views"), F.sha2(whole, 256).alias("transcript"))


@operator("n29_role_sequence_signature", "SELECT r, count(*) AS n FROM (SELECT string_agg(role, ',' ORDER BY turn) AS r FROM conversations GROUP BY conv_id) GROUP BY r")
def n29(spark, d):
    r = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ",")
    return table(spark, d, "conversations").groupBy("conv_id").agg(r.alias("r")).groupBy("r").agg(F.count(F.lit(1)).alias("n"))
