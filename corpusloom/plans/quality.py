"""Queries of the quality predicates (P) over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import quality as q
from ..operators.graph import checkpointed
from ..registry import operator, table
from . import sql as s

W, L, S = s.words("text"), s.lines("text"), s.sentences("text")


@operator("p01_length_band", f"SELECT doc_id, length({s.blank('text')}) BETWEEN 500 AND 20000 AS keep FROM documents")
def p01(spark, d):
    return table(spark, d, "documents").select("doc_id", q.length_band("text").alias("keep"))


@operator(
    "p02_letter_ratio",
    r"SELECT doc_id, round(r, 6) AS ratio, r >= 0.65 AS keep FROM (SELECT doc_id, length(regexp_replace(text, '[^\p{L}]', '', 'g')) / nullif(length(text), 0) AS r FROM documents)",
)
def p02(spark, d):
    r = q.letter_ratio("text")
    return table(spark, d, "documents").select("doc_id", F.round(r, 6).alias("ratio"), (r >= 0.65).alias("keep"))


@operator(
    "p03_prose_test",
    f"SELECT doc_id, len({W}) >= 120 AND len(list_filter({S}, lambda x: len(string_split(x, ' ')) >= 6)) >= 4 AS prose FROM documents",
)
def p03(spark, d):
    return table(spark, d, "documents").select("doc_id", q.is_prose("text").alias("prose"))


@operator(
    "p04_navigation_heavy",
    f"SELECT doc_id, len(l) >= 15 AND len(list_filter(l, lambda x: len(string_split(x, ' ')) < 6)) > len(l) * 0.6 AS navigation FROM (SELECT doc_id, {L} AS l FROM documents)",
)
def p04(spark, d):
    docs = table(spark, d, "documents").select("doc_id", t.lines("text").alias("l"))
    return docs.select("doc_id", q.navigation_heavy(F.col("l")).alias("navigation"))


@operator(
    "p05_repeated_lines_ratio",
    f"SELECT doc_id, round(coalesce(1 - len(list_distinct(l)) / nullif(len(l), 0), 0), 6) AS ratio FROM (SELECT doc_id, {L} AS l FROM documents)",
)
def p05(spark, d):
    docs = table(spark, d, "documents").select("doc_id", t.lines("text").alias("l"))
    return docs.select("doc_id", F.round(q.repeated_lines(F.col("l")), 6).alias("ratio"))


@operator(
    "p06_repeated_answer_line",
    f"""SELECT doc_id, CAST(max(n) AS BIGINT) AS most FROM (SELECT doc_id, l, count(*) AS n FROM (SELECT doc_id, unnest({L}) AS l FROM documents)
    WHERE length(l) >= 20 GROUP BY ALL) GROUP BY doc_id HAVING max(n) >= 3""",
)
def p06(spark, d):
    line = table(spark, d, "documents").select("doc_id", F.explode(t.lines("text")).alias("l")).where(F.length("l") >= 20)
    counts = line.groupBy("doc_id", "l").count()
    return counts.groupBy("doc_id").agg(F.max("count").alias("most")).where("most >= 3")


@operator(
    "p07_repeated_ngram",
    f"""SELECT doc_id, CAST(max(n) AS BIGINT) AS most FROM (SELECT doc_id, g, count(*) AS n FROM
    (SELECT doc_id, unnest({s.ngram_list('w', 8)}) AS g FROM (SELECT doc_id, {W} AS w FROM documents)) GROUP BY ALL) GROUP BY doc_id HAVING max(n) >= 5""",
)
def p07(spark, d):
    """A document's grams are counted in its own row, so only two numbers of it are shuffled; those of ids that several rows
    have are counted by gram."""
    docs = table(spark, d, "documents").select("doc_id", t.words("text").alias("w"))
    rows = docs.select("doc_id", q.most_repeated(t.gram_hashes(F.col("w"), 8)).alias("most"))
    found = checkpointed(rows.groupBy("doc_id").agg(F.max("most").alias("most"), F.count(F.lit(1)).alias("n")).where("n > 1 or most >= 5"))
    one = found.where("n = 1").select("doc_id", "most")
    several = found.where("n > 1").select(F.col("doc_id").alias("id"))
    if several.isEmpty():
        return one
    again = table(spark, d, "documents").join(several, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    grams = again.select("doc_id", t.words("text").alias("w")).select("doc_id", F.explode_outer(t.gram_hashes(F.col("w"), 8)).alias("g")).where("g is not null")
    counts = grams.groupBy("doc_id", "g").count()
    return one.union(counts.groupBy("doc_id").agg(F.max("count").alias("most")).where("most >= 5"))


@operator(
    "p08_lexicon_spam_screen",
    f"""SELECT page_id, contains(h, 'ads') AS bad_host, len(regexp_extract_all(x, 'track|page|offer')) >= 2 AS commercial
    FROM (SELECT page_id, {s.host('url')} AS h, lower(url || ' ' || html) AS x FROM pages)""",
)
def p08(spark, d):
    x = F.lower(F.concat("url", F.lit(" "), "html"))
    return table(spark, d, "pages").select(
        "page_id",
        F.contains(t.host("url"), F.lit("ads")).alias("bad_host"),
        (F.size(F.regexp_extract_all(x, F.lit("track|page|offer"), F.lit(0))) >= 2).alias("commercial"),
    )


@operator("p09_language_gate", "SELECT doc_id, coalesce(lang = 'en' AND n_chars / 1000.0 >= 0.9, FALSE) AS keep FROM documents")
def p09(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", F.coalesce((F.col("lang") == "en") & (F.col("n_chars") / 1000.0 >= 0.9), F.lit(False)).alias("keep")
    )


@operator(
    "p10_host_extract_and_block",
    f"SELECT page_id, h AS host, ends_with(h, 'example.org') OR ends_with(h, '.example.com') AS blocked FROM (SELECT page_id, {s.host('url')} AS h FROM pages)",
)
def p10(spark, d):
    h = t.host("url")
    return table(spark, d, "pages").select("page_id", h.alias("host"), (h.endswith("example.org") | h.endswith(".example.com")).alias("blocked"))


CASCADE_SQL = f"""CASE WHEN NOT coalesce(length({s.blank('text')}) BETWEEN 500 AND 20000, FALSE) THEN 'length'
  WHEN NOT coalesce(length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) / nullif(length(text), 0) >= 0.65, FALSE) THEN 'letters'
  WHEN NOT (len({W}) >= 120 AND len(list_filter({S}, lambda x: len(string_split(x, ' ')) >= 6)) >= 4) THEN 'prose'
  WHEN len(l) >= 15 AND len(list_filter(l, lambda x: len(string_split(x, ' ')) < 6)) > len(l) * 0.6 THEN 'navigation'
  WHEN coalesce(1 - len(list_distinct(l)) / nullif(len(l), 0), 0) > 0.2 THEN 'repeats' ELSE 'kept' END"""


def with_lines(docs):
    """docs with their lines in ``l``, which several rules read: a column of its own, found once."""
    return docs.withColumn("l", t.lines("text"))


def cascade_rules():
    """Rules over text and ``l``."""
    return [
        ("length", ~F.coalesce(q.length_band("text"), F.lit(False))),
        ("letters", ~F.coalesce(q.letter_ratio("text") >= 0.65, F.lit(False))),
        ("prose", ~q.is_prose("text")),
        ("navigation", q.navigation_heavy(F.col("l"))),
        ("repeats", q.repeated_lines(F.col("l")) > 0.2),
    ]


@operator(
    "p11_first_match_reason_cascade",
    f"SELECT lang, reason, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM (SELECT lang, n_chars, {CASCADE_SQL} AS reason FROM (SELECT *, {L} AS l FROM documents)) GROUP BY ALL",
)
def p11(spark, d):
    docs = q.cascade(with_lines(table(spark, d, "documents").select("lang", "n_chars", "text")), cascade_rules())
    return docs.groupBy("lang", "reason").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@operator(
    "p12_multi_flag_tagging",
    """SELECT flag, count(*) AS n FROM (SELECT unnest(list_filter([
      CASE WHEN trim(text) = '' THEN 'empty' END, CASE WHEN contains(text, '�') THEN 'replacement' END,
      CASE WHEN role = 'user' AND turn > 2 THEN 'later_user' END, CASE WHEN length(text) > 400 THEN 'long' END,
      CASE WHEN contains(text, '?') THEN 'question' END], lambda x: x IS NOT NULL)) AS flag FROM conversations) GROUP BY flag""",
)
def p12(spark, d):
    found = q.flags(
        ("empty", F.trim("text") == ""),
        ("replacement", F.contains("text", F.lit("�"))),
        ("later_user", (F.col("role") == "user") & (F.col("turn") > 2)),
        ("long", F.length("text") > 400),
        ("question", F.contains("text", F.lit("?"))),
    )
    return table(spark, d, "conversations").select(F.explode(found).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


CUES = {"greet": "the|der|le", "ask": "wh|que", "list": "and|und|et|y"}


@operator(
    "p13_task_cue_tagging",
    "SELECT conv_id, turn, " + ", ".join(f"regexp_matches(x, '(^| )({p})') AS {k}" for k, p in CUES.items()) + f" FROM (SELECT conv_id, turn, {s.norm_words('text')} AS x FROM conversations)",
)
def p13(spark, d):
    x = t.norm_words("text")
    return table(spark, d, "conversations").select("conv_id", "turn", *[x.rlike(f"(^| )({p})").alias(k) for k, p in CUES.items()])


@operator(
    "p14_style_flags",
    r"""SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS chars, CAST(len(string_split(trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g')), ' ')) AS BIGINT) AS words,
    CAST(len(string_split(text, chr(10))) AS BIGINT) AS lines, regexp_matches(text, '(?i)^(the|of|in|der|la)( |$)') AS opener, regexp_matches(text, '(?i)(thank|that)') AS thanks FROM conversations""",
)
def p14(spark, d):
    return table(spark, d, "conversations").select(
        "conv_id", "turn",
        F.length("text").cast("long").alias("chars"),
        F.size(F.split(t.blank("text"), " ")).cast("long").alias("words"),
        F.size(F.split("text", "\n")).cast("long").alias("lines"),
        F.col("text").rlike("(?i)^(the|of|in|der|la)( |$)").alias("opener"),
        F.col("text").rlike("(?i)(thank|that)").alias("thanks"),
    )


FORMATS = {"heading": r"(?m)^#{1,6} ", "list": r"(?m)^[ ]*[-*+] ", "fence": "```", "table": r"(?m)\|.*\|", "question": r"\?", "emphasis": r"\*\*|%%%|!!"}


@operator("p15_format_indicators", "SELECT doc_id, " + ", ".join(f"regexp_matches(text, '{p}') AS {k}" for k, p in FORMATS.items()) + " FROM documents")
def p15(spark, d):
    return table(spark, d, "documents").select("doc_id", *[F.col("text").rlike(p).alias(k) for k, p in FORMATS.items()])


@operator(
    "p16_structure_vector",
    f"""SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\\n\\s*\\n'), lambda x: trim(x) <> '')) AS BIGINT) AS paragraphs,
    CAST(len(list_filter({L}, lambda x: regexp_matches(x, '^[-*+] '))) AS BIGINT) AS bullets,
    CAST(len(list_filter({L}, lambda x: regexp_matches(x, '^[0-9]+[.)] '))) AS BIGINT) AS numbered,
    CAST(len(list_filter({L}, lambda x: contains(x, '|'))) AS BIGINT) AS table_rows,
    CAST(len(list_filter({L}, lambda x: starts_with(x, '#'))) AS BIGINT) AS headings FROM documents""",
)
def p16(spark, d):
    l = t.lines("text")
    count = lambda p: F.size(F.filter(l, p)).cast("long")
    return table(spark, d, "documents").select(
        "doc_id",
        F.size(F.filter(F.split("text", r"\n\s*\n"), lambda x: F.trim(x) != "")).cast("long").alias("paragraphs"),
        count(lambda x: x.rlike("^[-*+] ")).alias("bullets"),
        count(lambda x: x.rlike("^[0-9]+[.)] ")).alias("numbered"),
        count(lambda x: F.contains(x, F.lit("|"))).alias("table_rows"),
        count(lambda x: x.startswith("#")).alias("headings"),
    )


# fixed values: frequent short words of each language
STOPWORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "it", "for", "with"],
    "de": ["der", "die", "und", "in", "den", "das", "mit", "ist", "von", "zu"],
}


@operator(
    "p17_stopword_language_score",
    f"""SELECT doc_id, lang, {", ".join(f"round(len(list_filter(w, lambda x: list_contains({v}, x))) / nullif(len(w), 0), 6) AS {k}_score" for k, v in STOPWORDS.items())}
    FROM (SELECT doc_id, lang, {W} AS w FROM documents)""",
)
def p17(spark, d):
    w = t.words("text")

    def share(listed):
        return F.round(F.size(F.filter(w, lambda x: x.isin(listed))) / F.nullif(F.size(w), F.lit(0)), 6)

    return table(spark, d, "documents").select("doc_id", "lang", *[share(v).alias(f"{k}_score") for k, v in STOPWORDS.items()])


_TAGGED = "'<think>' || substr(text, 1, 20) || CASE WHEN turn % 3 = 0 THEN '' ELSE '</think>' END || substr(text, 21)"


@operator(
    "p18_reasoning_split",
    f"""SELECT conv_id, turn, contains(x, '</think>') AS closed,
    CASE WHEN contains(x, '</think>') THEN regexp_extract(x, '(?s)^<think>(.*?)</think>', 1) END AS reasoning,
    CASE WHEN contains(x, '</think>') THEN trim(regexp_replace(x, '(?s)^.*?</think>', '')) END AS final
    FROM (SELECT conv_id, turn, {_TAGGED} AS x FROM conversations)""",
)
def p18(spark, d):
    x = F.concat(
        F.lit("<think>"), F.substring("text", 1, 20), F.when(F.col("turn") % 3 == 0, "").otherwise("</think>"), F.expr("substring(text, 21)")
    )
    closed = F.contains(x, F.lit("</think>"))
    return table(spark, d, "conversations").select(
        "conv_id", "turn", closed.alias("closed"),
        F.when(closed, F.regexp_extract(x, "(?s)^<think>(.*?)</think>", 1)).alias("reasoning"),
        F.when(closed, F.trim(F.regexp_replace(x, "(?s)^.*?</think>", ""))).alias("final"),
    )


def _tail_sql(w: int) -> str:
    return "(len(w) >= %d AND " % (4 * w) + " AND ".join(f"w[len(w) - {w * k - 1}:len(w) - {w * (k - 1)}] = w[len(w) - {w - 1}:len(w)]" for k in (2, 3, 4)) + ")"


@operator("p19_exact_loop_guard", f"SELECT doc_id, {' OR '.join(map(_tail_sql, (1, 2, 4, 8)))} AS loops FROM (SELECT doc_id, {W} AS w FROM documents)")
def p19(spark, d):
    docs = table(spark, d, "documents").select("doc_id", t.words("text").alias("w"))
    return docs.select("doc_id", q.repeated_tail(F.col("w")).alias("loops"))


@operator(
    "p20_excluded_by_id_list",
    "SELECT d.doc_id, d.lang FROM documents d ANTI JOIN (SELECT doc_id FROM labels WHERE toxic = 1) l ON d.doc_id = l.doc_id",
)
def p20(spark, d):
    excluded = table(spark, d, "labels").where("toxic = 1").select("doc_id")
    return table(spark, d, "documents").join(excluded, "doc_id", "left_anti").select("doc_id", "lang")
