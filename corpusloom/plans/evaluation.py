"""Queries of scoring in full (M02, M03, M08), of label masks (V10) and meta text (V17), of numbered lines (S04). Predictions and masks are derived from the tables by
fixed rules, faults and wrong answers among them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions import text as t
from ..operators import answers as an
from ..operators import graph as gr
from ..operators import meta_text
from ..operators import scoring as m
from ..operators.masks import IGNORE, label_faults
from ..registry import operator, table
from ..sources import lines as numbered
from ..sources import readers
from . import sql as s
from .scalars import answer_sql
from .scoring import _GP, options

_W = s.words("text")
_QA = f"""SELECT item_id, CASE WHEN item_id % 5 = 0 THEN []::VARCHAR[] ELSE [array_to_string(w[1:4], ' '), '(' || array_to_string(w[2:6], ' ') || ').', 'the ' || array_to_string(w[1:2], ' ')] END AS golds,
    CASE item_id % 6 WHEN 0 THEN array_to_string(w[2:6], ' ') WHEN 1 THEN 'The ' || array_to_string(w[1:4], ' ') || '!' WHEN 2 THEN '' WHEN 3 THEN 'Unanswerable.' WHEN 4 THEN array_to_string(w[1:6], '  ') ELSE 'no match at all' END AS predicted
    FROM (SELECT item_id, {_W} AS w FROM benchmark)"""
_SQUAD = f"""WITH q AS ({_QA}), r AS (SELECT item_id, golds, {answer_sql('predicted')} AS said FROM q),
    e AS (SELECT item_id, said, i, {answer_sql('gold')} AS gold FROM (SELECT item_id, said, unnest(golds) AS gold, unnest(range(len(golds))) AS i FROM r)),
    v AS (SELECT *, list_filter(string_split(said, ' '), lambda x: x <> '') AS a, list_filter(string_split(gold, ' '), lambda x: x <> '') AS b FROM e),
    ca AS (SELECT item_id, i, x, count(*) AS n FROM (SELECT item_id, i, unnest(a) AS x FROM v) GROUP BY ALL), cb AS (SELECT item_id, i, x, count(*) AS n FROM (SELECT item_id, i, unnest(b) AS x FROM v) GROUP BY ALL),
    o AS (SELECT item_id, i, sum(least(ca.n, cb.n)) AS m FROM ca JOIN cb USING (item_id, i, x) GROUP BY ALL),
    f AS (SELECT v.item_id, CAST(said = gold AS INTEGER) AS em, CASE WHEN len(a) = 0 OR len(b) = 0 THEN CAST(len(a) = len(b) AS INTEGER) ELSE 2.0 * coalesce(m, 0) / (len(a) + len(b)) END AS f FROM v LEFT JOIN o USING (item_id, i)),
    g AS (SELECT item_id, max(em) AS em, max(CAST(f AS DOUBLE)) AS f FROM f GROUP BY item_id),
    h AS (SELECT r.item_id, len(golds) > 0 AS answerable, said = '' OR said IN ('cevaplanamaz', 'unanswerable') AS refused, em, f FROM r LEFT JOIN g USING (item_id)),
    k AS (SELECT item_id, answerable, refused, coalesce(em, CAST(refused AS INTEGER)) AS exact, coalesce(f, CAST(refused AS DOUBLE)) AS f1 FROM h),
    scores AS (SELECT *, CAST(answerable <> refused AS INTEGER) AS answerability_correct, CAST(exact = 0 AND f1 >= 0.5 AS INTEGER) AS low_exact_high_f1 FROM k)"""


def squad(spark, d):
    w = lambda a, b, sep=" ": F.array_join(F.slice("w", a, b), sep)
    b, n = table(spark, d, "benchmark").select("item_id", t.words("text").alias("w")), F.col("item_id") % 6
    golds = F.array(w(1, 4), F.concat(F.lit("("), w(2, 5), F.lit(").")), F.concat(F.lit("the "), w(1, 2)))
    predicted = F.when(n == 0, w(2, 5)).when(n == 1, F.concat(F.lit("The "), w(1, 4), F.lit("!"))).when(n == 2, "").when(n == 3, "Unanswerable.").when(n == 4, w(1, 6, "  ")).otherwise("no match at all")
    made = b.select("item_id", F.when(F.col("item_id") % 5 == 0, F.array().cast("array<string>")).otherwise(golds).alias("golds"), predicted.alias("predicted"))
    return an.squad_scores(made, "item_id", "golds", "predicted")


@operator("m02_squad_scores", f"{_SQUAD} SELECT item_id, answerable, refused, exact, round(f1, 6) AS f1, answerability_correct, low_exact_high_f1 FROM scores")
def m02_scores(spark, d):
    """Exact match and F1 against the best of several golds; items without golds want a refusal."""
    return squad(spark, d).withColumn("f1", F.round("f1", 6))


@operator(
    "m02_squad_summary",
    f"""{_SQUAD} SELECT count(*) AS n, count(*) FILTER (answerable) AS n_answerable, round(avg(exact), 6) AS exact, round(avg(f1), 6) AS f1, round(avg(answerability_correct), 6) AS answerability,
    round(avg(exact) FILTER (answerable), 6) AS exact_answerable, round(avg(f1) FILTER (answerable), 6) AS f1_answerable, round(avg(exact) FILTER (NOT answerable), 6) AS exact_unanswerable,
    round(avg(low_exact_high_f1), 6) AS low_exact_high_f1 FROM scores""",
)
def m02_summary(spark, d):
    out = an.squad_summary(squad(spark, d))
    return out.select("n", "n_answerable", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


# gold: all words of an item; prediction: without every (2 + item_id % 5)-th word, turned round, or nothing
_TRANSLATED = f"""SELECT item_id, w AS gold, CASE WHEN item_id % 11 = 0 THEN []::VARCHAR[] WHEN item_id % 7 = 0 THEN list_reverse(w) ELSE list_filter(w, lambda x, i: i % (2 + item_id % 5) <> 0) END AS predicted
    FROM (SELECT item_id, {_W} AS w FROM benchmark)"""
_CHARACTERS = "list_transform(range(1, length({x}) - {n} + 2), lambda i: substr({x}, i, {n}))"
_BOTH = " UNION ALL ".join(
    f"SELECT item_id, '{kind}' AS kind, {n} AS n, {side} AS side, unnest({s.ngram_list(words, n) if kind == 'w' else _CHARACTERS.format(x=text, n=n)}) AS g FROM x"
    for kind, top in (("w", 4), ("c", 6)) for n in range(1, top + 1) for side, words, text in ((0, "gold", "gc"), (1, "predicted", "pc"))
)


@operator(
    "m03_sentence_scores",
    f"""WITH x AS (SELECT *, array_to_string(gold, '') AS gc, array_to_string(predicted, '') AS pc FROM ({_TRANSLATED})), g AS ({_BOTH}),
    c AS (SELECT item_id, kind, n, g, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM g GROUP BY ALL),
    o AS (SELECT item_id, kind, n, sum(least(a, b)) AS shared, sum(a) AS r, sum(b) AS h FROM c GROUP BY ALL),
    w AS (SELECT *, sum(CAST(shared = 0 AS INTEGER)) OVER (PARTITION BY item_id ORDER BY n) AS missed FROM o WHERE kind = 'w' AND h > 0),
    b AS (SELECT item_id, CASE WHEN sum(shared) = 0 THEN 0.0 ELSE 100 * exp(avg(ln(CASE WHEN shared > 0 THEN shared / h ELSE 1 / (power(2, missed) * h) END)))
      * CASE WHEN max(h) FILTER (n = 1) < max(r) FILTER (n = 1) THEN exp(1 - max(r) FILTER (n = 1) / max(h) FILTER (n = 1)) ELSE 1 END END AS bleu FROM w GROUP BY item_id),
    p AS (SELECT item_id, avg(shared / h) AS p, avg(shared / r) AS q FROM o WHERE kind = 'c' AND h > 0 AND r > 0 GROUP BY item_id)
    SELECT item_id, round(coalesce(CAST(bleu AS DOUBLE), 0), 5) AS bleu, round(coalesce(CASE WHEN p + q > 0 THEN 500 * p * q / (4 * p + q) ELSE 0 END, 0), 5) AS chrf FROM x LEFT JOIN b USING (item_id) LEFT JOIN p USING (item_id)""",
)
def m03_sentences(spark, d):
    """BLEU (smoothed) and chrF of each item by itself."""
    i, w = F.col("item_id"), t.words("text")
    b = table(spark, d, "benchmark").select("item_id", w.alias("gold"))
    fewer = F.filter("gold", lambda x, k: (k + 1) % (2 + i % 5) != 0)
    made = b.withColumn("predicted", F.when(i % 11 == 0, F.array().cast("array<string>")).when(i % 7 == 0, F.reverse("gold")).otherwise(fewer))
    found = an.sentence_scores(an.gram_matches(made, "item_id", "gold", "predicted"), "item_id")
    return found.select("item_id", F.round("bleu", 5).alias("bleu"), F.round("chrf", 5).alias("chrf"))


@operator(
    "m08_accuracy_macro_f1",
    f"""WITH x AS ({_GP}), l AS (SELECT g AS label FROM x UNION SELECT p FROM x), c AS (SELECT label, (SELECT count(*) FROM x WHERE g = label) AS n, (SELECT count(*) FROM x WHERE p = label) AS m, (SELECT count(*) FROM x WHERE g = label AND p = label) AS tp FROM l)
    SELECT CAST((SELECT count(*) FROM x) AS BIGINT) AS n, CAST(sum(tp) AS BIGINT) AS correct, round(sum(tp) / (SELECT count(*) FROM x), 6) AS accuracy, round(avg(2.0 * tp / (n + m)), 6) AS macro_f1, count(*) AS labels FROM c""",
)
def m08_macro(spark, d):
    """Accuracy, and the mean F1 over all labels that are gold or predicted."""
    gp = options(spark, d).select(F.col("gold").alias("g"), m.argmax(F.col("scores")).alias("p"))
    long = gp.select(F.explode(F.array(F.struct(F.col("g").alias("label"), F.lit(1).alias("n"), F.lit(0).alias("m"), (F.col("g") == F.col("p")).cast("int").alias("tp")), F.struct(F.col("p").alias("label"), F.lit(0).alias("n"), F.lit(1).alias("m"), F.lit(0).alias("tp")))).alias("x")).select("x.*")
    c = long.groupBy("label").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.sum("tp").alias("tp"))
    return c.agg(
        F.sum("n").alias("n"), F.sum("tp").alias("correct"), F.round(F.sum("tp") / F.sum("n"), 6).alias("accuracy"), F.round(F.avg(2.0 * F.col("tp") / (F.col("n") + F.col("m"))), 6).alias("macro_f1"),
        F.count(F.lit(1)).alias("labels"),
    )


#: lines that are planted by the number of the conversation: no table holds texts about the making of data
_PLANTED = (
    "see the references here", "model_revision = 3", "the tokenizer revision is pinned", "```\nimport helper_lib\n```", "a review_helper", "```\n```\nimport helper_lib",
    "the `helper_lib` of the paper", "absent from model input, says the Reviewer", "previews of all",
)
_META_TERMS, _META_ROOTS = meta_text.TERMS + "|helper_lib", "helperlib"
_LETTER = "[A-Za-z]"


@operator(
    "v17_meta_text_verdicts",
    f"""WITH planted AS (SELECT unnest([{", ".join("'" + x.replace(chr(10), "' || chr(10) || '") + "'" for x in _PLANTED)}]) AS x, unnest(range({len(_PLANTED)})) AS k),
    t AS (SELECT conv_id * 1000 + turn AS id, text || chr(10) || x AS text FROM conversations JOIN planted ON k = (conv_id + turn) % {len(_PLANTED)}),
    l AS (SELECT id, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM t),
    f AS (SELECT *, sum(CAST(starts_with(ltrim(l, ' '), '```') AS INTEGER)) OVER (PARTITION BY id ORDER BY line) % 2 = 1 AS fenced FROM l),
    w AS (SELECT *, regexp_extract_all(l, '[A-Za-z_][A-Za-z0-9_]*|`|[^A-Za-z_`]+') AS w FROM f WHERE regexp_matches(l, '(?i){_META_TERMS}')),
    n AS (SELECT *, unnest(w) AS name, unnest(range(len(w))) AS i FROM w),
    h AS (SELECT *, i, len(list_filter(w[1:i], lambda x: x = '`')) % 2 = 1 AS ticks, lower(w[i - 1]) AS before FROM n WHERE regexp_matches(name, '(?i)(^|[^A-Za-z])({_META_TERMS})([^A-Za-z]|$)')),
    r AS (SELECT id, line, name, CASE WHEN name IN ({", ".join(f"'{x}'" for x in meta_text.FIELDS)}) THEN 'field of the contract' WHEN regexp_matches(name, '(?i)^revisions?$') AND before IN ({", ".join(f"'{x}'" for x in meta_text.SOURCES)}) THEN 'provenance of a source or model'
      WHEN lower(replace(name, '_', '')) = '{_META_ROOTS}' AND (fenced OR ticks) THEN 'declared name' END AS reason FROM h)
    SELECT id, line, name AS term, CASE WHEN reason IS NULL THEN 'assess' ELSE 'allowed' END AS status FROM r
    UNION ALL SELECT id, line, unnest(regexp_extract_all(l, '(?i)(?:{meta_text.META})')), 'block' FROM l""",
)
def v17_verdicts(spark, d):
    """Findings in turns with a planted line each: three verdicts, exemptions, fences and quotes."""
    n = F.col("conv_id") + F.col("turn")
    planted = F.get(F.array(*[F.lit(x) for x in _PLANTED]), (n % len(_PLANTED)).cast("int"))
    rows = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat("text", F.lit("\n"), planted).alias("text"), F.array(F.lit(_META_ROOTS)).alias("roots"))
    return meta_text.findings(rows, _META_TERMS).select("id", "line", "term", "status")


@operator(
    "s04_positional_lines",
    """SELECT CAST(3 + 2 * i AS BIGINT) AS line, CAST(p_partkey AS VARCHAR) AS id, p_brand AS brand, CAST(p_size AS VARCHAR) AS size FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part)""",
)
def s04_lines(spark, d):
    """Parts as one tab-separated file with a comment before each row, read strictly and by line number."""
    path = readers.scratch(spark, "lines")
    rows = table(spark, d, "part").select("p_partkey", F.concat(F.lit("# part\n"), F.concat_ws("\t", F.col("p_partkey").cast("string"), "p_brand", F.col("p_size").cast("string"))).alias("value"))
    head = spark.createDataFrame([(None, "# head")], "p_partkey long, value string")
    head.union(rows).repartition(1).sortWithinPartitions("p_partkey").select("value").write.text(path)
    return numbered.read_positional(spark, path, ["id", "brand", "size"], "[0-9]+").drop("file")


_TOKEN = r"<\|[a-z_]+\|>|\p{L}+|[^\p{L}]"
END, LIMIT = 7, 400
#: a turn and its answer as one text; of every eighth pair of its kind one has a planted fault
_TURNS = """SELECT a.conv_id, a.turn, '<|im_start|>user' || chr(10) || a.text || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS prompt, b.text AS answer FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"""
_OVER = "list_filter(spans, lambda s: s.a < s.b AND x.a < s.b AND x.b > s.a)"


@F.pandas_udf(ArrayType(IntegerType()))
def running_sums(lengths: pd.Series) -> pd.Series:
    return lengths.map(lambda x: None if x is None else np.cumsum(x, dtype=np.int32))


@operator(
    "v10_label_mask_faults",
    f"""WITH p AS (SELECT conv_id * 1000 + turn AS id, (conv_id + turn) % 8 AS kind, prompt, answer FROM ({_TURNS})),
    q AS (SELECT *, prompt || answer || '<|im_end|>' || chr(10) AS whole, length(prompt) AS i, length(answer) AS j FROM p),
    r AS (SELECT *, [{{'r': 'prompt', 'a': 0, 'b': i, 's': false}}, {{'r': 'answer', 'a': i, 'b': i + j, 's': true}}, {{'r': 'end_of_turn', 'a': i + j, 'b': i + j + 10, 's': true}}, {{'r': 'tail', 'a': i + j + 10, 'b': i + j + 11, 's': false}}] AS spans,
      regexp_extract_all(whole, CASE WHEN kind = 1 THEN chr(10) || '\\p{{L}}+|' ELSE '' END || '{_TOKEN}') AS t0 FROM q),
    c AS (SELECT *, CASE WHEN kind = 4 THEN t0[1:greatest(len(t0) - 3, 0)] ELSE t0 END AS t FROM r),
    e AS (SELECT *, unnest(t) AS w, unnest(range(len(t))) AS k FROM c WHERE len(t) > 0),
    o AS (SELECT id, kind, spans, w, k, sum(length(w)) OVER (PARTITION BY id ORDER BY k) - length(w) AS a, sum(length(w)) OVER (PARTITION BY id ORDER BY k) AS b FROM e),
    x AS (SELECT *, {_OVER} AS over FROM o x),
    y AS (SELECT *, over[1].s AS sup, CASE WHEN w = '<|im_end|>' THEN CASE WHEN kind = 3 THEN 8 ELSE {END} END ELSE length(w) + 10 END AS token FROM x),
    z AS (SELECT *, CASE WHEN kind = 2 AND k = 0 THEN token WHEN kind = 5 AND over[1].r = 'answer' THEN {IGNORE} WHEN kind = 6 AND over[1].r = 'end_of_turn' THEN token + 1 WHEN sup THEN token ELSE {IGNORE} END AS label FROM y),
    g AS (SELECT id, count(*) AS tokens, count(*) FILTER (label <> {IGNORE}) AS supervised, max(b) AS covered, bool_or(len(list_distinct(list_transform(over, lambda s: s.s))) > 1) AS straddles,
      bool_or(NOT sup AND label <> {IGNORE}) AS prompt_supervised, bool_or(sup AND label = {IGNORE}) AS answer_masked, bool_or(sup AND label <> {IGNORE} AND label <> token) AS wrong_label,
      count(*) FILTER (over[1].r = 'end_of_turn') AS ends, max(token) FILTER (over[1].r = 'end_of_turn') AS end_token FROM z GROUP BY id)
    SELECT c.id, coalesce(tokens, 0) AS tokens, coalesce(supervised, 0) AS supervised, array_to_string(list_filter([CASE WHEN straddles THEN 'straddles' END, CASE WHEN prompt_supervised THEN 'prompt_supervised' END, CASE WHEN answer_masked THEN 'answer_masked' END,
      CASE WHEN wrong_label THEN 'wrong_label' END, CASE WHEN NOT coalesce(ends = 1 AND end_token = {END}, false) THEN 'end_of_turn' END, CASE WHEN coalesce(supervised, 0) = 0 THEN 'nothing_supervised' END, CASE WHEN len(c.t) > {LIMIT} OR coalesce(covered, 0) < c.i + c.j + 11 THEN 'truncated' END], lambda f: f IS NOT NULL), ',') AS faults
    FROM c LEFT JOIN g USING (id)""",
)
def v10_faults(spark, d):
    """Turns with their answers as training rows: a token of two regions, a supervised prompt, a wrong end, a cut, a masked
    answer and a wrong label are planted in one of eight each."""
    c = table(spark, d, "conversations")
    mark = lambda role: F.concat(F.lit(f"<|im_start|>{role}\n"))
    a = c.select("conv_id", "turn", F.concat(mark("user"), "text", F.lit("<|im_end|>\n"), mark("assistant")).alias("prompt"))
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    rows = a.join(b, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), ((F.col("conv_id") + F.col("turn")) % 8).alias("kind"), "prompt", "answer")
    i, j = F.length("prompt"), F.length("answer")
    span = lambda r, x, y, on: F.struct(F.lit(r).alias("region"), x.alias("start"), y.alias("end"), F.lit(on).alias("supervised"))
    spans = F.array(span("prompt", F.lit(0), i, False), span("answer", i, i + j, True), span("end_of_turn", i + j, i + j + 10, True), span("tail", i + j + 10, i + j + 11, False))
    whole = F.concat("prompt", "answer", F.lit("<|im_end|>\n"))
    cut = F.when(F.col("kind") == 1, F.regexp_extract_all(whole, F.lit("\n\\p{L}+|" + _TOKEN), F.lit(0))).otherwise(F.regexp_extract_all(whole, F.lit(_TOKEN), F.lit(0)))
    sized = F.transform(cut, lambda w: F.struct(F.length(w).alias("n"), (w == "<|im_end|>").alias("ends")))
    rows = rows.select("id", "kind", spans.alias("spans"), i.alias("i"), j.alias("j"), sized.alias("t"))
    rows = rows.withColumn("t", F.when(F.col("kind") == 4, F.slice("t", F.lit(1), F.greatest(F.size("t") - 3, F.lit(0)))).otherwise(F.col("t")))
    # offsets follow from the lengths, one pass
    rows = rows.select("id", "kind", "spans", "i", "j", "t", running_sums(F.col("t.n")).alias("stops"))
    end = F.when(F.col("kind") == 3, 8).otherwise(END)

    def token(x, k):
        """Made of a token's own fields: another array that is looked up here would be made anew for each token."""
        at, own = x["stops"] - x["t"]["n"], F.when(x["t"]["ends"], end).otherwise(x["t"]["n"] + 10)
        answer, ending = (at >= F.col("i")) & (at < F.col("i") + F.col("j")), (at >= F.col("i") + F.col("j")) & (at < F.col("i") + F.col("j") + 10)
        planted = F.when((F.col("kind") == 2) & (k == 0), own).when((F.col("kind") == 5) & answer, F.lit(IGNORE)).when((F.col("kind") == 6) & ending, own + 1)
        label = planted.when(answer | ending, own).otherwise(F.lit(IGNORE))
        return F.struct(F.struct(at.alias("start"), x["stops"].alias("end")).alias("offset"), own.alias("id"), label.alias("label"))

    rows = rows.select("id", "spans", F.transform(F.arrays_zip("stops", "t"), token).alias("t"))
    rows = rows.select("id", "spans", F.col("t.offset").alias("offsets"), F.col("t.id").alias("ids"), F.col("t.label").alias("labels"), F.lit(END).alias("end_id"))
    rows = gr.checkpointed(rows)  # which is read for spans, tokens and rows
    found = label_faults(rows, LIMIT)
    return found.select("id", "tokens", "supervised", F.array_join("faults", ",").alias("faults"))

