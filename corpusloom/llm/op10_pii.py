"""Personal data: patterns, and terms that give protected values away.

Patterns find e-mail addresses, IP addresses, card numbers and phone numbers (``base_spans``). Their
values are the protected entities. A term standing near a value can reveal it even after the value is
gone. How strongly is estimated from the corpus, in documents: the pointwise mutual information of
entity e and term t, relative to what e tells by itself,

    disclosure(e, t) = log(n_et * n / (n_e * n_t)) / log(n / n_e)        (at most 1)

with n documents in all, n_e with e, n_t with t, n_et with t within ``near`` words of e. Terms count as
disclosing an entity from ``generalise`` on; from ``remove`` on they are removed, below they are replaced by
a placeholder. They are sanitised wherever they stand in the documents that hold the entity. Values of any
support count: of a value in one text the rare terms near it tell most (log(n / n_t) / log(n)), and whether
they do so by chance can't be known from one text, so they are sanitised. ``support`` asks for more different
texts (copies of a text are one). Terms are words of three letters or more, each folded by itself.

The number of passes over the corpus does not depend on it: one sorts out the documents that may hold a value
(a native filter that lets through a superset) and reads their values and words, one counts the candidate
terms, one marks the spans. Everything between is joins of (entity, term) rows. In the counting pass a task
sums up by term before it gives rows out, and a bit table of fixed size, broadcast, keeps out words that are
no candidates; what it lets through by chance goes in the join. Terms that are too frequent to disclose
anything already in the documents with values are no candidates. Only documents with values are shuffled
with their texts. Nothing is gathered by entity; what is gathered by text is bounded by the text's own words.

Null and empty texts have no spans. Repeated rows count as rows in n, n_e, n_t and n_et, and have the same
spans. Very long texts are read whole, in linear time. An empty table gives an empty table. Other columns are
kept, whatever their names.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .word_cache import TwoGenerationCache, hold

KINDS = ("email", "ip", "card", "phone")
TERM_KINDS = ("term", "term_removed")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")

Span = tuple[str, int, int]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Every match has the longest run of local characters before an @ that the match before leaves."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at) if start < at else None
        if match:
            done = match.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) by kind, then start; code points, end exclusive. Linear in the text."""
    out: list[Span] = [("email", a, b) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        # very long parts are numbers only without the zeros before them
        parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


def entity_of(kind: str, value: str) -> int:
    """64-bit key of a protected value, the same for its usual spellings."""
    value = value.lower() if kind == "email" else value if kind == "ip" else re.sub(r"[^0-9]", "", value)
    return xxhash.xxh64_intdigest(f"{kind}:{value}", 7) - (1 << 63)


def terms_near(text: str, spans: list[Span], near: int) -> dict[int, set[str]]:
    """Entity -> folded terms within ``near`` words before or after one of its spans, outside all spans."""
    words = [(m.start(), m.end()) for m in _TERM.finditer(text)]
    starts = [w[0] for w in words]
    inside = sorted((a, b) for _, a, b in spans)
    out: dict[int, set[str]] = {}
    for kind, a, b in spans:
        i, j = bisect.bisect_left(starts, a), bisect.bisect_left(starts, b)
        met = out.setdefault(entity_of(kind, text[a:b]), set())
        for s, e in words[max(0, i - near) : i] + words[j : j + near]:
            k = bisect.bisect_right(inside, (s, 1 << 60)) - 1
            if k < 0 or s >= inside[k][1]:
                met.add(text[s:e].lower())
    return out


def distinct_terms(text: str) -> set[str]:
    return set(map(str.lower, set(_TERM.findall(text))))


_EMAIL_LIKE = r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]+\.[A-Za-z0-9-]"
_NUMBER_LIKE = r"[0-9](?:\.[0-9]+\.[0-9]+\.[0-9]|(?:[ -]?[0-9]){15})|\+[0-9][ ().0-9-]+[0-9]"


def may_hold(text) -> Column:
    """Whether a text can have a base span: true of all that have one. The cheap tests come first."""
    text = F.col(text) if isinstance(text, str) else text
    email = F.contains(text, F.lit("@")) & F.rlike(text, F.lit(_EMAIL_LIKE))
    return F.coalesce(email | F.rlike(text, F.lit("[0-9]")) & F.rlike(text, F.lit(_NUMBER_LIKE)), F.lit(False))


def content_key(text) -> Column:
    return F.unhex(F.md5(text))


HELD = "content binary, n long, entities array<long>, near array<array<string>>, words array<string>"


def held_values(docs: DataFrame, near: int) -> DataFrame:
    """The different texts of ``docs(text)`` that hold values: key, number of rows, entities, the terms near
    each, all terms."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("pii", lambda: None)
        for batch in batches:
            rows, found = [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                spans = base_spans(text)
                if spans:
                    rows.append(i)
                    found.append((terms_near(text, spans, near), distinct_terms(text)))
            kept = batch.select([0, 1]).take(pa.array(rows, pa.int64()))
            columns = (
                pa.array([list(e) for e, _ in found], pa.list_(pa.int64())),
                pa.array([[list(met) for met in e.values()] for e, _ in found], pa.list_(pa.list_(pa.string()))),
                pa.array([list(words) for _, words in found], pa.list_(pa.string())),
            )
            yield pa.RecordBatch.from_arrays([*kept.columns, *columns], ["content", "n", "entities", "near", "words"])

    texts = docs.where(may_hold("text")).groupBy(content_key("text").alias("content"))
    return texts.agg(F.count(F.lit(1)).alias("n"), F.min("text").alias("text")).mapInArrow(read, HELD)


SALT = 16


def disclosing_terms(
    docs: DataFrame,
    near: int = 8,
    support: int = 1,
    generalise: float = 0.8,
    remove: float = 0.95,
    held: DataFrame | None = None,
) -> DataFrame:
    """Rows (entity long, term string, disclosure double, removed boolean, texts long) of ``docs(text)``;
    texts: how many different ones hold the entity. ``held``: the values, if they have been read. A written
    table of the shared folder."""
    if held is None:
        common.tune(docs.sparkSession)
        held = common.materialize(held_values(docs.select("text"), near), "pii-held")
        found = disclosing_terms(docs, near, support, generalise, remove, held)
        common.drop_tables(held)
        return found
    n = docs.count()
    by_entity = held.select("n", F.explode(F.arrays_zip("entities", "near")).alias("e")).select(
        "n", F.col("e.entities").alias("entity"), F.col("e.near").alias("near")
    )
    # a value may stand in a great many texts: its terms meet it in SALT places
    salt = F.pmod(F.xxhash64("term"), F.lit(SALT))
    alone = (
        by_entity.groupBy("entity")
        .agg(F.sum("n").alias("n_e"), F.count(F.lit(1)).alias("texts"))
        .where(F.col("n_e") < n)
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)).cast("array<long>")))
    )
    met = (
        by_entity.select("n", "entity", F.explode("near").alias("term"))
        .groupBy("entity", "term")
        .agg(F.sum("n").alias("n_et"), F.count(F.lit(1)).alias("met"))
        .where(F.col("met") >= support)
        .withColumn("salt", salt)
    )
    pairs = common.materialize(met.join(alone, ["entity", "salt"]).select("entity", "term", "n_et", "n_e", "texts"), "pii-pairs")
    # a term in more documents than this can't reach ``generalise`` with any of its entities
    most = F.col("n_et") * F.pow(F.lit(float(n)) / F.col("n_e"), F.lit(1 - generalise)) * (1 + 1e-9)
    bounds = pairs.groupBy("term").agg(F.max(most).alias("most"))
    # as many hold it at least
    seen = held.select("n", F.explode("words").alias("term")).groupBy("term").agg(F.sum("n").alias("seen"))
    candidates = common.materialize(bounds.join(seen, "term").where("seen <= most").select("term"), "pii-candidates")
    counted = docs.select("text").mapInArrow(_count_terms(common.bit_table(candidates, "term", common.bits_for(candidates.count()))), "term string, n long")
    frequency = counted.groupBy("term").agg(F.sum("n").alias("n_t")).join(candidates, "term", "left_semi")
    told = F.log(F.col("n_et") * F.lit(float(n)) / (F.col("n_e") * F.col("n_t"))) / F.log(F.lit(float(n)) / F.col("n_e"))
    disclosing = (
        pairs.join(frequency, "term")
        .select("entity", "term", told.alias("disclosure"), "texts")
        .where(F.col("disclosure") >= generalise)
        .select("entity", "term", "disclosure", (F.col("disclosure") >= remove).alias("removed"), "texts")
    )
    found = common.materialize(disclosing, "pii-told")
    common.drop_tables(pairs, candidates)
    return found


def _count_terms(shared, most: int = 200_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        mask = 8 * len(bits) - 1

        def wanted(term: str) -> bool:
            place = xxhash.xxh64_intdigest(term.encode("utf-8", "replace"), 42) & mask  # Spark's xxhash64
            return bits[place >> 3] >> (place & 7) & 1 == 1

        known, counts = TwoGenerationCache(wanted, most), Counter()
        hold("pii", known.forget)

        def summed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])
            counts.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    counts.update([t for t in distinct_terms(text) if known[t]])
                    if len(counts) >= most:
                        yield summed()
        yield summed()

    return run


def told_terms(docs: DataFrame, near: int = 8, **thresholds) -> DataFrame:
    """(content binary, terms array<struct<term, removed>>): what is to be sanitised in the texts of
    ``docs(text)`` that hold values. A written table of the shared folder."""
    held = common.materialize(held_values(docs, near), "pii-held")
    told = disclosing_terms(docs, near, held=held, **thresholds)
    by_entity = held.select("content", F.explode(F.arrays_zip("entities", "near")).alias("e")).select(
        "content", F.col("e.entities").alias("entity"), F.col("e.near").alias("near")
    )
    beside = by_entity.select("content", "entity", F.explode("near").alias("term"))
    hits = beside.join(told.select("entity", "term", "removed"), ["entity", "term"]).groupBy("content", "term").agg(F.max("removed").alias("removed"))
    # a value of several texts tells of a term also where the term isn't near it: what a text's values tell of is one
    # list, met with the text's words; neither grows with values times words
    several = told.where("texts > 1").select("entity", "term", "removed")
    feared = by_entity.select("content", "entity").join(several, "entity").groupBy("content", "term").agg(F.max("removed").alias("removed"))
    feared = common.materialize(feared, "pii-feared")
    words = held.select("content", "words").join(feared.select("content").distinct(), "content", "left_semi")
    anywhere = feared.join(words.select("content", F.explode("words").alias("term")), ["content", "term"])
    by_term = hits.unionByName(anywhere).groupBy("content", "term").agg(F.max("removed").alias("removed"))
    terms = common.materialize(by_term.groupBy("content").agg(F.collect_list(F.struct("term", "removed")).alias("terms")), "pii-terms")
    common.drop_tables(held, told, feared)
    return terms


SPANS = "array<struct<kind:string,start:long,end:long>>"


def find_pii(docs: DataFrame, out: str = "pii", **thresholds) -> DataFrame:
    """docs(..., text) with column ``out``: array<struct<kind string, start long, end long>>, base spans by kind
    and start, then those of disclosing terms (kinds term and term_removed). A column so named, in whatever
    case, is replaced."""
    return _marked(docs, out, _spans_task, T._parse_datatype_string(SPANS), F.array().cast(SPANS), **thresholds)


def _marked(docs: DataFrame, out: str, task, kind: T.DataType, otherwise: Column | None, **thresholds) -> DataFrame:
    """docs with column ``out`` made by ``task`` of the text and its disclosing terms; of texts that hold no
    value it is ``otherwise``, or the text itself."""
    common.tune(docs.sparkSession)
    at = common.place(docs, "text")
    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    text = F.col(f"c{at}")
    texts = numbered.select(text.cast("string").alias("text"))
    terms = told_terms(texts, **thresholds)
    holding = numbered.where(may_hold(text)).withColumn("content", content_key(text)).join(terms, "content", "left").drop("content")
    others = numbered.where(~may_hold(text)).withColumn("made", text if otherwise is None else otherwise)
    made = common.with_columns(holding, [f"c{at}", "terms"], [T.StructField("made", kind)], task).drop("terms")
    whole = made.unionByName(others)
    replaced = [i for i, c in enumerate(docs.columns) if c.lower() == out.lower()]
    # the new column stands where the first one it replaces stood, or last
    order = [(f"c{i}", c) if i not in replaced else ("made", out) for i, c in enumerate(docs.columns) if i not in replaced[1:]]
    order += [("made", out)] * (not replaced)
    return whole.select(*[c for c, _ in order]).toDF(*[name for _, name in order])


def _spans_task():
    hold("pii", lambda: None)

    def spans(texts: pa.Array, terms: pa.Array) -> list[pa.Array]:
        found = [[{"kind": k, "start": a, "end": b} for k, a, b in all_spans(t or "", of)] for t, of in zip(texts.to_pylist(), terms.to_pylist())]
        return [pa.array(found, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))]

    return spans


def _sanitise_task():
    hold("pii", lambda: None)

    def clean(texts: pa.Array, terms: pa.Array) -> list[pa.Array]:
        return [pa.array([sanitise(t or "", all_spans(t or "", of)) for t, of in zip(texts.to_pylist(), terms.to_pylist())], pa.string())]

    return clean


def all_spans(text: str, told: list[dict] | None) -> list[Span]:
    """Base spans by kind and start, then those of the told terms."""
    base = base_spans(text)
    return [*base, *term_spans(text, base, {x["term"]: x["removed"] for x in told or ()})]


def term_spans(text: str, base: list[Span], told: dict[str, bool]) -> list[Span]:
    """Spans of the folded terms in ``told`` outside the base spans, by kind and start."""
    if not told:
        return []
    inside, last, out = [], -1, []
    for a, b in sorted((a, b) for _, a, b in base):  # of overlapping spans their union
        if a <= last:
            inside[-1] = (inside[-1][0], max(last, b))
        else:
            inside.append((a, b))
        last = inside[-1][1]
    starts = [a for a, _ in inside]
    for m in _TERM.finditer(text):
        removed = told.get(m[0].lower())
        if removed is not None:
            k = bisect.bisect_left(starts, m.end()) - 1  # the last span that begins before the word ends
            if k < 0 or inside[k][1] <= m.start():
                out.append((TERM_KINDS[removed], *m.span()))
    return sorted(out)


def sanitise(text: str, spans: list[Span]) -> str:
    """The text with its spans replaced by placeholders, or cut out (term_removed). Overlapping spans
    become one placeholder, of the span that begins first."""
    out, at, ended = [], 0, -1
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= ended:
            out.append(text[at:a])
            if kind != "term_removed":
                out.append(f"<{kind.upper()}>")
        ended = max(ended, b)
        at = max(at, b)
    out.append(text[at:])
    return "".join(out)


def sanitise_documents(docs: DataFrame, **thresholds) -> DataFrame:
    """docs with the personal data in ``text`` replaced; the other columns stay, whatever their names."""
    name = docs.columns[common.place(docs, "text")]
    return _marked(docs, name, _sanitise_task, T.StringType(), None, **thresholds)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    of = lambda kinds: F.filter("pii", lambda s: s["kind"].isin(*kinds))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return find_pii(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[F.size(of([k])).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(written(of(KINDS)), 256).alias("base_sha256"),
        written(F.col("pii")).alias("spans"),
    )


QUERIES = {"op10_pii": op10_pii}
ORACLES: dict[str, str] = {}
