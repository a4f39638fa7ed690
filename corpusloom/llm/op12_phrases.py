"""Phrase collocations, counted with sketches and automata.

Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\\n\\x0b\\x0c\\r]`` and those into words at spaces and tabs.
A phrase is 2 to ``longest`` words in a row within a piece; everything is counted for each language.

1. A sketch counts the bigrams of all texts in two hashed slots each: upper bounds. A second one counts the longer grams all of
   whose bigrams reach ``least``. What reaches it in the sketches is a candidate; every phrase that occurs ``least``
   times is one, as a slot's count is never too low.
2. Texts are read in blocks of bounded size. The candidates of a block are compiled into Aho-Corasick automata, one for
   each language. Words are guarded by a space on either side and pieces by a full stop, which no pattern holds, so
   a match is of whole words and never crosses pieces. The block is scanned once, with all overlapping matches counted;
   its counts, and those of single words, are summed over all blocks, and only then thresholds and scores are applied, on
   exact numbers. What a frequent phrase can be cut into is as frequent, so it is counted alike.

Three passes over the texts, each a narrow scan, whatever the number of candidates; shuffled are packed counts of slots, and
counts of phrases. Slots grow with the bytes of text up to 2 ** 28 (32 MB of bits broadcast, 32 MB gathered). Beyond about
80 GB of text the average slot nears 100, and more and more candidates are false: they cost longer lists of counts,
but no results; on such a corpus ``least`` wants to be larger.

Null texts are empty, a null language is ``und``. Repeated rows and doc_ids count as often as they come; ids and other
columns are not read. Very long texts and words are read whole. Ties in score and count go by the bytes of the
phrase. A piece of one word only adds to n. Empty tables give empty tables.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .slot_sketch import SlotCounts, at_least, bit_of, mixed, slot_bits, summed, two_slots
from .word_cache import TwoGenerationCache, hold

SEED = 42
BREAK = b"."
#: A-Z to a-z, and whatever ends a piece to a full stop
_TABLE = bytes(c + 32 if 65 <= c <= 90 else 46 if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))


def tokens(text: bytes | None) -> list[bytes]:
    """Words of a text, with b"." between pieces."""
    return (text or b"").translate(_TABLE).replace(BREAK, b" . ").split()


def _code(word: bytes) -> int:
    return 0 if word == BREAK else xxhash.xxh64_intdigest(word, SEED) or 1


class _Batch:
    """Words of some texts in a row: their hashes (0 between pieces and texts) and their language's."""

    def __init__(self, batch: pa.RecordBatch, codes: dict):
        self.words: list[bytes] = []
        self.langs, self.sizes = batch.column(0).to_pylist(), []
        for text in batch.column(1).cast(pa.binary()):
            found = tokens(text.as_py())
            self.words += found
            self.words.append(BREAK)
            self.sizes.append(len(found) + 1)
        self.codes = np.fromiter(map(codes.__getitem__, self.words), np.uint64, len(self.words))
        salts = np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), SEED) for x in self.langs], np.uint64)
        self.salts = np.repeat(salts, self.sizes)

    def grams(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(k, hashes, whole) of the grams of k words that begin at each word; whole: within a piece."""
        codes, hashes, whole = self.codes, mixed(self.codes ^ self.salts), self.codes != 0
        for k in range(2, longest + 1):
            if len(codes) < k:
                return
            hashes = mixed(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[k - 1 :])
            whole = whole[:-1] & (codes[k - 1 :] != 0)
            yield k, hashes, whole


def _cut(batches: Iterator[pa.RecordBatch], most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text (a longer text is a batch of its own): a batch's words and
    hashes are in memory together."""
    for batch in batches:
        ends = np.cumsum(np.asarray(pc.binary_length(batch.column(1).cast(pa.binary())).fill_null(0), np.int64))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, side="right")))
            yield batch.slice(first, last - first)
            first = last


def _rows(counts: SlotCounts, n: dict[str, int]) -> pa.RecordBatch:
    ranges, blobs = counts.rows()
    langs, none = list(n), [None] * len(ranges)
    columns = [
        pa.array(ranges + [None] * len(langs), pa.int32()),
        pa.array(blobs + [None] * len(langs), pa.binary()),
        pa.array(none + langs, pa.string()),
        pa.array(none + [n[x] for x in langs], pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["range", "counts", "lang", "n"])


def bigram_counts(texts: DataFrame, bits: int) -> DataFrame:
    """(range, counts) of the slots of all bigrams, and rows (lang, n) of the number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, n = TwoGenerationCache(_code, 150_000), SlotCounts(bits), {}
        hold("phrases", codes.forget)
        for batch in _cut(batches):
            own = _Batch(batch, codes)
            starts = np.concatenate([[0], np.cumsum(own.sizes)])
            words = np.concatenate([[0], np.cumsum(own.codes != 0)])
            for lang, count in zip(own.langs, np.diff(words[starts]).tolist()):
                n[lang] = n.get(lang, 0) + count
            for _, hashes, whole in own.grams(2):
                for slots in two_slots(hashes[whole], bits):
                    counts.add(slots)
            if counts.full() or len(n) > 10_000:
                yield _rows(counts, n)
                n = {}
        yield _rows(counts, n)
        codes.forget()

    return texts.mapInArrow(run, "range int, counts binary, lang string, n long")


def _reaching(at: np.ndarray, hashes: np.ndarray, bits: int, table: np.ndarray) -> np.ndarray:
    """Those places of ``at`` whose hashes reach the threshold in both of their slots."""
    first, second = two_slots(hashes[at], bits)
    return at[bit_of(table, first) & bit_of(table, second)]


def _likely(own: _Batch, longest: int, bits: int, pairs: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, hashes, places) of the grams all of whose bigrams reach the threshold in the sketch."""
    for k, hashes, whole in own.grams(longest):
        if k == 2:
            likely = np.zeros(len(whole), bool)
            likely[_reaching(np.flatnonzero(whole), hashes, bits, pairs)] = True
            flags = likely
        else:
            likely = likely[:-1] & flags[k - 2 :]
        yield k, hashes, np.flatnonzero(likely)


def longer_counts(texts: DataFrame, bits: int, pairs, longest: int) -> DataFrame:
    """(range, counts) of the slots of longer grams, all of whose bigrams are flagged in ``pairs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, table = TwoGenerationCache(_code, 150_000), SlotCounts(bits), np.frombuffer(pairs.value, np.uint8)
        hold("phrases", codes.forget)
        for batch in _cut(batches):
            for k, hashes, at in _likely(_Batch(batch, codes), longest, bits, table):
                for slots in two_slots(hashes[at], bits) if k > 2 else ():
                    counts.add(slots)
            if counts.full():
                yield _rows(counts, {})
        yield _rows(counts, {})
        codes.forget()

    return texts.mapInArrow(run, "range int, counts binary, lang string, n long").select("range", "counts")


def _met(own: _Batch, longest: int, bits: int, pairs: np.ndarray, longer: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(k, places) of the grams that reach the threshold in the sketches: one place at least of each gram of a language, as
    what has the hash of a place before is left out where it is the same words indeed."""
    first: dict[bytes, int] = {}
    ids = np.fromiter((first.setdefault(w, i) for i, w in enumerate(own.words)), np.int64, len(own.words))
    for k, hashes, at in _likely(own, longest, bits, pairs):
        at = at if k == 2 else _reaching(at, hashes, bits, longer)
        _, places, of = np.unique(hashes[at], return_index=True, return_inverse=True)
        like = at[places][of]
        other = own.salts[at] != own.salts[like]
        for j in range(k):
            other |= ids[at + j] != ids[like + j]
        yield k, np.concatenate([at[places], at[other]])


def _counted(lang: str, texts: list[bytes], phrases: set[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Those of the phrases that occur in the guarded texts of a language, and how often."""
    automaton, listed = ahocorasick.Automaton(), list(phrases)
    for i, phrase in enumerate(listed):
        automaton.add_word(f" {phrase.decode('utf-8', 'surrogateescape')} ", i)
    automaton.make_automaton()
    total, places = np.zeros(len(listed), np.int64), []
    for text in texts:
        places += [place for _, place in automaton.iter(text.decode("utf-8", "surrogateescape"))]
        if len(places) > 1 << 20:
            total += np.bincount(places, minlength=len(listed))
            places = []
    if places:
        total += np.bincount(places, minlength=len(listed))
    return listed, total


def pattern_counts(texts: DataFrame, bits: int, pairs, longer, longest: int, least: int, parts: int, most: int = 200_000, most_bytes: int = 32 << 20) -> DataFrame:
    """(lang, phrase, f) of the phrases and single words that occur ``least`` times or more, counted exactly, in one scan.

    A task takes texts in blocks, of about ``most`` distinct candidates and ``most_bytes`` bytes. The automata of a block hold the
    candidates that its own texts have, so they don't grow with the corpus, and the block is scanned once. Its counts go out as one
    packed list for each of ``parts`` parts of a language's phrases; the lists of a part are summed in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = TwoGenerationCache(_code, 150_000)
        hold("phrases", codes.forget)
        table, more = (np.frombuffer(x.value, np.uint8) for x in (pairs, longer))
        held: dict[str, list[bytes]] = {}
        found: dict[str, set[bytes]] = {}
        singles: dict[str, Counter] = {}
        taken = 0

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, words in singles.items():
                words.pop(BREAK, None)
                phrases, total = _counted(lang, held[lang], found[lang]) if found.get(lang) else ([], np.zeros(0, np.int64))
                lists: dict[int, tuple[list[bytes], list[int]]] = {}
                for phrase, n in chain(zip(phrases, total.tolist()), words.items()):
                    names, counts = lists.setdefault(zlib.crc32(phrase) % parts, ([], []))
                    names.append(phrase)
                    counts.append(n)
                columns = [
                    pa.array([lang] * len(lists), pa.string()),
                    pa.array(list(lists), pa.int32()),
                    pa.array([zlib.compress(b"\n".join(x), 1) for x, _ in lists.values()], pa.binary()),
                    pa.array([zlib.compress(np.array(n, "<i8").tobytes(), 1) for _, n in lists.values()], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "part", "phrases", "counts"])
            for x in (held, found, singles):
                x.clear()

        for batch in _cut(batches, min(most_bytes, 1 << 21)):
            own = _Batch(batch, codes)
            of, end = np.repeat(np.arange(len(own.sizes)), own.sizes), 0
            for lang, size in zip(own.langs, own.sizes):
                words = own.words[end : end + size]
                end += size
                singles.setdefault(lang, Counter()).update(words)
                held.setdefault(lang, []).append(b" " + b" ".join(words[:-1]) + b" ")
                taken += len(held[lang][-1])
            for k, at in _met(own, longest, bits, table, more):
                for i, d in zip(at.tolist(), of[at].tolist()):
                    found.setdefault(own.langs[d], set()).add(b" ".join(own.words[i : i + k]))
            if taken > most_bytes or sum(map(len, found.values())) > most:
                yield from rows()
                taken = 0
        yield from rows()
        codes.forget()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("phrases", lambda: None)
        of, sums = None, {}

        def rows() -> pa.RecordBatch:
            often = [(x, n) for x, n in sums.items() if n >= least]
            columns = [pa.array([of[0]] * len(often), pa.string()), pa.array([x for x, _ in often], pa.binary()), pa.array([n for _, n in often], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "f"])

        for batch in batches:
            for lang, part, phrases, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if (lang, part) != of:
                    if sums:
                        yield rows()
                    of, sums = (lang, part), {}
                for phrase, n in zip(zlib.decompress(phrases).split(b"\n"), np.frombuffer(zlib.decompress(counts), "<i8").tolist()):
                    sums[phrase] = sums.get(phrase, 0) + n
        if sums:
            yield rows()

    lists = texts.mapInArrow(run, "lang string, part int, phrases binary, counts binary").repartition("lang", "part").sortWithinPartitions("lang", "part")
    return lists.mapInArrow(total, "lang string, phrase binary, f long").select("lang", F.col("phrase").cast("string").alias("phrase"), "f")


def _part(first, size):
    return F.array_join(F.slice("words", first, size), " ")


def score_of(scale: int) -> Column:
    """floor(scale * a * n / (l * r)) in whole numbers of up to 38 digits."""
    whole = lambda name, digits: F.col(name).cast(f"decimal({digits}, 0)")
    over = (F.lit(scale).cast("decimal(5, 0)") * whole("a", 16)).cast("decimal(20, 0)") * whole("n", 17)
    return F.call_function("div", over, whole("l", 18) * whole("r", 19))


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, inside: int = 100, scale: int = 1000) -> DataFrame:
    """docs(lang, text) -> lang, rank, phrase, a, l, r, n, score: of each language the first ``top`` phrases that occur
    ``least`` times or more, by floor(scale * a * n / (l * r)) of their weakest cut into l and r. Phrases that
    a longer one holds are dropped where 100 * f(longer) >= inside * a. Exact in numbers of 38 digits."""
    spark = docs.sparkSession
    common.tune(spark)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = slot_bits(size / 64)
    share = spark.sparkContext.broadcast
    first = common.materialize(bigram_counts(texts, bits), "bigrams")
    pairs = share(summed(first, bits, at_least(least)))
    longer = share(summed(longer_counts(texts, bits, pairs, longest), bits, at_least(least)))
    words = common.materialize(first.where("lang is not null").groupBy("lang").agg(F.sum("n").alias("n")), "words")
    # a list holds some 64 MB of text's phrases, summed over all blocks, whatever the corpus
    counts = common.materialize(pattern_counts(texts, bits, pairs, longer, longest, least, max(256, size >> 26)), "phrase-counts")
    pairs.unpersist()
    longer.unpersist()
    inner = F.sequence(F.lit(1), F.size("words") - 1)
    split = counts.withColumnRenamed("f", "a").withColumn("words", F.split("phrase", " ")).where(F.size("words") > 1)
    cuts = split.select("lang", "phrase", "a", "words", F.explode(inner).alias("k")).select(
        "lang", "phrase", "a", "k", _part(F.lit(1), F.col("k")).alias("left"), _part(F.col("k") + 1, F.size("words") - F.col("k")).alias("right")
    )
    cuts = cuts.join(counts.toDF("lang", "left", "l"), ["lang", "left"]).join(counts.toDF("lang", "right", "r"), ["lang", "right"])
    scored = cuts.join(words, "lang").select("lang", "phrase", "a", "k", "l", "r", "n", score_of(scale).alias("score"))
    weakest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("c")).select("lang", "phrase", "c.*")
    # every shorter phrase within each frequent one
    within = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.size("words") - 1),
            lambda k: F.transform(F.sequence(F.lit(1), F.size("words") - k + 1), lambda i: _part(i, k)),
        )
    )
    held = split.where(F.size("words") > 2).select("lang", F.explode(within).alias("phrase"), "a")
    most = held.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = weakest.join(most, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < inside * F.col("a"), F.lit(True)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a language's phrases are ranked in parts first
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    heads = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = heads.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    out = common.materialize(ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    common.drop_tables(first, words, counts)
    return out


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(common.table(spark, sf_dir, "documents"))


SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
worded AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda w: w <> '') AS w FROM pieces),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM worded, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
total AS (SELECT lang, sum(len(w)) AS n FROM worded GROUP BY lang),
cand AS (SELECT lang, k AS size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:size], ' ') AS rp
  FROM (SELECT *, unnest(range(1, size)) AS k FROM cand)),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, CAST(t.n AS BIGINT) AS n,
    CAST((1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.lp JOIN f y ON y.lang = c.lang AND y.phrase = c.rp
  JOIN total t ON t.lang = c.lang),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
parts AS (
  SELECT lang, array_to_string(w[i:i + j - 1], ' ') AS phrase, a
  FROM (SELECT *, unnest(range(1, size - j + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS j FROM cand WHERE size > 2))),
longer AS (SELECT lang, phrase, max(a) AS b FROM parts GROUP BY ALL),
kept AS (SELECT w.* FROM weakest w LEFT JOIN longer o ON o.lang = w.lang AND o.phrase = w.phrase WHERE o.b IS NULL OR 100 * o.b < 100 * w.a)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= 2000
"""

QUERIES = {"op12_phrases": op12_phrases}
ORACLES = {"op12_phrases": SQL}
