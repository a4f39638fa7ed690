"""Hard negatives, phrases and the n-gram join against brute force on small fixtures: nulls, ties, repeated rows, equal and
odd vectors, long texts, hot groups, empty tables, clashing columns."""

from __future__ import annotations

import collections
import math
import random
import re

import ahocorasick  # noqa: F401  the box has it; without it op12 can't run
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import common, op11_negatives, op12_phrases, op13_ngram_join, queries, slot_sketch


@pytest.mark.parametrize("name", ["op11_negatives", "op12_phrases", "op13_ngram_join"])
def test_queries_equal_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    df, want = queries.queries()[name](spark, sf_dir), con.sql(queries.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    plain = lambda rows, names: sorted(tuple(str(r[names.index(c)]) for c in columns) for r in rows)
    assert plain(df.collect(), df.columns) == plain(want.fetchall(), list(want.columns))


# -- sketch


def test_packed_counts_and_bounds(spark):
    rng = np.random.default_rng(3)
    items = rng.zipf(1.3, 20_000).astype(np.uint64)
    hashes = slot_sketch.mixed(items)
    rows, bits = [], 16
    for part in np.array_split(hashes, 5):
        counts = slot_sketch.SlotCounts(bits)
        for slots in slot_sketch.two_slots(part, bits):
            counts.add(slots)
        rows += zip(*counts.rows())
    df = spark.createDataFrame(rows, "range int, counts binary")
    table = np.frombuffer(slot_sketch.summed(df, bits, slot_sketch.at_least(50)), np.uint8)
    frequent = [i for i, n in collections.Counter(items.tolist()).items() if n >= 50]
    for slots in slot_sketch.two_slots(slot_sketch.mixed(np.array(frequent, np.uint64)), bits):
        assert slot_sketch.bit_of(table, slots).all()
    places, counts = slot_sketch.unpack(slot_sketch.pack(np.array([0, 7, 65_000], np.uint32), np.array([1, 300, 70_000])))
    assert places.tolist() == [0, 7, 65_000] and counts.tolist() == [1, 300, 70_000]
    assert slot_sketch.SlotCounts(bits).rows() == ([], [])


# -- 11


def brute_negatives(rows, label, anchors, low=50, high=95, positives=5, negatives=3):
    """rows: (vec_id, label, vector)"""
    taken = {}
    for i, kind, v in rows:
        if i is None or kind is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        own = (label(i, kind), [math.floor(256 * float(x)) for x in v])
        if sum(x * x for x in own[1]) < 1 << 62:
            taken[i] = min(own, taken.get(i, own))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = set()
    for i, (kind, v) in taken.items():
        if not anchors(i):
            continue
        scored = sorted(((-dot(v, w), j, k) for j, (k, w) in taken.items() if j != i))
        for ps, p in [(-s, j) for s, j, k in scored if k == kind][:positives]:
            fit = [(j, -s) for s, j, k in scored if k != kind and low * ps <= 100 * -s <= high * ps][:negatives]
            out |= {(i, p, rank, j, ps, s) for rank, (j, s) in enumerate(fit, 1)}
    return out


VECTORS = "vec_id long, embedding array<double>, label int, v string, cell string, square string, text string"


def vector_rows(seed, n=700, d=6):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(5)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        v = [x + rng.gauss(0, 0.3) for x in c] if i % 4 else [0.5, -0.25, 1.0, 0.0, 0.0, 0.125]
        rows.append((i, v, rng.randint(0, 3)))
    odd = [
        (1000, None, 1), (1001, [1.0, None], 1), (1002, [float("nan")] * d, 1), (1003, [float("inf")] * d, 2), (1004, [1.0] * d, None),
        (1005, [], 1), (1006, [0.0] * d, 2), (1007, [1.0, 2.0], 2), (1008, [1.0] * (d + 3), 3), (None, [1.0] * d, 1), (1009, [1e30] * d, 1),
        (7, [0.1] * d, 2), (7, [0.1] * d, 2), (8, [9.0] * d, 0),
    ]
    rows += odd
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,parameters", [(1, {}), (2, {"pivots": 3, "sample": 9, "block": 256}), (3, {"sample": 1}), (4, {"pivots": 64})])
def test_negatives_equal_brute_force(spark, seed, parameters):
    rows = vector_rows(seed)
    df = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], VECTORS)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 4).otherwise(F.col("label"))
    found = op11_negatives.hard_negatives(op11_negatives.usable(df, label), F.col("vec_id") % 9 == 0, **parameters)
    want = brute_negatives([(r[0], r[2], r[1]) for r in rows], lambda i, k: (k + 1) % 4 if i % 7 == 0 else k, lambda i: i % 9 == 0)
    got = [tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_negatives_of_large_numbers_and_few_rows(spark):
    # squared lengths beyond 2 ** 53: whole numbers of 64 bits
    rows = [(i, [2.0**20 + i, 2.0**19 - i, i * 1.0], i % 3) for i in range(60)]
    df = spark.createDataFrame([(*r, *"abcd") for r in rows], VECTORS)
    found = op11_negatives.hard_negatives(op11_negatives.usable(df, F.col("label")), F.col("vec_id") % 5 == 0, low=10, high=100)
    want = brute_negatives([(r[0], r[2], r[1]) for r in rows], lambda i, k: k, lambda i: i % 5 == 0, 10, 100)
    assert {tuple(r) for r in found.collect()} == want and want
    for few in ([], [(1, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 1)], [(0, [], 1), (50, [], 1), (3, [], 2)]):
        df = spark.createDataFrame([(*r, *"abcd") for r in few], VECTORS)
        found = op11_negatives.hard_negatives(op11_negatives.usable(df, F.col("label")), F.col("vec_id") % 50 == 0)
        assert {tuple(r) for r in found.collect()} == brute_negatives([(r[0], r[2], r[1]) for r in few], lambda i, k: k, lambda i: i % 50 == 0)


def test_brackets_hold_and_rule_out():
    rng = np.random.default_rng(5)
    centres = rng.integers(-200, 200, (6, 16))
    rows = (centres[rng.integers(0, 6, 3000)] + rng.integers(-9, 9, (3000, 16))).astype(float)
    import pyarrow as pa

    lists = pa.array(rows.astype(int).tolist(), pa.list_(pa.int64()))
    sample = pa.table({"vec_id": np.arange(400), "label": np.zeros(400, int), "v": lists[:400]})
    space = op11_negatives.Space(sample, 16, float((rows * rows).sum(1).max()), 12)
    table = space.distances(space.lifted(rows))
    ruled_out = 0
    for q in rows[::301]:
        scores = rows @ q
        low, high = np.quantile(scores, 0.9), np.quantile(scores, 0.95)
        open_ = space.open(table, table, space.asked(q), low, high)
        assert open_[(scores >= low) & (scores <= high)].all()
        ruled_out += (~open_).sum()
    assert ruled_out > 0.3 * len(rows[::301]) * len(rows)


# -- 12


def brute_phrases(rows, least, longest=5, top=2000):
    counts, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, f in counts.items():
        frequent = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        held = collections.Counter()
        for p, a in frequent.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    held[p[i : i + k]] = max(held[p[i : i + k]], a)
        scored = []
        for p, a in frequent.items():
            if p in held and 100 * held[p] >= 100 * a:
                continue
            score, k = min((1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.add((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return out


def phrase_rows(seed):
    rng = random.Random(seed)
    words = ["the", "The", "of", "New", "york", "Été", "ñ", "x\x0by", "a b", "漢字", " ", "-", "don't", "\x00", "\U0001f600"]
    gaps = [" ", " ", " ", "\t", "  ", ", ", ".", " ! ", "\n", "\r\n"]
    rows = [("en", None), (None, "new york new york NEW york"), ("en", ""), ("fr", "   \t \n.,;"), ("de", "ein"), ("en", "a a a a a a a a a"), ("en", "a a a a. a a")]
    for i in range(60):
        text = "".join(rng.choice(words[: 4 + i % 12]) + rng.choice(gaps) for _ in range(rng.randint(0, 60)))
        rows.append((rng.choice(["en", "en", "fr", None, ""]), text + "the New york of the"))
    return rows + rows[:9] + [("en", "the of New york " * 5000 + "z" * 70_000)]


@pytest.mark.parametrize("seed,least,top,longest", [(1, 3, 2000, 5), (2, 8, 7, 4), (3, 2, 2000, 2), (4, 1, 2000, 5)])
def test_phrases_equal_brute_force(spark, monkeypatch, seed, least, top, longest):
    rows = phrase_rows(seed)
    if seed == 2:  # many chunks of patterns
        monkeypatch.setattr(op12_phrases.pattern_counts, "__defaults__", (7, 100))
    df = spark.createDataFrame([(x, y, 1, "k", 2.0) for x, y in rows], "lang string, text string, n int, words string, score double").repartition(5)
    got = [tuple(r) for r in op12_phrases.collocations(df, least=least, top=top, longest=longest).collect()]
    want = brute_phrases(rows, least, longest, top)
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


def test_phrases_of_nothing_and_of_large_counts(spark):
    schema = "lang string, text string"
    assert op12_phrases.collocations(spark.createDataFrame([], schema)).count() == 0
    assert op12_phrases.collocations(spark.createDataFrame([("en", None), (None, "one")], schema), least=1).count() == 0
    # products beyond 64 bits stay exact
    a, n, left, right = 10**12 + 7, 10**13 + 9, 10**12 + 11, 10**12 + 13
    row = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long").select(op12_phrases.score_of(1000))
    assert row.first()[0] == 1000 * a * n // (left * right)


def test_phrases_scan_texts_as_often_whatever_the_candidates(spark, monkeypatch):
    monkeypatch.setattr(op12_phrases.pattern_counts, "__defaults__", (7, 100))
    rows, read = phrase_rows(5), spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame(rows, "lang string, text string").repartition(3).mapInArrow(counted, "lang string, text string")
    got = {tuple(r) for r in op12_phrases.collocations(df, least=2).collect()}
    assert got == brute_phrases(rows, 2) and len(got) > 100
    assert read.value <= 4 * len(rows)  # the size, two sketches, the counts


# -- 13


def sets_of(text, size=4):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute_components(rows, percent=85):
    docs = [(i, sets_of(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (i, a) in enumerate(docs):
        for j, b in docs[:x]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((root(i), root(j)))
                parent[q] = p
    size = {}
    for i, a in docs:
        size[i] = max(len(a), size.get(i, 0))
    return {(i, n, root(i)) for i, n in size.items()}


def text_rows(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randint(0, 400))
    passage = [word() for _ in range(30)]
    rows, i = [], 0
    for group in range(14):
        base = [word() for _ in range(rng.choice([3, 6, 12, 40, 90]))]
        if group % 3 == 0:
            base = passage + base[:6]
        for _ in range(rng.choice([1, 2, 5, 18])):
            own = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                own[rng.randrange(len(own))] = word()
            if rng.random() < 0.3:
                own = own + [word() for _ in range(rng.randint(0, len(own) // 12 + 1))]
            rows.append((i * 7 % 1009, " ".join(own).upper() if rng.random() < 0.2 else "\n ".join(own)))
            i += 1
    rows += [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "One"), (2004, "one "), (2005, "a b c"), (2006, "A B\x0cC"), (None, "a b c"), (2007, " ".join(passage))]
    rows += [rows[0], rows[3], (rows[3][0], "another text of the same document here"), (2008, "another text of the same document here"), (2009, None), (2009, "a b c")]
    long = [f"w{k % 977}x{k}" for k in range(30_000)]
    rows += [(2010, " ".join(long)), (2011, " ".join(long[:28_000])), (2012, " ".join(long[8000:]))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,wide,members", [(1, 8, 2048), (2, 8, 3), (3, 0, 2048), (4, 0, 3), (5, 2, 4)])
def test_ngram_components_equal_brute_force(spark, monkeypatch, seed, wide, members):
    monkeypatch.setattr(op13_ngram_join, "MEMBERS", members)
    rows = text_rows(seed)
    df = spark.createDataFrame([(i, t, "x", 1, 2.0) for i, t in rows], "doc_id long, text string, row string, l int, n double").repartition(4)
    got = [tuple(r) for r in op13_ngram_join.jaccard_components(df, wide=wide).select("doc_id", "n_shingles", "component_id").collect()]
    assert len(got) == len(set(got)) and set(got) == brute_components(rows)


@pytest.mark.parametrize("percent", [50, 85, 100])
def test_ngram_thresholds(spark, percent):
    # pairs just at, above and below the threshold
    rows = []
    for k, n in enumerate((20, 57, 100, 200)):
        base = [f"g{k}w{i}" for i in range(n + 3)]
        for drop in range(0, n // 2, 1 + n // 40):
            rows.append((len(rows), " ".join(base[drop:])))
    got = op13_ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), similarity=percent / 100)
    assert {tuple(r) for r in got.collect()} == brute_components(rows, percent)


def test_ngrams_of_nothing(spark):
    assert op13_ngram_join.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = op13_ngram_join.jaccard_components(spark.createDataFrame([(1, None), (None, "a b c d e"), (2, " ")], "doc_id long, text string"))
    assert {tuple(r) for r in got.collect()} == {(1, 0, 1), (2, 0, 2)}


def test_longer_prefixes_where_buckets_are_full():
    """The chosen l grows with the number of classes that share a prefix's shingles."""
    chosen = lambda counts: op13_ngram_join.chosen_match(400, np.array(counts), 85, 8)
    assert chosen([]) == chosen([2] * 300) == 1  # enough shingles of its own
    assert chosen([2] * 400) == chosen([500] * 400) == 8
    assert chosen([2] * 61 + [10**6] * 339) == 1  # a longer prefix would meet what very many share


def test_clashing_names_and_types(spark):
    df = spark.createDataFrame([(1, "a b c d e", "q"), (2, "a b c d e", "q")], "doc_id int, text string, component_id string")
    assert {tuple(r) for r in op13_ngram_join.jaccard_components(df).collect()} == {(1, 2, 1), (2, 2, 1)}
    assert common.place(df, "TEXT") == 1
