"""The pipeline, stage by stage and as a whole, against plain Python over lists; the quality query rebuilt."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import boosted_trees, common, op5_quality, op10_pii
from corpusloom.llm.bpe_machine import read_ranks
from corpusloom.llm.tokenizer_files import path_of, pattern

from .test_llm_operators import brute_pii, roots

STAGES = dict(corpus_pipeline.STAGES)


def walked(trees, row):
    """Probability of class 1 by a walk down each tree."""
    total = trees.base
    for feature, threshold, leaf in zip(trees.feature, trees.threshold, trees.leaf):
        at = 0
        while at < len(feature):
            at = 2 * at + 1 + int(row[feature[at]] > threshold[at])
        total += leaf[at - len(feature)]
    return 1 / (1 + np.exp(-total))


def brute_scores(texts, docs, labels):
    """Scores of ``texts`` by trees fitted to the labelled rows of docs (id, text) that aren't held out."""
    known: dict[int, int] = {}
    for doc_id, quality in labels:
        if doc_id is not None and quality in (0, 1) and zlib.crc32(str(doc_id).encode()) % 5:
            known[doc_id] = min(quality, known.get(doc_id, 1))
    stats: dict[int, list[float]] = {}
    for doc_id, text in docs:
        if doc_id in known:
            of = [float(x) for x in op5_quality.document_statistics((text or "").encode())]
            stats[doc_id] = min(of, stats.get(doc_id, of))
    ids = sorted(stats)
    trees = boosted_trees.fit(np.array([stats[i] for i in ids]).reshape(len(ids), op5_quality.WIDTH), np.array([known[i] for i in ids], float))
    return [walked(trees, op5_quality.document_statistics((t or "").encode())) for t in texts]


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_near_duplicates(rows):
    """Rows of (id, text) without all but the smallest id of each group."""
    ids = sorted({i for i, _ in rows if i is not None})
    sets = [[shingles(t) for i, t in rows if i == x] for x in ids]
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)  # noqa: E731 - two empty sets are alike
    near = [(a, b) for a in range(len(ids)) for b in range(a) if any(alike(x, y) for x in sets[a] for y in sets[b])]
    kept = {ids[r] for r in roots(len(ids), near)}
    return [i is None or i in kept for i, _ in rows]


def brute_contaminated(text, items):
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    here = words(text)
    for item in items:
        w = words(item)
        m = min(10, len(w))
        windows = {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if m else set()
        if any(tuple(here[i : i + m]) in windows for i in range(len(here) - m + 1) if m):
            return True
    return False


def brute_tokens(texts):
    import tiktoken

    whole = tiktoken.Encoding("own", pat_str=pattern(), mergeable_ranks=read_ranks(path_of("byte_bpe_50k.tiktoken")), special_tokens={})
    return [whole.encode_ordinary(t or "") for t in texts]


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    labels = [(r["doc_id"], r["quality"]) for r in common.table(spark, sf_dir, "labels").collect()]
    benchmark = [r["text"] for r in common.table(spark, sf_dir, "benchmark").collect()]
    return labels, benchmark


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, Pii string, n_words int, hit_spans string, __score double, `a.b` int"


@pytest.fixture(scope="module")
def odd_docs(spark, sf_dir, tables):
    """Documents of the table among nulls, repeats, ties, near copies, passages, values; with columns whose names
    the operators use."""
    rng = random.Random(21)
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in common.table(spark, sf_dir, "documents").collect()]
    texts = [t for _, t, *_ in rows if t and len(t.split()) > 60][:30]
    passage = tables[1][0]
    more = [(None, texts[0]), (None, None), (10_000, None), (10_001, ""), (10_002, " \n"), (10_003, texts[1]), (10_003, texts[1]), (10_003, "other words under one id")]
    for k, t in enumerate(texts[2:12]):
        words = t.split()
        words[rng.randrange(len(words))] = "altered"
        more.append((10_010 + k, " ".join(words)))
    more += [(10_030, texts[12] + " " + passage.upper() + " end"), (10_031, texts[13] + " one@mail.example Zyxwo " + " +49 30 1234567"), (10_032, texts[14] * 200)]
    rows += [(i, t, "en", "made") for i, t in more]
    whole = [(i, t, lang, source, len(t or ""), f"p{k}", k, "s", 0.5, k) for k, (i, t, lang, source) in enumerate(rows)]
    return spark.createDataFrame(whole, SCHEMA).repartition(6)


def listed(df):
    return [tuple(r) for r in df.collect()]


def test_stages_equal_brute_force(spark, sf_dir, odd_docs, tables):
    labels, benchmark = tables
    key = lambda r: r[5]  # noqa: E731 - the column Pii tells rows apart
    docs = odd_docs

    def staged(name):
        out = common.materialize(STAGES[name](spark, docs, sf_dir), name)
        assert out.columns == odd_docs.columns
        return out

    rows = listed(docs)
    scores = brute_scores([r[1] for r in rows], [(r[0], r[1]) for r in rows], labels)
    docs = staged("quality")
    assert sorted(listed(docs), key=key) == sorted((r for r, s in zip(rows, scores) if s >= 0.3), key=key) and docs.count() < len(rows)

    rows = listed(docs)
    kept = brute_near_duplicates([(r[0], r[1]) for r in rows])
    docs = staged("near_duplicates")
    assert sorted(listed(docs), key=key) == sorted((r for r, k in zip(rows, kept) if k), key=key) and docs.count() < len(rows)

    rows = listed(docs)
    docs = staged("decontaminate")
    assert sorted(listed(docs), key=key) == sorted((r for r in rows if not brute_contaminated(r[1], benchmark)), key=key)
    assert docs.count() < len(rows)

    rows = listed(docs)
    spans = brute_pii([r[1] for r in rows])
    clean = [r[1] if not s else op10_pii.sanitise(r[1], s) for r, s in zip(rows, spans)]
    docs = staged("pii")
    want = [(r[0], t, *r[2:4], None if t is None else len(t), *r[5:]) for r, t in zip(rows, clean)]
    assert sorted(listed(docs), key=key) == sorted(want, key=key) and any(spans)

    rows = listed(docs)
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["ids"], r["n_tokens"], r["decoded_sha256"]) for r in STAGES["byte_bpe"](spark, docs, sf_dir).collect())
    ids = brute_tokens([r[1] for r in rows])
    assert got == sorted((r[0] is not None, r[0] or 0, i, len(i), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r, i in zip(rows, ids))


def test_run_is_the_stages_in_order(spark, sf_dir, tables):
    labels, benchmark = tables
    rows = [(r["doc_id"], r["text"]) for r in common.table(spark, sf_dir, "documents").collect()]
    rows = [r for r, s in zip(rows, brute_scores([t for _, t in rows], rows, labels)) if s >= 0.3]
    rows = [r for r, k in zip(rows, brute_near_duplicates(rows)) if k]
    rows = [r for r in rows if not brute_contaminated(r[1], benchmark)]
    clean = [t if not s else op10_pii.sanitise(t, s) for (_, t), s in zip(rows, brute_pii([t for _, t in rows]))]
    want = sorted((i, ids) for (i, _), ids in zip(rows, brute_tokens(clean)))
    assert sorted((r["doc_id"], r["ids"]) for r in corpus_pipeline.run(spark, sf_dir).collect()) == want


def test_quality_query_rebuilt(spark, sf_dir, tables):
    rows = [(r["doc_id"], r["text"]) for r in common.table(spark, sf_dir, "documents").collect()]
    scores = brute_scores([t for _, t in rows], rows, tables[0])
    got = {r["doc_id"]: r for r in op5_quality.op5_quality(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for (doc_id, _), score in zip(rows, scores):
        r = got[doc_id]
        assert r["score"] == pytest.approx(score, abs=1e-12) and r["predicted"] == int(score >= 0.3)
        assert r["held_out"] == (zlib.crc32(str(doc_id).encode()) % 5 == 0)


def test_quality_of_repeated_ids_and_conflicting_labels(spark):
    """The lowest label and the least statistics of an id count, whatever the order."""
    rng = random.Random(2)
    good, bad = "A sentence of plain words, and another one. ", "$$$ %%% buy "
    docs = [(i, (good if i % 2 else bad) * rng.randint(1, 9)) for i in range(300)] + [(7, bad), (9, good * 30)]
    labels = [(i, i % 2, 0) for i in range(300)] + [(7, 0, 0), (8, 1, 0), (None, 1, 0), (11, None, 0)]
    for seed in (1, 2):
        random.Random(seed).shuffle(docs)
        random.Random(seed).shuffle(labels)
        a = spark.createDataFrame(docs, "doc_id long, text string")
        stats, known = op5_quality.training_rows(a, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), 1000)
        trees = boosted_trees.fit(stats, known)
        got = {(r["doc_id"], r["text"]): r["score"] for r in op5_quality.score(a, trees).collect()}
        want = brute_scores([t for _, t in docs], docs, [x[:2] for x in labels])
        assert all(got[d] == pytest.approx(s, abs=1e-12) for d, s in zip(docs, want))


def test_ids_are_left_out_by_broadcast_and_by_bits(spark):
    rows = [(i if i % 11 else None, f"t{i}", 1.5) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` double").repartition(5)
    ids = spark.range(0, 3000, 3).toDF("doc_id").union(spark.createDataFrame([(99_999,)], "doc_id long"))
    want = sorted((r for r in rows if r[0] is None or r[0] % 3), key=lambda r: r[1])
    for most in (1 << 20, 10):
        out = common.without_ids(df, "doc_id", ids, most)
        assert out.columns == df.columns and sorted(map(tuple, out.collect()), key=lambda r: r[1]) == want


def test_empty_tables(spark, sf_dir):
    docs = spark.createDataFrame([], common.table(spark, sf_dir, "documents").schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() == 0 and (name == "byte_bpe" or out.columns == docs.columns)


def test_scratch_is_dropped(spark, sf_dir):
    """What run() leaves are the last stage's input and, as the result is read from it, nothing else."""
    before = common.shared_folder(spark)
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.get(spark.sparkContext._jsc.hadoopConfiguration())
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{before}/corpusloom")
    tables = lambda: {f.getPath().getName() for f in fs.listStatus(path)}
    old = tables()
    corpus_pipeline.run(spark, sf_dir).agg(F.count(F.lit(1))).collect()
    left = {x.rpartition("-")[0] for x in tables() - old}
    assert left <= {"stage-pii", "gone", "pii-terms"}
