"""The registered queries that SQL can't express, against plain Python over the smallest tables."""

from __future__ import annotations

import difflib
import hashlib
import math
import re
import unicodedata
from collections import Counter
from urllib.parse import urlsplit

import pytest

from corpusloom.plans import catalog
from corpusloom.registry import table

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return sorted(tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text", "source", "n_chars").collect())


def run(spark, sf_dir, name):
    return [r.asDict() for r in QUERIES[name](spark, sf_dir).collect()]


def words(text):
    """Runs of letters, numbers and low lines in lower case."""
    return re.findall(r"\w+", "".join(c if c == "_" or unicodedata.category(c)[0] in "LN" else " " for c in text.lower()))


def grams(text, n):
    w = words(text)
    return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}


def rank(*parts):
    return hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()


def test_every_query_without_sql_is_tested_here():
    here = open(__file__, encoding="utf-8").read()
    assert [n for n in QUERIES if n not in SQL and f'"{n}"' not in here] == []


def test_greedy_near_dedup(spark, sf_dir, docs):
    sets = {i: grams(t, 8) for i, t, *_ in docs}
    first = {}
    for i, g in sets.items():
        if len(g):
            first.setdefault(frozenset(g), i)
    short = [i for i, g in sets.items() if not g]
    ids = sorted([*first.values(), *short])
    kept: list[int] = []
    for i in ids:
        if not sets[i] or not any(len(sets[i] & sets[j]) >= 0.8 * min(len(sets[i]), len(sets[j])) for j in kept if sets[j]):
            kept.append(i)
    assert sorted(r["doc_id"] for r in run(spark, sf_dir, "d05_greedy_near_dedup")) == kept and len(kept) < len(ids) and short


def test_paragraphs_of_kept_documents(spark, sf_dir, docs):
    kept, seen = [], set()
    for i, text, *_ in docs:
        own = {p for p in (re.sub(r"[ \t\n\r\f]+", " ", line).strip(" ") for line in text.split("\n")) if len(p) >= 200}
        if not own & seen:
            kept.append(i)
            seen |= own
    assert sorted(r["doc_id"] for r in run(spark, sf_dir, "d02_paragraph_dedup_of_kept")) == kept


def test_sequence_ratios(spark, sf_dir):
    turns = {(r["conv_id"], r["turn"]): r["text"] for r in table(spark, sf_dir, "conversations").collect()}
    want = {}
    for (c, t), x in turns.items():
        y = turns.get((c, t + 1))
        if y is not None and len(x) + len(y) and 2 * min(len(x), len(y)) / (len(x) + len(y)) >= 0.5:
            want[c, t] = round(difflib.SequenceMatcher(None, x, y, autojunk=False).ratio(), 6)
    got = {(r["conv_id"], r["turn"]): r["ratio"] for r in run(spark, sf_dir, "d07_sequence_ratio")}
    assert got == pytest.approx(want, abs=1e-6)


def test_verified_candidates(spark, sf_dir, docs):
    items = {r["item_id"]: r["text"] for r in table(spark, sf_dir, "benchmark").collect()}
    of_items = {i: grams(t, 3) for i, t in items.items()}
    want = []
    for d, text, *_ in docs:
        shared = Counter({i: n for i, g in of_items.items() if (n := len(g & grams(text, 3)))})
        x = " ".join(words(text))
        exact = {i for i, t in items.items() if x and " ".join(words(t)) == x}
        for i in {i for i, _ in sorted(shared.items(), key=lambda p: (-p[1], p[0]))[:10]} | exact:
            ratio = difflib.SequenceMatcher(None, x, " ".join(words(items[i]))).ratio()
            if i in exact or ratio >= 0.65:
                want.append((d, i, i in exact, round(ratio, 3)))
    got = sorted((r["doc_id"], r["item_id"], r["exact"], r["similarity"]) for r in run(spark, sf_dir, "j07_verified_candidates"))
    assert got == sorted(want)


def test_capped_greedy_select(spark, sf_dir, docs):
    seen, want = Counter(), set()
    for i, text, source, n in sorted(docs, key=lambda r: (rank("greedy", r[0]), r[0])):
        a, b = (source, "a", (words(text) or [""])[0]), (source, "b", math.floor(math.log10(n + 1) * 4))
        if seen[a] < 2 and seen[b] < 3:
            seen.update([a, b])
            want.add((source, i))
    assert {(r["category"], r["doc_id"]) for r in run(spark, sf_dir, "k08_capped_greedy_select")} == want


def test_host_cap_greedy(spark, sf_dir):
    used, want = Counter(), set()
    for r in sorted(table(spark, sf_dir, "pages").collect(), key=lambda r: (rank("host", r["page_id"]), r["page_id"])):
        host = re.sub(r"^www\.", "", (urlsplit(r["url"]).netloc.partition(":")[0]).lower())
        if used[host] + len(r["html"]) <= 20000:
            used[host] += len(r["html"])
            want.add((r["page_id"], host))
    assert {(r["page_id"], r["host"]) for r in run(spark, sf_dir, "k09_host_cap_greedy")} == want


def test_rouge_l(spark, sf_dir):
    from corpusloom.plans.scoring import answers

    want = {}
    for r in answers(spark, sf_dir).collect():
        a, b = list(r["gold"]), list(r["predicted"])
        row = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                row[i + 1][j + 1] = row[i][j] + 1 if x == y else max(row[i][j + 1], row[i + 1][j])
        want[r["item_id"]] = round(2 * row[-1][-1] / max(1, len(a) + len(b)), 6)
    assert {r["item_id"]: r["rouge_l"] for r in run(spark, sf_dir, "m04_rouge_l")} == want


def test_buffered_shuffle(spark, sf_dir):
    source: dict[str, list[int]] = {}
    for r in sorted(table(spark, sf_dir, "documents").select("doc_id", "lang").collect()):
        source.setdefault(r["lang"] or "und", []).append(r["doc_id"])
    got: dict[str, list] = {}
    for r in sorted(tuple(x.values()) for x in run(spark, sf_dir, "t01_buffered_shuffle")):
        got.setdefault(r[0], []).append(r[1:])
    assert set(got) == set(source)
    for lang, rows in got.items():
        assert [place for place, *_ in rows] == list(range(len(source[lang])))
        assert sorted(at for _, at, _ in rows) == list(range(len(rows))) and all(source[lang][at] == i and abs(place - at) <= 256 for place, at, i in rows)


def test_online_near_dedup(spark, sf_dir, docs):
    from pyspark.sql import functions as F

    from corpusloom.streaming import online_dedup

    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("rank"), "text")
    keys: dict[int, set] = {i: set() for i, *_ in docs}
    for r in online_dedup.keys_of(rows).collect():
        keys[r["rank"]].add(r["key"])
    sets, kept, taken = {i: grams(t, 8) for i, t, *_ in docs}, [], set()
    for i, *_ in docs:
        alone, pairs = ({k for k in keys[i] if (k[0] == "a") == pair} for pair in (False, True))
        if alone & taken or any(pairs & keys[j] and len(sets[i] & sets[j]) >= 0.8 * min(len(sets[i]), len(sets[j])) for j in kept):
            continue
        kept.append(i)
        taken |= alone
    assert sorted(r["doc_id"] for r in run(spark, sf_dir, "t02_online_near_dedup")) == kept and len(kept) < len(docs)


def test_paired_interval(spark, sf_dir):
    import numpy as np

    of: dict[int, list] = {}
    for r in table(spark, sf_dir, "lineitem").collect():
        of.setdefault(r["l_orderkey"], []).append(float(r["l_discount"]) - float(r["l_tax"]))
    means = np.array([sum(x) / len(x) for x in of.values()])
    rng = np.random.default_rng(1)
    boots = np.sort([means[rng.integers(0, len(means), len(means))].mean() for _ in range(10_000)])
    (got,) = run(spark, sf_dir, "m07_paired_interval")
    assert got["n"] == len(means) and got["mean"] == pytest.approx(means.mean(), abs=1e-7) and got["wins"] + got["losses"] + got["ties"] == len(means)
    # two sets of 10,000 resamples: ends agree within the noise of their order statistics
    assert abs(got["low"] - boots[250]) < 0.1 * means.std() / len(means) ** 0.5 and abs(got["high"] - boots[9750]) < 0.1 * means.std() / len(means) ** 0.5
