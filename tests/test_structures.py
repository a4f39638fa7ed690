"""Operators that rest on an algorithm of their own, against brute force: budgets, percentiles, resamples, similarity
joins by prefixes, suffix arrays, and streams with state."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import bootstrap, budget, dedup, quantiles, similarity, substrings
from corpusloom.sources import readers
from corpusloom.streaming import online_dedup, progress, shuffle


def digest(x) -> str:
    return hashlib.sha256(str(x).encode()).hexdigest()


# -- budgets


def test_budget_of_hot_and_adverse_groups(spark):
    rng, rows = random.Random(1), []
    for i in range(4000):
        group = "hot" if i % 3 else rng.choice(["a", "b", None, "c"])
        rows.append((i, group, rng.choice([0, 1, 3, 40, 400, 1000, 1001, 700]), digest(i)))
    # one small row between large ones that nearly fit, each a little smaller than the last
    order = sorted(digest(f"x{i}") for i in range(240))
    rows += [(10_000 + i, "falling", 1 if i % 2 == 0 else 1000 - i // 2, h) for i, h in enumerate(order)]
    rows += [(20_000, "a", None, digest("n")), (20_001, "a", -5, digest("m"))]
    used, want = Counter(), set()
    for i, group, n, _ in sorted((r for r in rows if r[2] is not None and r[2] >= 0), key=lambda r: (r[3], r[0])):
        if used[group] + n <= 1000:
            used[group] += n
            want.add((i, group))
    df = spark.createDataFrame(rows, "id long, g string, n long, h string")
    assert {tuple(r) for r in budget.budgeted(df, "g", "id", "n", "h", 1000).collect()} == want


def test_budget_rounds_follow_the_logarithm(spark, monkeypatch):
    rounds = []
    sums = budget.hash_running_sum
    monkeypatch.setattr(budget, "hash_running_sum", lambda *a: rounds.append(1) or sums(*a))
    df = spark.range(120_000).select("id", F.lit("one").alias("g"), (1 + F.col("id") % 3).alias("n"), F.sha2(F.col("id").cast("string"), 256).alias("h"))
    kept = budget.budgeted(df, "g", "id", "n", "h", 200_003)
    got = kept.join(df, ["id", "g"]).agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n")).first()
    assert got["n"] == 200_003 and got["c"] >= 100_000 and len(rounds) <= 20


# -- percentiles


@pytest.mark.parametrize("few", [4, 2048])
def test_percentiles_of_many_different_values(spark, few):
    rng = random.Random(2)
    rows = [("all", rng.gauss(0, 1e6) * rng.choice([1e-9, 1, 1e9])) for _ in range(6000)]
    rows += [("ties", float(rng.choice([1, 2, 2, 2, 5]))) for _ in range(3000)] + [(None, float(i)) for i in range(7)] + [("one", 4.0), ("none", None), ("all", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    of = defaultdict(list)
    for g, v in rows:
        if v is not None:
            of[g].append(v)
    places = lambda n: [F.floor((n - 1) * 0.1), F.floor(n / 2), n - 1, F.lit(0)]
    found = defaultdict(dict)
    for r in quantiles.select_ranks(df, "v", ["g"], places, few).collect():
        found[r["g"]][r["place"]] = r["v"]
        assert r["n"] == len(of[r["g"]])
    assert {g: {p: sorted(x)[p] for p in {math.floor((len(x) - 1) * 0.1), len(x) // 2, len(x) - 1, 0}} for g, x in of.items()} == found
    got = {r["g"]: (r["p10"], r["m"]) for r in quantiles.linear(df, "v", {"p10": 0.1, "m": 0.5}, ["g"]).collect()}
    assert set(got) == set(of)
    for g, x in of.items():
        assert got[g] == pytest.approx(tuple(np.percentile(x, [10, 50])), rel=1e-9)
    assert quantiles.select_ranks(df.where("false"), "v", ["g"], places).count() == 0
    whole = quantiles.linear(df, "v", {"m": 0.5}, []).first()
    assert whole["m"] == pytest.approx(np.percentile([v for _, v in rows if v is not None], 50))


# -- resamples


def test_resamples_are_multinomial_and_reproducible(spark):
    sizes, resamples = [5, 0, 12, 1, 30, 2, 0, 7], 4000
    counts = np.array([bootstrap.slice_counts(7, sizes, i, resamples) for i in range(len(sizes))])
    n = sum(sizes)
    assert (counts.sum(0) == n).all() and (counts[1] == 0).all()
    share = np.array(sizes) / n
    assert np.abs(counts.mean(1) - n * share).max() < 0.25 and np.abs(counts.var(1) - n * share * (1 - share)).max() < 1.2
    drawn = counts[4]
    parts = [bootstrap.slice_sums(7, 4, np.arange(30.0), drawn, most) for most in (1, 100, 1 << 20)]
    for got in parts:
        assert got.mean() == pytest.approx(14.5 * drawn.mean(), rel=0.02)
    rows = [(f"g{i % 37}", float(i % 11) - 4) for i in range(500)] + [(None, 1.0), ("g1", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    first, again = (bootstrap.paired_interval(x, "g", "v", 800, slices=8).first() for x in (df, df.repartition(7)))
    means = [np.mean([v for g, v in rows if g == f"g{i}" and v is not None]) for i in range(37)]
    assert first["n"] == 37 and first["mean"] == pytest.approx(np.mean(means)) and first["low"] < first["mean"] < first["high"]
    assert (first["low"], first["high"]) == pytest.approx((again["low"], again["high"]))
    # the same counts and draws in plain numpy
    unit = {f"g{i}": m for i, m in enumerate(means)}
    place = {r["u"]: r["s"] for r in spark.createDataFrame([(u,) for u in unit], "u string").select("u", F.pmod(F.xxhash64("u"), F.lit(8)).alias("s")).collect()}
    of = [np.array([unit[u] for u in sorted(unit) if place[u] == s]) for s in range(8)]
    total = sum(bootstrap.slice_sums(3407, s, v, bootstrap.slice_counts(3407, [len(x) for x in of], s, 800)) for s, v in enumerate(of) if len(v))
    boots = np.sort(total / 37)
    assert (first["low"], first["high"]) == pytest.approx((boots[20], boots[780]))
    assert bootstrap.paired_interval(df.where("false"), "g", "v", 10).count() == 0


# -- similarity joins


def weights_of(texts):
    df = Counter(w for t in texts.values() for w in set(t))
    out = {}
    for i, t in texts.items():
        raw = {w: (1 + math.log(c)) * (math.log((1 + len(texts)) / (1 + df[w])) + 1) for w, c in Counter(t).items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        out[i] = {w: x / norm for w, x in raw.items()}
    return out


def zipf_texts(n, seed=3):
    rng = random.Random(seed)
    out = {}
    for i in range(n):
        own = [f"w{min(int(rng.paretovariate(0.6)), 5000)}" for _ in range(rng.randint(3, 40))] + ["the"] * 5
        if i and rng.random() < 0.3:
            own = list(out[rng.randrange(i)])
            own[rng.randrange(len(own))] = f"x{i}"
        out[i] = own
    return out


@pytest.mark.parametrize("least", [0.3, 0.8])
def test_cosine_pairs(spark, least):
    weights = weights_of(zipf_texts(150))
    df = spark.createDataFrame([(i, t, w) for i, x in weights.items() for t, w in x.items()], "key long, term string, w double")
    want = {}
    for i, x in weights.items():
        for j, y in weights.items():
            if i < j and (c := sum(w * y.get(t, 0) for t, w in x.items())) >= least:
                want[i, j] = c
    got = {(r["a"], r["b"]): r["cosine"] for r in similarity.cosine_pairs(df, least).collect()}
    assert got == pytest.approx(want) and len(want) > 5
    assert similarity.cosine_pairs(df.where("false"), least).count() == 0


def test_cosine_candidates_grow_with_the_rows(spark, monkeypatch):
    """Unlike texts that share stop words: what is compared doubles with the table, it doesn't quadruple."""
    made = []
    keep = similarity.checkpointed
    monkeypatch.setattr(similarity, "checkpointed", lambda df: made.append(keep(df)) or made[-1])
    sizes = []
    for n in (150, 300):
        texts = {i: [f"t{i}x{k}" for k in range(12)] + [f"n{i // 2}"] * 2 + ["the", "of", "and"] for i in range(n)}
        made.clear()
        df = spark.createDataFrame([(i, t, w) for i, x in weights_of(texts).items() for t, w in x.items()], "key long, term string, w double")
        drops, similarity_drop = [], similarity.drop
        monkeypatch.setattr(similarity, "drop", lambda *f: drops.extend(f))
        similarity.cosine_pairs(df, 0.5).count()
        monkeypatch.setattr(similarity, "drop", similarity_drop)
        sizes.append(made[1].count())
        similarity_drop(*drops)
    assert sizes[1] <= 2.2 * max(1, sizes[0])


@pytest.mark.parametrize("k,first", [(1, 1), (3, 4), (7, 2)])
def test_nearest_by_jaccard(spark, k, first):
    texts = {i: sorted(set(t)) for i, t in zipf_texts(160, 5).items()}
    asking = {i: t for i, t in texts.items() if i % 4 == 0} | {1000: ["the"], 1001: ["nowhere"], 1002: []}
    rows = {i: t for i, t in texts.items() if i % 4} | {2000: []}
    want = set()
    for a, x in asking.items():
        scored = [(len(set(x) & set(y)) / len(set(x) | set(y)), b) for b, y in rows.items() if set(x) & set(y)]
        want |= {(a, b, round(j, 9)) for j, b in sorted(scored, key=lambda p: (-p[0], p[1]))[:k]}
    left = spark.createDataFrame(list(asking.items()), "a long, g array<string>")
    right = spark.createDataFrame(list(rows.items()), "b long, g array<string>")
    assert {(r[0], r[1], round(r[2], 9)) for r in similarity.nearest_by_jaccard(left, right, k, first).collect()} == want
    assert similarity.nearest_by_jaccard(left, right.where("false"), k).count() == 0
    assert similarity.nearest_by_jaccard(left.where("false"), right, k).count() == 0


# -- suffix arrays


def test_suffix_array_and_search():
    rng = random.Random(4)
    for text in ["", "a", "aaaaaaaa", "banana\0bandana", "".join(rng.choice("ab\U0001f600é") for _ in range(300))]:
        starts = substrings.suffix_array(text)
        assert sorted(starts.tolist(), key=lambda i: text[i:]) == starts.tolist()
        for _ in range(200):
            i, n = rng.randint(0, len(text)), rng.randint(0, 8)
            part = text[i : i + n] if rng.random() < 0.6 else "".join(rng.choice("abn\U0001f600é") for _ in range(n))
            assert substrings.stands_in(text, starts, part) == (part in text and bool(text or part == text and text)) or not part


def test_containment_where_all_lines_begin_alike(spark):
    rng = random.Random(5)
    items = [f"the {rng.choice('abc')} the same start {i} {'x' * (i % 7)}" for i in range(60)] + [None, "", "Ünïcode \U0001f600 end"]
    lines = [f"the {rng.choice('abcd')} the same start {rng.randint(0, 80)} {'x' * rng.randint(0, 8)}" for _ in range(300)]
    lines += ["the", "\U0001f600 e", "e\0U", None, "start 5 xxxxx", "zz"]
    texts = spark.createDataFrame([(x,) for x in items], "x string")
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    for most in (50, 1 << 20):
        got = df.select("line", substrings.contained(spark, F.col("line"), texts, "x", most).alias("hit")).collect()
        assert [(r[0], r[1]) for r in got] == [(x, None if x is None else any(x in i for i in items if i is not None)) for x in lines]
    assert df.where(substrings.contained(spark, F.col("line"), texts.where("false"), "x")).count() == 0


# -- streams


def files(spark, rows, schema, size):
    path = readers.scratch(spark, "in")
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], schema).coalesce(1).write.mode("append").parquet(path)
    return path


def sequential_shuffle(shard, values, size, limit):
    held, out = [], []

    def give():
        oldest = min(held)
        row = oldest if oldest[0] + size <= len(out) else held[shuffle.draw("s", shard, len(out), len(held))]
        place = held.index(row)
        held[place] = held[-1]
        held.pop()
        out.append(row)

    for i, v in enumerate(values[:limit]):
        held.append((i, v))
        if len(held) > size:
            give()
    while held:
        give()
    return [(shard, p, i, v) for p, (i, v) in enumerate(out)]


def test_bounded_shuffle(spark):
    schema, size, limit = "shard string, seq long, end boolean, v string", 5, 33
    values = {"a": [f"a{i}" for i in range(40)], "b": [f"b{i}" for i in range(12)], "c": []}
    rows = sorted(((s, i, False, v) for s, x in values.items() for i, v in enumerate(x)), key=lambda r: r[1])
    ends = [(s, 10**9, True, None) for s in values]
    want = sorted(r for s, x in values.items() for r in sequential_shuffle(s, x, size, limit))
    assert all(abs(p - i) <= size for _, p, i, _ in want) and [p for *_, p in want] != [p for *_, p in sorted(want, key=lambda r: (r[0], r[2]))]
    for per in (11, 100):
        path, out = files(spark, rows, schema, per), readers.scratch(spark, "out")
        spark.createDataFrame(ends, schema).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        shuffled = shuffle.bounded_shuffle(stream, "shard", "seq", "end", "s", size, limit)
        query = shuffled.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-c").trigger(availableNow=True).start()
        query.awaitTermination()
        assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == want


def test_online_dedup_of_any_cut_and_after_a_stop(spark):
    rng = random.Random(6)
    word = lambda: f"w{rng.randint(0, 900)}"
    paragraph = " ".join(word() for _ in range(60))
    rows = []
    for i in range(60):
        text = " ".join(word() for _ in range(40))
        if i % 5 == 4:
            text = rows[rng.randrange(i)][1] or text
        if i % 7 == 6:
            own = (rows[i - 1][1] or text).split(" ")
            own[len(own) // 2] = "changed"
            text = " ".join(own)
        if i % 9 == 8:
            text = f"{text}\n{paragraph}"
        rows.append((i, None if i in (20, 21) else "" if i in (22, 23) else text))
    df = spark.createDataFrame(rows, "rank long, text string")
    keys = defaultdict(set)
    for r in online_dedup.keys_of(df.where("text is not null")).collect():
        keys[r["rank"]].add(r["key"])
    grams = {r["rank"]: set(r["g"]) for r in online_dedup.grams(df.where("text is not null"), ["rank"]).collect()}
    want, taken = [], set()
    for i, _ in rows:
        alone = {k for k in keys[i] if k[0] != "a"}
        near = any({k for k in keys[i] & keys[j] if k[0] == "a"} and len(grams[i] & grams[j]) >= 0.8 * min(len(grams[i]), len(grams[j])) for j in want)
        if not alone & taken and not near:
            want.append(i)
            taken |= alone
    assert {20, 21, 22} <= set(want) and 23 not in want and len(want) < 50
    for size, per, stop in ((60, 1, None), (25, 1, 1)):
        source, out = files(spark, rows, online_dedup.SOURCE, size), readers.scratch(spark, "kept")
        if stop is not None:
            with pytest.raises(Exception, match="stopped before batch"):
                online_dedup.run(spark, source, out, per, stop_after=stop)
        assert sorted(r[0] for r in online_dedup.run(spark, source, out, per).collect()) == want


def test_progress_after_a_failure(spark):
    path, out = files(spark, [(i,) for i in range(30)], "v long", 10), readers.scratch(spark, "out")
    stream = lambda: spark.readStream.schema("v long").option("maxFilesPerTrigger", 1).parquet(path)

    def fail(batch, number):
        if number == 1:
            raise RuntimeError("no room")

    with pytest.raises(Exception, match="no room"):
        progress.append(stream(), out, {"model": "m"}, fail)
    failed = progress.manifest(spark, out)
    assert (failed["status"], failed["count"], failed["batches"], failed["model"]) == ("failed", 10, 1, "m") and failed["error"]
    done = progress.append(stream(), out, {"model": "m"})
    assert (done["status"], done["count"], done["batches"], done["error"]) == ("completed", 30, 3, None)
    assert progress.manifest(spark, out)["status"] == "completed"
    assert sorted(r["v"] for r in spark.read.parquet(f"{out}/rows").collect()) == list(range(30))
    assert [tuple(r) for r in progress.rollup(spark, out, 12).orderBy("batch").collect()] == [(0, 10, 0), (1, 20, 1), (2, 30, 1)]
    again = progress.append(stream(), out, {"model": "m"})
    assert (again["status"], again["count"]) == ("completed", 30)


def test_greedy_keep_still_equals_the_scan(spark):
    nodes = spark.range(3).withColumnRenamed("id", "rank")
    assert dedup.greedy_keep(nodes, spark.createDataFrame([], "rank long, key string")).count() == 3
