"""Literal cases and invariants of the operators."""

from __future__ import annotations

import itertools
import os
import json
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as t
from corpusloom.operators import aggregates, dedup, graph, quality, sampling, scoring, windows
from corpusloom.operators.budget import budgeted
from corpusloom.sources import readers


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_normalisers_tell_letters_apart(spark):
    assert one(spark, t.norm_turkish("a"), a="İI") == "iı"
    assert one(spark, t.norm_words("a"), a="kar, KAR kâr") == "kar kar kâr"
    assert one(spark, t.norm_answer("a"), a="The  cat, a (dog)!") == "cat dog"
    assert one(spark, t.nfkc_casefold("a"), a="ﬁ  Straße") == "fi strasse"
    assert one(spark, t.norm_numbers("a"), a="On 12 May, 3.5!") == "on <num> may <num> <num>"


def test_ngrams_of_short_texts_are_empty(spark):
    assert one(spark, t.ngrams(t.words("a"), 3), a="one two") == []
    assert one(spark, t.ngrams(t.words("a"), 2), a="a b a b") == ["a b", "b a"]


def test_stats_of_known_values(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "v double")
    r = aggregates.stats_linear(df, "v").first()
    assert (r["n"], r["mean"], r["median"]) == (3, 2.0, 2.0)
    assert r["std_pop"] == pytest.approx((2 / 3) ** 0.5) and r["std_samp"] == pytest.approx(1.0)
    assert aggregates.stats_linear(df.where("v > 9"), "v").first()["n"] == 0


def test_diversity_of_two_equal_categories(spark):
    df = spark.createDataFrame([("a",)] * 5 + [("b",)] * 5, "c string")
    r = aggregates.diversity(df, "c", []).first()
    assert r["effective"] == pytest.approx(2.0) and r["largest"] == 0.5


def test_cascade_counts_every_row_once(spark):
    df = spark.range(100)
    out = quality.cascade(df, [("even", F.col("id") % 2 == 0), ("third", F.col("id") % 3 == 0)]).groupBy("reason").count()
    assert {r["reason"]: r["count"] for r in out.collect()} == {"even": 50, "third": 17, "kept": 33}


def test_repeated_tail(spark):
    assert one(spark, quality.repeated_tail(F.split("a", " ")), a="x y z z z z") is True
    assert one(spark, quality.repeated_tail(F.split("a", " ")), a="x y z z z") is False


def test_ordered_prefix_equals_sequential_sum(spark):
    rows = [(i, i % 7 + 1) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, v long")
    out = windows.ordered_prefix(df, F.sha2(F.col("id").cast("string"), 256), F.col("v"), "before", "id")
    import hashlib

    ordered = sorted(rows, key=lambda r: (hashlib.sha256(str(r[0]).encode()).hexdigest(), r[0]))
    want, total = {}, 0
    for i, v in ordered:
        want[i] = total
        total += v
    assert {r["id"]: r["before"] for r in out.collect()} == want


def test_split_shares_and_largest_remainder(spark):
    df = spark.range(200).select("id", (F.col("id") % 4).alias("g"))
    out = sampling.stratified_split(df, ["g"], "id", {"a": 0.1, "b": 0.2}, "s").groupBy("split").count()
    assert {r["split"]: r["count"] for r in out.collect()} == {"a": 20, "b": 40, "train": 140}
    shares = spark.createDataFrame([("x", 1.0), ("y", 1.0), ("z", 1.0)], "n string, w double")
    assert sorted(r["quota"] for r in sampling.largest_remainder(shares, "n", "w", 10).collect()) == [3, 3, 4]


def test_greedy_keep_is_the_sequential_rule(spark):
    rng = random.Random(5)
    pairs = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(90)})
    kept: set[int] = set()
    for i in range(60):
        if not any((j, i) in set(pairs) for j in kept):
            kept.add(i)
    nodes, near = spark.range(60).withColumnRenamed("id", "rank"), spark.createDataFrame(pairs, "low long, high long")
    for rounds in (0, 1, 2, 30):  # by rounds, in order, and both
        out = dedup.greedy_keep(nodes, dedup.pair_members(near), rounds)
        assert {r["rank"] for r in out.collect()} == kept


def test_greedy_keep_of_long_chains(spark):
    """Versions each near the next, and each near the next two: one kept in two, and one in three."""
    chain = [(i, i + 1) for i in range(999)] + [(2000 + i, 2000 + i + k) for i in range(997) for k in (1, 2)]
    nodes = spark.range(3000).withColumnRenamed("id", "rank").where("rank < 1000 or rank between 2000 and 2998")
    out = dedup.greedy_keep(nodes, dedup.pair_members(spark.createDataFrame(chain, "low long, high long")), 2)
    assert sorted(r["rank"] for r in out.collect()) == [*range(0, 1000, 2), *range(2000, 2999, 3)]


def test_greedy_keep_by_keys(spark):
    rng = random.Random(8)
    members = sorted({(rng.randrange(200), f"k{rng.randrange(120)}") for _ in range(300)})
    held = {i: {k for j, k in members if j == i} for i in range(200)}
    kept, taken = set(), set()
    for i in range(200):
        if not held[i] & taken:
            kept.add(i)
            taken |= held[i]
    for rounds in (1, 8):
        out = dedup.greedy_keep(spark.range(200).withColumnRenamed("id", "rank"), spark.createDataFrame(members, "rank long, key string"), rounds)
        assert {r["rank"] for r in out.collect()} == kept


def test_mcnemar_and_bootstrap_identities(spark):
    same = spark.createDataFrame([(True, True)] * 10, "a boolean, b boolean")
    assert scoring.mcnemar(same, "a", "b").first()["statistic"] is None
    ones = spark.createDataFrame([(i, 1.0) for i in range(50)], "id long, v double")
    assert {r["mean"] for r in scoring.bootstrap(ones, "v", "id", 20).collect()} == {1.0}


def test_closure_and_cycles(spark):
    edges = lambda *x: spark.createDataFrame(list(x), "id long, parent long")
    out = graph.closure(edges((2, 1), (3, 2), (4, 3)))
    assert {(r["id"], r["ancestor"]) for r in out.collect()} == {(a, b) for a, b in itertools.product(range(1, 5), repeat=2) if a > b}
    for loop in (edges((1, 2), (2, 1)), edges((1, 1)), edges((1, 2), (2, 3), (3, 4), (4, 1), (9, 1))):
        with pytest.raises(ValueError, match="cycle"):
            graph.closure(loop)


@pytest.mark.parametrize("levels", [40, 3])
def test_closure_equals_walks(spark, levels):
    edges = {(i, i // k) for i in range(200) for k in (2, 3) if i // k >= 1} | {(300, 301), (400, 1)}
    up = {}
    for i in sorted({i for i, _ in edges}, key=lambda i: (i == 300, i)):
        parents = {p for j, p in edges if j == i}
        up[i] = parents.union(*(up.get(p, set()) for p in parents))
    df = spark.createDataFrame(sorted(edges) * 2, "id long, parent long")
    got = [tuple(r) for r in graph.closure(df, max_levels=levels).collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, a) for i, x in up.items() for a in x}
    assert graph.closure(df.where("false")).count() == 0


def test_closure_hands_a_list_on_once_an_edge(spark):
    """No path is joined to paths: the rows that joins make are in proportion to edges."""
    edges = spark.createDataFrame([(i, i // k) for i in range(1, 3_000) for k in (2, 3) if i // k >= 1], "id long, parent long")
    seen = []
    write, graph.checkpointed = graph.checkpointed, lambda df: (seen.append(out := write(df)), out)[1]
    try:
        n = graph.closure(edges).count()
        assert max(x.count() for x in seen if os.path.exists(x._scratch_path.removeprefix("file://"))) < n / 4
    finally:
        graph.checkpointed = write


def test_conflicts_of_several_files(spark):
    tasks = plan(spark, ("a", ["x", "y", "z"], []), ("b", ["Y", "./x"], []), ("c", ["x", "w"], ["a"]), ("d", ["w", "q", "w"], []), ("e", None, []))
    assert sorted(tuple(r) for r in graph.conflicts(tasks).collect()) == [("a", "b", ["x", "y"]), ("b", "c", ["x"]), ("c", "d", ["w"])]


def plan(spark, *rows):
    whole = [(k, *r) for k, r in enumerate(rows)]
    return spark.createDataFrame(whole, "place int, id string, implementation_files array<string>, depends_on array<string>")


def test_conflicts(spark):
    tasks = plan(spark, ("later", ["shared.py"], ["first"]), ("independent", ["other.py"], []), ("first", ["shared.py"], []))
    assert graph.conflicts(tasks).count() == 0
    tasks = plan(spark, ("base", ["base.py"], []), ("left", ["same.py"], ["base"]), ("right", ["same.py"], ["base"]), ("other", ["other.py"], []))
    assert [tuple(r) for r in graph.conflicts(tasks).collect()] == [("left", "right", ["same.py"])]
    tasks = plan(spark, ("a", ["src\\same.py"], []), ("b", ["other.py"], ["a"]), ("c", ["src/./SAME.py"], ["b"]))
    assert graph.conflicts(tasks).count() == 0
    for bad, said in (
        (plan(spark, ("a", ["x.py"], ["missing"])), "unknown"),
        (plan(spark, ("a", ["x.py"], ["b"]), ("b", ["y.py"], ["a"])), "cycle"),
        (plan(spark, ("a", ["x.py"], []), ("a", ["y.py"], [])), "duplicate"),
    ):
        with pytest.raises(ValueError, match=said):
            graph.conflicts(bad).count()


def test_normal_paths(spark):
    import posixpath

    for path in ("src\\same.py", "src/./same.py", "a//b/../C.py", "../x", "./a/../../b", "/a/../b", "a/b/..", "A"):
        assert one(spark, graph.normal_path(F.col("a")), a=path) == posixpath.normpath(path.replace("\\", "/")).lower(), path


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)]
    parent = {n: n for e in edges for n in e}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: root(n) for n in parent if any(n in e and e[0] != e[1] for e in edges)}


def test_value_row_number_of_hot_groups_and_values(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([5, 5, 5, 5, 1, 9, None]), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, v long, id long")
    got = {r["id"]: (r["i"], r["n"]) for r in windows.value_row_number(df, ["g"], F.col("v"), "id", "i", "n").collect()}
    for g in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [got[r[2]] for r in own] == [(k + 1, len(own)) for k in range(len(own))]


def test_running_sums_and_ranks(spark):
    import hashlib

    rows = [(i, "a" if i % 3 else "b", i % 11 + 1) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, g string, v long")
    got = {r["id"]: r["c"] for r in windows.hash_running_sum(df, ["g"], F.sha2(F.col("id").cast("string"), 256), "id", "v", "c").collect()}
    for g in "ab":
        total = 0
        for i, _, v in sorted((r for r in rows if r[1] == g), key=lambda r: hashlib.sha256(str(r[0]).encode()).hexdigest()):
            total += v
            assert got[i] == total
    ranks = {r["id"]: r["r"] for r in windows.tie_corrected_rank(df, ["g"], "v", "r").collect()}
    for i, g, v in rows:
        less, same = sum(x[1] == g and x[2] < v for x in rows), sum(x[1] == g and x[2] == v for x in rows)
        assert ranks[i] == less + (same + 1) / 2


def test_greedy_caps_equal_the_sequential_rules(spark):
    rng = random.Random(4)
    rows = [(rng.choice("st"), i, rng.choice("abcde") if rng.random() < 0.7 else f"w{i}", rng.randrange(4), f"{rng.random():.9f}") for i in range(1500)]
    out = sampling.doubly_capped(spark.createDataFrame(rows, "category string, doc_id long, a string, b long, h string"), 2, 3)
    want, seen = set(), {}
    for c, i, a, b, _ in sorted(rows, key=lambda r: (r[4], r[1])):
        if seen.get((c, a), 0) < 2 and seen.get((c, b), 0) < 3:
            seen[c, a], seen[c, b] = seen.get((c, a), 0) + 1, seen.get((c, b), 0) + 1
            want.add((c, i))
    assert {tuple(r) for r in out.collect()} == want
    pages = [(i, rng.choice(["x", "x", "x", "y", "z", None]), rng.choice([1, 5, 30, 90, 200, 5000]), f"{rng.random():.9f}") for i in range(700)]
    df = spark.createDataFrame(pages, "page_id long, host string, n long, h string")
    used, want = {}, set()
    for i, host, n, _ in sorted(pages, key=lambda r: (r[3], r[0])):
        if used.get(host, 0) + n <= 1000:
            used[host] = used.get(host, 0) + n
            want.add((i, host))
    assert {tuple(r) for r in budgeted(df, "host", "page_id", "n", "h", 1000).collect()} == want


def test_longest_common_subsequence():
    from corpusloom.plans.scoring import lcs

    rng = random.Random(9)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 30))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert lcs(a, b) == table[-1][-1]


def test_sections(spark):
    text = "before\n=== g1\n@@USER\n\n hi \n\\=== not one\n\\\\@@x\n@@FLAGS\nlow|a|b|c\nodd\n=== g2\n@@USER\n=== g1\n@@USER\nx\n@@USER\ny"
    parsed = readers.parse_sections(spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "no header")], "id long, t string"), "id", "t")
    rows = [(r["id"], r["place"], r["section"], [tuple(f) for f in r["fields"]]) for r in parsed.orderBy("id", "place").collect()]
    assert rows == [
        (1, 0, "g1", [("USER", "hi \n=== not one\n\\@@x"), ("FLAGS", "low|a|b|c\nodd")]),
        (1, 1, "g2", [("USER", "")]),
        (1, 2, "g1", [("USER", "x"), ("USER", "y")]),
    ]
    assert [tuple(r)[3:] for r in readers.section_flags(parsed, "id").collect()] == [("low", "a", "b|c"), ("odd", None, None)]
    faults = sorted((r["section"], r["fault"]) for r in readers.section_faults(parsed, "id", ["USER"]).collect())
    assert faults == [("g1", "bad flag"), ("g1", "repeated field"), ("g1", "repeated section"), ("g2", "empty USER")]
    for value in ("=== a\n@@b", "\\=== a", "x\n\\\\@@y\n===z"):
        assert one(spark, readers.escaped_lines("a"), a=value).replace("\\===", "===").replace("\\@@", "@@") != ""
        whole = spark.createDataFrame([(1, value)], "id long, v string").select("id", F.concat(F.lit("=== s\n@@F\n"), readers.escaped_lines("v")).alias("t"))
        assert readers.parse_sections(whole, "id", "t").first()["fields"][0]["value"] == value


def test_archives_are_the_same_bytes_and_faults_show(spark):
    rows = [(f"d/{i}.txt", f"text {i}" * i) for i in range(30)]
    df = spark.createDataFrame(rows, "name string, content string")
    one_, two = (sorted((r["archive"], bytes(r["data"])) for r in readers.pack_archives(x, "name", "content", 4).collect()) for x in (df, df.repartition(7)))
    assert one_ == two and len(one_) == 4
    declared = df.select("name", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))
    odd = declared.where("name <> 'd/3.txt'").withColumn("size", F.when(F.col("name") == "d/5.txt", 1).otherwise(F.col("size")))
    odd = odd.union(spark.createDataFrame([("gone", 1, "x")], "name string, size long, sha256 string"))
    got = {r["name"]: r["ok"] for r in readers.verify_archives(readers.pack_archives(df, "name", "content", 4), odd).collect()}
    assert got == {n: n not in ("d/3.txt", "d/5.txt", "gone") for n in [*(r[0] for r in rows), "gone"]}


def test_schema_drift():
    from pyspark.sql.types import _parse_datatype_string as header

    from corpusloom.plans.review import schema_drift

    assert schema_drift(header("a int, b string"), header("a int, b string")) == []
    assert schema_drift(header("b string, a long, c int"), header("a int, b string, d int")) == [
        ("a", "place", "0", "1"), ("a", "type", "int", "bigint"), ("b", "place", "1", "0"), ("c", "extra", None, "int"), ("d", "missing", "int", None),
    ]


def test_anchor_verdicts(spark):
    """Templates beyond the count, near copies and others, against all pairs; and one anchor pair that all share."""
    rng = random.Random(10)
    rows = []
    for i in range(120):
        grams = rng.sample(range(1000), 20) if i % 3 else [*range(18), 5000 + i, 6000 + i] if i % 2 else [*range(10), *rng.sample(range(2000, 9000), 10)]
        anchors = sorted({f"{x:05d}" for x in grams})[:12]
        rows.append((i, [str(g) for g in grams], anchors))
    for most in (5, 30, 256):
        want = {}
        for i, g, a in rows:
            before = [r for r in rows if r[0] < i and len(set(r[2]) & set(a)) >= 2]
            near = any(len(set(r[1]) & set(g)) >= 0.8 * min(len(r[1]), len(g)) for r in before)
            want[i] = (min(len(before), most + 1), "template" if len(before) > most else "near" if near else "kept")
        got = dedup.anchor_verdicts(spark.createDataFrame(rows, "doc_id long, g array<string>, anchors array<string>"), most)
        assert {r["doc_id"]: (r["candidates"], r["verdict"]) for r in got.collect()} == want


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n{"x": 2}\n{bad\n{"x": 3}\n')
    (tmp_path / "b.jsonl").write_text('{"x": 9}\n\n')
    path = f"file://{tmp_path}"
    loose = readers.read_jsonl(spark, path, "x long", strict=False)
    assert sorted(r["x"] for r in loose.collect() if r["_bad"] is None) == [1, 2, 3, 9]
    assert sorted(r["x"] for r in readers.read_jsonl_until_bad(spark, path, "x long").collect()) == [1, 2, 9]
    with pytest.raises(Exception, match="MALFORMED|bad|Malformed"):
        readers.read_jsonl(spark, path, "x long").collect()


def test_operators_on_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert sampling.top_by_hash(empty, 3, "s", "doc_id").count() == 0
    assert quality.cascade(empty, [("x", quality.is_prose("text"))]).count() == 0
    assert dedup.greedy_keep(spark.createDataFrame([], "rank long"), spark.createDataFrame([], "rank long, key string")).count() == 0
    assert dedup.anchor_verdicts(spark.createDataFrame([], "doc_id long, g array<string>, anchors array<string>")).count() == 0
    assert windows.value_row_number(empty, ["lang"], F.col("n_chars"), "doc_id", "i").count() == 0
    assert budgeted(spark.createDataFrame([], "id long, g string, n long, h string"), "g", "id", "n", "h", 9).count() == 0
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_prompts_anywhere_in_a_tree(spark):
    chat = {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "no"}, {"role": "user", "content": ["no"]}, "no"]}
    trees = {
        1: {"x": {"y": [{"prompt": "deep"}, [[{"user": "deeper", "question": 5}]]]}},
        2: [chat, {"run": {"list": [chat, {"question": "q"}]}}],
        3: {"messages": {"prompt": "not walked"}, "user_prompt": "top"},
        4: "prompt",
    }
    rows = [(i, json.dumps(x)) for i, x in trees.items()] + [(5, None), (6, "{bad"), (7, '{"user": "\\ud800"}')]
    got = readers.harvest_prompts(spark.createDataFrame(rows, "id long, j string"), "id", "j").collect()
    assert sorted(tuple(r) for r in got) == [(1, "deep"), (1, "deeper"), (2, "a"), (2, "a"), (2, "q"), (3, "top"), (7, "�")]
