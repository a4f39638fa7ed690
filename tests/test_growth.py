"""What queries shuffle and write, on tables made to show how it grows."""

from __future__ import annotations

import re
import tracemalloc
import unicodedata

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.llm import op13_ngram_join, slot_sketch
from corpusloom.operators import bootstrap, graph, similarity
from corpusloom.plans import catalog
from corpusloom.streaming import online_dedup


def moved(spark) -> int:
    """Bytes that all stages so far have shuffled and written."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() + stages.apply(i).outputBytes() for i in range(stages.size()))


def documents(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def against_sql(got, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    assert sorted(map(tuple, got)) == sorted(con.sql(catalog.oracle_sql()[name]).fetchall())


def test_cosine_pairs_meet_only_what_can_reach_the_threshold(spark):
    rest = F.sqrt(F.lit((1 - 0.36) / 2))
    parts = F.array(F.struct(F.lit("common").alias("term"), F.lit(0.6).alias("w")), *[F.struct(F.concat(F.lit(x), F.col("id").cast("string")).alias("term"), rest.alias("w")) for x in "xy"])
    weights = spark.range(1500).select(F.col("id").alias("key"), F.explode(parts).alias("p")).select("key", "p.*")
    before = moved(spark)
    assert similarity.cosine_pairs(weights, 0.5).count() == 0
    assert moved(spark) - before < 2e6


def test_vectors_of_alike_texts_are_not_moved_for_each_pair(spark, tmp_path, monkeypatch):
    rows = [(i, " ".join(f"c{j}" for j in range(2000) if (i * j) % 97 != 5)) for i in range(40)]
    rows += [(1000 + i, " ".join(f"d{j}" for j in range(5 * i, 5 * i + 12))) for i in range(30)]
    folder = documents(spark, tmp_path, rows + [(2000, None), (2001, ""), (2002, rows[0][1])])
    key, before = "spark.sql.autoBroadcastJoinThreshold", moved(spark)
    had = spark.conf.get(key)
    try:
        spark.conf.set(key, "-1")
        got = catalog.queries()["d08_document_cosine_pairs"](spark, folder).collect()
    finally:
        spark.conf.set(key, had)
    assert moved(spark) - before < 2e7 and len(got) > 700
    against_sql(got, folder, "d08_document_cosine_pairs")
    monkeypatch.setattr(similarity, "TILE", 5000)
    assert sorted(map(tuple, catalog.queries()["d08_document_cosine_pairs"](spark, folder).collect())) == sorted(map(tuple, got))


def test_repeated_grams_are_counted_in_their_rows(spark, tmp_path):
    line = "one two three four five six seven eight nine\n"
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(1500)) + " " + line * (i % 7)) for i in range(60)]
    folder = documents(spark, tmp_path, rows + [(3, line * 3), (4, line * 2), (70, None), (71, ""), (72, line * 5), (72, "short")])
    before = moved(spark)
    got = catalog.queries()["p07_repeated_ngram"](spark, folder).collect()
    assert moved(spark) - before < 2e5
    against_sql(got, folder, "p07_repeated_ngram")


def test_greedy_near_dedup_compares_an_alike_group_with_its_first(spark, tmp_path):
    base = " ".join(f"w{j}" for j in range(20))
    alike = [(i, f"{base} own{i}") for i in range(1500)]
    # a chain: each is like the next only; the second and the fourth go
    chain = [(5000 + i, " ".join(f"c{j}" for j in range(10 * i, 10 * i + 100))) for i in range(4)]
    odd = [(6000, None), (6001, ""), (6002, "one two"), (6003, "one two"), (6004, alike[0][1])]
    folder = documents(spark, tmp_path, alike + chain + odd)
    before = moved(spark)
    got = sorted(r["doc_id"] for r in catalog.queries()["d05_greedy_near_dedup"](spark, folder).collect())
    assert moved(spark) - before < 3e6
    grams = {i: {tuple(w[j : j + 8]) for j in range(len(w) - 7)} for i, w in ((i, (x or "").split()) for i, x in alike + chain + odd)}
    kept = []
    for i in sorted(grams):
        if all(len(grams[i] & grams[j]) < 0.8 * min(len(grams[i]), len(grams[j])) for j in kept if grams[i] and grams[j]):
            kept.append(i)
    assert got == kept and 6000 in kept and 5001 not in kept and 1 not in kept


def test_nearest_training_rows_shuffle_only_the_best(spark, tmp_path):
    common = [f"c{j}" for j in range(40)]
    rows = [(i, " ".join([*common[i % 5 : 20 + i % 21], *(f"r{i * j % 701}" for j in range(i % 30))])) for i in range(3000)]
    odd = [(7, "c1 c2 seven"), (4000, None), (4001, ""), (4002, "!")]
    items = [(f"q{i}", " ".join([*common[i % 7 :: 1 + i % 3], f"r{i}", f"own{i}"])) for i in range(60)] + [("none", "nowhere"), ("empty", ""), ("null", None)]
    folder = documents(spark, tmp_path, rows + odd)
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    before = moved(spark)
    got = catalog.queries()["j08_nearest_training_rows"](spark, folder).collect()
    assert moved(spark) - before < 5e5
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet/*.parquet')")
    want = con.sql(catalog.oracle_sql()["j08_nearest_training_rows"]).fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and len(got) == 180


def test_anchors_of_one_document_are_only_counted(spark, tmp_path):
    own = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    copies = [(1000 + i, f"{own(i // 3, 150)} end{i}") for i in range(15)]
    template = [(2000 + i, f"{own('t', 30)} {own(i, i % 3)}") for i in range(270)]
    rows = [(i, own(i, 150)) for i in range(800)] + copies + template
    folder = documents(spark, tmp_path, rows + [(3000, None), (3001, ""), (3002, "a b c d e")])
    before = moved(spark)
    got = catalog.queries()["d06_anchor_candidates"](spark, folder).collect()
    assert moved(spark) - before < 4e6
    assert {r["verdict"] for r in got} == {"kept", "near", "template"}
    against_sql(got, folder, "d06_anchor_candidates")


def normalised_in_small_batches(spark, tmp_path, name, plain):
    import hashlib

    texts = ["Straße\t ＡＢＣ ﬁ x", "  Plain  ASCII \n\x1c text ", "é É", "", None, " İ​"]
    folder = documents(spark, tmp_path, list(enumerate(texts)))
    bytes_key, rows_key = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.execution.arrow.maxRecordsPerBatch"
    had = {k: spark.conf.get(k) for k in (bytes_key, rows_key)}
    try:
        spark.conf.set(bytes_key, str(1 << 28))
        spark.conf.set(rows_key, "10000")
        got = {r["doc_id"]: r["h"] for r in catalog.queries()[name](spark, folder).collect()}
        assert int(spark.conf.get(bytes_key)) <= 16 << 20 and int(spark.conf.get(rows_key)) <= 2000
    finally:
        for k, v in had.items():
            spark.conf.set(k, v)
    assert got == {i: None if x is None else hashlib.sha256(plain(x).encode()).hexdigest() for i, x in enumerate(texts)}


def test_nfkc_folds_in_small_batches(spark, tmp_path):
    fold = lambda x: " ".join(unicodedata.normalize("NFKC", x).casefold().split())
    normalised_in_small_batches(spark, tmp_path, "n03_norm_nfkc_casefold_ws", fold)


def test_nfc_in_small_batches(spark, tmp_path):
    plain = lambda x: re.sub("[ \\t\\n\\r\\f]+", " ", unicodedata.normalize("NFC", x)).strip(" ")
    normalised_in_small_batches(spark, tmp_path, "n01_norm_nfc_ws", plain)


def test_few_texts_of_a_batch_are_python_strings_at_once():
    same, other = "é" * 8000, "e\u0301Ａ" * 4000
    for texts in ([same] * 2000, [other, None, "", "x"] * 500):
        batch = pa.array(texts, pa.string())
        for function, plain in ((text.nfc, lambda t: unicodedata.normalize("NFC", t)), (text.nfkc_casefold, lambda t: unicodedata.normalize("NFKC", t).casefold())):
            tracemalloc.start()
            out = function.func(batch)
            peak = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
            assert peak < 6e6, peak
            assert out.to_pylist() == [None if t is None else plain(t) for t in texts] and out.type == batch.type
    empty = pa.array([], pa.string())
    assert text.nfc.func(empty).to_pylist() == []


def test_resamples_of_few_distinct_values_cost_no_draw_for_each_row(monkeypatch):
    values, drawn = np.repeat([-1.0, 0.5, 2.0], [50_000, 30_000, 20_000]), np.full(300, 100_000)
    asked = []
    real = np.random.default_rng

    class Counting:
        def __init__(self, seed):
            self.rng = real(seed)

        def __getattr__(self, name):
            return lambda *a, **k: [out := getattr(self.rng, name)(*a, **k), asked.append(np.size(out))][0]

    monkeypatch.setattr(bootstrap.np.random, "default_rng", Counting)
    sums = bootstrap.slice_sums(7, 0, values, drawn)
    assert sum(asked) <= 3 * len(drawn)
    n, mean, sd = len(values), values.mean(), values.std()
    assert abs(sums.mean() - n * mean) < 4 * sd * (n / len(drawn)) ** 0.5 and abs(sums.std() / (sd * n**0.5) - 1) < 0.2


def test_one_call_answers_all_keys_of_a_bucket():
    class State:
        exists, get = True, (["a1:2", "a1:2", "tx"], [3, 4, 3])

        def update(self, held):
            self.exists, self.get = True, held

    state = State()
    frame = pd.DataFrame([("a1:2", 9, False), ("tx", 9, False), ("ty", 9, False), ("ty", 5, True), ("tx", 6, True), ("a1:2", 7, True)], columns=["key", "rank", "kept"])
    (out,) = online_dedup.answer((0,), iter([frame]), state)
    got = {(k, r, None if pd.isna(o) else int(o)) for k, r, o in out.itertuples(index=False)}
    assert got == {("a1:2", 9, x) for x in (None, 3, 4, 7)} | {("tx", 9, None), ("tx", 9, 3), ("ty", 9, None), ("ty", 9, 5)}
    assert sorted(zip(*state.get)) == [("a1:2", 3), ("a1:2", 4), ("a1:2", 7), ("tx", 3), ("ty", 5)]


def test_half_the_shingles_are_counted_and_no_alike_document_is_ruled_out(spark):
    own = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    # of 100 shingles each, 92 are in the other one, too: 92 / 108 = 0.852
    alike = [(i, f"{own(i // 2, 95)} {own(1000 + i, 8)}") for i in range(200)]
    alone = [(500 + i, own(5000 + i, 103)) for i in range(50)]
    df = spark.createDataFrame(alike + alone + [(900, ""), (901, None)], "row long, text string")
    counted = op13_ngram_join.document_counts(df, 4, 22).collect()
    assert 0.4 * 25_000 < sum(int(slot_sketch.unpack(r["counts"])[1].sum()) for r in counted) < 0.6 * 25_000
    got = op13_ngram_join.jaccard_components(df.withColumnRenamed("row", "doc_id"))
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()} == {
        *((i, 100, i - i % 2) for i, _ in alike), *((i, 100, i) for i, _ in alone), (900, 0, 900), (901, 0, 901),
    }


def test_alike_rows_of_a_batch_are_compared_with_the_kept_one(spark, tmp_path, monkeypatch):
    base = " ".join(f"w{j}" for j in range(400))
    rows = [(i, f"{base} own{i}") for i in range(150)] + [(500, "other words " * 9), (501, None), (502, ""), (503, "")]
    source = str(tmp_path / "in")
    for part in (rows[:100], rows[100:]):
        spark.createDataFrame(part, online_dedup.SOURCE).coalesce(1).write.mode("append").parquet(source)
    tried, near = [], online_dedup.near
    monkeypatch.setattr(online_dedup, "near", lambda pairs, docs: [tried.append(pairs.count()), near(pairs, docs)][1])
    got = sorted(r["rank"] for r in online_dedup.run(spark, source, str(tmp_path / "out"), 1).collect())
    assert got == [0, 500, 501, 502]
    assert sum(tried) < 300


def test_conflicts_of_one_file_are_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(graph, "SQUARE", 20, raising=False)
    rows = [(i, [i // 2] if i else [], ["a/b", "own" + str(i % 3)] if i % 4 else ["a/./B"]) for i in range(200)]
    got = graph.conflicts(spark.createDataFrame(rows, "id long, depends_on array<long>, implementation_files array<string>"))
    above = {0: set()}
    for i in range(1, 200):
        above[i] = {i // 2} | above[i // 2]
    files = [{"a/b"} | ({f"own{i % 3}"} if i % 4 else set()) for i in range(200)]
    want = sorted((i, j, sorted(files[i] & files[j])) for j in range(200) for i in range(j) if i not in above[j])
    tasks = got.withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r["left"], r["right"], r["files"]) for r in tasks) == want
    each = [sum(r["task"] == k for r in tasks) for k in {r["task"] for r in tasks}]
    assert len(each) > 8 and max(each) < len(want) / 8
