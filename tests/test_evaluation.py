"""Scores and audits in full, against plain Python."""

from __future__ import annotations

import math
import random
import re
import string
import time
from collections import Counter

import pytest

from corpusloom.operators import answers, masks, meta_text
from corpusloom.sources import lines as numbered


def normal(x):
    x = re.sub(r"\b(a|an|the)\b", " ", (x or "").lower())
    return " ".join(x.translate(str.maketrans("", "", string.punctuation)).split())


def test_squad_scores(spark):
    rows = [
        (1, ["The red house", "a house"], "red house!"), (2, ["one two three"], "two three four"), (3, [], "Unanswerable."), (4, [], "something"),
        (5, None, None), (6, ["the"], "an"), (7, ["x"], ""), (8, ["a b b c", "b"], "b b"), (9, ["word"], "unanswerable"), (10, [None, "ok"], "OK"),
    ]
    want = {}
    for i, golds, said in rows:
        p, golds = normal(said), golds or []
        refused = p in ("", *answers.REFUSALS)
        em, f1 = (int(refused), float(refused)) if not golds else (0, 0.0)
        for g in golds:
            a, b = p.split(), normal(g).split()
            shared = sum((Counter(a) & Counter(b)).values())
            em, f1 = max(em, int(p == normal(g))), max(f1, float(a == b) if not a or not b else 2 * shared / (len(a) + len(b)))
        want[i] = (bool(golds), refused, em, pytest.approx(f1), int(bool(golds) != refused), int(em == 0 and f1 >= 0.5))
    df = spark.createDataFrame(rows, "id long, golds array<string>, said string")
    got = answers.squad_scores(df, "id", "golds", "said")
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want
    summary = answers.squad_summary(got).first()
    assert summary["n"] == 10 and summary["n_answerable"] == 7 and summary["exact_unanswerable"] == pytest.approx(2 / 3)
    assert answers.squad_summary(got.where("false")).first()["exact"] is None


def sentence(gold, said):
    grams = lambda x, n: Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1))
    logs, missed, hits = [], 0, 0
    for n in range(1, 5):
        a, b = grams(said, n), grams(gold, n)
        total, shared = sum(a.values()), sum((a & b).values())
        if total:
            missed += shared == 0
            hits += shared
            logs.append(math.log(shared / total if shared else 1 / (2**missed * total)))
    bleu = 100 * math.exp(sum(logs) / len(logs)) * (math.exp(1 - len(gold) / len(said)) if len(said) < len(gold) else 1) if hits else 0.0
    ps, qs = [], []
    for n in range(1, 7):
        a, b = grams("".join(said), n), grams("".join(gold), n)
        if a and b:
            shared = sum((a & b).values())
            ps.append(shared / sum(a.values()))
            qs.append(shared / sum(b.values()))
    p, q = (sum(x) / len(x) if x else 0.0 for x in (ps, qs))
    return bleu, 500 * p * q / (4 * p + q) if p + q else 0.0


def test_sentence_scores(spark):
    rng = random.Random(1)
    rows = [(0, ["a"], []), (1, [], ["a"]), (2, [], []), (3, ["abc"], ["xyz"]), (4, ["the", "cat"], ["the", "cat"]), (5, list("abcdefgh"), list("abdcefgh"))]
    rows += [(i, [rng.choice(["aa", "ab", "ba", "é"]) for _ in range(rng.randint(1, 20))], [rng.choice(["aa", "ab", "ba", "é"]) for _ in range(rng.randint(1, 20))]) for i in range(6, 40)]
    df = spark.createDataFrame(rows, "id long, gold array<string>, said array<string>")
    got = {r["id"]: (r["bleu"], r["chrf"]) for r in answers.sentence_scores(answers.gram_matches(df, "id", "gold", "said"), "id").collect()}
    assert got == {i: pytest.approx(sentence(g, p)) for i, g, p in rows}


def test_label_faults(spark):
    spans = [("prompt", 0, 4, False), ("answer", 4, 9, True), ("gap", 9, 9, False), ("end_of_turn", 9, 12, True), ("tail", 12, 13, False)]
    cuts = [(0, 2), (2, 4), (4, 6), (6, 9), (9, 12), (12, 13)]
    ids, labels = [1, 2, 3, 4, 5, 6], [-100, -100, 3, 4, 5, -100]
    rows = {
        "fine": (spans, cuts, ids, labels, 5),
        "straddles": (spans, [(0, 2), (2, 5), (5, 6), *cuts[3:]], ids, labels, 5),
        "prompt": (spans, cuts, ids, [1, *labels[1:]], 5),
        "masked": (spans, cuts, ids, [-100, -100, -100, 4, 5, -100], 5),
        "wrong": (spans, cuts, ids, [-100, -100, 9, 4, 5, -100], 5),
        "end": (spans, cuts, ids, labels, 7),
        "two ends": (spans, [*cuts[:4], (9, 10), (10, 12), (12, 13)], [*ids, 7], [-100, -100, 3, 4, 5, 6, -100], 5),
        "cut": (spans, cuts[:4], ids[:4], labels[:4], 5),
        "unmapped": (spans, [*cuts[:3], (6, 6), *cuts[4:]], ids, labels, 5),
        "beyond": (spans, [*cuts, (13, 14)], [*ids, 9], [*labels, -100], 5),
        "unlike": (spans, cuts, ids, labels[:3], 5),
        "all masked": (spans, cuts, ids, [-100] * 6, 5),
        "empty": ([], [], [], [], 5),
    }
    df = spark.createDataFrame([(k, *v) for k, v in rows.items()], "id string, spans array<struct<region:string,start:int,end:int,supervised:boolean>>, offsets array<struct<start:int,end:int>>, ids array<int>, labels array<int>, end_id int")
    got = {r["id"]: (r["tokens"], r["supervised"], r["faults"]) for r in masks.label_faults(df, 7).collect()}
    assert got == {
        "fine": (6, 3, []), "straddles": (6, 3, ["straddles", "prompt_supervised"][:1]), "prompt": (6, 4, ["prompt_supervised"]), "masked": (6, 2, ["answer_masked"]), "wrong": (6, 3, ["wrong_label"]),
        "end": (6, 3, ["end_of_turn"]), "two ends": (7, 4, ["end_of_turn"]), "cut": (4, 2, ["end_of_turn", "truncated"]), "unmapped": (6, 3, ["unmapped"]),
        "beyond": (7, 3, ["unmapped"]), "unlike": (0, 0, ["misaligned"]), "all masked": (6, 0, ["answer_masked", "nothing_supervised"]),
        "empty": (0, 0, ["end_of_turn", "nothing_supervised"]),
    }
    assert {r["faults"][-1] for r in masks.label_faults(df.where("id = 'fine'"), 5).collect()} == {"truncated"}


def test_meta_text(spark):
    text = "\n".join([
        "see the references here", "model_revision = 3", "the tokenizer revision is pinned", "```", "import helper_lib", "a review_helper", "```", "import helper_lib",
        "`helper_lib` is quoted", "not part of model input", "reviewer and Reviews", "previews are fine", "x" * 5000 + " review",
    ])
    rows = [(1, text, ["helperlib"]), (2, None, None), (3, "", []), (4, "```\nhelper_lib", None)]
    got = meta_text.findings(spark.createDataFrame(rows, "id long, text string, roots array<string>"), terms=r"revisions?|references?|reviews?|reviewer|helper_lib", meta=r"not part of model input")
    assert sorted((r["line"], r["term"], r["status"]) for r in got.where("id = 1").collect()) == [
        (1, "references", "assess"), (2, "model_revision", "allowed"), (3, "revision", "allowed"), (5, "helper_lib", "allowed"), (6, "review_helper", "assess"), (8, "helper_lib", "assess"),
        (9, "helper_lib", "allowed"), (10, "not part of model input", "block"), (11, "Reviews", "assess"), (11, "reviewer", "assess"), (13, "review", "assess"),
    ]
    assert [(r["line"], r["status"]) for r in got.where("id <> 1").collect()] == [(2, "assess")]


def test_numbered_lines_of_files_larger_than_a_split(spark, tmp_path):
    rng = random.Random(2)
    texts = {}
    for name, n in (("a.tsv", 900), ("b.tsv", 1), ("empty.tsv", 0), ("c.tsv", 300)):
        rows = [rng.choice(["", "# note", f"r{i}\tx\t{'é' * rng.randint(0, 40)}", f"r{i}\ttwo"]) for i in range(n)]
        content = "\n".join(rows) + ("\n" if rng.random() < 0.5 and rows else "")
        texts[name] = content.split("\n")
        (tmp_path / name).write_bytes(content.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("700b", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = numbered.numbered_lines(spark, f"file://{tmp_path}/*.tsv")
            found = sorted((r["file"].rsplit("/", 1)[1], r["line"], r["value"]) for r in got.collect())
            want = sorted((name, i, x) for name, rows in texts.items() for i, x in enumerate(rows, 1) if not (i == len(rows) and x == ""))
            assert found == want
            faults = numbered.positional_faults(got, 3, "r[0-9]+")
            bad = sorted((name, i) for name, i, x in want if x.strip() and x[0] != "#" and (x.count("\t") != 2 or not re.fullmatch("r[0-9]+", x.split("\t")[0])))
            assert sorted((r["file"].rsplit("/", 1)[1], r["line"]) for r in faults.collect()) == bad and bad
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    first = min(bad)
    with pytest.raises(ValueError, match=f"{first[0]}:{first[1]}: "):
        numbered.read_positional(spark, f"file://{tmp_path}/*.tsv", ["id", "x", "y"], "r[0-9]+")
    (tmp_path / "fine.txt").write_text("# c\n\nr1\tb\tc\nr2\t\t\n")
    fine = numbered.read_positional(spark, f"file://{tmp_path}/fine.txt", ["id", "x", "y"], "r[0-9]+")
    assert sorted(tuple(r)[1:] for r in fine.collect()) == [(3, "r1", "b", "c"), (4, "r2", "", "")]


def test_label_masks_of_long_turns_take_one_pass(spark, tmp_path):
    """Tokens looked up in an array that is made anew for each token take minutes here."""
    from corpusloom.plans import catalog

    text = "word, " * 1_500
    spark.createDataFrame([(i, k, "user", text) for i in range(40) for k in range(3)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    since = time.monotonic()
    got = catalog.queries()["v10_label_mask_faults"](spark, str(tmp_path)).collect()
    assert len(got) == 80 and {r["tokens"] for r in got} == {9_010, 9_008, 9_007} and time.monotonic() - since < 60
    assert all("truncated" in r["faults"] for r in got)
