"""Scores of answers against one or several references: exact match and F1, BLEU and chrF by sentence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from .scoring import bag_overlap

#: fixed values: answers, normalised, that decline to answer
REFUSALS = ("cevaplanamaz", "unanswerable")


def squad_scores(df: DataFrame, key: str, golds: str, predicted: str) -> DataFrame:
    """(key, answerable, refused, exact, f1, answerability_correct, low_exact_high_f1) of a prediction and an array of golds.

    Texts are normalised (case, articles, signs, white space). With golds, the best of them counts; without, a
    refusal (a marker, or nothing) is right. A null prediction is empty; null golds are none. F1 is of bags of words, and
    of an empty side only 1 if both are.
    """
    said = t.norm_answer(F.coalesce(F.col(predicted), F.lit("")))
    rows = df.select(F.col(key).alias("k"), F.coalesce(golds, F.array().cast("array<string>")).alias("g"), said.alias("said"))
    words = lambda x: F.filter(F.split(x, " "), lambda w: w != "")
    each = rows.select("k", "said", F.posexplode("g").alias("i", "gold")).withColumn("gold", t.norm_answer(F.coalesce("gold", F.lit(""))))
    pairs = each.select("k", "i", (F.col("gold") == F.col("said")).cast("int").alias("em"), words(F.col("said")).alias("a"), words(F.col("gold")).alias("b"))
    o = bag_overlap(pairs, ["k", "i"], "a", "b").join(pairs.select("k", "i", "em"), ["k", "i"])
    both = F.when((F.col("a_size") == 0) | (F.col("b_size") == 0), (F.col("a_size") == F.col("b_size")).cast("double"))
    f1 = both.otherwise(2.0 * F.col("shared") / (F.col("a_size") + F.col("b_size")))
    best = o.groupBy("k").agg(F.max("em").alias("em"), F.max(f1).alias("f"))
    refused = (F.col("said") == "") | F.col("said").isin(*REFUSALS)
    scored = rows.join(best, "k", "left").select(
        "k", (F.size("g") > 0).alias("answerable"), refused.alias("refused"), F.coalesce("em", refused.cast("int")).alias("exact"), F.coalesce("f", refused.cast("double")).alias("f1")
    )
    return scored.select(
        F.col("k").alias(key), "answerable", "refused", "exact", "f1",
        (F.col("answerable") != F.col("refused")).cast("int").alias("answerability_correct"),
        ((F.col("exact") == 0) & (F.col("f1") >= 0.5)).cast("int").alias("low_exact_high_f1"),
    )


def squad_summary(scores: DataFrame) -> DataFrame:
    """One row of counts and rates; rates of none are null."""
    of = lambda c, where=None: F.avg(F.col(c) if where is None else F.when(where, F.col(c)))
    yes = F.col("answerable")
    return scores.agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(yes, 1)).alias("n_answerable"), of("exact").alias("exact"), of("f1").alias("f1"),
        of("answerability_correct").alias("answerability"), of("exact", yes).alias("exact_answerable"), of("f1", yes).alias("f1_answerable"),
        of("exact", ~yes).alias("exact_unanswerable"), of("low_exact_high_f1").alias("low_exact_high_f1"),
    )


def _characters(text: Column, n: int) -> Column:
    last = F.length(text) - n + 1
    return F.when(last < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(n))))


def gram_matches(df: DataFrame, key: str, gold: str, predicted: str, words: int = 4, characters: int = 6) -> DataFrame:
    """(key, kind, n, shared, r, h) of the word n-grams (kind w) and the character n-grams without white space (kind c) of
    predictions and golds, both arrays of words, as bags: what they share, and how many the gold and the prediction have."""
    rows = df.select(F.col(key).alias("k"), F.col(gold).alias("g"), F.col(predicted).alias("p"), F.array_join(gold, "").alias("gc"), F.array_join(predicted, "").alias("pc"))
    parts = [("w", n, t.ngram_list(F.col("g"), n), t.ngram_list(F.col("p"), n)) for n in range(1, words + 1)]
    parts += [("c", n, _characters(F.col("gc"), n), _characters(F.col("pc"), n)) for n in range(1, characters + 1)]
    long = reduce(DataFrame.unionByName, [rows.select("k", F.lit(kind).alias("kind"), F.lit(n).alias("n"), a.alias("a"), b.alias("b")) for kind, n, a, b in parts])
    return bag_overlap(long, ["k", "kind", "n"], "a", "b").select(F.col("k").alias(key), "kind", "n", "shared", F.col("a_size").alias("r"), F.col("b_size").alias("h"))


def sentence_scores(matches: DataFrame, key: str, beta: float = 2.0) -> DataFrame:
    """(key, bleu, chrf) of 0 to 100 from ``gram_matches``.

    BLEU: orders that the prediction has; the i-th order without a match counts as one match of 2 ** i; brevity penalty;
    0 without any shared word. chrF: mean precision and recall over the orders that both sides have, F of ``beta``.
    """
    ordered = Window.partitionBy(key).orderBy("n")
    w = matches.where((F.col("kind") == "w") & (F.col("h") > 0)).withColumn("missed", F.sum((F.col("shared") == 0).cast("int")).over(ordered))
    p = F.when(F.col("shared") > 0, F.col("shared") / F.col("h")).otherwise(1.0 / (F.pow(F.lit(2.0), F.col("missed")) * F.col("h")))
    first = lambda c: F.max(F.when(F.col("n") == 1, F.col(c)))
    bleu = w.groupBy(key).agg(F.avg(F.log(p)).alias("mean"), F.sum("shared").alias("hits"), first("r").alias("r"), first("h").alias("h"))
    short = F.when(F.col("h") < F.col("r"), F.exp(1 - F.col("r") / F.col("h"))).otherwise(1.0)
    bleu = bleu.select(key, F.when(F.col("hits") > 0, 100 * short * F.exp("mean")).otherwise(0.0).alias("bleu"))
    c = matches.where((F.col("kind") == "c") & (F.col("h") > 0) & (F.col("r") > 0))
    means = c.groupBy(key).agg(F.avg(F.col("shared") / F.col("h")).alias("p"), F.avg(F.col("shared") / F.col("r")).alias("q"))
    b = beta * beta
    chrf = means.select(key, F.when(F.col("p") + F.col("q") > 0, 100 * (1 + b) * F.col("p") * F.col("q") / (b * F.col("p") + F.col("q"))).otherwise(0.0).alias("chrf"))
    return matches.select(key).distinct().join(bleu, key, "left").join(chrf, key, "left").fillna(0.0, ["bleu", "chrf"])
