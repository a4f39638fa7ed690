"""Row-quality predicates and the first-match-wins cascade. Each takes a text column and stays native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t


def length_band(c, low: int = 500, high: int = 20000) -> Column:
    return F.length(t.blank(c)).between(low, high)


def letter_ratio(c) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}]+", "")) / F.nullif(F.length(c), F.lit(0))


def is_prose(c, least_words: int = 120, least_spans: int = 4, span_words: int = 6) -> Column:
    spans = F.filter(t.sentences(c), lambda s: F.size(F.split(s, " ")) >= span_words)
    return (F.size(t.words(c)) >= least_words) & (F.size(spans) >= least_spans)


def navigation_heavy(found: Column, least_lines: int = 15, share: float = 0.6, short: int = 6) -> Column:
    """Of a column of lines (``text.lines``): many of them, and most of few words."""
    few = F.size(F.filter(found, lambda x: F.size(F.split(x, " ")) < short))
    return (F.size(found) >= least_lines) & (few > F.size(found) * share)


def repeated_lines(found: Column) -> Column:
    """Share of lines that repeat an earlier one; 0 without lines."""
    return F.coalesce(1 - F.size(F.array_distinct(found)) / F.nullif(F.size(found), F.lit(0)), F.lit(0.0))


def most_repeated(values: Column) -> Column:
    """How often the most frequent one of an array of numbers is in it; 0 if it is empty."""
    start = F.struct(F.lit(None).cast("bigint").alias("last"), F.lit(0).cast("bigint").alias("run"), F.lit(0).cast("bigint").alias("most"))

    def step(held: Column, x: Column) -> Column:
        run = F.when(held["last"] == x, held["run"] + 1).otherwise(F.lit(1).cast("bigint"))
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(held["most"], run).alias("most"))

    return F.aggregate(F.array_sort(values), start, step, lambda held: held["most"])


def cascade(df: DataFrame, rules: list[tuple[str, Column]], out: str = "reason", kept: str = "kept") -> DataFrame:
    """df with the name of the first rule that holds, or ``kept``. A null condition doesn't hold."""
    reason = None
    for name, condition in rules:
        reason = F.when(condition, name) if reason is None else reason.when(condition, name)
    return df.withColumn(out, F.lit(kept) if reason is None else reason.otherwise(kept))


def flags(*pairs: tuple[str, Column]) -> Column:
    """Names of all conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(condition, name) for name, condition in pairs]))


def repeated_tail(tokens: Column, widths=(1, 2, 4, 8), times: int = 4) -> Column:
    """Whether the last ``times`` blocks of some width are the same."""
    def loops(w: int) -> Column:
        last = F.slice(tokens, -w, w)
        same = [F.slice(tokens, -w * k, w) == last for k in range(2, times + 1)]
        out = same[0]
        for s in same[1:]:
            out = out & s
        return F.when(F.size(tokens) >= w * times, out).otherwise(F.lit(False))

    out = loops(widths[0])
    for w in widths[1:]:
        out = out | loops(w)
    return out
