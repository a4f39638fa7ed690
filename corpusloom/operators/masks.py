"""Audit of training labels: which tokens are supervised, against the character spans that should be."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

IGNORE = -100
FAULTS = ("misaligned", "unmapped", "straddles", "prompt_supervised", "answer_masked", "wrong_label", "end_of_turn", "nothing_supervised", "truncated")


def label_faults(df: DataFrame, limit: int) -> DataFrame:
    """df(id, spans array<struct<region, start, end, supervised>>, offsets array<struct<start, end>>, ids array<int>, labels
    array<int>, end_id) -> id, tokens, supervised, faults: an array of those of FAULTS, in their order.

    Spans and tokens are two sorted lists of intervals, merged by position: a token belongs to the last span that begins
    at or before it, and straddles where supervision changes inside it. Tokens without characters or spans are
    unmapped. Tokens of masked spans must be labelled -100, others with their id; there must be one token in the
    region ``end_of_turn``, the last supervised one, and it must be ``end_id``; the last span must be covered and the row
    must hold at most ``limit`` tokens. Lists of unlike lengths are misaligned, and nothing else is said of them.
    """
    sizes = (F.size("offsets") == F.size("labels")) & (F.size("ids") == F.size("labels"))
    spans = df.select("id", F.explode("spans").alias("s")).where(F.col("s.start") < F.col("s.end"))
    before = Window.partitionBy("id").orderBy("pos")
    spans = spans.select("id", F.col("s.start").alias("pos"), F.col("s.end").alias("stop"), F.col("s.region").alias("region"), F.col("s.supervised").alias("on"))
    changes = F.when(F.lag("on").over(before) != F.col("on"), F.col("pos"))
    marks = spans.withColumn("change", changes).select("id", "pos", F.lit(0).alias("kind"), "stop", "region", "on", "change", *[F.lit(None).cast("int").alias(c) for c in ("i", "token", "label")])
    zipped = F.arrays_zip("offsets", "ids", "labels")
    tokens = df.where(sizes).select("id", F.posexplode(zipped).alias("i", "t"))
    tokens = tokens.select(
        "id", F.col("t.offsets.start").alias("pos"), F.lit(1).alias("kind"), F.col("t.offsets.end").alias("stop"), F.lit(None).cast("string").alias("region"),
        F.lit(None).cast("boolean").alias("on"), F.lit(None).cast("int").alias("change"), "i", F.col("t.ids").alias("token"), F.col("t.labels").alias("label"),
    )
    merged = marks.unionByName(tokens)
    back = Window.partitionBy("id").orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0)
    # a change at the token's own start lies before it in this order, so it isn't inside
    ahead = Window.partitionBy("id").orderBy(F.desc("pos"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    of = lambda c: F.last(F.when(F.col("kind") == 0, F.struct(c)), ignorenulls=True).over(back)[c]
    placed = merged.select("*", of("on").alias("own"), of("region").alias("of"), of("stop").alias("until"), F.last("change", ignorenulls=True).over(ahead).alias("next")).where("kind = 1")
    on = F.coalesce("own", F.lit(False))
    unmapped = (F.col("pos") >= F.col("stop")) | F.col("own").isNull() | (F.col("until") <= F.col("pos"))
    end = F.col("of") == "end_of_turn"
    told = placed.groupBy("id").agg(
        F.count(F.lit(1)).alias("tokens"),
        F.count(F.when(F.col("label") != IGNORE, 1)).alias("supervised"),
        F.max(unmapped).alias("unmapped"),
        F.max((F.col("next") < F.col("stop")) & ~unmapped).alias("straddles"),
        F.max(~on & (F.col("label") != IGNORE)).alias("prompt_supervised"),
        F.max(on & (F.col("label") == IGNORE)).alias("answer_masked"),
        F.max(on & (F.col("label") != IGNORE) & (F.col("label") != F.col("token"))).alias("wrong_label"),
        F.count(F.when(end, 1)).alias("ends"),
        F.max(F.when(end, F.col("token"))).alias("end_token"),
        F.max("stop").alias("covered"),
    )
    rows = df.select("id", "end_id", (~sizes).alias("misaligned"), F.size("offsets").alias("n"), F.array_max(F.transform("spans", lambda s: s["end"])).alias("length"))
    j = rows.join(told, "id", "left")
    whole = ~F.col("misaligned")
    flags = {
        "misaligned": F.col("misaligned"),
        **{c: whole & F.coalesce(c, F.lit(False)) for c in ("unmapped", "straddles", "prompt_supervised", "answer_masked", "wrong_label")},
        "end_of_turn": whole & ~F.coalesce((F.col("ends") == 1) & (F.col("end_token") == F.col("end_id")), F.lit(False)),
        "nothing_supervised": whole & (F.coalesce("supervised", F.lit(0)) == 0),
        "truncated": whole & ((F.col("n") > limit) | (F.coalesce("covered", F.lit(0)) < F.coalesce("length", F.lit(0)))),
    }
    faults = F.filter(F.array(*[F.when(flags[k], F.lit(k)) for k in FAULTS]), lambda x: x.isNotNull())
    return j.select("id", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"), F.coalesce("supervised", F.lit(0)).cast("long").alias("supervised"), faults.alias("faults"))
