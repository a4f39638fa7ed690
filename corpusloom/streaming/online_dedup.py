"""Online deduplication: what later rows are held against grows with the rows that are kept, while the stream runs.

A row (rank, text) is dropped if a kept row of smaller rank has the same normalised text, a paragraph of 200
characters or more in common, or two of the smallest twelve hashes of word 8-grams (anchors) and, on comparison, 0.8 or more
of the smaller one's 8-grams. Rows must come in batches of ascending rank; how they are cut is of no account.

Of each row a batch makes its hashes: of the text, of paragraphs, and its anchors. What the rows that it keeps have of them is
written, and read by the batches after it; only hashes that a batch's own rows have are shuffled, and of anchors those
that two of these rows or kept ones have. So a batch costs its rows and a scan of what has been kept. Rows that one of
earlier batches takes go first. Then, by rounds, the open rows that are the first of all their keys are kept, each is
compared with the others of its keys, and the alike go: of a group of alike texts one is compared with each. What is open
after ``ROUNDS`` is compared in pairs, and rounds of ``greedy_keep`` decide, which equals the scan in order of rank.
All output of a batch lies in folders of its number, which a
repeated batch replaces; offsets and state are in the checkpoint folder; so a run can stop anywhere and go on.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from ..functions import text as t
from ..operators import dedup as dd
from ..operators.graph import checkpointed, drop

GRAMS, ANCHORS, PARAGRAPH, CONTAINED = 8, 12, 200, 0.8
ROUNDS = 3
HASHES = "rank long, alone array<string>, anchors array<long>"
SOURCE = "rank long, text string"


def grams(docs: DataFrame, keep: list[str]) -> DataFrame:
    """docs with ``g``, the distinct hashes of the word 8-grams of ``text``."""
    words = docs.select(*keep, t.words("text").alias("__w"))
    return words.select(*keep, F.transform(t.ngrams(F.col("__w"), GRAMS), lambda x: F.xxhash64(x)).alias("g"))


def keys_of(docs: DataFrame) -> DataFrame:
    """(key, rank) of docs(rank, text): t: text, p: paragraph, a: two of the anchors."""
    whole = docs.select("rank", F.concat(F.lit("t"), F.sha2(t.blank("text"), 256)).alias("key"))
    lines = docs.select("rank", F.explode(F.array_distinct(t.lines("text"))).alias("line")).where(F.length("line") >= PARAGRAPH)
    paragraphs = lines.select("rank", F.concat(F.lit("p"), F.sha2("line", 256)).alias("key"))
    few = grams(docs.select("rank", "text"), ["rank"]).select("rank", F.slice(F.array_sort("g"), 1, ANCHORS).alias("g"))
    first = few.select("rank", "g", F.posexplode_outer("g").alias("i", "x"))
    pair = first.select("rank", "x", F.explode_outer(F.slice("g", F.coalesce("i", F.lit(0)) + 2, F.lit(ANCHORS))).alias("y"))
    anchors = pair.select("rank", F.concat(F.lit("a"), F.hex("x"), F.lit(":"), F.hex("y")).alias("key"))
    return whole.unionByName(paragraphs).unionByName(anchors).where("key is not null").select("key", "rank")


def answer(bucket: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Per key of a bucket: whether a kept row has it; of a pair of anchors, which. State comes and goes with the batch's rows.
    For streams whose keys live in keyed state; ``run`` reads written hashes, as state in Python took most of its time."""
    known: dict[str, list[int]] = {}
    for k, r in zip(*state.get) if state.exists else ():
        known.setdefault(k, []).append(r)
    asked, new = [], {}
    for frame in frames:
        for k, r, kept in zip(frame["key"].tolist(), frame["rank"].tolist(), frame["kept"].tolist()):
            if kept:
                new.setdefault(k, set()).add(r)
            else:
                asked.append((k, r))
    more = False
    for k, ranks in new.items():
        pair, old = k.startswith("a"), known.get(k, [])
        ranks = ranks.difference(old)
        if ranks and (pair or not old):
            # one row tells as much as all where a key alone decides
            known[k], more = old + (sorted(ranks) if pair else [min(ranks)]), True
    if more:
        state.update(([k for k, ranks in known.items() for _ in ranks], [r for ranks in known.values() for r in ranks]))
    if asked:
        out = [(k, r, other) for k, r in asked for other in (None, *known.get(k, ()))]
        yield pd.DataFrame(out, columns=["key", "rank", "other"]).astype({"other": "Int64"})


def hashes_of(docs: DataFrame) -> DataFrame:
    """(rank, alone, anchors) of docs(rank, text): the keys that decide alone (t: text, p: paragraph), and the anchors."""
    lines = F.filter(F.array_distinct(t.lines("text")), lambda x: F.length(x) >= PARAGRAPH)
    whole = F.array(F.concat(F.lit("t"), F.sha2(t.blank("text"), 256)))
    alone = F.concat(whole, F.transform(lines, lambda x: F.concat(F.lit("p"), F.sha2(x, 256))))
    listed = docs.where("text is not null").select("rank", alone.alias("alone"), t.words("text").alias("__w"))
    g = F.transform(t.ngrams(F.col("__w"), GRAMS), lambda x: F.xxhash64(x))
    return listed.select("rank", "alone", F.slice(F.array_sort(g), 1, ANCHORS).alias("anchors"))


def keys_met(new: DataFrame, old: DataFrame) -> DataFrame:
    """(rank, key, alone, kept) of the keys of new(rank, alone, anchors) that another row of it or one of ``old``, the
    rows kept before, has, and of the rows that have them; both are written tables. Keys are the hashes that decide alone and
    pairs of anchors."""
    sides = new.withColumn("kept", F.lit(False)).unionByName(old.withColumn("kept", F.lit(True)))

    def met(keys: DataFrame) -> DataFrame:
        """Those of keys(rank, key, kept) that two rows have, one of them new."""
        often = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("kept").alias("old")).where("n > 1 and not old")
        return checkpointed(keys.join(often.select("key"), "key").select("rank", "key", "kept"))

    alone = met(sides.select("rank", F.explode("alone").alias("key"), "kept"))
    single = met(sides.select("rank", F.explode("anchors").alias("key"), "kept"))
    held = single.groupBy("rank", "kept").agg(F.array_sort(F.collect_list("key")).alias("g")).where(F.size("g") >= 2)
    later = lambda i: F.transform(F.sequence(i + 1, F.size("g")), lambda j: F.concat(F.lit("a"), F.hex(F.get("g", i - 1)), F.lit(":"), F.hex(F.get("g", j - 1))))
    pairs = F.flatten(F.transform(F.sequence(F.lit(1), F.size("g") - 1), later))
    double = met(held.select("rank", F.explode(pairs).alias("key"), "kept"))
    out = checkpointed(alone.withColumn("alone", F.lit(True)).unionByName(double.withColumn("alone", F.lit(False))))
    drop(alone, single, double)
    return out


def near(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the distinct pairs (low, high) whose 8-grams are contained in one another; a written table."""
    wanted = pairs.select(F.explode(F.array("low", "high")).alias("rank")).distinct()
    sets = checkpointed(grams(docs.join(wanted, "rank", "left_semi"), ["rank"]))
    both = pairs.join(sets.toDF("low", "x"), "low").join(sets.toDF("high", "y"), "high")
    enough = F.size(F.array_intersect("x", "y")) >= CONTAINED * F.least(F.size("x"), F.size("y"))
    return both.where(enough).select("low", "high")


def decide(new: DataFrame, old: DataFrame, docs: DataFrame) -> DataFrame:
    """(rank) kept of one batch, new(rank, alone, anchors); old: the same of the rows kept before it."""
    keys = keys_met(new, old)
    asked, had = keys.where("not kept"), keys.where("kept")
    taken = asked.where("alone").join(had.where("alone").select("key"), "key", "left_semi").select("rank")
    pair = asked.where("not alone").select("key", F.col("rank").alias("high"))
    earlier = checkpointed(had.where("not alone").select("key", F.col("rank").alias("low")).join(pair, "key").select("low", "high").distinct())
    gone = checkpointed(taken.union(near(earlier, docs).select("high")).distinct())
    ranks = new.select("rank").join(gone, "rank", "left_anti")
    open_ = checkpointed(asked.select("rank", "key", "alone").join(gone, "rank", "left_anti"))
    drop(keys, earlier)
    kept = [ranks.join(open_.select("rank").distinct(), "rank", "left_anti")]
    used = [gone, open_]
    for _ in range(ROUNDS):
        if open_.isEmpty():
            break
        first = open_.groupBy("key").agg(F.min("rank").alias("first"))
        free = open_.join(first, "key").groupBy("rank").agg(F.min(F.col("rank") == F.col("first")).alias("free"))
        chosen = checkpointed(free.where("free").select("rank"))
        kept.append(chosen)
        heads = open_.join(chosen, "rank", "left_semi").select("key", F.col("rank").alias("low"))
        rest = open_.join(chosen, "rank", "left_anti").select("rank", "key", "alone")
        met = checkpointed(rest.join(heads, "key").groupBy("low", "rank").agg(F.max("alone").alias("alone")))
        alike = near(met.where("not alone").select("low", F.col("rank").alias("high")), docs).select("high")
        out = checkpointed(met.where("alone").select("rank").union(alike).distinct())
        open_ = checkpointed(rest.join(out, "rank", "left_anti"))
        drop(met, out)
        used.append(open_)
    keyed = open_.where("not alone").select("key", "rank")
    within = keyed.toDF("key", "low").join(keyed.toDF("key", "high"), "key").where("low < high").select("low", "high").distinct()
    members = open_.where("alone").select("rank", "key").unionByName(dd.pair_members(near(checkpointed(within), docs)))
    kept.append(dd.greedy_keep(open_.select("rank").distinct(), members))
    done = checkpointed(reduce(DataFrame.union, kept))
    drop(*used)
    return done


def run(spark: SparkSession, source: str, out: str, files_per_batch: int = 1, stop_after: int | None = None) -> DataFrame:
    """Kept ranks of the Parquet files under ``source`` (rank long, text string; ranks ascend with the files' age), read
    ``files_per_batch`` at a time. Takes up where an earlier run under ``out`` has stopped; ``stop_after``: batches to
    run before stopping on purpose. Texts that are null have no key: they are kept."""
    docs = spark.read.schema(SOURCE).parquet(source)
    stream = spark.readStream.schema(SOURCE).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    spark.createDataFrame([], HASHES).write.mode("ignore").parquet(f"{out}/keys/batch=-1")
    done = 0

    def write(batch: DataFrame, number: int) -> None:
        nonlocal done
        if stop_after is not None and done >= stop_after:
            raise InterruptedError(f"stopped before batch {number}")
        done += 1
        session = batch.sparkSession
        rows = batch.select("rank", F.coalesce("text", F.concat(F.lit("\0"), F.col("rank").cast("string"))).alias("text"))
        new = checkpointed(hashes_of(rows))
        # a batch that is repeated does not read what it wrote before
        old = session.read.schema(f"{HASHES}, batch int").parquet(f"{out}/keys").where(F.col("batch") < number).drop("batch")
        kept = decide(new, old, docs)
        kept.write.mode("overwrite").parquet(f"{out}/kept/batch={number}")
        new.join(kept, "rank", "left_semi").select("rank", "alone", "anchors").write.mode("overwrite").parquet(f"{out}/keys/batch={number}")
        drop(new, kept)

    query = stream.writeStream.option("checkpointLocation", f"{out}/checkpoint").foreachBatch(write).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.parquet(f"{out}/kept").select("rank")
