"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set is that of its distinct word shingles (64-bit hashes). Two sets of similarity t or more have all but
1 - t of either in common, so a document more of whose shingles are met nowhere else is linked with nothing; nor is one
with more than that number of such shingles among half of them. A table of bits (four for each shingle, 2 ** 30 at most)
tells those shingles of one half that two documents have, and by chance few others; half the shingles fill it half as
much. The documents that remain are read into sets, equal sets being one class from the start.

The shingles of the classes are counted exactly and put in one order, rare ones first. Two sets of similarity t or more
share at least l shingles of their l-prefixes, the first |x| - ceil(t |x|) + l. Each class chooses its own l, from 1 to
``longest``: shingles that s other classes share in all cost s lookups and at most s / l verifications of |x| steps,
and the l of the smallest estimate is taken. A pair is held to the smaller of its two l: shingles in both prefixes of that
length must number that many before the sets are compared.

The shingles of the prefixes are buckets of classes, and classes that buckets connect are a group. A group goes with
its sets to one task, or in slices of bounded bytes, each pair of them to one task, which looks candidates up in the
prefixes and tries them until they are connected. So a group of copies costs about as many comparisons as it has
members, and tasks give out links only, never pairs to be tried. Groups of more than ``WIDE`` slices, chained by
shingles that unlike documents share, are taken apart first: each class is tried in one bucket, the largest that one
task holds, then only buckets whose members are not in one component yet make groups, and of those that are still wide
every bucket is a task of its own (or slices) in which pairs are tried that share no earlier one. No link between two
components is lost in either way.

Beyond some 2 ** 30 shingles (about 6 GB of text) the bits fill up; what they no longer sort out is read into sets and
counted as well, at the price of shuffling it. Results do not change.

A text of fewer words than a shingle is one shingle; without words (null, empty, white space) it has an empty set and is
linked with nothing. Rows that repeat a doc_id are one document, linked with whatever one of them is linked with, with
the number of shingles of the largest; rows with a null doc_id take no part and are not returned. Very long texts are
read whole. Other columns are ignored. Empty tables give empty tables. Shingles are told apart by the XXH64 of their words, mixed to 64 bits: two
different ones are taken for one with a chance of about 1 in 10 ** 19.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .op2_simhash import alike
from .slot_sketch import SlotCounts, at_least, bit_of, mixed, slot_bits, slot_of, summed
from .word_cache import hold

SEED = 42
#: what a bucket's task holds at most, in shingles and in members
TILE, MEMBERS = 1 << 19, 2048
#: slices of a group from which on it is taken apart
WIDE = 8


def shingles(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles: words are hashed once each, and these numbers mixed in order."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), ">u8").astype(np.uint64)
    found = np.zeros(max(1, len(h) - size + 1), np.uint64)
    for i in range(min(size, len(h))):
        found = (found + h[i : i + len(found)]) * np.uint64(0x9E3779B97F4A7C15)
        found ^= found >> np.uint64(29)
    found = np.sort(mixed(found))
    return found[np.append(True, found[1:] != found[:-1])]


def sampled(found: np.ndarray) -> np.ndarray:
    """The half of some shingles that the bit table knows."""
    return found[found & np.uint64(1) == 0]


def _count_rows(counts: SlotCounts) -> pa.RecordBatch:
    ranges, blobs = counts.rows()
    return pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), pa.array(blobs, pa.binary())], ["range", "counts"])


def document_counts(texts: DataFrame, size: int, bits: int) -> DataFrame:
    """(range, counts) of the slots of each document's distinct sampled shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("ngrams", lambda: None)
        counts = SlotCounts(bits)
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                counts.add(slot_of(sampled(shingles(text.as_py(), size)), bits))
                if counts.full():
                    yield _count_rows(counts)
        yield _count_rows(counts)

    return texts.select("text").mapInArrow(run, "range int, counts binary")


def needed(n, percent: int):
    """Shingles of n that a set of the similarity must share."""
    return -(-percent * n // 100)


def marked(texts: DataFrame, size: int, bits: int, repeated: Broadcast, percent: int) -> DataFrame:
    """texts(row, text) -> row, set_id (128-bit hash), n, open: whether enough shingles may be met elsewhere. Narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("ngrams", lambda: None)
        table = np.frombuffer(repeated.value, np.uint8)
        for batch in batches:
            ids, sizes, open_ = [], [], []
            for text in batch.column(1).cast(pa.binary()):
                found = shingles(text.as_py(), size)
                ids.append(xxhash.xxh128_digest(found.tobytes(), SEED))
                sizes.append(len(found))
                half, missing = sampled(found), len(found) - needed(len(found), percent)
                open_.append(len(found) > 0 and int(bit_of(table, slot_of(half, bits)).sum()) >= len(half) - missing)
            columns = [batch.column(0), pa.array(ids, pa.binary()), pa.array(sizes, pa.int64()), pa.array(open_, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "set_id", "n", "open"])

    return texts.select("row", "text").mapInArrow(run, "row long, set_id binary, n long, open boolean")


def sets_of(texts: DataFrame, rows: DataFrame, n: int, size: int) -> DataFrame:
    """(row, set_id, shingles) of those texts(row, text) that ``rows(row)``, n in number, names, and of few others: texts
    are sorted out in place by a bit table of sixteen bits a row (2 ** 30 bits at most). Narrow."""
    bits = slot_bits(16 * n, 16, 30)
    wanted = common.bit_table(rows, "row", bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("ngrams", lambda: None)
        table = np.frombuffer(wanted.value, np.uint8)
        for batch in batches:
            places = np.asarray(batch.column(2))
            chosen = batch.take(pa.array(np.flatnonzero(table[places >> 3] >> (places & 7) & 1)))
            sets = [shingles(t.as_py(), size).tobytes() for t in chosen.column(1).cast(pa.binary())]
            ids = [xxhash.xxh128_digest(x, SEED) for x in sets]
            yield pa.RecordBatch.from_arrays([chosen.column(0), pa.array(ids, pa.binary()), pa.array(sets, pa.binary())], ["row", "set_id", "shingles"])

    return texts.select("row", "text", common.bit_place("row", bits).alias("place")).mapInArrow(run, "row long, set_id binary, shingles binary")


def tokens_of(sets: DataFrame) -> DataFrame:
    """(row, line, n, token) of sets(row, line, n, shingles): one row for each shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("ngrams", lambda: None)
        for batch in batches:
            sizes = np.asarray(batch.column(2))
            found = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x.as_py(), np.int64) for x in batch.column(3))])
            numbers = [pa.array(np.repeat(np.asarray(batch.column(i)), sizes)) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*numbers, pa.array(found)], ["row", "line", "n", "token"])

    return sets.select("row", "line", "n", "shingles").mapInArrow(run, "row long, line long, n long, token long")


def chosen_match(n: int, counts: np.ndarray, percent: int, longest: int) -> int:
    """The l of the least estimated cost. counts: in how many classes each of the shingles is that others have, too, in
    order; the n - len(counts) shingles before them cost nothing."""
    choices = np.arange(1, min(longest, needed(n, percent)) + 1)
    sums = np.concatenate([[0], np.cumsum(counts - 1)])
    shared = sums[np.clip(n - needed(n, percent) - (n - len(counts)) + choices, 0, len(counts))]
    return int(choices[np.argmin(shared + shared / choices * n)])


def prefixes_of(shared: DataFrame, percent: int, longest: int) -> DataFrame:
    """shared(row, line, n, listed array<struct<often, token>>) -> row, line, l, skip, prefix: the shingles of the l-prefix
    that others have, too. Of the prefix for l' they are the first skip + l'. Classes without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("ngrams", lambda: None)
        for batch in batches:
            kept, matches, skips, prefixes = [], [], [], []
            lists = batch.column(3)
            often, token = (np.asarray(x) for x in lists.flatten().flatten())
            ends = np.concatenate([[0], np.cumsum(np.diff(np.asarray(lists.offsets)))]).tolist()
            for i, n in enumerate(batch.column(2).to_pylist()):
                own = slice(ends[i], ends[i + 1])
                order = np.lexsort((token[own], often[own]))
                match = chosen_match(n, often[own][order], percent, longest)
                skip = len(order) - needed(n, percent)
                if skip + match > 0:
                    kept.append(i)
                    matches.append(match)
                    skips.append(skip)
                    prefixes.append(token[own][order][: skip + match])
            out = batch.select([0, 1]).take(pa.array(kept, pa.int64()))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]), pa.int32())
            found = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int64), *prefixes]), pa.int64()))
            columns = [*out.columns, pa.array(matches, pa.int64()), pa.array(skips, pa.int64()), found]
            yield pa.RecordBatch.from_arrays(columns, ["row", "line", "l", "skip", "prefix"])

    return shared.mapInArrow(run, "row long, line long, l long, skip long, prefix array<long>")


class Tile:
    """Members of a bucket or a group that one task compares."""

    def __init__(self, similarity: float):
        self.percent, self.similarity, self.members = round(100 * similarity), similarity, []

    def add(self, own: int, row: int, root: int, match: int, skip: int, prefix: np.ndarray, found: np.ndarray) -> None:
        self.members.append((own, row, root, match, skip, prefix, found))

    def links(self, bucket: int | None) -> list[tuple[int, int]]:
        """Links (pairs of rows) of members of different roots, enough to connect what is connected here. Members of one
        slice are compared only where the tile has no other. With a bucket, pairs are left to the first they share."""
        if len(self.members) < 2:
            return []
        slices, rows, label, match = (np.array(x, np.int64) for x in list(zip(*self.members))[:4])
        prefixes, sets = ([m[k] for m in self.members] for k in (5, 6))
        size, length = (np.array([len(x) for x in y]) for y in (sets, prefixes))
        _, token = np.unique(np.concatenate(prefixes), return_inverse=True)
        of = np.repeat(np.arange(len(sets)), length)
        by_token = np.argsort(token, kind="stable")
        starts = np.searchsorted(token[by_token], np.arange(token.max() + 2)) if len(token) else np.zeros(1, np.int64)
        postings, ends = of[by_token], np.cumsum(length)
        often = np.diff(starts) > 1
        crossing, out = len(np.unique(slices)) > 1, []
        for i in range(len(sets) - 1):
            if (label == label[0]).all():
                break
            mine = token[ends[i] - len(prefixes[i]) : ends[i]]
            met = [postings[a:b] for a, b in zip(starts[mine[often[mine]]].tolist(), starts[mine[often[mine]] + 1].tolist())]
            if not met:
                continue
            shared = np.bincount(np.concatenate(met), minlength=len(sets))
            near = (shared >= np.minimum(match, match[i])) & (label != label[i])
            near &= 100 * np.minimum(size, size[i]) >= self.percent * np.maximum(size, size[i])
            if crossing:
                near &= slices != slices[i]
            near[: i + 1] = False
            near = np.flatnonzero(near)
            # the likeliest first, as a link spares the comparisons with all it connects
            for j in near[np.argsort(-shared[near], kind="stable")].tolist():
                if label[i] != label[j] and self._alike(i, j, bucket):
                    label[label == label[j]] = label[i]
                    out.append((int(rows[i]), int(rows[j])))
        return out

    def _alike(self, i: int, j: int, bucket: int | None) -> bool:
        one, other = self.members[i], self.members[j]
        least = min(one[3], other[3])
        mine, its = (m[5][: max(0, m[4] + least)] for m in (one, other))
        shared = mine[np.isin(mine, its, assume_unique=True)]
        if len(shared) < least or bucket is not None and shared[0] != bucket:
            return False
        return alike(one[6], other[6], self.similarity)


def tile_links(buckets: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links among the members of buckets(key, by_token, row, root), a written table (a, b). by_token: the key is a
    shingle, and a pair is tried in the first that it shares."""
    held = buckets.join(sets, "row")
    members = common.materialize(held, "members")
    cut = F.ceil(F.greatest(F.sum(F.length("shingles") / 8) / TILE, F.count(F.lit(1)) / MEMBERS)).cast("long")
    cuts = common.materialize(members.groupBy("key", "by_token").agg(F.greatest(cut, F.lit(1)).alias("slices")), "cuts")
    own = F.pmod(F.xxhash64("row"), F.col("slices"))
    parts = F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda o: F.least(F.col("own"), o) * (1 << 24) + F.greatest(F.col("own"), o))
    tiles = (
        members.join(cuts, ["key", "by_token"])
        .withColumn("own", own)
        .withColumn("part", F.explode(parts))
        .select("key", "by_token", "part", "own", "row", "root", "l", "skip", "prefix", "shingles")
        .repartition("key", "by_token", "part")
        .sortWithinPartitions("key", "by_token", "part", "row")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("ngrams", lambda: None)
        of, tile = None, Tile(similarity)

        def found() -> pa.RecordBatch:
            links = tile.links(of[0] if of and of[1] else None)
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in links], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(8)]
            for *key, own, row, root, match, skip, prefix, shingled in zip(*columns, batch.column(8), batch.column(9)):
                if key != of:
                    yield found()
                    of, tile = key, Tile(similarity)
                tile.add(own, row, root, match, skip, np.asarray(prefix.values), np.frombuffer(shingled.as_py(), np.uint64))
        yield found()

    links = common.materialize(tiles.mapInArrow(run, "a long, b long").distinct(), "links")
    common.drop_tables(members, cuts)
    return links


def grouped(buckets: DataFrame, sizes: DataFrame) -> DataFrame:
    """buckets(token, row, root) with the group that buckets connect a row to, and the group's number of slices."""
    ends = buckets.groupBy("token").agg(F.min("row").alias("first"))
    edges = buckets.join(ends, "token").where("row <> first").select(F.col("row").alias("a"), F.col("first").alias("b")).distinct()
    stars = common.components(edges)
    groups = buckets.join(stars.withColumnRenamed("node", "row").withColumnRenamed("root", "grp"), "row")
    one = groups.select("grp", "row").distinct().join(sizes, "row")
    cut = F.ceil(F.greatest(F.sum("n") / TILE, F.count(F.lit(1)) / MEMBERS)).alias("slices")
    out = common.materialize(groups.join(one.groupBy("grp").agg(cut), "grp"), "groups")
    common.drop_tables(stars)
    return out


def by_group(groups: DataFrame) -> DataFrame:
    return groups.select(F.col("grp").alias("key"), F.lit(False).alias("by_token"), "row", "root").distinct()


def links_of(buckets: DataFrame, sizes: DataFrame, sets: DataFrame, similarity: float, wide: int = WIDE) -> list[DataFrame]:
    """Written tables of links (a, b) that connect the classes of buckets(token, row, members) which are connected."""
    groups = grouped(buckets.withColumn("root", F.col("row")), sizes)
    links = [tile_links(by_group(groups.where(F.col("slices") <= wide)), sets, similarity)]
    rest = common.materialize(groups.where(F.col("slices") > wide).select("token", "row", "members"), "wide")
    common.drop_tables(groups)
    if not rest.isEmpty():
        # the largest bucket that one task holds, else the smallest
        fit = F.when(F.col("members") <= MEMBERS, F.col("members")).otherwise(-F.col("members"))
        own = rest.groupBy("row").agg(F.max(F.struct(fit.alias("fit"), "token")).alias("x")).select("x.token", "row")
        links.append(tile_links(own.select(F.col("token").alias("key"), F.lit(False).alias("by_token"), "row", F.col("row").alias("root")), sets, similarity))
        stars = common.components(links[-1])
        rooted = common.materialize(
            rest.join(stars.withColumnRenamed("node", "row"), "row", "left").select("token", "row", F.coalesce("root", "row").alias("root")), "rooted"
        )
        ends = rooted.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"))
        unsettled = common.materialize(ends.where("low < high").select("token"), "unsettled")
        groups = grouped(rooted.join(unsettled, "token", "left_semi"), sizes)
        by_token = groups.where(F.col("slices") > wide).select(F.col("token").alias("key"), F.lit(True).alias("by_token"), "row", "root")
        links.append(tile_links(by_group(groups.where(F.col("slices") <= wide)).unionByName(by_token), sets, similarity))
        common.drop_tables(stars, rooted, unsettled, groups)
    common.drop_tables(rest)
    return links


def jaccard_components(docs: DataFrame, shingle: int = 4, similarity: float = 0.85, longest: int = 8, wide: int = WIDE) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id: the smallest doc_id among documents connected by pairs of
    similarity ``similarity`` (whole hundredths) or more. A written table of the shared folder."""
    spark = docs.sparkSession
    common.tune(spark)
    percent = round(100 * similarity)
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("row"), F.col("text").cast("string").alias("text"))
    # a shingle for about six bytes
    bits = slot_bits(4 * (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / 6, 16, 30)
    counted = common.materialize(document_counts(texts, shingle, bits), "shingle-counts")
    repeated = spark.sparkContext.broadcast(summed(counted, bits, at_least(2)))
    common.drop_tables(counted)
    seen = common.materialize(marked(texts, shingle, bits, repeated, percent), "marked")
    repeated.unpersist()
    # one row for each distinct set stands for all documents that have it
    names = common.materialize(seen.where("open").groupBy("set_id").agg(F.min("row").alias("class")), "names")
    classes = names.select("set_id", F.col("class").alias("row"))
    chosen = sets_of(texts, classes.select("row"), names.count(), shingle).join(classes, ["set_id", "row"], "left_semi")
    size = (F.length("shingles") / 8).cast("long").alias("n")
    sets = common.materialize(chosen.dropDuplicates(["set_id", "row"]).select("row", F.xxhash64("set_id").alias("line"), size, "shingles"), "sets")
    tokens = tokens_of(sets)
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    listed = F.collect_list(F.struct("often", "token")).alias("listed")
    shared = tokens.join(often, "token").groupBy("row", "line", "n").agg(listed).select("row", "line", "n", "listed")
    prefixes = common.materialize(prefixes_of(shared, percent, longest), "prefixes")
    entries = prefixes.select("row", F.explode("prefix").alias("token"))
    members = entries.groupBy("token").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    buckets = common.materialize(entries.join(members, "token").select("token", "row", "members"), "buckets")
    sizes = sets.groupBy("row").agg(F.sum("n").alias("n"))
    held = prefixes.join(sets.select("row", "line", "shingles"), ["row", "line"]).drop("line")
    links = links_of(buckets, sizes, held, similarity, wide)
    # documents of several sets connect the classes of these
    of_class = common.materialize(seen.join(names, "set_id", "left").select("row", "class", "n"), "of-class")
    least = of_class.groupBy("row").agg(F.min("class").alias("a"), F.max("class").alias("z")).where("a < z").select("row", "a")
    own = of_class.join(least, "row").select("a", F.col("class").alias("b"))
    stars = common.components(reduce(DataFrame.unionByName, [own, *links]))
    rooted = of_class.join(stars.withColumnRenamed("node", "class"), "class", "left").select("row", "n", F.coalesce("root", "class").alias("root"))
    result = rooted.groupBy("row").agg(F.max("n").alias("n_shingles"), F.coalesce(F.min("root"), F.col("row")).alias("component_id"))
    out = common.materialize(result.withColumnRenamed("row", "doc_id"), "ngram-components")
    common.drop_tables(seen, names, sets, prefixes, buckets, *links, of_class, stars)
    return out


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(common.table(spark, sf_dir, "documents"))


SQL = """
WITH RECURSIVE worded AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM worded),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS an, any_value(b.n) AS bn, count(*) AS shared
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM pairs WHERE 100 * shared >= 85 * (an + bn - shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.component_id
FROM sets s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) m ON m.a = s.doc_id
"""

QUERIES = {"op13_ngram_join": op13_ngram_join}
ORACLES = {"op13_ngram_join": SQL}
