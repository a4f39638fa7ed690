"""SimHash near-duplicates, linked by a Gray-order hierarchical index.

``fingerprints``: 64-bit SimHash of each text's word shingles. ``linked``: rows (a, b) of fingerprints
that differ in ``radius`` bits or fewer, enough of them to connect each component. Five or fewer
differences short of one per block leave a block of bits equal (radius + 1 blocks), so fingerprints are
dealt by block and value; within a bucket the index of ``gray_index`` finds the links and the task gives
out a spanning forest, not all pairs. A bucket of more than ``slice_size`` fingerprints is cut into
slices, and each pair of slices is a bucket of its own, so that one task's memory is bounded. Equal
fingerprints are one row throughout; documents meet their component again in the last join, which
adaptive execution splits where one fingerprint has very many documents.

``near_duplicates`` groups documents by similarity of shingle sets (five words, 0.8 or more). At that
similarity fingerprints differ in about ten bits, more than any block scheme reaches, so there SimHash
links are joined by MinHash band keys as a second source of candidates, and every candidate pair is
verified on the exact sets. Documents with the same set are one class from the start. A band's bucket
pairs each member with the smallest one first. Buckets whose other members are not of one component then
are closed by ``closing_links``: tiles of bounded bytes hold the exact sets, and a task compares all pairs of
different components, each in the first band it shares. Only links leave a task, so a bucket of unlike
members costs comparisons, never rows. What can be lost is a pair that shares no band and no fingerprint
link: at a similarity of exactly 0.8 about 2 in 10,000, at 0.85 6 in a million.

Null and empty texts have no words: fingerprint zero, linked like any other; for sets they are copies of
one another. Repeated rows are kept and share a component. A null doc_id is never a component's name; a
component of null ids only has a null name. Very long texts are read whole, in linear time and by chunks of
shingles. Other columns are ignored, or kept by ``keep_first``. Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .gray_index import GrayIndex, forest
from .word_cache import hold

SEED, CHUNK = 42, 1 << 16


def shingle_digests(text: bytes | None, size: int) -> Iterator[bytes]:
    """XXH64 digests (8 bytes, big endian) of a text's word shingles in order, joined for each 65,536."""
    words = (text or b"").lower().split()
    joined = b" ".join(words)
    if not words:
        return
    digest = xxhash.xxh64_digest
    if len(words) <= size:
        yield digest(joined, SEED)
        return
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    for i in range(0, len(starts), CHUNK):
        yield b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[i : i + CHUNK], ends[i : i + CHUNK])])


def simhash(parts: list[bytes]) -> int:
    """Fingerprint, as a signed 64-bit integer, of shingle digests; a bit is set if it is in over half."""
    total, ones = 0, np.zeros(64, np.int64)
    for part in parts:
        rows = np.frombuffer(part, np.uint8).reshape(-1, 8)
        total += len(rows)
        ones += np.unpackbits(rows, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big", signed=True) if total else 0


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """docs(doc_id, text) -> doc_id, fp (the fingerprint as a signed 64-bit integer). Narrow."""
    common.tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("simhash", lambda: None)
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = [simhash(list(shingle_digests(t.as_py(), shingle))) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def block_keys(fp, radius: int):
    """Array of block number << 32 | the block's bits, for radius + 1 blocks."""
    blocks, keys, low = radius + 1, [], 0
    for i in range(blocks):
        width = (64 - low) // (blocks - i)
        bits = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        keys.append(bits.bitwiseOR(F.lit(i << 32).cast("long")))
        low += width
    return F.array(*keys)


def linked(codes: DataFrame, radius: int = 4, slice_size: int = 1 << 16) -> DataFrame:
    """Distinct codes(fp long) -> (a, b) that differ in at most ``radius`` bits: for every bucket a
    spanning forest of its links, so that components come out whole. Up to radius + 1 rows a code."""
    dealt = codes.select("fp", F.explode(block_keys(F.col("fp"), radius)).alias("key"))
    # at most (radius + 1) * 2 ** ceil(64 / (radius + 1)) keys exist; few are hot
    hot = dealt.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / slice_size).cast("int").alias("slices")).where("slices > 1")
    own = F.pmod(F.xxhash64("fp"), F.col("slices")).cast("int")
    other = F.sequence(F.lit(0), F.col("slices") - 1)
    pair = F.transform(other, lambda o: F.least(own, o) * 65536 + F.greatest(own, o))
    # a single slice needs no copies
    spread = (
        dealt.join(F.broadcast(hot), "key", "left")
        .select("fp", "key", F.explode(F.when(F.col("slices").isNull(), F.array(F.lit(0))).otherwise(pair)).alias("part"))
        .repartition("key", "part")
        .sortWithinPartitions("key", "part")
        .select("key", "part", "fp")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("simhash", lambda: None)
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0

        def search(keys: np.ndarray, parts: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            change = np.concatenate([[0], np.cumsum((keys[1:] != keys[:-1]) | (parts[1:] != parts[:-1]))])
            index = GrayIndex(fps.view(np.uint64), change)
            found = np.array(forest(len(fps), index.links(radius)), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(fps[found[:, 0]]), pa.array(fps[found[:, 1]])], ["a", "b"])

        for batch in batches:
            held.append(tuple(np.asarray(batch.column(i)) for i in range(3)))
            rows += batch.num_rows
            if rows >= 1 << 19:  # whole buckets so far; the last one may go on
                keys, parts, fps = (np.concatenate(x) for x in zip(*held))
                cut = np.flatnonzero((keys != keys[-1]) | (parts != parts[-1]))
                if len(cut):
                    end = cut[-1] + 1
                    yield search(keys[:end], parts[:end], fps[:end])
                    held, rows = [(keys[end:], parts[end:], fps[end:])], len(keys) - end
        if rows:
            yield search(*(np.concatenate(x) for x in zip(*held)))

    return spread.mapInArrow(run, "a long, b long")


def component_ids(prints: DataFrame, radius: int = 4) -> DataFrame:
    """prints(doc_id, fp) -> doc_id, fp, component_id: the smallest doc_id of the component. A written table of
    the shared folder."""
    codes = common.materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "codes")
    stars = common.components(linked(codes.select("fp"), radius))
    rooted = codes.join(stars.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = prints.join(rooted.join(names, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
    out = common.materialize(named, "components")
    common.drop_tables(codes, stars)
    return out


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = common.materialize(fingerprints(common.table(spark, sf_dir, "documents")), "fingerprints")
    found = component_ids(prints)
    common.drop_tables(prints)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# -- similarity of shingle sets

BANDS, ROWS = 16, 4
_FACTORS = np.random.default_rng(SEED).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(parts: list[bytes]) -> np.ndarray:
    """Sorted distinct 64-bit hashes."""
    return np.unique(np.frombuffer(b"".join(parts), ">u8").astype(np.uint64))


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for i in range(0, len(shingles), 4096):
        np.minimum(least, (shingles[i : i + 4096, None] * _FACTORS).min(0), out=least)
    return least


def profiles(docs: DataFrame, shingle: int) -> DataFrame:
    """docs(row, text) -> row, set_id (128-bit hash of the shingle set), fp, bands (MinHash keys). Narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("simhash", lambda: None)
        for batch in batches:
            ids, fps, bands = [], [], []
            for text in batch.column(1).cast(pa.binary()):
                parts = list(shingle_digests(text.as_py(), shingle))
                found = shingle_set(parts)
                least = min_hashes(found).reshape(BANDS, ROWS)
                ids.append(xxhash.xxh128_digest(found.tobytes(), SEED))
                fps.append(simhash(parts))
                bands.append([xxhash.xxh64_intdigest(least[i].tobytes(), i) - (1 << 63) for i in range(BANDS)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.binary()), pa.array(fps, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                ["row", "set_id", "fp", "bands"],
            )

    return docs.select("row", "text").mapInArrow(run, "row long, set_id binary, fp long, bands array<long>")


def alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have a Jaccard similarity of at least ``similarity``."""
    if min(len(x), len(y)) < similarity * max(len(x), len(y)) - 1e-9:
        return False
    both = np.concatenate([x, y])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared >= similarity * (len(both) - shared) - 1e-9


def sets_of(docs: DataFrame, rows: DataFrame, shingle: int) -> DataFrame:
    """(row, set_id, shingles) of those documents(row, text) that ``rows(row)`` names, and of few others: texts
    stay where they are and are sorted out by a bit table of their number. Narrow."""
    size = common.bits_for(rows.count())
    wanted = common.bit_table(rows, "row", size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("simhash", lambda: None)
        bits = np.frombuffer(wanted.value, np.uint8)
        for batch in batches:
            places = np.asarray(batch.column(2))
            chosen = batch.take(pa.array(np.flatnonzero(bits[places >> 3] >> (places & 7) & 1)))
            sets = [shingle_set(list(shingle_digests(t.as_py(), shingle))).tobytes() for t in chosen.column(1).cast(pa.binary())]
            ids = [xxhash.xxh128_digest(x, SEED) for x in sets]
            columns = [chosen.column(0), pa.array(ids, pa.binary()), pa.array(sets, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "set_id", "shingles"])

    return docs.select("row", "text", common.bit_place("row", size).alias("place")).mapInArrow(run, "row long, set_id binary, shingles binary")


def verified(pairs: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of rows of docs(row, text) whose sets have a Jaccard similarity of at least
    ``similarity``. Only documents that are in a pair are read into sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("simhash", lambda: None)
        for batch in batches:
            kept = [
                i
                for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3)))
                if alike(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), similarity)
            ]
            yield batch.select([0, 1]).take(pa.array(kept, pa.int64()))

    ids = pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct()
    ids = common.materialize(ids, "ids")
    sets = common.materialize(sets_of(docs, ids, shingle), "sets")
    common.drop_tables(ids)
    a = sets.select(F.col("row").alias("a"), F.col("shingles").alias("x"))
    b = sets.select(F.col("row").alias("b"), F.col("shingles").alias("y"))
    found = pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct()
    out = common.materialize(found, "similar")
    common.drop_tables(sets)
    return out


def tile_links(band: int, rows: list[int], slices: np.ndarray, roots: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links (pairs of rows) among a tile's members that join different roots, enough to connect what is
    connected in the tile. Members of one slice are compared only where the tile has no other."""
    least = np.array([min_hashes(x) for x in sets]).reshape(len(sets), BANDS, ROWS)
    signature, size = least.reshape(len(sets), -1).astype(np.uint8), np.array([len(x) for x in sets])
    crossing, label, out = len(np.unique(slices)) > 1, roots.copy(), []
    for i in range(len(sets) - 1):
        later = slice(i + 1, None)
        low, high = np.minimum(size[later], size[i]), np.maximum(size[later], size[i])
        near = (label[later] != label[i]) & (low >= similarity * high - 1e-9)
        if crossing:
            near &= slices[later] != slices[i]
        near = np.flatnonzero(near) + i + 1
        # a pair is compared in the first band it shares
        shared = (least[near, : band + 1] == least[i, : band + 1]).all(2)
        near = near[shared[:, band] & ~shared[:, :band].any(1)]
        # the likeliest first, as a link spares the comparisons with all it connects
        agree = (signature[near] == signature[i]).sum(1)
        for j in near[np.argsort(-agree, kind="stable")].tolist():
            if label[i] != label[j] and alike(sets[i], sets[j], similarity):
                label[label == label[j]] = label[i]
                out.append((rows[i], rows[j]))
    return out


def closing_links(buckets: DataFrame, members: DataFrame, docs: DataFrame, shingle: int, similarity: float, tile: int = 1 << 19) -> DataFrame:
    """Links between members of one bucket that are not in one component: buckets(row, band, key, first),
    members(node, root) -> (a, b). ``first`` has been compared with all. A bucket of more than ``tile``
    shingles, or 2,048 members, is cut into slices, and each pair of slices is a tile."""
    rooted = (
        buckets.where("row <> first")
        .join(members.withColumnRenamed("node", "row"), "row", "left")
        .select("band", "key", "row", F.coalesce("root", "row").alias("root"))
    )
    # bucket keys are written before they are joined, so that the join can be split where a bucket is hot
    ends = rooted.groupBy("band", "key").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    unsettled = common.materialize(ends.where("low < high").select("band", "key"), "unsettled")
    open_ = common.materialize(rooted.join(unsettled, ["band", "key"], "left_semi"), "open")
    ids = common.materialize(open_.select("row").distinct(), "ids")
    sets = common.materialize(sets_of(docs, ids, shingle).distinct(), "sets")
    common.drop_tables(ids)
    sized = open_.join(sets.groupBy("row").agg(F.sum(F.length("shingles") / 8).alias("n")), "row")
    slices = F.ceil(F.greatest(F.sum("n") / tile, F.count(F.lit(1)) / 2048)).cast("long")
    cuts = common.materialize(sized.groupBy("band", "key").agg(slices.alias("slices")), "cuts")
    own = F.pmod(F.xxhash64("row"), F.greatest("slices", F.lit(1)))
    others = F.sequence(F.lit(0), F.greatest("slices", F.lit(1)) - 1)
    parts = F.transform(others, lambda o: F.least(F.col("own"), o) * (1 << 24) + F.greatest(F.col("own"), o))
    tiles = (
        open_.join(cuts, ["band", "key"])
        .withColumn("own", own)
        .select("band", "key", F.explode(parts).alias("part"), "own", "row", "root")
        .join(sets.select("row", "shingles"), "row")
        .repartition("band", "key", "part")
        .sortWithinPartitions("band", "key", "part")
        .select("band", "key", "part", "own", "row", "root", "shingles")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("simhash", lambda: None)
        of, held = None, []

        def search() -> pa.RecordBatch:
            slices, rows, roots, sets = zip(*held) if held else ((),) * 4
            found = tile_links(of[0], list(rows), np.array(slices), np.array(roots), list(sets), similarity) if held else []
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            *numbers, shingles = (batch.column(i) for i in range(7))
            for band, key, part, slice_, row, root, found in zip(*(x.to_pylist() for x in numbers), shingles):
                if (band, key, part) != of:
                    yield search()
                    of, held = (band, key, part), []
                held.append((slice_, row, root, np.frombuffer(found.as_py(), np.uint64)))
        yield search()

    found = common.materialize(tiles.mapInArrow(run, "a long, b long").where("a <> b").distinct(), "closing")
    common.drop_tables(unsettled, open_, sets, cuts)
    return found


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 4) -> DataFrame:
    """docs(doc_id, text) -> doc_id, component_id: the smallest doc_id among documents connected by pairs
    of similarity ``similarity`` or more. Null doc_ids take no part; rows that share a doc_id are one document,
    alike to whatever one of them is alike to. A written table of the shared folder."""
    common.tune(docs.sparkSession)
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("row"), "text")
    seen = common.materialize(profiles(texts, shingle), "profiles")
    # one row for each distinct set stands for all documents that have it
    least = seen.groupBy("set_id").agg(F.min(F.struct("row", "fp", "bands")).alias("p"))
    classes = common.materialize(least.select("set_id", "p.*"), "classes")

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    # SimHash: links of fingerprints, between the smallest rows that have them; and rows of one fingerprint
    by_code = classes.groupBy("fp").agg(F.min("row").alias("least"))
    low, high = by_code.toDF("a", "ra"), by_code.toDF("b", "rb")
    links = linked(by_code.select("fp"), radius).join(low, "a").join(high, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    same = classes.join(by_code, "fp").select(F.col("least").alias("a"), F.col("row").alias("b"))
    # MinHash bands: each member with the smallest of its bucket
    banded = classes.select("row", F.posexplode("bands").alias("band", "key"))
    ends = banded.groupBy("band", "key").agg(F.min("row").alias("first"), F.max("row").alias("last"))
    centres = common.materialize(ends.where("first <> last").drop("last"), "centres")
    buckets = common.materialize(banded.join(centres, ["band", "key"]), "buckets")
    centred = buckets.select(F.col("first").alias("a"), F.col("row").alias("b"))
    tried = common.materialize(ordered(links.unionByName(same).unionByName(centred)), "pairs")
    edges = verified(tried, texts, shingle, similarity)
    first = common.components(edges)
    more = closing_links(buckets, first, texts, shingle, similarity)
    members = common.components(edges.unionByName(more))
    names = (
        classes.select("set_id", "row")
        .join(members.withColumnRenamed("node", "row"), "row", "left")
        .select("set_id", F.coalesce("root", "row").alias("component_id"))
    )
    found = seen.select("set_id", F.col("row").alias("doc_id")).join(names, "set_id")
    out = common.materialize(found.groupBy("doc_id").agg(F.min("component_id").alias("component_id")), "near-duplicates")
    common.drop_tables(seen, classes, centres, buckets, tried, edges, first, more, members)
    return out


def keep_first(docs: DataFrame, **parameters) -> DataFrame:
    """docs without all but the document of smallest doc_id of each near-duplicate group. Rows without a
    doc_id stay; rows that share one stay or go together. Columns stay as they are, whatever their names."""
    found = near_duplicates(docs.select("doc_id", "text"), **parameters)
    gone = common.materialize(found.where("doc_id <> component_id").select("doc_id"), "gone")
    common.drop_tables(found)
    return common.without_ids(docs, "doc_id", gone)


QUERIES = {"op2_simhash": op2_simhash}
ORACLES: dict[str, str] = {}
