"""Token-ID output: fixed-width bit packing with block offsets.

Segment image (little endian), the unit of the file format:

    4s  magic "CLT1"      u16 bits per id     u16 zero       u32 ids per block (a multiple of 8)
    u64 ids               u64 documents
    u64[blocks + 1]       byte offset of each block in the payload
    u64[documents + 1]    first id of each document, and the end
    payload               blocks of ids, each id in `bits` bits, least significant bit first

Any id range is read by touching only the blocks it overlaps; a block is unpacked by numpy as a whole.
Segments are rows (shard, segment, start_in_shard, n_tokens, n_docs, doc_ids, image) of a Parquet table
written by Spark's own commit protocol, so that a lost executor or a repeated task leaves no half file
and any Hadoop file system will do. Shards follow doc_id order.

Null and empty texts have no ids but the end id. Repeated doc_ids are kept, ordered by the text's xxhash64,
then the text; null doc_ids come first. Very long texts are encoded whole and make a segment of their own.
Columns beside doc_id and text are ignored, whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .tokenizer_files import path_of
from .word_cache import TwoGenerationCache, hold

MAGIC, HEADER = b"CLT1", struct.Struct("<4sHHIQQ")
SEGMENT_SCHEMA = "shard int, segment int, start_in_shard long, n_tokens long, n_docs long, doc_ids array<long>, image binary"
DIGEST_SCHEMA = "shard int, doc_id long, position long, n_tokens long, ids_crc32 long"


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold every id of a vocabulary."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as one bit string, least significant bit first, padded to a byte."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, count: int, bits: int) -> np.ndarray:
    """The first ``count`` ids of a packed bit string, as unsigned 32-bit integers."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype(np.uint32)
    planes = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little")
    weights = np.uint32(1) << np.arange(bits, dtype=np.uint32)
    return planes.reshape(count, bits).astype(np.uint32) @ weights


def build_segment(ids: np.ndarray, starts: np.ndarray, bits: int, block: int = 4096) -> bytes:
    """The image of documents whose ids are concatenated in ``ids``; starts: each one's first id, and the end."""
    parts = [pack(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)]).astype("<u8")
    head = HEADER.pack(MAGIC, bits, 0, block, len(ids), len(starts) - 1)
    return b"".join([head, offsets.tobytes(), np.asarray(starts, "<u8").tobytes(), *parts])


class SegmentReader:
    """Random access to the ids of a segment image."""

    def __init__(self, image: bytes):
        magic, self.bits, _, self.block, self.n_tokens, self.n_docs = HEADER.unpack_from(image)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        n = -(-self.n_tokens // self.block) + 1
        self.offsets = np.frombuffer(image, "<u8", n, HEADER.size)
        self.starts = np.frombuffer(image, "<u8", self.n_docs + 1, HEADER.size + 8 * n).astype(np.int64)
        self.payload = memoryview(image)[HEADER.size + 8 * (n + self.n_docs + 1) :]

    def slice(self, start: int, end: int) -> np.ndarray:
        """Ids start to end (exclusive) of the segment; reads the overlapping blocks only."""
        start, end = max(0, start), min(end, self.n_tokens)
        if start >= end:
            return np.empty(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        parts = [
            unpack(
                self.payload[int(self.offsets[b]) : int(self.offsets[b + 1])],
                min(self.block, self.n_tokens - b * self.block),
                self.bits,
            )
            for b in range(first, last + 1)
        ]
        return np.concatenate(parts)[start - first * self.block : end - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.slice(int(self.starts[k]), int(self.starts[k + 1]))


def pieces(text: bytes, size: int = 1 << 22) -> Iterator[bytes]:
    """A text in pieces of about ``size`` bytes, cut before white space."""
    at = 0
    while at < len(text):
        space = re.compile(rb"\s").search(text, at + size) if at + size < len(text) else None
        end = space.start() if space else len(text)
        yield text[at:end]
        at = end


_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """Ids of whole texts by the lower-casing word tokenizer file of the tokenizers library.

    Its pre-tokenizer cuts a text into runs of letters, single digits and runs of signs, and drops white
    space; each part is encoded by itself. So the library encodes each distinct part once per worker
    (bounded memo), and a text's ids are its parts' ids in turn. Texts of ASCII and Latin-1 letters,
    which no normaliser but lower-casing changes, are cut into parts here, the whole text at once; of
    others, each white-space-delimited word goes through the whole library. Added tokens that a text spells out (such as
    <|endoftext|>, an id of the vocabulary, not the end id of a document) get their ids, as from the library.
    ``encode_bytes`` returns little-endian 16- or 32-bit integers.
    """

    LETTERS = rb"a-z\xdf-\xf6\xf8-\xff"
    PARTS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[" + LETTERS + rb"]+|[0-9]|[^\s0-9" + LETTERS + rb"]+")
    OTHER = re.compile(rb"[\x80-\xbf\xd7\xf7]")
    LOWER = bytes(b + 32 if 65 <= b <= 90 or 0xC0 <= b <= 0xDE and b != 0xD7 else b for b in range(256))

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # added tokens that stand in a text are taken for themselves, as the library does
        own = self.tokenizer.get_added_tokens_decoder()
        self.added = {t.content.encode(): np.array([i], self.dtype_of(self.tokenizer)).tobytes() for i, t in own.items()}
        self.cut = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + b")") if own else None
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.dtype = self.dtype_of(self.tokenizer)
        self.parts = TwoGenerationCache(self._encode_part, 350_000)
        self.words = TwoGenerationCache(self._encode_word, 50_000)
        # the byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(printable)]
        self.alphabet = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def _encode_part(self, part: bytes) -> bytes:
        text = part.decode("latin-1") if part.isascii() else "".join(map(self.alphabet.__getitem__, part.decode("latin-1").encode()))
        if part.isascii() and not part.isalnum():
            text = "".join(map(self.alphabet.__getitem__, part))
        return np.array([t.id for t in self.tokenizer.model.tokenize(text)], self.dtype).tobytes()

    def _encode_word(self, word: bytes) -> bytes:
        ids = self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids
        return np.array(ids, self.dtype).tobytes()

    @staticmethod
    def dtype_of(tokenizer) -> str:
        return "<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4"

    def encode_bytes(self, text: bytes) -> bytes:
        if self.cut and any(token in text for token in self.added):
            return b"".join([self.added.get(part) or self.encode_bytes(part) for part in self.cut.split(text)])
        if not text.isascii():
            try:
                narrow = text.decode().encode("latin-1")
            except UnicodeError:
                narrow = None
            if narrow is None or self.OTHER.search(narrow):
                return b"".join(map(self.words.__getitem__, text.split()))
            text = narrow
        text = text.translate(self.LOWER)
        return b"".join([x for piece in pieces(text) for x in map(self.parts.__getitem__, self.PARTS.findall(piece))])


def word_encoder(path: str) -> WordEncoder:
    hold("token_ids", _encoders.clear)
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def write_segments(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, segment_tokens: int = 1 << 20, block: int = 4096
) -> None:
    """Encode ``docs(doc_id, text)`` in ascending doc_id order into a table of segments at ``path``.

    Texts are dealt by range of doc_id, then hash (rows of one doc_id may fill several tasks), once, before
    encoding (text compresses better than ids), sorted in the same order within each range and packed by the
    task that encodes them. A segment holds whole documents, about
    ``segment_tokens`` ids or one longer document.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        bits, end = bits_for(encoder.vocabulary), np.array([end_id], encoder.dtype).tobytes()
        shard, segment, before = TaskContext.get().partitionId(), 0, 0
        ids: list[bytes] = []
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal segment, before, held
            starts = np.concatenate([[0], np.cumsum(lengths)])
            image = build_segment(np.frombuffer(b"".join(ids), encoder.dtype), starts, bits, block)
            row = (shard, segment, before, held, len(lengths), list(doc_ids), image)
            segment, before, held = segment + 1, before + held, 0
            for x in (ids, doc_ids, lengths):
                x.clear()
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            names = [c.split()[0] for c in SEGMENT_SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for doc_id, text in zip(batch.column(0).to_pylist(), texts):
                data = encoder.encode_bytes(text.as_py() or b"") + end
                ids.append(data)
                doc_ids.append(doc_id)
                lengths.append(len(data) // np.dtype(encoder.dtype).itemsize)
                held += lengths[-1]
                if held >= segment_tokens:
                    yield flush()
        if lengths:
            yield flush()

    common.tune(docs.sparkSession)
    order = ["doc_id", F.xxhash64("text")]
    ordered = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order, "text")
    ordered.mapInArrow(encode, SEGMENT_SCHEMA).write.option("compression", "zstd").parquet(path)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a table of segments: doc_id, start, n_tokens, ids_crc32, from the stored ids."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, before, doc_ids, image in zip(*(batch.column(i) for i in range(4))):
                reader = SegmentReader(image.as_py())
                ids = reader.slice(0, reader.n_tokens).astype("<u4", copy=False)
                s = reader.starts
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(s[:-1].tolist(), s[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(crc), shard.as_py()), pa.int32()),
                        pa.array(doc_ids.as_py(), pa.int64()),
                        pa.array(before.as_py() + s[:-1], pa.int64()),
                        pa.array(np.diff(s), pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    ["shard", "doc_id", "position", "n_tokens", "ids_crc32"],
                )

    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    # one row a shard, as many as the writing tasks
    totals = segments.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    bases = totals.select(
        "shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base")
    )
    rows = segments.select("shard", "start_in_shard", "doc_ids", "image").mapInArrow(digest, DIGEST_SCHEMA)
    return rows.join(F.broadcast(bases), "shard").select(
        "doc_id", (F.col("base") + F.col("position")).cast("long").alias("start"), "n_tokens", "ids_crc32"
    )


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch_path(spark, "tokens")
    write_segments(common.table(spark, sf_dir, "documents"), path, path_of("word_bpe_49k.json"))
    return read_digests(spark, path)


QUERIES = {"op1_token_ids": op1_token_ids}
ORACLES: dict[str, str] = {}
