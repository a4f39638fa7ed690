"""Byte-level BPE encoding and decoding of whole texts, by the transducer of ``bpe_machine``.

``encode`` adds the ids of each text, ``decode`` the text of each list of ids, ``digests`` the round trip's
lengths and hashes. All are narrow: no shuffle, one Arrow batch in memory. Null and empty texts have no
ids, very long ones are read whole. Repeated rows give repeated rows, an empty table an empty one. ``encode``
and ``decode`` keep other columns; an added column replaces one of its name, in whatever case.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .bpe_machine import ByteBpe, Utf8Machine, read_ranks
from .tokenizer_files import path_of, pattern
from .word_cache import hold

_codecs: dict[tuple[str, str, int], ByteBpe] = {}


def codec(path: str, split_pattern: str, memory: int = 250_000) -> ByteBpe:
    """This worker's codec; the last one asked for is kept."""
    hold("byte_bpe", _codecs.clear)
    key = (path, split_pattern, memory)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = ByteBpe(read_ranks(path), split_pattern, memory)
    return _codecs[key]


def _map_column(df: DataFrame, source: str, out: str, kind: T.DataType, f: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """df with column ``out`` = f(column ``source``), computed batch by batch."""
    common.tune(df.sparkSession)
    return common.with_columns(df, source, [T.StructField(out, kind)], lambda: lambda values: [f(values)])


def encode(df: DataFrame, path: str, split_pattern: str, source: str = "text", out: str = "ids") -> DataFrame:
    """df with the ids of column ``source`` as an array of integers (null for a null text)."""

    def f(texts: pa.Array) -> pa.Array:
        bpe = codec(path, split_pattern)
        return pa.array([None if t is None else np.frombuffer(bpe.encode_bytes(t), "<i4") for t in texts.to_pylist()], pa.list_(pa.int32()))

    return _map_column(df, source, out, T.ArrayType(T.IntegerType()), f)


def decode(df: DataFrame, path: str, split_pattern: str, source: str = "ids", out: str = "text", step: int = 4096) -> DataFrame:
    """df with the text of the ids in ``source``: fed ``step`` ids at a time to the incremental UTF-8
    machine; bytes that are no UTF-8 become U+FFFD."""

    def one(bpe: ByteBpe, ids: list[int]) -> str:
        machine = Utf8Machine()
        parts = [machine.feed(bpe.decode(ids[i : i + step])) for i in range(0, len(ids), step)]
        return "".join([*parts, machine.close()])

    def f(lists: pa.Array) -> pa.Array:
        bpe = codec(path, split_pattern)
        return pa.array([None if x is None else one(bpe, x) for x in lists.to_pylist()], pa.string())

    return _map_column(df, source, out, T.StringType(), f)


def digests(docs: DataFrame, path: str, split_pattern: str, with_ids: bool = False, memory: int = 250_000) -> DataFrame:
    """Per document of ``docs(doc_id, text)``: doc_id, n_tokens, and sha256 of the ids and of their decoding;
    with_ids: the ids too, as array<int>. memory: see ``ByteBpe``."""
    common.tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, split_pattern, memory)
        for batch in batches:
            counts, of_ids, of_bytes, all_ids = [], [], [], []
            for text in batch.column(1):
                ids = bpe.encode_bytes(text.as_py() or "")
                counts.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                back = hashlib.sha256()
                listed = np.frombuffer(ids, "<u4").tolist()
                for i in range(0, len(listed), 1 << 16):
                    back.update(bpe.decode(listed[i : i + (1 << 16)]))
                of_bytes.append(back.hexdigest())
                if with_ids:
                    all_ids.append(np.frombuffer(ids, "<i4"))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents"), path_of("byte_bpe_50k.tiktoken"), pattern())


QUERIES = {"op8_byte_bpe": op8_byte_bpe}
ORACLES: dict[str, str] = {}
