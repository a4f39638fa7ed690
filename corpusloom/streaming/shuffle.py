"""A bounded shuffle of streams: rows of a shard pass a buffer in keyed state and leave it in a seeded order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocks_db(spark) -> None:
    """Keyed state of any kind lives in RocksDB: on disk and in the checkpoint folder, not in the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_DB)


def draw(seed: str, shard: str, n: int, below: int) -> int:
    """A number below ``below``, by hash: the same on any worker and for any cut into batches."""
    return int.from_bytes(hashlib.blake2b(f"{seed}:{shard}:{n}".encode(), digest_size=8).digest()) % below


class _Buffer(StatefulProcessor):
    def __init__(self, row: StructType, names: list[str], seed: str, size: int, scan_limit: int | None):
        self.row, self.names, self.seed, self.size, self.scan_limit = row, names, seed, size, scan_limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", self.row)
        self.counts = handle.getValueState("counts", "scanned long, given long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802
        shard = str(key[0])
        scanned, given = self.counts.get() if self.counts.exists() else (0, 0)
        held, ended = [tuple(x) for x in self.held.get()] if self.held.exists() else [], False

        def give() -> Row:
            nonlocal given
            # the oldest must go once all later ones could overtake it
            oldest = min(range(len(held)), key=lambda i: held[i][0])
            place = oldest if held[oldest][0] + self.size <= given else draw(self.seed, shard, given, len(held))
            out = held[place]
            held[place] = held[-1]
            held.pop()
            given += 1
            return Row(**dict(zip(self.names, (key[0], given - 1, *out))))

        for row in sorted((tuple(r) for r in rows), key=lambda r: (r[2], r[1])):  # ends after rows
            _, seq, end, *rest = row
            if end:
                ended = True
            elif self.scan_limit is None or scanned < self.scan_limit:
                held.append((scanned, *rest))
                scanned += 1
                if len(held) > self.size:
                    yield give()
        while ended and held:
            yield give()
        self.counts.update((scanned, given))
        self.held.put(held) if held else self.held.clear()

    def close(self) -> None:
        pass


def bounded_shuffle(stream: DataFrame, shard: str, seq: str, end: str, seed: str, size: int = 10_000, scan_limit: int | None = None) -> DataFrame:
    """(shard, place, source_place, other columns) of a stream whose rows are numbered by ``seq`` within a shard, and whose
    last row of each shard has ``end`` set (and is not given out).

    A shard's rows wait in a buffer of ``size`` rows; each row that comes pushes out one that a seeded hash picks, or the
    oldest where it has waited as long as it may. So a row moves by ``size`` places at most in either direction, and
    the order depends on the seed only, not on batches. Rows beyond ``scan_limit`` of a shard are passed over. The
    end gives out what is left, in the same way. Rows of a batch are put in order of ``seq``; batches must come in that
    order. A task holds one shard's buffer and its rows of one batch.
    """
    use_rocks_db(stream.sparkSession)
    kinds = [stream.schema[c] for c in stream.columns if c not in (shard, seq, end)]
    held = StructType([StructField("source_place", LongType()), *kinds])
    out = StructType([StructField(shard, stream.schema[shard].dataType), StructField("place", LongType()), *held.fields])
    keyed = stream.select(shard, F.col(seq).cast("long").alias(seq), end, *[f.name for f in kinds])
    return keyed.groupBy(shard).transformWithState(_Buffer(held, out.names, seed, size, scan_limit), out, "Append", "None")
