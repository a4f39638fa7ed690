"""Counts of hashed items over a whole corpus, as upper bounds: items whose hashes fall in one slot share its count.

Tasks hand over the slots of their items (``SlotCounts``), at most ``most`` at a time, as compressed pairs of places
and counts for each of 1,024 ranges of slots; ``summed`` adds them range by range and brings what is made of the
sums (a bit or a byte for each slot) to the driver. So what a task holds, and what is gathered and broadcast, is
fixed by the number of slots; what is shuffled is in proportion to the items.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANGES = 10


def slot_bits(items: float, least: int = 16, most: int = 28) -> int:
    """Bits of a slot number, so that there are about as many slots as ``items``, within the bounds."""
    return min(most, max(least, int(max(1.0, items)).bit_length()))


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers spread evenly: every bit depends on every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slot_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return hashes >> np.uint64(64 - bits)


def two_slots(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent slots of each hash, one in either half of the slots: the smaller count is the bound, so only
    what meets frequent items in both is taken for frequent."""
    again = mixed(hashes * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))
    return slot_of(hashes, bits - 1), slot_of(again, bits - 1) + np.uint64(1 << (bits - 1))


class SlotCounts:
    """The slots a task has seen and not yet given out."""

    def __init__(self, bits: int, most: int = 1 << 22):
        self.bits, self.most, self.parts, self.n = bits, most, [], 0

    def add(self, slots: np.ndarray) -> None:
        self.parts.append(slots.astype(np.uint32))
        self.n += len(slots)

    def full(self) -> bool:
        return self.n >= self.most

    def rows(self) -> tuple[list[int], list[bytes]]:
        """(range, packed counts) of what has been added since the last call."""
        if not self.n:
            return [], []
        slots, counts = np.unique(np.concatenate(self.parts), return_counts=True)
        self.parts, self.n = [], 0
        return packed_ranges(slots, counts, self.bits)


def packed_ranges(slots: np.ndarray, counts: np.ndarray, bits: int) -> tuple[list[int], list[bytes]]:
    """(range, packed counts) of slots (uint32) in ascending order."""
    width = bits - RANGES
    cuts = np.searchsorted(slots, np.arange((1 << RANGES) + 1, dtype=np.uint64) << np.uint64(width)).tolist()
    ranges = [r for r in range(1 << RANGES) if cuts[r] < cuts[r + 1]]
    return ranges, [pack(slots[cuts[r] : cuts[r + 1]] - np.uint32(r << width), counts[cuts[r] : cuts[r + 1]]) for r in ranges]


def pack(places: np.ndarray, counts: np.ndarray) -> bytes:
    both = np.concatenate([np.diff(places, prepend=places.dtype.type(0)), np.minimum(counts, (1 << 32) - 1)]).astype("<u4")
    return zlib.compress(both.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(blob), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()
    return np.cumsum(both[: len(both) // 2]), both[len(both) // 2 :]


def _by_range(counts: DataFrame, bits: int, row: Callable[[int, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """What ``row`` makes of each range and the sums of its slots; counts(range int, counts binary)."""
    width = 1 << (bits - RANGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, np.zeros(width, np.int64)
        for batch in batches:
            for r, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if r != at:
                    if at is not None:
                        yield row(at, total)
                    at, total = r, np.zeros(width, np.int64)
                places, n = unpack(blob.as_py())
                total[places] += n
        if at is not None:
            yield row(at, total)

    found = counts.where(F.col("range").isNotNull()).select("range", "counts").repartition("range").sortWithinPartitions("range")
    return found.mapInArrow(run, schema)


def summed(counts: DataFrame, bits: int, told: Callable[[np.ndarray], np.ndarray]) -> bytes:
    """What ``told`` makes of each range's sums, for all slots in order; counts(range int, counts binary)."""

    def row(r: int, sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([told(sums).tobytes()], pa.binary())], ["range", "told"])

    rows = _by_range(counts, bits, row, "range int, told binary").toArrow()
    by_range = dict(zip(rows["range"].to_pylist(), rows["told"].to_pylist()))
    nothing = told(np.zeros(1 << (bits - RANGES), np.int64)).tobytes()
    return b"".join(by_range.get(r, nothing) for r in range(1 << RANGES))


def slot_sums(counts: DataFrame, bits: int) -> DataFrame:
    """(place, n) of the slots that have been counted; counts(range int, counts binary)."""

    def row(r: int, sums: np.ndarray) -> pa.RecordBatch:
        met = np.flatnonzero(sums)
        return pa.RecordBatch.from_arrays([pa.array(met + (r << (bits - RANGES))), pa.array(sums[met])], ["place", "n"])

    return _by_range(counts, bits, row, "place long, n long")


def at_least(threshold: int) -> Callable[[np.ndarray], np.ndarray]:
    """A bit for each slot (lowest first), set where its sum reaches the threshold."""
    return lambda sums: np.packbits(sums >= threshold, bitorder="little")


def bit_of(table: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """The bits of ``table`` (uint8) at ``slots``."""
    return (table[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)
