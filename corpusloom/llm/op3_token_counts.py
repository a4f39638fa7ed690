"""Edit-aware token counts: a segment tree over each document's pre-tokens.

A leaf holds a run of neighbouring pre-tokens with their lengths and token counts; inner nodes hold the
sums of lengths and tokens below. An edit (start, end, replacement, in code points of the text it meets)
finds its leaves by descending along the lengths, cuts only the touched region and its context into
pre-tokens again, encodes those, and updates the sums on the way to the root. The result always equals
the count of the edited text as a whole.

Context. Where a pre-token ends depends on at most two characters after it, so cutting starts at the
first pre-token that ends within two characters of the edit or later. From the point where a new border
behind the edit meets an old one, the rest of the old borders hold, as they depend on what follows only.

Null texts count as empty. Repeated rows are counted each by itself; very long texts are counted whole. Columns
beside doc_id, text and the edits are ignored. An empty table gives an empty table. Edits of a document apply in
the order given; starts and ends outside the text are clamped, and an end before its start is taken as the
start. Null replacements delete.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .bpe_machine import ByteBpe
from .op8_byte_bpe import codec
from .tokenizer_files import path_of, pattern

LEAF = 64
#: where a pre-token ends depends on at most so many characters behind it
CONTEXT = 3


class CountTree:
    """Token count of a text under edits. A leaf holds its pre-tokens' lengths and token counts, and its part of
    the text, so an edit reads and rewrites the leaves it touches and those around them only."""

    def __init__(self, text: str, bpe: ByteBpe):
        self.bpe, self.encoded = bpe, 0
        self._start(text)

    def _start(self, text: str) -> None:
        lengths, counts = self.bpe.measure(text)
        self.encoded += len(lengths)
        self._plant(lengths, counts, text)

    def _plant(self, lengths: list[int], counts: list[int], text: str) -> None:
        leaves = [(lengths[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(lengths), LEAF)]
        self.size = 1
        while self.size < max(1, len(leaves)):
            self.size *= 2
        self.leaves = leaves + [([], []) for _ in range(self.size - len(leaves))]
        self.texts, at = [""] * self.size, 0
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, (run, of) in enumerate(leaves):
            self.chars[self.size + i], self.tokens[self.size + i] = sum(run), sum(of)
            self.texts[i] = text[at : at + self.chars[self.size + i]]
            at += len(self.texts[i])
        for node in range(self.size - 1, 0, -1):
            self._sum(node)

    def _sum(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def text(self) -> str:
        return "".join(self.texts)

    def _find(self, position: int) -> tuple[int, int]:
        """(leaf, first character of the leaf) of the leaf with the character at ``position``."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if position - start >= self.chars[node] and self.chars[node + 1]:
                start += self.chars[node]
                node += 1
        return node - self.size, start

    def _read(self, start: int, end: int) -> str:
        """The text from start to end (exclusive)."""
        if start >= end:
            return ""
        leaf, at = self._find(start)
        parts = [self.texts[leaf][start - at : end - at]]
        at += len(self.texts[leaf])
        while at < end:
            leaf += 1
            parts.append(self.texts[leaf][: end - at])
            at += len(self.texts[leaf])
        return "".join(parts)

    def _settled(self, old: int, last: tuple[int, int], target: int) -> tuple[int, tuple[int, int]]:
        """The first old border at ``target`` or behind it: its position, and (leaf, pre-token) behind it."""
        leaf, k = last
        while old < target:
            while leaf < self.size and k >= len(self.leaves[leaf][0]):
                leaf, k = leaf + 1, 0
            if leaf == self.size:
                break
            old += self.leaves[leaf][0][k]
            k += 1
        return old, (leaf, k)

    def edit(self, start: int, end: int, replacement: str) -> int:
        """Replace characters start to end (exclusive); gives the new token count."""
        size = self.chars[1]
        start = min(max(0, start), size)
        end = min(max(start, end), size)
        shift = len(replacement) - (end - start)
        if not size or not size + shift:
            self._start(replacement if not size else "")
            return self.n_tokens
        # the first pre-token to cut again: it holds the character two before the edit, or begins the text
        first_leaf, at = self._find(max(0, start - 2))
        leaf_start, first_k = at, 0
        run = self.leaves[first_leaf][0]
        while at + run[first_k] <= start - 2:
            at += run[first_k]
            first_k += 1
        cut_from = at
        # new pre-tokens from there until a border behind the edit is an old one too; the window of new text
        # grows until no border depends on what follows it
        reach = min(size, end + 64)
        window = self._read(cut_from, start) + replacement + self._read(end, reach)
        pieces: list[str] = []
        old, last, place = cut_from, (first_leaf, first_k), 0
        while True:
            match = self.bpe.pattern.search(window, place)
            if (match is None or match.end() + CONTEXT > len(window)) and reach < size:
                further = min(size, end + 2 * (reach - end))
                window += self._read(reach, further)
                reach = further
                continue
            if match is None:
                last = (self.size - 1, len(self.leaves[-1][0]))
                break
            pieces.append(match[0])
            place = match.end()
            if cut_from + place < start + len(replacement):
                continue
            target = max(end, cut_from + place - shift)
            old, last = self._settled(old, last, target)
            if old == cut_from + place - shift and old >= end:
                break
        last_leaf, last_k = last
        if last_leaf == self.size:
            last_leaf, last_k = self.size - 1, len(self.leaves[-1][0])
        lengths, counts = list(map(len, pieces)), self.bpe.count_pieces(pieces)
        self.encoded += len(pieces)
        head, tail = self.leaves[first_leaf], self.leaves[last_leaf]
        lengths = head[0][:first_k] + lengths + tail[0][last_k:]
        counts = head[1][:first_k] + counts + tail[1][last_k:]
        behind = sum(tail[0][last_k:])
        text = self.texts[first_leaf][: cut_from - leaf_start] + "".join(pieces) + (self.texts[last_leaf][-behind:] if behind else "")
        if len(lengths) > 4 * LEAF * (last_leaf - first_leaf + 1):  # a leaf would outgrow its kind: plant anew
            before, after = self.leaves[:first_leaf], self.leaves[last_leaf + 1 :]
            runs = [n for r, _ in before for n in r] + lengths + [n for r, _ in after for n in r]
            of = [n for _, c in before for n in c] + counts + [n for _, c in after for n in c]
            self._plant(runs, of, "".join([*self.texts[:first_leaf], text, *self.texts[last_leaf + 1 :]]))
            return self.n_tokens
        share = -(-len(lengths) // (last_leaf - first_leaf + 1)) or 1
        touched, at = set(), 0
        for i, leaf in enumerate(range(first_leaf, last_leaf + 1)):
            run, of = lengths[i * share : (i + 1) * share], counts[i * share : (i + 1) * share]
            self.leaves[leaf] = (run, of)
            self.chars[self.size + leaf], self.tokens[self.size + leaf] = sum(run), sum(of)
            self.texts[leaf] = text[at : at + self.chars[self.size + leaf]]
            at += len(self.texts[leaf])
            touched.add((self.size + leaf) // 2)
        while touched and 0 not in touched:
            for node in touched:
                self._sum(node)
            touched = {node // 2 for node in touched}
        return self.n_tokens


def count_tokens(docs: DataFrame, edits: str, path: str, split_pattern: str) -> DataFrame:
    """Token counts of ``docs(doc_id, text, <edits>)`` before and after the edits in column ``edits``, an
    array<struct<start long, end long, replacement string>>: doc_id, n_tokens, n_tokens_edited,
    n_pieces (pre-tokens encoded for the whole text), n_pieces_again (encoded because of edits). Narrow.
    """
    common.tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, split_pattern, 400_000)
        for batch in batches:
            rows = []
            for text, changes in zip(batch.column(1), batch.column(2)):
                tree = CountTree(text.as_py() or "", bpe)
                before, pieces = tree.n_tokens, tree.encoded
                for e in changes.as_py() or []:
                    if e is not None:
                        start = e["start"] or 0
                        tree.edit(start, start if e["end"] is None else e["end"], e["replacement"] or "")
                rows.append((before, tree.n_tokens, pieces, max(0, tree.encoded - pieces)))
            names = ["n_tokens", "n_tokens_edited", "n_pieces", "n_pieces_again"]
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *names])

    return docs.select("doc_id", "text", F.col(edits).alias("__edits")).mapInArrow(
        run, "doc_id long, n_tokens long, n_tokens_edited long, n_pieces long, n_pieces_again long"
    )


def standard_edits(docs: DataFrame) -> DataFrame:
    """docs with a column ``edits``: a note put before the text, a word put in at one quarter of it, and
    20 characters from its middle cut out (positions as each edit meets the text)."""
    n = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    note = F.concat(F.lit("[doc "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("] "))
    m = F.length(note).cast("long")

    def edit(start, end, replacement):
        return F.struct(start.alias("start"), end.alias("end"), replacement.alias("replacement"))

    quarter, half = m + F.floor(n / 4), m + 8 + F.floor(n / 2)
    zero = F.lit(0).cast("long")
    return docs.withColumn(
        "edits", F.array(edit(zero, zero, note), edit(quarter, quarter, F.lit(" edited ")), edit(half, half + 20, F.lit("")))
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = standard_edits(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return count_tokens(docs, "edits", path_of("byte_bpe_50k.tiktoken"), pattern())


QUERIES = {"op3_token_counts": op3_token_counts}
ORACLES: dict[str, str] = {}
