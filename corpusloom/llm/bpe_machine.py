"""Byte-level BPE as a finite-state transducer, determinised lazily, and a streaming decoder.

Encoding. A sequence of tokens is the BPE encoding of its bytes exactly when every two neighbours stay
apart while the merges are applied to the two alone. So the nondeterministic machine reads bytes down
the vocabulary trie, and at a token's node may emit the token if it may follow the one before; its
configurations are (kind of the token before, trie node). Every prefix of the input has exactly one
encoding, hence there is at most one configuration for each possible start of the token being read:
their number, and with it the lookahead, is bounded by the longest token. The subset construction turns
sets of configurations into states as they are met; a transition keeps, for each configuration it leads
to, the one it came from and the token it emits. Once all configurations have come from one, the tokens
up to there are given out. States are dropped and found anew when there are too many.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import regex

from .word_cache import TwoGenerationCache

NEVER = 1 << 60

# fixed values: the public pattern of this vocabulary, and the same over Latin-1 bytes
GPT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_L, _N, _S = rb"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", rb"0-9\xb2\xb3\xb9\xbc-\xbe", rb"\t-\r \x85\xa0"
NARROW_PATTERN = (
    rb"'s|'t|'re|'ve|'m|'ll|'d| ?[" + _L + rb"]+| ?[" + _N + rb"]+| ?[^" + _S + _L + _N + rb"]+"
    rb"|[" + _S + rb"]+(?![^" + _S + rb"])|[" + _S + rb"]+"
)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class BpeMachine:
    def __init__(self, ranks: dict[bytes, int], max_transitions: int = 250_000):
        self.ranks, self.max_transitions = ranks, max_transitions
        self.tokens = {i: t for t, i in ranks.items()}
        self.trie: dict[int, int] = {}  # node << 8 | byte -> node; the root is 0
        self.token_at: list[int] = [-1]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                key = node << 8 | byte
                following = self.trie.get(key)
                if following is None:
                    following = self.trie[key] = len(self.token_at)
                    self.token_at.append(-1)
                node = following
            self.token_at[node] = rank
        # the lowest rank at which a part is merged with something to its right
        self.joined: dict[bytes, int] = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                if rank < self.joined.get(token[:i], NEVER) and token[i:] in ranks:
                    self.joined[token[:i]] = rank
        self._kinds: dict[tuple, int] = {}
        self._rights: list[tuple] = [()]
        self._kind: dict[int, int] = {}
        self._left: dict[int, list] = {}
        self._right: dict[int, list] = {}
        self._whole: dict[int, bool] = {}
        self._forget()

    def _forget(self) -> None:
        start = (0,)
        self.states: list[tuple[int, ...]] = [start]
        self.number: dict[tuple[int, ...], int] = {start: 0}
        self.moves: dict[int, tuple[int, tuple[int, ...], int]] = {}
        self._paths: dict[tuple[int, ...], tuple[int, ...]] = {}

    # -- which tokens may be neighbours

    def merge(self, data: bytes, spine: list | None = None, at_end: bool = False) -> list[bytes]:
        """Apply the merges, lowest rank first, leftmost first. spine: gets (part, rank at which it is
        merged on) of the first part, or of the last if at_end."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = NEVER, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1], NEVER)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            if spine is not None and at == (len(parts) - 2 if at_end else 0):
                spine.append((parts[-1 if at_end else 0], best))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if spine is not None and parts:
            spine.append((parts[-1 if at_end else 0], NEVER))
        return parts

    def _spine(self, token: int, at_end: bool) -> list:
        known = self._right if at_end else self._left
        found = known.get(token)
        if found is None:
            found = known[token] = []
            self._whole[token] = len(self.merge(self.tokens[token], found, at_end)) == 1
        return found

    def kind(self, token: int) -> int:
        """Number of the class of tokens that let the same tokens follow: the parts at the end of
        ``token`` in the course of its merges, without those that never merge to the right in time."""
        found = self._kind.get(token)
        if found is None:
            kept: list[tuple] = []
            for part, until in self._spine(token, True):
                part = part if self.joined.get(part, NEVER) < until else None
                if part is None and kept and kept[-1][0] is None:
                    kept.pop()
                kept.append((part, until))
            found = self._kinds.setdefault(tuple(kept), len(self._rights))  # 0 is the start
            if found == len(self._rights):
                self._rights.append(tuple(kept))
            self._kind[token] = found
        return found

    def may_follow(self, before: int, token: int) -> bool:
        """Whether no merge joins a token of kind ``before`` and ``token`` when applied to both together;
        before 0: the start."""
        left = self._spine(token, False)
        if not self._whole[token]:
            return False
        if before == 0:
            return True
        right, i, j, ranks = self._rights[before], 0, 0, self.ranks
        while True:
            (x, x_end), (y, y_end) = right[i], left[j]
            if x is not None:
                r = ranks.get(x + y, NEVER)
                if r < x_end and r <= y_end and r < NEVER:
                    return False
            if x_end == y_end == NEVER:
                return True
            if x_end <= y_end:
                i += 1
            else:
                j += 1

    # -- the determinised machine

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...], int]:
        """(state that follows, for each of its configurations the place of the one it came from, the
        token emitted on the way to the last one or -1). A configuration is kind << 20 | node."""
        trie, token_at, met, origin = self.trie, self.token_at, [], []
        ended, emitted = -1, -1
        for i, c in enumerate(self.states[state]):
            following = trie.get((c & 0xFFFFF) << 8 | byte)
            if following is None:
                continue
            met.append(c & ~0xFFFFF | following)
            origin.append(i)
            token = token_at[following]
            if ended < 0 and token >= 0 and self.may_follow(c >> 20, token):
                ended, emitted = i, token
        if ended >= 0:
            met.append(self.kind(emitted) << 20)
            origin.append(ended)
        if not met:
            raise ValueError("the vocabulary lacks a byte")
        key, path = tuple(met), tuple(origin)
        number = self.number.get(key)
        if number is None:
            number = self.number[key] = len(self.states)
            self.states.append(key)
        out = self.moves[state << 8 | byte] = (number, self._paths.setdefault(path, path), emitted)
        return out

    @staticmethod
    def _trace(path: list, place: int) -> list[int]:
        """Tokens on the way to the configuration at ``place`` after ``path``."""
        out = []
        for _, origin, token in reversed(path):
            if token >= 0 and place == len(origin) - 1:
                out.append(token)
            place = origin[place]
        out.reverse()
        return out

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.moves) > self.max_transitions:
            self._forget()
        state, moves, out = 0, self.moves, []
        path = []
        for byte in piece:
            move = moves.get(state << 8 | byte)
            if move is None:
                move = self._move(state, byte)
                if len(moves) > 2 * self.max_transitions:  # within a very long piece: go on from its state alone
                    keep = self.states[move[0]]
                    self._forget()
                    moves = self.moves
                    if keep not in self.number:
                        self.number[keep] = len(self.states)
                        self.states.append(keep)
                    move = (self.number[keep], move[1], move[2])
            path.append(move)
            state = move[0]
            if len(path) >= 256 and len(move[1]) == 1:
                out.extend(self._trace(path, 0))
                path.clear()
        if path:
            out.extend(self._trace(path, len(path[-1][1]) - 1))
        return out


class ByteBpe:
    """Encoding and decoding of whole texts by a ranks file, as the tiktoken library does it without
    special tokens: the pattern splits the text, each match is encoded by itself."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memory: int = 250_000):
        """memory: about how many transitions, and how many pre-tokens, a worker remembers."""
        self.machine = BpeMachine(ranks, memory)
        self.pattern = regex.compile(pattern)
        size = max(ranks.values(), default=0) + 1
        self.pieces: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            self.pieces[rank] = token
        self._wide = TwoGenerationCache(lambda p: self.machine.encode_piece(p.encode("utf-8", "replace")), memory // 5)
        self._counts = TwoGenerationCache(self._count, memory)
        self._narrow = None
        if pattern == GPT_PATTERN:
            self._narrow = re.compile(NARROW_PATTERN)
        self._pieces = TwoGenerationCache(self._piece, memory * 4 // 5)

    def _piece(self, piece: bytes) -> bytes:
        data = piece if piece.isascii() else piece.decode("latin-1").encode()
        return np.array(self.machine.encode_piece(data), "<u4").tobytes()

    def _count(self, piece: bytes | str) -> int:
        """Tokens of a pre-token, given in one-byte form or as text."""
        data = piece.encode("utf-8", "replace") if isinstance(piece, str) else piece if piece.isascii() else piece.decode("latin-1").encode()
        return len(self.machine.encode_piece(data))

    def measure(self, text: str) -> tuple[list[int], list[int]]:
        """Lengths, in code points, and token counts of the text's pre-tokens."""
        try:
            narrow = self._narrow and text.encode("latin-1")
        except UnicodeError:
            narrow = None
        pieces = self.pattern.findall(text) if narrow is None else self._narrow.findall(narrow)
        return list(map(len, pieces)), list(map(self._counts.__getitem__, pieces))

    def count_pieces(self, pieces: list[str]) -> list[int]:
        return list(map(self._counts.__getitem__, pieces))

    def encode_slow(self, text: str) -> list[int]:
        """Without any shortcut or memo of pre-tokens."""
        return [i for p in self.pattern.findall(text) for i in self.machine.encode_piece(p.encode("utf-8", "replace"))]

    def encode_bytes(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers. Pre-tokens met before in this
        worker are looked up (bounded memo). Latin-1 texts are split in their one-byte form, which the
        pattern's byte version does several times faster."""
        try:
            narrow = self._narrow and text.encode("latin-1")
        except UnicodeError:
            narrow = None
        if narrow is None:
            return np.array(self.encode_wide(text), "<u4").tobytes()
        return b"".join(map(self._pieces.__getitem__, self._narrow.findall(narrow)))

    def encode_wide(self, text: str) -> list[int]:
        out: list[int] = []
        for piece in self.pattern.findall(text):
            out.extend(self._wide[piece])
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


class Utf8Machine:
    """Incremental UTF-8: feed() takes bytes as they come and gives the text that is complete.

    The state is the tail that may still become a character. Malformed bytes become U+FFFD, one for each
    maximal part of a sequence, as in Python's own "replace".
    """

    #: first byte's high bits -> bytes of the sequence
    def __init__(self):
        self.tail = b""

    @staticmethod
    def _open(data: bytes) -> int:
        """How many bytes at the end are a proper beginning of a longer sequence."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead & 0xC0 == 0x80:
                continue
            need = 4 if 0xF0 <= lead <= 0xF4 else 3 if 0xE0 <= lead <= 0xEF else 2 if 0xC2 <= lead <= 0xDF else 1
            if back >= need:
                return 0
            if back > 1:
                low = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, 0x80)
                high = {0xED: 0x9F, 0xF4: 0x8F}.get(lead, 0xBF)
                if not low <= data[-back + 1] <= high:
                    return 0
            return back
        return 0

    def feed(self, data: bytes) -> str:
        data = self.tail + data
        n = self._open(data)
        self.tail = data[len(data) - n :] if n else b""
        return (data[:-n] if n else data).decode("utf-8", "replace")

    def close(self) -> str:
        out, self.tail = self.tail.decode("utf-8", "replace"), b""
        return out
