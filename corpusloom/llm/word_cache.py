"""A bounded memo for per-word results inside a Python worker."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Hashable

#: what operators hold in this Python worker between tasks: name -> a function that lets go of it
_held: dict[str, Callable[[], None]] = {}


def hold(name: str, release: Callable[[], None]) -> None:
    """Called where a task of operator ``name`` begins: what other operators have left here is released,
    as workers are reused and their memory would add up."""
    others = [k for k in _held if k != name]
    for k in others:
        _held.pop(k)()
    _held[name] = release
    if others:
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # glibc only: give freed memory back
            ctypes.CDLL(None).malloc_trim(0)


#: keys beyond this length are computed each time: they hardly come again, and bound what an entry takes
LONGEST = 64


class TwoGenerationCache(dict):
    """dict of texts or bytes whose missing keys are computed by ``compute``; holds at most 2 * ``limit`` entries,
    none with a key of more than LONGEST characters, so its bytes are bounded as well.

    When the young generation is full it becomes the old one, and entries of the old one that are
    asked for again are kept. Frequent words thus stay, and memory is bounded on any corpus.
    """

    def __init__(self, compute: Callable[[Hashable], object], limit: int = 300_000):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
            if len(key) > LONGEST:
                return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value

    def forget(self) -> None:
        self.clear()
        self.old = {}
