"""Places and patterns of the public tokenizer files; every operator takes a path as a parameter."""

from __future__ import annotations

import importlib


def path_of(name: str) -> str:
    return importlib.import_module("public_tokenizers").path(name)


def pattern() -> str:
    return importlib.import_module("public_tokenizers").PATTERN
