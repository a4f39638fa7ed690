"""Column functions over text: normalisers, tokens, n-grams, extraction. All stay inside the JVM but the
Unicode normal forms, which have no built-in."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WORD = r"[\p{L}\p{N}_]+"


def blank(c: Column | str) -> Column:
    """Runs of white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(c, r"[ \t\n\r\f]+", " "))


def fold(c: Column | str) -> Column:
    """Lower case, with sharp s written out."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def norm_ws_fold(c: Column | str) -> Column:
    return blank(fold(c))


def words(c: Column | str) -> Column:
    """Lower-case Unicode words, in order."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def norm_words(c: Column | str) -> Column:
    return F.array_join(words(c), " ")


def norm_turkish(c: Column | str) -> Column:
    """Dotted and dotless i are told apart before lower-casing."""
    return blank(F.lower(F.translate(c, "Iİ", "ıi")))


def norm_answer(c: Column | str) -> Column:
    """For answer matching: lower case, without articles, then without ASCII signs, white space collapsed."""
    no_articles = F.regexp_replace(F.lower(c), r"(?<![\p{L}\p{N}_])(a|an|the)(?![\p{L}\p{N}_])", " ")
    return blank(F.regexp_replace(no_articles, r"[!-/:-@\[-`{-~]", ""))


def norm_numbers(c: Column | str) -> Column:
    """Digit runs become <num>; everything else that is no word becomes a space."""
    masked = F.regexp_replace(F.lower(c), r"[0-9]+", "<num>")
    return blank(F.regexp_replace(masked, r"[^\p{L}\p{N}_<>]+", " "))


def fingerprint(c: Column | str, n: int = 8) -> Column:
    """First n words of the number-masked text."""
    return F.array_join(F.slice(F.split(norm_numbers(c), " "), 1, n), " ")


def strip_wrapper(c: Column | str, prefix: str) -> Column:
    """Without a leading instruction that matches ``prefix`` (a pattern)."""
    return F.regexp_replace(c, "^(?:" + prefix + r")\s*", "")


def canonical_newlines(c: Column | str) -> Column:
    """Without byte order mark; every line end a line feed."""
    return F.regexp_replace(F.regexp_replace(c, "^﻿", ""), r"\r\n?", "\n")


def ngrams(tokens: Column, n: int) -> Column:
    """Distinct n-word sequences, space-joined; none for shorter texts."""
    return F.when(F.size(tokens) < n, F.array().cast("array<string>")).otherwise(
        F.array_distinct(
            F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), " "))
        )
    )


def ngram_hashes(tokens: Column, n: int) -> Column:
    """64-bit hashes of the distinct n-word sequences: the words are hashed in a row, no text is made of them."""
    return F.when(F.size(tokens) < n, F.array().cast("array<bigint>")).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.xxhash64(F.slice(tokens, i, n))))
    )


def ngram_list(tokens: Column, n: int) -> Column:
    """All n-word sequences with repeats."""
    return F.when(F.size(tokens) < n, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    )


def gram_hashes(tokens: Column, n: int) -> Column:
    """64-bit hashes of all n-word sequences with repeats."""
    return F.when(F.size(tokens) < n, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.xxhash64(F.slice(tokens, i, n)))
    )


def lines(c: Column | str) -> Column:
    """White-space-collapsed lines that aren't empty. White space is collapsed in the whole text, then cut."""
    flat = F.regexp_replace(c, r"[ \t\r\f]+", " ")
    return F.filter(F.transform(F.split(flat, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def sentences(c: Column | str) -> Column:
    """Trimmed, white-space-collapsed pieces between sentence ends that aren't empty."""
    flat = F.regexp_replace(c, r"[ \t\n\r\f]+", " ")
    return F.filter(F.transform(F.split(flat, r"[.!?]+"), lambda x: F.trim(x)), lambda x: x != "")


def numbers(c: Column | str) -> Column:
    """Digit runs without their separators, of two digits or more."""
    found = F.regexp_extract_all(c, F.lit(r"[0-9][0-9.,]*"), F.lit(0))
    return F.filter(F.transform(found, lambda x: F.regexp_replace(x, "[.,]", "")), lambda x: F.length(x) >= 2)


def host(c: Column | str) -> Column:
    """Lower-case host without a leading www."""
    return F.regexp_replace(F.lower(F.regexp_extract(c, r"^[a-zA-Z]+://([^/?#:]+)", 1)), r"^www\.", "")


#: fixed values: the character references that texts hold most
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def html_text(c: Column | str) -> Column:
    """Tags become spaces, the usual character references are decoded, white space is collapsed."""
    out = F.regexp_replace(c, "<[^>]*>", " ")
    for name, sign in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(sign))
    return blank(out)


def _fold_spaced(t: str) -> str:
    """NFKC, case folded, white space collapsed. Normal forms of ASCII are itself, and no list of words is made."""
    folded = t.lower() if t.isascii() else unicodedata.normalize("NFKC", t).casefold()
    return _SPACES.sub(" ", folded).strip()


#: white space as str.split() knows it
_SPACES = re.compile(r"\s+")


#: fixed value: texts of a batch that are Python strings at once
_AT_ONCE = 64


def _few_at_once(s: pa.Array, change: Callable[[str], str]) -> pa.Array:
    """``change`` of each text, null for null. Few are Python strings at once, and where none of these changes they are not
    copied."""
    parts, same = [], True
    for start in range(0, len(s), _AT_ONCE):
        part = s.slice(start, _AT_ONCE)
        had = part.to_pylist()
        new = [None if t is None else change(t) for t in had]
        if new != had:
            part, same = pa.array(new, s.type), False
        parts.append(part)
    return s if same else pa.concat_arrays(parts)


def _composed(t: str) -> str:
    return t if t.isascii() or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t)


@F.arrow_udf(StringType())
def nfc(s: pa.Array) -> pa.Array:
    return _few_at_once(s, _composed)


@F.arrow_udf(StringType())
def nfkc_casefold(s: pa.Array) -> pa.Array:
    return _few_at_once(s, _fold_spaced)


def bucket(*parts: Column | str, modulus: int) -> Column:
    """A number from 0 to modulus - 1 from the md5 of the parts, the same in any SQL engine."""
    text = F.concat_ws(":", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(modulus)).cast("long")
