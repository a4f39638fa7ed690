"""Pieces of DuckDB SQL that mirror ``functions.text``."""

from __future__ import annotations


def blank(x: str) -> str:
    return f"trim(regexp_replace({x}, '[ \\t\\n\\r\\f]+', ' ', 'g'))"


def fold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def words(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]+')"


def norm_words(x: str) -> str:
    return f"array_to_string({words(x)}, ' ')"


def ngram_list(w: str, n: int) -> str:
    return f"list_transform(range(1, len({w}) - {n} + 2), lambda i: array_to_string({w}[i:i + {n - 1}], ' '))"


def ngrams(w: str, n: int) -> str:
    return f"list_distinct({ngram_list(w, n)})"


def lines(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, chr(10)), lambda l: {blank('l')}), lambda l: l <> '')"


def sentences(x: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({x}, '[.!?]+'), lambda l: {blank('l')}), lambda l: l <> '')"


def bucket(x: str, modulus: int) -> str:
    return f"CAST(('0x' || substr(md5({x}), 1, 8))::BIGINT % {modulus} AS BIGINT)"


def host(x: str) -> str:
    return f"regexp_replace(lower(regexp_extract({x}, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\\.', '')"
