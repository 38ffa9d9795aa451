"""Column functions on text, and the same rules as DuckDB SQL."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 29 code points that split words, as a class for Java and for RE2.
WS = WS_SQL = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

#: The patterns of personal data, replaced in this order.
PII = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "phone": r"\b(?:\+?\d{1,3}[\s-]?)?\(?\d{3}\)?[\s-]?\d{3}[\s-]?\d{4}\b",
    "ipv4": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
}

# XXH64 primes: fixed values of the published algorithm.
_P1, _P2, _P3, _P4, _P5 = (
    11400714785074694791,
    14029467366897019727,
    1609587929392839161,
    9650029242287828579,
    2870177450012600261,
)
_M = (1 << 64) - 1


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The runs of characters that aren't white space."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WS + "+"), "")


def words_sql(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{WS_SQL}+'), lambda x: x <> '')"


def fold(text: Column) -> Column:
    """Case folding for the letters of the corpus' languages; casefold differs on 324 rare code points."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def normalise(text: Column) -> Column:
    """Folded, with everything but letters, numbers, underscores and white space as one space, trimmed."""
    spaced = F.regexp_replace(fold(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_" + WS[1:] + "+", " ")
    return F.trim(F.regexp_replace(spaced, WS + "+", " "))


def normalise_sql(text: str) -> str:
    inner = rf"regexp_replace(replace(lower({text}), 'ß', 'ss'), '[^\p{{L}}\p{{N}}_{WS_SQL[1:]}+', ' ', 'g')"
    return f"trim(regexp_replace({inner}, '{WS_SQL}+', ' ', 'g'))"


_NO_WORD = re.compile(r"[^\w\s]+")


def normal_words(text: str | None) -> list[str]:
    """The words of :func:`normalise`, in a worker: case-folded, with everything but word characters and white space as a break."""
    return _NO_WORD.sub(" ", (text or "").casefold()).split()


def window_hashes(words: list[str], n: int) -> np.ndarray:
    """A 64-bit hash of each window of ``n`` words, one for each position; none with fewer words."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        out = (out ^ h[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def top_counts(text: str | None, n: int) -> tuple[int, int, int]:
    """(words, how often the most frequent word occurs, and the most frequent n-gram; 0 with fewer words), in a worker."""
    words = (text or "").split()
    if not words:
        return 0, 0, 0
    grams = max(Counter(zip(*(words[i:] for i in range(n)), strict=False)).values()) if len(words) >= n else 0
    return len(words), max(Counter(words).values()), grams


def ngrams(parts: Column, n: int) -> Column:
    """The n-grams of an array of words, joined by spaces, one for each position; none with fewer words."""
    def cut(p: Column) -> Column:
        at = F.when(F.size(p) >= n, F.sequence(F.lit(1), F.size(p) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice(p, i, n), " "))

    return let(parts, cut)


def ngrams_sql(parts: str, n: int) -> str:
    return f"list_transform(range(1, len({parts}) - {n} + 2), lambda i: array_to_string({parts}[i:i+{n - 1}], ' '))"


def shingles(text: Column, n: int = 5) -> Column:
    """Distinct n-grams; the words as one with fewer than n, and none without words."""
    def cut(w: Column) -> Column:
        none = F.array().cast("array<string>")
        return F.when(F.size(w) == 0, none).when(F.size(w) < n, F.array(F.array_join(w, " "))).otherwise(F.array_distinct(ngrams(w, n)))

    return let(words(text), cut)


def symbol_count(text: Column) -> Column:
    """Characters that are no letter, number or white space."""
    return F.length(F.regexp_replace(text, r"[\p{L}\p{N}" + WS[1:], ""))


def word_id(word: Column, vocab: int = 131_072, reserved: int = 4) -> Column:
    """A token id that any engine can compute: by the first 8 hexadecimal digits of the md5."""
    return (F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("long") % (vocab - reserved) + reserved).cast("int")


def word_id_sql(word: str, vocab: int = 131_072, reserved: int = 4) -> str:
    return f"(cast('0x' || substr(md5({word}), 1, 8) AS BIGINT) % {vocab - reserved} + {reserved})"


def _unshift(x: int, k: int) -> int:
    out = x
    for _ in range(64 // k + 1):
        out = x ^ (out >> k)
    return out & _M


def _rotate_right(x: int, k: int) -> int:
    return ((x >> k) | (x << (64 - k))) & _M


def seed_literal(seed: int) -> int:
    """The long whose ``xxhash64`` is ``seed``, so that hashing a column after it is XXH64 with that seed."""
    inv = lambda p: pow(p, -1, 1 << 64)
    h = _unshift(seed & _M, 32)
    h = _unshift(h * inv(_P3) & _M, 29)
    h = _unshift(h * inv(_P2) & _M, 33)
    h = _rotate_right((h - _P4) * inv(_P1) & _M, 27)
    k = h ^ ((42 + _P5 + 8) & _M)
    out = _rotate_right(k * inv(_P1) & _M, 31) * inv(_P2) & _M
    return out - (1 << 64) if out >> 63 else out


def xxh64(text: Column, seed: int = 0) -> Column:
    """XXH64 of the UTF-8 bytes with any seed; null counts as empty."""
    return F.xxhash64(F.lit(seed_literal(seed)), F.coalesce(text, F.lit("")))


def text_hash(text: Column) -> Column:
    """XXH64 with seed 0, without its top bit."""
    return xxh64(text).bitwiseAND((1 << 63) - 1)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x
