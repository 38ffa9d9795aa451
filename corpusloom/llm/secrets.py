"""Secret scanning through a trigram index.

Each rule's pattern is parsed and turned into a Boolean query over trigrams
that every match must contain. For each block of documents an inverted index
holds, for each trigram that some query names, the documents that have it;
the queries intersect and unite these postings, and only the candidates are
run through the pattern. A rule without mandatory trigrams scans every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as sre
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.batches import pieces


@dataclass(frozen=True)
class SecretRule:
    """``pattern`` is matched left to right without overlaps; matches with a ``group`` of under ``least`` characters are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The three base kinds, in their order. A run of 24 or more is what is left of all runs once shorter ones are dropped,
#: and so with AKIA keys, whose run holds any later key; an assignment that fails uses up its text, so its length is
#: asked for afterwards.
BASE_RULES = (
    SecretRule(
        "assign",
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    SecretRule("access", r"AKIA[A-Z0-9]{16,}"),
    SecretRule("hex", r"[0-9a-f]{24,}"),
)

#: Further kinds whose spans the scan adds.
MORE_RULES = (
    SecretRule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    # It starts a run of its characters, so that no run is read twice.
    SecretRule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
)

_MOST = 64  # strings that a part's exact set may hold before it is turned into trigrams

# A query is True (any text), a trigram, ("and", parts) or ("or", parts). Text is folded to lower case for it.


def _and(*parts):
    flat = [p for p in dict.fromkeys(parts) if p is not True]
    return True if not flat else flat[0] if len(flat) == 1 else ("and", tuple(flat))


def _or(*parts):
    flat = list(dict.fromkeys(parts))
    return True if True in flat or not flat else flat[0] if len(flat) == 1 else ("or", tuple(flat))


def _grams(words: set[str]):
    """The query that some word of ``words`` occurs."""
    return _or(*(_and(*(w[i : i + 3] for i in range(len(w) - 2))) for w in sorted(words)))


#: With IGNORECASE and without ASCII, these letters also match some beyond ASCII, which the folded text keeps.
_LOOSE = frozenset("iks")


def _is_loose(flags: int) -> bool:
    return bool(flags & re.IGNORECASE and not flags & re.ASCII)


def _set_of(items, loose: bool) -> set[str] | None:
    """The folded characters of a class, or None when it is negated or has many."""
    out: set[str] = set()
    for op, arg in items:
        if op is sre.LITERAL and arg < 128:
            out.add(chr(arg).lower())
        elif op is sre.RANGE and arg[1] < 128 and arg[1] - arg[0] < 8:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 and not (loose and out & _LOOSE) else None


def _walk(seq, flags: int) -> tuple[set[str] | None, object]:
    """(the exact strings that ``seq`` matches, or None; the query of what it must contain)."""
    loose = _is_loose(flags)
    done, run = [], {""}  # run: exact strings of the part read since the last gap

    def gap():
        nonlocal run
        done.append(_grams(run) if run != {""} else True)
        run = {""}

    whole = True
    for op, arg in seq:
        exact, query = None, True
        if op is sre.LITERAL and arg < 128:  # only A-Z fold alike in patterns and texts
            exact = None if loose and chr(arg).lower() in _LOOSE else {chr(arg).lower()}
        elif op is sre.IN:
            exact = _set_of(arg, loose)
        elif op is sre.SUBPATTERN:
            exact, query = _walk(arg[3], (flags | arg[1]) & ~arg[2])
        elif op is sre.BRANCH:
            parts = [_walk(p, flags) for p in arg[1]]
            query = _or(*(q for _, q in parts))
            exact = set().union(*(e for e, _ in parts)) if all(e is not None for e, _ in parts) else None
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            low, high, body = arg
            e, q = _walk(body, flags)
            if (low, high) == (0, 1) and e is not None:
                exact = e | {""}
            elif low == high and e is not None and len(e) ** low <= _MOST:
                exact = {""}
                for _ in range(low):
                    exact = {a + b for a in exact for b in e}
            query = q if low else True
        elif op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):  # they take no characters
            exact = {""}
        joined = {a + b for a in run for b in exact} if exact is not None and len(run) * len(exact) <= _MOST else None
        if joined is not None:
            run = joined
        else:
            whole = False
            gap()
            if exact is not None and len(exact) <= _MOST:
                run = set(exact)
            else:
                done.append(query)
    if whole:
        return run, _grams(run)
    gap()
    return None, _and(*done)


def trigram_query(pattern: str):
    """What every match of ``pattern`` contains, folded to lower case, as a Boolean query; True for nothing.

    Flags in the pattern count: a letter that ``(?i)`` lets match beyond ASCII
    is no part of a trigram.
    """
    parsed = _parser.parse(pattern)
    return _walk(parsed, parsed.state.flags)[1]


def query_grams(query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(query_grams, query[1]))


def _lookup(query, postings: dict[str, np.ndarray], n: int) -> np.ndarray:
    """The documents (sorted numbers) of a block of ``n`` that satisfy ``query``."""
    if query is True:
        return np.arange(n)
    if isinstance(query, str):
        return postings.get(query, np.empty(0, np.int64))
    parts = [_lookup(q, postings, n) for q in query[1]]
    out = parts[0]
    for p in parts[1:]:
        out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
    return out


class TrigramIndex:
    """The postings of the trigrams that some rule names, for one block of texts.

    Every trigram of the block is looked up in a table of all 2 ** 24, which
    gives the number of the named one that it is.
    """

    SLICE = 1 << 21

    def __init__(self, grams: set[str]):
        self.grams = sorted(grams)
        self.table = np.zeros(1 << 24, np.uint16)
        for i, g in enumerate(self.grams, 1):
            x, y, z = g.encode()
            self.table[x << 16 | y << 8 | z] = i

    def postings(self, folded: list[bytes]) -> dict[str, np.ndarray]:
        found: list[np.ndarray] = []
        first = size = 0
        for d, t in enumerate(folded):
            size += len(t) + 2
            if size >= self.SLICE or d == len(folded) - 1:
                found.append(self._hits(folded[first : d + 1]) + (first << 16))
                first, size = d + 1, 0
        hits = np.concatenate(found) if found else np.empty(0, np.int64)
        order = hits[np.argsort(hits & 0xFFFF, kind="stable")]
        cuts = np.searchsorted(order & 0xFFFF, np.arange(1, len(self.grams) + 2))
        return {g: order[cuts[i] : cuts[i + 1]] >> 16 for i, g in enumerate(self.grams) if cuts[i] < cuts[i + 1]}

    def _hits(self, folded: list[bytes]) -> np.ndarray:
        """Sorted distinct (document << 16 | number of a named trigram) of a few texts."""
        x = np.frombuffer(b"\0\0".join(folded) + b"\0\0", np.uint8).astype(np.int32)
        got = self.table[(x[:-2] << 16) | (x[1:-1] << 8) | x[2:]]
        at = np.flatnonzero(got)
        ends = np.cumsum([len(t) + 2 for t in folded])
        return np.unique(np.searchsorted(ends, at, "right") << 16 | got[at])


class SecretScanner:
    def __init__(self, rules: tuple[SecretRule, ...]):
        self.rules = [(r, re.compile(r.pattern), trigram_query(r.pattern)) for r in rules]
        self.index = TrigramIndex(set().union(*(query_grams(q) for _, _, q in self.rules)))

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """For each text the (start, rule number, end) of its secrets, sorted, in code points."""
        postings = self.index.postings([t.encode().lower() for t in texts])  # of bytes, only A-Z fold
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, (rule, pattern, query) in enumerate(self.rules):
            for d in _lookup(query, postings, len(texts)).tolist():
                for m in pattern.finditer(texts[d]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        found[d].append((m.start(), k, m.end()))
        return [sorted(f) for f in found]


def scan(docs: DataFrame, rules: tuple[SecretRule, ...] = BASE_RULES + MORE_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, secrets) of each row: an array of (kind, start, end), by start and then the rules' order.

    Positions are code points, the end exclusive. A null or empty text has no
    secrets; repeated rows are scanned alike; other columns are not read.
    Blocks are pieces of Arrow batches of bounded size, and so is the index;
    a longer text is a block of its own. An empty table gives no rows.
    """
    schema = "doc_id long, secrets array<struct<kind:string,start:int,end:int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = SecretScanner(rules)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in pieces(batches, 1):
            found = scanner.spans([t or "" for t in batch.column(1).to_pylist()])
            values = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in f] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, kind)], ["doc_id", "secrets"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


def redact_text(text: str, spans: list[tuple[int, int, int]], mask: str) -> str:
    """``text`` with each run of overlapping spans replaced by ``mask``."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, rules: tuple[SecretRule, ...] = BASE_RULES + MORE_RULES, mask: str = "<SECRET>", text_col: str = "text") -> DataFrame:
    """``docs`` with every secret in ``text_col`` replaced; all rows, columns and null texts stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = SecretScanner(rules)
        for batch in pieces(batches, text_col):
            at = batch.schema.names.index(text_col)
            texts = batch.column(at).to_pylist()
            found = scanner.spans([t or "" for t in texts])
            clean = pa.array([redact_text(t, f, mask) if f else t for t, f in zip(texts, found, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([clean if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
