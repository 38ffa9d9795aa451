"""Byte-level BPE in two tiers.

A minimal perfect hash over the vocabulary resolves a whole pre-token with
one probe and one comparison; a pre-token outside the vocabulary is merged by
a heap of ranked neighbour pairs over a doubly linked list of its bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.batches import pieces

_U = np.uint64


def load_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file (base64 token, rank), by rank; ranks must run from 0 without a gap."""
    with open(path, "rb") as f:
        rows = [line.split() for line in f if line.strip()]
    tokens: list[bytes | None] = [None] * len(rows)
    for token, rank in rows:
        tokens[int(rank)] = base64.b64decode(token)
    if None in tokens:
        raise ValueError("ranks are not 0 to n - 1")
    return tokens


def _spread(h: np.ndarray) -> np.ndarray:
    """Further 64-bit hashes from ``h``."""
    h = h * _U(0x9E3779B97F4A7C15)
    return (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class PerfectHash:
    """Hash and displace: slot = (start + d * step + d // n) mod n, where each bucket's d lets all its keys go to free slots."""

    displacement: np.ndarray
    value: np.ndarray  # slot -> number of the key there
    size: int

    @staticmethod
    def _parts(keys: list[bytes], n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bucket, start and step of each key."""
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), _U, len(keys))
        more = _spread(h)
        step = more % _U(max(1, n - 1)) + _U(1)
        return (_spread(more) % _U(buckets)).astype(np.int64), (h % _U(n)).astype(np.int64), step.astype(np.int64)

    @classmethod
    def build(cls, keys: list[bytes]) -> PerfectHash:
        n = len(keys)
        buckets = max(1, n // 3)
        by: list[list[tuple[int, int, int]]] = [[] for _ in range(buckets)]
        for i, (b, start, step) in enumerate(zip(*(x.tolist() for x in cls._parts(keys, n, buckets)), strict=True)):
            by[b].append((start, step, i))
        displacement, value = np.zeros(buckets, np.int64), np.full(n, -1, np.int64)
        taken, free = bytearray(n), 0
        for b in sorted(range(buckets), key=lambda b: -len(by[b])):
            if len(by[b]) == 1:  # a lone key goes straight to a free place: d // n moves the start
                free = taken.index(0, free)
                d = (free - by[b][0][0]) % n * n
                slots = [free]
            else:
                for d in range(64 * n):
                    slots = [(s + d * t + d // n) % n for s, t, _ in by[b]]
                    if len(set(slots)) == len(slots) and not any(taken[s] for s in slots):
                        break
                else:
                    raise ValueError("no displacement found")
            displacement[b] = d
            for s, (_, _, i) in zip(slots, by[b], strict=True):
                taken[s], value[s] = 1, i
        return cls(displacement, value, n)

    def find(self, keys: list[bytes]) -> np.ndarray:
        """For each key the number of the only vocabulary key that it can be."""
        n = self.size
        bucket, start, step = self._parts(keys, n, len(self.displacement))
        d = self.displacement[bucket]
        return self.value[(start + d % n * step + d // n) % n]


def pair_ranks(tokens: list[bytes]) -> dict[int, int]:
    """(left id << 32 | right id) -> id, for each way to cut a token into two tokens."""
    ids = {t: i for i, t in enumerate(tokens)}
    out = {}
    for t, i in ids.items():
        for cut in range(1, len(t)):
            left = ids.get(t[:cut])
            if left is not None and (right := ids.get(t[cut:])) is not None:
                out[left << 32 | right] = i
    return out


def merge_bytes(piece: bytes, bytes_ids: list[int], pairs: dict[int, int]) -> list[int]:
    """The ids of ``piece``: the neighbours whose joint token ranks lowest merge first, the leftmost among equals.

    The parts are a doubly linked list, the possible merges a heap of
    (rank, place). An entry is stale when its place no longer starts that pair.
    """
    n = len(piece)
    part = [bytes_ids[b] for b in piece]
    get = pairs.get
    heap = [r << 32 | i for i in range(n - 1) if (r := get(part[i] << 32 | part[i + 1])) is not None]
    if not heap:
        return part
    heapify(heap)
    nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
    while heap:
        entry = heappop(heap)
        i = entry & 0xFFFFFFFF
        j = nxt[i]
        if part[i] < 0 or j >= n or get(part[i] << 32 | part[j]) != entry >> 32:
            continue
        joint = part[i] = entry >> 32
        part[j] = -1
        k = nxt[i] = nxt[j]
        if k < n:
            prev[k] = i
            if (r := get(joint << 32 | part[k])) is not None:
                heappush(heap, r << 32 | i)
        p = prev[i]
        if p >= 0 and (r := get(part[p] << 32 | joint)) is not None:
            heappush(heap, r << 32 | p)
    return [x for x in part if x >= 0]


def _latin_split(pattern: str):
    """``pattern`` for texts below U+0250 as a pattern of the quicker standard library, or None if it says more."""
    kinds = {k: "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
    space = r"\t-\r \x85\xa0"
    out = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{kinds['L']}{kinds['N']}]")
    for name, chars in ((r"\p{L}", f"[{kinds['L']}]"), (r"\p{N}", f"[{kinds['N']}]"), (r"\S", f"[^{space}]"), (r"\s", f"[{space}]")):
        out = out.replace(name, chars)
    return None if r"\p" in out else re.compile(out)


class Encoder:
    """Ids of texts, and texts of ids.

    ``memory`` bounds the pre-tokens whose ids are kept, the first that come;
    others are worked out anew in each text.
    """

    def __init__(self, tokens: list[bytes], pattern: str, hashed: PerfectHash | None = None, memory: int = 600_000):
        self.tokens = tokens
        self.hashed = hashed or PerfectHash.build(tokens)
        self.pairs = pair_ranks(tokens)
        ids = {t: i for i, t in enumerate(tokens) if len(t) == 1}
        self.bytes_ids = [ids[bytes([b])] for b in range(256)]
        # \s means White_Space; in this library it would also take the separators 0x1C to 0x1F.
        self.split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.latin, self.beyond = _latin_split(pattern), re.compile("[^\x00-\u024f]")
        self.memory = memory
        self.known: dict[str, bytes] = {}

    def _resolve(self, new: list[str]) -> dict[str, bytes]:
        keys = [p.encode() for p in new]
        out = {}
        for p, k, i in zip(new, keys, self.hashed.find(keys).tolist(), strict=True):
            out[p] = pack("<I", i) if self.tokens[i] == k else np.array(merge_bytes(k, self.bytes_ids, self.pairs), "<u4").tobytes()
        return out

    def encode(self, text: str) -> np.ndarray:
        """The ids, as little-endian unsigned 32-bit integers."""
        split = self.split if self.latin is None or self.beyond.search(text) else self.latin
        pieces = split.findall(text)
        known = self.known
        parts = list(map(known.get, pieces))
        if None in parts:
            got = self._resolve(list({p for p, x in zip(pieces, parts, strict=True) if x is None}))
            if len(known) + len(got) <= self.memory:
                known.update(got)
            parts = [got[p] if x is None else x for p, x in zip(pieces, parts, strict=True)]
        return np.frombuffer(b"".join(parts), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def encode_texts(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, digests: bool = False
) -> DataFrame:
    """(doc_id, ids) of each row, with ``digests`` (…, n_tokens, ids_sha256, decoded_sha256); without ``ids`` those alone.

    The digests are of the ids as little-endian unsigned 32-bit integers and
    of the bytes that decoding those ids gives. ``path`` names a rank file
    that the driver reads. A null or empty text has no ids; repeated rows are
    encoded alike; whole texts are encoded, however long; other columns are
    not read; an empty table gives no rows. No special tokens.
    """
    tokens = load_ranks(path)
    shared = docs.sparkSession.sparkContext.broadcast((tokens, PerfectHash.build(tokens)))  # the vocabulary: fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared, pattern)
        for batch in pieces(batches, 1):
            lists, n, ids_sha, text_sha = [], [], [], []
            for t in batch.column(1).to_pylist():
                got = encoder.encode(t or "")
                if ids:
                    lists.append(got.astype(np.int32))
                if digests:
                    n.append(len(got))
                    ids_sha.append(hashlib.sha256(got.tobytes()).hexdigest())
                    text_sha.append(hashlib.sha256(encoder.decode(got)).hexdigest())
            out = {"ids": pa.array(lists, pa.list_(pa.int32()))} if ids else {}
            if digests:
                out |= {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}
            yield pa.RecordBatch.from_arrays([batch.column(0), *out.values()], ["doc_id", *out])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kinds = ["ids array<int>"] * ids + ["n_tokens long", "ids_sha256 string", "decoded_sha256 string"] * digests
    return rows.mapInArrow(run, ", ".join(["doc_id long", *kinds]))


def decode_ids(tokens_df: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids count as none."""
    shared = tokens_df.sparkSession.sparkContext.broadcast(load_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value.__getitem__
        for batch in batches:
            texts = [b"".join(map(at, ids or ())).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens_df.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def _encoder(shared, pattern: str) -> Encoder:
    """One encoder for each vocabulary and worker process, so its memory lasts over tasks."""
    key = (shared.id if hasattr(shared, "id") else id(shared), pattern)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        tokens, hashed = shared.value
        _ENCODERS[key] = Encoder(tokens, pattern, hashed)
    return _ENCODERS[key]


_ENCODERS: dict = {}
