"""Near-duplicate detection with min-max hashing.

Each of ``permutations`` hash evaluations of a document's shingle set gives
two signature values, its minimum and its maximum, so a signature of
``2 * permutations`` values costs half the evaluations of plain MinHash and
its agreement rate has a lower variance. Bands of that signature propose
candidates; a candidate is a link only after the full sets confirm it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.batches import pieces
from corpusloom.llm.graph import connected_components
from corpusloom.sources.scratch import Scratch

_U = np.uint64


@dataclass(frozen=True)
class NearDupConfig:
    """Words in a shingle, linking similarity in percent, and the banding.

    A pair at exactly 80 % is missed by all bands with probability
    (1 - 0.8 ** rows) ** bands, 3e-6 here; a closer pair far less often.
    """

    shingle_words: int = 5
    percent: int = 80
    permutations: int = 80
    rows: int = 5
    seed: int = 7
    #: Cells of the hashed document-frequency table of the completing join: its fixed size, 1 MB.
    frequency_cells: int = 1 << 18
    #: Counted ids up to which a list of them is broadcast (some 100 MB in memory); a longer one is joined by a shuffle.
    broadcast_ids: int = 2_000_000

    @property
    def bands(self) -> int:
        return 2 * self.permutations // self.rows


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    return x ^ (x >> _U(33))


def shingle_hashes(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``k``-word shingles of a UTF-8 text.

    Words are runs of bytes other than space and 0x09 to 0x0D, with A-Z
    lower-cased. A text of fewer words than ``k`` has its whole sequence as
    its one shingle; without words the set is empty.
    """
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, _U)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, len(words))
    k = min(k, len(words))
    n = len(words) - k + 1
    acc = np.full(n, k, _U)
    for i in range(k):
        acc = _mix((acc + h[i : i + n]) * _U(0x9E3779B185EBCA87))
    return np.unique(acc)


class MinMaxHasher:
    """Signatures of 2 * permutations values: all minima, then all maxima."""

    BLOCK = 2048

    def __init__(self, permutations: int, seed: int):
        rng = np.random.default_rng(seed)
        self.a = (rng.integers(0, 2**63, (permutations, 1), dtype=_U) << _U(1)) | _U(1)
        self.b = rng.integers(0, 2**63, (permutations, 1), dtype=_U)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        low = high = None
        for at in range(0, len(shingles), self.BLOCK):  # bounds the work space of very long texts
            x = shingles[None, at : at + self.BLOCK] * self.a + self.b
            lo, hi = x.min(1), x.max(1)
            low, high = (lo, hi) if low is None else (np.minimum(low, lo), np.maximum(high, hi))
        return np.concatenate([low, high])


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` values; the band's number is part of it."""
    bands = signatures.shape[1] // rows
    x = signatures[:, : bands * rows].reshape(len(signatures), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=_U), x.shape[:2])
    for e in range(rows):
        key = _mix(key * _U(0x9E3779B185EBCA87) + x[:, :, e])
    return key


def _binary(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary() if not pa.types.is_large_string(column.type) else pa.large_binary()).to_pylist()


def _signer(cfg: NearDupConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinMaxHasher(cfg.permutations, cfg.seed)
        for batch in pieces(batches, 1):
            sets = [shingle_hashes(t, cfg.shingle_words) for t in _binary(batch.column(1))]
            full = [i for i, s in enumerate(sets) if len(s)]
            keys = np.empty((0, cfg.bands), _U)
            if full:
                keys = band_keys(np.stack([hasher.signature(sets[i]) for i in full]), cfg.rows)
            of = dict(zip(full, keys.view(np.int64), strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([of.get(i) for i in range(len(sets))], pa.list_(pa.int64())),
                ],
                ["doc_id", "text_hash", "n_shingles", "set_key", "bands"],
            )

    return run


def signatures(docs: DataFrame, cfg: NearDupConfig, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_shingles, set_key, bands) of each document; the last two null without words."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash")).mapInArrow(
        _signer(cfg), "doc_id long, text_hash long, n_shingles long, set_key binary, bands array<long>"
    )


def _verifier(cfg: NearDupConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes | None, np.ndarray] = (None, np.empty(0, _U))
        for batch in pieces(batches, 2, 3):
            keep = []
            for i, (x, y) in enumerate(zip(_binary(batch.column(2)), _binary(batch.column(3)), strict=True)):
                if x != last[0]:  # rows come sorted by the first document
                    last = (x, shingle_hashes(x, cfg.shingle_words))
                s, t = last[1], shingle_hashes(y, cfg.shingle_words)
                short, long = (s, t) if len(s) < len(t) else (t, s)
                if 100 * len(short) < cfg.percent * len(long):
                    continue
                at = np.searchsorted(long, short)
                both = int((long[np.minimum(at, len(long) - 1)] == short).sum()) if len(long) else 0
                if both and 100 * both >= cfg.percent * (len(s) + len(t) - both):
                    keep.append(i)
            rows = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows)], ["a", "b"])

    return run


def _listed(ids: DataFrame, cfg: NearDupConfig) -> DataFrame:
    """A written list of ids, marked for broadcast if it is counted to be short enough."""
    return F.broadcast(ids) if ids.count() <= cfg.broadcast_ids else ids


def verified(pairs: DataFrame, texts: DataFrame, cfg: NearDupConfig, scratch: Scratch) -> DataFrame:
    """The ``pairs`` (a, b), a written table, whose full shingle sets are similar enough, as a written table.

    Only the texts that some pair names move: they are picked out by a list of
    their ids, written once, and joined with the pairs' either side.
    """
    names = scratch.save(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    named = scratch.save(texts.join(_listed(names, cfg), "doc_id").select("doc_id", "text"))
    both = pairs.join(named.select(F.col("doc_id").alias("a"), F.col("text").alias("x")), "a").join(
        named.select(F.col("doc_id").alias("b"), F.col("text").alias("y")), "b"
    )
    out = scratch.save(both.select("a", "b", "x", "y").mapInArrow(_verifier(cfg), "a long, b long"))
    scratch.drop(names, named)
    return out


def _frequencies(cfg: NearDupConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(cfg.frequency_cells, np.int64)
        for batch in pieces(batches, 1):
            for t in _binary(batch.column(1)):
                np.add.at(counts, shingle_hashes(t, cfg.shingle_words) % _U(cfg.frequency_cells), 1)
        cells = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(counts[cells])], ["cell", "n"])

    return run


def _prefixes(cfg: NearDupConfig, counts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value
        for batch in pieces(batches, 2):
            parts = []
            for i, t in enumerate(_binary(batch.column(2))):
                s = shingle_hashes(t, cfg.shingle_words)
                n = len(s)
                first = s[np.lexsort((s, table[s % _U(cfg.frequency_cells)]))][: n + 1 + (-cfg.percent * n // 100)]
                pos = np.arange(len(first))
                short = pos < n + 1 + (-2 * cfg.percent * n // (100 + cfg.percent))
                parts.append((first.view(np.int64), np.full(len(first), i), pos, np.full(len(first), n), short))
            if parts:
                h, i, pos, n, short = (np.concatenate(x) for x in zip(*parts, strict=True))
                rows = pa.array(i)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(pos), pa.array(n), pa.array(short)],
                    ["h", "id", "label", "pos", "n", "short"],
                )

    return run


def _completing_pairs(open_docs: DataFrame, texts: DataFrame, cfg: NearDupConfig, scratch: Scratch) -> DataFrame:
    """Every pair of different labels in ``open_docs`` (id, label), a written table, that can reach the similarity.

    In any common order of elements, two sets x and y, x not the larger, of
    Jaccard t share an element among the first n - ceil(2 t / (1 + t) n) + 1
    of x and the first n - ceil(t n) + 1 of y, so joining x's shorter prefix
    with y's loses no pair. The order is rarest first, by a hashed count of
    fixed size. A passage that many documents share is then in the shorter
    prefix of those only that are so like one another that they are linked
    already; an element that is in no shorter prefix, or in one label's
    documents alone, is dropped before the join.
    """
    spark, t, whole = texts.sparkSession, cfg.percent, 100 + cfg.percent
    mine = scratch.save(texts.join(_listed(open_docs, cfg).withColumnRenamed("id", "doc_id"), "doc_id").select("doc_id", "label", "text"))
    cells = np.zeros(cfg.frequency_cells, np.int64)
    got = (
        mine.select("doc_id", "text").mapInArrow(_frequencies(cfg), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    ).toArrow()  # at most frequency_cells rows
    cells[got["cell"].to_numpy()] = got["n"].to_numpy()
    rows = scratch.save(
        mine.mapInArrow(_prefixes(cfg, spark.sparkContext.broadcast(cells)), "h long, id long, label long, pos long, n long, short boolean")
    )
    scratch.drop(mine)
    mixed = rows.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max(F.col("short").cast("int")).alias("any"))
    mixed = scratch.save(mixed.where("lo <> hi AND any = 1").select("h"))
    kept = scratch.save(rows.join(mixed, "h", "left_semi"))
    scratch.drop(rows, mixed)
    side = lambda s: (F.col(c).alias(f"{c}_{s}") for c in ("id", "label", "pos", "n"))
    pairs = kept.where("short").select("h", *side("x")).join(kept.select("h", *side("y")), "h")
    need = F.ceil((F.col("n_x") + F.col("n_y")) * F.lit(t) / F.lit(whole))
    likely = (
        ((F.col("n_x") < F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("id_x") < F.col("id_y"))))
        & (F.col("label_x") != F.col("label_y"))
        & (F.col("n_x") * 100 >= F.col("n_y") * t)
        & (F.least(F.col("n_x") - F.col("pos_x"), F.col("n_y") - F.col("pos_y")) >= need)
    )
    return pairs.where(likely).select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct()


def _sets(texts: DataFrame, signed: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(set_key, node, rep, n_rows, n_shingles, bands) of each distinct set of ``signed``, and (doc_id, text) with each node as doc_id.

    rep is the smallest doc_id that has the set. It is the set's node too,
    unless ids repeat and another set has the same rep: then a hash of the set
    stands for all but one of them.
    """
    rows = signed.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    least = scratch.save(
        rows.groupBy("set_key").agg(
            F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_rows"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")
        )
    )
    if not rows.groupBy("doc_id").count().where("count > 1").head(1):
        return least.withColumn("node", F.col("rep")), texts
    key = F.xxhash64("set_key")
    shared = least.groupBy("rep").agg(F.min(key).alias("key"), F.count(F.lit(1)).alias("n")).where("n > 1").select("rep", "key")
    node = F.when(F.col("key") != key, key).otherwise(F.col("rep"))
    sets = scratch.save(least.join(shared, "rep", "left").withColumn("node", node).drop("key"))
    chosen = rows.join(sets.select("set_key", "node", "rep"), "set_key").where("doc_id = rep").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("r"))
    chosen = scratch.save(chosen.select("node", "r.doc_id", "r.text_hash"))
    mine = texts.withColumn("text_hash", F.xxhash64("text")).join(chosen, ["doc_id", "text_hash"])
    return sets, mine.select(F.col("node").alias("doc_id"), "text").dropDuplicates(["doc_id"])


def _components(docs: DataFrame, cfg: NearDupConfig, id_col: str, text_col: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(the signed rows, (set_key, label, component_id, n_rows, linked) of each distinct shingle set)."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id IS NOT NULL")
    signed = scratch.save(signatures(docs, cfg, id_col, text_col))
    sets, texts = _sets(texts, signed, scratch)
    in_bands = sets.select(F.explode("bands").alias("key"), F.col("node").alias("id"))
    heads = scratch.save(in_bands.groupBy("key").agg(F.min("id").alias("head"), F.max("id").alias("tail")).where("head <> tail").select("key", "head"))
    buckets = scratch.save(in_bands.join(heads, "key"))
    scratch.drop(heads)
    sizes = sets.select("node", "n_shingles")
    stars = scratch.save(buckets.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct())
    near = scratch.save(
        stars.join(sizes.select(F.col("node").alias("a"), F.col("n_shingles").alias("m")), "a")
        .join(sizes.select(F.col("node").alias("b"), F.col("n_shingles").alias("n")), "b")
        .where(F.least("m", "n") * 100 >= F.greatest("m", "n") * cfg.percent)
        .select("a", "b")
    )
    links = verified(near, texts, cfg, scratch)
    labels = scratch.save(connected_components(links, scratch))

    members = scratch.save(buckets.join(labels, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label")))
    split = scratch.save(members.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key"))
    open_docs = scratch.save(members.join(split, "key", "left_semi").select("id", "label").distinct())
    scratch.drop(buckets, stars, members, split)
    pairs = scratch.save(_completing_pairs(open_docs, texts, cfg, scratch).join(near, ["a", "b"], "left_anti"))
    more = verified(pairs, texts, cfg, scratch)
    joined = scratch.save(
        connected_components(labels.select(F.col("id").alias("a"), F.col("label").alias("b")).unionByName(more), scratch)
    )
    scratch.drop(near, links, labels, open_docs, pairs, more)
    ends = joined.join(sets.select(F.col("node").alias("id"), "rep"), "id").groupBy("label").agg(F.min("rep").alias("least"))
    joined = scratch.save(joined.join(ends, "label").select(F.col("id").alias("node"), "label", "least"))
    linked = sets.select("set_key", "node", "rep", "n_rows").join(joined, "node", "left")
    return signed, linked.select(
        "set_key", F.coalesce("label", "node").alias("label"), F.coalesce("least", "rep").alias("component_id"), "n_rows", F.col("label").isNotNull().alias("linked")
    )


def near_duplicates(
    docs: DataFrame, cfg: NearDupConfig = NearDupConfig(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents are linked when ``100 * |A & B| >= percent * |A | B|`` for their
    shingle sets; component_id is the smallest doc_id that a document reaches
    over links. Equal sets collapse to their smallest doc_id before banding.
    In each band's bucket the members are compared with the smallest one; the
    buckets that then hold more than one component send their members to an
    exact prefix join, so no link between components of a bucket is lost and
    no bucket emits its pairs. A document without words (null or empty text)
    links with nothing. Rows with a null doc_id are returned with a null
    component and kept. Rows that repeat a doc_id each return the component of
    their own text; ``kept`` says no more than that the ids are equal, so of
    such rows several may be kept: :func:`survivors` picks one. Other columns
    of ``docs`` are not read; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "neardup")
    signed, sets = _components(docs, cfg, id_col, text_col, scratch)
    rows = signed.where("set_key IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "n_shingles", "set_key")
    linked = rows.join(sets.select("set_key", "component_id"), "set_key").select("doc_id", "n_shingles", "component_id")
    alone = signed.where("set_key IS NULL OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def survivors(docs: DataFrame, cfg: NearDupConfig = NearDupConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with exactly one row of each group of near-duplicates, with all its columns.

    It is the row with the smallest id, of those the one with the smallest
    hash of its text, and any one of rows equal in both. Rows without words or
    with a null id are in no group and stay. Unlike texts stay although they
    have the same id.
    """
    scratch = Scratch(docs.sparkSession, "survivors")
    signed, sets = _components(docs, cfg, id_col, text_col, scratch)
    grouped = sets.where("linked OR n_rows > 1").select("set_key", "label", "component_id")
    rows = signed.where("set_key IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "text_hash", "set_key")
    rows = scratch.save(rows.join(grouped, "set_key").drop("set_key"))
    first = rows.where("doc_id = component_id").groupBy("label").agg(F.min("text_hash").alias("first"))
    first = scratch.save(rows.select("label", "component_id").distinct().join(first, "label"))
    marked = rows.drop("component_id").join(first, "label").withColumn("stays", (F.col("doc_id") == F.col("component_id")) & (F.col("text_hash") == F.col("first")))
    counted = scratch.save(marked.groupBy("doc_id", "text_hash", "stays").agg(F.count(F.lit(1)).alias("n")).where("NOT stays OR n > 1"))
    key = [f"__{c}" for c in ("id", "hash")]
    while set(key) & {c.lower() for c in docs.columns}:
        key = [f"_{c}" for c in key]
    out = docs.withColumn(key[0], F.col(id_col).cast("long")).withColumn(key[1], F.xxhash64(F.col(text_col).cast("string")))
    renamed = counted.select(F.col("doc_id").alias(key[0]), F.col("text_hash").alias(key[1]), "stays")
    once = out.join(renamed.select(key), key, "left_anti")
    again = renamed.where("stays").select(key)
    if again.head(1):
        once = once.unionByName(out.join(again, key, "left_semi").dropDuplicates(key))
    return once.drop(*key)
