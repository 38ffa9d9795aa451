"""A quality classifier from compressed sizes.

Two zstandard dictionaries are built, one from good and one from bad text. A
text is compressed with either, block by block; the difference of the two
sizes over their sum is large when the good dictionary explains the text
better, and a logistic curve turns it into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.batches import pieces
from corpusloom.sources.scratch import Scratch


@dataclass(frozen=True)
class QualityConfig:
    """Bounds of the fitted sample, and the compressor.

    At most ``sample_docs`` labelled documents of each class, chosen by a hash
    of their id, are read, whole. The driver holds ``sample_bytes`` of a class
    at most: where its rows have more, as many of their blocks, taken from all
    over the texts by a hash. Calibration returns a number a row.
    """

    sample_docs: int = 6000
    sample_bytes: int = 64 << 20
    block: int = 4096
    dictionary: int = 112_640
    level: int = 3
    seed: int = 11


@dataclass(frozen=True)
class QualityModel:
    """Two dictionaries, as raw content if ``raw``, and the curve; without dictionaries the score is the offset's alone."""

    good: bytes
    bad: bytes
    slope: float
    offset: float
    block: int
    level: int
    raw: bool = False


class _Sizer:
    def __init__(self, model: QualityModel):
        self.block = model.block
        self.by = []
        for d in (model.good, model.bad):
            data = zstandard.ZstdCompressionDict(d, zstandard.DICT_TYPE_RAWCONTENT if model.raw else zstandard.DICT_TYPE_FULLDICT)
            data.precompute_compress(level=model.level)
            self.by.append(
                zstandard.ZstdCompressor(
                    dict_data=data, level=model.level, write_content_size=False, write_checksum=False, write_dict_id=False
                )
            )

    def difference(self, text: bytes) -> float:
        """(bad size - good size) / (bad size + good size); 0 for an empty text."""
        if not text:
            return 0.0
        good, bad = (
            sum(len(c.compress(text[i : i + self.block])) for i in range(0, len(text), self.block)) for c in self.by
        )
        return (bad - good) / (bad + good)


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a weighted one-variable logistic regression, by Newton steps."""
    scale = float(x.std()) or 1.0
    z = np.stack([x / scale, np.ones_like(x)], 1)
    beta = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        g = z.T @ (w * (y - p)) - 1e-3 * beta
        h = (z * (w * p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def _sample(docs: DataFrame, labels: DataFrame, cfg: QualityConfig, scratch: Scratch) -> tuple[DataFrame, dict[int, int]]:
    """(quality, part, doc_id, text) of the sampled rows, dealt to the parts 0 and 1 in turn, and the labels of each class."""
    texts = docs.where("doc_id IS NOT NULL AND text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    rows = scratch.save(rows.distinct().join(texts.select("doc_id"), "doc_id", "left_semi"))
    count = {int(r[0]): int(r[1]) for r in rows.groupBy("quality").count().collect()}
    h = F.xxhash64("doc_id", F.lit(cfg.seed)).alias("h")
    picks = [rows.where(F.col("quality") == q).select(h, "doc_id", "quality").orderBy("h", "doc_id").limit(cfg.sample_docs) for q in (0, 1)]
    turn = F.row_number().over(Window.partitionBy("quality").orderBy("h", "doc_id"))  # over sample_docs rows a class at most
    named = picks[0].unionByName(picks[1]).select("doc_id", "quality", ((turn - 1) % 2).alias("part"))
    out = texts.join(F.broadcast(named), "doc_id").groupBy("quality", "part", "doc_id").agg(F.min("text").alias("text"))
    return scratch.save(out), count


def _blocks(sample: DataFrame, cfg: QualityConfig) -> dict[tuple[int, int], list[tuple[int, bytes]]]:
    """The blocks (key, bytes) of each class and part, by a hash: all of a class, or a share of ``sample_bytes``."""
    bars = {}
    for q, n in sample.groupBy("quality").agg(F.sum(F.octet_length("text"))).collect():
        bars[q] = int(min(1.0, cfg.sample_bytes / max(1, n)) * (1 << 64))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 3):
            out = []
            q, part, ids = (batch.column(i).to_pylist() for i in range(3))
            for row, text in enumerate(batch.column(3).cast(pa.binary()).to_pylist()):
                for at in range(0, len(text), cfg.block):
                    key = xxhash.xxh3_64_intdigest(f"{ids[row]}:{at}", cfg.seed)
                    if key < bars[q[row]]:
                        out.append((q[row], part[row], key >> 1, text[at : at + cfg.block]))
            columns = zip(*out, strict=True) if out else [[]] * 4
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["quality", "part", "key", "block"])

    got = sample.select("quality", "part", "doc_id", "text").mapInArrow(cut, "quality int, part int, key long, block binary").toArrow()
    out: dict[tuple[int, int], list[tuple[int, bytes]]] = {(q, part): [] for q in (0, 1) for part in (0, 1)}
    for q, part, key, block in zip(*(got[c].to_pylist() for c in got.column_names), strict=True):
        out[q, part].append((key, block))
    return out


def _raw(blocks: list[bytes], size: int) -> bytes:
    """At most ``size`` bytes of the blocks, an equal share of each; repeated up to 64 bytes, as less counts as none."""
    share = max(1, size // len(blocks))
    out = b"".join(b[:share] for b in blocks)[:size]
    return out * -(-64 // len(out)) if len(out) < 64 else out


def _model(good: list[tuple[int, bytes]], bad: list[tuple[int, bytes]], cfg: QualityConfig) -> QualityModel:
    """Dictionaries of the blocks of each class, raw content where either is too little to train on; no curve yet."""
    blocks = [[b for _, b in sorted(part)] for part in (good, bad)]
    try:
        fit = [[b for b in part if len(b) >= 8] for part in blocks]
        got = [zstandard.train_dictionary(min(cfg.dictionary, sum(map(len, p)) // 8), p, level=cfg.level).as_bytes() for p in fit]
        return QualityModel(got[0], got[1], 1.0, 0.0, cfg.block, cfg.level)
    except (zstandard.ZstdError, ValueError, MemoryError):
        got = [_raw(part, cfg.dictionary) for part in blocks]
        return QualityModel(got[0], got[1], 1.0, 0.0, cfg.block, cfg.level, True)


def _differences(rows: DataFrame, model: QualityModel, key: str) -> DataFrame:
    """(key, x): the difference of each row's whole ``text``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # two dictionaries of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizer = _Sizer(shared.value)
        for batch in pieces(batches, 1):
            x = [sizer.difference(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.float64())], [key, "x"])

    return rows.select(key, "text").mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, x double")


def fit(docs: DataFrame, labels: DataFrame, cfg: QualityConfig = QualityConfig()) -> QualityModel:
    """Fit on the texts of ``docs`` (doc_id, text) that ``labels`` (doc_id, quality 0/1) names.

    Labels of documents that ``docs`` lacks, or has without text, are left out
    before any is counted, and repeated labels count once; a document labelled
    both ways counts in both classes. Of rows that repeat an id the least text
    is read. The sample of each class is the ``sample_docs`` labels with the
    smallest hash of their id, in two parts. The dictionaries are built from
    both parts; the curve is fitted on what dictionaries of either part say of
    the other, weighted to the classes' counts. Where a class is too small to
    train a dictionary on, both are raw text of their class; where it has one
    row, that row is in both parts. Only if a class has no labelled text at
    all does the model score every text alike, by the share of good labels.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    sample, count = _sample(docs, labels, cfg, scratch)
    prior = (count.get(1, 0) + 1) / (sum(count.values()) + 2)
    if len(count) < 2:
        return QualityModel(b"", b"", 0.0, float(np.log(prior / (1 - prior))), cfg.block, cfg.level)
    blocks = _blocks(sample, cfg)
    alone = [q for q in (0, 1) if not blocks[q, 1]]
    halves = [_model(blocks[1, 0 if 1 in alone else part], blocks[0, 0 if 0 in alone else part], cfg) for part in (0, 1)]
    x, y, w = [], [], []
    for part in (0, 1):
        rows = sample.where((F.col("part") == part) | F.col("quality").isin(alone)).select("quality", "text")
        got = _differences(rows, halves[1 - part], "quality").toArrow()  # 2 * sample_docs rows at most
        x.append(got["x"].to_numpy())
        y.append(got["quality"].to_numpy())
    x, y = np.concatenate(x), np.concatenate(y)
    w = np.array([count[q] / max(1, (y == q).sum()) for q in (0, 1)])[y]
    order = np.lexsort((x, y))  # rows come in any order
    slope, offset = _logistic(x[order], y[order].astype(float), (w * len(w) / w.sum())[order])
    whole = _model(*(blocks[q, 0] + (blocks[q, 1] if q not in alone else []) for q in (1, 0)), cfg)
    scratch.drop(sample)
    return QualityModel(whole.good, whole.bad, slope, offset, cfg.block, cfg.level, whole.raw)


def _probabilities(model: QualityModel, sizer: _Sizer | None, texts: list[bytes | None]) -> np.ndarray:
    d = np.array([sizer.difference(t or b"") if sizer else 0.0 for t in texts], float)
    return 1 / (1 + np.exp(-np.clip(model.slope * d + model.offset, -30, 30)))


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row: the probability that its whole text is good.

    Null counts as empty, an empty text gets the score of a difference of 0,
    and repeated rows score alike. Other columns are not read. An empty table
    gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: QualityModel = shared.value
        sizer = _Sizer(m) if m.good else None
        for batch in pieces(batches, 1):
            p = _probabilities(m, sizer, batch.column(1).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns; repeated rows stay or go together."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: QualityModel = shared.value
        sizer = _Sizer(m) if m.good else None
        for batch in pieces(batches, text_col):
            texts = batch.column(batch.schema.names.index(text_col)).cast(pa.binary()).to_pylist()
            yield batch.filter(pa.array(_probabilities(m, sizer, texts) >= threshold))

    return docs.mapInArrow(run, docs.schema)
