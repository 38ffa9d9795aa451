"""Losses over logits arrays, bf16 storage, synthetic batches and fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def log_sum_exp(logits: Column) -> Column:
    top = F.array_max(logits)
    return top + F.log(_sum(F.transform(logits, lambda z: F.exp((z - top).cast("double")))))


def cross_entropy(logits: Column, label: Column, z_weight: float = 0.0) -> Column:
    """-log softmax at ``label`` (from 0), plus ``z_weight`` times the squared log partition."""
    lse = log_sum_exp(logits)
    return lse - F.element_at(logits, label + 1) + z_weight * lse * lse


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.greatest(F.sum(weight), F.lit(1.0))


def top_k_divergence(student: Column, teacher_logits: Column, teacher_indices: Column) -> Column:
    """KL of the teacher's top-K distribution to the student's over the same K, both normalised there."""
    own = F.transform(teacher_indices, lambda i: F.element_at(student, i.cast("int") + 1))
    a, b = log_sum_exp(teacher_logits), log_sum_exp(own)
    return _sum(F.zip_with(teacher_logits, own, lambda t, s: F.exp(t - a) * ((t - a) - (s - b))))


def distilled(ce: Column, divergences: list[Column], weights: list[float], alpha: Column) -> Column:
    """alpha * ce + (1 - alpha) * the weighted mean divergence of several teachers."""
    mean = sum((d * (w / sum(weights)) for d, w in zip(divergences, weights, strict=True)), F.lit(0.0))
    return alpha * ce + (1 - alpha) * mean


def to_bf16(values: np.ndarray) -> np.ndarray:
    """The upper 16 bits of each float, cut off, not rounded."""
    return (np.ascontiguousarray(values, np.float32).view(np.uint32) >> 16).astype(np.uint16)


def from_bf16(bits: np.ndarray) -> np.ndarray:
    return (bits.astype(np.uint32) << 16).view(np.float32)


def with_bf16(df: DataFrame, column: str) -> DataFrame:
    """``df`` with array<float> ``column`` as bf16 stores it."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = [None if x is None else from_bf16(to_bf16(np.array(x, np.float32))) for x in batch.column(at).to_pylist()]
            new = pa.array(v, pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return df.mapInArrow(run, df.withColumn(column, F.col(column).cast("array<float>")).schema)


def synthetic_batches(spark, steps: int, micro_batch: int, length: int, vocab: int, seed: int = 0, start: int = 0) -> DataFrame:
    """(step, row, tokens): batch N depends on the seed and N alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in batch.column(0).to_pylist():
                rng = np.random.default_rng(np.random.SeedSequence([seed, step]))
                rows = rng.integers(0, vocab, (micro_batch, length), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([step] * micro_batch), pa.array(range(micro_batch), pa.int32()), pa.array(list(rows), pa.list_(pa.int64()))], ["step", "row", "tokens"])

    return spark.range(start, start + steps).mapInArrow(run, "step long, row int, tokens array<bigint>")


def synthetic_logits(df: DataFrame, name: str, vocab: int) -> DataFrame:
    """``df`` (…, tokens) with teacher logits: normal, seeded by the teacher's name and the sum of the tokens."""
    base = int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column(batch.schema.names.index("tokens")).to_pylist()
            z = [np.random.default_rng((base + sum(t or ())) % 2**64).standard_normal(vocab).astype(np.float32) for t in tokens]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(z, pa.list_(pa.float32()))], [*batch.schema.names, "logits"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{schema}, logits array<float>")


def table_hash(df: DataFrame) -> str:
    """SHA-256 of a table whatever its row order: over the sums of its rows' hashes."""
    h = F.xxhash64(*(F.to_json(F.struct(c)) for c in sorted(df.columns)))
    n, a, b = df.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)")), F.expr("bit_xor(xxhash64(1))") if not df.columns else F.bit_xor(h)).first()
    return hashlib.sha256(f"{sorted(df.columns)}:{n}:{a}:{b}".encode()).hexdigest()


def parameter_count(hidden: Column, layers: Column, ffn: Column, vocab: Column, kv_share: Column) -> Column:
    """Weights of a decoder with grouped keys and a gated feed-forward layer, embeddings tied."""
    attention = hidden * hidden * 2 + hidden * hidden * kv_share * 2
    return layers * (attention + 3 * hidden * ffn + 2 * hidden) + vocab * hidden + hidden


def utilisation(parameters: Column, tokens_per_s: Column, peak_flops: Column) -> Column:
    return 6 * parameters * tokens_per_s / peak_flops


def token_steps(tokens: Column, micro_batch: Column, length: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(tokens / (micro_batch * length)))
