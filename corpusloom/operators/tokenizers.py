"""Tokenizer files in workers, with checks of special tokens and round trips."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ids that packing relies on.
REQUIRED = {"<s>": 0, "</s>": 1, "<pad>": 2, "<unk>": 3}

#: Texts that a tokenizer must give back.
CANON = ("hello world", "  two  spaces", "नमस्ते दुनिया", "Straße", "def f(x):\n\treturn x", "1 234,50 €", "🙂🙂", "áé")


def special_tokens(reserved: int = 0) -> list[str]:
    return [*REQUIRED, *(f"<reserved_{i}>" for i in range(reserved))]


def check_special(ids: dict[str, int]) -> None:
    wrong = {t: ids.get(t) for t, i in REQUIRED.items() if ids.get(t) != i}
    if wrong:
        raise ValueError(f"special tokens with other ids: {wrong}")


def file_sha256(path: str) -> str:
    """Of the file a driver reads; it goes into every manifest."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


class Encoder(Protocol):
    """What a worker needs: ``encode`` gives the ids of a text; one with ``encode_batch`` is given many texts at a time."""

    def encode(self, text: str) -> list[int]: ...


class _FromJson:
    """An encoder of a tokenizer JSON, without special tokens."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.encode_special_tokens = True

    def encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]


def tokenize(
    docs: DataFrame, spec: str, batch: int = 1000, text_col: str = "text", chars: int = 8_000_000, make: Callable[[str], Encoder] = _FromJson
) -> DataFrame:
    """``docs`` with tokens by the encoder that ``make`` builds in each worker from ``spec``, by default a tokenizer JSON's content.

    Texts are encoded ``batch`` at a time, or fewer once they have ``chars``
    characters; rows of no text or no tokens go.
    """
    shared = docs.sparkSession.sparkContext.broadcast(spec)  # a vocabulary: fixed size

    def groups(texts: list[str]) -> Iterator[tuple[int, int]]:
        start = held = 0
        for i, t in enumerate(texts):
            held += len(t)
            if i + 1 - start >= batch or held >= chars:
                yield start, i + 1
                start, held = i + 1, 0
        if start < len(texts):
            yield start, len(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make(shared.value)
        many = getattr(encoder, "encode_batch", None) or (lambda texts: [encoder.encode(t) for t in texts])
        for b in batches:
            texts = [x or "" for x in b.column(text_col).to_pylist()]
            for start, end in groups(texts):
                ids = pa.array(many(texts[start:end]), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*b.slice(start, end - start).columns, ids], [*b.schema.names, "tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.where(F.length(text_col) > 0).mapInArrow(run, f"{schema}, tokens array<int>").where(F.size("tokens") > 0)


def decode(rows: DataFrame, spec: str, column: str = "tokens") -> DataFrame:
    """``rows`` with decoded: the text of the ids in ``column``."""
    shared = rows.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(shared.value)
        for b in batches:
            ids = [x or [] for x in b.column(b.schema.names.index(column)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(t.decode_batch(ids, skip_special_tokens=False))], [*b.schema.names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, decoded string")


def round_trip(texts: DataFrame, spec: str, text_col: str = "text") -> DataFrame:
    """The rows whose text doesn't come back."""
    return decode(tokenize(texts, spec, text_col=text_col), spec).where(F.col("decoded") != F.col(text_col))


def canary_texts(n: int = 200, seed: int = 0) -> list[str]:
    """The fixed texts, and ``n`` strings drawn by the seed from several scripts."""
    rng = random.Random(seed)
    scripts = [(0x20, 0x7E), (0xC0, 0x17F), (0x900, 0x939), (0x4E00, 0x4FFF), (0x1F600, 0x1F640)]
    draw = lambda: "".join(chr(rng.randint(*rng.choice(scripts))) for _ in range(rng.randint(1, 40)))
    return [*CANON, *(draw() for _ in range(n))]


def canary(spark: SparkSession, spec: str, n: int = 200, seed: int = 0) -> DataFrame:
    """The canary texts that don't come back."""
    return round_trip(spark.createDataFrame([(t,) for t in canary_texts(n, seed)], "text string"), spec)


def decode_previews(incidents: DataFrame, spec: str, rows: int = 4, chars: int = 200) -> DataFrame:
    """(step, row, end, decoded) of ``incidents`` (step, input_ids_preview): head and tail of the first ``rows`` rows, ``chars`` characters each."""
    parts = incidents.select("step", F.posexplode(F.slice("input_ids_preview", 1, rows)).alias("row", "p"))
    both = parts.select("step", "row", F.inline(F.array(F.struct(F.lit("head").alias("end"), F.col("p.head").alias("tokens")), F.struct(F.lit("tail").alias("end"), F.col("p.tail").alias("tokens")))))
    return decode(both, spec).select("step", "row", "end", F.substring("decoded", 1, chars).alias("decoded"))


def compression(tokenized: DataFrame, by: str = "lang", text_col: str = "text") -> DataFrame:
    """(by, bytes_per_token)."""
    return tokenized.groupBy(by).agg((F.sum(F.octet_length(text_col)) / F.sum(F.size("tokens"))).alias("bytes_per_token"))
