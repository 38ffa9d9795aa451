"""Readers and writers of the corpus formats: flat token files, Arrow IPC, JSON lines and logs."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.sources.scratch import Scratch

INCIDENT = (
    "ts string, step long, data_position long, reason string, loss double, batch_shape map<string,array<int>>, "
    "input_ids_preview array<struct<head:array<int>,tail:array<int>>>, segment_ids_histogram array<map<string,int>>"
)


def numbered(rows: DataFrame, order_by: str, name: str) -> DataFrame:
    """``rows`` with ``name``: their place by ``order_by``, from 0.

    Rows are dealt by ranges and written so, which fixes the ranges; then each
    range is numbered by its own task behind the counts of those before it.
    """
    scratch, pieces = Scratch(rows.sparkSession, "numbered"), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = scratch.save(rows.repartitionByRange(pieces, F.col(order_by).asc_nulls_first()).withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    counts = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    offsets = scratch.save(counts.withColumn("__off", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(F.col(order_by).asc_nulls_first())) - 1
    return dealt.join(offsets, "__part").withColumn(name, (F.col("__off") + inside).cast("long")).drop("__part", "__off")


def read_documents(
    rows: DataFrame, dataset: str, text_fields: list[str], id_field: str | None = None, order_by: str | None = None, skip_first: int = 0, sample_limit: int | None = None
) -> DataFrame:
    """Rows of any table as (doc_id, dataset, text): named fields joined by blank lines, nulls skipped.

    One missing field alone is an error, raised when planned. Without an id
    field, ids are ``dataset#k`` by ``order_by``, which counts skipped rows
    too. ``skip_first`` and ``sample_limit`` cut the raw rows by that order.
    """
    missing = [c for c in text_fields if c not in rows.columns]
    if missing and len(text_fields) == 1:
        raise ValueError(f"no column {missing[0]}")
    fields = [F.col(c).cast("string") for c in text_fields if c in rows.columns]
    text = F.concat_ws("\n\n", *fields).alias("text")
    cut = bool(skip_first or sample_limit is not None)
    if not order_by and (cut or not id_field):
        raise ValueError("an order is needed")
    if cut or not id_field:
        rows = numbered(rows, order_by, "__k")
    if cut:
        last = F.lit(True) if sample_limit is None else F.col("__k") < skip_first + sample_limit
        rows = rows.where((F.col("__k") >= skip_first) & last)
    doc_id = F.col(id_field).cast("string") if id_field else F.concat(F.lit(f"{dataset}#"), F.col("__k"))
    return rows.select(doc_id.alias("doc_id"), F.lit(dataset).alias("dataset"), text)


def _mounted(folder: str) -> str:
    path = folder.removeprefix("file://")
    if "://" in path or not os.path.isabs(path):
        raise ValueError(f"{folder} is no folder that machines can mount")
    return path


def write_token_files(sequences: DataFrame, folder: str, length: int, shard: str = "shard_id", order: str = "local_id") -> DataFrame:
    """Write ``sequences`` (shard, local id, tokens) as flat files below ``folder``, which all machines mount: (file, n_sequences, bytes).

    A shard is ``shard-000000/tokens.bin``: unsigned 32-bit little-endian ids,
    no header. Its rows meet in one task, sorted, and stream to the file, so
    no shard is ever one value; files are renamed into place whole. A sequence
    of another length, or a negative id, is an error.
    """
    root = _mounted(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, part, n = None, None, "", 0

        def close():
            out.close()
            name = f"shard-{now:06d}/tokens.bin"
            os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
            os.replace(part, f"{root}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([n * length * 4], pa.int64())], ["file", "n_sequences", "bytes"])

        os.makedirs(root, exist_ok=True)
        for batch in batches:
            for s, tokens in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                flat = tokens.values.to_numpy()
                if len(flat) != length or (flat < 0).any():
                    raise ValueError("a sequence has another length or a negative token")
                if s != now:
                    if out:
                        yield close()
                    now, n, part = s, 0, f"{root}/.{s}-{uuid.uuid4().hex}"
                    out = open(part, "wb")
                out.write(flat.astype("<u4").tobytes())
                n += 1
        if out:
            yield close()

    rows = sequences.select(F.col(shard).cast("long").alias("s"), F.col("tokens").cast("array<bigint>").alias("t"), F.col(order).alias("o"))
    rows = rows.repartition("s").sortWithinPartitions("s", "o").select("s", "t")
    return Scratch(sequences.sparkSession, "tokens").save(rows.mapInArrow(run, "file string, n_sequences long, bytes long"))


def read_token_files(spark: SparkSession, folder: str, length: int, rows_each: int = 1024) -> DataFrame:
    """(path, local_id, tokens) of flat token files below ``folder``, which all machines mount; a short tail is dropped.

    Only names and sizes are listed; each task reads stretches of ``rows_each``
    sequences by their offsets, so files of any size are split.
    """
    _mounted(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with open(path.removeprefix("file://").removeprefix("file:"), "rb") as f:
                    f.seek(first * length * 4)
                    flat = np.frombuffer(f.read(n * length * 4), "<u4").astype(np.int64)
                tokens = pa.FixedSizeListArray.from_arrays(pa.array(flat), length).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(range(first, first + n), pa.int64()), tokens], ["path", "local_id", "tokens"])

    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.bin").load(folder).select("path", "length")
    whole = listed.withColumn("n", F.floor(F.col("length") / (length * 4))).where("n > 0")
    starts = whole.select("path", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(rows_each).cast("long"))).alias("first"))
    cuts = starts.select("path", "first", F.least(F.lit(rows_each).cast("long"), F.col("n") - F.col("first")).alias("k"))
    return cuts.repartition(spark.sparkContext.defaultParallelism).mapInArrow(run, "path string, local_id long, tokens array<bigint>")


def read_arrow_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of Arrow IPC files (file or stream format) under ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                buffer = pa.py_buffer(data.as_py())
                try:
                    yield from pa.ipc.open_file(buffer).read_all().to_batches()
                except pa.ArrowInvalid:
                    yield from pa.ipc.open_stream(buffer).read_all().to_batches()

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def arrow_file(batch: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_file(sink, batch.schema) as w:
        w.write_table(batch)
    return sink.getvalue().to_pybytes()


def split_json(line: str) -> list[str]:
    """The JSON objects of a log line that may hold several glued together; what doesn't parse is skipped."""
    out, at, decoder = [], 0, json.JSONDecoder()
    while (at := line.find("{", at)) >= 0:
        try:
            _, end = decoder.raw_decode(line, at)
            out.append(line[at:end])
            at = end
        except ValueError:
            at += 1
    return out


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, line, …) of JSON-lines logs: garbage is skipped and glued objects give a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [split_json(t or "") for t in batch.column(1).to_pylist()]
            at = pa.array([i for i, f in enumerate(found) for _ in f], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array([x for f in found for x in f], pa.string())], ["file", "line"])

    lines = spark.read.text(path).select(F.input_file_name().alias("file"), "value").mapInArrow(run, "file string, line string")
    return lines.withColumn("e", F.from_json("line", schema)).select("file", "line", "e.*")


def append_json(rows: DataFrame, path: str) -> None:
    """Append to a folder of JSON lines (quarantine, ledger)."""
    rows.write.mode("append").json(path)


def read_incidents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INCIDENT).json(path)


def write_shards(sequences: DataFrame, path: str, per_shard: int, length: int, spans: DataFrame | None = None, tokenizer_sha256: str = "") -> None:
    """Packed sequences (sequence_id, tokens, …) as Parquet partitioned by shard, after checks of every row.

    Fails on a sequence of another length, a negative id, or a span outside
    its sequence. With ``spans`` (sequence_id, source, doc_id, token_start,
    token_end, doc_span_id) the table lies in ``tokens``, beside ``doc_meta``
    (spans) and ``seq_meta`` (source mix and span range of each sequence), both
    by shard, and ``manifest``, written last, with a row for each shard.
    """
    bad = sequences.where((F.size("tokens") != length) | F.exists("tokens", lambda t: t < 0))
    if bad.head(1):
        raise ValueError("a sequence has another length or a negative token")
    shard = F.floor(F.col("sequence_id") / per_shard).alias("shard_id")

    def put(rows: DataFrame, name: str, *order: str) -> None:
        out = rows.select("*", shard).repartition("shard_id").sortWithinPartitions("shard_id", *order)
        out.write.option("compression", "zstd").partitionBy("shard_id").parquet(f"{path}{name}")

    put(sequences, "/tokens" if spans is not None else "", "sequence_id")
    if spans is None:
        return
    if spans.where((F.col("token_start") < 0) | (F.col("token_end") > length) | (F.col("token_start") >= F.col("token_end"))).head(1):
        raise ValueError("a span lies outside its sequence")
    put(spans, "/doc_meta", "doc_span_id")
    mix = spans.groupBy("sequence_id", "source").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("n"))
    mix = mix.groupBy("sequence_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "n")))).alias("source_mix"))
    ends = spans.groupBy("sequence_id").agg(F.min("doc_span_id").alias("doc_span_start_id"), F.count(F.lit(1)).cast("int").alias("doc_span_count"))
    start = F.col("sequence_id") * length
    meta = mix.join(ends, "sequence_id").withColumn("token_start_global", start).withColumn("token_end_global", start + length)
    put(meta, "/seq_meta", "sequence_id")
    n = F.count(F.lit(1))
    shards = meta.groupBy(shard).agg(
        n.alias("n_sequences"), F.min("sequence_id").alias("first_id"), F.max("sequence_id").alias("last_id"), F.sum("doc_span_count").alias("n_spans"), (n * length).alias("n_tokens")
    )
    full = shards.withColumn("sequence_length", F.lit(length)).withColumn("tokenizer_sha256", F.lit(tokenizer_sha256))
    full.coalesce(1).write.json(f"{path}/manifest")  # a row for each shard


MANIFEST = "shard_id long, n_sequences long, first_id long, last_id long, n_spans long, n_tokens long, sequence_length int, tokenizer_sha256 string"


def corpus_summary(manifest: DataFrame) -> DataFrame:
    """(n_shards, n_sequences, n_tokens, first_id, last_id) of shard manifests; lengths or tokenizers that differ are an error when read."""
    one = lambda c: F.countDistinct(c) <= 1
    out = manifest.agg(
        F.count(F.lit(1)).alias("n_shards"),
        F.coalesce(F.sum("n_sequences"), F.lit(0)).alias("n_sequences"),
        F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"),
        F.coalesce(F.min("first_id"), F.lit(-1)).alias("first_id"),
        F.coalesce(F.max("last_id"), F.lit(-1)).alias("last_id"),
        (one("sequence_length") & one("tokenizer_sha256")).alias("__same"),
    )
    checked = F.when(F.col("__same"), F.col("n_shards")).otherwise(F.raise_error(F.lit("shards of different lengths or tokenizers")).cast("long"))
    return out.withColumn("n_shards", checked).drop("__same")


def completeness(shards: DataFrame, manifest: DataFrame, per_shard: int, tokenizer_sha256: str) -> DataFrame:
    """(n_shards, n_missing, n_short, n_other_tokenizer, passed): shards (shard_id) without a manifest row, that lack sequences though not the last, or of another tokenizer."""
    here = manifest.select("shard_id", "n_sequences", "tokenizer_sha256").withColumn("__m", F.lit(True))
    rows = shards.select("shard_id").distinct().join(here, "shard_id", "left")
    last = rows.agg(F.max("shard_id").alias("__last"))  # one row
    n = rows.crossJoin(F.broadcast(last)).agg(
        F.count(F.lit(1)).alias("n_shards"),
        F.count_if(F.col("__m").isNull()).alias("n_missing"),
        F.count_if((F.col("n_sequences") < per_shard) & (F.col("shard_id") < F.col("__last"))).alias("n_short"),
        F.count_if(F.col("tokenizer_sha256") != tokenizer_sha256).alias("n_other_tokenizer"),
    )
    return n.withColumn("passed", (F.col("n_missing") == 0) & (F.col("n_short") == 0) & (F.col("n_other_tokenizer") == 0))


class ManifestStore:
    """What shards of a dataset are done, as a JSON file for each below ``root`` in any store."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, dataset: str, shard: str) -> str:
        return f"{self.root}/{dataset.replace('/', '__')}/{shard}.json"

    def _fs(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def has(self, dataset: str, shard: str) -> bool:
        fs, path = self._fs(self._path(dataset, shard))
        return fs.exists(path)

    def write(self, dataset: str, shard: str, entry: dict) -> None:
        from corpusloom.operators.governance import write_text

        write_text(self.spark, json.dumps(entry, sort_keys=True), self._path(dataset, shard))

    def read(self, dataset: str, schema: str) -> DataFrame:
        """(shard, …) of a dataset's entries."""
        rows = self.spark.read.schema(schema).json(f"{self.root}/{dataset.replace('/', '__')}")
        return rows.withColumn("shard", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))


def mirror(spark: SparkSession, source: str, target: str, tries: int = 3) -> int:
    """Copy all files below ``source`` to ``target``, in any stores, and count them; each is tried ``tries`` times."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    src = path(source)
    a, b = src.getFileSystem(conf), path(target).getFileSystem(conf)
    base, n = a.getFileStatus(src).getPath().toString().rstrip("/"), 0
    files = a.listFiles(src, True)
    while files.hasNext():
        one = files.next().getPath()
        to = path(target.rstrip("/") + one.toString()[len(base) :])
        for left in reversed(range(tries)):
            try:
                if not jvm.org.apache.hadoop.fs.FileUtil.copy(a, one, b, to, False, True, conf):
                    raise OSError(f"{one.toString()} was not copied")
                break
            except Exception:
                if not left:
                    raise
        n += 1
    return n


def write_lines(docs: DataFrame, path: str, least: int = 50, most: int = 200_000) -> DataFrame:
    """Write the texts of ``docs`` (source, text) as lines of at most ``most`` characters, and count them: (source, n_lines). Short texts go."""
    rows = docs.where(F.length("text") >= least).select("source", F.translate(F.substring("text", 1, most), "\n\r", "  ").alias("value"))
    rows = Scratch(docs.sparkSession, "lines").save(rows)
    rows.select("value").write.text(path)
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_lines"))


def get_sequence(spark: SparkSession, path: str, sequence_id: int, per_shard: int) -> DataFrame:
    """One sequence by id; the shard predicate prunes all other folders."""
    return spark.read.parquet(path).where((F.col("shard_id") == sequence_id // per_shard) & (F.col("sequence_id") == sequence_id))


def iterate_from(spark: SparkSession, path: str, start: int, per_shard: int) -> DataFrame:
    rows = spark.read.parquet(path).where((F.col("shard_id") >= start // per_shard) & (F.col("sequence_id") >= start))
    return rows.orderBy("sequence_id")


def pending(work: DataFrame, manifest: DataFrame, keys: list[str]) -> DataFrame:
    """What of ``work`` no manifest row names yet."""
    return work.join(manifest.select(*keys).distinct(), keys, "left_anti")
