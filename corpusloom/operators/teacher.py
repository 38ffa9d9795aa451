"""The cache of teacher logits: its positions, shards and keys, their checks, and how batches meet it."""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import packing
from corpusloom.sources.scratch import Scratch

FORMAT = "1"


def shard_key(teacher: Column, top_k: Column, corpus_sha: Column, start: Column, end: Column) -> Column:
    """The name that a shard is stored under."""
    return F.format_string(
        "distillation_cache/%s/k%d/corpus_%s/tokens_%013d_%013d.arrow", teacher, top_k, F.substring(corpus_sha, 1, 16), start, end
    )


def batch_positions(batches: DataFrame, start: int = 0) -> DataFrame:
    """``batches`` (batch, n_rows, width) with first and last_excl: each takes rows * width positions after the one before."""
    whole = Scratch(batches.sparkSession, "positions").save(batches.withColumn("__all", F.lit(0)))
    size = (F.col("n_rows") * F.col("width")).cast("long")
    placed = packing.running_start(whole, "__all", "batch", size).drop("__all")
    return placed.withColumn("first", F.col("start") + start).withColumn("last_excl", F.col("first") + size).drop("start")


def flat_batches(tokens: DataFrame, start: int, end: int, rows: int, width: int) -> DataFrame:
    """(batch, row, first, last_excl, tokens) of ``tokens`` (pos, token) in [start, end): whole batches, the tail filled up with zeros.

    ``last_excl`` is where the batch's own tokens end; rows beyond it are all zeros.
    """
    size, spark = rows * width, tokens.sparkSession
    n = max(0, -(-(end - start) // size))
    mine = tokens.where((F.col("pos") >= start) & (F.col("pos") < end)).withColumn("__line", F.floor((F.col("pos") - start) / width))
    lines = mine.groupBy("__line").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "token"))), lambda x: x.token).alias("t"))
    every = spark.range(n * rows).withColumnRenamed("id", "__line")
    got = F.coalesce("t", F.array().cast("array<bigint>"))
    return every.join(lines, "__line", "left").select(
        F.floor(F.col("__line") / rows).alias("batch"),
        (F.col("__line") % rows).alias("row"),
        (F.lit(start) + F.floor(F.col("__line") / rows) * size).alias("first"),
        F.least(F.lit(end).cast("long"), F.lit(start) + (F.floor(F.col("__line") / rows) + 1) * size).alias("last_excl"),
        F.concat(got.cast("array<bigint>"), F.array_repeat(F.lit(0).cast("bigint"), F.lit(width) - F.size(got))).alias("tokens"),
    )


def plan_shards(spark: SparkSession, teacher: str, top_k: int, corpus_sha: str, start: int, end: int, batch_tokens: int, shard_tokens: int, manifest: DataFrame | None = None) -> DataFrame:
    """(start, end, key) of the shards still to be written over [start, end).

    A shard takes whole batches until it has ``shard_tokens``; the last takes
    what is left. ``manifest`` (teacher_id, start, end) of an earlier run is
    carried on from its largest end; one of another teacher is an error.
    """
    if manifest is not None:
        other, last = manifest.agg(F.count_if(F.col("teacher_id") != teacher), F.max("end")).first()
        if other:
            raise ValueError(f"the manifest has shards of another teacher than {teacher}")
        start = max(start, last if last is not None else start)
    size = -(-shard_tokens // batch_tokens) * batch_tokens
    n = max(0, -(-(end - start) // size))
    first = (F.lit(start) + F.col("id") * size).cast("long")
    out = spark.range(n).select(first.alias("start"), F.least(first + size, F.lit(end)).cast("long").alias("end"))
    return out.withColumn("key", shard_key(F.lit(teacher), F.lit(top_k), F.lit(corpus_sha), F.col("start"), F.col("end")))


def shard_issues(shards: DataFrame, payload: DataFrame) -> DataFrame:
    """(key, issues) of each of ``shards`` (key, top_k, start, end): what its rows of ``payload`` (key, pos, logits, indices) get wrong, or empty."""
    joined = payload.join(shards.select("key", "top_k", F.col("start").alias("__s"), F.col("end").alias("__e")), "key")
    found = joined.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.size("logits") != F.col("top_k")).alias("bad_logits"),
        F.count_if(F.size("indices") != F.col("top_k")).alias("bad_indices"),
        F.count_if(F.exists("indices", lambda i: i < 0)).alias("negative"),
        F.count_if((F.col("pos") < F.col("__s")) | (F.col("pos") >= F.col("__e"))).alias("outside"),
    )
    none = lambda c: F.coalesce(c, F.lit(0))
    tests = [
        (F.col("top_k") <= 0, "top_k must be above 0"),
        (F.col("end") <= F.col("start"), "the end must be after the start"),
        (none("n") != F.greatest(F.lit(0), F.col("end") - F.col("start")), "rows differ from the range"),
        (none("bad_logits") > 0, "logits of another size than top_k"),
        (none("bad_indices") > 0, "indices of another size than top_k"),
        (none("negative") > 0, "negative indices"),
        (none("outside") > 0, "positions outside the range"),
    ]
    return shards.join(found, "key", "left").select("key", F.concat_ws("; ", *(F.when(t, F.lit(m)) for t, m in tests)).alias("issues"))


def stack(cache: DataFrame, teachers: list[str]) -> DataFrame:
    """(pos, logits, indices) of ``cache`` (teacher_id, pos, logits, indices): by position, in the teachers' order.

    A position that a teacher lacks, or whose teachers differ in top_k, is an
    error when rows are read.
    """
    of = F.array_position(F.array(*(F.lit(t) for t in teachers)), F.col("teacher_id"))
    rows = cache.where(of > 0).select("pos", F.struct(of.alias("t"), "logits", "indices").alias("x"))
    rows = rows.groupBy("pos").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    sizes = F.size(F.array_distinct(F.transform("xs", lambda x: F.size(x.logits))))
    fault = F.when(F.size("xs") != len(teachers), "a position without all teachers").when(sizes != 1, "teachers of different top_k")
    checked = rows.withColumn("xs", F.when(fault.isNull(), F.col("xs")).otherwise(F.raise_error(fault).cast(rows.schema["xs"].dataType)))
    return checked.select("pos", F.transform("xs", lambda x: x.logits).alias("logits"), F.transform("xs", lambda x: x.indices).alias("indices"))


def attach(batches: DataFrame, cache: DataFrame, teachers: list[str], activation: int) -> DataFrame:
    """(step, batch, first, pos, logits, indices): the teachers' top-K of each position of the batches from step ``activation`` on.

    ``batches`` has (step, batch, first, last_excl). Batches before it give one
    row without a position. A position that the cache doesn't cover is an error
    when rows are read.
    """
    off = batches.where(F.col("step") < activation).select("step", "batch", "first")
    on = batches.where(F.col("step") >= activation).select("step", "batch", "first", F.explode(F.sequence("first", F.col("last_excl") - 1)).alias("pos"))
    joined = on.join(stack(cache, teachers), "pos", "left")
    kind = joined.schema["logits"].dataType
    covered = F.when(F.col("logits").isNotNull(), F.col("logits")).otherwise(F.raise_error(F.concat(F.lit("no teacher logits at "), F.col("pos"))).cast(kind))
    return joined.withColumn("logits", covered).select("step", "batch", "first", "pos", "logits", "indices").unionByName(off, allowMissingColumns=True)


def write_shards(rows: DataFrame, folder: str, meta: dict[str, str]) -> DataFrame:
    """Write ``rows`` (key, pos, logits, indices) as an Arrow IPC file for each key below ``folder``, which all machines mount: (key, sha256, n).

    A shard's rows meet in one task, sorted by position, and its file is
    renamed into place whole. ``meta`` and the format's version go to its schema.
    """
    root = folder.removeprefix("file://")
    if "://" in root or not os.path.isabs(root):
        raise ValueError(f"{folder} is no folder that machines can mount")
    kind = pa.schema([("pos", pa.int64()), ("logits", pa.list_(pa.float32())), ("indices", pa.list_(pa.uint32()))], {**meta, "format_version": FORMAT})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, out, n = None, None, None, 0

        def close():
            out.close()
            with open(part, "rb") as f:
                sha = hashlib.file_digest(f, "sha256").hexdigest()
            os.replace(part, f"{root}/{now}")
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([sha]), pa.array([n], pa.int64())], ["key", "sha256", "n"])

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for key in dict.fromkeys(keys):
                mine = batch.filter(pa.compute.equal(batch.column(0), key))
                if key != now:
                    if out:
                        yield close()
                    now, n, part = key, 0, f"{root}/{key}-{uuid.uuid4().hex}"
                    os.makedirs(os.path.dirname(part), exist_ok=True)
                    out = pa.ipc.new_file(part, kind)
                out.write_batch(pa.RecordBatch.from_arrays([mine.column(i + 1).cast(f.type) for i, f in enumerate(kind)], schema=kind))
                n += mine.num_rows
        if out:
            yield close()

    cols = rows.select("key", F.col("pos").cast("long"), F.col("logits").cast("array<float>"), F.col("indices").cast("array<bigint>"))
    done = cols.repartition("key").sortWithinPartitions("key", "pos").mapInArrow(run, "key string, sha256 string, n long")
    return Scratch(rows.sparkSession, "shards").save(done)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, logits, indices) of the shard files that ``path`` names; another format version is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1), strict=True):
                reader = pa.ipc.open_file(pa.py_buffer(data.as_py()))
                if (reader.schema.metadata or {}).get(b"format_version") != FORMAT.encode():
                    raise ValueError(f"{name} has another format version than {FORMAT}")
                for i in range(reader.num_record_batches):
                    b = reader.get_batch(i)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name.as_py()] * b.num_rows, pa.string()), b.column(0), b.column(1), b.column(2).cast(pa.list_(pa.int64()))],
                        ["path", "pos", "logits", "indices"],
                    )

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.arrow").load(path)
    return files.select("path", "content").mapInArrow(run, "path string, pos long, logits array<float>, indices array<bigint>")
