"""Benchmark decontamination: 64-bit hashes of n-grams find the few that can match, and their text decides."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T

#: Distinct n-grams up to which an index's hashes are sent to the workers (8 MB) and its n-grams to a stage of few rows.
#: A larger index meets all n-grams of the documents in a join on their hash.
BROADCAST_ROWS = 1_000_000


def build_index(prompts: DataFrame, n: int) -> DataFrame:
    """(benchmark_id, gram), distinct, of ``prompts`` (benchmark_id, prompt); blank prompts give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for b, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = T.normal_words(t)
                rows += [(b, g) for g in dict.fromkeys(" ".join(w[i : i + n]) for i in range(len(w) - n + 1))]
            ids, grams = zip(*rows, strict=True) if rows else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(grams, pa.string())], ["benchmark_id", "gram"])

    rows = prompts.select(F.col("benchmark_id").cast("string"), F.col("prompt").cast("string"))
    return rows.mapInArrow(run, "benchmark_id string, gram string").distinct()


def adapter_prompts(examples: DataFrame, name: str, prompt_col: str = "prompt") -> DataFrame:
    """(benchmark_id, prompt) of a benchmark's examples, under its adapter's ``name``; a missing column is a TypeError."""
    if prompt_col not in examples.columns:
        raise TypeError(f"{name}: examples without {prompt_col}")
    return examples.select(F.lit(name).alias("benchmark_id"), F.col(prompt_col).alias("prompt"))


def index_sizes(prompts: DataFrame, index: DataFrame) -> DataFrame:
    """(benchmark_id, n_examples, n_ngrams); benchmarks without n-grams are listed."""
    sizes = prompts.groupBy("benchmark_id").agg(F.count(F.lit(1)).alias("n_examples"))
    grams = index.groupBy("benchmark_id").agg(F.count(F.lit(1)).alias("n_ngrams"))
    return sizes.join(grams, "benchmark_id", "left").select("benchmark_id", "n_examples", F.coalesce("n_ngrams", F.lit(0)).cast("long").alias("n_ngrams"))


def replace_benchmark(index: DataFrame, again: DataFrame) -> DataFrame:
    """``index`` with the benchmarks of ``again`` in place of those of the same id."""
    return index.join(again.select("benchmark_id").distinct(), "benchmark_id", "left_anti").unionByName(again)


def _gram_hashes(grams: DataFrame, n: int) -> np.ndarray | None:
    """The sorted hashes of an index's n-grams, or None beyond ``BROADCAST_ROWS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [T.window_hashes(g.split(" "), n) for g in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h).view(np.int64) if h else [], pa.int64())], ["h"])

    got = grams.mapInArrow(run, "h long").limit(BROADCAST_ROWS + 1).toArrow()["h"].to_numpy()
    return np.sort(got.view(np.uint64)) if len(got) <= BROADCAST_ROWS else None


def _hits(docs: DataFrame, n: int, known: np.ndarray | None) -> DataFrame:
    """(doc_id, gram, k): the n-grams of ``docs`` (doc_id, text) whose hash is ``known`` (all if None), and how often each occurs."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in batches:
            at, grams, counts = [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                w = T.normal_words(t)
                if wanted is None:
                    places = range(len(w) - n + 1)
                else:
                    h = T.window_hashes(w, n)
                    spot = np.searchsorted(wanted, h)
                    places = np.flatnonzero(wanted[np.minimum(spot, len(wanted) - 1)] == h).tolist() if len(wanted) else ()
                for g, k in Counter(" ".join(w[p : p + n]) for p in places).items():
                    at.append(i)
                    grams.append(g)
                    counts.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(grams, pa.string()), pa.array(counts, pa.int64())], ["doc_id", "gram", "k"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, gram string, k long")


def scan(docs: DataFrame, index: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, benchmark_id, n_matches): positions of a document whose n-gram a benchmark has.

    Workers look the hash of each position up in the sorted hashes of the
    index and send on the n-grams that hit; a join on their text decides.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = _gram_hashes(index.select("gram").distinct(), n)
    found = _hits(rows, n, known).join(index, "gram")
    return found.groupBy("doc_id", "benchmark_id").agg(F.sum("k").alias("n_matches"))


def with_matches(docs: DataFrame, index: DataFrame, n: int, text_col: str, name: str, where: Column) -> DataFrame:
    """``docs`` with ``name``: its positions whose n-gram a benchmark has, summed over benchmarks; 0 where ``where`` doesn't hold.

    Needs doc_id to name the row: rows that repeat an id share their sum.
    """
    hits = scan(docs.where(where), index, n, text_col=text_col).groupBy("doc_id").agg(F.sum("n_matches").alias(name))
    out = docs.join(hits, "doc_id", "left")
    return out.withColumn(name, F.when(where, F.coalesce(name, F.lit(0))).otherwise(F.lit(0)).cast("long"))


def scan_modes(docs: DataFrame, prompts: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """(mode, doc_id, benchmark_id, n_matches) for several n-gram sizes."""
    out = None
    for mode, n in sizes.items():
        part = scan(docs, build_index(prompts, n), n).withColumn("mode", F.lit(mode))
        out = part if out is None else out.unionByName(part)
    return out


def keep_clean(docs: DataFrame, matches: DataFrame) -> DataFrame:
    return docs.join(matches.select("doc_id").distinct(), "doc_id", "left_anti")


def tag(docs: DataFrame, matches: DataFrame) -> DataFrame:
    """``docs`` with contaminated and n_matches; nothing is dropped."""
    n = matches.groupBy("doc_id").agg(F.sum("n_matches").alias("n_matches"))
    out = docs.join(n, "doc_id", "left").withColumn("n_matches", F.coalesce("n_matches", F.lit(0)).cast("long"))
    return out.withColumn("contaminated", F.col("n_matches") > 0)


def decide(docs: DataFrame, matches: DataFrame) -> DataFrame:
    """``docs`` with keep, reason (ok or contaminated) and score (the matches of all benchmarks): the test as a filter."""
    out = tag(docs, matches)
    reason = F.when(F.col("contaminated"), "contaminated").otherwise("ok")
    return out.withColumn("keep", ~F.col("contaminated")).withColumn("reason", reason).withColumn("score", F.col("n_matches").cast("double")).drop("n_matches", "contaminated")


def report(docs: DataFrame, prompts: DataFrame, matches: DataFrame, examples: int = 20) -> DataFrame:
    """(benchmark_id, n_examples, matched_docs, scanned_docs, any_docs, rate, example_ids); benchmarks without a match are listed.

    any_docs counts the documents that match any benchmark; example_ids are
    the ``examples`` smallest matched ids of the benchmark.
    """
    sizes = prompts.groupBy("benchmark_id").agg(F.count(F.lit(1)).alias("n_examples"))
    pairs = matches.select("benchmark_id", "doc_id").distinct()
    hit = pairs.groupBy("benchmark_id").agg(F.count(F.lit(1)).alias("matched_docs"))
    # The smallest ids of each of 64 parts hold the smallest of all, so no benchmark's ids meet in one place.
    dealt = pairs.groupBy("benchmark_id", F.pmod(F.xxhash64("doc_id"), F.lit(64)).alias("part")).agg(F.slice(F.sort_array(F.collect_list("doc_id")), 1, examples).alias("few"))
    few = dealt.groupBy("benchmark_id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("few"))), 1, examples).alias("example_ids"))
    scanned = docs.agg(F.count(F.lit(1)).alias("scanned_docs")).crossJoin(matches.agg(F.countDistinct("doc_id").alias("any_docs")))  # one row
    rate = F.when(F.col("scanned_docs") > 0, F.col("matched_docs") / F.col("scanned_docs")).otherwise(0.0)
    return (
        sizes.join(hit, "benchmark_id", "left")
        .join(few, "benchmark_id", "left")
        .withColumn("matched_docs", F.coalesce("matched_docs", F.lit(0)).cast("long"))
        .crossJoin(F.broadcast(scanned))
        .withColumn("rate", F.round(rate, 6))
    )


def report_lines(reported: DataFrame) -> DataFrame:
    """(benchmark_id, line): the report as CSV lines, to be written by benchmark under the header ``CSV_HEADER``."""
    line = F.concat_ws(",", "benchmark_id", "n_examples", "matched_docs", "scanned_docs", F.format_string("%.6f", F.col("rate").cast("double")))
    return reported.select("benchmark_id", line.alias("line"))


CSV_HEADER = "benchmark_id,n_examples,matched_docs,scanned_docs,rate"


def write_report(reported: DataFrame, path: str) -> None:
    """One CSV file of the report, a row for each benchmark, by benchmark."""
    rows = reported.select("benchmark_id", "n_examples", "matched_docs", "scanned_docs", F.format_string("%.6f", F.col("rate").cast("double")).alias("rate"))
    rows.orderBy("benchmark_id").coalesce(1).write.option("header", True).csv(path)


def index_json(index: DataFrame, n: int) -> DataFrame:
    """(value): a JSON line for each benchmark and each 65,536 of its n-grams, with the sizes that loading checks."""
    part = F.pmod(F.xxhash64("gram"), F.greatest(F.lit(1), F.ceil(F.col("of") / 65_536)))
    sizes = index.groupBy("benchmark_id").agg(F.count(F.lit(1)).alias("of"))
    rows = index.join(sizes, "benchmark_id").groupBy("benchmark_id", "of", part.alias("part")).agg(F.sort_array(F.collect_list("gram")).alias("grams"))
    return rows.select(F.to_json(F.struct(F.lit(n).alias("n"), "benchmark_id", "of", "part", "grams")).alias("value"))


def save_index(index: DataFrame, n: int, path: str) -> None:
    index_json(index, n).write.text(path)


def index_from_json(lines: DataFrame, n: int) -> DataFrame:
    """(benchmark_id, gram) of the lines (value) of :func:`index_json`; another n or a missing part is an error when rows are read."""
    e = F.from_json("value", "n int, benchmark_id string, of long, part long, grams array<string>")
    rows = lines.select(e.alias("e")).select("e.*")
    right = F.when(F.col("n") == n, F.col("grams")).otherwise(F.raise_error(F.lit(f"an index of other n-grams than {json.dumps(n)}")).cast("array<string>"))
    whole = rows.groupBy("benchmark_id").agg(F.sum(F.size("grams")).alias("got"), F.max("of").alias("want"))
    checked = rows.join(whole, "benchmark_id").withColumn(
        "grams", F.when(F.col("got") == F.col("want"), right).otherwise(F.raise_error(F.lit("an index with parts missing")).cast("array<string>"))
    )
    return checked.select("benchmark_id", F.explode("grams").alias("gram"))


def load_index(spark: SparkSession, path: str, n: int) -> DataFrame:
    return index_from_json(spark.read.text(path), n)
