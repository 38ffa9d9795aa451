"""Structured Streaming forms of the one-pass operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.functions import text as T
from corpusloom.operators import decontam, dedup, filters


def filter_stream(docs: DataFrame, index: DataFrame | None = None, n: int = 13) -> DataFrame:
    """The filter chain on a stream of documents, then, with ``index`` (benchmark_id, gram), the benchmark n-gram test.

    Stateless: a document is kept or dropped when seen. Workers hold the
    index's n-grams, up to ``decontam.BROADCAST_ROWS`` of them; for a larger
    index, :func:`clean_batch` tests each micro-batch by joins.
    """
    out = filters.filter_documents(docs).where("reason = 'ok'")
    if index is None:
        return out
    rows = index.select("gram").distinct().limit(decontam.BROADCAST_ROWS + 1).toArrow()["gram"].to_pylist()
    if len(rows) > decontam.BROADCAST_ROWS:
        raise ValueError("the index is too large for a stream's workers: use clean_batch")
    known = docs.sparkSession.sparkContext.broadcast(frozenset(rows))

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        grams = known.value

        def free(t: str) -> bool:
            w = T.normal_words(t)
            return not any(" ".join(w[i : i + n]) in grams for i in range(len(w) - n + 1))

        return texts.map(free)

    return out.where(clean("text"))


def clean_batch(index: DataFrame, out_path: str, n: int = 13):
    """A ``foreachBatch`` function: the filter chain and the benchmark n-gram test, for an index of any size."""

    def run(batch: DataFrame, epoch: int) -> None:
        kept = filters.filter_documents(batch).where("reason = 'ok'").persist()
        decontam.keep_clean(kept, decontam.scan(kept, index, n)).write.mode("overwrite").parquet(f"{out_path}/epoch={epoch}")
        kept.unpersist()

    return run


def _seen(spark, path: str, schema: str, epoch: int) -> DataFrame:
    """What earlier batches wrote below ``path``: a batch that is run again must not see its own rows."""
    try:
        return spark.read.schema(f"{schema}, epoch long").parquet(path).where(F.col("epoch") < epoch).drop("epoch")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def near_batch(seen_path: str, out_path: str, cfg: dedup.MinHashConfig = dedup.MinHashConfig(), group: str = "source"):
    """A ``foreachBatch`` function: near-duplicate removal over the whole stream, by :func:`corpusloom.operators.dedup.greedy_keep`.

    Signatures of documents kept so far are a table; a document of a batch
    that is similar to one of its group there goes, the rest are resolved
    among themselves in order of doc_id, and those kept are added.
    """
    schema = f"doc_id long, {group} string, signature array<long>"

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        seen = _seen(spark, seen_path, schema, epoch)
        signed = dedup.signatures(batch, cfg, [group]).persist()
        both = seen.unionByName(signed).select("doc_id", group, "signature")
        old, new = (t.select(group, F.col("doc_id").alias(x), F.explode(dedup.band_keys(cfg)).alias("key")) for t, x in ((seen, "a"), (signed, "b")))
        pairs = old.join(new, [group, "key"]).select("a", "b").distinct()
        gone = dedup.similar(pairs, both.select(F.col("doc_id").alias("id"), "signature"), cfg).select(F.col("b").alias("doc_id")).distinct()
        left = batch.join(gone, "doc_id", "left_anti")
        kept = left.join(dedup.greedy_keep(left, cfg, group).where("kept").select("doc_id"), "doc_id", "left_semi").persist()
        kept.write.mode("overwrite").parquet(f"{out_path}/epoch={epoch}")
        signed.join(kept.select("doc_id"), "doc_id", "left_semi").select("doc_id", group, "signature").write.mode("overwrite").parquet(f"{seen_path}/epoch={epoch}")
        kept.unpersist()
        signed.unpersist()

    return run


def dedup_batch(seen_path: str, out_path: str):
    """A ``foreachBatch`` function: keeps the first document of each exact text over the whole stream.

    Digests kept so far are a table; each batch anti-joins it and appends.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        keyed = batch.withColumn("digest", F.sha2("text", 256))
        first = keyed.groupBy("digest").agg(F.min("doc_id").alias("__first"))
        fresh = keyed.join(first, "digest").where("doc_id = __first").drop("__first").dropDuplicates(["digest"])
        fresh = fresh.join(_seen(spark, seen_path, "digest string", epoch), "digest", "left_anti")
        fresh = fresh.persist()
        fresh.write.mode("overwrite").parquet(f"{out_path}/epoch={epoch}")
        fresh.select("digest").write.mode("overwrite").parquet(f"{seen_path}/epoch={epoch}")
        fresh.unpersist()

    return run


def watchdog_stream(losses: DataFrame, window: int = 200, least: int = 50, soft: float = 3.0, hard: float = 6.0) -> DataFrame:
    """(run, step, loss, verdict) of a stream (run, step, loss): each against the finite losses before it.

    State is the last ``window`` finite losses of each run.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        past = list(state.get[0]) if state.exists else []
        for frame in frames:
            verdicts = []
            frame = frame.sort_values("step")
            for x in frame["loss"]:
                if x is None or x != x or abs(x) == float("inf"):
                    verdicts.append("hard")
                    continue
                verdict = "ok"
                if len(past) >= least:
                    mean = sum(past) / len(past)
                    std = (sum((v - mean) ** 2 for v in past) / len(past)) ** 0.5
                    if std > 0:
                        z = (x - mean) / std
                        verdict = "hard" if z >= hard else "soft" if z >= soft else "ok"
                verdicts.append(verdict)
                past = [*past[-(window - 1) :], float(x)]
            yield frame.assign(verdict=verdicts)[["run", "step", "loss", "verdict"]]
        state.update((past,))

    return losses.groupBy("run").applyInPandasWithState(
        run, "run long, step long, loss double, verdict string", "past array<double>", "append", GroupStateTimeout.NoTimeout
    )


def monitor_stream(events: DataFrame, delay: str = "1 hour", window: str = "10 minutes") -> DataFrame:
    """Events and tokens per source and window, with late events dropped after ``delay``."""
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", window), "source")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"))
        .select(F.col("window.start").alias("start"), "source", "n", "tokens")
    )
