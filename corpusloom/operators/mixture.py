"""Mixture schedules: drawn on the driver from counts or sizes alone, written in chunks, then joined to the data."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.sources.scratch import Scratch


def check_shares(counts: dict[str, int], shares: dict[str, float]) -> None:
    if not counts:
        raise ValueError("no sources")
    if set(counts) != set(shares):
        raise ValueError(f"sources and shares differ: {sorted(set(counts) ^ set(shares))}")
    if abs(sum(shares.values()) - 1) > 1e-6:
        raise ValueError("shares must sum to 1")


def check_manifests(manifests: list[dict]) -> None:
    """Corpora may be composed only if their tokenizers (tokenizer_sha256) and sequence lengths are one."""
    for key in ("tokenizer_sha256", "sequence_length"):
        if len({m[key] for m in manifests}) > 1:
            raise ValueError(f"the corpora differ in {key}")


def compose_schedule(counts: dict[str, int], shares: dict[str, float], total: int | None = None, seed: int = 0, bootstrap: int = 16) -> Iterator[tuple[int, str, int]]:
    """(position, source, local id): weighted picks first, then the source furthest behind its share.

    Equal deficits are drawn among; when none is behind, a weighted pick. It
    ends at ``total`` or once every source is used up. What is kept is a few
    numbers for each source.
    """
    check_shares(counts, shares)
    rng, names = random.Random(seed), list(counts)
    size, share = (np.array([d[s] for s in names], float) for d in (counts, shares))
    taken = np.zeros(len(names))
    for position in range(int(size.sum() if total is None else min(total, size.sum()))):
        live = taken < size
        behind = np.where(live, share * position - taken, -np.inf)
        if position < bootstrap or behind.max() <= 0:
            chances = np.where(live, share, 0.0)
            pick = rng.choices(range(len(names)), chances if chances.sum() > 0 else live)[0]
        else:
            pick = rng.choice(np.flatnonzero(behind == behind.max()).tolist())
        yield position, names[pick], int(taken[pick])
        taken[pick] += 1


def measure(column: Column, kind: str = "text") -> Column:
    """The default size of a row: the characters of a text or the elements of an array, 1 at least, and 1 for anything else."""
    n = F.length(column) if kind == "text" else F.size(column) if kind == "array" else F.lit(1)
    return F.greatest(F.lit(1), F.coalesce(n, F.lit(1)))


class _Stream:
    """The sizes of one source in order, which can start anew."""

    def __init__(self, sizes: Callable[[], Iterator[int]]):
        self.sizes, self.emitted = sizes, 0
        self.restart()

    def restart(self) -> None:
        self.place, self.rest = 0, iter(self.sizes())

    def take(self) -> tuple[int, int] | None:
        """(place, size) of the next row, or None at the end."""
        for size in self.rest:
            self.place += 1
            self.emitted += max(1, size)
            return self.place - 1, size
        return None


def mixture_schedule(
    sizes: dict[str, Callable[[], Iterator[int]]], weights: dict[str, float], seed: int = 0, on_exhaust: str = "drop", bootstrap: int = 32, limit: int | None = None
) -> Iterator[tuple[int, str, int]]:
    """(position, source, local id): picks in proportion to what each source lacks of its share of the size taken.

    ``sizes`` gives for each source a function that starts its sizes, in
    order, anew. ``on_exhaust``: stop ends at the first empty source, drop
    goes on without it, cycle starts it anew (``limit`` then bounds the picks).
    """
    if on_exhaust not in ("stop", "drop", "cycle"):
        raise ValueError(on_exhaust)
    if set(weights) - set(sizes) or any(w < 0 for w in weights.values()) or sum(weights.values()) <= 0:
        raise ValueError("weights must be nonnegative, not all 0, and of known sources")
    rng, position = random.Random(seed), 0
    live = {s: _Stream(sizes[s]) for s, w in weights.items() if w > 0}
    while live and (limit is None or position < limit):
        whole, sofar = sum(weights[s] for s in live), sum(x.emitted for x in live.values())
        lacks = [max(0.0, weights[s] / whole * sofar - x.emitted) for s, x in live.items()]
        steered = position >= bootstrap and any(lacks)
        pick = rng.choices(list(live), lacks if steered else [weights[s] for s in live])[0]
        got = live[pick].take()
        if got:
            yield position, pick, got[0]
            position += 1
        elif on_exhaust == "drop":
            del live[pick]
        elif on_exhaust == "stop" or live[pick].place == 0:
            return
        else:
            live[pick].restart()


def write_schedule(spark: SparkSession, picks: Iterator[tuple[int, str, int]], chunk: int = 200_000) -> DataFrame:
    """A table (position, source, local_id) of ``picks``, written ``chunk`` rows at a time, which is all that the driver holds."""
    out = f"{Scratch(spark, 'schedule').path}/picks"
    schema = "position long, source string, local_id long"
    spark.createDataFrame([], schema).write.parquet(out)
    while part := list(islice(picks, chunk)):
        columns = [pa.array(c, t) for c, t in zip(zip(*part, strict=True), (pa.int64(), pa.string(), pa.int64()), strict=True)]
        spark.createDataFrame(pa.table(columns, ["position", "source", "local_id"])).write.mode("append").parquet(out)
    return spark.read.schema(schema).parquet(out)


def apply_schedule(rows: DataFrame, schedule: DataFrame, source: str = "source", local: str = "seq") -> DataFrame:
    """``rows`` in the places that ``schedule`` (position, source, local_id) gives them: one equi join."""
    s = schedule.select("position", F.col("source").alias("__s"), F.col("local_id").alias("__l"))
    return rows.join(s, (F.col(source) == F.col("__s")) & (F.col(local) == F.col("__l"))).drop("__s", "__l")


def renormalise(shares: DataFrame, present: DataFrame) -> DataFrame:
    """(source, share) over the sources of ``present``, scaled to 1; sources are few."""
    kept = shares.join(present.select("source").distinct(), "source", "left_semi")
    return kept.withColumn("share", F.col("share") / F.sum("share").over(Window.partitionBy()))


def share_drift(actual: DataFrame, target: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """(drift, passed): the largest difference over the union of the sources of (source, share) tables."""
    both = actual.withColumnRenamed("share", "x").join(target.withColumnRenamed("share", "y"), "source", "full")
    gap = F.max(F.abs(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0))))
    return both.agg(gap.alias("drift")).withColumn("passed", F.col("drift") <= tolerance)
