"""What the tokens of packed sequences came from: per place, per label, and for incidents of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import packing


def provenance(spans: DataFrame, ids: DataFrame) -> DataFrame:
    """The spans of the sequences that ``ids`` (sequence_id) names."""
    return spans.join(ids.select("sequence_id").distinct(), "sequence_id", "left_semi")


def source_vocab(spans: DataFrame) -> DataFrame:
    """(source, source_int): the sources by name, from 0; they are few."""
    names = spans.agg(F.sort_array(F.collect_set("source")).alias("s"))
    return names.select(F.posexplode("s").alias("source_int", "source"))


def token_sources(spans: DataFrame, vocab: DataFrame, length: int) -> DataFrame:
    """(sequence_id, sources): for each place the number of its source in ``vocab`` (source, source_int), else -1."""
    return packing.per_place(spans.join(F.broadcast(vocab), "source", "left"), length, F.col("source_int"), "sources")


def label_sources(sources: DataFrame, first: int, rows: int) -> DataFrame:
    """(batch, row, sequence_id, label_sources) of the ``first`` sequences, in whole batches of ``rows``; a short tail goes.

    The label of a place is the token after it, so its source is too.
    """
    full = first // rows * rows
    i = F.col("sequence_id")
    held = sources.where(i < full).select(F.floor(i / rows).alias("batch"), (i % rows).alias("row"), i, F.slice("sources", F.lit(2), F.size("sources") - 1).alias("label_sources"))
    complete = held.groupBy("batch").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") == rows).select("batch")
    return held.join(complete, "batch", "left_semi")


def mix_labels(mix: DataFrame) -> DataFrame:
    """(sequence_id, label, dominant) of ``mix`` (sequence_id, source, n_tokens): the largest source, with the mix where there are several."""
    entry = F.struct((-F.col("n_tokens")).alias("s"), F.col("source").alias("name"))
    rows = mix.groupBy("sequence_id").agg(F.min(entry).alias("top"), F.sort_array(F.collect_list(F.struct("source", "n_tokens"))).alias("m"))
    shares = F.array_join(F.transform("m", lambda x: F.concat_ws("=", x.source, x.n_tokens.cast("string"))), ",")
    name = F.coalesce(F.nullif(F.col("top.name"), F.lit("")), F.lit("<empty>"))
    label = F.when(F.size("m") > 1, F.concat(name, F.lit(" [mix: "), shares, F.lit("]"))).otherwise(name)
    return rows.select("sequence_id", label.alias("label"), name.alias("dominant"))


def incident_sequences(incidents: DataFrame, length: int, legacy: bool = False, rows: int | None = None) -> DataFrame:
    """``incidents`` (…, data_position) with the sequence_id that each came from; those without a position go.

    The cursor counts ``length`` - 1 places a sequence; ``legacy`` divides by
    ``length`` instead. As it is logged after its batch, ``rows`` gives every
    sequence of that batch, a row each.
    """
    known = incidents.where("data_position IS NOT NULL")
    at = F.floor(F.col("data_position") / (length if legacy else length - 1))
    if rows is None:
        return known.withColumn("sequence_id", at)
    spread = known.withColumn("sequence_id", F.explode(F.sequence(at - rows, at - 1)))
    return spread.where("sequence_id >= 0")


def attribute(placed: DataFrame, labels: DataFrame) -> DataFrame:
    """``placed`` (…, sequence_id) with label and dominant of ``labels``, ``<unmapped>`` for sequences that aren't there."""
    out = placed.join(labels, "sequence_id", "left")
    return out.withColumn("label", F.coalesce("label", F.lit("<unmapped>"))).withColumn("dominant", F.coalesce("dominant", F.lit("<unmapped>")))


def segment_histogram(rows: DataFrame, by: str = "sequence_id") -> DataFrame:
    """(sequence_id, segment, n): how many places each segment of a row has."""
    return rows.select(by, F.explode("segments").alias("segment")).groupBy(by, "segment").agg(F.count(F.lit(1)).alias("n"))


def token_preview(tokens: Column, n: int) -> Column:
    """The first and the last ``n`` ids; no last ones where there are no more than ``n``."""
    tail = F.when(F.size(tokens) > n, F.slice(tokens, F.size(tokens) - n + 1, n)).otherwise(F.slice(tokens, 1, 0))
    return F.struct(F.slice(tokens, 1, n).alias("head"), tail.alias("tail"))
