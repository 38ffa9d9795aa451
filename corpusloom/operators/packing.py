"""Fixed-length packing with provenance, from prefix sums of token counts.

A document of n tokens takes n + 1 places of its source's token stream, its
end token included. Sequence s of a source holds places [s * L, (s + 1) * L),
so spans follow from the running totals alone and no row waits for another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.ranges import cut_points, range_of
from corpusloom.sources.scratch import Scratch

BOS, EOS, PAD, UNK = 0, 1, 2, 3


def word_tokens(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with tokens: an id for each word; documents without words have none."""
    return docs.withColumn("tokens", F.transform(T.words(F.col(text_col)), lambda w: T.word_id(w)))


def running_start(rows: DataFrame, group: str, key: str, size: Column) -> DataFrame:
    """``rows`` with ``start``: the sum of ``size`` over the rows of the group before it, by the numeric ``key``.

    Rows are cut into key ranges, as many as shuffle partitions, so a large
    group is summed by many tasks; only the ranges' totals are summed in one
    window per group. ``rows`` is read three times, so it should be a table.
    """
    cuts = cut_points(rows, key, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.withColumn("__part", range_of(F.col(key), cuts)).withColumn("__size", size)
    totals = rows.groupBy(group, "__part").agg(F.sum("__size").alias("__sum"))
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("__offset", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum")
    inner = Window.partitionBy(group, "__part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("__in", F.coalesce(F.sum("__size").over(inner), F.lit(0))).join(offsets, [group, "__part"])
    return out.withColumn("start", (F.col("__offset") + F.col("__in")).cast("long")).drop("__part", "__size", "__in", "__offset")


def pack_spans(docs: DataFrame, length: int, drop_last: bool = True, group: str = "source", key: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """(source, seq, doc_id, token_start, token_end, from_token, …) of ``docs`` (source, doc_id, n_tokens): [start, end) in each sequence.

    Documents of no tokens are left out; rows that repeat an id are documents
    of their own. With ``drop_last`` the places after the last full sequence
    go, else that sequence is kept and padded; padding is in no span. The
    rows, with the columns ``carry``, are written once and placed from there.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    full = scratch.save(docs.where("n_tokens > 0").select(group, key, "n_tokens", *carry))
    placed = running_start(full, group, key, F.col("n_tokens") + 1).withColumn("end", F.col("start") + F.col("n_tokens") + 1)
    if drop_last:
        totals = scratch.save(full.groupBy(group).agg((F.floor(F.sum(F.col("n_tokens") + 1) / length) * length).alias("__full")))  # one row for each source
        placed = placed.join(totals, group).withColumn("end", F.least("end", "__full")).where("start < end").drop("__full")
    spans = placed.withColumn("seq", F.explode(F.sequence(F.floor(F.col("start") / length), F.floor((F.col("end") - 1) / length))))
    base = F.col("seq") * length
    return spans.select(
        group,
        "seq",
        key,
        (F.greatest("start", base) - base).cast("int").alias("token_start"),
        (F.least("end", base + length) - base).cast("int").alias("token_end"),
        (F.greatest("start", base) - F.col("start")).cast("int").alias("from_token"),
        *carry,
    )


def pack_sequences(docs: DataFrame, length: int, drop_last: bool = True, group: str = "source", key: str = "doc_id") -> DataFrame:
    """(source, seq, tokens) of ``docs`` (source, doc_id, tokens): spans' slices put in order; a sequence is one row."""
    sized = docs.withColumn("n_tokens", F.size("tokens"))
    spans = pack_spans(sized, length, drop_last, group, key, ("tokens",))
    n = F.col("token_end") - F.col("token_start")
    # The end token stands behind the last token; a slice stops at the array's end without it.
    part = F.slice("tokens", F.col("from_token") + 1, n)
    part = F.concat(part, F.array_repeat(F.lit(EOS), n - F.size(part)))
    rows = spans.select(group, "seq", F.struct("token_start", part.alias("part")).alias("p")).groupBy(group, "seq").agg(F.sort_array(F.collect_list("p")).alias("parts"))
    joined = F.flatten(F.transform("parts", lambda p: p.part))
    padded = F.concat(joined, F.array_repeat(F.lit(PAD), F.lit(length) - F.size(joined)))
    return rows.select(group, "seq", padded.alias("tokens"))


def number_sequences(spans: DataFrame, group: str = "source") -> DataFrame:
    """``spans`` (a table) with a corpus-wide sequence_id: sources in order, each with its own count of sequences before."""
    counts = spans.groupBy(group).agg((F.max("seq") + 1).alias("__n"))
    before = Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)  # one row for each source
    offsets = counts.withColumn("__off", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    offsets = Scratch(spans.sparkSession, "offsets").save(offsets)
    return spans.join(offsets, group).withColumn("sequence_id", (F.col("__off") + F.col("seq")).cast("long")).drop("__off")


def number_spans(spans: DataFrame) -> DataFrame:
    """``spans`` (a table with sequence_id) with doc_span_id, from 0 without gaps by sequence and start."""
    counts = spans.groupBy("sequence_id").agg(F.count(F.lit(1)).alias("__n")).withColumn("__all", F.lit(0))
    counts = Scratch(spans.sparkSession, "spans").save(counts)
    first = running_start(counts, "__all", "sequence_id", F.col("__n")).select("sequence_id", F.col("start").alias("__first"))
    inside = F.row_number().over(Window.partitionBy("sequence_id").orderBy("token_start")) - 1
    out = spans.join(first, "sequence_id").withColumn("doc_span_id", (F.col("__first") + inside).cast("long"))
    return out.drop("__first")


def document_numbers(docs: DataFrame, group: str = "source", key: str = "doc_id") -> DataFrame:
    """(source, doc_id, document): the number of each document in the order of packing, from 0, over all sources."""
    scratch = Scratch(docs.sparkSession, "documents")
    full = scratch.save(docs.where("n_tokens > 0").select(group, key))
    counts = full.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)  # one row for each source
    offsets = scratch.save(counts.withColumn("__off", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n"))
    placed = running_start(full, group, key, F.lit(1)).join(offsets, group)
    return placed.select(group, key, (F.col("start") + F.col("__off")).cast("long").alias("document"))


def first_kept(docs: DataFrame, limit: int, group: str = "source", key: str = "doc_id") -> DataFrame:
    """The first ``limit`` rows of each group of ``docs`` (kept documents, a table) by ``key``."""
    return running_start(docs, group, key, F.lit(1)).where(F.col("start") < limit).drop("start")


def per_place(spans: DataFrame, length: int, value: Column | None, name: str, by: str | list[str] = "sequence_id") -> DataFrame:
    """(sequence_id, name): for each place ``value`` of the span that covers it, or its number in the sequence; -1 where none does."""
    what = F.coalesce(value, F.lit(-1)).cast("long") if value is not None else F.lit(0).cast("long")
    by = [by] if isinstance(by, str) else by
    rows = spans.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("token_start", "token_end", what.alias("v")))).alias("s"))

    def run(x: Column, i: Column) -> Column:
        gap = x.token_start - F.coalesce(F.get("s", i - 1).token_end, F.lit(0))
        return F.concat(F.array_repeat(F.lit(-1).cast("long"), gap), F.array_repeat(x.v if value is not None else i.cast("long"), x.token_end - x.token_start))

    runs = F.flatten(F.transform("s", run))
    return rows.select(*by, F.concat(runs, F.array_repeat(F.lit(-1).cast("long"), F.lit(length) - F.size(runs))).alias(name))


def segment_ids(spans: DataFrame, length: int, by: str | list[str] = "sequence_id") -> DataFrame:
    """(sequence_id, segments): for each place the number of its span in the sequence, -1 where none covers it."""
    return per_place(spans, length, None, "segments", by)


def input_label_pairs(sequences: DataFrame) -> DataFrame:
    """Inputs, labels and loss mask of ``sequences`` (…, tokens, segments): a label counts inside one segment only."""
    n = F.size("tokens")
    mask = F.zip_with(
        F.slice("segments", F.lit(1), n - 1),
        F.slice("segments", F.lit(2), n - 1),
        lambda a, b: F.when((a == b) & (b != -1), 1).otherwise(0),
    )
    return sequences.withColumn("inputs", F.slice("tokens", F.lit(1), n - 1)).withColumn("labels", F.slice("tokens", F.lit(2), n - 1)).withColumn("loss_mask", mask)


def source_mix(spans: DataFrame, by: str = "sequence_id", source: str = "source") -> DataFrame:
    """(sequence_id, source, n_tokens): covered places of each source."""
    return spans.groupBy(by, source).agg(F.sum(F.col("token_end") - F.col("token_start")).alias("n_tokens"))


def epochs(sequences: DataFrame, start: int, times: int | None, by: str = "sequence_id", steps: int | None = None) -> DataFrame:
    """``sequences`` in the order of reading from ``start``: one epoch stops at the end, more go around ``times`` in full.

    ``times`` None goes around without end, so then ``steps`` says how many are read.
    """
    if start < 0 or (times is not None and times < 1) or (times is None and (steps is None or steps < 0)):
        raise ValueError("at least one epoch, or a number of steps, from an id of 0 or more")
    if times is None:
        total = sequences.agg(F.max(by)).first()[0]
        laps = -(-steps // (total + 1)) if total is not None else 1
        return epochs(sequences, start, max(2, laps), by).where(F.col("position") < steps)
    if times == 1:
        return sequences.where(F.col(by) >= start).withColumn("position", F.col(by) - start)
    total = sequences.agg(F.max(by)).first()[0]
    total = 0 if total is None else total + 1
    shift = F.when(F.col(by) >= start, F.col(by) - start).otherwise(F.col(by) - start + total)
    laps = F.explode(F.sequence(F.lit(0), F.lit(times - 1)))
    return sequences.withColumn("__lap", laps).withColumn("position", shift + F.col("__lap") * total).drop("__lap")


def batches(sequences: DataFrame, size: int, by: str = "sequence_id") -> DataFrame:
    """(batch, first, last) of consecutive full batches; a short tail is dropped. Ids run from 0 without gaps."""
    rows = sequences.groupBy(F.floor(F.col(by) / size).alias("batch")).agg(
        F.min(by).alias("first_id"), F.max(by).alias("last_id"), F.count(F.lit(1)).alias("__n")
    )
    return rows.where(F.col("__n") == size).drop("__n")


def seek(ids: DataFrame, length: int, per_shard: int, width: int = 4, by: str = "sequence_id") -> DataFrame:
    """``ids`` with the shard, the place in it, and the token and byte offsets there; a negative id is an error when rows are read."""
    if length < 1 or per_shard < 1:
        raise ValueError("a sequence has a token and a shard a sequence at least")
    i = F.when(F.col(by) >= 0, F.col(by)).otherwise(F.raise_error(F.lit("a negative sequence id")).cast("long"))
    local = i % per_shard
    return ids.select(
        by, F.floor(i / per_shard).alias("shard_id"), local.alias("local_id"), (local * length).alias("token_offset"), (local * (length * width)).alias("byte_offset")
    )


def cursor_of(position: Column, length: int) -> Column:
    """The sequence that holds a position of the label stream, which has ``length`` - 1 places a sequence."""
    return F.floor(position / (length - 1))
