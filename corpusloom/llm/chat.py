"""Chat formatting with Spark expressions only.

A conversation becomes one string of blocks::

    <|user|>first text<+>second text</turn>
    <|assistant|>reply</turn>

Adjacent turns of one role share a block, their texts parted by ``<+>``.
Inside roles and texts a backslash is written ``\\s`` and ``<`` is written
``\\l``, so markers are the only ``<`` in the output and unescaping restores
every text. The loss mask lists the span of each assistant text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import let

#: Fixed strings of the template.
OPEN, MIDDLE, PART, CLOSE = "<|", "|>", "<+>", "</turn>\n"

#: Turns that are added up, or read back, at a time: the cost of a turn doesn't grow with its conversation.
_CHUNK = 64


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l")), F.lit("|>"), F.lit("\\p"))


def unescape(text: Column) -> Column:
    """Undo :func:`escape`: every backslash there starts a code of two characters."""
    return F.replace(F.replace(F.replace(text, F.lit("\\p"), F.lit("|>")), F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """``turns`` (conv_id, turn, role, text) to (conv_id, formatted, loss_spans).

    Turns sort by turn, then role and text; a null turn comes first, a null
    role or text counts as empty, and rows that repeat a turn are turns of
    their own. Rows of a null conv_id form one conversation. ``loss_spans``
    holds (start, length) of each text of ``loss_role`` in ``formatted``, in
    code points from 0. Other columns are not read. A conversation is one
    output row, so its turns meet in one task; the sort is inside the row. An
    empty table gives no rows.
    """
    rows = turns.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    conv = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))

    def part(t: Column, i: Column) -> Column:
        """A turn joins the block before it if that has its role, and ends its block if the next one has another."""
        joins = F.coalesce(F.get("ts", i - 1).role == t.role, F.lit(False))
        ends = F.coalesce(F.get("ts", i + 1).role != t.role, F.lit(True))
        return F.struct(
            F.when(joins, F.lit(PART)).otherwise(F.concat(F.lit(OPEN), escape(t.role), F.lit(MIDDLE))).alias("head"),
            escape(t.text).alias("body"),
            F.when(ends, F.lit(CLOSE)).otherwise(F.lit("")).alias("tail"),
            (t.role == loss_role).alias("loss"),
        )

    parts = conv.select("conv_id", F.transform("ts", part).alias("parts"))
    sized = parts.select(
        "conv_id",
        F.array_join(F.transform("parts", lambda p: F.concat(p.head, p.body, p.tail)), "").alias("formatted"),
        F.transform(
            "parts",
            lambda p: F.struct(
                F.length(p.head).alias("before"), F.length(p.body).alias("n"), F.length(p.tail).alias("after"), p.loss.alias("loss")
            ),
        ).alias("sizes"),
    )
    return sized.select("conv_id", "formatted", _placed(F.col("sizes")).alias("loss_spans"))


def _placed(sizes: Column) -> Column:
    """(start, length) of the parts under the loss: running sums within chunks, from where each chunk starts."""
    whole = lambda at, p: at + p.before + p.n + p.after
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / _CHUNK).cast("int")), lambda k: F.slice(sizes, k * _CHUNK + 1, _CHUNK))
    starts = F.aggregate(
        F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), whole)),
        F.expr("struct(0 AS at, CAST(array() AS array<int>) AS starts)"),
        lambda acc, n: F.struct((acc.at + n).alias("at"), F.concat(acc.starts, F.array(acc.at)).alias("starts")),
        lambda acc: acc.starts,
    )

    def spans(chunk: Column, start: Column) -> Column:
        return F.aggregate(
            chunk,
            F.struct(start.alias("at"), F.expr("CAST(array() AS array<struct<start:int,length:int>>)").alias("spans")),
            lambda acc, p: F.struct(
                whole(acc.at, p).alias("at"),
                F.when(p.loss, F.concat(acc.spans, F.array(F.struct((acc.at + p.before).alias("start"), p.n.alias("length")))))
                .otherwise(acc.spans)
                .alias("spans"),
            ),
            lambda acc: acc.spans,
        )

    return let(chunks, lambda c: F.flatten(F.zip_with(c, starts, spans)))


def parse_formatted(formatted: Column) -> Column:
    """The turns of a formatted conversation, as an array of (role, text) structs, in order."""
    blocks = F.filter(F.split(formatted, "</turn>\n"), lambda b: b != "")
    return F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.substring_index(b, MIDDLE, -1), r"<\+>"),
                lambda x: F.struct(
                    unescape(F.substring(F.substring_index(b, MIDDLE, 1), 3, 1 << 30)).alias("role"), unescape(x).alias("text")
                ),
            ),
        )
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between.

    Spans are cut from the stretch of text that their chunk covers, as every
    cut counts code points from the front of what it is cut from.
    """

    def cut(part: Column) -> Column:
        first, last = F.get(part, F.lit(0)), F.try_element_at(part, F.lit(-1))
        stretch = F.struct(
            first.start.alias("from"), F.substring(formatted, first.start + 1, last.start + last.length - first.start).alias("text"), part.alias("spans")
        )
        pieces = lambda x: F.array_join(F.transform(x.spans, lambda s: unescape(F.substring(x.text, s.start - x["from"] + 1, s.length))), "")
        return let(stretch, pieces)

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / _CHUNK).cast("int")), lambda k: F.slice(spans, k * _CHUNK + 1, _CHUNK))
    return F.when(F.size(spans) == 0, F.lit("")).otherwise(F.array_join(F.transform(chunks, cut), ""))
