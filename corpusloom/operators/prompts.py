"""Benchmark rows as prompts: a projection for each benchmark, and whole few-shot prompts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The index takes this much of a prompt: enough n-grams to know it by.
LONGEST = 8000


def _choice(rows: DataFrame) -> Column:
    question = F.trim(F.coalesce("question", F.lit("")))
    options = F.coalesce("options", F.array().cast("array<string>"))
    return F.when(question != "", F.when(F.size(options) > 0, F.concat_ws(" ", question, F.array_join(options, " "))).otherwise(question))


def _field(*names: str) -> Callable[[DataFrame], Column]:
    """The first of the columns that says something."""
    return lambda rows: F.coalesce(*(F.nullif(F.col(n), F.lit("")) for n in names if n in rows.columns))


@dataclass(frozen=True)
class Loader:
    """``text`` makes the prompt of a row; ``config`` names the column that a sample size counts within; ``split`` is read by default."""

    text: Callable[[DataFrame], Column]
    split: str = "test"
    config: str | None = None


LOADERS: dict[str, Loader] = {
    "mmlu-pro": Loader(_choice),
    "humaneval-plus": Loader(_field("prompt")),
    "mbpp-plus": Loader(_field("prompt", "text")),
    "gsm8k": Loader(_field("question")),
    "math": Loader(_field("problem")),
    "mgsm": Loader(_field("question"), config="config"),
    "bbh": Loader(_field("input"), "train", "config"),
    "ifeval": Loader(_field("prompt"), "train"),
}


def loader(benchmark: str) -> Loader:
    if benchmark not in LOADERS:
        raise ValueError(f"no benchmark {benchmark}; there are {', '.join(sorted(LOADERS))}")
    return LOADERS[benchmark]


def load_prompts(benchmark: str, rows: DataFrame, sample: int | None = None, order: str = "id", split: str | None = None) -> DataFrame:
    """(benchmark_id, id, prompt) of ``rows``: the benchmark's projection, cut to ``LONGEST`` characters; blank prompts go.

    With a column ``split`` only the rows of ``split`` are read, by default the
    benchmark's own. ``sample`` keeps the first prompts by ``order``, of each
    config where the benchmark has several.
    """
    how = loader(benchmark)
    if "split" in rows.columns:
        rows = rows.where(F.col("split") == (split or how.split))
    out = rows.withColumn("prompt", F.substring(how.text(rows), 1, LONGEST)).where(F.trim("prompt") != "")
    if sample is not None and how.config:
        rank = F.row_number().over(Window.partitionBy(how.config).orderBy(order))
        out = out.withColumn("__r", rank).where(F.col("__r") <= sample)
    elif sample is not None:
        out = out.orderBy(order).limit(sample)
    return out.select(F.lit(benchmark).alias("benchmark_id"), F.col(order).alias("id"), "prompt")
