"""Scorecards, canary roll-ups, consistency of configurations, source matching and their text forms."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import evals

SCORE = "benchmark string, accuracy double, n long, error string, subgroups map<string,double>"


@dataclass(frozen=True)
class Benchmark:
    """``load`` gives the examples, ``score`` and ``subgroup`` are columns of them with the column prediction."""

    name: str
    load: Callable[[SparkSession], DataFrame]
    score: Callable[[DataFrame], Column]
    subgroup: Callable[[DataFrame], Column] = lambda df: F.lit("all")


def run_benchmark(spark: SparkSession, benchmark: Benchmark, predict: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(bench, subgroup, n, n_correct, accuracy): ``predict`` adds prediction to the examples."""
    rows = predict(benchmark.load(spark))
    scored = rows.select(F.lit(benchmark.name).alias("bench"), benchmark.subgroup(rows).alias("subgroup"), benchmark.score(rows).alias("correct"))
    return evals.accuracy(scored)


def scorecard(spark: SparkSession, benchmarks: list[Benchmark], predict: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A row of ``SCORE`` for each benchmark: one that fails has no accuracy, n 0 and its error, and the others still run."""
    out = []
    for b in benchmarks:
        try:
            got = run_benchmark(spark, b, predict).collect()  # a row for each subgroup
            whole = next((r for r in got if r.subgroup is None), None)
            parts = {r.subgroup: float(r.accuracy) for r in got if r.subgroup is not None}
            out.append((b.name, float(whole.accuracy) if whole else 0.0, int(whole.n) if whole else 0, None, parts))
        except Exception as e:
            out.append((b.name, None, 0, str(e).strip()[:300], {}))
    return spark.createDataFrame(out, SCORE)


def scorecard_lines(scores: DataFrame) -> DataFrame:
    """(benchmark, line): the table lines of a scorecard in Markdown."""
    share = lambda x, d: F.concat(F.format_string(f"%.{d}f", x * 100), F.lit("%"))
    parts = F.transform(F.array_sort(F.map_entries("subgroups")), lambda e: F.concat(e.key, F.lit("="), share(e.value, 1)))
    note = F.when(F.col("error").isNotNull(), F.concat(F.lit("FAILED: "), F.substring("error", 1, 80))).otherwise(F.coalesce(F.array_join(parts, "  "), F.lit("")))
    accuracy = F.when(F.col("error").isNull() & F.col("accuracy").isNotNull(), share(F.col("accuracy"), 2)).otherwise("—")
    return scores.select("benchmark", F.concat_ws(" | ", F.concat(F.lit("| "), "benchmark"), accuracy, F.col("n").cast("string"), F.concat(note, F.lit(" |"))).alias("line"))


def scorecard_markdown(scores: DataFrame, model: str, notes: str = "") -> str:
    """The scorecard as Markdown; it is a row for each benchmark, in their order of name."""
    lines = [r.line for r in scorecard_lines(scores).orderBy("benchmark").collect()]
    head = [f"# Scorecard: {model}", "", "| Benchmark | Accuracy | N | Notes |", "|---|---|---|---|"]
    return "\n".join([*head, *lines, *(["", notes] if notes else [])]) + "\n"


def scorecard_json(scores: DataFrame) -> str:
    return json.dumps([r.asDict(True) for r in scores.orderBy("benchmark").collect()], indent=1, sort_keys=True)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """Write a small file to any store: beside it first, then renamed into place."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    to = jvm.org.apache.hadoop.fs.Path(path)
    part = jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    fs = to.getFileSystem(conf)
    out = fs.create(part, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    fs.delete(to, False)
    if not fs.rename(part, to):
        raise OSError(f"{path} could not be renamed into place")


def write_scorecard(spark: SparkSession, scores: DataFrame, model: str, path: str) -> None:
    """``path``.json and ``path``.md."""
    write_text(spark, scorecard_json(scores), f"{path}.json")
    write_text(spark, scorecard_markdown(scores, model), f"{path}.md")


def config_issues(configs: DataFrame) -> DataFrame:
    """(name, passed, issues) of model configurations: required numbers, then the arithmetic between them."""
    required = ["layers", "hidden_dim", "ffn_dim", "num_heads", "vocab_size", "context_length"]
    col = lambda c: F.col(c) if c in configs.columns else F.lit(None)
    hidden, heads, ffn = col("hidden_dim"), col("num_heads"), col("ffn_dim")
    kv = F.coalesce(col("num_kv_heads"), heads)
    head_dim = F.coalesce(col("head_dim"), F.floor(hidden / F.nullif(heads, F.lit(0))))
    rope = F.coalesce(col("rope_base").cast("double"), F.lit(10_000.0))
    ratio = ffn / F.nullif(hidden, F.lit(0))
    mod = lambda a, b: F.coalesce(a % F.nullif(b, F.lit(0)), F.lit(1))
    tests = [
        (mod(hidden, heads) != 0, "hidden_dim is not divisible by num_heads"),
        (mod(heads, kv) != 0, "num_heads is not divisible by num_kv_heads"),
        (head_dim * heads != hidden, "head_dim times num_heads is not hidden_dim"),
        (rope <= 0, "rope_base must be above 0"),
        (col("context_length") < 64, "context_length is below 64"),
        ((ratio < 1.5) | (ratio > 8), "ffn ratio is outside 1.5 to 8"),
    ]
    missing = F.concat_ws("; ", *(F.when(col(c).isNull(), F.lit(f"missing {c}")) for c in required))
    found = F.when(missing != "", missing).otherwise(F.concat_ws("; ", *(F.when(t, F.lit(m)) for t, m in tests)))
    return configs.select("name", (found == "").alias("passed"), found.alias("issues"))


def stage_rollup(checks: DataFrame) -> DataFrame:
    """(stage, n_passed, n, passed) of ``checks`` (stage, passed); the null stage is the whole run, which passes if every check does."""
    sums = [F.count_if("passed").alias("n_passed"), F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed")]
    whole = checks.agg(*sums).select(F.lit(None).cast("string").alias("stage"), "n_passed", "n", "passed")
    return checks.groupBy("stage").agg(*sums).unionByName(whole)


def build_summary(builds: DataFrame) -> DataFrame:
    """(n_pass, n_fail, wall_s) of parallel ``builds`` (source, ok, started, ended)."""
    return builds.agg(F.count_if("ok").alias("n_pass"), F.count_if(~F.col("ok")).alias("n_fail"), (F.max("ended") - F.min("started")).alias("wall_s"))


def short_name(dataset: Column) -> Column:
    """What follows the last slash, lower-cased, with hyphens and dots as underscores."""
    return F.translate(F.lower(F.substring_index(dataset, "/", -1)), "-.", "__")


def match_sources(wanted: DataFrame, entries: DataFrame) -> DataFrame:
    """(source_id, place, dataset): for each of ``wanted`` (source_id) the first of ``entries`` (place, dataset, source_id) that it names.

    It may name the dataset, the entry's source_id, or the dataset's short
    name. One that names none has nulls.
    """
    w = wanted.select("source_id").distinct()
    forms = [
        entries.select(F.col("dataset").alias("k"), F.lit("exact").alias("form"), "place", "dataset"),
        entries.where("source_id IS NOT NULL").select(F.col("source_id").alias("k"), F.lit("exact").alias("form"), "place", "dataset"),
        entries.select(short_name(F.col("dataset")).alias("k"), F.lit("short").alias("form"), "place", "dataset"),
    ]
    keys = forms[0].unionByName(forms[1]).unionByName(forms[2])
    named = F.array(
        F.struct(F.col("source_id").alias("k"), F.lit("exact").alias("form")),
        F.struct(F.translate(F.lower("source_id"), "-.", "__").alias("k"), F.lit("short").alias("form")),
    )
    found = w.select("source_id", F.inline(named)).join(keys, ["k", "form"]).groupBy("source_id").agg(F.min(F.struct("place", "dataset")).alias("m"))
    return w.join(found, "source_id", "left").select("source_id", "m.place", "m.dataset")


def resolve_config(wanted: DataFrame, present: DataFrame, strict: bool = False) -> DataFrame:
    """(source, share) of ``wanted`` (source, share) that are ``present`` (source), scaled to 1; with ``strict`` a missing one is an error."""
    here = present.select("source").distinct().withColumn("__here", F.lit(True))
    rows = wanted.join(here, "source", "left")
    if strict:
        gone = [r.source for r in rows.where("__here IS NULL").select("source").collect()]  # sources are few
        if gone:
            raise ValueError(f"no corpus of {', '.join(sorted(gone))}")
    kept = rows.where("__here").drop("__here")
    total = kept.agg(F.sum("share")).first()[0] or 0
    if total <= 0:
        raise ValueError("no share is left")
    return kept.withColumn("share", F.col("share") / F.lit(float(total)))


def source_table(sources: DataFrame, licenses: DataFrame, default: str = "see register") -> DataFrame:
    """``sources`` (dataset, …) with the license and notes of ``licenses`` (dataset, license, notes), or ``default`` and nothing."""
    out = sources.join(F.broadcast(licenses), "dataset", "left")  # a register: a row for each dataset
    return out.withColumn("license", F.coalesce("license", F.lit(default))).withColumn("notes", F.coalesce("notes", F.lit("")))


def source_budgets(shares: DataFrame, total: int) -> DataFrame:
    """``shares`` (source, share) with tokens: the whole part of its share of ``total``."""
    return shares.withColumn("tokens", F.floor(F.lit(total) * F.col("share")))


def unique_source_ids(datasets: DataFrame) -> DataFrame:
    """(dataset, config, split, unique_id) of ``datasets``: the short name with config and split; an id that two rows share is an error."""
    parts = [F.col(c) for c in ("config", "split")]
    clean = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    out = datasets.select("dataset", "config", "split", F.concat_ws("_", clean(F.substring_index("dataset", "/", -1)), *(clean(c) for c in parts)).alias("unique_id"))
    twice = [r.unique_id for r in out.groupBy("unique_id").count().where("count > 1").collect()]  # sources are few
    if twice:
        raise ValueError(f"source ids that several sources share: {', '.join(sorted(twice))}")
    return out


def smoke(spark: SparkSession, sources: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """(source, n, mean_chars, passed, error): a few sums of each source's texts; one without rows, or that can't be read, fails and the others still run."""
    out = []
    for name, load in sources.items():
        try:
            n, chars = load().agg(F.count(F.lit(1)), F.sum(F.length("text"))).first()
            out.append((name, n, (chars or 0) // n if n else 0, n > 0, None if n else "no rows"))
        except Exception as e:
            out.append((name, 0, 0, False, str(e).strip()[:300]))
    return spark.createDataFrame(out, "source string, n long, mean_chars long, passed boolean, error string")
