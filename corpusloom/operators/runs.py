"""Analytics of training runs: losses, incidents, costs, schedules, sweeps and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.packing import running_start
from corpusloom.sources.scratch import Scratch


def loss_watchdog(losses: DataFrame, key: str = "step", by: str | None = None, window: int = 200, least: int = 50, soft: float = 3.0, hard: float = 6.0) -> DataFrame:
    """``losses`` (…, step, loss) with verdict ok, soft or hard against the finite losses before it.

    A loss that isn't finite is hard and doesn't count for later ones; with
    under ``least`` losses before it, or no spread, a loss is ok.
    """
    parts = [by] if by else []
    finite = F.col("loss").isNotNull() & ~F.isnan("loss") & (F.abs("loss") != float("inf"))
    w = Window.partitionBy(*parts).orderBy(key).rowsBetween(-window, -1)
    good = (
        losses.where(finite)
        .withColumn("__n", F.count("loss").over(w))
        .withColumn("__mean", F.avg("loss").over(w))
        .withColumn("__std", F.stddev_pop("loss").over(w))
    )
    z = (F.col("loss") - F.col("__mean")) / F.col("__std")
    verdict = F.when((F.col("__n") < least) | (F.col("__std") <= 0), "ok").when(z >= hard, "hard").when(z >= soft, "soft").otherwise("ok")
    judged = good.withColumn("verdict", verdict).drop("__n", "__mean", "__std")
    return judged.unionByName(losses.where(~finite).withColumn("verdict", F.lit("hard")))


def clusters(events: DataFrame, gap: int = 100, least: int = 2, key: str = "step", by: str | None = None) -> DataFrame:
    """Runs of events at most ``gap`` steps apart, of ``least`` events or more."""
    parts = [by] if by else []
    w = Window.partitionBy(*parts).orderBy(key)
    fresh = F.when(F.col(key) - F.lag(key).over(w) <= gap, 0).otherwise(1)
    numbered = events.withColumn("__new", fresh).withColumn("cluster", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = numbered.groupBy(*parts, "cluster").agg(F.min(key).alias("first_step"), F.max(key).alias("last_step"), F.count(F.lit(1)).alias("n"))
    return out.where(F.col("n") >= least).drop("cluster")


def incident_summary(events: DataFrame, key: str = "step") -> DataFrame:
    """(reason, n, first_step, last_step, per_1000): the rate over the span of all events."""
    span = events.agg(F.greatest(F.lit(1), F.max(key) - F.min(key)).alias("span"))  # one row
    out = events.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_step"), F.max(key).alias("last_step"))
    return out.crossJoin(F.broadcast(span)).withColumn("per_1000", F.col("n") / F.col("span") * 1000).drop("span")


def dominant(mix: DataFrame, by: str, source: str = "source", size: str = "n_tokens") -> DataFrame:
    """The source with the most of each group, the first name among equals."""
    return mix.groupBy(by).agg(F.min(F.struct((-F.col(size)).alias("s"), F.col(source).alias("name"))).alias("m")).select(by, F.col("m.name").alias("dominant"))


def hourly_cost(rate: Column, pods: Column) -> Column:
    return rate * pods


def charge(rate: Column, seconds: Column) -> Column:
    """What ``seconds`` cost at an hourly rate."""
    return rate * seconds / 3600


def ledger(charges: DataFrame, ceiling: float, by: str, order: list[str], warn: float = 0.8) -> DataFrame:
    """Running totals of ``charges`` (…, delta_usd) with near_ceiling and blocked.

    Charges are counted in whole 1e-9 dollars and summed as decimals, so a
    total is exact in any order of adding and a tie of a later rounding, or a
    total right at a limit, is not up to an error. Rows that tie in ``order``
    have the total after all of them, as in SQL.
    """
    w = Window.partitionBy(by).orderBy(*order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    out = charges.withColumn("total_usd", F.sum(F.col("delta_usd").cast("decimal(28,9)")).over(w).cast("double"))
    return out.withColumn("remaining_usd", ceiling - F.col("total_usd")).withColumn("near_ceiling", F.col("total_usd") >= warn * ceiling).withColumn("blocked", F.col("total_usd") >= ceiling)


def nearest_rank(rows: DataFrame, value: str, by: str, points: list[float]) -> DataFrame:
    """(by, q, value) with the value at place int(n * q) of the sorted values, counted from 0.

    Values are placed by ranges, so no group is sorted in one task.
    """
    scratch = Scratch(rows.sparkSession, "ranks")
    table = scratch.save(rows.where(F.col(value).isNotNull()).select(by, value))
    sizes = scratch.save(table.groupBy(by).agg(F.count(F.lit(1)).alias("__n")))
    wanted = sizes.withColumn("q", F.explode(F.array(*(F.lit(p) for p in points)))).withColumn("start", F.least(F.floor(F.col("__n") * F.col("q")), F.col("__n") - 1))
    return running_start(table, by, value, F.lit(1)).join(F.broadcast(wanted), [by, "start"]).select(by, "q", value)  # a row for each group and point


def iso_seconds(text: Column) -> Column:
    """Seconds since 1970 of an ISO 8601 time, in UTC where it names no zone; null if it is none."""
    shape = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$"
    zoned = F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & text.contains(":"), text).otherwise(F.concat(text, F.lit("Z")))
    full = F.when(F.length(text) == 10, F.concat(text, F.lit("T00:00:00Z"))).otherwise(zoned)
    return F.when(text.rlike(shape), F.unix_micros(F.try_to_timestamp(full)) / F.lit(1e6))


def incident_rate_high(summary: DataFrame, most: float = 5.0) -> DataFrame:
    """``summary`` (…, per_1000) with warn: more than ``most`` in 1,000 steps."""
    return summary.withColumn("warn", F.col("per_1000") > most)


def monitor_total(events: DataFrame) -> DataFrame:
    """(n_sources, tokens, runtime_s, tok_per_s) over all of ``events`` (source, ts, tokens): the rate from the first start to the last sight."""
    us = F.unix_micros(F.max(F.col("ts").cast("timestamp"))) - F.unix_micros(F.min(F.col("ts").cast("timestamp")))
    out = events.agg(F.countDistinct("source").alias("n_sources"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("tokens"), (us / 1e6).alias("runtime_s"))
    return out.withColumn("tok_per_s", F.when(F.col("runtime_s") > 0, F.col("tokens") / F.col("runtime_s")).otherwise(0.0))


def latest_to_merge(checkpoints: DataFrame, n: int) -> DataFrame:
    """The last ``n`` complete checkpoints (step, complete, merged) that aren't merged ones themselves."""
    return checkpoints.where("complete AND NOT merged").orderBy(F.col("step").desc()).limit(n)


def resume_position(state: dict, strict: bool = False) -> int:
    """The data position of a saved state; one without it starts at 0, or is an error if ``strict``."""
    if "data_position" not in state and strict:
        raise KeyError("the state has no data_position")
    return int(state.get("data_position", 0))


def micro_batch(command: Column, model: Column, data: Column) -> Column:
    """The micro-batch that counts: the command's, the model's, the data's, else 8."""
    return F.coalesce(command, model, data, F.lit(8))


def retention(checkpoints: DataFrame, keep_last: int, every: int, key: str = "step", by: str | None = None) -> DataFrame:
    """Complete checkpoints with ``kept`` (the last few of each ``by``, and each k-th step) and ``is_latest``; a run has few."""
    w = Window.partitionBy(*([by] if by else [])).orderBy(F.col(key).desc())
    r = F.row_number().over(w)
    return checkpoints.where("complete").withColumn("__r", r).withColumn("kept", (F.col("__r") <= keep_last) | (F.col(key) % every == 0)).withColumn("is_latest", F.col("__r") == 1).drop("__r")


def cosine_rate(step: Column, peak: float, warmup: int, total: int, end: float = 0.1) -> Column:
    """Linear warm-up, then a cosine to ``end`` of the peak."""
    if peak <= 0 or warmup < 0 or total <= warmup or not 0 <= end <= 1:
        raise ValueError("bad schedule")
    at = (step - warmup) / (total - warmup)
    return F.when(step < warmup, peak * step / max(1, warmup)).when(step >= total, peak * end).otherwise(peak * (end + (1 - end) * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * at))))


def wsd_rate(step: Column, peak: float, warmup: int, decay: int, total: int, end: float = 0.1) -> Column:
    """Linear warm-up, a plateau, then a linear decay to ``end`` of the peak."""
    if peak <= 0 or warmup < 0 or decay < 0 or warmup + decay > total:
        raise ValueError("bad schedule")
    start = total - decay
    falling = peak + (peak * end - peak) * (step - start) / max(1, decay)
    return F.when(step < warmup, peak * step / max(1, warmup)).when(step < start, peak).when(step >= total, peak * end).otherwise(falling)


def alpha_rate(step: Column, activation: int, total: int | None, first: float, last: float) -> Column:
    """1 before the activation, then linear from ``first`` to ``last``."""
    if total is None or total <= activation:
        return F.when(step < activation, 1.0).otherwise(last)
    at = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (step - activation) / (total - activation)))
    return F.when(step < activation, 1.0).otherwise(first + (last - first) * at)


def human_count(x: Column) -> Column:
    """1.2T, 3.4B, 5.6M or the number itself."""
    return F.when(x >= 1e12, F.concat(F.format_string("%.1f", x / 1e12), F.lit("T"))).when(x >= 1e9, F.concat(F.format_string("%.1f", x / 1e9), F.lit("B"))).when(
        x >= 1e6, F.concat(F.format_string("%.1f", x / 1e6), F.lit("M"))
    ).otherwise(x.cast("string"))


def human_seconds(x: Column) -> Column:
    """3h05m, or 4m07s below an hour."""
    h, m, s = F.floor(x / 3600), F.floor(x % 3600 / 60), F.floor(x % 60)
    return F.when(x >= 3600, F.format_string("%dh%02dm", h, m)).otherwise(F.format_string("%dm%02ds", m, s))


def final_losses(lines: DataFrame) -> DataFrame:
    """(run, final_loss) of ``lines`` (run, line_no, line): the last loss of each run that parses."""
    found = F.regexp_extract(F.col("line"), r'"loss":\s*(-?[0-9][0-9.eE+-]*)', 1).try_cast("double")
    return lines.withColumn("loss", found).where("loss IS NOT NULL").groupBy("run").agg(F.max_by("loss", "line_no").alias("final_loss"))


def monitor(events: DataFrame) -> DataFrame:
    """(source, status, n_events, tokens, runtime_s, tok_per_s) of ``events`` (source, ts, kind, tokens)."""
    ended, failed = F.count_if(F.col("kind") == "done") > 0, F.count_if(F.col("kind") == "error") > 0
    out = events.groupBy("source").agg(
        F.when(failed, "ERR").when(ended, "DONE").when(F.count_if(F.col("kind") == "step") > 0, "RUN").otherwise("QUEUE").alias("status"),
        F.count(F.lit(1)).alias("n_events"),
        F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("tokens"),
        (F.unix_micros(F.max(F.col("ts").cast("timestamp"))) - F.unix_micros(F.min(F.col("ts").cast("timestamp")))).alias("__us"),
    )
    sec = F.col("__us") / 1e6
    return out.withColumn("runtime_s", sec).withColumn("tok_per_s", F.when(sec > 0, F.col("tokens") / sec).otherwise(0.0)).drop("__us")
