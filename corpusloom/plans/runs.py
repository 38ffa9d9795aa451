"""Queries of mixtures, manifests, run logs and ledgers; ``events`` stands in for logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from itertools import repeat

from corpusloom.functions import numeric
from corpusloom.operators import governance, mixture, packing, provenance, runs
from corpusloom.plans import corpus
from corpusloom.plans.corpus import table
from corpusloom.sources import files

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- mixtures and manifests ----------------------------------------------------------------------------------------

_SHARES = "t AS (SELECT 'src' || i AS source, (i + 1) / 300.0 AS share FROM (SELECT unnest(range(24)) AS i))"


def _targets(spark):
    return spark.range(24).select(F.concat(F.lit("src"), "id").alias("source"), ((F.col("id") + 1) / 300.0).alias("share"))


@query(f"WITH {_SHARES} SELECT source, round(share / sum(share) OVER (), 9) AS share FROM t WHERE source IN (SELECT source FROM documents)")
def share_renormalize(spark, sf_dir):
    out = mixture.renormalise(_targets(spark), table(spark, sf_dir, "documents"))
    return out.withColumn("share", F.round("share", 9))


@query(f"WITH {_SHARES}, a AS (SELECT source, sum(n_chars) / (SELECT sum(n_chars) FROM documents) AS share FROM documents GROUP BY 1) SELECT round(max(abs(coalesce(a.share, 0) - coalesce(t.share, 0))), 9) AS drift, max(abs(coalesce(a.share, 0) - coalesce(t.share, 0))) <= 0.02 AS passed FROM a FULL JOIN t USING (source)")
def share_drift(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    total = d.agg(F.sum("n_chars").alias("all"))
    a = d.groupBy("source").agg(F.sum("n_chars").alias("n")).crossJoin(F.broadcast(total)).select("source", (F.col("n") / F.col("all")).alias("share"))
    return mixture.share_drift(a, _targets(spark)).withColumn("drift", F.round("drift", 9))


@query(f"SELECT count(*) AS n_docs, cast(max(coalesce(list_max(list_transform({corpus.T.words_sql('text')}, lambda w: {corpus.T.word_id_sql('w')})), -1)) AS BIGINT) AS max_id, true AS passed FROM documents")
def token_range_check(spark, sf_dir):
    d = packing.word_tokens(table(spark, sf_dir, "documents").select("text"))
    top = F.max(F.coalesce(F.array_max("tokens"), F.lit(-1))).cast("long")
    return d.agg(F.count(F.lit(1)).alias("n_docs"), top.alias("max_id")).withColumn("passed", F.col("max_id") < 131_072)


@query(f"WITH {corpus._spans_sql(True)}, c AS (SELECT sequence_id, sum(token_end - token_start) AS n, count(*) AS k FROM ids GROUP BY 1) SELECT count(*) AS n_sequences, count(*) FILTER (n <> {corpus.L}) AS n_short, max(k) - 1 AS max_segment, count(*) FILTER (n <> {corpus.L}) = 0 AND max(k) <= 10000 AS passed FROM c")
def segment_check(spark, sf_dir):
    s = packing.segment_ids(corpus._ids(spark, sf_dir), corpus.L)
    short = F.count_if(F.size(F.filter("segments", lambda x: x >= 0)) != corpus.L)
    top = F.max(F.array_max("segments")).cast("long")
    return s.agg(F.count(F.lit(1)).alias("n_sequences"), short.alias("n_short"), top.alias("max_segment")).withColumn("passed", (F.col("n_short") == 0) & (F.col("max_segment") < 10_000))


@query(f"""WITH {corpus._spans_sql(True)}, w AS (SELECT DISTINCT sequence_id, sequence_id // {corpus.PER_SHARD} AS shard_id FROM ids), m AS (SELECT shard_id FROM w GROUP BY 1 HAVING shard_id < (SELECT (max(shard_id) + 1) // 2 FROM w))
 SELECT shard_id, count(*) AS n_sequences, min(sequence_id) AS first_id, max(sequence_id) AS last_id FROM w WHERE shard_id NOT IN (SELECT shard_id FROM m) GROUP BY 1""")
def manifest_resume_antijoin(spark, sf_dir):
    work = corpus._ids(spark, sf_dir).select("sequence_id", F.floor(F.col("sequence_id") / corpus.PER_SHARD).alias("shard_id")).distinct()
    listed = corpus.shard_manifest(spark, sf_dir).select("shard_id")
    half = listed.agg(F.floor((F.max("shard_id") + 1) / 2).alias("half"))  # one row
    done = listed.crossJoin(F.broadcast(half)).where("shard_id < half")  # the earlier run ended half way
    return files.pending(work, done, ["shard_id"]).groupBy("shard_id").agg(
        F.count(F.lit(1)).alias("n_sequences"), F.min("sequence_id").alias("first_id"), F.max("sequence_id").alias("last_id")
    )


@query(f"WITH {_SHARES} SELECT source, round(share / (SELECT sum(share) FROM t WHERE source IN (SELECT source FROM documents)), 9) AS share FROM t WHERE source IN (SELECT source FROM documents)")
def resolve_config(spark, sf_dir):
    return governance.resolve_config(_targets(spark), table(spark, sf_dir, "documents")).withColumn("share", F.round("share", 9))


@query(f"WITH {_SHARES} SELECT source, cast(floor(1000000007 * share) AS BIGINT) AS tokens FROM t")
def source_budgets(spark, sf_dir):
    return governance.source_budgets(_targets(spark), 1_000_000_007).select("source", "tokens")


def _counts(spark, sf_dir):
    rows = corpus._spans(spark, sf_dir).groupBy("source").agg((F.max("seq") + 1).alias("n")).collect()  # one row a source
    return {r["source"]: int(r["n"]) for r in sorted(rows)}


@query()
def compose_schedule(spark, sf_dir):
    counts = _counts(spark, sf_dir)
    return mixture.write_schedule(spark, mixture.compose_schedule(counts, {s: 1 / len(counts) for s in counts}))


@query()
def mixture_schedule(spark, sf_dir):
    sizes = {s: lambda n=n: repeat(corpus.L, n) for s, n in _counts(spark, sf_dir).items()}
    return mixture.write_schedule(spark, mixture.mixture_schedule(sizes, {s: i + 1.0 for i, s in enumerate(sizes)}))


@query()
def compose_mixed_corpus(spark, sf_dir):
    ids = corpus._spans(spark, sf_dir)
    return mixture.apply_schedule(ids, compose_schedule(spark, sf_dir)).select("position", "source", "seq", "doc_id", "token_start", "token_end")


@query("SELECT doc_id, greatest(1, length(text)) AS by_text, greatest(1, len(string_split(text, ' '))) AS by_array FROM documents")
def default_measure(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", mixture.measure(F.col("text")).alias("by_text"), mixture.measure(F.split("text", " "), "array").alias("by_array"))


@query("""SELECT doc_id, trim(regexp_replace(lower(source), '[^a-z0-9]+', '_', 'g'), '_') || '_' || lang AS unique_id FROM documents""")
def unique_source_id(spark, sf_dir):
    name = F.regexp_replace(F.regexp_replace(F.lower("source"), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("_", name, "lang").alias("unique_id"))


# --- logs ----------------------------------------------------------------------------------------------------------

_LOG = "l AS (SELECT user_id, event_id AS step, CASE WHEN event_id % 997 = 5 THEN 'nan'::DOUBLE WHEN event_id % 101 = 3 THEN value * 40 ELSE value END AS loss FROM events)"


def _log(spark, sf_dir):
    i = F.col("event_id")
    loss = F.when(i % 997 == 5, F.lit(float("nan"))).when(i % 101 == 3, F.col("value") * 40).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select("user_id", i.alias("step"), loss.alias("loss"))


@query(
    f"""WITH {_LOG}, f AS (SELECT *, count(*) OVER w AS n, avg(loss) OVER w AS m, stddev_pop(loss) OVER w AS s FROM l WHERE isfinite(loss) WINDOW w AS (PARTITION BY user_id ORDER BY step ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING))
 SELECT user_id, step, CASE WHEN n < 50 OR s <= 0 THEN 'ok' WHEN (loss - m) / s >= 6 THEN 'hard' WHEN (loss - m) / s >= 3 THEN 'soft' ELSE 'ok' END AS verdict FROM f
 UNION ALL SELECT user_id, step, 'hard' FROM l WHERE loss IS NULL OR NOT isfinite(loss)"""
)
def loss_watchdog(spark, sf_dir):
    return runs.loss_watchdog(_log(spark, sf_dir), by="user_id").select("user_id", "step", "verdict")


_INCIDENTS = "SELECT user_id, event_id AS step, event_type AS reason FROM events WHERE event_type = 'error' OR event_id % 13 = 0"


def _incidents(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'error' OR event_id % 13 = 0")
    return e.select("user_id", F.col("event_id").alias("step"), F.col("event_type").alias("reason"))


@query(f"""WITH e AS ({_INCIDENTS}), g AS (SELECT *, CASE WHEN step - lag(step) OVER (PARTITION BY user_id ORDER BY step) <= 100 THEN 0 ELSE 1 END AS fresh FROM e),
 c AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY step) AS cluster FROM g) SELECT user_id, min(step) AS first_step, max(step) AS last_step, count(*) AS n FROM c GROUP BY user_id, cluster HAVING count(*) >= 2""")
def incident_clusters(spark, sf_dir):
    return runs.clusters(_incidents(spark, sf_dir), by="user_id")


@query(f"WITH e AS ({_INCIDENTS}) SELECT reason, count(*) AS n, min(step) AS first_step, max(step) AS last_step, round(count(*) / (SELECT greatest(1, max(step) - min(step)) FROM e) * 1000, 6) AS per_1000 FROM e GROUP BY reason")
def incident_summary(spark, sf_dir):
    return runs.incident_summary(_incidents(spark, sf_dir)).withColumn("per_1000", F.round("per_1000", 6))


@query(f"SELECT user_id, step, reason FROM (SELECT *, row_number() OVER (ORDER BY step DESC) AS r FROM ({_INCIDENTS})) WHERE r <= 20")
def recent_incidents(spark, sf_dir):
    return _incidents(spark, sf_dir).orderBy(F.col("step").desc()).limit(20)


@query(f"WITH {corpus._spans_sql(True)}, m AS (SELECT sequence_id, source, sum(token_end - token_start) AS n FROM ids GROUP BY ALL) SELECT sequence_id, arg_min(source, (-n, source)) AS dominant FROM m GROUP BY 1")
def dominant_source(spark, sf_dir):
    return runs.dominant(packing.source_mix(corpus._ids(spark, sf_dir)), "sequence_id")


_CELLS = "c AS (SELECT format('{}_{}', n_nationkey % 5, n_nationkey // 5) AS cell_id, CASE n_nationkey % 4 WHEN 0 THEN 'failed' ELSE 'done' END AS status, CASE WHEN n_nationkey % 6 = 5 THEN NULL ELSE 3 + (n_nationkey * 7 % 11) / 10.0 END AS final_loss FROM nation)"


@query(f"WITH {_CELLS} SELECT arg_min(cell_id, (final_loss, cell_id)) AS best, min(final_loss) AS final_loss FROM c WHERE status = 'done' AND final_loss IS NOT NULL")
def sweep_best(spark, sf_dir):
    k = F.col("n_nationkey")
    c = table(spark, sf_dir, "nation").select(
        F.concat_ws("_", (k % 5).cast("string"), F.floor(k / 5).cast("string")).alias("cell_id"),
        F.when(k % 4 == 0, "failed").otherwise("done").alias("status"),
        F.when(k % 6 == 5, None).otherwise(3 + (k * 7 % 11) / 10.0).alias("final_loss"),
    )
    good = c.where("status = 'done' AND final_loss IS NOT NULL")
    return good.agg(F.min(F.struct("final_loss", "cell_id")).alias("m")).select(F.col("m.cell_id").alias("best"), F.col("m.final_loss").alias("final_loss"))


@query("SELECT format('lr{}_init{}', lr, init) AS cell_id, lr, init FROM (SELECT unnest([1, 3, 10, 30, 100]) AS lr), (SELECT unnest([5, 20]) AS init)")
def sweep_grid(spark, sf_dir):
    lr = spark.range(5).select(F.element_at(F.array(*(F.lit(x) for x in (1, 3, 10, 30, 100))), F.col("id").cast("int") + 1).alias("lr"))
    init = spark.range(2).select(F.element_at(F.array(F.lit(5), F.lit(20)), F.col("id").cast("int") + 1).alias("init"))
    return lr.crossJoin(init).select(F.format_string("lr%d_init%d", "lr", "init").alias("cell_id"), "lr", "init")


_CHARGES = "SELECT user_id AS pod, event_id, round(event_id % 5 * 0.5 * (event_id % 600) / 3600, 9) AS delta_usd FROM events"


@query(f"SELECT pod, event_id, round(total, 6) AS total_usd, total >= 1.6 AS near_ceiling, total >= 2.0 AS blocked FROM (SELECT *, sum(delta_usd) OVER (PARTITION BY pod ORDER BY event_id) AS total FROM ({_CHARGES}))")
def cost_ledger(spark, sf_dir):
    i = F.col("event_id")
    charges = table(spark, sf_dir, "events").select(F.col("user_id").alias("pod"), "event_id", F.round(runs.charge(i % 5 * 0.5, i % 600), 9).alias("delta_usd"))
    out = runs.ledger(charges, 2.0, "pod", ["event_id"])
    return out.select("pod", "event_id", F.round("total_usd", 6).alias("total_usd"), "near_ceiling", "blocked")


@query("WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE event_id >= 100 AND value IS NOT NULL) SELECT event_type, q, value FROM r, (SELECT unnest([0.5, 0.9, 0.99]) AS q) WHERE r = least(floor(n * q), n - 1)")
def step_time_percentiles(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_id >= 100 AND value IS NOT NULL")  # warm-up rows are dropped
    return runs.nearest_rank(e, "value", "event_type", [0.5, 0.9, 0.99])


@query("SELECT run, step, r <= 3 OR step % 500 = 0 AS kept, r = 1 AS is_latest FROM (SELECT run, step, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS r FROM (SELECT user_id AS run, event_id * 100 AS step FROM events WHERE event_id % 7 <> 3))")
def checkpoint_retention(spark, sf_dir):
    i = F.col("event_id")
    c = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), (i * 100).alias("step"), (i % 7 != 3).alias("complete"))
    return runs.retention(c, 3, 500, by="run").select("run", "step", "kept", "is_latest")


def _steps(spark):
    return spark.range(0, 1100, 25).withColumnRenamed("id", "step")


_STEPS = "s AS (SELECT unnest(range(0, 1100, 25)) AS step)"


@query(f"WITH {_STEPS} SELECT step, round(CASE WHEN step < 100 THEN 2.0 * step / 100 WHEN step < 850 THEN 2.0 WHEN step >= 1000 THEN 0.2 ELSE 2.0 + (0.2 - 2.0) * (step - 850) / 150 END, 9) AS lr FROM s")
def lr_wsd(spark, sf_dir):
    return _steps(spark).select("step", F.round(runs.wsd_rate(F.col("step"), 2.0, 100, 150, 1000), 9).alias("lr"))


@query(f"WITH {_STEPS} SELECT step, round(CASE WHEN step < 100 THEN 2.0 * step / 100 WHEN step >= 1000 THEN 0.2 ELSE 2.0 * (0.1 + 0.9 * 0.5 * (1 + cos(pi() * (step - 100) / 900))) END, 9) AS lr FROM s")
def lr_cosine(spark, sf_dir):
    return _steps(spark).select("step", F.round(runs.cosine_rate(F.col("step"), 2.0, 100, 1000), 9).alias("lr"))


@query(f"WITH {_STEPS} SELECT step, round(CASE WHEN step < 800 THEN 1.0 ELSE 0.9 + (0.5 - 0.9) * least(1.0, (step - 800) / 200) END, 9) AS alpha FROM s")
def alpha_anneal(spark, sf_dir):
    return _steps(spark).select("step", F.round(runs.alpha_rate(F.col("step"), 800, 1000, 0.9, 0.5), 9).alias("alpha"))


@query(
    """WITH e AS (SELECT 's' || user_id % 20 AS source, ts, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' ELSE 'step' END AS kind, event_id % 50 AS tokens FROM events WHERE event_type <> 'error' OR user_id % 3 = 0),
 g AS (SELECT source, count(*) FILTER (kind = 'error') AS bad, count(*) FILTER (kind = 'done') AS fin, count(*) AS n_events, cast(sum(tokens) AS BIGINT) AS tokens, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS sec FROM e GROUP BY 1)
 SELECT source, CASE WHEN bad > 0 THEN 'ERR' WHEN fin > 0 THEN 'DONE' ELSE 'RUN' END AS status, n_events, tokens, round(sec, 3) AS runtime_s, round(tokens / sec, 9) AS tok_per_s FROM g"""
)
def build_monitor(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type <> 'error' OR user_id % 3 = 0")
    kind = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "error").otherwise("step")
    m = runs.monitor(e.select(F.concat(F.lit("s"), F.col("user_id") % 20).alias("source"), "ts", kind.alias("kind"), (F.col("event_id") % 50).alias("tokens")))
    return m.select("source", "status", "n_events", "tokens", F.round("runtime_s", 3).alias("runtime_s"), F.round("tok_per_s", 9).alias("tok_per_s"))


@query("""SELECT user_id AS run, arg_max(try_cast(regexp_extract(line, '"loss":\\s*(-?[0-9][0-9.eE+-]*)', 1) AS DOUBLE), event_id) FILTER (try_cast(regexp_extract(line, '"loss":\\s*(-?[0-9][0-9.eE+-]*)', 1) AS DOUBLE) IS NOT NULL) AS final_loss
 FROM (SELECT user_id, event_id, CASE event_id % 4 WHEN 0 THEN 'garbage' ELSE '{"step": ' || event_id || ', "loss": ' || (event_id % 97) || '.5}' END AS line FROM events) GROUP BY 1""")
def sweep_log_losses(spark, sf_dir):
    i = F.col("event_id")
    line = F.when(i % 4 == 0, "garbage").otherwise(F.concat(F.lit('{"step": '), i, F.lit(', "loss": '), i % 97, F.lit(".5}")))
    return runs.final_losses(table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), i.alias("line_no"), line.alias("line")))


@query("""SELECT source, CASE WHEN n >= 1e12 THEN format('{:.1f}T', n / 1e12) WHEN n >= 1e9 THEN format('{:.1f}B', n / 1e9) WHEN n >= 1e6 THEN format('{:.1f}M', n / 1e6) ELSE cast(n AS VARCHAR) END AS human FROM (SELECT source, cast(sum(n_chars) AS BIGINT) * CASE WHEN source LIKE '%1' THEN 1000 ELSE 1 END AS n FROM documents GROUP BY 1)""")
def human_formats(spark, sf_dir):
    n = F.sum("n_chars") * F.when(F.col("source").endswith("1"), 1000).otherwise(1)
    return table(spark, sf_dir, "documents").groupBy("source").agg(runs.human_count(n).alias("human"))


@query("SELECT count(DISTINCT user_id % 20) AS n_sources, cast(sum(event_id % 50) AS BIGINT) AS tokens, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3) AS runtime_s, round(sum(event_id % 50) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 9) AS tok_per_s FROM events")
def monitor_total(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    m = runs.monitor_total(e.select((F.col("user_id") % 20).alias("source"), "ts", (F.col("event_id") % 50).alias("tokens")))
    return m.select("n_sources", "tokens", F.round("runtime_s", 3).alias("runtime_s"), F.round("tok_per_s", 9).alias("tok_per_s"))


@query("SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL WHEN 1 THEN epoch_us(ts) // 1000000 - 7200 ELSE epoch_us(ts) // 1000000 END::DOUBLE AS seconds FROM events")
def iso_times(spark, sf_dir):
    i, t = F.col("event_id"), F.col("ts").cast("timestamp")
    plain = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(i % 4 == 0, F.concat(plain, F.lit("Z"))).when(i % 4 == 1, F.concat(plain, F.lit("+02:00"))).when(i % 4 == 2, plain).otherwise(F.concat(F.lit("at "), plain))
    return table(spark, sf_dir, "events").select("event_id", runs.iso_seconds(text).alias("seconds"))


@query("SELECT sequence_id, pos, round(avg(x), 6) AS mean FROM (SELECT 0 AS sequence_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM embeddings WHERE vec_id IN (SELECT vec_id FROM embeddings WHERE vec_id % 3 <> 1 AND vec_id % 5 <> 2 ORDER BY vec_id DESC LIMIT 6)) GROUP BY ALL")
def merged_weights(spark, sf_dir):
    from corpusloom.operators import evals

    e = table(spark, sf_dir, "embeddings")
    c = e.select(F.col("vec_id").alias("step"), (F.col("vec_id") % 3 != 1).alias("complete"), (F.col("vec_id") % 5 == 2).alias("merged"))
    last = runs.latest_to_merge(c, 6).select(F.col("step").alias("vec_id"))
    m = evals.element_mean(F.col("embedding"), e.join(last, "vec_id").withColumn("sequence_id", F.lit(0)), ["sequence_id"])
    return m.select("sequence_id", "pos", F.round("mean", 6).alias("mean"))


_Z = "z AS (SELECT vec_id, list_transform(embedding, lambda x: cast(x AS DOUBLE) * 20) AS z, vec_id % 64 AS y FROM embeddings), l AS (SELECT vec_id, y, z, list_max(z) + ln(list_sum(list_transform(z, lambda x: exp(x - list_max(z))))) AS lse FROM z)"


@query(f"WITH {_Z}, c AS (SELECT vec_id, lse - z[y + 1] + 0.0001 * lse * lse AS ce, CASE WHEN vec_id % 3 = 0 THEN 0.0 ELSE 1.0 END AS w FROM l) SELECT vec_id, round(ce, 6) AS ce, round((SELECT sum(ce * w) / greatest(sum(w), 1) FROM c), 6) AS mean FROM c")
def cross_entropy(spark, sf_dir):
    z = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 20).alias("z"))
    c = z.select("vec_id", numeric.cross_entropy(F.col("z"), (F.col("vec_id") % 64).cast("int"), 0.0001).alias("ce"), F.when(F.col("vec_id") % 3 == 0, 0.0).otherwise(1.0).alias("w"))
    mean = c.agg(numeric.weighted_mean(F.col("ce"), F.col("w")).alias("mean"))  # one row
    return c.crossJoin(F.broadcast(mean)).select("vec_id", F.round("ce", 6).alias("ce"), F.round("mean", 6).alias("mean"))


@query("""WITH e AS (SELECT a.vec_id, list_transform(a.embedding, lambda x: cast(x AS DOUBLE) * 20) AS t, list_transform(b.embedding, lambda x: cast(x AS DOUBLE) * 20) AS s FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
 k AS (SELECT vec_id, t[1:8] AS t, [s[cast(i AS INTEGER) + 1] for i in [0, 9, 18, 27, 36, 45, 54, 63]] AS s FROM e), l AS (SELECT vec_id, t, s, ln(list_sum(list_transform(t, lambda x: exp(x)))) AS a, ln(list_sum(list_transform(s, lambda x: exp(x)))) AS b FROM k)
 SELECT vec_id, round(list_sum(list_transform(range(1, 9), lambda i: exp(t[i] - a) * ((t[i] - a) - (s[i] - b)))), 6) AS divergence, round(0.7 * 1.5 + 0.3 * list_sum(list_transform(range(1, 9), lambda i: exp(t[i] - a) * ((t[i] - a) - (s[i] - b)))), 6) AS loss FROM l""")
def top_k_divergence(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 20).alias("z"))
    pairs = e.withColumnRenamed("z", "t").join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("z").alias("s")), "vec_id")
    d = numeric.top_k_divergence(F.col("s"), F.slice("t", 1, 8), F.sequence(F.lit(0), F.lit(63), F.lit(9)))
    loss = numeric.distilled(F.lit(1.5), [d, d], [1.0, 3.0], F.lit(0.7))
    return pairs.select("vec_id", F.round(d, 6).alias("divergence"), F.round(loss, 6).alias("loss"))


@query("""SELECT n_nationkey, 12 * (2 * h * h + 2 * h * h * 0.25 + 3 * h * 4 * h + 2 * h) + 1000 * h + h AS parameters, round(6 * 1000.0 * (n_nationkey + 1) * 50 / 1e9, 9) AS utilisation, greatest(1, ceil(1000000 * n_nationkey / (8.0 * 2048)))::BIGINT AS steps,
 CASE WHEN n_nationkey % 4 = 0 THEN 1 WHEN n_nationkey % 4 = 1 THEN 2 WHEN n_nationkey % 4 = 2 THEN 3 ELSE 8 END AS micro_batch FROM (SELECT n_nationkey, 64 * (n_nationkey + 1) AS h FROM nation)""")
def model_arithmetic(spark, sf_dir):
    k = F.col("n_nationkey")
    h = 64 * (k + 1)
    pick = lambda r, v: F.when(k % 4 == r, v)
    return table(spark, sf_dir, "nation").select(
        "n_nationkey",
        numeric.parameter_count(h, F.lit(12), 4 * h, F.lit(1000), F.lit(0.25)).alias("parameters"),
        F.round(numeric.utilisation(F.lit(1000.0), (k + 1) * 50.0, F.lit(1e9)), 9).alias("utilisation"),
        numeric.token_steps(k * 1_000_000, F.lit(8), F.lit(2048)).cast("long").alias("steps"),
        runs.micro_batch(pick(0, 1), pick(1, 2), pick(2, 3)).alias("micro_batch"),
    )


@query("SELECT event_id, CASE WHEN s >= 3600 THEN s // 3600 || 'h' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || 'm' ELSE s // 60 || 'm' || lpad((s % 60)::VARCHAR, 2, '0') || 's' END AS human FROM (SELECT event_id, event_id * 7 % 9000 AS s FROM events)")
def human_times(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", runs.human_seconds(F.col("event_id") * 7 % 9000).alias("human"))
