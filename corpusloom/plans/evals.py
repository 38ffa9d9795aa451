"""Queries of evaluation and of teacher logits."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import evals, governance, teacher
from corpusloom.plans.corpus import table
from corpusloom.sources.scratch import Scratch

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: A model answer for each benchmark item, in one of several phrasings, with its target letter.
_FORMS = ["The answer is {}.", "  {}  ", "Answer: {}", "({})", "I think {} is right", "no letter here"]
_ANSWERS_SQL = (
    "a AS (SELECT item_id, 'bench' || item_id % 4 AS bench, CASE item_id % 2 WHEN 0 THEN 'en' ELSE 'de' END AS subgroup, substr('ABCD', cast(item_id % 4 AS INTEGER) + 1, 1) AS target, "
    "replace(CASE item_id % 6 " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(_FORMS)) + " END, '{}', lower(substr('ABCD', cast(item_id % 5 % 4 AS INTEGER) + 1, 1))) AS prediction FROM benchmark)"
)
_LETTER_SQL = f"substr(regexp_replace(upper(prediction), '{evals.ANSWER_PREFIX}', ''), 1, 1)"


def _answers(spark, sf_dir):
    i = F.col("item_id")
    form = F.lit(_FORMS[-1])
    for k, f in enumerate(_FORMS[:-1]):
        form = F.when(i % 6 == k, F.lit(f)).otherwise(form)
    letter = lambda n: F.substring(F.lit("ABCD"), (n + 1).cast("int"), F.lit(1))
    return table(spark, sf_dir, "benchmark").select(
        "item_id",
        F.concat(F.lit("bench"), i % 4).alias("bench"),
        F.when(i % 2 == 0, "en").otherwise("de").alias("subgroup"),
        letter(i % 4).alias("target"),
        F.replace(form, F.lit("{}"), F.lower(letter(i % 5 % 4))).alias("prediction"),
    )


@query(f"WITH {_ANSWERS_SQL} SELECT item_id, prediction, {_LETTER_SQL} = target AS correct FROM a")
def letter_score(spark, sf_dir):
    return _answers(spark, sf_dir).select("item_id", "prediction", evals.letter_score(F.col("prediction"), F.col("target")).alias("correct"))


@query(
    f"WITH {_ANSWERS_SQL} SELECT bench, subgroup, count(*) AS n, count(*) FILTER ({_LETTER_SQL} = target) AS n_correct, round(count(*) FILTER ({_LETTER_SQL} = target) / count(*), 9) AS accuracy FROM a GROUP BY GROUPING SETS ((bench), (bench, subgroup))"
)
def benchmark_accuracy(spark, sf_dir):
    a = _answers(spark, sf_dir)
    return evals.accuracy(a.select("bench", "subgroup", evals.letter_score(F.col("prediction"), F.col("target")).alias("correct")))


_NUMBERS_SQL = "n AS (SELECT event_id, 'so ' || event_id || ' and #### ' || (event_id % 7) || CASE event_id % 3 WHEN 0 THEN '.0' WHEN 1 THEN '.5 #### ' || user_id ELSE ' then 12' END AS answer, 'it is ' || value || CASE event_id % 2 WHEN 0 THEN '' ELSE ' #### ' || (event_id % 7) || '.0' END AS prediction FROM events)"


def _plain_sql(x: str) -> str:
    return f"CASE WHEN try_cast({x} AS DOUBLE) = floor(try_cast({x} AS DOUBLE)) THEN cast(cast(floor(cast({x} AS DOUBLE)) AS BIGINT) AS VARCHAR) ELSE {x} END"


@query(
    f"""WITH {_NUMBERS_SQL}, e AS (SELECT event_id, regexp_extract(answer, '{evals.MARKED}', 1) AS g,
 coalesce(list_extract(regexp_extract_all(prediction, '{evals.MARKED}', 1), -1), list_extract(regexp_extract_all(prediction, '{evals.NUMBER}'), -1)) AS p FROM n)
 SELECT event_id, g AS gold, {_plain_sql('p')} AS predicted, coalesce({_plain_sql('g')} = {_plain_sql('p')}, false) AS correct FROM e"""
)
def gsm8k_score(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    tail = F.when(i % 3 == 0, ".0").when(i % 3 == 1, F.concat(F.lit(".5 #### "), "user_id")).otherwise(" then 12")
    answer = F.concat(F.lit("so "), i, F.lit(" and #### "), i % 7, tail)
    prediction = F.concat(F.lit("it is "), F.col("value").cast("string"), F.when(i % 2 == 0, "").otherwise(F.concat(F.lit(" #### "), i % 7, F.lit(".0"))))
    gold, got = evals.gold_number(answer), evals.predicted_number(prediction)
    return e.select("event_id", gold.alias("gold"), got.alias("predicted"), F.coalesce(evals.plain_number(gold) == got, F.lit(False)).alias("correct"))


_MCQ_SQL = "m AS (SELECT n_nationkey, [n_name, ' ' || n_name || ' x', n_name || ' y', 'N/A'] AS options, CASE n_nationkey % 3 WHEN 0 THEN n_name WHEN 1 THEN n_name || ' x' ELSE 'none' END AS answer FROM nation)"


def _mcq(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    options = [F.col("n_name"), F.concat(F.lit(" "), "n_name", F.lit(" x")), F.concat("n_name", F.lit(" y")), F.lit("N/A")]
    answer = F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).when(F.col("n_nationkey") % 3 == 1, F.concat("n_name", F.lit(" x"))).otherwise("none")
    return n, options, answer


@query(f"WITH {_MCQ_SQL} SELECT n_nationkey, CASE WHEN k > 0 THEN substr('ABCD', cast(k AS INTEGER), 1) END AS letter FROM (SELECT n_nationkey, coalesce(nullif(list_position(options, answer), 0), list_position(list_transform(options, lambda o: trim(o)), trim(answer))) AS k FROM m)")
def milu_gold(spark, sf_dir):
    n, options, answer = _mcq(spark, sf_dir)
    return n.select("n_nationkey", evals.answer_to_letter(F.array(*options), answer).alias("letter"))


@query(f"WITH {_MCQ_SQL} SELECT n_nationkey, array_to_string(list_filter(options, lambda o: o NOT IN ('', 'N/A')), '|') AS choices FROM m")
def choices_extract(spark, sf_dir):
    n, options, _ = _mcq(spark, sf_dir)
    return n.select("n_nationkey", F.array_join(evals.choices(options), "|").alias("choices"))


_LOSS_SQL = "l AS (SELECT event_id // 64 AS batch, CASE WHEN user_id % 10 < 9 THEN 's' || user_id % 10 END AS source, CASE WHEN event_id % 1999 = 7 THEN 'inf'::DOUBLE ELSE value / 100 END AS nll, CASE WHEN event_id % 5 = 0 OR user_id % 10 = 3 THEN 0.0 ELSE 1.0 END AS weight FROM events WHERE value IS NOT NULL)"


def _losses(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value IS NOT NULL")
    i, u = F.col("event_id"), F.col("user_id")
    return e.select(
        F.floor(i / 64).alias("batch"),
        F.when(u % 10 < 9, F.concat(F.lit("s"), u % 10)).alias("source"),
        F.when(i % 1999 == 7, F.lit(float("inf"))).otherwise(F.col("value") / 100).alias("nll"),
        F.when((i % 5 == 0) | (u % 10 == 3), 0.0).otherwise(1.0).alias("weight"),
    )


@query(
    f"""WITH {_LOSS_SQL}, g AS (SELECT * FROM l WHERE batch NOT IN (SELECT batch FROM l WHERE NOT isfinite(nll)))
 SELECT source, cast(sum(CASE WHEN weight > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_tokens, round(sum(nll * weight) / sum(weight), 6) AS loss, round(exp(least(sum(nll * weight) / sum(weight), 50)), 6) AS ppl FROM g WHERE source IS NOT NULL GROUP BY source HAVING sum(weight) > 0
 UNION ALL SELECT NULL, cast(sum(CASE WHEN weight > 0 THEN 1 ELSE 0 END) AS BIGINT), round(sum(nll * weight) / sum(weight), 6), round(exp(least(sum(nll * weight) / sum(weight), 50)), 6) FROM g HAVING sum(weight) > 0"""
)
def per_source_loss(spark, sf_dir):
    return evals.source_loss(_losses(spark, sf_dir)).select("source", "n_tokens", F.round("loss", 6).alias("loss"), F.round("ppl", 6).alias("ppl"))


@query(f"WITH {_LOSS_SQL}, b AS (SELECT batch, avg(nll) AS m FROM l GROUP BY 1) SELECT round(avg(m), 6) AS loss, round(exp(avg(m)), 6) AS ppl, count(*) AS n_batches FROM b WHERE isfinite(m)")
def mean_finite_loss(spark, sf_dir):
    b = _losses(spark, sf_dir).groupBy("batch").agg(F.avg("nll").alias("m")).where("m < double('infinity')")
    return b.agg(F.round(F.avg("m"), 6).alias("loss"), F.round(F.exp(F.avg("m")), 6).alias("ppl"), F.count(F.lit(1)).alias("n_batches"))


@query(
    "WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('0:' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT doc_id, lang, r <= 4 AS is_shot FROM r WHERE n >= 5"
)
def few_shot_split(spark, sf_dir):
    return evals.few_shot_split(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 4)


@query("SELECT doc_id, 'Q: ' || text || chr(10) || 'A. ' || lang || chr(10) || 'B. ' || source || chr(10) || 'Answer:' AS prompt FROM documents")
def prompt_template(spark, sf_dir):
    prompt = evals.choice_block(F.col("text"), F.array("lang", "source"))
    return table(spark, sf_dir, "documents").select("doc_id", prompt.alias("prompt"))


@query("""WITH s AS (SELECT item_id, text, row_number() OVER (ORDER BY md5('0:' || item_id), item_id) AS r FROM benchmark), k AS (SELECT string_agg('Q: ' || text || chr(10) || 'A: #### ' || item_id, chr(10) || chr(10) ORDER BY r) AS shots FROM s WHERE r <= 3)
 SELECT item_id, shots || chr(10) || chr(10) || 'Q: ' || text || chr(10) || 'A:' AS prompt FROM s, k WHERE r > 3""")
def few_shot_prompts(spark, sf_dir):
    b = evals.few_shot_split(table(spark, sf_dir, "benchmark").select("item_id", "text", F.lit("all").alias("set")), "set", "item_id", 3)
    h = F.md5(F.concat(F.lit("0:"), F.col("item_id").cast("string")))
    block = evals.worked_block(F.col("text"), F.concat(F.lit("#### "), F.col("item_id")))
    shots = b.where("is_shot").agg(F.transform(F.sort_array(F.collect_list(F.struct(h.alias("h"), "item_id", block.alias("b")))), lambda x: x.b).alias("shots"))  # one row
    rest = b.where("NOT is_shot").crossJoin(F.broadcast(shots))
    return rest.select("item_id", evals.few_shot_prompt(F.col("shots"), evals.worked_block(F.col("text"))).alias("prompt"))


@query("SELECT doc_id, 'Passage: ' || text || chr(10) || 'Question: ' || source || chr(10) || 'A. ' || lang || chr(10) || 'B. ' || source || chr(10) || 'Answer:' AS prompt FROM documents")
def passage_prompts(spark, sf_dir):
    prompt = evals.passage_prompt(F.col("text"), F.col("source"), F.array("lang", "source"))
    return table(spark, sf_dir, "documents").select("doc_id", prompt.alias("prompt"))


@query("""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('3:' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT doc_id, lang, r <= 5 AS is_shot FROM r WHERE n >= 6 AND r <= 25""")
def few_shot_capped(spark, sf_dir):
    return evals.few_shot_split(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 5, seed=3, most=20)


@query("""WITH t AS (SELECT item_id, row_number() OVER (ORDER BY md5('0:' || item_id), item_id) AS r FROM benchmark WHERE item_id % 3 = 0) SELECT item_id, true AS is_shot FROM t WHERE r <= 8 UNION ALL SELECT item_id, false FROM benchmark WHERE item_id % 3 <> 0""")
def shots_from_train(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id")
    return evals.shots_from_train(b.where("item_id % 3 = 0"), b.where("item_id % 3 <> 0"), "item_id", 8)


@query("""SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN substr('ABCDEFGHIJ', cast(n_nationkey % 10 AS INTEGER) + 1, 1) WHEN 1 THEN substr('CDE', cast(n_nationkey % 3 AS INTEGER) + 1, 1) ELSE substr('ABCDEFGHIJ', cast(n_regionkey AS INTEGER) + 1, 1) END AS letter,
 CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'unknown' END AS subgroup FROM nation""")
def gold_letter(spark, sf_dir):
    k = F.col("n_nationkey")
    low = F.lower(F.substring(F.lit("CDE"), (k % 3 + 1).cast("int"), F.lit(1)))
    answer = F.when(k % 4 == 1, F.concat(F.lit(" "), low, F.lit(" "))).when(k % 4 == 2, "Z").when(k % 4 == 3, "AB")
    index = F.when(k % 4 == 0, k % 10).otherwise(F.col("n_regionkey"))
    meta = F.when(k % 2 == 0, F.create_map(F.lit("language"), F.col("n_name"))).otherwise(F.create_map(F.lit("subject"), F.col("n_name")))
    n = table(spark, sf_dir, "nation")
    return n.select("n_nationkey", evals.gold_letter(answer, index).alias("letter"), evals.subgroup_key(meta, "language").alias("subgroup"))


def _scores(spark, sf_dir):
    answers = _answers(spark, sf_dir)
    score = lambda df: evals.letter_score(F.col("prediction"), F.col("target"))
    group = lambda df: F.col("subgroup")
    pick = lambda name: lambda spark: answers.where(F.col("bench") == name)

    def lost(spark):
        raise FileNotFoundError("no such benchmark")

    marks = [governance.Benchmark(f"bench{i}", pick(f"bench{i}"), score, group) for i in range(4)]
    return governance.scorecard(spark, [marks[0], governance.Benchmark("lost", lost, score), *marks[1:]], lambda df: df)


_SCORES_SQL = f"g AS (SELECT bench, subgroup, count(*) AS n, count(*) FILTER ({_LETTER_SQL} = target) / count(*) AS a FROM a GROUP BY GROUPING SETS ((bench), (bench, subgroup)))"


@query(f"WITH {_ANSWERS_SQL}, {_SCORES_SQL} SELECT bench AS benchmark, round(a, 9) AS accuracy, n, NULL AS error FROM g WHERE subgroup IS NULL UNION ALL SELECT 'lost', NULL, 0, 'no such benchmark'")
def scorecard(spark, sf_dir):
    return _scores(spark, sf_dir).select("benchmark", "accuracy", "n", "error")


@query(f"""WITH {_ANSWERS_SQL}, {_SCORES_SQL}, p AS (SELECT bench, string_agg(subgroup || '=' || format('{{:.1f}}', a * 100) || '%', '  ' ORDER BY subgroup) AS note FROM g WHERE subgroup IS NOT NULL GROUP BY 1)
 SELECT bench AS benchmark, '| ' || bench || ' | ' || format('{{:.2f}}', a * 100) || '% | ' || n || ' | ' || note || ' |' AS line FROM g JOIN p USING (bench) WHERE subgroup IS NULL UNION ALL SELECT 'lost', '| lost | — | 0 | FAILED: no such benchmark |'""")
def scorecard_lines(spark, sf_dir):
    return governance.scorecard_lines(_scores(spark, sf_dir))


@query("""WITH c AS (SELECT n_name AS name, n_nationkey AS k, CASE WHEN n_nationkey % 7 = 6 THEN NULL ELSE 12 END AS layers, 64 * (n_nationkey % 5 + 1) AS hidden, 64 * (n_nationkey % 5 + 1) * (n_nationkey % 10 + 1) AS ffn, n_nationkey % 6 + 3 AS heads, 2 AS kv, CASE n_nationkey % 3 WHEN 0 THEN 32 END AS hd, CASE n_nationkey % 9 WHEN 8 THEN -1 ELSE 10000 END AS rope, 32 * (n_nationkey % 4 + 1) AS ctx FROM nation),
 i AS (SELECT name, CASE WHEN layers IS NULL THEN 'missing layers' ELSE concat_ws('; ', CASE WHEN hidden % heads <> 0 THEN 'hidden_dim is not divisible by num_heads' END, CASE WHEN heads % kv <> 0 THEN 'num_heads is not divisible by num_kv_heads' END,
  CASE WHEN coalesce(hd, hidden // heads) * heads <> hidden THEN 'head_dim times num_heads is not hidden_dim' END, CASE WHEN rope <= 0 THEN 'rope_base must be above 0' END, CASE WHEN ctx < 64 THEN 'context_length is below 64' END, CASE WHEN ffn / hidden < 1.5 OR ffn / hidden > 8 THEN 'ffn ratio is outside 1.5 to 8' END) END AS issues FROM c)
 SELECT name, issues = '' AS passed, issues FROM i""")
def config_issues(spark, sf_dir):
    k = F.col("n_nationkey")
    c = table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("name"),
        F.when(k % 7 != 6, 12).alias("layers"),
        (64 * (k % 5 + 1)).alias("hidden_dim"),
        (64 * (k % 5 + 1) * (k % 10 + 1)).alias("ffn_dim"),
        (k % 6 + 3).alias("num_heads"),
        F.lit(2).alias("num_kv_heads"),
        F.when(k % 3 == 0, 32).alias("head_dim"),
        F.when(k % 9 == 8, -1).otherwise(10_000).alias("rope_base"),
        F.lit(50_000).alias("vocab_size"),
        (32 * (k % 4 + 1)).alias("context_length"),
    )
    return governance.config_issues(c)


@query("WITH c AS (SELECT CASE WHEN user_id % 10 < 9 THEN 'stage' || user_id % 10 ELSE 'late' END AS stage, event_type <> 'error' OR user_id % 4 > 0 AS ok FROM events) SELECT stage, count(*) FILTER (ok) AS n_passed, count(*) AS n, bool_and(ok) AS passed FROM c GROUP BY GROUPING SETS ((stage), ())")
def stage_rollup(spark, sf_dir):
    u = F.col("user_id")
    stage = F.when(u % 10 < 9, F.concat(F.lit("stage"), u % 10)).otherwise("late")
    return governance.stage_rollup(table(spark, sf_dir, "events").select(stage.alias("stage"), ((F.col("event_type") != "error") | (u % 4 > 0)).alias("passed")))


@query("SELECT count(*) FILTER (o_totalprice < 200000) AS n_pass, count(*) FILTER (o_totalprice >= 200000) AS n_fail, max(o_orderkey * 3) - min(o_orderkey) AS wall_s FROM orders")
def build_summary(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    ok = F.col("o_totalprice") < 200_000
    return governance.build_summary(o.select(F.col("o_orderkey").alias("source"), ok.alias("ok"), F.col("o_orderkey").alias("started"), (F.col("o_orderkey") * 3).alias("ended")))


@query("""WITH e AS (SELECT n_nationkey AS place, CASE n_nationkey % 3 WHEN 0 THEN n_name ELSE 'Org/' || replace(n_name, ' ', '-') END AS dataset, CASE WHEN n_nationkey % 4 = 1 THEN 'id_' || n_nationkey END AS sid FROM nation),
 w AS (SELECT DISTINCT s AS source_id FROM (SELECT CASE c_custkey % 3 WHEN 0 THEN 'id_' || c_custkey % 30 WHEN 1 THEN lower(replace(n_name, ' ', '.')) ELSE n_name END AS s FROM customer JOIN nation ON n_nationkey = c_nationkey)),
 m AS (SELECT source_id, min(place) AS place FROM w JOIN e ON dataset = source_id OR sid = source_id OR replace(replace(lower(source_id), '-', '_'), '.', '_') = replace(replace(lower(string_split(dataset, '/')[-1]), '-', '_'), '.', '_') GROUP BY 1)
 SELECT source_id, place, dataset FROM w LEFT JOIN m USING (source_id) LEFT JOIN e USING (place)""")
def match_sources(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    k, name = F.col("n_nationkey"), F.col("n_name")
    entries = n.select(k.alias("place"), F.when(k % 3 == 0, name).otherwise(F.concat(F.lit("Org/"), F.replace(name, F.lit(" "), F.lit("-")))).alias("dataset"), F.when(k % 4 == 1, F.concat(F.lit("id_"), k)).alias("source_id"))
    c = table(spark, sf_dir, "customer").join(n, F.col("n_nationkey") == F.col("c_nationkey"))
    i = F.col("c_custkey")
    wanted = F.when(i % 3 == 0, F.concat(F.lit("id_"), i % 30)).when(i % 3 == 1, F.lower(F.replace(name, F.lit(" "), F.lit(".")))).otherwise(name)
    return governance.match_sources(c.select(wanted.alias("source_id")), entries)


@query("""SELECT DISTINCT source AS dataset, CASE WHEN source LIKE '%1' THEN 'CC0' ELSE 'see register' END AS license, CASE WHEN source LIKE '%1' THEN 'ends in one' ELSE '' END AS notes FROM documents""")
def source_table(spark, sf_dir):
    sources = table(spark, sf_dir, "documents").select(F.col("source").alias("dataset")).distinct()
    licenses = sources.where("dataset LIKE '%1'").select("dataset", F.lit("CC0").alias("license"), F.lit("ends in one").alias("notes"))
    return governance.source_table(sources, licenses)


# --- teacher logits ------------------------------------------------------------------------------------------------

_E = "e AS (SELECT vec_id, list_transform(embedding, lambda x: cast(x AS DOUBLE) * 20) AS z FROM embeddings)"


def _logits(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double") * 20).alias("z"))


@query(f"WITH {_E}, x AS (SELECT vec_id, unnest(z) AS v, unnest(range(len(z))) AS i FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS r FROM x) SELECT vec_id, string_agg(i, ',' ORDER BY r) AS indices, round(sum(v), 6) AS total FROM r WHERE r <= 8 GROUP BY 1")
def topk_extract(spark, sf_dir):
    t = _logits(spark, sf_dir).withColumn("t", evals.top_k(F.col("z"), 8))
    total = F.aggregate("t", F.lit(0.0), lambda a, x: a + x.value)
    return t.select("vec_id", F.array_join(F.transform("t", lambda x: x["index"].cast("string")), ",").alias("indices"), F.round(total, 6).alias("total"))


_MASS_SQL = f"{_E}, p AS (SELECT vec_id, list_reverse_sort(list_transform(z, lambda x: exp(x - list_max(z)))) AS s FROM e), mass AS (SELECT vec_id, k, list_sum(s[1:k]) / list_sum(s) AS mass FROM p, (SELECT unnest([4, 8, 16, 32]) AS k))"


def _masses(spark, sf_dir):
    out = None
    for k in (4, 8, 16, 32):
        part = _logits(spark, sf_dir).select("vec_id", F.lit(k).alias("k"), evals.top_k_mass(F.col("z"), k).alias("mass"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {_MASS_SQL} SELECT vec_id, k, round(mass, 6) AS mass FROM mass")
def topk_mass(spark, sf_dir):
    return _masses(spark, sf_dir).withColumn("mass", F.round("mass", 6))


@query(
    f"""WITH {_MASS_SQL} SELECT k, round(avg(mass), 6) AS mean, round(quantile_cont(mass, 0.1), 6) AS p10, round(quantile_cont(mass, 0.5), 6) AS p50, round(quantile_cont(mass, 0.9), 6) AS p90, round(quantile_cont(mass, 0.99), 6) AS p99,
 round(avg(CASE WHEN mass < 0.9 THEN 1.0 ELSE 0 END), 6) AS below_90, round(avg(CASE WHEN mass < 0.95 THEN 1.0 ELSE 0 END), 6) AS below_95, round(avg(CASE WHEN mass < 0.99 THEN 1.0 ELSE 0 END), 6) AS below_99 FROM mass GROUP BY k"""
)
def mass_summary(spark, sf_dir):
    s = evals.mass_summary(_masses(spark, sf_dir))
    return s.select("k", *(F.round(c, 6).alias(c) for c in s.columns if c != "k"))


@query(f"WITH {_MASS_SQL}, s AS (SELECT k, avg(CASE WHEN mass < 0.95 THEN 1.0 ELSE 0 END) AS b FROM mass GROUP BY k) SELECT coalesce(min(k) FILTER (b <= 0.1), max(k)) AS k FROM s")
def recommend_k(spark, sf_dir):
    return evals.recommend_k(evals.mass_summary(_masses(spark, sf_dir)))


_RANGES = "r AS (SELECT n_nationkey * 500 AS start, n_nationkey * 500 + CASE WHEN n_nationkey % 4 = 3 THEN 400 ELSE 500 END AS \"end\", 'k' || n_nationkey AS key FROM nation)"


def _ranges(spark, sf_dir):
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        (n * 500).cast("long").alias("start"), (n * 500 + F.when(n % 4 == 3, 400).otherwise(500)).cast("long").alias("end"), F.concat(F.lit("k"), n).alias("key")
    )


@query(f"WITH {_RANGES} SELECT event_id AS pos, key FROM events LEFT JOIN r ON event_id >= start AND event_id < \"end\"")
def position_range_join(spark, sf_dir):
    p = table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"))
    return evals.range_lookup(p, _ranges(spark, sf_dir), 512).select("pos", "key")


@query(f"WITH {_RANGES}, g AS (SELECT start, max(\"end\") OVER (ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap_start FROM r) SELECT gap_start, start AS gap_end FROM g WHERE gap_start < start")
def coverage_gaps(spark, sf_dir):
    return evals.coverage_gaps(_ranges(spark, sf_dir))


@query("SELECT label, pos, round(avg(x), 6) AS mean FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM embeddings) GROUP BY ALL")
def weight_mean(spark, sf_dir):
    m = evals.element_mean(F.col("embedding"), table(spark, sf_dir, "embeddings"), ["label"])
    return m.select("label", "pos", F.round("mean", 6).alias("mean"))


@query("WITH t AS (SELECT vec_id // 2 AS pos, vec_id % 2 AS teacher, array_to_string(list_transform(embedding, lambda x: cast(round(x, 4) AS DECIMAL(9, 4))), ',') AS v FROM embeddings) SELECT pos, count(*) AS n_teachers, string_agg(v, ';' ORDER BY teacher) AS stacked FROM t GROUP BY pos HAVING count(*) = 2")
def teacher_stack(spark, sf_dir):
    full = teacher.stack(_cache(spark, sf_dir), ["t0", "t1"])
    one = lambda v: F.array_join(F.transform(v, lambda x: F.round(x, 4).cast("decimal(9,4)").cast("string")), ",")
    return full.select("pos", F.size("logits").cast("long").alias("n_teachers"), F.array_join(F.transform("logits", one), ";").alias("stacked"))


def _cache(spark, sf_dir):
    """Two teachers' logits: even vectors of one and odd ones of the other, at the positions that both have."""
    e = table(spark, sf_dir, "embeddings")
    rows = e.select(
        F.concat(F.lit("t"), F.col("vec_id") % 2).alias("teacher_id"), F.floor(F.col("vec_id") / 2).alias("pos"), F.col("embedding").alias("logits"), F.transform("embedding", lambda x, i: i).alias("indices")
    )
    both = rows.groupBy("pos").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("pos")
    return rows.join(both, "pos", "left_semi")


_CACHED = "c AS (SELECT vec_id // 2 AS pos FROM embeddings GROUP BY 1 HAVING count(*) = 2), top AS (SELECT max(pos) + 1 AS n FROM c), b AS (SELECT unnest(range(0, 40)) AS step), p AS (SELECT step, step * 6 AS first FROM b, top WHERE step * 6 + 6 <= n)"


@query(f"WITH {_CACHED}, j AS (SELECT step, first, unnest(range(first, first + 6)) AS pos FROM p WHERE step >= 5) SELECT step, first, pos, round(a.embedding[1] + d.embedding[64], 5) AS mixed FROM j JOIN embeddings a ON a.vec_id = 2 * pos JOIN embeddings d ON d.vec_id = 2 * pos + 1 UNION ALL SELECT step, first, NULL, NULL FROM p WHERE step < 5")
def decay_attach(spark, sf_dir):
    cache = _cache(spark, sf_dir)
    n = cache.agg(F.max("pos") + 1).first()[0]
    batches = spark.range(40).select(F.col("id").alias("batch"), F.lit(2).alias("n_rows"), F.lit(3).alias("width"))
    placed = teacher.batch_positions(batches).where(F.col("last_excl") <= n).withColumn("step", F.col("batch"))
    out = teacher.attach(placed, cache, ["t0", "t1"], 5)
    mixed = F.get(F.get("logits", F.lit(0)), F.lit(0)) + F.get(F.get("logits", F.lit(1)), F.lit(63))
    return out.select("step", "first", "pos", F.round(mixed, 5).alias("mixed"))


@query("SELECT event_id AS batch, cast(coalesce(sum((event_id % 4 + 1) * (user_id % 7 + 1)) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) + 100 AS first, cast(sum((event_id % 4 + 1) * (user_id % 7 + 1)) OVER (ORDER BY event_id) AS BIGINT) + 100 AS last_excl FROM events")
def corpus_positions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("batch"), (F.col("event_id") % 4 + 1).alias("n_rows"), (F.col("user_id") % 7 + 1).alias("width"))
    return teacher.batch_positions(e, 100).select("batch", "first", "last_excl")


@query("""WITH t AS (SELECT event_id - 1 AS pos, user_id AS token FROM events), z AS (SELECT 7 AS a, (SELECT max(pos) FROM t) - 3 AS b), l AS (SELECT unnest(range(0, ceil((b - a) / 40.0)::BIGINT * 4)) AS line, a, b FROM z),
 x AS (SELECT line, a, b, unnest(range(0, 10)) AS i FROM l) SELECT line // 4 AS batch, line % 4 AS row, min(a) + line // 4 * 40 AS first, least(min(b), min(a) + (line // 4 + 1) * 40) AS last_excl, string_agg(CASE WHEN a + line * 10 + i < b THEN coalesce(token, 0) ELSE 0 END, ' ' ORDER BY i) AS tokens
 FROM x LEFT JOIN t ON t.pos = a + line * 10 + i GROUP BY line""")
def flat_batches(spark, sf_dir):
    t = table(spark, sf_dir, "events").select((F.col("event_id") - 1).alias("pos"), F.col("user_id").cast("bigint").alias("token"))
    end = t.agg(F.max("pos")).first()[0] - 3
    out = teacher.flat_batches(t, 7, end, 4, 10)
    return out.withColumn("tokens", F.array_join(F.transform("tokens", lambda x: x.cast("string")), " "))


_SHA = "0123456789abcdef0123456789abcdef"


@query(f"""WITH z AS (SELECT count(*) * 1000 AS n, count(*) * 1000 // 3 // 4096 * 4096 AS done FROM events), s AS (SELECT unnest(range(0, ceil((n - done) / 12288.0)::BIGINT)) AS i, n, done FROM z), r AS (SELECT done + i * 12288 AS start, least(done + (i + 1) * 12288, n) AS "end" FROM s)
 SELECT start, "end", 'distillation_cache/big/k8/corpus_{_SHA[:16]}/tokens_' || lpad(start::VARCHAR, 13, '0') || '_' || lpad("end"::VARCHAR, 13, '0') || '.arrow' AS key FROM r""")
def cache_plan(spark, sf_dir):
    n = table(spark, sf_dir, "events").count() * 1000
    done = spark.createDataFrame([("big", 0, 4096), ("big", 4096, n // 3 // 4096 * 4096)], "teacher_id string, start long, end long")
    return teacher.plan_shards(spark, "big", 8, _SHA, 0, n, 4096, 10_000, done)


@query("""WITH e AS (SELECT vec_id, vec_id // 50 AS s FROM embeddings), c AS (SELECT s, count(*) AS n, max(s) OVER () AS last FROM e GROUP BY s)
 SELECT 'k' || s AS key, concat_ws('; ', CASE WHEN s % 9 = 4 THEN 'top_k must be above 0' END, CASE WHEN s % 9 = 5 THEN 'the end must be after the start' END, CASE WHEN CASE WHEN s % 9 = 5 THEN 0 ELSE 50 END <> n THEN 'rows differ from the range' END,
 CASE WHEN s % 9 IN (4, 6) THEN 'logits of another size than top_k' END, CASE WHEN s % 9 = 4 THEN 'indices of another size than top_k' END, CASE WHEN s % 9 = 7 THEN 'negative indices' END, CASE WHEN s % 9 = 5 THEN 'positions outside the range' END) AS issues FROM c""")
def shard_issues(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("s", F.floor(F.col("vec_id") / 50))
    kind = F.col("s") % 9
    payload = e.select(
        F.concat(F.lit("k"), "s").alias("key"),
        F.col("vec_id").alias("pos"),
        F.slice("embedding", F.lit(1), F.when(kind == 6, 3).otherwise(4)).alias("logits"),
        F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.when((kind == 7) & (i == 2), -1).otherwise(i)).alias("indices"),
    )
    shards = e.select("s").distinct().select(
        F.concat(F.lit("k"), "s").alias("key"), F.when(kind == 4, 0).otherwise(4).alias("top_k"), (F.col("s") * 50).alias("start"), (F.col("s") * 50 + F.when(kind == 5, -1).otherwise(50)).alias("end")
    )
    return teacher.shard_issues(shards, payload)


@query(f"""WITH {_E}, x AS (SELECT vec_id, unnest(z) AS z, unnest(range(len(z))) AS i FROM e), q AS (SELECT vec_id, i, exp(z - max(z) OVER (PARTITION BY vec_id)) AS w FROM x), p AS (SELECT vec_id, i, w / sum(w) OVER (PARTITION BY vec_id) AS q FROM q),
 c AS (SELECT vec_id, i, q, sum(q) OVER (PARTITION BY vec_id ORDER BY q DESC, i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum, row_number() OVER (PARTITION BY vec_id ORDER BY q DESC, i) AS r FROM p),
 k AS (SELECT * FROM c WHERE cum <= 0.9 OR r = 1) SELECT vec_id, count(*) AS n, string_agg(i, ' ' ORDER BY r) AS indices, round(max(q) / sum(q), 6) AS top FROM k GROUP BY 1""")
def nucleus(spark, sf_dir):
    kept = evals.nucleus(_logits(spark, sf_dir), "z", "vec_id", 0.9)
    order = F.sort_array(F.collect_list(F.struct("rank", "index")))
    return kept.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(order, lambda x: x["index"].cast("string")), " ").alias("indices"), F.round(F.max("p"), 6).alias("top"))


@query("SELECT vec_id FROM embeddings WHERE vec_id < 16 * 9 ORDER BY md5('0:' || vec_id), vec_id LIMIT 40")
def position_sample(spark, sf_dir):
    return evals.position_sample(table(spark, sf_dir, "embeddings").select("vec_id"), "vec_id", 16, 9, 40)


@query()
def sequence_sample(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id")
    ids = evals.sequence_sample(e.agg(F.max("vec_id")).first()[0] + 1, 32)
    return e.where(F.col("vec_id").isin(ids))
