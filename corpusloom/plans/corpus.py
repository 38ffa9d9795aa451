"""Queries of the document path: filters, decontamination, duplicates, packing and manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import builds, decontam, dedup, filters, packing, prompts, provenance
from corpusloom.sources import files
from corpusloom.sources.scratch import Scratch
from corpusloom.sources.tables import read_table as table
from corpusloom.sources.tables import spread

L, PER_SHARD, BATCH = 256, 64, 4

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def documents(spark, sf_dir, *columns):
    """The documents over all cores, as every query here works on each text."""
    return spread(table(spark, sf_dir, "documents").select(*(columns or ("*",))))


# --- scans ---------------------------------------------------------------------------------------------------------


@query("""SELECT doc_id, source || '#' || (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) AS synthetic_id,
 coalesce(text, '') AS text, source, lang AS language FROM documents""")
def doc_scan(spark, sf_dir):
    d = packing.running_start(table(spark, sf_dir, "documents"), "source", "doc_id", F.lit(1))
    return d.select(
        "doc_id", F.concat("source", F.lit("#"), "start").alias("synthetic_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), "source", F.col("lang").alias("language")
    )


@query("SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 100 OFFSET 20")
def offset_limit(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source").orderBy("doc_id").offset(20).limit(100)


@query("""SELECT 'set#' || (row_number() OVER (ORDER BY doc_id) - 1) AS doc_id, 'set' AS dataset, concat_ws(chr(10) || chr(10), lang, text) AS text FROM documents
 QUALIFY row_number() OVER (ORDER BY doc_id) - 1 BETWEEN 20 AND 149""")
def read_documents(spark, sf_dir):
    return files.read_documents(table(spark, sf_dir, "documents"), "set", ["lang", "text"], order_by="doc_id", skip_first=20, sample_limit=130)


@query("""SELECT source, count(*) AS n, cast(floor(sum(length(text)) / count(*)) AS BIGINT) AS mean_chars, count(*) > 0 AS passed
 FROM documents GROUP BY source""")
def source_smoke(spark, sf_dir):
    n = F.count(F.lit(1))
    return table(spark, sf_dir, "documents").groupBy("source").agg(
        n.alias("n"), F.floor(F.sum(F.length("text")) / n).cast("long").alias("mean_chars"), (n > 0).alias("passed")
    )


@query("SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def conversation_concat(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    turns = F.sort_array(F.collect_list(F.struct("turn", "text")))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda t: t.text), "\n\n").alias("text"))


@query("""SELECT doc_id, translate(substr(text, 1, 200000), chr(10) || chr(13), '  ') AS line FROM documents WHERE length(text) >= 50""")
def tokenizer_corpus_lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(F.length("text") >= 50)
    return d.select("doc_id", F.translate(F.substring("text", 1, 200_000), "\n\r", "  ").alias("line"))


# --- filters -------------------------------------------------------------------------------------------------------

_SHARES = f"""w AS (SELECT *, {T.words_sql("text")} AS ws, length(text) AS n FROM documents),
wc AS (SELECT doc_id, max(c) AS c FROM (SELECT doc_id, x, count(*) AS c FROM (SELECT doc_id, unnest(ws) AS x FROM w) GROUP BY ALL) GROUP BY 1),
gc AS (SELECT doc_id, max(c) AS c FROM (SELECT doc_id, x, count(*) AS c FROM (SELECT doc_id, unnest({T.ngrams_sql("ws", 5)}) AS x FROM w WHERE len(ws) >= 5) GROUP BY ALL) GROUP BY 1),
s AS (SELECT w.*, wc.c / len(ws) AS top, coalesce(gc.c / (len(ws) - 4), 0) AS grams, length(regexp_replace(text, '[\\p{{L}}\\p{{N}}{T.WS_SQL[1:]}', '', 'g')) AS sym
 FROM w LEFT JOIN wc USING (doc_id) LEFT JOIN gc USING (doc_id))"""
_LENGTH = "CASE WHEN n < 200 THEN 'too_short' WHEN n > 1000000 THEN 'too_long' ELSE 'ok' END"
_REPEAT = "CASE WHEN len(ws) = 0 THEN 'empty' WHEN top > 0.2 THEN 'top_word_repeated' WHEN grams > 0.1 THEN 'top_ngram_repeated' ELSE 'ok' END"
_REPEAT_SCORE = "CASE WHEN len(ws) = 0 THEN 0 WHEN top > 0.2 THEN top WHEN grams > 0.1 THEN grams ELSE top END"
_SYMBOL = "CASE WHEN n = 0 THEN 'empty' WHEN sym / n > 0.3 THEN 'too_symbolic' ELSE 'ok' END"
_SYMBOL_SCORE = "CASE WHEN n = 0 THEN 0 ELSE sym / n END"
_CHAIN = f"CASE WHEN {_LENGTH} <> 'ok' THEN {_LENGTH} WHEN {_REPEAT} <> 'ok' THEN {_REPEAT} ELSE {_SYMBOL} END"


def _redact_sql(text: str, kinds=("email", "phone")) -> str:
    for k in kinds:
        text = f"regexp_replace({text}, '{T.PII[k]}', '<{k.upper()}>', 'g')"
    return text


def _offline_sql(columns: str) -> str:
    return f"WITH {_SHARES} SELECT {columns} FROM (SELECT doc_id, source, {_CHAIN} AS reason, CASE WHEN {_CHAIN} = 'ok' THEN {_redact_sql('text')} ELSE text END AS text FROM s)"


def _decided(spark, sf_dir, f):
    d = documents(spark, sf_dir, "doc_id", "text").select("doc_id", f(F.coalesce("text", F.lit(""))).alias("d"))
    return d.select("doc_id", F.col("d.keep").alias("keep"), F.col("d.reason").alias("reason"), F.round("d.score", 9).alias("score"))


def _decision_sql(reason: str, score: str) -> str:
    return f"WITH {_SHARES} SELECT doc_id, ({reason}) = 'ok' AS keep, {reason} AS reason, round(cast({score} AS DOUBLE), 9) AS score FROM s"


@query(_decision_sql(_LENGTH, "n"))
def filter_length(spark, sf_dir):
    return _decided(spark, sf_dir, filters.LengthFilter())


@query(_decision_sql(_REPEAT, _REPEAT_SCORE))
def filter_repetition(spark, sf_dir):
    return _decided(spark, sf_dir, filters.RepetitionFilter())


@query(_decision_sql(_SYMBOL, _SYMBOL_SCORE))
def filter_symbol_ratio(spark, sf_dir):
    return _decided(spark, sf_dir, filters.SymbolFilter())


@query(f"""SELECT doc_id, {_redact_sql('text')} AS text,
 cast(len(regexp_extract_all(text, '{T.PII["email"]}')) + len(regexp_extract_all(regexp_replace(text, '{T.PII["email"]}', '<EMAIL>', 'g'), '{T.PII["phone"]}')) AS BIGINT) AS n_redactions
 FROM documents""")
def pii_redact(spark, sf_dir):
    r = filters.PiiRedactor()
    return documents(spark, sf_dir, "doc_id", "text").select(
        "doc_id", r.redact(F.col("text")).alias("text"), r(F.col("text")).score.cast("long").alias("n_redactions")
    )


def _offline(spark, sf_dir):
    return filters.filter_documents(documents(spark, sf_dir, "doc_id", "source", "text"))


@query(_offline_sql("doc_id, source, reason, text"))
def filter_chain_offline(spark, sf_dir):
    return _offline(spark, sf_dir).select("doc_id", "source", "reason", "text")


@query(_offline_sql("source, reason, count(*) AS n") + " GROUP BY source, reason")
def reject_histogram(spark, sf_dir):
    return filters.reject_histogram(_offline(spark, sf_dir))


@query(f"SELECT doc_id, {T.normalise_sql('text')} AS normalised FROM documents")
def normalize_text(spark, sf_dir):
    return documents(spark, sf_dir, "doc_id", "text").select("doc_id", T.normalise(F.col("text")).alias("normalised"))


@query("""SELECT conv_id, turn, substr(text, 1, 8000) AS prompt FROM conversations WHERE role = 'user' AND trim(text) <> ''""")
def prompt_projection(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where((F.col("role") == "user") & (F.trim("text") != ""))
    return c.select("conv_id", "turn", F.substring("text", 1, 8000).alias("prompt"))


# --- decontamination -----------------------------------------------------------------------------------------------

_PROMPTS = "p AS (SELECT 'bench' || (item_id % 4) AS benchmark_id, text AS prompt FROM benchmark)"


def _index_sql(n: int, name: str = "i") -> str:
    return f"{name} AS (SELECT DISTINCT benchmark_id, unnest({T.ngrams_sql('ws', n)}) AS gram FROM (SELECT benchmark_id, {T.words_sql(T.normalise_sql('prompt'))} AS ws FROM p))"


def _scan_sql(n: int, name: str = "m", index: str = "i") -> str:
    return f"""{name} AS (SELECT doc_id, benchmark_id, count(*) AS n_matches FROM (SELECT doc_id, unnest({T.ngrams_sql('ws', n)}) AS gram
 FROM (SELECT doc_id, {T.words_sql(T.normalise_sql('text'))} AS ws FROM documents)) JOIN {index} USING (gram) GROUP BY ALL)"""


def _prompts(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.concat(F.lit("bench"), F.col("item_id") % 4).alias("benchmark_id"), F.col("text").alias("prompt"))


def _matches(spark, sf_dir, n):
    return decontam.scan(documents(spark, sf_dir, "doc_id", "text"), decontam.build_index(_prompts(spark, sf_dir), n), n)


@query(f"WITH {_PROMPTS}, {_index_sql(13)} SELECT benchmark_id, (SELECT count(*) FROM p WHERE p.benchmark_id = b.benchmark_id) AS n_examples, (SELECT count(*) FROM i WHERE i.benchmark_id = b.benchmark_id) AS n_ngrams FROM (SELECT DISTINCT benchmark_id FROM p) b")
def bench_index_sizes(spark, sf_dir):
    p = _prompts(spark, sf_dir)
    return decontam.index_sizes(p, decontam.build_index(p, 13))


def _scan_query(n: int):
    def f(spark, sf_dir):
        return _matches(spark, sf_dir, n)

    f.__name__ = f"decontam_scan_{n}"
    return query(f"WITH {_PROMPTS}, {_index_sql(n)}, {_scan_sql(n)} SELECT * FROM m")(f)


for _n in (13, 8, 5):
    _scan_query(_n)


@query(f"WITH {_PROMPTS}, {_index_sql(13)}, {_scan_sql(13)} SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM m)")
def decontam_keep(spark, sf_dir):
    return decontam.keep_clean(table(spark, sf_dir, "documents").select("doc_id", "source"), _matches(spark, sf_dir, 13))


@query(f"WITH {_PROMPTS}, {_index_sql(13)}, {_scan_sql(13)} SELECT doc_id, cast(coalesce(sum(n_matches), 0) AS BIGINT) AS n_matches, coalesce(sum(n_matches), 0) > 0 AS contaminated FROM documents LEFT JOIN m USING (doc_id) GROUP BY doc_id")
def decontam_tag(spark, sf_dir):
    return decontam.tag(table(spark, sf_dir, "documents").select("doc_id"), _matches(spark, sf_dir, 13))


_DUAL = f"WITH {_PROMPTS}, {_index_sql(13)}, {_scan_sql(13)}, {_index_sql(8, 'j')}, {_scan_sql(8, 'k', 'j')}"


@query(f"{_DUAL} SELECT doc_id, benchmark_id, cast(sum(n_matches) AS BIGINT) AS n_matches FROM (SELECT * FROM m UNION ALL SELECT * FROM k) GROUP BY ALL")
def decontam_dual(spark, sf_dir):
    both = decontam.scan_modes(documents(spark, sf_dir, "doc_id", "text"), _prompts(spark, sf_dir), {"primary": 13, "secondary": 8})
    return both.groupBy("doc_id", "benchmark_id").agg(F.sum("n_matches").alias("n_matches"))


@query(f"{_DUAL} SELECT benchmark_id, count(DISTINCT doc_id) AS matched_docs FROM k GROUP BY 1")
def decontam_secondary(spark, sf_dir):
    return _matches(spark, sf_dir, 8).groupBy("benchmark_id").agg(F.countDistinct("doc_id").alias("matched_docs"))


@query(f"""WITH {_PROMPTS}, {_index_sql(13)}, {_scan_sql(13)} SELECT benchmark_id, n_examples, matched_docs, scanned_docs, any_docs, round(matched_docs / scanned_docs, 6) AS rate, example_ids FROM (
 SELECT b.benchmark_id, b.n_examples, (SELECT count(DISTINCT doc_id) FROM m WHERE m.benchmark_id = b.benchmark_id) AS matched_docs, (SELECT count(*) FROM documents) AS scanned_docs, (SELECT count(DISTINCT doc_id) FROM m) AS any_docs,
 (SELECT array_to_string(list_sort(list(DISTINCT doc_id))[1:20], ' ') FROM m WHERE m.benchmark_id = b.benchmark_id) AS example_ids
 FROM (SELECT benchmark_id, count(*) AS n_examples FROM p GROUP BY 1) b)""")
def decontam_report(spark, sf_dir):
    r = decontam.report(table(spark, sf_dir, "documents"), _prompts(spark, sf_dir), _matches(spark, sf_dir, 13))
    return r.withColumn("example_ids", F.array_join(F.transform("example_ids", lambda i: i.cast("string")), " "))


# --- duplicates ----------------------------------------------------------------------------------------------------

_SHINGLES = f"""sh AS (SELECT doc_id, source, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE {T.ngrams_sql('ws', 5)} END)) AS g
 FROM (SELECT doc_id, source, {T.words_sql('text')} AS ws FROM documents))"""


@query(f"WITH {_SHINGLES} SELECT doc_id, (SELECT count(*) FROM sh WHERE sh.doc_id = d.doc_id) AS n_shingles FROM documents d")
def shingle_counts(spark, sf_dir):
    return documents(spark, sf_dir, "doc_id", "text").select("doc_id", F.size(T.shingles(F.col("text"))).cast("long").alias("n_shingles"))


@query("SELECT sha256(text) AS text_sha256, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY text HAVING count(*) > 1")
def exact_dup_groups(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("text_sha256"))
    return d.agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query()
def minhash_signature(spark, sf_dir):
    s = dedup.signatures(documents(spark, sf_dir, "doc_id", "text"))
    return s.select("doc_id", F.array_join(F.transform("signature", lambda x: x.cast("string")), ",").alias("signature"))


@query()
def lsh_candidates(spark, sf_dir):
    signed = Scratch(spark, "candidates").save(dedup.signatures(documents(spark, sf_dir, "doc_id", "source", "text"), extra=["source"]))
    return dedup.candidates(signed, group="source").select("a", "b", "estimate")


@query()
def minhash_dedup(spark, sf_dir):
    return dedup.greedy_keep(documents(spark, sf_dir, "doc_id", "source", "text"), group="source")


@query(f"""WITH {_SHINGLES}, n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.source = b.source AND a.doc_id < b.doc_id GROUP BY ALL)
 SELECT a, b, round(c / (x.n + y.n - c), 9) AS jaccard FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 4 * c >= 3 * (x.n + y.n - c)""")
def jaccard_pairs_exact(spark, sf_dir):
    return dedup.exact_pairs(documents(spark, sf_dir, "doc_id", "source", "text"), 75, group="source").select("a", "b", F.round("jaccard", 9).alias("jaccard"))


# --- packing -------------------------------------------------------------------------------------------------------

_PLACED = f"""t AS (SELECT source, doc_id, {T.words_sql('text')} AS ws FROM documents),
q AS (SELECT source, doc_id, ws, len(ws) AS n, sum(len(ws) + 1) OVER (PARTITION BY source ORDER BY doc_id) - len(ws) - 1 AS st FROM t WHERE len(ws) > 0),
tot AS (SELECT source, sum(n + 1) AS total FROM q GROUP BY 1)"""


def _spans_sql(drop_last: bool) -> str:
    end = f"least(st + n + 1, total // {L} * {L})" if drop_last else "st + n + 1"
    return f"""{_PLACED}, e AS (SELECT source, doc_id, ws, cast(st AS BIGINT) AS st, cast({end} AS BIGINT) AS en FROM q JOIN tot USING (source)),
sp AS (SELECT source, doc_id, st, unnest(range(st // {L}, (en - 1) // {L} + 1)) AS seq, en FROM e WHERE st < en),
spans AS (SELECT source, seq, doc_id, cast(greatest(st, seq * {L}) - seq * {L} AS INTEGER) AS token_start, cast(least(en, seq * {L} + {L}) - seq * {L} AS INTEGER) AS token_end FROM sp),
nums AS (SELECT source, coalesce(sum(n) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM (SELECT source, max(seq) + 1 AS n FROM spans GROUP BY 1)),
ids AS (SELECT spans.*, cast(off + seq AS BIGINT) AS sequence_id FROM spans JOIN nums USING (source))"""


def _sized(spark, sf_dir):
    return documents(spark, sf_dir, "source", "doc_id", "text").select("source", "doc_id", F.size(T.words(F.col("text"))).alias("n_tokens"))


def _spans(spark, sf_dir, drop_last=True):
    return packing.pack_spans(_sized(spark, sf_dir), L, drop_last).drop("from_token")


def _ids(spark, sf_dir):
    scratch = Scratch(spark, "ids")
    return scratch.save(packing.number_sequences(scratch.save(_spans(spark, sf_dir))))


@query(f"SELECT doc_id, array_to_string(list_transform({T.words_sql('text')}, lambda w: {T.word_id_sql('w')}), ' ') AS tokens FROM documents")
def word_tokens(spark, sf_dir):
    d = packing.word_tokens(documents(spark, sf_dir, "doc_id", "text"))
    return d.select("doc_id", F.array_join(F.transform("tokens", lambda t: t.cast("string")), " ").alias("tokens"))


@query(f"WITH {_spans_sql(True)} SELECT * FROM spans")
def pack_spans(spark, sf_dir):
    return _spans(spark, sf_dir)


@query(f"WITH {_spans_sql(False)} SELECT * FROM spans")
def pack_spans_padded(spark, sf_dir):
    return _spans(spark, sf_dir, drop_last=False)


@query(f"""WITH {_PLACED}, tk AS (SELECT source, st + unnest(range(0, n + 1)) AS pos, unnest(list_append(list_transform(ws, lambda w: {T.word_id_sql('w')}), {packing.EOS})) AS tok FROM q)
 SELECT source, cast(pos // {L} AS BIGINT) AS seq, string_agg(tok, ' ' ORDER BY pos) AS tokens FROM tk JOIN tot USING (source) WHERE pos < total // {L} * {L} GROUP BY ALL""")
def pack_sequences(spark, sf_dir):
    return _sequences(spark, sf_dir).select("source", "seq", F.array_join(F.transform("tokens", lambda t: t.cast("string")), " ").alias("tokens"))


def _sequences(spark, sf_dir):
    return packing.pack_sequences(packing.word_tokens(documents(spark, sf_dir, "source", "doc_id", "text")).select("source", "doc_id", "tokens"), L)


_SEGMENTS = f"""seg AS (SELECT sequence_id, string_agg(rn, ' ' ORDER BY pos) AS segments FROM (SELECT sequence_id, rn, unnest(range(token_start, token_end)) AS pos
 FROM (SELECT *, row_number() OVER (PARTITION BY sequence_id ORDER BY token_start) - 1 AS rn FROM ids)) GROUP BY 1)"""


@query(f"WITH {_spans_sql(True)}, {_SEGMENTS} SELECT * FROM seg")
def segment_ids(spark, sf_dir):
    s = packing.segment_ids(_ids(spark, sf_dir), L)
    return s.select("sequence_id", F.array_join(F.transform("segments", lambda x: x.cast("string")), " ").alias("segments"))


_PLACES = f"""{_PLACED}, tk AS (SELECT source, doc_id, st + unnest(range(0, n + 1)) AS pos, unnest(list_append(list_transform(ws, lambda w: {T.word_id_sql('w')}), {packing.EOS})) AS tok FROM q),
pl AS (SELECT source, cast(pos // {L} AS BIGINT) AS seq, pos, pos % {L} AS place, tok, CASE WHEN lag(doc_id) OVER (PARTITION BY source ORDER BY pos) = doc_id THEN 1 ELSE 0 END AS mask FROM tk JOIN tot USING (source) WHERE pos < total // {L} * {L})"""


@query(f"""WITH {_PLACES} SELECT source, seq, md5(string_agg(tok, ' ' ORDER BY pos) FILTER (place < {L - 1})) AS inputs, md5(string_agg(tok, ' ' ORDER BY pos) FILTER (place > 0)) AS labels,
 md5(string_agg(mask, ' ' ORDER BY pos) FILTER (place > 0)) AS loss_mask, cast(sum(mask) FILTER (place > 0) AS BIGINT) AS loss_positions FROM pl GROUP BY ALL""")
def input_label_pairs(spark, sf_dir):
    segments = packing.segment_ids(_spans(spark, sf_dir), L, ["source", "seq"])
    pairs = packing.input_label_pairs(_sequences(spark, sf_dir).join(segments, ["source", "seq"]))
    text = lambda c: F.md5(F.array_join(F.transform(c, lambda x: x.cast("string")), " ")).alias(c)
    total = F.aggregate("loss_mask", F.lit(0).cast("long"), lambda a, x: a + x)
    return pairs.select("source", "seq", text("inputs"), text("labels"), text("loss_mask"), total.alias("loss_positions"))


@query(f"WITH {_spans_sql(True)} SELECT row_number() OVER (ORDER BY sequence_id, token_start) - 1 AS doc_span_id, sequence_id, doc_id, token_start, token_end FROM ids")
def doc_span_ids(spark, sf_dir):
    return packing.number_spans(_ids(spark, sf_dir)).select("doc_span_id", "sequence_id", "doc_id", "token_start", "token_end")


@query(f"""WITH {_spans_sql(True)}, d AS (SELECT source, doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS document FROM q),
 x AS (SELECT sequence_id, document, unnest(range(token_start, token_end)) AS pos FROM ids JOIN d USING (source, doc_id)) SELECT sequence_id, string_agg(document, ' ' ORDER BY pos) AS documents FROM x GROUP BY 1""")
def segment_ids_global(spark, sf_dir):
    ids = _ids(spark, sf_dir).join(packing.document_numbers(_sized(spark, sf_dir)), ["source", "doc_id"])
    out = packing.per_place(ids, L, F.col("document"), "documents")
    return out.select("sequence_id", F.array_join(F.transform("documents", lambda x: x.cast("string")), " ").alias("documents"))


_VOCAB = "v AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS k FROM (SELECT DISTINCT source FROM ids WHERE source NOT LIKE '%7'))"


def _token_sources(spark, sf_dir):
    ids = _ids(spark, sf_dir)
    return provenance.token_sources(ids, provenance.source_vocab(ids.where("source NOT LIKE '%7'")), L)


@query(f"WITH {_spans_sql(True)}, {_VOCAB}, x AS (SELECT sequence_id, coalesce(k, -1) AS k, unnest(range(token_start, token_end)) AS pos FROM ids LEFT JOIN v USING (source)) SELECT sequence_id, string_agg(k, ' ' ORDER BY pos) AS sources FROM x GROUP BY 1")
def token_source_ids(spark, sf_dir):
    return _token_sources(spark, sf_dir).select("sequence_id", F.array_join(F.transform("sources", lambda x: x.cast("string")), " ").alias("sources"))


@query(f"""WITH {_spans_sql(True)}, {_VOCAB}, x AS (SELECT sequence_id, coalesce(k, -1) AS k, unnest(range(token_start, token_end)) AS pos FROM ids LEFT JOIN v USING (source) WHERE sequence_id < 50 // {BATCH} * {BATCH})
 SELECT sequence_id // {BATCH} AS batch, sequence_id % {BATCH} AS row, sequence_id, string_agg(k, ' ' ORDER BY pos) FILTER (pos > 0) AS label_sources FROM x GROUP BY sequence_id""")
def label_sources(spark, sf_dir):
    held = provenance.label_sources(_token_sources(spark, sf_dir), 50, BATCH)
    return held.select("batch", "row", "sequence_id", F.array_join(F.transform("label_sources", lambda x: x.cast("string")), " ").alias("label_sources"))


@query(f"WITH {_spans_sql(True)} SELECT sequence_id, doc_id, token_start, token_end FROM ids WHERE sequence_id IN (SELECT event_id * 3 FROM events)")
def get_provenance(spark, sf_dir):
    asked = table(spark, sf_dir, "events").select((F.col("event_id") * 3).alias("sequence_id"))
    return provenance.provenance(_ids(spark, sf_dir), asked).select("sequence_id", "doc_id", "token_start", "token_end")


@query(f"WITH {_spans_sql(True)}, {_SEGMENTS}, p AS (SELECT sequence_id, string_split(segments, ' ') AS s FROM seg) SELECT sequence_id, segment, count(*) AS n FROM (SELECT sequence_id, cast(unnest(s) AS BIGINT) AS segment FROM p) GROUP BY ALL")
def segment_histogram(spark, sf_dir):
    return provenance.segment_histogram(packing.segment_ids(_ids(spark, sf_dir), L))


@query(f"""SELECT doc_id, array_to_string(ids[1:8], ' ') AS head, CASE WHEN len(ids) > 8 THEN array_to_string(ids[-8:], ' ') ELSE '' END AS tail
 FROM (SELECT doc_id, list_transform({T.words_sql('text')}, lambda w: {T.word_id_sql('w')}) AS ids FROM documents)""")
def token_preview(spark, sf_dir):
    d = packing.word_tokens(documents(spark, sf_dir, "doc_id", "text")).select("doc_id", provenance.token_preview(F.col("tokens"), 8).alias("p"))
    text = lambda c: F.array_join(F.transform(c, lambda t: t.cast("string")), " ")
    return d.select("doc_id", text("p.head").alias("head"), text("p.tail").alias("tail"))


@query(f"WITH {_spans_sql(True)}, u AS (SELECT DISTINCT sequence_id AS s FROM ids) SELECT s AS sequence_id, s // {PER_SHARD} AS shard_id, s % {PER_SHARD} AS local_id, s % {PER_SHARD} * {L} AS token_offset, s % {PER_SHARD} * {L * 4} AS byte_offset FROM u")
def seek_math(spark, sf_dir):
    return packing.seek(_ids(spark, sf_dir).select("sequence_id").distinct(), L, PER_SHARD)


@query(f"WITH {_SHARES}, k AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM s WHERE {_CHAIN} = 'ok') SELECT doc_id, source FROM k WHERE r <= 7")
def sample_limit(spark, sf_dir):
    kept = Scratch(spark, "kept").save(_offline(spark, sf_dir).where("reason = 'ok'").select("source", "doc_id"))
    return packing.first_kept(kept, 7).select("doc_id", "source")


@query(f"WITH {_spans_sql(True)} SELECT sequence_id, source, cast(sum(token_end - token_start) AS BIGINT) AS n_tokens FROM ids GROUP BY ALL")
def source_mix(spark, sf_dir):
    return packing.source_mix(_ids(spark, sf_dir))


@query(f"WITH {_spans_sql(True)}, u AS (SELECT DISTINCT sequence_id FROM ids) SELECT sequence_id // {BATCH} AS batch, min(sequence_id) AS first_id, max(sequence_id) AS last_id FROM u GROUP BY 1 HAVING count(*) = {BATCH}")
def batch_groups(spark, sf_dir):
    return packing.batches(_ids(spark, sf_dir).select("sequence_id").distinct(), BATCH)


@query(f"""WITH {_spans_sql(True)}, u AS (SELECT DISTINCT sequence_id FROM ids), t0 AS (SELECT max(sequence_id) + 1 AS total FROM u)
 SELECT sequence_id, CASE WHEN sequence_id >= 3 THEN sequence_id - 3 ELSE sequence_id - 3 + total END + lap * total AS position FROM u, t0, (SELECT unnest([0, 1]) AS lap)""")
def epoch_cycle(spark, sf_dir):
    return packing.epochs(_ids(spark, sf_dir).select("sequence_id").distinct(), 3, 2)


@query(f"WITH {_spans_sql(True)} SELECT DISTINCT sequence_id, sequence_id // {PER_SHARD} AS shard_id, sequence_id % {PER_SHARD} AS local_id, sequence_id % {PER_SHARD} * {L * 4} AS byte_offset FROM ids WHERE sequence_id >= 1000 // {L - 1}")
def resume_from_cursor(spark, sf_dir):
    u = _ids(spark, sf_dir).select("sequence_id").distinct().where(F.col("sequence_id") >= packing.cursor_of(F.lit(1000), L))
    return packing.seek(u, L, PER_SHARD).drop("token_offset")


@query(f"WITH {_spans_sql(True)} SELECT DISTINCT sequence_id FROM ids WHERE sequence_id < ceil(10000 / {L})")
def target_token_cut(spark, sf_dir):
    return _ids(spark, sf_dir).select("sequence_id").distinct().where(F.col("sequence_id") < -(-10_000 // L))


@query(f"""WITH {_spans_sql(True)} SELECT sequence_id // {PER_SHARD} AS shard_id, count(DISTINCT sequence_id) AS n_sequences, min(sequence_id) AS first_id, max(sequence_id) AS last_id,
 count(*) AS n_spans, cast(count(DISTINCT sequence_id) * {L} AS BIGINT) AS n_tokens FROM ids GROUP BY 1""")
def shard_manifest(spark, sf_dir):
    s = _ids(spark, sf_dir).groupBy("sequence_id").agg(F.count(F.lit(1)).alias("k"))
    n = F.count(F.lit(1))
    return s.groupBy(F.floor(F.col("sequence_id") / PER_SHARD).alias("shard_id")).agg(
        n.alias("n_sequences"), F.min("sequence_id").alias("first_id"), F.max("sequence_id").alias("last_id"), F.sum("k").alias("n_spans"), (n * L).alias("n_tokens")
    )


@query(f"""WITH {_spans_sql(True)} SELECT source, cast(sum(token_end - token_start) AS BIGINT) AS n_tokens, round(sum(token_end - token_start) / (SELECT count(DISTINCT sequence_id) * {L} FROM ids), 9) AS share FROM ids GROUP BY 1""")
def corpus_manifest(spark, sf_dir):
    ids = _ids(spark, sf_dir)
    total = ids.agg((F.countDistinct("sequence_id") * L).alias("total"))  # one row
    mix = ids.groupBy("source").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("n_tokens"))
    return mix.crossJoin(F.broadcast(total)).select("source", "n_tokens", F.round(F.col("n_tokens") / F.col("total"), 9).alias("share"))


_MIX = f"{_spans_sql(True)}, mx AS (SELECT sequence_id, source, cast(sum(token_end - token_start) AS BIGINT) AS n FROM ids GROUP BY ALL), dom AS (SELECT sequence_id, arg_min(source, (-n, source)) AS dominant, count(*) AS k FROM mx GROUP BY 1)"


def _incident_labels(spark, sf_dir, legacy=False):
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 11 != 5, F.col("event_id") * 37).alias("data_position"))
    placed = provenance.incident_sequences(e, L, legacy)
    return provenance.attribute(placed, provenance.mix_labels(packing.source_mix(_ids(spark, sf_dir))))


@query(f"WITH {_MIX} SELECT event_id, event_id * 37 AS data_position, event_id * 37 // {L - 1} AS sequence_id, coalesce(dominant, '<unmapped>') AS dominant FROM events LEFT JOIN dom ON sequence_id = event_id * 37 // {L - 1} WHERE event_id % 11 <> 5")
def incident_sources(spark, sf_dir):
    return _incident_labels(spark, sf_dir).select("event_id", "data_position", "sequence_id", "dominant")


@query(f"WITH {_MIX} SELECT coalesce(dominant, '<unmapped>') AS dominant, count(*) AS n FROM events LEFT JOIN dom ON sequence_id = event_id * 37 // {L} WHERE event_id % 11 <> 5 GROUP BY 1")
def incident_sources_legacy(spark, sf_dir):
    return _incident_labels(spark, sf_dir, legacy=True).groupBy("dominant").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_spans_sql(True)}, s AS (SELECT DISTINCT sequence_id // {PER_SHARD} AS shard_id, sequence_id FROM ids), c AS (SELECT shard_id, count(*) AS n FROM s GROUP BY 1), m AS (SELECT * FROM c WHERE shard_id % 5 <> 2),
 j AS (SELECT c.shard_id, m.n, CASE WHEN c.shard_id % 4 = 1 THEN 'b' ELSE 'a' END AS sha FROM c LEFT JOIN m USING (shard_id))
 SELECT count(*) AS n_shards, count(*) FILTER (n IS NULL) AS n_missing, count(*) FILTER (n < {PER_SHARD} AND shard_id < (SELECT max(shard_id) FROM c)) AS n_short, count(*) FILTER (n IS NOT NULL AND sha <> 'a') AS n_other_tokenizer,
 count(*) FILTER (n IS NULL) = 0 AND count(*) FILTER (n < {PER_SHARD} AND shard_id < (SELECT max(shard_id) FROM c)) = 0 AND count(*) FILTER (n IS NOT NULL AND sha <> 'a') = 0 AS passed FROM j""")
def manifest_completeness(spark, sf_dir):
    m = shard_manifest(spark, sf_dir).withColumn("tokenizer_sha256", F.when(F.col("shard_id") % 4 == 1, "b").otherwise("a"))
    return files.completeness(m.select("shard_id"), m.where("shard_id % 5 <> 2"), PER_SHARD, "a")


@query(f"WITH {_spans_sql(True)}, c AS (SELECT count(DISTINCT sequence_id) AS n, max(sequence_id) AS hi FROM ids) SELECT hi // {PER_SHARD} + 1 AS n_shards, n AS n_sequences, n * {L} AS n_tokens, 0 AS first_id, hi AS last_id FROM c")
def corpus_summary(spark, sf_dir):
    m = shard_manifest(spark, sf_dir).withColumn("sequence_length", F.lit(L)).withColumn("tokenizer_sha256", F.lit("a"))
    return files.corpus_summary(m)


# --- prompts -------------------------------------------------------------------------------------------------------

_KIND = "['mmlu-pro', 'humaneval-plus', 'mbpp-plus', 'gsm8k', 'math', 'mgsm', 'bbh', 'ifeval'][item_id % 8 + 1]"


@query(f"""WITH b AS (SELECT item_id, text, {_KIND} AS bench, item_id // 8 % 3 AS config FROM benchmark),
 p AS (SELECT bench, item_id, config, CASE bench WHEN 'mmlu-pro' THEN trim(text) || ' one two' ELSE text END AS prompt FROM b WHERE trim(text) <> '' AND NOT (bench = 'bbh' AND item_id % 5 = 0) AND NOT (bench IN ('ifeval') AND item_id % 3 = 0)),
 r AS (SELECT *, row_number() OVER (PARTITION BY bench, CASE WHEN bench IN ('mgsm', 'bbh') THEN config END ORDER BY item_id) AS r FROM p)
 SELECT bench AS benchmark_id, item_id AS id, substr(prompt, 1, 8000) AS prompt FROM r WHERE r <= 4""")
def prompt_loaders(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").withColumn("id", F.col("item_id")).withColumn("config", F.floor(F.col("item_id") / 8) % 3)
    given = {
        "mmlu-pro": {"question": F.col("text"), "options": F.array(F.lit("one"), F.lit("two"))},
        "humaneval-plus": {"prompt": F.col("text")},
        "mbpp-plus": {"prompt": F.when(F.col("item_id") % 2 == 0, F.col("text")), "text": F.col("text")},
        "gsm8k": {"question": F.col("text")},
        "math": {"problem": F.col("text")},
        "mgsm": {"question": F.col("text")},
        "bbh": {"input": F.when(F.col("item_id") % 5 == 0, F.lit(" ")).otherwise(F.col("text"))},
        "ifeval": {"prompt": F.col("text"), "split": F.when(F.col("item_id") % 3 == 0, "test").otherwise("train")},
    }
    out = None
    for i, (name, columns) in enumerate(given.items()):
        rows = b.where(F.col("item_id") % 8 == i).select("id", "config", *(c.alias(k) for k, c in columns.items()))
        part = prompts.load_prompts(name, rows, sample=4)
        out = part if out is None else out.unionByName(part)
    return out


# --- builds --------------------------------------------------------------------------------------------------------


def _built_sql(decided: str) -> str:
    """Statistics of a build, from ``r0`` (doc_id, source, reason, text) and ``hit`` (doc_id) that ``decided`` defines."""
    kept = "reason = 'ok' AND hit.doc_id IS NULL"
    tokens = f"coalesce(sum(len({T.words_sql('text')}) + 1) FILTER ({kept}), 0)"
    return f"""{decided} SELECT source, count(*) AS docs_seen, count(*) FILTER (reason <> 'ok') AS docs_filtered, count(*) FILTER (hit.doc_id IS NOT NULL) AS docs_contaminated,
 count(*) FILTER ({kept}) AS docs_kept, cast({tokens} AS BIGINT) AS n_tokens, cast({tokens} // {L} AS BIGINT) AS n_sequences FROM r0 LEFT JOIN hit USING (doc_id) GROUP BY source"""


_HIT = f"hit AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest({T.ngrams_sql('ws', 13)}) AS gram FROM (SELECT doc_id, {T.words_sql(T.normalise_sql('text'))} AS ws FROM r0 WHERE reason = 'ok')) JOIN i USING (gram))"
_R0 = f"r0 AS (SELECT doc_id, source, {_CHAIN} AS reason, CASE WHEN {_CHAIN} = 'ok' THEN {{}} ELSE text END AS text FROM s)"


@query(_built_sql(f"WITH {_SHARES}, {_R0.format(_redact_sql('text'))}, {_PROMPTS}, {_index_sql(13)}, {_HIT}"))
def build_stats(spark, sf_dir):
    built = builds.decide(documents(spark, sf_dir, "doc_id", "source", "text"), decontam.build_index(_prompts(spark, sf_dir), 13), 13)
    return builds.statistics(built, L).drop("docs_deduped")


@query()
def build_stats_dedup(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id", "source", "text")
    return builds.statistics(builds.decide(docs, decontam.build_index(_prompts(spark, sf_dir), 13), 13, dedup.MinHashConfig()), L)


@query(f"""WITH {_SHARES}, {_R0.format('text')}, {_PROMPTS}, {_index_sql(13)}, {_HIT} SELECT doc_id, source, CASE WHEN hit.doc_id IS NOT NULL THEN 'contaminated' ELSE reason END AS reason,
 CASE WHEN reason = 'ok' AND hit.doc_id IS NULL THEN {_redact_sql('text')} ELSE text END AS text FROM r0 LEFT JOIN hit USING (doc_id)""")
def filter_chain_live(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id", "source", "text")
    return filters.filter_live(docs, decontam.build_index(_prompts(spark, sf_dir), 13), 13).select("doc_id", "source", "reason", "text")


@query(f"WITH {_PROMPTS}, {_index_sql(13)} SELECT benchmark_id, count(*) AS n_ngrams, md5(string_agg(gram, chr(10) ORDER BY gram)) AS digest FROM i GROUP BY 1")
def index_round_trip(spark, sf_dir):
    lines = decontam.index_json(decontam.build_index(_prompts(spark, sf_dir), 13), 13)
    back = decontam.index_from_json(lines, 13).groupBy("benchmark_id")
    return back.agg(F.count(F.lit(1)).alias("n_ngrams"), F.md5(F.array_join(F.sort_array(F.collect_list("gram")), "\n")).alias("digest"))


@query(f"WITH {_PROMPTS}, {_index_sql(13)}, {_scan_sql(13)} SELECT doc_id, coalesce(sum(n_matches), 0) = 0 AS keep, CASE WHEN coalesce(sum(n_matches), 0) > 0 THEN 'contaminated' ELSE 'ok' END AS reason, cast(coalesce(sum(n_matches), 0) AS DOUBLE) AS score FROM documents LEFT JOIN m USING (doc_id) GROUP BY doc_id")
def filter_decontam(spark, sf_dir):
    return decontam.decide(table(spark, sf_dir, "documents").select("doc_id"), _matches(spark, sf_dir, 13)).select("doc_id", "keep", "reason", "score")


@query(f"""WITH {_PROMPTS}, {_index_sql(13)}, {_scan_sql(13)} SELECT benchmark_id, benchmark_id || ',' || n_examples || ',' || matched_docs || ',' || scanned_docs || ',' || format('{{:.6f}}', matched_docs / scanned_docs) AS line FROM (
 SELECT b.benchmark_id, b.n_examples, (SELECT count(DISTINCT doc_id) FROM m WHERE m.benchmark_id = b.benchmark_id) AS matched_docs, (SELECT count(*) FROM documents) AS scanned_docs FROM (SELECT benchmark_id, count(*) AS n_examples FROM p GROUP BY 1) b)""")
def report_csv(spark, sf_dir):
    return decontam.report_lines(decontam.report(table(spark, sf_dir, "documents"), _prompts(spark, sf_dir), _matches(spark, sf_dir, 13)))
