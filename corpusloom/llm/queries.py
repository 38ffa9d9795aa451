"""The ten operators applied to the standard tables, each to its whole table, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, chat, imatch, media, minhash, mixing, neighbours, quality, secrets, urls, warc

#: The rules of the URL query: fixed values.
URL_RULES = [
    urls.Rule("block", "com", "/en/"),
    urls.Rule("allow", "example.com", "/en/7"),
    urls.Rule("block", "net", "/de/"),
    urls.Rule("block", "example.net", "/de/8"),
    urls.Rule("block", "org", "/es/"),
]

#: Target shares of the tokens by domain, of the query.
MIX_SHARES = {"clean": 0.84, "junk": 0.08, "toxic": 0.08}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def training_labels(labels: DataFrame) -> DataFrame:
    """The labels that a model may learn from: crc32 of the id's text isn't divisible by 5."""
    return labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)


def domain_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, domain): toxic, else junk for quality 0, else clean."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "junk").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", domain.alias("domain"))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), minhash.NearDupConfig(shingle_words=4))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, training_labels(_table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return quality.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted")
    )


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_texts(_table(spark, sf_dir, "documents"))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    out = mixing.mix_rates(docs, domain_labels(labels), MIX_SHARES)
    p = [F.round(F.col("posterior")[i], 6).alias(f"p_{d}") for i, d in enumerate(MIX_SHARES)]
    return out.select("doc_id", "n_tokens", *p, F.round("rate", 6).alias("rate"), "copies")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = [r.kind for r in secrets.BASE_RULES]
    found = secrets.scan(_table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("secrets", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    span = lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))
    plain = F.array_join(F.transform(F.filter("secrets", lambda s: s.kind.isin(base)), span), ",")
    return found.select(
        "doc_id", *map(count, base), F.sha2(plain, 256).alias("base_sha256"), F.array_join(F.transform("secrets", span), ",").alias("spans")
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives, _ = warc.archive_pages(_table(spark, sf_dir, "pages"))
    return warc.read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_texts(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, ids=False, digests=True)


def op9_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    fingerprint = imatch.Fingerprinter(docs)
    rows = neighbours.with_next(
        fingerprint.add(docs, "text", "fingerprint"), "doc_id", ["text"], {"next_text": "text", "next_fingerprint": "fingerprint"}
    )
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    done = fingerprint.add(edited, "edited", "edited_fingerprint")
    return done.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        imatch.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        imatch.likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(r"\### Assistant: </turn> ok").alias("text"),
    )
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    out = chat.format_conversations(turns)
    read = out.select(
        "conv_id",
        chat.parse_formatted(F.col("formatted")).alias("turns"),
        chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_quality": op2_quality,
    "op3_media": op3_media,
    "op4_urls": op4_urls,
    "op5_mixing": op5_mixing,
    "op6_secrets": op6_secrets,
    "op7_warc": op7_warc,
    "op8_bpe": op8_bpe,
    "op9_imatch": op9_imatch,
    "op10_chat": op10_chat,
}
