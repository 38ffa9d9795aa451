"""A training corpus from ``documents``: quality, near-duplicates, secrets, mixture, tokens.

Each stage takes (spark, docs, sf_dir), works on all that the one before it
kept, and is written as Parquet between stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, minhash, mixing, quality, queries, secrets
from corpusloom.sources.scratch import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: The part of its own expected tokens that each domain is to keep; clean text takes what the others lose.
KEEP = {"clean": None, "junk": 0.75, "toxic": 0.75}


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier scores at 0.3 or more.

    A null text scores as an empty one does; repeated rows stay or go
    together; whole texts are scored; an empty table stays empty, and columns
    beyond those of documents are not read.
    """
    labels = queries.training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    docs = docs.select(COLUMNS)
    return quality.keep_good(docs, quality.fit(docs, labels)).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (5 words, 0.8): the one with the smallest id.

    Rows without words are in no group and stay. Of rows that repeat an id and
    a text one stays; unlike texts stay even under one id. Groups are found
    over whole texts; an empty table stays empty.
    """
    return minhash.survivors(docs.select(COLUMNS)).select(COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked and n_chars counted anew.

    Null and empty texts stay as they are, and so do repeated rows; an empty
    table stays empty.
    """
    return secrets.redact(docs.select(COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their fitted rate says.

    A null or empty text is taken by the rate of its posterior; repeated rows
    are taken alike, and ties in the sampled labels go by id; an empty table
    stays empty.
    """
    labels = queries.domain_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mixing.mix(docs.select(COLUMNS), labels, KEEP, relative=True).select(COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, ids_sha256, decoded_sha256) of each row: its token ids, and digests to check them by.

    A null or empty text has no ids; a row that repeats is encoded as often;
    an empty table stays empty.
    """
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_texts(docs, path, public_tokenizers.PATTERN, digests=True)


STAGES = [
    ("quality", keep_good_quality),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_to_targets),
    ("tokens", tokenize),
]

#: No stage but the second can be said in SQL, so there is none for run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; the others are tables in the shared folder."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.save(docs)
    return docs
