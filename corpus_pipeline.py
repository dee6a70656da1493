"""A corpus pipeline: language ID, near-duplicate removal, decontamination, secret redaction, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents, whatever others the table has. An empty table gives an
empty table at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontam, icws, langid, secrets
from tidemark.llm.shared import shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told (no text or no letter) go; a missing language is filled in.

    Whole texts count. Repeated rows stay, as do null ids, sources and counts; equal losses take the first language.
    """
    model = langid.train(docs.filter(~langid.held_out()))
    told = langid.predict(docs.select(*COLUMNS), model).filter(F.col("lang_pred") != langid.UNDETERMINED)
    return told.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest id stays.

    Ids need not differ: rows are told apart by id and text, a null id comes last, and equal ids are ordered by a hash of
    the text. Repeated rows become one. A null text counts as empty; texts without words are near only their equals.
    """
    return icws.keep_one(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go.

    Every row with such a text goes, repeated rows too, and no other row that shares its id. Null and empty texts stay.
    """
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts; no document goes.

    Repeated rows are each rewritten; a null text stays null, and n_chars counts the new text.
    """
    return secrets.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of what they decode to; a document without tokens goes.

    Repeated rows are each encoded; a null text has no tokens.
    """
    made = bpe.tokenize(docs, keep=("doc_id", "lang", "source", "n_chars"), outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256"))
    return made.filter("n_tokens > 0")


STAGES = [("language ID", language_id), ("near-dedup", near_dedup), ("decontamination", decontamination), ("secret scan", secret_scan), ("BPE", encode)]

#: SQL cannot express the classifier, the samples or the merges; the tests hold the result against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_folder(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
