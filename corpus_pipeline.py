"""Corpus pipeline: language ID, near-duplicates, secret scans, source mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns the documents it leaves, in the columns of documents; the last
returns the packed pieces. Columns beyond those of documents pass through all stages but the last, whatever their names;
empty tables stay empty. run() writes each stage's rows as Parquet in the shared folder and reads them again, so a
lost executor costs no more than a part of one stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapcat.llm import components, jaccard, langid, mixing, packing, secrets


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents in which a learned language is found with a probability of 0.3 or more.

    Whole texts decide; those that are null, empty or without a letter go, and all go if no row has a language to learn
    from. Null ids, sources and languages stay as they are, repeated rows are judged each for itself.
    """
    components.checkpoint_dir(spark)
    return langid.keep_languages(docs, langid.train_langid(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies, and every one without words.

    The smallest id stays (null is larger than any); of rows with one id the text with the smallest hash, of repeated
    rows one. Unlike texts under one id, or under null, stay both.
    """
    components.checkpoint_dir(spark)
    return jaccard.one_per_group(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret in the texts by a mark; all documents stay, and n_chars follows the text.

    Null and empty texts stay as they are, texts of any length are scanned whole, repeated rows each for itself.
    """
    components.checkpoint_dir(spark)
    return secrets.redact_secrets(docs, secrets.train_crf(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take documents, some more than once, so that the sources come near their target sizes.

    Null is a source of its own. Texts without words are taken by the same rule as others, at no cost. Rows alike in id,
    source and size take the copies of their group in turn.
    """
    components.checkpoint_dir(spark)
    return mixing.mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into training sequences: a row for each piece of a document.

    Texts without words make no piece, long ones several; null ids and repeated rows are packed each for itself.
    """
    components.checkpoint_dir(spark)
    return packing.pack_documents(docs, mixing.word_count(F.col("text")))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]

#: trained models and 64-bit shingle hashes are not for SQL; tests hold run() against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; each stage's rows are written as Parquet and read again by the next, then deleted."""
    components.checkpoint_dir(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}_{name}")
        docs = spark.read.parquet(f"{base}/{k}_{name}")
        if before:
            folder = spark._jvm.org.apache.hadoop.fs.Path(before)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        before = f"{base}/{k}_{name}"
    return docs
