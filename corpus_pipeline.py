"""The corpus pipeline: documents pass five stages, each written as Parquet and read again as the next one's input.

Language ID drops texts of no known language, line dedup removes passages that occur before, near-dedup keeps one
document of each group, the mix repeats or drops documents for its sources' target weights, and byte-level BPE encodes
what remains. A document that the mix takes twice is encoded twice.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from quireflow.llm import bpe, langid, linededup, mixing, similar
from quireflow.llm.common import own_tables, shared_dir


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that language ID rejects; lang becomes the predicted language. Rows without doc_id are
    judged by their text alike."""
    found = langid.predicted(docs, langid.learnt(docs))
    return found.where(~F.col("_rejected")).withColumn("lang", F.col("_lang_pred")).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without repeated passages; a document of which nothing remains stays with an empty text, n_chars follows."""
    out = linededup.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose shingles of five words have a Jaccard similarity of 0.8 or more."""
    return similar.keep_one(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document, and the ids themselves."""
    return bpe.encode(docs, ids=True)


STAGES = [
    ("language_id", identify_languages),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_documents),
    ("source_mixing", mix_sources),
    ("byte_bpe", encode),
]

#: Hashing by XXH64, models and recursive merges can't be said in SQL: the tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        with own_tables():
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
