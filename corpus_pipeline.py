"""The corpus pipeline: language ID, near-dedup, PII, mixing and packing, one after the other over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to the folder that the executors share
and reads it as the next one's ``docs``. All stages but the last return the columns of ``documents``; further columns don't reach the stages after.

Odd input: a document without text, or without any word, names no language and goes with the first stage. Nulls in the other columns stay;
a null source counts as the source ''; rows without an id pass the first three stages and are never drawn by the mix. Rows with the same id stay or go
together in the second stage. Ties go to the least id, as each operator says. Texts of any length are read whole. An empty table goes through all stages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import langid, mixing, packing, pii, queries, simhash
from quillspark.llm.shared import dropped, shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified, which becomes their ``lang``; those rejected go."""
    found = langid.classify(docs, langid.fit(docs)).where("accepted")
    return found.withColumn("lang", F.col("predicted_lang")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, and all that are in none."""
    return simhash.deduplicated(docs).select(*COLUMNS)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data."""
    return pii.pseudonymise(docs, queries.KEY).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources up to twice, towards 0.95 of the greatest entropy of sources."""
    return mixing.mixed(docs, target_entropy=0.95, max_repetition=2.0, budget=0).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 2048 tokens, each with the sources in the proportions that the mix has given them."""
    return packing.windows(docs, exponent=1.0)


STAGES = [("language ID", language), ("SimHash near-dedup", near_copies), ("PII", private), ("mixing", mix), ("packing", pack)]

#: Fingerprints, trained models and keyed permutations have no SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        if k > 0:  # the stage before has been read for the last time
            dropped(spark, f"{folder}/{k - 1}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
