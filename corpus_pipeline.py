"""A corpus pipeline of five stages; each calls one operator over all that its predecessor kept.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as
Parquet and reread as the next one's ``docs``. All but the last return the columns
of documents; the last adds what the mix takes of each document.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from arbora.llm import decontaminate, line_dedup, mixing, simhash, toxicity
from arbora.llm._shared import shared_folder, table


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(spark, docs, sf_dir)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs)


def keep_one_near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(spark, docs, sf_dir)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take(spark, docs, sf_dir)


STAGES = [
    ("toxicity", remove_toxic),
    ("line_dedup", remove_repeated_lines),
    ("simhash_near_dedup", keep_one_near_duplicate),
    ("decontamination", remove_contaminated),
    ("mix_sources", mix_sources),
]

#: Stages 1 to 3 and 5 (a trained model, components, a balanced draw) have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's output is written to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
