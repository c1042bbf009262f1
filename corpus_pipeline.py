"""A corpus from raw documents to packed sequences, in five stages.

Every stage is a function of (session, documents, folder of the tables). Its rows are
written to the shared folder and read again as the next stage's documents, so a lost
executor costs a stage at most. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depot.llm.decontam import decontaminate
from depot.llm.packing import pack
from depot.llm.pii import sanitise
from depot.llm.shared import tasks_find_package
from depot.llm.simhash import one_of_each
from depot.llm.toxicity import fit, score
from depot.operators.durable import materialize

#: Documents whose crc32 of the id is divisible by FOLDS teach the toxicity stage nothing.
FOLDS = 5


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    tasks_find_package(spark)
    fitted = fit(docs, labels, list(range(1, FOLDS)), FOLDS)
    return score(docs, fitted).where(F.col("toxicity") < 0.5).select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays whose fingerprints of three words link at 3 bits."""
    tasks_find_package(spark)
    return one_of_each(docs, shingle=3, radius=3)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    tasks_find_package(spark)
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and words that give it away are masked; all documents stay."""
    tasks_find_package(spark)
    return sanitise(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents, packed into sequences of 2048."""
    tasks_find_package(spark)
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: No SQL can fit a lexicon or run a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs


QUERIES = {"pipeline": (run, ORACLE_SQL)}
