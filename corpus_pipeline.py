"""The corpus pipeline: from ``documents`` to packed sequences.

Every stage gets all rows that the stage before it kept, written as Parquet and read again, and all but the
last return the columns of ``documents``:

1. toxicity: documents of a score of 0.7 or more go;
2. near_dedup: of each class of near-duplicates (five-word runs, similarity 0.8) the row of the least id stays;
3. pii: personal data in texts is replaced by its kind, and n_chars follows;
4. mixing: rows are repeated or left out as the budgets of their domain, language and source say;
5. packing: one row for each piece of a document in a sequence of at most 2048 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from notelake.llm.common import materialise, table
from notelake.llm.mixing import mix
from notelake.llm.near_dedup import without_near_duplicates
from notelake.llm.packing import pack_documents
from notelake.llm.pii import sanitised
from notelake.llm.toxicity import fit, without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_near_duplicates(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sanitised(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("pii", pii), ("mixing", mixing), ("packing", packing)]

#: A fitted classifier and sketches cannot be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialise(docs, f"stage-{name}")
    return docs
