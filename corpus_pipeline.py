"""The corpus pipeline: stages over the table of documents, each written before the next.

1. toxicity: documents that the network finds toxic go.
2. near_duplicates: one document of each group of near copies stays.
3. decontamination: documents that hold a window of a benchmark item go.
4. pii: personal data is replaced by surrogates, and n_chars follows the new text.
5. packing: the token pieces of what is left, with their places in sequences.

All stages but the last return the columns of their input. Nulls, empty texts and
tables, repeated rows and further columns are handled as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from facetframe.llm import decontaminate, near_dup, packing, pii, toxicity
from facetframe.llm.base import kept, table
from facetframe.llm.queries import PII_KEY, toxicity_model


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.survivors(docs)


def remove_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    new = pii.replaced(docs, PII_KEY, added=("_n_replaced", "_kinds_replaced"))
    columns = [
        F.when(F.col("_n_replaced") > 0, F.char_length("text").cast(kind)).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c)
        for c, kind in docs.dtypes
    ]
    return new.select(*columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("near_duplicates", remove_near_duplicates),
    ("decontamination", remove_benchmark_passages),
    ("pii", replace_personal_data),
    ("packing", pack),
]

#: SQL can't express the network, the chosen paths' recall, the surrogates or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
