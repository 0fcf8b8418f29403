"""Language ID, exact dedup, near-dedup, mixing and packing over ``documents``, one after another.

Each stage takes what its predecessor kept, written as Parquet into the folder that the cluster
shares and read again; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracklens.llm.common import Workspace
from tracklens.llm.exact_dedup import drop_exact_duplicates
from tracklens.llm.language_id import keep_identified
from tracklens.llm.mixing import mix_documents
from tracklens.llm.near_dedup import drop_near_duplicates
from tracklens.llm.packing import pack_documents


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters; ``lang`` becomes the predicted one, of the known languages the nearest."""
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the longest of texts that are equal but for white space."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five-word shingles, similarity 0.8)."""
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops, repeats and orders documents so that the sources' words meet their targets."""
    return mix_documents(docs).drop("mix_shard")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the mixed documents' token ids into pieces of gapless sequences."""
    return pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL can express neither the language model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = ws.put(stage(spark, docs, sf_dir), name)
    return ws.result(STAGES[-1][1](spark, docs, sf_dir))
