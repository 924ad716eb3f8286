"""From raw documents to packed training sequences: reject, de-duplicate, near-de-duplicate, mix, pack.

Every stage but the last returns the columns of its input, clashing names and extra ones included, untouched. Null texts
count as empty: rejected or kept by the classifier like any other, one text to exact and near-de-duplication, of size 0 and
so never taken by the mix. Null sources are a source, null ids lose against any other where copies are dropped. Rows that
repeat id and text are copies of one another. Without labels no document is rejected. An empty table stays empty throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brookmill.llm import exact_dedup, mixing, near, packing, quality
from brookmill.llm.common import new_folder
from brookmill.llm.queries import labels, vocabulary
from brookmill.session import ship


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps."""
    ship(spark)
    return quality.survivors(docs, labels(spark, sf_dir))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the smallest id."""
    ship(spark)
    return exact_dedup.survivors(docs)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each class of near-duplicates: five-word shingles with a Jaccard similarity of 0.8 or more."""
    ship(spark)
    return near.survivors(docs, width=5, least=0.8)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    ship(spark)
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences with their token ids."""
    ship(spark)
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("quality", good), ("exact_dedup", distinct), ("near_dedup", unlike), ("mix", mixed), ("pack", packed)]

#: A trained classifier has no SQL form; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
