"""From raw documents to packed training sequences.

Every stage takes all rows that its predecessor kept and returns whole rows of
documents, the last one the places of their tokens:

1. language: rows rejected by language identification go;
2. exact: of equal texts the row of the largest id stays;
3. near: of linked SimHash fingerprints the row of the smallest id stays;
4. benchmark: rows with a passage of a benchmark item go;
5. packing: tokens of the rest are placed in sequences.

Each stage's result is written to the folder in ``spark.checkpoint.dir`` and read
again as the input of the next. Null texts have no language and go in stage 1.
An empty table stays empty. The steps pass SQL by (centroids, fingerprints, tokens),
so there is no SQL for the whole; the tests hold it against plain Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matchspark.llm import decontaminate, exact_dedup, language, queries, simhash
from matchspark.session import cut

ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep(docs, queries.language_model(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return queries.packed(docs)


STAGES = [
    ("language", identify_language),
    ("exact", exact),
    ("near", near),
    ("benchmark", benchmark),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
