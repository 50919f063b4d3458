"""A training-data pipeline over documents: five operators in a row, each on all that the one before kept.

Every stage's function takes (spark, docs, sf_dir); its result is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, decontam, rules, similar, suffix_dedup
from tessera.llm.common import make_importable, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the isolation forest reject go."""
    make_importable(spark)
    return rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 or more of five-word shingles, the document of smallest id stays."""
    make_importable(spark)
    return similar.keep_first(docs, similarity=(4, 5), shingle=5)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each string of 200 bytes that repeats, the first copy stays in its text; n_chars follows."""
    make_importable(spark)
    return suffix_dedup.remove_repeats(docs, window=200, keep="first", length_col="n_chars" if "n_chars" in docs.columns else None)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with passages of two benchmark items or more go; from the others the passages are cut."""
    make_importable(spark)
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: its ids, their number, and digests of the ids and of what they decode to."""
    make_importable(spark)
    return bpe.encode_documents(docs, bpe.default_codec())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_bpe", byte_bpe),
]

#: Forests, similar sets and byte-pair merges are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, stored(docs) if k else docs, sf_dir)
    return docs
