"""Work on reads before a run: names of pairs, subsamples, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ordinals import with_running_sum


def rename_pairs(reads: DataFrame, order: list[str]) -> DataFrame:
    """reads with name cut at its first space, and 1 added at its first occurrence (in order) or 2 at any later one."""
    short = reads.withColumn("name", F.substring_index("name", " ", 1))
    place = F.row_number().over(Window.partitionBy("name").orderBy(*order))
    return short.withColumn("name", F.concat("name", F.when(place == 1, "1").otherwise("2")))


def subsample(reads: DataFrame, order: list, length, reference_length: int, coverage: int) -> DataFrame:
    """Reads in order while their total length is at most coverage * reference_length."""
    return with_running_sum(reads, order, length, "running").where(F.col("running") <= coverage * reference_length)


def split_targets(targets: DataFrame, order: list, chunk_bytes: int) -> DataFrame:
    """targets with chunk: a new one begins where the bytes before pass a multiple of chunk_bytes."""
    size = F.octet_length("data").cast("long")
    return with_running_sum(targets, order, size, "running").withColumn("chunk", ((F.col("running") - size) / chunk_bytes).cast("long")).drop("running")
