"""Which overlaps count: errors, self overlaps, and the best of each run of a query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.sequence import too_wrong


def passes(error_threshold: float):
    """The error is not above the threshold and query and target differ."""
    return ~too_wrong(F.col("error"), error_threshold) & (F.col("q_id") != F.col("t_id"))


def fragment_filter(overlaps: DataFrame, error_threshold: float = 0.3) -> DataFrame:
    return overlaps.where(passes(error_threshold))


def with_islands(overlaps: DataFrame) -> DataFrame:
    """overlaps with island: it numbers the maximal runs of consecutive rows of one query.

    ordinal must be dense (0, 1, 2, ...) over the rows; the gap to the query's own row number is constant in a run.
    """
    own = F.row_number().over(Window.partitionBy("q_id").orderBy("ordinal"))
    return overlaps.withColumn("island", F.col("ordinal") - own)


def best_per_run(overlaps: DataFrame, error_threshold: float = 0.3) -> DataFrame:
    """Of each run the row that the tournament leaves: a later row knocks out what is not longer, and wrong ones drop out after.

    So it is the first passing row among those that are longer than all rows after them in the run.
    """
    run = Window.partitionBy("q_id", "island").orderBy("ordinal")
    after = F.max("length").over(run.rowsBetween(1, Window.unboundedFollowing))
    left = with_islands(overlaps).withColumn("after", F.coalesce(after, F.lit(-1).cast("long"))).where((F.col("length") > F.col("after")) & passes(error_threshold))
    return left.withColumn("place", F.row_number().over(run)).where("place = 1").drop("after", "place")
