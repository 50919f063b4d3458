"""Dense ordinals and running sums over a total order, without a window over all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import settled


def _prefix(df: DataFrame, order: list, measure: Column, name: str) -> DataFrame:
    """df with the sum of measure over the rows before each, in order; the rows are dealt by range and sorted within."""
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"__p": F.spark_partition_id(), "__i": F.monotonically_increasing_id(), "__m": measure})
    sorted_ = settled(sorted_)  # a second computation might draw other range borders
    totals = sorted_.groupBy("__p").agg(F.sum("__m").alias("__t")).collect()  # a row for each partition
    before, running = {}, 0
    for r in sorted(totals, key=lambda r: r["__p"]):
        before[r["__p"]] = running
        running += r["__t"]
    offsets = df.sparkSession.createDataFrame(list(before.items()) or [(0, 0)], "__p int, __b long")
    own = Window.partitionBy("__p").orderBy("__i").rowsBetween(Window.unboundedPreceding, -1)
    out = sorted_.join(F.broadcast(offsets), "__p").withColumn(name, F.col("__b") + F.coalesce(F.sum("__m").over(own), F.lit(0)))
    return out.drop("__p", "__i", "__m", "__b")


def with_ordinal(df: DataFrame, order: list, name: str = "ordinal") -> DataFrame:
    """df with 0, 1, 2, ... in order: a row's place in its partition, after the rows of those before. Sorted rows are neither dealt nor sorted again."""
    sorted_ = settled(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__i", F.monotonically_increasing_id()))
    part = F.shiftright("__i", 33).cast("int")
    before, running = {}, 0
    for r in sorted(sorted_.groupBy(part.alias("p")).count().collect(), key=lambda r: r["p"]):  # a row for each partition
        before[r["p"]] = running
        running += r["count"]
    offsets = df.sparkSession.createDataFrame(list(before.items()) or [(0, 0)], "__p int, __b long")
    out = sorted_.withColumn("__p", part).join(F.broadcast(offsets), "__p")
    return out.withColumn(name, F.col("__b") + F.col("__i").bitwiseAND(F.lit((1 << 33) - 1))).drop("__p", "__i", "__b")


def with_running_sum(df: DataFrame, order: list, measure: Column, name: str) -> DataFrame:
    """df with the sum of measure over the rows up to and with each, in order."""
    return _prefix(df, order, measure.cast("long"), "__before").withColumn(name, F.col("__before") + measure.cast("long")).drop("__before")
