"""Identities: reads that are targets, and overlaps' names or ordinals to sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_identity(reads: DataFrame, targets: DataFrame) -> DataFrame:
    """reads (ordinal, name, ...) with uid: the same-named target's 't' and ordinal, else 'q' and the read's.

    Of equal names the last counts. A read whose length or quality length differs from its target's is an error,
    where both tables have length and quality_length.
    """
    last = targets.groupBy("name").agg(F.max_by(F.struct(*targets.columns), "ordinal").alias("t"))
    joined = reads.join(last, "name", "left")
    uid = F.when(F.col("t").isNotNull(), F.concat(F.lit("t"), F.col("t.ordinal"))).otherwise(F.concat(F.lit("q"), F.col("ordinal")))
    if "length" in reads.columns and "length" in targets.columns:
        differ = F.col("t").isNotNull() & (F.col("length") != F.col("t.length"))
        if "quality_length" in reads.columns and "quality_length" in targets.columns:
            differ = differ | F.col("t").isNotNull() & (F.coalesce("quality_length", F.lit(0)) != F.coalesce("t.quality_length", F.lit(0)))
        uid = F.when(differ, F.raise_error(F.concat(F.lit("read and target of one name differ in length: "), F.col("name")))).otherwise(uid)
    return joined.select(*[F.col(c) for c in reads.columns], uid.alias("uid"))


def last_of_name(sequences: DataFrame) -> DataFrame:
    """One row for each name, the last."""
    return sequences.groupBy("name").agg(F.max_by(F.struct(*[c for c in sequences.columns if c != "name"]), "ordinal").alias("s")).select("name", "s.*")


def resolve(overlaps: DataFrame, reads: DataFrame, targets: DataFrame) -> DataFrame:
    """Valid overlaps with q_id, t_id (uids), q_ordinal, t_ordinal and t_length; rows that name no read or no target go.

    reads: ordinal, name, length, uid; targets: ordinal, name, length. Ordinals in the overlap are looked up where it
    has no names. A length that differs from the sequence's is an error; the query's is looked at first.
    """
    by_name = "q_name" in overlaps.columns
    read_key, target_key, q, t = ("name", "name", "q_name", "t_name") if by_name else ("ordinal", "ordinal", "q_ord", "t_ord")
    r = (last_of_name(reads) if by_name else reads).select(F.col(read_key).alias("__q"), F.col("uid").alias("q_id"), F.col("ordinal").alias("q_ordinal"), F.col("length").alias("__ql"))
    g = (last_of_name(targets) if by_name else targets).select(F.col(target_key).alias("__t"), F.concat(F.lit("t"), F.col("ordinal")).alias("t_id"), F.col("ordinal").alias("t_ordinal"), F.col("length").alias("__tl"))
    valid = overlaps.where("is_valid") if "is_valid" in overlaps.columns else overlaps
    joined = valid.join(r, valid[q] == r["__q"]).join(g, F.col(t) == g["__t"], "left")
    q_id = F.when(F.col("q_length") != F.col("__ql"), F.raise_error(F.concat(F.lit("query length differs from its read's: "), F.col("__q").cast("string")))).otherwise(F.col("q_id"))
    t_id = F.when((F.coalesce("t_length", F.lit(0)) != 0) & (F.col("t_length") != F.col("__tl")), F.raise_error(F.concat(F.lit("target length differs: "), F.col("__t").cast("string")))).otherwise(F.col("t_id"))
    joined = joined.withColumns({"q_id": q_id, "t_id": t_id, "t_length": F.col("__tl")}).where("t_id is not null and q_id is not null")
    return joined.drop("__q", "__t", "__ql", "__tl")
