"""Sequences, overlaps and targets derived from the given tables by integer arithmetic, alike in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.sequence import overlap_error, overlap_length, reverse_complement
from tessera.operators.ordinals import with_ordinal


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dna(text):
    """The letters A, C, G and T of a text, in upper case."""
    return F.upper(F.regexp_replace(text, "[^acgtACGT]", ""))


SQL_DNA = "upper(regexp_replace(coalesce(text, ''), '[^acgtACGT]', '', 'g'))"

ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]


def overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An overlap for each row of lineitem with its part; status F exchanges the spans of query and target."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    lines = lines.withColumns({"wide": F.expr("cast(l_quantity as bigint) * 20"), "disc": F.expr("cast(round(l_discount * 100) as bigint)")})
    lines = lines.withColumn("narrow", F.expr("wide - (wide * disc * 4) div 100"))
    flipped = F.col("l_linestatus") == "F"
    q_span, t_span = F.when(flipped, F.col("narrow")).otherwise(F.col("wide")), F.when(flipped, F.col("wide")).otherwise(F.col("narrow"))
    gap = F.when(F.col("wide") == F.col("narrow"), "").otherwise(F.concat(F.expr("cast(wide - narrow as string)"), F.when(flipped, "D").otherwise("I")))
    out = lines.select(
        *ORDER, (F.col("l_suppkey") % 7).alias("shuffle"), (F.col("l_orderkey") % 500).alias("q_id"), (F.col("l_partkey") % 500).alias("t_id"), q_span.alias("q_span"), t_span.alias("t_span"),
        F.expr("cast(1000 + 50 * p_size as bigint)").alias("t_length"), (F.col("l_linenumber") * 10).cast("long").alias("q_begin"), (F.col("l_returnflag") == "R").alias("strand"),
        F.concat(F.expr("cast(narrow div 2 as string)"), F.lit("M"), gap, F.expr("cast(narrow - narrow div 2 as string)"), F.lit("M")).alias("cigar"),
    )
    return out.withColumns({"t_begin": F.expr("(l_suppkey * 37) % (t_length - t_span + 1)"), "length": overlap_length(F.col("q_span"), F.col("t_span")), "error": overlap_error(F.col("q_span"), F.col("t_span"))})


def ordered_overlaps(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """overlaps' named columns, or all, with a dense ordinal from 0, in an order that mixes the queries. What is not asked for is not sorted along."""
    order = ["shuffle", *ORDER]
    found = overlaps(spark, sf_dir)
    slim = found.select(*order, *[c for c in columns if c not in order]) if columns else found
    ordered = with_ordinal(slim, order)
    return ordered.select("ordinal", *columns) if columns else ordered


_K = ", ".join(ORDER)

SQL_OVERLAPS = f"""
lines AS (
  SELECT *, wide - (wide * disc * 4) // 100 AS narrow, l_linestatus = 'F' AS flipped
  FROM (SELECT *, CAST(l_quantity AS BIGINT) * 20 AS wide, CAST(round(l_discount * 100) AS BIGINT) AS disc FROM lineitem JOIN part ON l_partkey = p_partkey)
), laps AS (
  SELECT {_K}, row_number() OVER (ORDER BY l_suppkey % 7, {_K}) - 1 AS ordinal,
         l_orderkey % 500 AS q_id, l_partkey % 500 AS t_id,
         CASE WHEN flipped THEN narrow ELSE wide END AS q_span, CASE WHEN flipped THEN wide ELSE narrow END AS t_span,
         CAST(1000 + 50 * p_size AS BIGINT) AS t_length, CAST(l_linenumber * 10 AS BIGINT) AS q_begin, l_returnflag = 'R' AS strand,
         (l_suppkey * 37) % (CAST(1000 + 50 * p_size AS BIGINT) - CASE WHEN flipped THEN wide ELSE narrow END + 1) AS t_begin,
         wide AS length, CASE WHEN wide = 0 THEN CAST('NaN' AS DOUBLE) ELSE 1 - narrow / wide END AS error,
         CAST(narrow // 2 AS VARCHAR) || 'M' || CASE WHEN wide = narrow THEN '' ELSE CAST(wide - narrow AS VARCHAR) || CASE WHEN flipped THEN 'D' ELSE 'I' END END
           || CAST(narrow - narrow // 2 AS VARCHAR) || 'M' AS cigar
  FROM lines
)"""


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets: the documents' letters with a substitution every 31 bases. ordinal, name, data, quality, truth."""
    own = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ordinal"), F.concat(F.lit("d"), F.col("doc_id")).alias("name"), dna(F.coalesce("text", F.lit(""))).alias("truth"))
    return own.select("ordinal", "name", _changed("truth", 31, F.col("ordinal")).alias("data"), F.lit(None).cast("string").alias("quality"), "truth")


def _changed(column: str, every: int, shift):
    """Each base whose place plus shift is a multiple of every, replaced by another."""
    bases = F.transform(F.split(column, ""), lambda c, i: F.when((i + shift) % every == 0, F.translate(c, "ACGT", "CGTA")).otherwise(c))
    return F.array_join(bases, "")


def noisy_reads(drafted: DataFrame, copies: int = 5) -> DataFrame:
    """Reads of each target's truth, each with other substitutions; every second is its reverse complement."""
    many = drafted.where(F.length("truth") > 0).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    many = many.withColumn("seen", _changed("truth", 23, F.col("ordinal") + F.col("copy") * 5)).withColumn("back", F.col("copy") % 2 == 1)
    data = F.when(F.col("back"), reverse_complement(F.col("seen"))).otherwise(F.col("seen"))
    return many.select(
        (F.col("ordinal") * copies + F.col("copy")).alias("ordinal"), F.concat(F.lit("r"), F.col("ordinal") * copies + F.col("copy")).alias("name"), data.alias("data"), F.translate(data, "ACGT", "I5?+").alias("quality"),
        F.col("name").alias("target"), F.col("back"), "copy",
    )


def whole_overlaps(reads: DataFrame) -> DataFrame:
    """An overlap of each read with all of its target, as an alignment file would give it."""
    n = F.length("data").cast("long")
    zero = F.lit(0).cast("long")
    out = reads.select("ordinal", F.col("name").alias("q_name"), F.col("target").alias("t_name"), zero.alias("q_begin"), n.alias("q_end"), n.alias("q_length"), zero.alias("t_begin"), n.alias("t_end"), n.alias("t_length"), F.col("back").alias("strand"), F.concat(n.cast("string"), F.lit("M")).alias("cigar"), F.lit(True).alias("is_valid"))
    return out.withColumns({"length": F.col("q_end"), "error": F.lit(0.0)})

