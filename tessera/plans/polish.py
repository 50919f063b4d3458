"""The whole run: reads, overlaps and targets to corrected targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import PolishConfig
from tessera.functions.sequence import oriented, slice_of, tag
from tessera.operators import layers as L
from tessera.operators.align import align_pair
from tessera.operators.ordinals import with_ordinal
from tessera.operators.poa import consensus_udf
from tessera.operators.resolve import resolve, shared_identity
from tessera.operators.select import best_per_run, fragment_filter
from tessera.session import settled
from tessera.sources.files import read_overlaps, read_sequences


def long_reads(reads: DataFrame) -> bool:
    """Whether the mean read is longer than 1000."""
    found = reads.agg(F.sum(F.length("data").cast("long")).alias("total"), F.count("*").alias("n")).first()
    if not found.n:
        raise ValueError("empty set of reads")
    return found.total / found.n > 1000


def chosen_overlaps(reads: DataFrame, overlaps: DataFrame, targets: DataFrame, config: PolishConfig) -> DataFrame:
    """Overlaps that count, with uids; sequences are not in them yet, only names and places."""
    slim = lambda df: df.select("ordinal", "name", F.length("data").cast("long").alias("length"), F.length("quality").cast("long").alias("quality_length"))
    known = resolve(overlaps, shared_identity(slim(reads), slim(targets)), slim(targets))
    if config.fragment:
        return settled(fragment_filter(known, config.error_threshold))  # used several times
    return best_per_run(with_ordinal(known.withColumnRenamed("ordinal", "line"), ["line"]), config.error_threshold)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt to as many tasks as shuffles have: its rows are few but costly, so they aren't to be drawn together by size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def with_cigars(chosen: DataFrame, reads: DataFrame, targets: DataFrame) -> DataFrame:
    """chosen, each with its CIGAR; those without one are aligned, and only they."""
    own = chosen.where("cigar is not null")
    bare = chosen.where("cigar is null")
    q = reads.select(F.col("ordinal").alias("q_ordinal"), F.col("data").alias("q"))
    t = targets.select(F.col("ordinal").alias("t_ordinal"), F.col("data").alias("t"))
    joined = bare.drop("cigar").join(q, "q_ordinal").join(t, "t_ordinal")
    begin = F.when(F.col("strand"), F.col("q_length") - F.col("q_end")).otherwise(F.col("q_begin"))
    query = slice_of(oriented(F.col("q"), F.col("strand")), begin, begin + F.col("q_end") - F.col("q_begin"))
    pairs = joined.withColumns({"q": query, "t": slice_of(F.col("t"), F.col("t_begin"), F.col("t_end"))})
    aligned = spread(pairs, "ordinal").withColumn("cigar", align_pair("q", "t")["cigar"]).select(*chosen.columns)
    return own.select(*chosen.columns).unionByName(aligned)


def build_windows(reads: DataFrame, chosen: DataFrame, targets: DataFrame, config: PolishConfig) -> DataFrame:
    """t_id, rank, backbone, backbone_quality, layers."""
    target_ids = targets.withColumn("t_id", F.concat(F.lit("t"), "ordinal"))
    aligned = with_cigars(chosen, reads, targets)
    start = F.when(F.col("strand"), F.col("q_length") - F.col("q_end")).otherwise(F.col("q_begin"))
    key = ["ordinal"]
    points = L.breaking_points(aligned.select(*key, "cigar", "t_begin", start.alias("q_start")), key, config.window_length)
    points = points.join(chosen.select(*key, "t_id", F.col("q_ordinal").alias("read"), "strand"), key)
    both = reads.select(F.col("ordinal").alias("read"), "data", "quality", F.explode(F.array(F.lit(False), F.lit(True))).alias("strand"))
    both = both.select("read", "strand", oriented(F.col("data"), F.col("strand")).alias("data"), F.when(F.col("strand"), F.reverse("quality")).otherwise(F.col("quality")).alias("quality"))
    layered = L.layers(points, both, key, config.window_length, config.quality_threshold)
    return L.stacks(L.tiles(target_ids, config.window_length), layered, key)


def polished_windows(windows: DataFrame, config: PolishConfig, trim: bool) -> DataFrame:
    """t_id, rank, consensus, polished. Windows of fewer than two layers keep their backbone, and their sequences stay out of Python."""
    polished = F.size("layers") >= 2
    thick = lambda c: F.when(polished, F.col(c))
    consensus = consensus_udf(config.match, config.mismatch, config.gap, trim)(thick("backbone"), thick("backbone_quality"), thick("layers"))
    return spread(windows, "t_id", "rank").select("t_id", "rank", F.coalesce(consensus, "backbone").alias("consensus"), polished.alias("polished"))


def finished(consensus: DataFrame, chosen: DataFrame, targets: DataFrame, config: PolishConfig) -> DataFrame:
    """ordinal, name (with its tags), data, ln, rc, xc of each target; untouched ones only where asked."""
    names = targets.select(F.concat(F.lit("t"), "ordinal").alias("t_id"), "ordinal", "name")
    whole = L.stitched(consensus).join(L.coverage(names, chosen), "t_id").join(names, "t_id")
    if not config.include_unpolished:
        whole = whole.where("polished > 0")
    length = F.length("data")
    return whole.select("ordinal", tag(F.col("name"), length, F.col("rc"), F.col("polished"), F.col("windows"), config.fragment).alias("name"), "data", length.cast("long").alias("ln"), "rc", (F.col("polished") / F.col("windows")).alias("xc"))


def polish(reads: DataFrame, overlaps: DataFrame, targets: DataFrame, config: PolishConfig = PolishConfig()) -> DataFrame:
    """Corrected targets of reads and targets (ordinal, name, data, quality) and overlaps (as sources.files reads them)."""
    trim = config.trim and long_reads(reads)
    for name, df in (("targets", targets), ("overlaps", overlaps)):
        if df.isEmpty():
            raise ValueError(f"empty set of {name}")
    chosen = chosen_overlaps(reads, overlaps, targets, config)
    if chosen.isEmpty():
        raise ValueError("no overlap is left after filtering")
    return finished(polished_windows(build_windows(reads, chosen, targets, config), config, trim), chosen, targets, config)


def polish_files(spark: SparkSession, reads: str, overlaps: str, targets: str, config: PolishConfig = PolishConfig()) -> DataFrame:
    return polish(read_sequences(spark, reads), read_overlaps(spark, overlaps), read_sequences(spark, targets), config)


def polish_in_chunks(reads: DataFrame, overlaps: DataFrame, targets: DataFrame, chunk_bytes: int, config: PolishConfig = PolishConfig()) -> DataFrame:
    """polish() for one chunk of targets after another, results together; an overlap competes within its chunk only."""
    from tessera.operators.prepare import split_targets

    chunked = split_targets(targets, ["ordinal"], chunk_bytes)
    out = None
    for row in chunked.select("chunk").distinct().orderBy("chunk").collect():  # as many as chunks were asked for
        part = polish(reads, overlaps, chunked.where(F.col("chunk") == row.chunk).drop("chunk"), config)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("empty set of targets")
    return out
