"""Readers and writers of sequence and overlap files, by Spark's own text source (any file system, gzip as well)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.sequence import known_quality, overlap_error, overlap_length, query_range, target_span
from tessera.operators.ordinals import with_ordinal

#: Suffixes of each format; each also with .gz. Case counts.
FASTA, FASTQ = (".fasta", ".fna", ".fa"), (".fastq", ".fq")


def _has(path: str, suffixes: tuple[str, ...]) -> bool:
    return path.removesuffix(".gz").endswith(suffixes)


def _numbered(spark: SparkSession, path: str, separator: str | None = None, keep_file: bool = False) -> DataFrame:
    """value and line, the number of the line in the file, or in all files in the order of their names; blocks are counted first, so files stay splittable."""
    reader = spark.read.option("lineSep", separator) if separator else spark.read
    rows = reader.text(path).select("value", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")).alias("block"), F.monotonically_increasing_id().alias("id"))
    counts = rows.groupBy("block").count()
    before = counts.withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("block", "before")
    own = F.row_number().over(Window.partitionBy("block").orderBy("id")) - 1
    return rows.withColumn("own", own).join(F.broadcast(before), "block").select((F.col("own") + F.col("before")).alias("line"), "value", *([F.col("block.file").alias("file")] if keep_file else []))  # a row for each block


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """ordinal, name (up to the first white space), data (upper case), quality (null)."""
    records = _numbered(spark, path, "\n>")
    text = F.regexp_replace("value", r"^>", "")
    head = F.regexp_replace(F.substring_index(text, "\n", 1), "\r", "")
    rest = F.when(F.locate("\n", text) > 0, F.expr("substring(t, locate('\n', t) + 1)")).otherwise("")
    out = records.withColumn("t", text).where(F.trim("t") != "")
    return out.select(F.col("line").alias("ordinal"), F.regexp_extract(head, r"^(\S*)", 1).alias("name"), F.upper(F.regexp_replace(rest, r"\s", "")).alias("data"), F.lit(None).cast("string").alias("quality"))


def read_fastq(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """ordinal, name, data (upper case), quality (null if all of it is '!').

    Records are four lines each, gathered by number; with multiline each file is parsed in order by one task, records being
    numbered over all files. Empty lines at the very end do not count, elsewhere they are an error; a record may have empty
    data and quality. With multiline a record of more quality than data is an error; one of less is left out where it is cut
    off by its file's end.
    """
    lines = _numbered(spark, path)
    if multiline:
        parsed = _numbered(spark, path, keep_file=True).groupBy("file").applyInPandas(_parse_fastq, "line long, record long, name string, data string, quality string")
        parsed = with_ordinal(parsed, ["line", "record"])
    else:
        lines = lines.withColumns({"ordinal": F.expr("line div 4"), "k": F.col("line") % 4})
        part = lambda k: F.max(F.when(F.col("k") == k, F.regexp_replace("value", "\r$", "")))
        records = lines.groupBy("ordinal").agg(part(0).alias("head"), part(1).alias("data"), part(2).alias("plus"), part(3).alias("quality"))
        records = records.where(F.concat_ws("", "head", "data", "plus", "quality") != "")
        wrong = ~F.col("head").startswith("@") | ~F.col("plus").startswith("+") | (F.length("data") != F.length("quality"))
        head = F.when(F.coalesce(wrong, F.lit(True)), F.raise_error(F.concat(F.lit("not a record of four lines: "), F.coalesce("head", F.lit("?"))))).otherwise(F.col("head"))
        parsed = records.select("ordinal", F.regexp_extract(head, r"^@(\S*)", 1).alias("name"), "data", "quality")
    return parsed.select("ordinal", "name", F.upper("data").alias("data"), known_quality(F.col("quality")).alias("quality"))


def _parse_fastq(lines):
    import pandas as pd

    lines = lines.sort_values("line")
    texts, first, out = iter(x.rstrip("\r") for x in lines["value"]), int(lines["line"].iloc[0]), []
    for head in texts:
        if not head.startswith("@"):
            continue
        data = quality = ""
        for line in texts:
            if line.startswith("+"):
                break
            data += line
        while len(quality) < len(data) and (line := next(texts, None)) is not None:
            quality += line
        if len(quality) > len(data):
            raise ValueError(f"more quality than data: {head}")
        if len(quality) < len(data):
            break  # no lines are left: a truncated last record
        out.append((first, len(out), (head[1:].split() or [""])[0], data, quality))
    return pd.DataFrame(out, columns=["line", "record", "name", "data", "quality"])


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """Sequences of a file whose suffix tells the format; ValueError for others."""
    if _has(path, FASTA):
        return read_fasta(spark, path)
    if _has(path, FASTQ):
        return read_fastq(spark, path)
    raise ValueError(f"{path}: unsupported format; valid suffixes are {', '.join(FASTA + FASTQ)}, also with .gz")


def _spans(df: DataFrame) -> DataFrame:
    q, t = F.col("q_end") - F.col("q_begin"), F.col("t_end") - F.col("t_begin")
    return df.withColumns({"length": overlap_length(q, t), "error": overlap_error(q, t)})


def _whole(name: str, fields, i: int):
    return fields[i].cast("long").alias(name)


def read_mhap(spark: SparkSession, path: str) -> DataFrame:
    """Twelve fields by spaces; ids count from 1 and become ordinals; strands are told apart by their exclusive or."""
    f = F.split(F.trim("value"), r"\s+")
    rows = _numbered(spark, path).where(F.trim("value") != "")
    out = rows.select(
        F.col("line").alias("ordinal"), (f[0].cast("long") - 1).alias("q_ord"), (f[1].cast("long") - 1).alias("t_ord"), _whole("q_begin", f, 5), _whole("q_end", f, 6), _whole("q_length", f, 7),
        _whole("t_begin", f, 9), _whole("t_end", f, 10), _whole("t_length", f, 11), (f[4].cast("int").bitwiseXOR(f[8].cast("int")) != 0).alias("strand"), F.lit(None).cast("string").alias("cigar"), F.lit(True).alias("is_valid"),
    )
    return _spans(out)


def read_paf(spark: SparkSession, path: str) -> DataFrame:
    f = F.split("value", "\t")
    rows = _numbered(spark, path).where(F.trim("value") != "")
    out = rows.select(
        F.col("line").alias("ordinal"), f[0].alias("q_name"), f[5].alias("t_name"), _whole("q_begin", f, 2), _whole("q_end", f, 3), _whole("q_length", f, 1), _whole("t_begin", f, 7), _whole("t_end", f, 8),
        _whole("t_length", f, 6), (f[4] == "-").alias("strand"), F.lit(None).cast("string").alias("cigar"), F.lit(True).alias("is_valid"),
    )
    return _spans(out)


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments; header lines go. A mapped record whose CIGAR is shorter than two characters is an error."""
    f = F.split("value", "\t")
    rows = _numbered(spark, path).where((F.trim("value") != "") & ~F.col("value").startswith("@"))
    rows = rows.select(F.col("line").alias("ordinal"), f[0].alias("q_name"), f[2].alias("t_name"), f[1].cast("int").alias("flag"), (f[3].cast("long") - 1).alias("t_begin"), f[5].alias("raw"))
    mapped = F.col("flag").bitwiseAND(4) == 0
    cigar = F.when(mapped & (F.length("raw") < 2), F.raise_error(F.concat(F.lit("no CIGAR of "), F.col("q_name")))).otherwise(F.col("raw"))
    rows = rows.withColumns({"cigar": cigar, "strand": F.col("flag").bitwiseAND(16) != 0, "is_valid": mapped})
    begin, end, length = query_range(F.col("cigar"), F.col("strand"))
    out = rows.select("ordinal", "q_name", "t_name", begin.alias("q_begin"), end.alias("q_end"), length.alias("q_length"), "t_begin", (F.col("t_begin") + target_span(F.col("cigar"))).alias("t_end"), F.lit(0).cast("long").alias("t_length"), "strand", "cigar", "is_valid")
    return _spans(out)


def read_overlaps(spark: SparkSession, path: str) -> DataFrame:
    """Overlaps of a file whose suffix tells the format; ValueError for others."""
    for suffix, read in ((".mhap", read_mhap), (".paf", read_paf), (".sam", read_sam)):
        if _has(path, (suffix,)):
            return read(spark, path)
    raise ValueError(f"{path}: unsupported format; valid suffixes are .mhap, .paf, .sam, also with .gz")


def fasta_lines(polished: DataFrame) -> DataFrame:
    """polished (ordinal, name, data) as one text column in the order of the targets."""
    return polished.orderBy("ordinal").select(F.concat(F.lit(">"), "name", F.lit("\n"), "data").alias("value"))


def write_fasta(polished: DataFrame, path: str) -> None:
    fasta_lines(polished).write.text(path)


def write_fastq(reads: DataFrame, path: str) -> None:
    """Records of four lines, in order; where quality is null, it is written as '!' throughout, which reads back as null."""
    quality = F.coalesce("quality", F.expr("repeat('!', length(data))"))
    reads.orderBy("ordinal").select(F.concat(F.lit("@"), "name", F.lit("\n"), "data", F.lit("\n+\n"), quality).alias("value")).write.text(path)

