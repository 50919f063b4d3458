"""python -m tessera.cli READS OVERLAPS TARGETS: corrected targets as FASTA on standard output, or to --out."""

from __future__ import annotations

import argparse
import os
import sys

from tessera import __version__
from tessera.config import PolishConfig


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tessera", description="Consensus of sequences from reads, their overlaps, and targets.")
    out.add_argument("reads", help="FASTA or FASTQ, may be gzipped")
    out.add_argument("overlaps", help="MHAP, PAF or SAM, may be gzipped")
    out.add_argument("targets", help="FASTA or FASTQ, may be gzipped")
    out.add_argument("-u", "--include-unpolished", action="store_true")
    out.add_argument("-f", "--fragment-correction", action="store_true")
    out.add_argument("-w", "--window-length", type=int, default=500)
    out.add_argument("-q", "--quality-threshold", type=float, default=10.0)
    out.add_argument("-e", "--error-threshold", type=float, default=0.3)
    out.add_argument("--no-trimming", action="store_true")
    out.add_argument("-m", "--match", type=int, default=3)
    out.add_argument("-x", "--mismatch", type=int, default=-5)
    out.add_argument("-g", "--gap", type=int, default=-4)
    out.add_argument("-t", "--threads", type=int, default=1, help="cores, where Spark runs locally")
    out.add_argument("--master", help="of the cluster; without it spark-submit's, or else this machine's cores")
    out.add_argument("--split", type=int, metavar="BYTES", help="take targets in chunks of this size")
    out.add_argument("--subsample", type=int, nargs=2, metavar=("REFERENCE_LENGTH", "COVERAGE"))
    out.add_argument("--out", help="folder to write to")
    out.add_argument("--version", action="version", version=__version__)
    return out


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from tessera.operators.prepare import subsample
    from tessera.plans.polish import polish, polish_in_chunks
    from tessera.sources.files import fasta_lines, read_overlaps, read_sequences, write_fasta

    config = PolishConfig(args.window_length, args.quality_threshold, args.error_threshold, not args.no_trimming, args.match, args.mismatch, args.gap, args.fragment_correction, args.include_unpolished)
    builder = SparkSession.builder.appName("tessera")
    if args.master or "PYSPARK_GATEWAY_PORT" not in os.environ:  # spark-submit has set the master
        builder = builder.master(args.master or f"local[{args.threads}]")
    spark = builder.getOrCreate()
    reads, overlaps, targets = read_sequences(spark, args.reads), read_overlaps(spark, args.overlaps), read_sequences(spark, args.targets)
    if args.subsample:
        reads = subsample(reads, [F.xxhash64("name"), "ordinal"], F.length("data"), *args.subsample).drop("running")
    polished = polish_in_chunks(reads, overlaps, targets, args.split, config) if args.split else polish(reads, overlaps, targets, config)
    if args.out:
        write_fasta(polished, args.out)
    else:
        for row in fasta_lines(polished).toLocalIterator():
            sys.stdout.write(row.value + "\n")


if __name__ == "__main__":
    main()
