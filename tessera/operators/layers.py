"""Tiles of targets, and the slices of reads that cover them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.sequence import mean_quality, slice_of


def tiles(targets: DataFrame, window_length: int) -> DataFrame:
    """targets (t_id, data[, quality]) cut at a fixed grid: t_id, rank, backbone, backbone_quality ('!' where there is none). Empty targets have none."""
    quality = F.col("quality") if "quality" in targets.columns else F.lit(None).cast("string")
    some = targets.where(F.length("data") > 0).select("t_id", F.col("data").cast("binary").alias("d"), quality.cast("binary").alias("q"))
    ranks = F.sequence(F.lit(0).cast("long"), F.expr(f"(octet_length(d) - 1) div {window_length}").cast("long"))
    cut = lambda column, rank: F.substring(column, (rank * window_length + 1).cast("int"), F.lit(window_length)).cast("string")
    out = some.select("t_id", F.explode(F.transform(ranks, lambda r: F.struct(r.alias("rank"), cut(F.col("d"), r).alias("d"), cut(F.col("q"), r).alias("q")))).alias("x"))
    return out.select("t_id", "x.rank", F.col("x.d").alias("backbone"), F.coalesce("x.q", F.expr("repeat('!', length(x.d))")).alias("backbone_quality"))


_DIGIT = np.isin(np.arange(256), np.arange(48, 58))
_QUERY, _TARGET, _ALIGNED = (np.isin(np.arange(256), list(codes)) for codes in (b"M=XI", b"M=XDN", b"M=X"))


def parsed(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The operations of CIGAR strings laid end to end: their string's number, length and code."""
    column = pc.fill_null(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    at = at - at[0] if len(at) else np.zeros(1, np.int64)
    place = np.flatnonzero(~_DIGIT[raw])
    owner = np.searchsorted(at, place, "right") - 1
    floor = np.maximum(np.concatenate([[-1], place[:-1]]), at[owner] - 1)  # what stands before the digits
    length, scale, digit = np.zeros(len(place), np.int64), 1, place - 1
    while (more := digit > floor).any():
        length[more] += (raw[digit[more]].astype(np.int64) - 48) * scale
        scale *= 10
        digit = digit - 1
    return owner, length, raw[place]


def _sums_before(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The sum of the values before each, of the same owner; owners ascend."""
    total = np.cumsum(values) - values
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else owner
    return total - np.repeat(total[first], np.diff(np.append(first, len(owner))))


def breaking_points(alignments: DataFrame, key: list[str], window_length: int) -> DataFrame:
    """alignments (key, cigar, t_begin, q_start): per tile that aligned columns touch, its first and past-last ones.

    q_start is where the query starts in the direction of the alignment. Columns: key, rank, t_first, q_first, t_last, q_last.
    Running sums within a CIGAR are no column expression in linear time, so each batch of rows is taken as arrays; nothing is shuffled.
    """
    k = len(key)

    def work(batches):
        for batch in batches:
            owner, n, code = parsed(batch.column(k))
            begin, start = (np.asarray(batch.column(k + i).cast(pa.int64())) for i in (1, 2))
            t0 = begin[owner] + _sums_before(np.where(_TARGET[code], n, 0), owner)
            q0 = start[owner] + _sums_before(np.where(_QUERY[code], n, 0), owner)
            use = _ALIGNED[code] & (n > 0)
            owner, n, t0, q0 = owner[use], n[use], t0[use], q0[use]
            low = t0 // window_length
            many = (t0 + n - 1) // window_length - low + 1
            block = np.repeat(np.arange(len(n)), many)
            rank = low[block] + np.arange(len(block)) - np.repeat(np.cumsum(many) - many, many)
            first = np.maximum(t0[block], rank * window_length)
            past = np.minimum((t0 + n)[block], (rank + 1) * window_length)
            own, shift = owner[block], (q0 - t0)[block]
            # blocks ascend along the target, so a tile's are neighbours, its first and last ones at the ends
            head = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (rank[1:] != rank[:-1])])) if len(own) else own
            tail = np.append(head[1:], len(own)) - 1 if len(own) else own
            keys = [column.take(pa.array(own[head])) for column in batch.columns[:k]]
            values = (rank[head], first[head], (first + shift)[head], past[tail], (past + shift)[tail])
            yield pa.RecordBatch.from_arrays([*keys, *map(pa.array, values)], [*key, "rank", "t_first", "q_first", "t_last", "q_last"])

    slim = alignments.select(*key, "cigar", "t_begin", "q_start")
    schema = ", ".join(f"{c} {slim.schema[c].dataType.simpleString()}" for c in key)
    return slim.mapInArrow(work, f"{schema}, rank long, t_first long, q_first long, t_last long, q_last long")


def wide_enough(window_length: int):
    """At least 0.02 of a window of the query, and more than one base of the target."""
    return ((F.col("q_last") - F.col("q_first")) >= 0.02 * window_length) & (F.col("t_last") - 1 != F.col("t_first"))


def layers(points: DataFrame, reads: DataFrame, key: list[str], window_length: int, quality_threshold: float) -> DataFrame:
    """points (key, read, strand, t_id, rank, ...) joined with reads (read, oriented data and quality): one layer a row.

    Columns: t_id, rank, key, begin, end (inclusive, in the tile), data, quality. Too narrow ones and those of low mean quality go.
    """
    joined = points.where(wide_enough(window_length)).join(reads, ["read", "strand"])
    out = joined.select(
        "t_id",
        "rank",
        *key,
        (F.col("t_first") - F.col("rank") * window_length).alias("begin"),
        (F.col("t_last") - 1 - F.col("rank") * window_length).alias("end"),
        slice_of(F.col("data"), F.col("q_first"), F.col("q_last")).alias("data"),
        slice_of(F.col("quality"), F.col("q_first"), F.col("q_last")).alias("quality"),
    )
    return out.where(F.col("quality").isNull() | (mean_quality(F.col("quality")) >= quality_threshold))


def stacks(windows: DataFrame, layered: DataFrame, key: list[str]) -> DataFrame:
    """windows with layers, an array in order of (begin, key); tiles without any have an empty one."""
    sorted_ = layered.groupBy("t_id", "rank").agg(F.array_sort(F.collect_list(F.struct("begin", *key, "end", "data", "quality"))).alias("layers"))
    empty = F.array().cast(sorted_.schema["layers"].dataType)
    return windows.join(sorted_, ["t_id", "rank"], "left").withColumn("layers", F.coalesce("layers", empty))


def coverage(targets: DataFrame, overlaps: DataFrame) -> DataFrame:
    """targets' t_id with the number of its overlaps, before any layer is dropped."""
    return targets.select("t_id").join(overlaps.groupBy("t_id").agg(F.count("*").alias("rc")), "t_id", "left").withColumn("rc", F.coalesce("rc", F.lit(0).cast("long")))


def stitched(consensus: DataFrame) -> DataFrame:
    """Per target: its windows' consensus joined in order, their number and how many were polished."""
    parts = F.array_sort(F.collect_list(F.struct("rank", "consensus")))
    return consensus.groupBy("t_id").agg(F.array_join(F.transform(parts, lambda x: x["consensus"]), "").alias("data"), F.count("*").alias("windows"), F.sum(F.col("polished").cast("long")).alias("polished"))
