"""Shared plumbing: shared-folder tables, Arrow text batches, word boundaries, folds."""

from __future__ import annotations

import atexit
import os
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tessera.session import shared_dir

#: Bytes of text handled by one vectorised step; bounds a worker's memory.
CHUNK_BYTES = 2 << 20

#: Texts handled by one vectorised step: arrays of texts by features stay small where texts are short or empty.
CHUNK_ROWS = 2048

#: Stands for a null document id where ids are keys; smaller than any other id.
NULL_ID = -(2**63)

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
LOWER_NP = np.frombuffer(LOWER, np.uint8)

#: Bytes that part words ``[^\x20\x09-\x0D]+``; bytes.split() parts at the same ones.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def make_importable(spark: SparkSession) -> None:
    """Lets local Python workers import this package, wherever the driver was started."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def quoted(name: str) -> str:
    """A column's name as an expression, whatever is in it."""
    return "`" + name.replace("`", "``") + "`"


def columns_of(df: DataFrame) -> list[Column]:
    return [F.col(quoted(c)) for c in df.columns]


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """Names that are not taken, case aside: the given ones, with as many underscores before them as that needs."""
    used, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


#: Tables in the shared folder that are still there, with the session they were written in.
_LEFT: dict[str, SparkSession] = {}


def stored(df: DataFrame) -> DataFrame:
    """df written to a table in the shared folder and read back: later steps read it instead of computing it anew.

    drop_stored() deletes it when nothing reads it any more; what a result still reads goes with drop_all_stored(), at the
    latest when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    _LEFT[path] = spark
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def _delete(path: str) -> None:
    spark = _LEFT.pop(path, None)
    if spark is not None:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jvm.org.apache.hadoop.conf.Configuration() if spark._jsc.sc().isStopped() else spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def drop_stored(*tables: DataFrame) -> None:
    """Deletes what stored() wrote."""
    for df in tables:
        _delete(getattr(df, "_tessera_path", ""))


def drop_all_stored() -> None:
    """Deletes all that stored() wrote and that is still there; results that are not read yet are lost."""
    for path in list(_LEFT):
        try:
            _delete(path)
        except Exception:  # noqa: BLE001 - the JVM may be gone at the driver's end
            _LEFT.pop(path, None)


atexit.register(drop_all_stored)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id's text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, laid end to end, and len + 1 offsets; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(batch: pa.RecordBatch, column: str | int, limit: int = CHUNK_BYTES, rows: int = CHUNK_ROWS) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most `rows` texts and about limit bytes of text, or one text where that alone is longer."""
    n = batch.num_rows
    if not n:
        return
    _, at = texts_of(batch.column(column if isinstance(column, int) else batch.schema.get_field_index(column)))
    i = 0
    while i < n:
        j = min(i + rows, max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1))
        yield batch.slice(i, j - i)
        i = j


def map_texts(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType, column: str = "text", setup: Callable | None = None) -> DataFrame:
    """df.mapInArrow over slices bounded in bytes; setup() runs once a task and its value goes to work as second argument.

    With a StructType as schema, names are taken off the columns before and put on again after, as mapInArrow takes no dots in them.
    """
    where, own = df.columns.index(column), df.columns
    plain = isinstance(schema, StructType)
    if plain:
        names = schema.names
        schema = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(schema)])
        df = df.toDF(*[f"c{i}" for i in range(len(own))])
    inside = schema.names if plain else None

    def run(batches):
        tools = (setup(),) if setup else ()
        for batch in batches:
            for part in pieces(batch, where):
                out = work(part.rename_columns(own) if inside else part, *tools)
                if out is not None and out.num_rows:
                    yield out.rename_columns(inside) if inside else out

    out = df.mapInArrow(run, schema)
    return out.toDF(*names) if plain else out


def word_spans(raw: np.ndarray, at: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in raw, none across documents, and for each of len(at) documents' borders the words before it."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    word = is_word[raw]
    head = np.zeros(len(raw) + 1, bool)
    head[at[:-1]] = True  # a word starts anew at a document's border
    before = np.empty(len(raw), bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | head[:-1]))
    after = np.empty(len(raw), bool)
    after[-1] = False
    after[:-1] = word[1:]
    head[len(raw)] = True
    ends = np.flatnonzero(word & (~after | head[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def per_doc(counts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of a 0/1 or integer array over the documents whose borders are at."""
    total = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all bits (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= MIX1
    x ^= x >> np.uint64(27)
    x *= MIX2
    x ^= x >> np.uint64(31)
    return x


#: Odd base of the polynomial hashes modulo 2**64, and a fixed random 64-bit value for each byte.
BASE = np.uint64(0x9E3779B97F4A7C15)
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * BASE)
_INVERSE = pow(int(BASE), -1, 2**64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of raw, equal for equal bytes wherever they stand."""
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[raw] * powers(int(BASE), len(raw)), out=total[1:])
    back = powers(_INVERSE, len(raw) + 1)
    return mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def rolled(units: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of every k consecutive units, len(units) - k + 1 of them; not mixed."""
    if len(units) < k:
        return np.zeros(0, np.uint64)
    level, width, out, have = units, 1, None, 0
    while True:
        if k & width:
            if out is None:
                out, have = level, width
            else:  # out covers `have` units, level the `width` that stand before them
                n = min(len(level), len(out) - width)
                out = level[:n] * powers(int(BASE), have + 1)[have] + out[width : width + n]
                have += width
        if have == k:
            return out
        n = len(level) - width
        level = level[:n] * powers(int(BASE), width + 1)[width] + level[width : width + n]
        width *= 2
