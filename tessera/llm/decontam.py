"""Benchmark decontamination by a broadcast hash set of the items' word windows.

Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased. A
window is n consecutive words of an item; an item with fewer words, but not none,
is one window. A document's word windows are hashed in bulk, looked up in the set,
and each hit is confirmed on the words themselves. Hits of one item's windows add up.

The set's size is bounded: benchmark texts beyond max_block_bytes are taken in
blocks, one pass over the documents for each, and the hits of all blocks add up.

Cases: a null text has no words; an item whose id or text is null has no windows; a very
long text is one step's work; items tie in nothing, as all that occur are listed; equal item ids count as one item; repeated rows are judged each on its own; an
empty benchmark hits nothing; the input's other columns are kept by
decontaminate() whatever their names, and not read by find_hits().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER_NP, drop_stored, fresh, map_texts, mix, quoted, rolled, span_hashes, stored, texts_of, word_spans

#: Bytes of benchmark text in one broadcast block, at most (but for a single longer item).
MAX_BLOCK_BYTES = 8 << 20

WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_FILTER_BITS = 22


def _words(text: str) -> list[bytes]:
    raw = LOWER_NP[np.frombuffer(text.encode(), np.uint8)]
    starts, ends, _ = word_spans(raw, np.array([0, len(raw)]), WORD)
    low = raw.tobytes()
    return [low[s:e] for s, e in zip(starts.tolist(), ends.tolist())]


class Windows:
    """The windows of a block of items, in arrays: for each length their hashes in order, where their words stand in `text`
    and whose they are, and a bit filter of the hashes. Some 30 bytes a window, and 4 MB for each length."""

    def __init__(self, items: list[tuple[str, str]], n: int):
        self.names = [item_id for item_id, _ in items]
        parts, base = [], 0
        found: dict[int, list[tuple[np.ndarray, ...]]] = {}
        for k, (_, text) in enumerate(items):
            words = _words(text)
            size = min(n, len(words))
            if not size:
                continue
            joined = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words]) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])
            hashes = rolled(span_hashes(np.frombuffer(joined, np.uint8), starts, ends), size)
            _, first = np.unique(hashes, return_index=True)  # each window of an item once
            found.setdefault(size, []).append((hashes[first], base + starts[first], base + ends[first + size - 1], np.full(len(first), k)))
            parts.append(joined)
            base += len(joined)
        self.text = b"".join(parts)
        self.lengths = {}
        for size, arrays in found.items():
            hashes, start, end, item = (np.concatenate(x) for x in zip(*arrays))
            order = np.argsort(hashes, kind="stable")
            bits = np.zeros(1 << _FILTER_BITS, bool)
            bits[self.bits_of(hashes)] = True
            self.lengths[size] = bits, hashes[order], start[order], end[order], item[order].astype(np.int32)

    @staticmethod
    def bits_of(hashes: np.ndarray) -> np.ndarray:
        return (mix(hashes) >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)


def hits(raw: np.ndarray, at: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[set[str]]]:
    """Word starts, ends and borders by document, whether each word is hit, and each document's item ids."""
    low = LOWER_NP[raw]
    starts, ends, border = word_spans(low, at, WORD)
    hit = np.zeros(len(starts) + 1, np.int64)
    found: list[set[str]] = [set() for _ in range(len(at) - 1)]
    if len(starts) and windows.lengths:
        words, doc = span_hashes(low, starts, ends), np.repeat(np.arange(len(at) - 1), np.diff(border))
        text = low.tobytes()
        for size, (bits, known, first, past, item) in windows.lengths.items():
            if len(starts) < size:
                continue
            hashes = rolled(words, size)
            maybe = np.flatnonzero(bits[windows.bits_of(hashes)])
            maybe = maybe[doc[maybe] == doc[maybe + size - 1]]
            low_at, high_at = (np.searchsorted(known, hashes[maybe], side) for side in ("left", "right"))
            use = low_at < high_at
            for i, a, b in zip(maybe[use].tolist(), low_at[use].tolist(), high_at[use].tolist()):
                own = b" ".join([text[s:e] for s, e in zip(starts[i : i + size].tolist(), ends[i : i + size].tolist())])
                same = [k for k in range(a, b) if windows.text[first[k] : past[k]] == own]
                if same:
                    hit[i] += 1
                    hit[i + size] -= 1
                    found[doc[i]].update(windows.names[item[k]] for k in same)
    return starts, ends, border, np.cumsum(hit)[:-1] > 0, found


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, max_block_bytes: int):
    """The items in blocks of at most about max_block_bytes, each fetched on its own."""
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-total // max_block_bytes) or 1
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield [(r.i, r.t) for r in part.collect()]  # bounded: one block


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = 8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_block_bytes: int = MAX_BLOCK_BYTES, keep: bool = False) -> DataFrame:
    """Per row: doc_id, n_words, hit_words (ordinals of the hit words) and item_ids (sorted); with keep all columns of docs come first, then these three, whatever they have to be called then."""
    columns = docs.columns if keep else [id_col, text_col]
    own = fresh(columns, "__n_words", "__hit_words", "__item_ids")
    out = docs.select(*[quoted(c) for c in columns]).withColumns(dict(zip(own, (F.lit(0).cast("long"), F.array().cast("array<int>"), F.array().cast("array<string>")))))
    where, spark = columns.index(text_col), docs.sparkSession
    schema, width, before = out.schema, len(columns), None
    for k, items in enumerate(_blocks(benchmark, item_col, item_text_col, max_block_bytes)):
        if k:
            out = stored(out)
            if before is not None:
                drop_stored(before)
            before = out
        shared = spark.sparkContext.broadcast(Windows(items, n))

        def work(part: pa.RecordBatch, shared=shared, first=not k) -> pa.RecordBatch:
            raw, at = texts_of(part.column(where))
            starts, _, border, hit, found = hits(raw, at, shared.value)
            ordinal = np.arange(len(starts)) - np.repeat(border[:-1], np.diff(border))
            words = [ordinal[a:b][hit[a:b]] for a, b in zip(border[:-1].tolist(), border[1:].tolist())]
            if not first:
                words = [np.union1d(w, old) for w, old in zip(words, part.column(width + 1).to_pylist())]
                found = [f.union(old) for f, old in zip(found, part.column(width + 2).to_pylist())]
            new = [pa.array(np.diff(border), pa.int64()), pa.array([w.tolist() for w in words], pa.list_(pa.int32())), pa.array([sorted(f) for f in found], pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays([*part.columns[:width], *new], names=[*part.schema.names[:width], *own])

        out = map_texts(out, work, schema, text_col)
    return out if keep else out.select(quoted(id_col), *[F.col(a).alias(b) for a, b in zip(own, ("n_words", "hit_words", "item_ids"))])


def report(found: DataFrame, id_col: str = "doc_id", min_items: int = 2) -> DataFrame:
    """Figures of find_hits(): n_words, n_hit, n_items, items_sha256 and contaminated (min_items items or more)."""
    return found.select(
        id_col,
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("item_ids") >= min_items).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 8, min_items: int = 2, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """docs, its columns as they are, without documents that hold windows of min_items items or more; from the others the runs of hit words are cut out of the text.

    A document of fewer items stays, and what it has of them goes. A null text stays null.
    """
    found = find_hits(docs, benchmark, n, id_col, text_col, keep=True, **more)
    found = found.where(F.size(quoted(found.columns[-1])) < min_items)
    where = docs.columns.index(text_col)

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        raw, at = texts_of(part.column(where))
        low = LOWER_NP[raw]
        starts, ends, border = word_spans(low, at, WORD)
        texts = part.column(where).to_pylist()
        for d, words in enumerate(part.column(len(part.columns) - 2).to_pylist()):
            if words:
                kept, last = [], at[d]
                runs = np.split(np.array(words), np.flatnonzero(np.diff(words) != 1) + 1)
                for run in runs:
                    kept.append(raw[last : starts[border[d] + run[0]]].tobytes())
                    last = ends[border[d] + run[-1]]
                texts[d] = b"".join([*kept, raw[last : at[d + 1]].tobytes()]).decode()
        columns = part.columns[: len(part.columns) - 3]
        columns[where] = pa.array(texts, pa.string())
        return pa.RecordBatch.from_arrays(columns, names=part.schema.names[: len(columns)])

    return map_texts(found, work, docs.schema, text_col)
