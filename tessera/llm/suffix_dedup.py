"""Exact substring dedup of bytes by suffix order and longest previous factors.

Removes every byte covered by a string of `window` bytes that starts elsewhere too
(keep="none"), or that starts in an earlier place (keep="first": the first copy stays).
Places are ordered by document id, then position. Strings never cross documents and
are judged on the input, not on what is left.

The suffixes that can matter (see repeats.py) are dealt by a key of their first
`window` bytes, so equal ones meet; each group is put in suffix order by those bytes, its
common prefixes are taken between neighbours, and a suffix's longest previous factor
comes from the previous and the next smaller position in that order; with positions
reversed it is the longest next factor. A suffix whose longest previous factor has
`window` bytes stands earlier too, and one whose longest previous or next factor has them
stands elsewhere.

Cases: a null text counts as empty and loses nothing; a text shorter than the window
loses nothing; a very long text is cut by one task at a time, and is compared in
pieces; of a text that goes round, as rulers do, only a first period is compared; rows that repeat id and text count as copies of each other for
keep="none", and as one document for keep="first"; an empty table gives an empty
result; remove_repeats() keeps all other columns whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BASE, BYTE_VALUES, NULL_ID, columns_of, fresh, map_texts, mix, quoted, rolled, texts_of
from tessera.llm.repeats import Limits, key_minima, keyed, removed, second, spans, split_long

#: Suffixes put in order at a time.
SORTED = 60_000


def previous_smaller(position: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """In suffix order: each suffix's common prefix with the last one before it whose position is smaller; 0 if there is none.

    lcp[i] is that of suffixes i - 1 and i. All links lead one suffix back at first; where that has no smaller
    position, a link is replaced by that suffix's own link, which skips only greater ones, until all are right.
    """
    n = len(position)
    at = np.concatenate([[position.min() - 1 if n else 0], position])  # a smallest one before all
    common = np.concatenate([[0, 0], lcp[1:]]) if n else np.zeros(1, np.int64)
    link = np.maximum(np.arange(n + 1) - 1, 0)
    while True:
        wrong = np.flatnonzero(at[link] >= at)[1:] if n else np.zeros(0, np.int64)
        if not len(wrong):
            return np.where(link > 0, common, 0)[1:]
        common[wrong] = np.minimum(common[wrong], common[link[wrong]])
        link[wrong] = link[link[wrong]]


def longest_previous(position: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Longest previous factor of each suffix, given in suffix order: the better of the previous and the next smaller position."""
    left = previous_smaller(position, lcp)
    back = np.concatenate([[0], lcp[1:][::-1]]) if len(lcp) else lcp
    return np.maximum(left, previous_smaller(position[::-1], back)[::-1])


def periodic(raw: np.ndarray, marks: np.ndarray, window: int) -> tuple[int, int, int]:
    """The usual distance d of the marks, and the longest range of windows that lie in a stretch of raw that repeats itself every d bytes."""
    d = int(np.bincount(np.diff(marks)).argmax()) if len(marks) > 1 else 0
    if not d or d >= len(raw):
        return 1, 0, 0
    differs = np.flatnonzero(np.concatenate([[True], raw[d:] != raw[:-d], [True]]))
    k = int(np.diff(differs).argmax())
    u, v = int(differs[k]), int(differs[k + 1]) - 1  # raw[i] == raw[i + d] for u <= i < v
    return d, u, max(u, v + d - window + 1)


def common_prefixes(rows: np.ndarray, step: int = 8192) -> np.ndarray:
    """Of each row of bytes, how many it has in common with the row before, from the start; 0 for the first."""
    out = np.zeros(len(rows), np.int64)
    for a in range(1, len(rows), step):
        differ = rows[a : a + step] != rows[a - 1 : min(a + step, len(rows)) - 1]
        out[a : a + step] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return out


class Bytes:
    def __init__(self, window: int = 200, gram: int | None = None):
        self.window = self.least_bytes = window
        self.gram = gram or max(1, window // 5)
        self.width = window - self.gram + 1

    def runs(self, raw, at, later):
        none = np.zeros(0, np.int64)
        if len(raw) < self.window:
            return none.view(np.uint64), none, none, none, none, none.astype(bool), none.astype(bool)
        hashes = mix(rolled(BYTE_VALUES[raw], self.gram))
        least = key_minima(hashes, self.width)
        doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
        ok = doc[: len(least)] == doc[self.window - 1 :]
        new = ok.copy()
        new[1:] &= (least[1:] != least[:-1]) | ~ok[:-1] | (doc[1 : len(least)] != doc[: len(least) - 1])
        a = np.flatnonzero(new)
        stop = np.flatnonzero(ok & np.concatenate([~ok[1:] | new[1:], [True]])) + 1
        n = stop - a
        within = np.zeros(len(a), bool)
        reach = np.arange(self.width)
        for i in range(0, len(a), 4096):  # a key that occurs twice in a run may hide equal windows in it
            s, e = a[i : i + 4096], stop[i : i + 4096] - 1
            first = s + hashes[s[:, None] + reach].argmin(1)
            last = e + self.width - 1 - hashes[e[:, None] + reach[::-1]].argmin(1)
            within[i : i + 4096] = first != last
        split, settled = [], []
        for i in np.flatnonzero(within & (n > 2 * self.width)).tolist():
            s, e = int(a[i]), int(stop[i])
            period, u, v = periodic(raw[s : e - 1 + self.window], np.flatnonzero(hashes[s : e - 1 + self.width] == least[s]), self.window)
            if v - u > period:  # windows u..v - 1 go round; a first period of them stands for the others
                split.append((i, s, s + u + period, s + v, e))
                settled.append((i, s + u + (period if later else 0), s + v))
        keep = np.ones(len(a), bool)
        keep[[x[0] for x in split]] = False
        ends = [(i, s, u) for i, s, u, _, _ in split] + [(i, v, e) for i, _, _, v, e in split if v < e]
        part = lambda rows: np.array(rows, np.int64).reshape(-1, 3).T
        more, done = part(ends), part(settled)
        owner = doc[a[done[0]]]
        head, of = np.concatenate([a[keep], more[1]]), np.concatenate([np.flatnonzero(keep), more[0]])
        n = np.concatenate([n[keep], more[2] - more[1]])
        key, doc, first, n, off, within = split_long((least[a[of]], doc[a[of]], head - at[doc[a[of]]], n, np.zeros(len(of), np.int64), within[of]))
        both = lambda x, y: np.concatenate([x, y])
        none = np.zeros(len(owner), np.int64)
        return (
            both(key, mix(done[1].astype(np.uint64) * BASE + at[-1:].astype(np.uint64))), both(doc, owner), both(first, done[1] - at[owner]), both(n, done[2] - done[1]),
            both(off, none), both(within, none == 0), both(np.zeros(len(key), bool), none == 0),
        )

    def cutter(self, text):
        return lambda a, n: text[a : a + n - 1 + self.window]

    def digests(self, piece, n):
        raw = np.frombuffer(piece, np.uint8)
        return mix(rolled(BYTE_VALUES[raw], self.window)), mix(rolled(second(BYTE_VALUES)[raw], self.window))

    def equal(self, key, piece, n, off, order, later):
        raw = np.frombuffer(b"".join(piece) + bytes(8), np.uint8)
        length, n = np.array([len(p) for p in piece]), np.array(n)
        first = np.cumsum(length) - length
        row = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        suffix = first[row] + step
        # suffixes that share 24 of their bytes with no other are alone, whatever their order
        eights = np.lib.stride_tricks.sliding_window_view(raw, 8)
        sign = np.zeros(len(suffix), np.uint64)
        for k in (0, (self.window - 8) // 2, self.window - 8) if self.window >= 8 else ():
            sign = mix(sign + eights[suffix + k].copy().view(np.uint64).ravel())
        by = np.argsort(sign, kind="stable")
        same = sign[by][1:] == sign[by][:-1]
        maybe = by[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
        flagged = np.zeros(len(suffix), bool)
        edges = np.flatnonzero(np.concatenate([[True], np.diff(sign[maybe].view(np.int64)) != 0])) if len(maybe) else maybe
        # in order of places: a row's order, then the step in it
        place = order[row] * (int(n.max()) + 1 if len(n) else 1) + step
        a = 0
        windows = np.lib.stride_tricks.sliding_window_view(raw, self.window)
        while a < len(maybe):
            b = int(np.searchsorted(edges, a + SORTED))
            b = int(edges[b]) if b < len(edges) else len(maybe)
            here = maybe[a:b]
            a = b
            text = np.ascontiguousarray(windows[suffix[here]])
            ranked = np.argsort(text.view(f"S{self.window}").ravel(), kind="stable")  # suffix order, by the first `window` bytes
            here, text = here[ranked], text[ranked]
            lcp = common_prefixes(text)
            if later:
                factor = longest_previous(place[here], lcp)
            else:  # rows that repeat have the same places, but are others
                own = np.empty(len(here), np.int64)
                own[np.argsort(place[here], kind="stable")] = np.arange(len(here))
                factor = np.maximum(longest_previous(own, lcp), longest_previous(-own, lcp))
            flagged[here[factor >= self.window]] = True
        at = np.flatnonzero(flagged)
        if not len(at):
            return []
        cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(row[at]) != 0)) + 1
        return [(int(row[g[0]]), int(step[g[0]]), int(step[g[-1]]) + 1) for g in np.split(at, cut)]


def byte_spans(docs: DataFrame, window: int, keep: str, id_col: str, text_col: str, limits: Limits) -> DataFrame:
    """keyed rows with what spans() finds in them."""
    if keep not in ("none", "first"):
        raise ValueError("keep is 'none' or 'first'")
    return spans(keyed(docs, id_col, text_col), Bytes(window), keep == "first", limits)


def measure_repeats(docs: DataFrame, window: int = 200, keep: str = "none", id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (array of start and end, in bytes)."""
    joined = byte_spans(docs, window, keep, id_col, text_col, limits).select("own", "text", "found", "copy")

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        raw, at = texts_of(part.column(1))
        out = []
        for d, (f, copy) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist())):
            text = raw[at[d] : at[d + 1]].tobytes()
            cut = removed(f, copy, len(text), window, keep == "first")
            out.append((len(text), sum(b - a for a, b in cut), len(cut), hashlib.sha256(without(text, cut)).hexdigest(), [{"start": a, "end": b} for a, b in cut]))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        n_bytes, gone, n_spans, digest, cuts = zip(*out)
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(n_bytes, pa.int64()), pa.array(gone, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digest), pa.array(cuts, kind)], ["own", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    out = map_texts(joined, work, f"own {joined.schema['own'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>")
    return out.select(F.col("own").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")


def without(text: bytes, cut: list[tuple[int, int]]) -> bytes:
    parts, last = [], 0
    for a, b in cut:
        parts.append(text[last:a])
        last = b
    return b"".join([*parts, text[last:]])


def remove_repeats(docs: DataFrame, window: int = 200, keep: str = "first", id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, limits: Limits = Limits()) -> DataFrame:
    """docs, its columns as they are, with the repeats cut out of the text.

    A span that begins or ends within a character is drawn in to whole ones, so the text stays valid UTF-8.
    length_col, if given, is set to the new length in characters. A null text stays null.
    """
    own = docs.columns
    i, t, f, c = fresh(own, "__id", "__tag", "__found", "__copy")
    found = byte_spans(docs, window, keep, id_col, text_col, limits).where("found is not null or copy is not null").dropDuplicates(["id", "tag"])
    found = found.select(F.col("id").alias(i), F.col("tag").alias(t), F.col("found").alias(f), F.col("copy").alias(c))
    marked = docs.withColumns({i: F.coalesce(F.col(quoted(id_col)).cast("long"), F.lit(NULL_ID)), t: F.hash(quoted(text_col))})
    joined = marked.join(found, [i, t], "left").select(*columns_of(docs), f, c)
    where, length = own.index(text_col), None if length_col is None else own.index(length_col)

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = part.column(where).to_pylist()
        for d, (f, copy) in enumerate(zip(part.column(len(own)).to_pylist(), part.column(len(own) + 1).to_pylist())):
            if texts[d] is not None and (f or copy is not None):
                raw = texts[d].encode()
                whole = []
                for a, b in removed(f, copy, len(raw), window, keep == "first"):
                    while a < b and raw[a] & 0xC0 == 0x80:
                        a += 1
                    while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
                        b -= 1
                    whole.append((a, b))
                texts[d] = without(raw, whole).decode()
        columns = part.columns[: len(own)]
        columns[where] = pa.array(texts, pa.string())
        if length is not None:
            columns[length] = pa.array([None if t is None else len(t) for t in texts]).cast(part.schema.field(length).type)
        return pa.RecordBatch.from_arrays(columns, names=own)

    return map_texts(joined, work, docs.schema, text_col)
