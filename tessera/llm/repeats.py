"""Windows of a corpus that stand elsewhere too, found exactly and without comparing documents in pairs.

A window is a fixed number of consecutive units (bytes or words) of one document. Its
key is the least hash of the grams in it (winnowing), so equal windows have equal keys,
and consecutive windows mostly share theirs: a run of windows with one key is one row.

 0  texts shorter than a window take no part; of texts that occur more than once, only one
    is searched: nothing in the others is new;
 A  each task lists its runs; of those that share a key within the task only one is
    dealt by its key, the others are candidates already. Where a text goes round (rulers,
    padding), windows that equal one a period before are settled at once, and only a
    first period is listed;
 B  runs whose key occurs twice or more are the candidates (a stream over sorted keys);
 C  joined with their texts, candidates become pieces: the bytes of a run's windows;
    equal pieces within a task are resolved there, but for one of them;
 D  pieces are dealt by key, and a kernel finds the equal windows among those of a key;
    a key with more pieces, windows or bytes than a group may have is handed on instead,
    each of its windows dealt by a 128-bit digest (X), so that no task holds an unbounded
    group; the HOT most frequent such keys are known from B and dealt to all tasks for it;
 E  the windows found are joined to their documents, as spans of units.

Rows are told apart by document id and a hash of the text: rows that repeat both are
one document to "earlier", and get the same spans. A null id counts as smaller than all
others.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import NULL_ID, mix, pieces, quoted, texts_of


@dataclass(frozen=True)
class Limits:
    """What one task holds at a time. group_rows, group_windows, group_bytes: pieces of one key that a kernel takes at most,
    windows in them, and their bytes; block_bytes: pieces of several keys that it takes at once; held_runs, held_bytes: runs,
    and bytes of pieces, that a task looks for repeats among."""

    group_rows: int = 50_000
    group_windows: int = 300_000
    group_bytes: int = 16 << 20
    block_bytes: int = 1 << 20
    held_runs: int = 600_000
    held_bytes: int = 24 << 20


#: Keys that are dealt to all tasks since their groups are too large, at most; bounds what is broadcast.
HOT = 10_000

#: Windows of a run, at most; longer ones are several.
LONGEST_RUN = 4096

#: m holds a run's number of windows, the anchor's offset (11 bits), and whether its key is too frequent for a group, its
#: windows are settled (not to be compared), it is a candidate already.
_RUN_SCHEMA = "h long, s int, id long, tag int, a int, m long"
_OFFSETS = 1 << 11
_WIDE, _SETTLED, _KNOWN = 4, 2, 1


def packed(n, off, known, settled=0):
    return n * (8 * _OFFSETS) + off * 8 + settled * _SETTLED + known * _KNOWN


def unpacked(m):
    """Windows, offset, known, settled, wide."""
    return m // (8 * _OFFSETS), m // 8 % _OFFSETS, m & _KNOWN != 0, m & _SETTLED != 0, m & _WIDE != 0


def split_long(parts: tuple[np.ndarray, ...], longest: int = LONGEST_RUN) -> tuple[np.ndarray, ...]:
    """Runs (key, document, first window, windows, offset, within) as runs of at most `longest` windows."""
    key, doc, a, n, off, within = parts
    if not len(n) or n.max() <= longest:
        return parts
    many = -(-n // longest)
    step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    key, doc, a, n, off, within = (np.repeat(x, many) for x in (key, doc, a, n, off, within))
    return key, doc, a + step * longest, np.minimum(n - step * longest, longest), np.maximum(off - step * longest, 0), within


class Units(Protocol):
    window: int
    least_bytes: int  # of a text with a window

    def runs(self, raw: np.ndarray, at: np.ndarray, later: bool) -> tuple[np.ndarray, ...]:
        """Of texts laid end to end: key, text number, first window, number of windows, anchor's offset, whether repeats may
        lie within, and whether the windows are settled: found here, and not to be compared."""

    def cutter(self, text: bytes):
        """A function (a, n) -> bytes of the units of n windows from a."""

    def equal(self, key, piece, n, off, order, later: bool) -> list[tuple[int, int, int]]:
        """(row, first, past last) windows of pieces that stand elsewhere too (later: in an earlier place)."""

    def digests(self, piece: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each window of a piece."""


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and tag tell rows apart; own is the id as it is."""
    id_, text = F.col(quoted(id_col)), F.col(quoted(text_col))
    return docs.select(F.coalesce(id_.cast("long"), F.lit(NULL_ID)).alias("id"), F.hash(text).alias("tag"), F.coalesce(text, F.lit("")).alias("text"), id_.alias("own"))


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _runs(units: Units, later: bool, limits: Limits):
    def flush(held: list) -> pa.RecordBatch | None:
        if not held:
            return None
        h, id_, tag, a, n, off, known, settled = (np.concatenate(x) for x in zip(*held))
        known |= settled
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        again = np.concatenate([[False], same])
        known[order] |= again | np.concatenate([same, [False]])
        s = np.zeros(len(h), np.int32)
        s[order[again]] = 1 + np.arange(again.sum(), dtype=np.int32)  # dealt anywhere
        return _batch({"h": pa.array(h), "s": pa.array(s), "id": pa.array(id_), "tag": pa.array(tag), "a": pa.array(a, pa.int32()), "m": pa.array(packed(n, off, known, settled))})

    def work(batches):
        held, rows = [], 0
        for batch in batches:
            for part in pieces(batch, "text"):
                key, doc, a, n, off, within, settled = units.runs(*texts_of(part.column(2)), later)
                held.append((key.view(np.int64), np.asarray(part.column(0))[doc], np.asarray(part.column(1))[doc], a, n, off, within, settled))
                rows += len(key)
                if rows > limits.held_runs:
                    yield flush(held)
                    held, rows = [], 0
        if rows:
            yield flush(held)

    return work


def _neighbours(columns: list[str], both: bool, out: list[str]):
    """Of rows sorted by columns: those that are equal in them to the row before (both: or after), or are known."""

    def work(batches):
        last = None  # the row before, as one-row batch, and whether it is given out yet
        given = True
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [np.asarray(batch.column(batch.schema.get_field_index(c))) for c in columns]
            same = np.ones(batch.num_rows, bool)
            for c, k in zip(columns, keys):
                same[1:] &= k[1:] == k[:-1]
                same[0] &= last is not None and last.column(last.schema.get_field_index(c))[0].as_py() == int(k[0])
            take = same.copy()
            if both:
                take[:-1] |= same[1:]
            if "m" in batch.schema.names:
                take |= unpacked(np.asarray(batch.column(batch.schema.get_field_index("m"))))[2]
            if both and same[0] and not given:
                yield last.select(out)
            given = bool(take[-1])
            last = batch.slice(batch.num_rows - 1)
            if take.any():
                yield batch.filter(pa.array(take)).select(out)

    return work


_PIECE_SCHEMA = "h long, s int, id long, tag int, a int, m long, piece binary"


def _cut(units: Units, later: bool, limits: Limits):
    def flush(rows: list, groups: dict) -> pa.RecordBatch:
        known, send, s, spread = [r[7] for r in rows], [not r[7] for r in rows], list(range(len(rows))), len(rows)
        for r, x in enumerate(rows):
            if not x[7] and not x[8]:
                s[r] = 0
        for same in groups.values():
            if len(same) > 1:
                first = min(same, key=lambda i: rows[i][1:4])  # the place: id, tag, a
                for i in same:
                    known[i] = i != first or not later
                    send[i] = i == first
                    if i != first:
                        spread += 1
                        s[i] = spread
        # in order of keys, so that like pieces stand together and compress well
        h, id_, tag, a, n, off, piece, wide, s, known = zip(*sorted(((*r[:6], r[6] if x else None, r[8], t, k) for r, x, t, k in zip(rows, send, s, known)), key=lambda r: (r[0], r[6] or b"")))
        return _batch(
            {
                "h": pa.array(h, pa.int64()), "s": pa.array(s, pa.int32()), "id": pa.array(id_, pa.int64()), "tag": pa.array(tag, pa.int32()), "a": pa.array(a, pa.int32()),
                "m": pa.array(packed(np.array(n, np.int64), np.array(off), np.array(known)) + _WIDE * np.array(wide)), "piece": pa.array(piece, pa.binary()),
            }
        )

    def work(batches):
        rows, groups, size, last = [], {}, 0, None
        for batch in batches:
            for part in pieces(batch, "text"):
                raw, at = texts_of(part.column(2))
                lists = part.column(3)
                border = np.asarray(lists.offsets) - lists.offsets[0].as_py()
                flat = lists.flatten()
                n_of, off_of, _, settled, wide = unpacked(np.asarray(flat.field(2)))
                fields = [x.tolist() for x in (np.asarray(flat.field(0)), np.asarray(flat.field(1)), n_of, off_of, settled, wide)]
                for d, (id_, tag) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist())):
                    if later and (id_, tag) == last:
                        continue  # a row that repeats the one before is the same document
                    last = id_, tag
                    cut = units.cutter(raw[at[d] : at[d + 1]].tobytes())
                    for i in range(border[d], border[d + 1]):
                        h, a, n, off, is_settled, is_wide = (f[i] for f in fields)
                        piece = None if is_settled else cut(a, n)
                        if not is_settled:
                            groups.setdefault((h, off, piece), []).append(len(rows))
                            size += len(piece)
                        rows.append((h, id_, tag, a, n, off, piece, is_settled, is_wide))
                    if size + 100 * len(rows) > limits.held_bytes:
                        yield flush(rows, groups)
                        rows, groups, size = [], {}, 0
        if rows:
            yield flush(rows, groups)

    return work


_FOUND_SCHEMA = "id long, tag int, a int, n int, off int, piece binary"


def _found(id_, tag, a, n, off=None, piece=None) -> pa.RecordBatch:
    nulls = [None] * len(id_)
    return _batch({"id": pa.array(id_, pa.int64()), "tag": pa.array(tag, pa.int32()), "a": pa.array(a, pa.int32()), "n": pa.array(n, pa.int32()), "off": pa.array(off or nulls, pa.int32()), "piece": pa.array(piece or nulls, pa.binary())})


def _compare(units: Units, later: bool, limits: Limits):
    """Over pieces sorted by key: the windows found, and the pieces of keys with too many, handed on."""

    def judge(rows: list) -> pa.RecordBatch | None:
        if not rows:
            return None
        h, id_, tag, a, n, off, piece, known = zip(*rows)
        order = np.unique(np.array(list(zip(id_, tag, a)), np.int64), axis=0, return_inverse=True)[1].ravel()  # places; equal for rows that repeat
        out = [(i, 0, n[i]) for i in range(len(rows)) if known[i]]
        out += [x for x in units.equal(h, piece, n, off, order, later) if not known[x[0]]]
        return _found([id_[i] for i, _, _ in out], [tag[i] for i, _, _ in out], [a[i] + p for i, p, _ in out], [q - p for _, p, q in out]) if out else None

    def hand_on(rows: list) -> pa.RecordBatch:
        """Pieces of a key with too many, to be compared by their windows' digests; what is known of them already goes along."""
        known = [r for r in rows if r[7]]
        ends = [[r[k] for r in known] + [r[k] for r in rows] for k in (1, 2, 3, 4)]
        none = [None] * len(known)
        return _found(*ends, none + [r[5] for r in rows], none + [r[6] for r in rows])

    def work(batches):
        block, size, windows = [], 0, 0  # whole groups
        group, group_size, group_windows, wide = [], 0, 0, False  # rows of the key at hand that are not in a block or handed on yet
        key = None
        for batch in batches:
            column = lambda c, batch=batch: batch.column(batch.schema.get_field_index(c))
            n, off, known, _, hot = unpacked(np.asarray(column("m")))
            plain = np.asarray(column("piece").is_null())
            if plain.any():  # resolved before
                yield _found(*[column(c).filter(pa.array(plain)).to_pylist() for c in ("id", "tag", "a")], n[plain].tolist())
            rows = zip(*[column(c).to_pylist() for c in ("h", "id", "tag", "a")], n.tolist(), off.tolist(), column("piece").to_pylist(), known.tolist())
            if hot.any():  # in parts, dealt to all tasks
                straight = [r for r, x, y in zip(rows, hot.tolist(), plain.tolist()) if x and not y]
                if straight:
                    yield hand_on(straight)
                rows = zip(*[column(c).to_pylist() for c in ("h", "id", "tag", "a")], n.tolist(), off.tolist(), column("piece").to_pylist(), known.tolist())
            for row, skip in zip(rows, (plain | hot).tolist()):
                if skip:
                    continue
                if row[0] != key:
                    if wide and group:
                        yield hand_on(group)
                    elif not wide:
                        block += group
                        size += group_size
                        windows += group_windows
                    group, group_size, group_windows, wide, key = [], 0, 0, False, row[0]
                    if size > limits.block_bytes or windows > limits.group_windows:
                        if (out := judge(block)) is not None:
                            yield out
                        block, size, windows = [], 0, 0
                group.append(row)
                group_size += len(row[6])
                group_windows += row[4]
                if len(group) > limits.group_rows or group_size > limits.group_bytes or group_windows > limits.group_windows or wide and (len(group) >= 1000 or group_size > limits.block_bytes):
                    yield hand_on(group)
                    group, group_size, group_windows, wide = [], 0, 0, True
        if wide and group:
            yield hand_on(group)
        elif not wide:
            block += group
        if (out := judge(block)) is not None:
            yield out

    return work


def _digested(units: Units, rows: int = 1 << 16):
    def flush(held: list) -> pa.RecordBatch:
        d, e, id_, tag, a, n = zip(*held)
        total = np.array(n)
        step = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
        each = lambda x, kind: np.repeat(np.array(x, kind), total)
        return _batch({"d": pa.array(np.concatenate(d).view(np.int64)), "e": pa.array(np.concatenate(e).view(np.int64)), "id": pa.array(each(id_, np.int64)), "tag": pa.array(each(tag, np.int32)), "a": pa.array((each(a, np.int64) + step).astype(np.int32)), "n": pa.array(np.ones(len(step), np.int32))})

    def work(batches):
        held, size = [], 0
        for batch in batches:
            part = batch.filter(pa.array(~np.asarray(batch.column(5).is_null())))
            for id_, tag, a, n, piece in zip(*[part.column(k).to_pylist() for k in (0, 1, 2, 3, 5)]):
                held.append((*units.digests(piece, n), id_, tag, a, n))
                size += n
                if size > rows:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return work


def _settled(batches):
    """Windows found, without the pieces handed on. It takes all columns, so that both uses of the exchange ask for the same."""
    for batch in batches:
        yield batch.filter(pa.array(np.asarray(batch.column(5).is_null()))).select(["id", "tag", "a", "n"])


def _copies(rows: DataFrame, least_bytes: int) -> DataFrame:
    """id, tag and copy for rows whose whole text occurs more than once: copy is false for those of the smallest id."""
    keys = rows.where(F.octet_length("text") >= least_bytes).select("id", "tag", F.xxhash64("text").alias("x"), F.octet_length("text").alias("size"))
    text = ["x", "tag", "size"]  # a digest of over 96 bits, by two unlike hashes and the length
    firsts = keys.groupBy(*text).agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    # the most frequent texts meet no rows in one task: they are few, and go to all
    hot = firsts.orderBy(F.desc("n"), *text).limit(HOT).select(*text, F.col("first").alias("hot"))
    told = keys.join(F.broadcast(hot), text, "left")
    rest = told.where("hot is null").select("id", "tag", "x", "size").join(firsts, text).select("id", "tag", "first")
    told = told.where("hot is not null").select("id", "tag", F.col("hot").alias("first")).unionByName(rest)
    return told.groupBy("id", "tag").agg(F.max(F.col("id") != F.col("first")).alias("copy"))


def spans(rows: DataFrame, units: Units, later: bool, limits: Limits = Limits()) -> DataFrame:
    """rows: keyed(). rows with copy (as in _copies(), null for texts that occur once) and found, an array of (a, n):
    windows a..a+n-1 stand elsewhere too (later: in an earlier place). Whole copies have no windows listed; see removed().

    The texts are dealt by id and tag once: all three uses ask for the same columns of all rows, and so read one exchange."""
    marked = rows.join(_copies(rows, units.least_bytes), ["id", "tag"], "left")
    searched = marked.where("copy is null or not copy").select("id", "tag", "text", "own")  # no filter of texts: it would be put before the exchange
    runs = searched.mapInArrow(_runs(units, later, limits), _RUN_SCHEMA).repartition("h", "s").sortWithinPartitions("h", "s")
    candidates = runs.mapInArrow(_neighbours(["h", "s"], True, ["id", "tag", "h", "a", "m"]), "id long, tag int, h long, a int, m long")
    hot = candidates.groupBy("h").agg(F.count("*").alias("k")).where(F.col("k") > limits.group_rows).orderBy(F.desc("k"), "h").limit(HOT)
    told = candidates.join(F.broadcast(hot), "h", "left").withColumn("m", F.when(F.col("k").isNull(), F.col("m")).otherwise(F.col("m") + _WIDE))
    lists = told.groupBy("id", "tag").agg((F.collect_set if later else F.collect_list)(F.struct("h", "a", "m")).alias("runs"))
    cut = rows.join(lists, ["id", "tag"]).select("id", "tag", "text", "runs", "own").mapInArrow(_cut(units, later, limits), _PIECE_SCHEMA)
    found = cut.repartition("h", "s").sortWithinPartitions("h", "s").mapInArrow(_compare(units, later, limits), _FOUND_SCHEMA).repartition("id", "tag")
    # both uses read one exchange; the pieces in it are those of too frequent keys
    wide = found.mapInArrow(_digested(units), "d long, e long, id long, tag int, a int, n int").repartition("d", "e").sortWithinPartitions("d", "e", "id", "tag", "a")
    wide = wide.mapInArrow(_neighbours(["d", "e"], not later, ["id", "tag", "a", "n"]), "id long, tag int, a int, n int")
    plain = found.mapInArrow(_settled, "id long, tag int, a int, n int").select("id", "tag", F.struct("a", "n").alias("x"))
    both = plain.unionByName(wide.select("id", "tag", F.struct("a", "n").alias("x")))
    return marked.join(both.groupBy("id", "tag").agg(F.collect_list("x").alias("found")), ["id", "tag"], "left")


def removed(found: list | None, copy: bool | None, n: int, window: int, later: bool) -> list[tuple[int, int]]:
    """Sorted disjoint spans of a document's n units that go. A whole text that occurs twice needs no search: its windows all do."""
    if copy is not None and (copy or not later):
        return [(0, n)] if n >= window else []
    return covered(found, window)


def covered(found: list | None, window: int) -> list[tuple[int, int]]:
    """Windows found, as sorted disjoint spans of the units that they cover."""
    out: list[list[int]] = []
    for a, b in sorted((x["a"], x["a"] + x["n"] - 1 + window) for x in found or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def key_minima(hashes: np.ndarray, width: int) -> np.ndarray:
    """Minima of all windows of width hashes."""
    size, out = 1, hashes
    while size * 2 <= width:
        out = np.minimum(out[: len(out) - size], out[size:])
        size *= 2
    return np.minimum(out[: len(hashes) - width + 1], out[width - size : width - size + len(hashes) - width + 1])


def second(values: np.ndarray) -> np.ndarray:
    """Other unit values, for an independent hash."""
    return mix(values + np.uint64(0xD6E8FEB86659FD93))
