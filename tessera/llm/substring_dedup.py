"""Substring dedup of words by seed and extend.

Removes every word covered by a window of `window` consecutive words whose word
sequence also starts earlier: in a document of smaller id, or earlier in the same one.
Windows are judged on the input, not on what is left. Words part at ASCII white space
and are taken unchanged.

Seeds are winnowed anchors: in each window the gram of least hash, the leftmost of
equals. Documents meet on equal anchors (see repeats.py). All occurrences of an anchor
are extended together, a word at a time to the left and to the right: extending splits
them into classes that still agree, so each step costs one pass over the occurrences, not
over their pairs. A window is the classes after its words to the left and to the right;
of each, the earliest occurrence stays. What is removed are the maximal repeats of window
words or more.

Whole copies of a text take no part: they are told by 96 bits of two unlike hashes and
the length, and later ones lose every word.

Cases: a null text has no words; a text of fewer words than the window loses nothing; a
very long text is cut by one task at a time and compared in pieces; of words that go
round with a period of up to four, only a first period is compared;
rows that repeat id and text are one document, and keep or lose the same; rows that
repeat an id with other texts are ordered by a hash of the text; a null id is smaller
than all others; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BASE, SPACE, map_texts, mix, rolled, span_hashes, texts_of, word_spans
from tessera.llm.repeats import _OFFSETS as OFFSETS
from tessera.llm.repeats import Limits, keyed, removed, second, spans

#: Periods, in words, of text that goes round, for which a first period stands for the rest.
PERIODS = 4


def classes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of the distinct pairs."""
    return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1] if len(a) else a


class Words:
    def __init__(self, window: int = 20, gram: int | None = None):
        self.window = window
        self.gram = gram or max(1, window // 5)
        self.width = window - self.gram + 1
        self.least_bytes = 2 * window - 1
        if self.width > OFFSETS:
            raise ValueError(f"a window has at most {OFFSETS} places for its anchor")

    def runs(self, raw, at, later):
        starts, ends, border = word_spans(raw, at, ~SPACE)
        none = np.zeros(0, np.int64)
        if len(starts) < self.window:
            return none.view(np.uint64), none, none, none, none, none.astype(bool), none.astype(bool)
        words = span_hashes(raw, starts, ends)
        hashes = mix(rolled(words, self.gram))
        n_windows = len(starts) - self.window + 1
        least, anchor = hashes[:n_windows].copy(), np.arange(n_windows)
        for d in range(1, self.width):
            here = hashes[d : d + n_windows]
            better = here < least
            least[better] = here[better]
            anchor[better] = np.flatnonzero(better) + d
        doc = np.repeat(np.arange(len(at) - 1), np.diff(border))
        ok = doc[:n_windows] == doc[self.window - 1 :]
        # windows that equal one a few words before, in the same document, are settled here
        again, found = np.zeros(n_windows, bool), np.zeros(n_windows, bool)
        for d in range(1, min(PERIODS, n_windows - 1) + 1):
            same = np.zeros(len(words) + 1, np.int64)
            np.cumsum((words[d:] == words[:-d]) & (doc[d:] == doc[:-d]), out=same[d + 1 :])
            here = same[self.window :] - same[: -self.window] == self.window
            here = here[:n_windows] & ok
            again |= here
            found |= here
            if not later:
                found[:-d] |= here[d:]
        ok &= ~again
        new = ok.copy()
        new[1:] &= (anchor[1:] != anchor[:-1]) | ~ok[:-1]
        a = np.flatnonzero(new)
        stop = np.flatnonzero(ok & np.concatenate([~ok[1:] | new[1:], [True]])) + 1
        edge = np.flatnonzero(np.diff(np.concatenate([[False], found, [False]]).astype(np.int8)))
        b, past = edge[::2], edge[1::2]
        whole = lambda x, y: np.concatenate([x, y])
        settled = whole(np.zeros(len(a), bool), np.ones(len(b), bool))
        return (
            whole(least[a], mix(b.astype(np.uint64) * BASE + np.uint64(len(words)))), doc[whole(a, b)], whole(a - border[doc[a]], b - border[doc[b]]), whole(stop - a, past - b),
            whole(anchor[a] - a, np.zeros(len(b), np.int64)), settled.copy(), settled,
        )

    def cutter(self, text):
        words = text.split()
        return lambda a, n: b" ".join(words[a : a + n - 1 + self.window])

    def digests(self, piece, n):
        raw = np.frombuffer(piece, np.uint8)
        starts, ends, _ = word_spans(raw, np.array([0, len(raw)]), ~SPACE)
        words = span_hashes(raw, starts, ends)
        return mix(rolled(words, self.window)), mix(rolled(second(words), self.window))

    def equal(self, key, piece, n, off, order, later):
        numbers: dict[bytes, int] = defaultdict(count(len(piece) + 1).__next__)
        left = self.width - 1
        row_words = left + self.window
        table = np.tile(np.arange(len(piece))[:, None], (1, row_words))  # a number of its own where a piece has no word
        for i, (p, o) in enumerate(zip(piece, off)):
            words = [numbers[w] for w in p.split()]
            table[i, left - o : left - o + len(words)] = words
        n, off = np.array(n), np.array(off)
        seed = np.unique(np.array(key), return_inverse=True)[1]
        for k in range(self.gram):
            seed = classes(seed, table[:, left + k])
        after = [seed]  # after[r]: agree on r words to the right of the seed
        for k in range(left):
            after.append(classes(after[-1], table[:, left + self.gram + k]))
        flags = np.zeros((len(piece), self.width), bool)
        before = seed
        for k in range(self.width):  # the windows that begin k words before the seed
            if k:
                before = classes(before, table[:, left - k])
            has = np.flatnonzero((off - k >= 0) & (off - k < n))
            if not len(has):
                continue
            same = classes(before[has], after[left - k][has])
            first = np.full(int(same.max()) + 1, len(piece))
            np.minimum.at(first, same, order[has])
            if later:
                flags[has, k] = order[has] > first[same]
            else:
                flags[has, k] = np.bincount(same)[same] > 1
        out = []
        for i in np.flatnonzero(flags.any(1)).tolist():
            at = np.sort(off[i] - np.flatnonzero(flags[i]))
            for g in np.split(at, np.flatnonzero(np.diff(at) != 1) + 1):
                out.append((i, int(g[0]), int(g[-1]) + 1))
        return out


def measure_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, limits: Limits = Limits()) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space), spans (of words removed), and where asked kept_text."""
    joined = spans(keyed(docs, id_col, text_col), Words(window), True, limits).select("own", "text", "found", "copy")

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        raw, at = texts_of(part.column(1))
        out = []
        for d, (f, copy) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist())):
            words = raw[at[d] : at[d + 1]].tobytes().split()
            cut, kept, last = removed(f, copy, len(words), window, True), [], 0
            for a, b in cut:
                kept += words[last:a]
                last = b
            kept = b" ".join(kept + words[last:])
            out.append((len(words), sum(b - a for a, b in cut), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in cut], kept.decode() if keep_text else None))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        n_words, gone, digest, cuts, texts = zip(*out)
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest), pa.array(cuts, kind), pa.array(texts, pa.string())], ["own", "n_words", "n_removed", "kept_sha256", "spans", "kept_text"])

    out = map_texts(joined, work, f"own {joined.schema['own'].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept_text string")
    out = out.select(F.col("own").alias(id_col), "n_words", "n_removed", "kept_sha256", "spans", "kept_text")
    return out if keep_text else out.drop("kept_text")
