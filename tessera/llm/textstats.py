"""Counts and rates of whole texts, for the quality rules and the quality classifier."""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa

from tessera.llm.common import SPACE, per_doc, texts_of, word_spans

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
_CONTINUES = np.arange(256) & 0xC0 == 0x80  # bytes of a code point after its first
_UPPER, _LOWER, _DIGIT = (np.isin(np.arange(256), list(range(a, b))) for a, b in ((65, 91), (97, 123), (48, 58)))
_MARK = np.isin(np.arange(256), list(b"!\"'(),-./:;?@[\\]^_`{}~+="))

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: np.ndarray, border: np.ndarray, n_types: int) -> np.ndarray:
    """Words of each document that lie in 3-word windows found there twice or more; words: an id for each, border: documents' first words."""
    n = len(words)
    hit = np.zeros(n + 1, np.int64)
    if n >= 3:
        doc = np.repeat(np.arange(len(border) - 1), np.diff(border))
        at = np.flatnonzero(doc[:-2] == doc[2:])
        a, b, c = words[at], words[at + 1], words[at + 2]
        if n_types**3 * len(border) < 2**62:
            key = ((doc[at] * n_types + a) * n_types + b) * n_types + c
        else:  # pairs are numbered first, for the product to fit
            pair = np.unique(a * n_types + b, return_inverse=True)[1]
            pair = np.unique(pair * len(border) + doc[at], return_inverse=True)[1]
            key = pair * n_types + c
        order = np.argsort(key, kind="stable")
        same = np.diff(key[order]) == 0
        twice = at[order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]] if len(at) else at
        for k in range(3):
            hit[twice + k] = 1
    return per_doc(hit[:n], border)


def stats(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The COUNTS of each text (n, 5), and its rates (n, len(RATES)) as floats."""
    raw, at = texts_of(column)
    n = len(at) - 1
    text = raw.tobytes()
    starts, _, border = word_spans(raw, at, ~SPACE)
    ids: dict[bytes, int] = defaultdict(count().__next__)
    lines, types = np.zeros(n, np.int64), np.zeros(n, np.int64)
    numbers, n_lines = [], np.zeros(n, np.int64)
    for i, (s, e) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        doc = text[s:e]
        own = list(map(ids.__getitem__, doc.split()))
        numbers += own
        types[i] = len(set(own))
        with_words = [x for x in doc.split(b"\n") if x.strip()]
        n_lines[i] = len(with_words)
        lines[i] = len(with_words) - len(set(with_words))
    words = np.array(numbers, np.int64)
    n_words = np.diff(border)
    first_bytes = ~_CONTINUES[raw]
    word_chars = per_doc(first_bytes & ~SPACE[raw], at)
    symbols = per_doc(SYMBOL[raw], at)
    repeats = repeated_words(words, border, max(1, len(ids)))
    counts = np.stack([n_words, word_chars, symbols, lines, repeats], 1)
    some, chars = np.maximum(n_words, 1), np.maximum(per_doc(first_bytes, at), 1)
    upper, lower = per_doc(_UPPER[raw], at), per_doc(_LOWER[raw], at)
    rates = np.stack(
        [
            np.log1p(n_words),
            word_chars / some,
            symbols / some,
            lines / np.maximum(n_lines, 1),
            repeats / some,
            upper / np.maximum(upper + lower, 1),
            per_doc(_DIGIT[raw], at) / chars,
            per_doc(_MARK[raw], at) / some,
            per_doc(raw == 0x21, at) / some,
            types / some**0.85,  # types grow more slowly than words
            n_lines / some,
            per_doc(first_bytes & SPACE[raw], at) / some,
        ],
        1,
    ).astype(np.float64)
    return counts, rates


RATES = ["log_words", "word_length", "symbols", "dup_lines", "repeats", "upper", "digits", "marks", "shouts", "types", "lines", "spaces"]
