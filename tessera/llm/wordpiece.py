"""Token counts by greedy longest match, in time linear in the text.

A trie of the vocabulary has, for each node, a failure link and the number of
tokens that greedy matching pops on following it; counting walks the trie and
adds those numbers, and no piece is ever built.

Cases: a null or empty text has no words and no tokens; a word with a byte that no
token covers counts as one unknown token; a very long text or word takes time in
proportion to its length; of tokens that match, ties cannot occur, as the longest is
one; repeated rows are counted each on its own; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tessera.llm.common import map_texts, quoted

#: Words whose counts a worker remembers, at most, and bytes of such a word; longer ones are counted anew.
REMEMBERED, MAX_REMEMBERED = 300_000, 64


class Automaton:
    """Counts the tokens of greedy longest matching, left to right, over the bytes of a word."""

    def __init__(self, vocabulary: Iterable[bytes]):
        self.step: dict[int, int] = {}  # node * 256 + byte -> node; the root is 0
        step, is_token, level = self.step, [False], []
        for token in vocabulary:
            node = 0
            for byte in token:
                key = node << 8 | byte
                child = step.get(key)
                if child is None:
                    child = step[key] = len(is_token)
                    is_token.append(False)
                node = child
            if node:
                is_token[node] = True
        self.fail = [-1] * len(is_token)  # -1: nothing matches on
        self.pops = [0] * len(is_token)
        children: list[list[tuple[int, int]]] = [[] for _ in is_token]
        for key, child in step.items():
            children[key >> 8].append((key & 255, child))
        level = [0]
        while level:  # breadth first: links of shorter strings are there when longer ones ask for them
            below = []
            for node in level:
                for byte, child in children[node]:
                    below.append(child)
                    if is_token[child]:
                        self.fail[child], self.pops[child] = 0, 1
                        continue
                    to, popped = self.fail[node], self.pops[node]
                    while to >= 0 and (to << 8 | byte) not in step:
                        popped += self.pops[to]
                        to = self.fail[to]
                    if to >= 0:
                        self.fail[child], self.pops[child] = step[to << 8 | byte], popped
            level = below
        self.known: dict[str, int] = {}

    def count(self, word: bytes) -> int:
        """Tokens of a word; 1 if it cannot be matched whole, 0 if it is empty."""
        step, fail, pops = self.step, self.fail, self.pops
        node = total = 0
        for byte in word:
            child = step.get(node << 8 | byte)
            while child is None:
                total += pops[node]
                node = fail[node]
                if node < 0:
                    return 1
                child = step.get(node << 8 | byte)
            node = child
        while node:
            total += pops[node]
            node = fail[node]
            if node < 0:
                return 1
        return total

    def counts(self, words: list[str]) -> int:
        known, long = self.known, {}
        for word in set(words):
            if word not in known:
                (known if len(word) <= MAX_REMEMBERED else long)[word] = self.count(word.encode())
        total = sum(map(known.__getitem__, words)) if not long else sum(known[w] if w in known else long[w] for w in words)
        if len(known) > REMEMBERED:
            known.clear()
        return total


def count_tokens(docs: DataFrame, vocabulary: Iterable[bytes], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words (matches of pattern) and n_tokens (greedy pieces of those, over all words)."""
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(vocabulary))
    schema = f"{quoted(id_col)} {docs.schema[id_col].dataType.simpleString()}, n_words long, n_tokens long"

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        automaton, split = shared.value, regex.compile(pattern).findall
        words = [split(t) if t else [] for t in part.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [part.column(0), pa.array([len(w) for w in words], pa.int64()), pa.array([automaton.counts(w) for w in words], pa.int64())], [id_col, "n_words", "n_tokens"]
        )

    return map_texts(docs.select(quoted(id_col), quoted(text_col)), work, schema, text_col)
