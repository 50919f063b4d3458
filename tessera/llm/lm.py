"""Language-model scoring: exact unigram counts and a log-bilinear model with normalised probabilities.

Tokens are the words of the text, A-Z lower-cased, then one end. Counts of all
training tokens are gathered by a distributed sum. The model has a vector for each of the
`vocabulary` most frequent words, both as context and as target, and factors

    p(word | context) = p(class | context) p(word | class, context).

The end and the most frequent words are classes of their own; the other words of the
vocabulary are in groups of like endings; and every word beyond it belongs to one of a few
buckets by its last bytes, where it has its smoothed share of the counts. Both factors
are a softmax of (sum of position-weighted context vectors) . (class's or word's vector)
+ bias, so that the probabilities of all words, with one unseen word of each bucket,
sum to one.

Both are trained in numpy by noise-contrastive estimation: on a bounded sample first, then
on all training documents. These are dealt by a hash to shards of about SHARD_TOKENS tokens,
and the shards to `rounds` rounds. All shards of a round start from the same parameters, and
theirs are averaged by their tokens, in order of shards, for the next. Neither shards nor
the order in them depend on how the table is partitioned, and so scores don't either. Scores come from
batched matrix products over all classes, and over the words of each group.

A word's count is needed for every token. The types frequent enough to be among the
max_broadcast most frequent ones are broadcast, but for words over MAX_WORD bytes; the rest of
a document's words are joined with the count table by a shuffle.

Cases: a null text counts as empty, and has the end token only; without training rows
all counts are zero and the model is near uniform over its classes; repeated rows are
scored each on its own and alike; of equally frequent words those that sort first come
first; a very long text is one row and is scored in steps; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, drop_stored, map_texts, pieces, quoted, stored

#: Words that are classes of their own, buckets of words beyond the vocabulary, tokens of context, and the vectors' width.
HEAD, BUCKETS, CONTEXT, WIDTH = 63, 32, 4, 16

#: Words with vectors of their own, at most; words of a group, about; rounds of averaging; tokens of a shard, about.
VOCABULARY, GROUP, ROUNDS, SHARD_TOKENS = 8_000, 96, 2, 3_000_000

#: Types whose counts go to every worker, at most, and bytes of such a word.
MAX_BROADCAST, MAX_WORD = 200_000, 64

#: Documents of the warm start, and tokens of each, at most (it leaves longer ones out; the rounds take all).
WARM_DOCUMENTS, WARM_LENGTH = 400, 3000

#: Tokens that a step of training draws from, in the order of the shard.
_BLOCK = 1 << 16

#: Types and bytes of words that a task counts before it hands its counts on; and words that a worker remembers.
_HELD, _HELD_BYTES = 250_000, 16 << 20

END = b""


def bucket_of(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % BUCKETS


def _tokens(text: str | None) -> list[bytes]:
    words = text.encode().translate(LOWER).split() if text else []
    words.append(END)
    return words


def count_tokens(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """token (binary; the end is empty) and n, over all rows."""

    def count(batches):
        held: Counter = Counter()
        size = 0
        for batch in batches:
            for part in pieces(batch, "text"):
                for text in part.column(0).to_pylist():
                    tokens = _tokens(text)
                    held.update(tokens)
                    if max(map(len, tokens)) > MAX_WORD:
                        size += sum(len(w) for w in set(tokens) if len(w) > MAX_WORD)
                if len(held) > _HELD or size > _HELD_BYTES:
                    yield _packed(held)
                    held, size = Counter(), 0
        if held:
            yield _packed(held)

    def _packed(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["token", "n"])

    return docs.select(F.col(quoted(text_col)).alias("text")).mapInArrow(count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


class Counts:
    """What of the counts goes to every worker: totals, the frequent types, the vocabulary's layout and the buckets' sums."""

    def __init__(self, table: DataFrame, max_broadcast: int, vocabulary: int = VOCABULARY):
        total = table.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
        self.tokens, self.types = total.n or 0, total.v
        short = table.where(F.octet_length("token") <= MAX_WORD)
        # the least count such that at most max_broadcast types have it or more, from a histogram of a few thousand bins
        step = F.when(F.col("n") < 1024, F.col("n")).otherwise(F.floor(F.log2(F.col("n").cast("double")) * 64) + 384).cast("long")
        bins = sorted((r.b, r.least, r.types) for r in short.groupBy(step.alias("b")).agg(F.min("n").alias("least"), F.count("*").alias("types")).collect())
        self.least, held = None, 0
        for _, least, types in reversed(bins):
            if held + types > max_broadcast:
                break
            self.least, held = least, held + types
        frequent = short.where(F.col("n") >= self.least).collect() if self.least is not None else []
        frequent = sorted(((r.n, bytes(r.token)) for r in frequent), key=lambda x: (-x[0], x[1]))
        self.whole = len(frequent) == self.types
        self.n = {w: n for n, w in frequent}
        self.n |= {END: r.n for r in table.where(F.col("token") == F.lit(END)).collect()}  # a row at most
        self.frequent = len(set(self.n) | {END})
        ranked = [w for _, w in frequent if w != END]
        head, others = [END] + ranked[:HEAD], sorted(ranked[HEAD:vocabulary], key=lambda w: (w[::-1], w))
        #: Words with vectors: the classes of their own, then the groups, one after another.
        self.vocabulary = head + others
        self.head = len(head)
        edges = np.linspace(0, len(others), -(-len(others) // GROUP) + 1).astype(np.int64) if others else np.zeros(1, np.int64)
        self.borders = self.head + edges
        self.group = np.repeat(np.arange(len(edges) - 1), np.diff(edges))  # of each word from head on
        sums = table.groupBy((F.crc32(F.expr("substring(token, -2, 2)")) % BUCKETS).alias("b")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
        self.bucket = np.zeros((BUCKETS, 2))
        for r in sums:
            self.bucket[r.b] = r.n, r.v
        for w in self.vocabulary:
            if w in self.n:
                self.bucket[bucket_of(w)] -= self.n[w], 1
        own = np.array([self.n.get(w, 0) for w in self.vocabulary], float)
        groups = np.add.reduceat(own, self.borders[:-1]) if len(self.group) else np.zeros(0)
        #: Shares of the classes (own words, groups, buckets), and of the words in their group.
        self.shares = np.concatenate([own[: self.head], groups, self.bucket[:, 0]]) + 0.5
        self.shares /= self.shares.sum()
        self.within = own[self.head :] / np.maximum(groups, 1)[self.group] if len(self.group) else np.zeros(0)
        self.classes = len(self.shares)

    def class_of(self, code: int) -> int:
        return code if code < self.head else self.head + int(self.group[code - self.head])


class Words(dict):
    """Word to code, remembered: its place in the vocabulary, then in the other frequent words, or the number of all these plus its bucket."""

    def __init__(self, counts: Counts):
        known = set(counts.vocabulary)
        self.frequent = counts.vocabulary + [w for w in counts.n if w not in known]
        super().__init__((w, i) for i, w in enumerate(self.frequent))
        self.size, self.most = 0, _HELD_BYTES
        v, groups = len(counts.vocabulary), counts.head + len(counts.borders) - 1
        buckets = np.array([bucket_of(w) for w in self.frequent[v:]] + list(range(BUCKETS)), np.int64)
        self.classes = np.concatenate([np.arange(counts.head), counts.head + counts.group, groups + buckets]).astype(np.int64)
        self.context = np.concatenate([np.arange(v), v + buckets])  # the vector that stands for it before others
        self.logs = np.log10([counts.n.get(w, 0) + 0.1 for w in self.frequent] + [0.1] * BUCKETS)

    def __missing__(self, word: bytes) -> int:
        out = self[word] = len(self.frequent) + bucket_of(word)
        self.size += len(word) + 100
        return out

    def trim(self) -> None:
        if self.size > self.most:
            self.clear()
            self.update((w, i) for i, w in enumerate(self.frequent))
            self.size = 0


def sequences(codes: np.ndarray, border: np.ndarray, words_context: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts' context numbers in one array, each text after CONTEXT starting marks, and the tokens' places in it."""
    sizes = np.diff(border)
    at = np.arange(len(codes)) + CONTEXT * np.repeat(np.arange(1, len(sizes) + 1), sizes)
    sequence = np.full(len(codes) + CONTEXT * len(sizes), start)
    sequence[at] = words_context[codes]
    return sequence, at


class LogBilinear:
    """vector: of words (and buckets, and what stands before a text's start) as context; weight: of its places; target, bias:
    of classes; word, word_bias: of the vocabulary's words within their groups."""

    NAMES = ("vector", "weight", "target", "bias", "word", "word_bias")

    def __init__(self, counts: Counts, seed: int = 3):
        rng, v = np.random.default_rng(seed), len(counts.vocabulary)
        self.classes = len(counts.shares)
        self.shares, self.head, self.borders, self.group, self.within = counts.shares, counts.head, counts.borders, counts.group, counts.within
        small = lambda n: rng.normal(0, 0.1, (n, WIDTH)).astype(np.float32)
        self.vector = small(v + BUCKETS + 1)
        self.weight = np.ones((CONTEXT, WIDTH), np.float32)
        self.target, self.bias = small(len(self.shares)), np.log(self.shares).astype(np.float32)
        self.word = small(v)
        self.word_bias = np.concatenate([np.zeros(self.head), np.log(np.maximum(self.within, 1e-9))]).astype(np.float32)
        self.state: dict[str, np.ndarray] = {k: np.full(getattr(self, k).shape, 1e-3, np.float32) for k in self.NAMES}

    @property
    def start(self) -> int:
        return len(self.vector) - 1

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).ravel() for k in self.NAMES])

    def load(self, flat: np.ndarray) -> None:
        for k in self.NAMES:
            x = getattr(self, k)
            x[...] = flat[: x.size].reshape(x.shape)
            flat = flat[x.size :]

    def predicted(self, sequence: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._sums([self.vector * w for w in self.weight], sequence, at)

    @staticmethod
    def _sums(weighted: list[np.ndarray], sequence: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Sums of the places' vectors, which are weighted already."""
        out = weighted[0].take(sequence.take(at - 1), 0)
        for j in range(1, CONTEXT):
            out += weighted[j].take(sequence.take(at - 1 - j), 0)
        return out

    def log_probabilities(self, sequence: np.ndarray, at: np.ndarray, own: np.ndarray, word: np.ndarray, step: int = 1024) -> np.ndarray:
        """Natural log-probabilities, at the places `at`, of the classes `own` times those of the words `word` in them (-1: of the class alone)."""
        hidden = np.ones((len(at), WIDTH + 1), np.float32)  # its last column is for the biases
        out = np.zeros(len(at))
        weighted = [self.vector * w for w in self.weight]
        target, words = np.column_stack([self.target, self.bias]).T.copy(), np.column_stack([self.word, self.word_bias])
        size = lambda x: float(np.sqrt(np.einsum("ij,ij->i", x, x).max())) if len(x) else 0.0
        longest, longest_word = size(target.T), size(words[self.head :])
        buffer = np.empty(step * target.shape[1], np.float32)
        for a in range(0, len(at), step):  # steps whose scores stay in the processor's cache
            here = hidden[a : a + step]
            here[:, :WIDTH] = self._sums(weighted, sequence, at[a : a + step])
            scores = np.matmul(here, target, out=buffer[: len(here) * target.shape[1]].reshape(len(here), -1))
            out[a : a + step] = _log_share(scores, own[a : a + step], size(here) * longest)
        grouped = np.flatnonzero(word >= self.head)
        by = grouped[np.argsort(own[grouped].astype(np.int16 if self.classes < 2**15 else np.int64), kind="stable")]
        edge = np.flatnonzero(np.concatenate([[True], np.diff(own[by]) != 0, [True]])) if len(by) else np.zeros(1, np.int64)
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            g = int(own[by[a]]) - self.head
            first, past = int(self.borders[g]), int(self.borders[g + 1])
            for c in range(a, b, step):
                rows = by[c : min(c + step, b)]
                here = hidden.take(rows, 0)
                out[rows] += _log_share(here @ words[first:past].T, word[rows] - first, size(here) * longest_word)
        return out

    def train(self, sequence: np.ndarray, at: np.ndarray, own: np.ndarray, word: np.ndarray, rng: np.random.Generator, rate: float = 0.08, noise: int = 32, within: int = 2, step: int = 8192) -> None:
        """Noise-contrastive estimation by Adagrad; a step's places share the noise drawn for classes, and draw their own in their groups."""
        order = rng.permutation(len(at))
        log_noise = np.log(noise * self.shares).astype(np.float32)
        log_within = np.log(within * np.maximum(self.within, 1e-9)).astype(np.float32)
        # words of a group in the order of their shares' sums, each group a unit after the one before
        total = np.cumsum(self.within)
        upto = total - np.concatenate([[0], total])[(self.borders[:-1] - self.head)[self.group]] + self.group if len(self.group) else total
        for a in range(0, len(order), step):
            pick = order[a : a + step]
            here, cls = at[pick], own[pick]
            drawn = rng.choice(len(self.shares), noise, p=self.shares)
            before = np.stack([sequence.take(here - 1 - j) for j in range(CONTEXT)])
            vectors = self.vector.take(before, 0)
            hidden = vectors[0] * self.weight[0]
            for j in range(1, CONTEXT):
                hidden += vectors[j] * self.weight[j]
            right, offset = self.target.take(cls, 0), self.bias - log_noise
            true = np.einsum("ij,ij->i", hidden, right) + offset.take(cls)
            false = hidden @ self.target[drawn].T
            false += offset[drawn]
            d_true, d_false = _sigmoid(true) - 1, _sigmoid(false)  # the gradients of the loss
            right *= d_true[:, None]
            d_hidden = d_false @ self.target[drawn]
            d_hidden += right
            n = len(here)
            class_rows, class_bias = np.concatenate([cls, drawn]), np.concatenate([d_true, d_false.sum(0)])
            hidden_columns, false_columns = hidden.T.copy(), (d_false.T @ hidden).T
            m = np.flatnonzero(word[pick] >= self.head)
            if len(m):
                w, h = word[pick][m], hidden.take(m, 0)
                g = self.group.take(w - self.head)
                lies = np.searchsorted(upto, g[:, None] + rng.random((len(m), within)), "right")
                others = self.head + np.clip(lies, (self.borders[:-1] - self.head)[g][:, None], (self.borders[1:] - self.head - 1)[g][:, None])
                right, offset = self.word.take(w, 0), self.word_bias[self.head :] - log_within
                true2 = np.einsum("ij,ij->i", h, right) + offset.take(w - self.head)
                noisy = self.word.take(others, 0)
                false2 = np.einsum("ij,ikj->ik", h, noisy) + offset.take(others - self.head)
                d_true2, d_false2 = _sigmoid(true2) - 1, _sigmoid(false2)
                right *= d_true2[:, None]
                for k in range(within):
                    right += d_false2[:, k, None] * noisy[:, k]
                d_hidden[m] += right
                rows = np.concatenate([w, others.ravel()])
                self._update("word", rows, (np.concatenate([d_true2 * x, (d_false2 * x[:, None]).ravel()]) for x in h.T.copy()), n, rate)
                self._update("word_bias", rows, [np.concatenate([d_true2, d_false2.ravel()])], n, rate)
            weight = np.einsum("ij,cij->cj", d_hidden, vectors)
            self._update("vector", before.ravel(), (np.multiply.outer(self.weight[:, c], x).ravel() for c, x in enumerate(d_hidden.T.copy())), n, rate)
            self._update("target", class_rows, (np.concatenate([d_true * x, y]) for x, y in zip(hidden_columns, false_columns)), n, rate)
            self._update("bias", class_rows, [class_bias], n, rate)
            self._update("weight", np.arange(CONTEXT), weight.T, n, rate)

    def _update(self, name: str, rows: np.ndarray, columns: Iterable[np.ndarray], n: int, rate: float) -> None:
        """columns: of the rows' gradients, one after another, each small enough for the processor's cache."""
        x, state = getattr(self, name), self.state[name]
        touched = np.flatnonzero(np.bincount(rows, minlength=len(x)))
        total = [np.bincount(rows, column, len(x)).take(touched) for column in columns]
        gradient = ((np.stack(total, 1) if x.ndim == 2 else total[0]) / n).astype(np.float32)
        squares = state.take(touched, 0)
        squares += gradient**2
        state[touched] = squares
        x[touched] -= rate * gradient / np.sqrt(squares)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """Changes x."""
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _log_share(scores: np.ndarray, which: np.ndarray, most: float) -> np.ndarray:
    """Log-softmax of each row, at one column; changes scores. most: a bound of their sizes."""
    own = scores[np.arange(len(scores)), which]
    if not len(scores):
        return own
    if not most < 60 and (scores.max() > 60 or scores.min() < -60):  # beyond what sums of single-precision exponentials hold
        scores = scores.astype(np.float64) - scores.max(1, keepdims=True)
        own = scores[np.arange(len(scores)), which]
    return own - np.log(np.exp(scores, out=scores).sum(1))


def train(docs: DataFrame, counts: Counts, id_col: str = "doc_id", text_col: str = "text", seed: int = 11, rounds: int = ROUNDS, shard_tokens: int = SHARD_TOKENS) -> LogBilinear:
    """A model learned from all rows of docs."""
    spark = docs.sparkSession
    model, words_of = LogBilinear(counts), spark.sparkContext.broadcast(counts)
    shards = max(1, -(-counts.tokens // shard_tokens))

    def code(part: pa.RecordBatch, words: Words) -> pa.RecordBatch:
        texts = [_tokens(t) for t in part.column(2).to_pylist()]
        border = np.cumsum([0, *map(len, texts)])
        codes = np.fromiter(map(words.__getitem__, chain.from_iterable(texts)), np.int32, border[-1])
        words.trim()
        # words beyond the vocabulary are their buckets: all that training tells of them
        own = np.where(codes < len(words_of.value.vocabulary), codes, words.classes[codes] + len(words.frequent)).astype(np.int32)
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(border, pa.int32()), pa.array(own))], ["shard", "h", "codes"])

    h = F.xxhash64(F.col(quoted(id_col)).cast("string"), F.col(quoted(text_col)))
    slim = docs.select(F.pmod(F.xxhash64(h), F.lit(shards)).cast("int").alias("shard"), h.alias("h"), F.col(quoted(text_col)).alias("text"))
    coded = lambda rows: map_texts(rows, code, "shard int, h long, codes array<int>", setup=lambda: Words(words_of.value))
    share = max(1, -(-counts.n.get(END, 1) // WARM_DOCUMENTS))  # END stands once in each document
    sample = coded(slim.where(F.pmod("h", F.lit(share)) == 0)).where(F.size("codes") <= WARM_LENGTH).groupBy("h").agg(F.min("codes").alias("codes")).orderBy("h").limit(2 * WARM_DOCUMENTS).collect()
    if sample:
        texts = [np.array(r.codes) for r in sample]
        for k in range(2):
            _learn(model, counts, texts, np.random.default_rng([seed, k]), 2048)

    for k in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def learn(batches, k=k, shared=shared):
            mine, at, held, size, seen, block = None, None, [], 0, 0, 0

            def flush():
                nonlocal held, size, block
                if held:
                    _learn(mine, words_of.value, held, np.random.default_rng([seed, 100 + k, at, block]))
                held, size, block = [], 0, block + 1

            def given():
                flush()
                flat = mine.flat()
                parts = np.split(flat, range(4096, len(flat), 4096))
                own = [pa.array(np.full(len(parts), x)) for x in (at, seen)]
                return pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts))), *own, pa.array(parts, pa.list_(pa.float32()))], ["part", "shard", "seen", "x"])

            for batch in batches:
                shard, lists = np.asarray(batch.column(0)), batch.column(2)
                border, flat = np.asarray(lists.offsets), np.asarray(lists.values)
                for i, s in enumerate(shard.tolist()):
                    if s != at:
                        if mine is not None:
                            yield given()
                        mine, at, seen, block = _copy(shared.value), s, 0, 0
                    codes = flat[border[i] : border[i + 1]]
                    held.append(codes)
                    size += len(codes)
                    seen += len(codes)
                    if size >= _BLOCK:
                        flush()
            if mine is not None:
                yield given()

        mine = coded(slim.where(F.col("shard") % rounds == k)).repartition("shard").sortWithinPartitions("shard", "h")
        learned = mine.mapInArrow(learn, "part long, shard long, seen long, x array<float>")
        means = learned.repartition("part").sortWithinPartitions("part", "shard").mapInArrow(_averaged, "part long, x array<double>").collect()  # one model
        if means:
            model.load(np.concatenate([np.array(r.x) for r in sorted(means, key=lambda r: r.part)]))
    return model


def _copy(model: LogBilinear) -> LogBilinear:
    out = object.__new__(LogBilinear)
    out.__dict__.update(model.__dict__)
    for k in LogBilinear.NAMES:
        setattr(out, k, getattr(model, k).copy())
    out.state = {k: v.copy() for k, v in model.state.items()}
    return out


def _learn(model: LogBilinear, counts: Counts, texts: list[np.ndarray], rng: np.random.Generator, step: int = 8192) -> None:
    """A step or more over texts of codes as training has them: vocabulary numbers, or classes of buckets after all frequent words."""
    v, frequent = len(counts.vocabulary), counts.frequent
    codes = np.concatenate(texts).astype(np.int64)
    inside = codes < v
    classes = np.concatenate([np.arange(counts.head), counts.head + counts.group]).astype(np.int64)
    own = np.where(inside, classes[np.minimum(codes, v - 1)], codes - frequent)
    context = np.where(inside, codes, v + own - (counts.classes - BUCKETS))
    sequence, at = sequences(np.arange(len(codes)), np.cumsum([0, *map(len, texts)]), context, model.start)
    model.train(sequence, at, own, np.where(inside, codes, -1), rng, step=step)


def _averaged(batches):
    """Means of the arrays of each part, by tokens seen; summed in the order of the shards."""

    def given():
        return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([total / weight], pa.list_(pa.float64()))], ["part", "x"])

    part, total, weight = None, 0.0, 0
    for batch in batches:
        lists = batch.column(3)
        border, flat = np.asarray(lists.offsets), np.asarray(lists.values)
        for i, (p, seen) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
            if p != part:
                if part is not None:
                    yield given()
                part, total, weight = p, 0.0, 0
            total = total + flat[border[i] : border[i + 1]].astype(np.float64) * seen
            weight += seen
    if part is not None:
        yield given()


def score_documents(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", max_broadcast: int = MAX_BROADCAST, vocabulary: int = VOCABULARY, **more) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10); learning from rows that are not held out. more: of train()."""
    training = docs.where(~held_out)
    table = stored(count_tokens(training, text_col))
    counts = Counts(table, max_broadcast, vocabulary)
    model = train(training, counts, id_col, text_col, **more)
    model.state = {}
    shared = docs.sparkSession.sparkContext.broadcast((counts, model))
    schema = f"row long, id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, known double, modelled double, rest array<struct<token:binary,times:int>>"

    def run(batches):
        counts, model = shared.value
        task, done, words = TaskContext.get().partitionId(), 0, Words(counts)
        v, frequent = len(counts.vocabulary), len(words.frequent)
        # what the sums of logs of counts have too much: all of it for the vocabulary, else what a count is divided by within its bucket
        divide = np.log10(np.maximum(counts.bucket[:, 0], 0) + 0.1 * (np.maximum(counts.bucket[:, 1], 0) + 1))
        less = np.concatenate([words.logs[:v], divide[words.context[v:] - v]])
        place = np.arange(len(words.logs))
        is_held = (place < frequent) & (words.logs > np.log10(0.5))  # END may have no count
        known_logs = np.where(is_held | (place < v) | counts.whole, words.logs, 0.0)
        target_word = np.where(place < v, place, -1)
        for batch in batches:
            for part in pieces(batch, "text"):
                texts = [_tokens(t) for t in part.column(2).to_pylist()]
                border = np.cumsum([0, *map(len, texts)])
                codes = np.fromiter(map(words.__getitem__, chain.from_iterable(texts)), np.int64, border[-1])
                words.trim()
                sequence, at = sequences(codes, border, words.context, model.start)
                logp = model.log_probabilities(sequence, at, words.classes.take(codes), target_word.take(codes)) / np.log(10) - less.take(codes)
                held = is_held.take(codes)
                modelled, known, n_known = (np.add.reduceat(x, border[:-1]) for x in (logp, known_logs.take(codes), held.astype(np.int64)))
                rest = [[] for _ in texts]
                if not counts.whole:
                    missing = np.flatnonzero(~held & (codes >= v))
                    for d, (i, j) in enumerate(zip(*np.searchsorted(missing, [border[:-1], border[1:]]).tolist())):
                        rest[d] = [{"token": t, "times": k} for t, k in Counter(texts[d][m] for m in (missing[i:j] - border[d]).tolist()).items()]
                n = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(done, done + n) + (task << 40)),
                        part.column(0),
                        part.column(1),
                        pa.array(np.diff(border)),
                        pa.array(n_known, pa.int64()),
                        pa.array(known, pa.float64()),
                        pa.array(modelled),
                        pa.array(rest, pa.list_(pa.struct([("token", pa.binary()), ("times", pa.int32())]))),
                    ],
                    ["row", "id", "held_out", "n_tokens", "n_known", "known", "modelled", "rest"],
                )
                done += n

    scored = docs.select(F.col(quoted(id_col)).alias("id"), held_out.alias("held_out"), F.col(quoted(text_col)).alias("text")).mapInArrow(run, schema)
    if counts.whole:
        drop_stored(table)
        full = scored.withColumns({"more": F.lit(0.0), "more_known": F.lit(0).cast("long")})
    else:
        scored = stored(scored)
        # words beyond MAX_WORD are not broadcast, whatever their counts
        others = table.where((F.col("n") < counts.least) | (F.octet_length("token") > MAX_WORD)) if counts.least is not None else table
        rare = scored.select("row", F.explode("rest").alias("w")).select("row", "w.token", "w.times").join(others, "token", "left")
        rare = rare.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.1))).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).cast("long").alias("more_known"))
        full = scored.drop("rest").join(rare, "row", "left").fillna({"more": 0.0, "more_known": 0})
    whole = float(np.log10(counts.tokens + 0.1 * (counts.types + 1)))
    return full.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.col("more_known")).alias("n_known"),
        F.lit(counts.tokens).cast("long").alias("train_tokens"),
        (F.col("known") + F.col("more") - F.col("n_tokens") * F.lit(whole)).alias("base_score"),
        (F.col("modelled") + F.col("known") + F.col("more")).alias("score"),
    )
