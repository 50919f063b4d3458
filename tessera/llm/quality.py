"""Quality classifier by pairwise ranking (Bradley-Terry).

Preference pairs of a good and a bad labelled document train weights w by logistic
loss on the difference of their features, so that sigmoid(w . (good - bad)) is the
chance that the good one wins. A document's rank score is w . features; the quantile
of the training scores at the share of bad labels is the threshold, and score =
sigmoid(rank score - threshold), so that it passes 0.5 there.

All labelled rows take part. They are dealt by a hash to blocks of about BLOCK rows, those of the
rarer label to so many that each block has some RARER of them; every row of a block is in each
of its rounds of pairs. Means, spreads and the terms of Newton's steps are summed over blocks in
their order, and the quantile is narrowed down by counting: no result depends on how the tables
are partitioned, and no task or driver holds all rows.

Cases: a null or empty text is scored like any other, from its features (all zero
counts); a very long one is one step's work; equal features have equal scores; labels with a null id or label are not used; repeated rows are scored each
on its own and alike; if the labels have one class only, or none, every score is 1,
0 or 0.5 respectively; an empty table gives an empty result; other columns of docs
are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import drop_stored, stored
from tessera.llm.rules import labelled, measured, rows_of
from tessera.llm.textstats import RATES

#: Preference pairs, at least; rounds of pairs of each block, at least.
PAIRS, ROUNDS = 60_000, 4

#: Labelled rows of a block, about; rows of the rarer label in it, about, at least; sums that reach the driver at a time.
BLOCK, RARER, SUMS = 4096, 64, 16


def features(rates: np.ndarray) -> np.ndarray:
    """The rates, square-rooted to draw in their tails, and products of each two."""
    x = np.sqrt(np.maximum(rates, 0))
    upper = np.triu_indices(x.shape[1])
    return np.concatenate([x, (x[:, :, None] * x[:, None, :])[:, upper[0], upper[1]]], 1)


def minimum(terms, size: int, l2: float) -> np.ndarray:
    """w of least logistic loss and l2 |w|^2 / 2, by Newton's method. terms(w): the loss's gradient and curve, and the number of pairs, as sums over these."""
    w = np.zeros(size)
    for _ in range(25):
        gradient, curve, pairs = terms(w)
        step = np.linalg.solve(curve / pairs + l2 * np.eye(size), gradient / pairs + l2 * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def pair_terms(difference: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    p = 1 / (1 + np.exp(-np.clip(difference @ w, -30, 30)))
    return difference.T @ (p - 1), (difference * (p * (1 - p))[:, None]).T @ difference, len(difference)


class Ranking:
    """w and the threshold, with the means and spreads that features are scaled by."""

    def __init__(self, rates: np.ndarray, label: np.ndarray, pairs: int = PAIRS, l2: float = 1e-3, seed: int = 5):
        """From rows at hand; see learn() for those of a table."""
        good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
        self.constant = constant(len(good), len(bad))
        if self.constant is not None:
            return
        x = features(rates)
        self.mean, self.spread = x.mean(0), x.std(0) + 1e-6
        x = self.scaled(rates)
        rng = np.random.default_rng(seed)
        difference = x[rng.choice(good, pairs)] - x[rng.choice(bad, pairs)]
        self.w = minimum(lambda w: pair_terms(difference, w), x.shape[1], l2)
        self.threshold = float(np.quantile(x @ self.w, len(bad) / (len(good) + len(bad))))

    def scaled(self, rates: np.ndarray) -> np.ndarray:
        return np.clip((features(rates) - self.mean) / self.spread, -8, 8)

    def scores(self, rates: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(rates), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.scaled(rates) @ self.w - self.threshold, -40, 40)))


def constant(good: int, bad: int) -> float | None:
    """The score of all documents where there are not both labels."""
    return None if good and bad else 1.0 if good else 0.0 if bad else 0.5


def in_blocks(rows: DataFrame, good: int, bad: int, block: int = BLOCK, rarer: int = RARER) -> tuple[DataFrame, int]:
    """labelled() rows as one row a block: block, rates of its good and of its bad rows, and for each whether this is the row's first block."""
    blocks = -(-(good + bad) // block)
    copies = min(blocks, -(-rarer * blocks // min(good, bad)))
    rare = F.col("label") == int(good < bad)
    dealt = rows.select("h", "label", "rates", F.explode(F.sequence(F.lit(0), F.when(rare, F.lit(copies - 1)).otherwise(F.lit(0)))).alias("k"))
    dealt = dealt.select(F.pmod(F.xxhash64("h") + F.col("k"), F.lit(blocks)).cast("int").alias("block"), "h", "label", "rates", "k")

    def pack(batches):
        def given():
            label, first, rates = (np.concatenate(x) for x in zip(*held))
            own = [rates[label == 1].tobytes(), rates[label == 0].tobytes(), first[label == 1].tobytes(), first[label == 0].tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), *[pa.array([x], pa.binary()) for x in own]], ["block", "good", "bad", "first_good", "first_bad"])

        at, held = None, []
        for batch in batches:
            number, label, rates = np.asarray(batch.column(0)), np.asarray(batch.column(2)), rows_of(batch.column(3), len(RATES))
            first = np.asarray(batch.column(4)) == 0
            for part in np.split(np.arange(len(number)), np.flatnonzero(np.diff(number)) + 1):
                if not len(part):
                    continue
                if number[part[0]] != at:
                    if held:
                        yield given()
                    at, held = int(number[part[0]]), []
                held.append((label[part], first[part], rates[part]))
        if held:
            yield given()

    packed = dealt.repartition("block").sortWithinPartitions("block", "h", "label", "rates").mapInArrow(pack, "block int, good binary, bad binary, first_good binary, first_bad binary")
    return stored(packed), blocks


def _unpacked(batches):
    """Block, rates of its good and its bad rows, rates of the rows whose first block it is."""
    for batch in batches:
        for block, *own in zip(*[c.to_pylist() for c in batch.columns]):
            good, bad = (np.frombuffer(x).reshape(-1, len(RATES)) for x in own[:2])
            first = [x[np.frombuffer(f, bool)] for x, f in zip((good, bad), own[2:])]
            yield block, good, bad, np.concatenate(first)


def _summed(table: DataFrame, blocks: int, terms) -> np.ndarray:
    """Sums over blocks of terms(block, good, bad, first), arrays of one length; in the order of blocks, most of them in tasks."""

    def work(batches):
        for block, *own in _unpacked(batches):
            yield pa.RecordBatch.from_arrays([pa.array([block * min(blocks, SUMS) // blocks]), pa.array([block]), pa.array([terms(block, *own)], pa.list_(pa.float64()))], ["part", "block", "x"])

    def add(batches):
        sums = {}
        for batch in batches:
            for part, x in zip(batch.column(0).to_pylist(), rows_of(batch.column(2), len(batch.column(2)[0])) if batch.num_rows else ()):
                sums[part] = sums[part] + x if part in sums else x
        for part, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([part]), pa.array([x], pa.list_(pa.float64()))], ["part", "block", "x"])

    schema = "part long, block long, x array<double>"
    out = table.mapInArrow(work, schema)
    if blocks > SUMS:
        out = out.repartition(SUMS, "part").sortWithinPartitions("part", "block").mapInArrow(add, schema)
    return sum(np.array(r.x) for r in sorted(out.collect(), key=lambda r: r.part))


def quantile(values: DataFrame, share: float) -> float:
    """The quantile of the column x, exactly, with a straight line between two rows' values, by counts in ever narrower bins."""
    total = values.agg(F.count("x").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).first()
    place = share * (total.n - 1)
    rank, low, high, bins = int(place), total.low, total.high, 4096
    while low < high:
        bin_ = F.least(F.floor((F.col("x") - low) / (high - low) * bins), F.lit(bins - 1)) if (high - low) / bins > 0 else F.col("x")
        for r in values.where(F.col("x").between(low, high)).groupBy(bin_.alias("bin")).agg(F.count("x").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy("bin").collect():
            if rank < r.n:
                low, high = r.low, r.high
                break
            rank -= r.n
    after = values.agg(F.count_if(F.col("x") <= low).alias("n"), F.min(F.when(F.col("x") > low, F.col("x"))).alias("next")).first()
    next_ = low if after.n > int(place) + 1 or after.next is None else after.next
    return low + (next_ - low) * (place - int(place))


def learn(rows: DataFrame, pairs: int = PAIRS, l2: float = 1e-3, seed: int = 5, block: int = BLOCK, rarer: int = RARER) -> Ranking:
    """A ranking from all labelled() rows."""
    out = object.__new__(Ranking)
    good, bad = rows.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
    out.constant = constant(good, bad)
    if out.constant is not None:
        return out
    table, blocks = in_blocks(rows.where(F.col("label").isin(0, 1)), good, bad, block, rarer)
    out.mean = _summed(table, blocks, lambda _, good, bad, first: features(first).sum(0)) / (good + bad)
    mean, rounds = out.mean, max(ROUNDS, -(-pairs // max(good, bad)))
    out.spread = np.sqrt(_summed(table, blocks, lambda _, good, bad, first: ((features(first) - mean) ** 2).sum(0)) / (good + bad)) + 1e-6
    size = len(mean)
    upper = np.triu_indices(size)

    def terms(w):
        def of_block(number, good, bad, first):
            total = np.zeros(size + len(upper[0]) + 1)
            if len(good) and len(bad):
                x, y, rng, n = out.scaled(good), out.scaled(bad), np.random.default_rng([seed, number]), max(len(good), len(bad))
                for _ in range(rounds):  # each row is in each
                    i, j = (rng.permutation(len(z))[np.arange(n) % len(z)] for z in (x, y))
                    gradient, curve, pairs = pair_terms(x[i] - y[j], w)
                    total += np.concatenate([gradient, curve[upper], [pairs]])
            return total

        total = _summed(table, blocks, of_block)
        curve = np.zeros((size, size))
        curve[upper] = total[size:-1]
        return total[:size], curve + np.triu(curve, 1).T, total[-1]

    out.w = minimum(terms, size, l2)

    def rank_scores(batches):
        for _, _, _, first in _unpacked(batches):
            yield pa.RecordBatch.from_arrays([pa.array(out.scaled(first) @ out.w)], ["x"])

    ranked = stored(table.mapInArrow(rank_scores, "x double"))
    out.threshold = quantile(ranked, bad / (good + bad))
    drop_stored(table, ranked)
    return out


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Per row: doc_id, score (0 to 1) and predicted (1 from 0.5 up); labels: the rows to learn from, all of them."""
    table = measured(docs, id_col, text_col)
    rows = stored(labelled(table, labels, id_col, label_col).select("label", "rates", "h"))
    shared = docs.sparkSession.sparkContext.broadcast(learn(rows))
    drop_stored(rows)
    schema = f"own {docs.schema[id_col].dataType.simpleString()}, score double, predicted int"

    def work(batches):
        for batch in batches:
            scores = shared.value.scores(rows_of(batch.column(1), len(RATES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["own", "score", "predicted"])

    return table.select("own", "rates").mapInArrow(work, schema).withColumnRenamed("own", id_col)
