"""Quality rules: base rules on counts, then an isolation forest over the rule statistics.

The forest is grown on the labelled good documents. Each tree draws 256 of all of them, by
a hash of its own, and one of the JUDGED statistics, in turn, and splits it at random values until a
point is alone or the depth is log2(256). Values are drawn from a range beyond the
labelled rows', so that one no usual document has falls into a branch that is soon empty. A
statistic's score of a document is high where few splits part it from the rest, by the
mean path length in that statistic's trees. So a document odd in one statistic alone is
found, however usual it is in the others.

Each statistic has a threshold of its own, calibrated on all labelled rows: the one that
rejects most bad rows while at most max_false of the good rows that pass the base rules are
rejected; where no bad row lies beyond the good ones, midway between those and the end of
the range. Without good labelled rows nothing but the base rules rejects. Labelled rows stay
where they are: a statistic has as many scores as its trees have splits, at most, and these are
counted there.

Cases: a null or empty text has no words and fails the base rules; a very long text is
one step's work; repeated rows and ties are judged each on its own and alike; labels with a
null id or a null quality are not used; an id that is labelled or that occurs more than
once counts once for each pair; with no rows the result is empty. Other
columns are kept by keep_good() whatever their names, and not read by judge().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BASE, drop_stored, map_texts, mix, quoted, stored
from tessera.llm.textstats import COUNTS, RATES, stats

#: Points that a tree is grown on.
SAMPLE = 256


def base_failed(counts: np.ndarray, min_words: int = 50, max_repeat_percent: int = 50) -> np.ndarray:
    return (counts[:, 0] < min_words) | (100 * counts[:, 4] > max_repeat_percent * counts[:, 0])


def _mean_path(n: np.ndarray | float):
    """Mean depth of an unsuccessful search in a random binary tree of n points."""
    n = np.asarray(n, float)
    m = np.maximum(n - 1, 1)
    return np.where(n > 2, 2 * (np.log(m) + 0.5772156649015329) - 2 * m / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """Random split trees in arrays, each over one statistic: node i of a tree has children 2i + 1 and 2i + 2.

    A split value is drawn from the whole range that the node stands for, not only
    from where its points lie; so a value that no usual document has falls into a
    branch that is soon empty, even if the usual ones do not vary in it at all.
    """

    def __init__(self, points: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = 24, sample: int = SAMPLE, seed: int = 7, drawn: list[list[np.ndarray]] | None = None):
        """points: (n, statistics); trees: of each statistic; drawn: each statistic's and tree's values, where they are drawn from points elsewhere."""
        rng = np.random.default_rng(seed)
        if drawn is None:
            size = min(sample, len(points))
            drawn = [[points[rng.choice(len(points), size, replace=False), c] for _ in range(trees)] for c in range(points.shape[1])]
        statistics = len(drawn)
        self.depth = int(np.log2(sample))
        self.far = high
        nodes = 2 ** (self.depth + 1) - 1
        self.value = np.full((statistics, trees, nodes), np.inf)  # all go left where a node has no split
        self.path = np.zeros((statistics, trees, nodes))
        self.norm = float(_mean_path(sample))
        for c in range(statistics):
            for t in range(trees):
                todo = [(0, 0, drawn[c][t], low[c], high[c])]
                while todo:
                    node, depth, own, least, most = todo.pop()
                    if depth == self.depth or len(own) < 2 or least >= most:
                        while True:  # the leaf goes on to the left, down to the last level
                            self.path[c, t, node] = depth + float(_mean_path(len(own)))
                            if 2 * node + 1 >= nodes:
                                break
                            node = 2 * node + 1
                        continue
                    v = rng.uniform(least, most)
                    self.value[c, t, node] = v
                    left = own < v
                    todo += [(2 * node + 1, depth + 1, own[left], least, v), (2 * node + 2, depth + 1, own[~left], v, most)]

    def scores(self, points: np.ndarray) -> np.ndarray:
        """(n, statistics) of 2 ** -(mean path / usual path): near 1 for values that are soon alone, 0.5 and less for the usual."""
        out = np.zeros(points.shape)
        for c, (values, paths) in enumerate(zip(self.value, self.path)):
            for value, path in zip(values, paths):
                node = np.zeros(len(points), np.int64)
                for _ in range(self.depth):
                    node = 2 * node + 1 + (points[:, c] >= value[node])
                out[:, c] += path[node]
        return 2.0 ** (-out / self.value.shape[1] / self.norm)


#: The statistics that the forest judges: the rules' own, by words or lines, and what is easily counted beside them.
JUDGED = [RATES.index(x) for x in ("word_length", "symbols", "dup_lines", "repeats", "upper", "digits", "marks", "shouts")]


def judged(rates: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(rates[:, JUDGED], 0))


def calibrate(scores: np.ndarray, good: np.ndarray, max_false: float, far: float = np.inf, times: np.ndarray | None = None) -> float:
    """The threshold above which most bad rows and at most max_false of the good ones lie; midway between the rows beside it.

    If no bad row lies above, midway between the good rows and far. times: how many rows each score stands for; one, if not given.
    """
    if not good.any():
        return np.inf
    order = np.argsort(scores[good], kind="stable")
    own, upto = scores[good][order], np.cumsum((np.ones(len(scores), np.int64) if times is None else times)[good][order])
    least = own[np.searchsorted(upto, upto[-1] - int(max_false * upto[-1]))]  # may stay
    above = scores[~good][scores[~good] > least]
    return float((least + above.min()) / 2) if len(above) else float((own[-1] + far) / 2)


def measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """own (the id as it is), counts and rates of every row, stored."""
    schema = f"own {docs.schema[id_col].dataType.simpleString()}, counts array<long>, rates array<double>"

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        counts, rates = stats(part.column(1))
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(list(counts), pa.list_(pa.int64())), pa.array(list(rates), pa.list_(pa.float64()))], ["own", "counts", "rates"])

    return stored(map_texts(docs.select(F.col(quoted(id_col)).alias("own"), F.col(quoted(text_col)).alias("text")), work, schema))


def rows_of(lists: pa.Array, width: int, kind: type = float) -> np.ndarray:
    """A column of lists of one length, as (n, width)."""
    return np.asarray(lists.flatten(), kind).reshape(-1, width)


def labelled(table: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """label, counts, rates and h, a hash of these and the id, of all measured() rows with a label."""
    id_, label = F.col(quoted(id_col)), F.col(quoted(label_col))
    known = labels.where(id_.isNotNull() & label.isNotNull()).select(id_.alias("__id"), label.cast("int").alias("label")).distinct()
    return table.join(known, F.col("own") == F.col("__id")).select("label", "counts", "rates", F.xxhash64(F.col("__id").cast("string"), "label", "rates").alias("h"))


def _least(tree: np.ndarray, draw: np.ndarray, value: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each tree, the `most` rows of least draws."""
    order = np.lexsort((value, draw, tree))
    tree, draw, value = tree[order], draw[order], value[order]
    keep = np.arange(len(tree)) - np.searchsorted(tree, tree) < most
    return tree[keep], draw[keep], value[keep]


def draw(rows: DataFrame, n: int, statistics: int, trees: int, sample: int = SAMPLE) -> list[list[np.ndarray]]:
    """For each statistic and tree, its values of min(sample, n) of the n rows (h, points): those of least hashes, other ones for each tree."""

    salts = np.arange(1, statistics * trees + 1, dtype=np.uint64) * BASE

    def take(share: float) -> list:
        limit = int(share * 2**63)

        def work(batches):
            held, size = [], 0
            for batch in batches:
                h, points = np.asarray(batch.column(0)).view(np.uint64), rows_of(batch.column(1), statistics)
                for j in range(statistics * trees):
                    own = (mix(h + salts[j]) >> np.uint64(1)).astype(np.int64)
                    at = np.flatnonzero(own < limit)
                    held.append((np.full(len(at), j), own[at], points[at, j // trees]))
                    size += len(at)
                if size > 4 * statistics * trees * sample:
                    held = [_least(*map(np.concatenate, zip(*held)), sample)]
                    size = len(held[0][0])
            if size:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _least(*map(np.concatenate, zip(*held)), sample)], ["tree", "draw", "value"])

        return rows.select("h", "points").mapInArrow(work, "tree long, draw long, value double").collect()

    share = min(1.0, 1.5 * sample / n)  # enough for all trees but by rare chance
    while True:
        found = np.array([tuple(r) for r in take(share)], [("tree", np.int64), ("draw", np.int64), ("value", float)])
        tree, _, value = _least(found["tree"], found["draw"], found["value"], sample)
        sizes = np.bincount(tree, minlength=statistics * trees)
        if share == 1 or sizes.min() >= min(sample, n):
            parts = np.split(value, np.cumsum(sizes)[:-1])
            return [parts[c * trees : (c + 1) * trees] for c in range(statistics)]
        share = min(1.0, 4 * share)


def _tally(rows: DataFrame, forest: IsolationForest, statistics: int) -> np.ndarray:
    """statistic, good, score and the number of rows that have it; a few thousand scores a statistic."""
    shared = rows.sparkSession.sparkContext.broadcast(forest)

    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            good, scores = np.asarray(batch.column(0)), shared.value.scores(rows_of(batch.column(1), statistics))
            for c in range(statistics):
                for g in (False, True):
                    score, n = np.unique(scores[good == g, c], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), c)), pa.array(np.full(len(score), g)), pa.array(score), pa.array(n)], ["statistic", "good", "score", "n"])

    counted = rows.select("good", "points").mapInArrow(work, "statistic long, good boolean, score double, n long").groupBy("statistic", "good", "score").agg(F.sum("n").alias("n"))
    return np.array([tuple(r) for r in counted.collect()], [("statistic", np.int64), ("good", bool), ("score", float), ("n", np.int64)])


def fit(table: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", max_false: float = 0.0002, trees: int = 24) -> tuple[IsolationForest | None, np.ndarray]:
    """A forest and its thresholds, one for each statistic, from all labelled rows of a measured() table; (None, inf) if there are no good rows."""
    statistics = len(JUDGED)

    def work(batches):
        for batch in batches:
            open_ = ~base_failed(rows_of(batch.column(1), len(COUNTS), np.int64))  # the others are rejected anyway
            points = judged(rows_of(batch.column(2), len(RATES)))[open_]
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(batch.column(3))[open_]), pa.array(np.asarray(batch.column(0))[open_] == 1), pa.array(list(points), pa.list_(pa.float64()))], ["h", "good", "points"])

    rows = stored(labelled(table, labels, id_col, label_col).mapInArrow(work, "h long, good boolean, points array<double>"))
    total = rows.agg(F.count_if("good").alias("n"), *[F.max(F.col("points")[c]).alias(f"most{c}") for c in range(statistics)]).first()
    if not total.n:
        drop_stored(rows)
        return None, np.full(statistics, np.inf)
    high = 1.5 * np.array([total[f"most{c}"] for c in range(statistics)]) + 0.1
    forest = IsolationForest(np.zeros((0, statistics)), np.zeros(statistics), high, trees, drawn=draw(rows.where("good"), total.n, statistics, trees))
    far = forest.scores(forest.far[None])[0]
    tally = _tally(rows, forest, statistics)
    drop_stored(rows)
    own = [tally[tally["statistic"] == c] for c in range(statistics)]
    return forest, np.array([calibrate(x["score"], x["good"], max_false, max(far[c], x["score"].max()), x["n"]) for c, x in enumerate(own)])


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """Per row: doc_id, the counts, base_failed, kept and anomaly (the greatest of its scores' ratios to their thresholds, null without a forest)."""
    table = measured(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(fit(table, labels, id_col, **more))
    names = ["own", *COUNTS, "base_failed", "kept", "anomaly"]
    schema = f"own {docs.schema[id_col].dataType.simpleString()}, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, kept boolean, anomaly double"

    def work(batches):
        for batch in batches:
            counts = rows_of(batch.column(1), len(COUNTS), np.int64)
            failed, kept, scores = verdicts(counts, rows_of(batch.column(2), len(RATES)), *shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in counts.T], pa.array(failed), pa.array(kept), pa.array(scores, pa.float64(), from_pandas=True)], names)

    return table.mapInArrow(work, schema).withColumnRenamed("own", id_col)


def verdicts(counts: np.ndarray, rates: np.ndarray, forest: IsolationForest | None, thresholds: np.ndarray):
    failed = base_failed(counts)
    scores = (forest.scores(judged(rates)) / thresholds).max(1) if forest else np.full(len(counts), np.nan)
    return failed, ~failed & ~(scores > 1), scores


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """docs, its columns as they are, without the rows that judge() does not keep."""
    table = measured(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(fit(table, labels, id_col, **more))
    drop_stored(table)
    where = docs.columns.index(text_col)

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        return part.filter(pa.array(verdicts(*stats(part.column(where)), *shared.value)[1]))

    return map_texts(docs, work, docs.schema, text_col)
