"""Language identification with a string kernel.

The kernel of two texts counts the byte n-grams (n = 1..3, blended) present in both,
over lower-cased letters with every other run read as one space, normalised by each
text's own count. Nystroem landmarks, a bounded number of labelled texts, turn it into
features K(x, landmarks) (K_mm)^-1/2; kernel ridge regression learns one weight vector
for each language against the rest. A batch of texts is scored by matrix products:
presence bits times the landmarks' presence bits, then times the weights.

Cases: a null text, or one without a letter, is `und` with score 0; rows with a null
language or text are not learned from, nor are texts over MAX_BYTES; a very long text is
scored whole, as one step's work; an id that repeats counts once a language; equal scores go to the language that sorts
first; with nothing to learn from all is `und`; repeated rows are scored each on its
own and alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import LOWER_NP, map_texts, quoted, texts_of

#: Labelled texts of each language that are fitted on, and landmarks among them, at most.
PER_LANGUAGE, LANDMARKS = 400, 48

#: Languages, the most frequent ones, and over all of them texts, their bytes each and landmarks, at most: bounds the driver and what is broadcast.
MAX_LANGUAGES, MAX_TEXTS, MAX_BYTES, MAX_LANDMARKS = 512, 20_000, 16_384, 768

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_FOLD = np.where(_LETTER, np.arange(256), 0x20).astype(np.uint8)


def folded(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with each run of others as one space, and the borders of the texts in them."""
    low = _FOLD[LOWER_NP[raw]]
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] != 0x20) | (low[:-1] != 0x20)
    keep[at[:-1][at[:-1] < len(low)]] = True  # a text's first byte does not depend on the text before it
    return low[keep], np.concatenate([[0], np.cumsum(keep)])[at] if len(low) else at


def gram_codes(low: np.ndarray, n: int) -> np.ndarray:
    code = low[: len(low) - n + 1].astype(np.int32)
    for k in range(1, n):
        code = code << 8 | low[k : len(low) - n + 1 + k]
    return code


class Presence:
    """Maps texts to presence bits over a fixed set of n-grams, the landmarks' own."""

    def __init__(self, low: np.ndarray, at: np.ndarray | None = None, orders: int = 3):
        """low: texts laid end to end, at: their borders (one text if not given)."""
        doc = np.repeat(np.arange(len(at) - 1), np.diff(at)) if at is not None else np.zeros(len(low), np.int64)
        self.codes = []
        for n in range(1, orders + 1):
            some = gram_codes(low, n)[doc[: len(low) - n + 1] == doc[n - 1 :]] if len(low) >= n else np.zeros(0, np.int32)
            self.codes.append(np.unique(some))
        self._ready()

    def _ready(self) -> None:
        self.tables, self.size = [], 0
        for n, codes in enumerate(self.codes, 1):
            table = np.full(256**n, -1, np.int32)
            table[codes] = np.arange(len(codes))
            self.tables.append((n, table, self.size))
            self.size += len(codes)

    def __getstate__(self):
        return {"codes": self.codes}  # the tables are large and made anew where they are used

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._ready()

    def bits(self, low: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.zeros((len(at) - 1, self.size), np.float32)
        doc = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
        for n, table, first in self.tables:
            if len(low) < n:
                continue
            gram = table[gram_codes(low, n)]
            own = (gram >= 0) & (doc[: len(gram)] == doc[n - 1 :])  # no gram reaches into the next text
            out[doc[: len(gram)][own], gram[own].astype(np.int64) + first] = 1
        return out


class Model:
    def __init__(self, texts: list[str], langs: list[str], landmarks: int = LANDMARKS, ridge: float = 1e-3):
        """texts and langs in an order that does not depend on the language; the first of each language are its landmarks."""
        self.langs = sorted(set(langs))
        if not self.langs:
            return
        landmarks = max(1, min(landmarks, MAX_LANDMARKS // len(self.langs)))
        number = {x: i for i, x in enumerate(self.langs)}
        label = np.array([number[x] for x in langs])
        mark = np.concatenate([np.flatnonzero(label == c)[:landmarks] for c in range(len(self.langs))])
        low, at = folded(*texts_of(pa.array([texts[i] for i in mark], pa.string())))
        self.presence = Presence(low, at)
        bits = self.presence.bits(low, at)
        self.marks = (bits / np.sqrt(np.maximum(bits.sum(1, keepdims=True), 1))).T.copy()
        values, vectors = np.linalg.eigh((self.marks.T @ self.marks).astype(np.float64))
        use = values > 1e-4 * values.max()
        self.root = vectors[:, use] / np.sqrt(values[use])
        column = pa.array(texts, pa.string())
        x = np.concatenate([self.features(column.slice(i, 64)) for i in range(0, len(texts), 64)])
        y = np.where(label[:, None] == np.arange(len(self.langs)), 1.0, -1.0)
        weight = 1 / np.bincount(label)[label][:, None]  # languages count alike
        self.mean = (x * weight).sum(0) / weight.sum()
        centred = x - self.mean
        self.bias = (y * weight).sum(0) / weight.sum()
        self.w = np.linalg.solve(centred.T @ (centred * weight) + ridge * len(self.langs) * np.eye(x.shape[1]), centred.T @ ((y - self.bias) * weight))

    def features(self, column: pa.Array) -> np.ndarray:
        bits = self.presence.bits(*folded(*texts_of(column)))
        return (bits @ self.marks / np.sqrt(np.maximum(bits.sum(1, keepdims=True), 1))) @ self.root

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        n = len(column)
        out = np.zeros(n, np.int64) - 1
        score = np.zeros(n)
        if self.langs:
            margin = (self.features(column) - self.mean) @ self.w + self.bias
            spread = np.exp(3 * (margin - margin.max(1, keepdims=True)))
            out = margin.argmax(1)
            score = spread[np.arange(n), out] / spread.sum(1)
        langs = []
        for i, text in enumerate(column.to_pylist()):
            if not self.langs or text is None or not (any(c.isalpha() for c in text)):
                langs.append("und")
                score[i] = 0
            else:
                langs.append(self.langs[out[i]])
        return langs, score


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS) -> Model:
    """A model from a bounded sample: for each of the most frequent languages the texts of smallest hash of id, one for each id."""
    text, lang = F.col(quoted(text_col)), F.col(quoted(lang_col))
    rows = labelled.where(lang.isNotNull() & text.isNotNull()).select(F.col(quoted(id_col)).cast("string").alias("i"), lang.alias("l"), text.alias("t"))
    rows = rows.where(F.octet_length("t") <= MAX_BYTES).withColumn("h", F.xxhash64("i", "l"))
    sizes = rows.groupBy("l").agg(F.approx_count_distinct("h").alias("n")).orderBy(F.desc("n"), "l").limit(MAX_LANGUAGES).collect()
    if not sizes:
        return Model([], [], landmarks)
    per_language = max(1, min(per_language, MAX_TEXTS // len(sizes)))
    # few more than are wanted, by their hash alone; so no task sees all rows of a language, nor all that repeat an id
    share = labelled.sparkSession.createDataFrame([(r.l, min(1.0, 4 * per_language / max(1, r.n))) for r in sizes], "l string, share double")
    some = rows.join(F.broadcast(share), "l").where(F.shiftrightunsigned("h", 11) / F.lit(2.0**53) < F.col("share"))
    some = some.groupBy("l", "i", "h").agg(F.min("t").alias("t"))
    rank = F.row_number().over(Window.partitionBy("l").orderBy("h", F.col("i").asc_nulls_first()))
    sample = sorted((r.h, r.i or "", r.t, r.l) for r in some.withColumn("r", rank).where(F.col("r") <= per_language).collect())
    return Model([x[2] for x in sample], [x[3] for x in sample], landmarks)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, lang_pred, score (of the softmax over languages)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"{quoted(id_col)} {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double"

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        langs, score = shared.value.predict(part.column(1))
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(score)], [id_col, "lang_pred", "score"])

    return map_texts(docs.select(quoted(id_col), quoted(text_col)), work, schema, text_col)
