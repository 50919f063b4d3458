import math
import random
import re

import numpy as np
import pyarrow as pa

from tessera.llm import langid
from tessera.llm.langid import Presence, gram_codes


def test_no_gram_of_a_landmark_is_dropped():
    """More different grams of three bytes than 16 bits can number; the last ones start with the highest bytes."""
    low = np.random.default_rng(1).integers(0x80, 0x100, 120_000).astype(np.uint8)
    presence = Presence(low)
    n = len(np.unique(gram_codes(low, 3)))
    assert n > 65_536 and len(presence.codes[2]) == n
    last = np.array([0xFF, 0xFF, low[np.flatnonzero((low[:-1] == 0xFF) & (low[1:] == 0xFF))[0] + 2]], np.uint8)
    _, table, _ = presence.tables[2]
    assert (np.sort(table[table >= 0]) == np.arange(n)).all() and table[gram_codes(last, 3)[0]] >= 0


def _grams(text):
    """The byte n-grams of a text, n = 1 to 3, letters lower-cased and each run of others read as one space."""
    raw = re.sub(rb"[^a-z\x80-\xff]+", b" ", text.encode().lower())
    return {raw[i : i + n] for n in (1, 2, 3) for i in range(len(raw) - n + 1)}


def test_kernel_ridge_by_plain_loops():
    """Features from sets of n-grams, and weights at which the ridge loss has no slope."""
    rng = random.Random(3)
    stock = {"a": "aeio bcd", "b": "xyzo wvu", "c": "éüöä ktp"}
    langs = [rng.choice("abc") for _ in range(60)]
    texts = ["".join(rng.choice(stock[x] + "ET! ") for _ in range(rng.randint(5, 60))) for x in langs]
    model = langid.Model(texts, langs, landmarks=4)
    marks = [t for x in "abc" for t in [t for t, own in zip(texts, langs) if own == x][:4]]
    known = set().union(*map(_grams, marks))
    sets = lambda ts: [_grams(t) & known for t in ts]
    kernel = lambda xs, ys: np.array([[len(x & y) / math.sqrt(max(1, len(x)) * max(1, len(y))) for y in ys] for x in xs])
    values, vectors = np.linalg.eigh(kernel(sets(marks), sets(marks)))
    use = values > 1e-4 * values.max()
    features = kernel(sets(texts), sets(marks)) @ (vectors[:, use] / np.sqrt(values[use]))
    own = model.features(pa.array(texts))
    assert np.allclose(own @ own.T, features @ features.T, atol=1e-4)
    weight = np.array([1 / langs.count(x) for x in langs])[:, None]
    y = np.array([[1.0 if x == c else -1.0 for c in "abc"] for x in langs])
    centred = own - (own * weight).sum(0) / weight.sum()
    bias = (y * weight).sum(0) / weight.sum()
    slope = centred.T @ (weight * (centred @ model.w + bias - y)) + 1e-3 * 3 * model.w
    assert np.abs(slope).max() < 1e-6
    margin = centred @ model.w + bias
    got, score = model.predict(pa.array(texts))
    assert got == ["abc"[i] for i in margin.argmax(1)] and ((0 < score) & (score <= 1)).all()


def test_many_languages(spark):
    """200 languages, one id that a third of all rows repeat, texts of a megabyte: the sample stays bounded."""
    rng = random.Random(4)
    word = lambda k: "".join(chr(0x3B1 + (k * 7 + rng.randrange(9)) % 600) for _ in range(rng.randint(2, 6)))
    rows = [(i, " ".join(word(i % 200) for _ in range(12)), f"l{i % 200:03}") for i in range(1200)]
    rows += [(5, rows[5][1], "l005")] * 600 + [(9999, "x" * 1_000_000, "l000"), (None, "a b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert len(model.langs) == 200 and model.marks.shape[1] <= langid.MAX_LANDMARKS
    right = {r.doc_id: r.lang_pred for r in langid.identify(docs, model).where("doc_id < 1200").collect()}
    assert sum(right[i] == lang for i, _, lang in rows[:1200]) > 900
