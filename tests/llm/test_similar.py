"""Near-duplicates of the pipeline against brute force over all pairs."""

import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
from tessera.llm import similar
from tests.llm.oracle import firsts, shingles

SMALL = "/root/testdata/sf0.001"


def _copies(seed, n=40):
    """Texts with copies edited in more and more places, around the similarity that decides; some in one common passage."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    common, texts = [word() for _ in range(60)], {}
    for k in range(n):
        own = [word() for _ in range(rng.choice([3, 8, 40, 120]))]
        base = own + (common if k % 3 == 0 else [])
        for _ in range(4):
            edited = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 30)):
                edited[rng.randrange(len(edited))] = word()
            texts[len(texts)] = " ".join(edited)
    return texts


def test_components(spark):
    for seed in (1,):
        texts = _copies(seed)
        docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        got = sorted(r.doc_id for r in similar.keep_first(docs).collect())
        assert got == firsts(texts) and len(got) < len(texts) - 20


def test_stage_takes_near_copies(spark):
    """Ten words of 300 changed: similar by 0.8 at least, and fingerprints further apart than four bits for most."""
    rng, texts = random.Random(5), {}
    for k in range(30):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        texts[2 * k] = " ".join(words)
        for i in rng.sample(range(300), 5):
            words[i] = "x"
        texts[2 * k + 1] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert firsts(texts) == list(range(0, 60, 2))
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SMALL).collect()) == list(range(0, 60, 2))


def test_large_group(spark):
    """A chain in which each is similar to the next alone, and a star of near copies, in shards that have to be split."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(100)]
    texts = {}
    for i in range(60):
        texts[i] = " ".join(words)
        words[(7 * i) % 100] = f"c{i}"
    star = [f"s{i}" for i in range(200)]
    for i in range(60, 160):
        edited = list(star)
        for _ in range(3):
            edited[rng.randrange(200)] = f"e{rng.randrange(10**6)}"
        texts[i] = " ".join(edited)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert sorted(r.doc_id for r in similar.keep_first(docs, max_shard=6).collect()) == firsts(texts)


def test_real_texts(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(r.doc_id for r in similar.keep_first(docs).collect()) == firsts(texts)


def test_sets():
    texts = ["", "a b", "A  b", "a b c d e f", "a b c d e a b c d e a b c d e", None, "b a"]
    value, border = similar.shingle_sets(pa.array(texts))
    assert np.diff(border).tolist() == [len(shingles(t)) for t in texts]
    names = similar.set_names(value, border)
    assert names[1] == names[2] != names[6] and names[0] == names[5]


def test_forest():
    """Edges that join as much as all edges do, one fewer than the members of each component."""
    rng = np.random.default_rng(2)
    for _ in range(50):
        n, m = int(rng.integers(1, 30)), int(rng.integers(0, 60))
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        label = rng.integers(0, n, n)
        kept = similar.forest(a, b, label)

        def parts(edges):
            of = label.copy()
            for x, y in edges:
                of[of == of[x]] = of[y]
            return of

        whole, own = parts(zip(a, b)), parts(zip(a[kept], b[kept]))
        assert len(set(zip(whole.tolist(), own.tolist()))) == len(set(whole.tolist())) == len(set(own.tolist()))
        assert len(kept) == len(set(label.tolist())) - len(set(whole.tolist()))
