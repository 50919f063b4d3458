"""Operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import math
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import bpe, decontam, lm, quality, queries, repeats, rules, simhash, substring_dedup, suffix_dedup, textstats, wordpiece
from tessera.llm.common import fold, pieces, stored
from tests.llm.oracle import firsts, lower as _lower

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def _fingerprint(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", _lower(text))
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def _components(prints, radius=4):
    label = {i: i for i in prints}
    ids = list(prints)

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[:x]:
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return {i: root(i) for i in ids}


def test_simhash(spark, texts):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op9_simhash(spark, SMALL).collect()}
    prints = {i: _fingerprint(t) for i, t in texts.items()}
    roots = _components(prints)
    assert got == {i: (f"{prints[i]:016x}", roots[i]) for i in texts}


def test_fingerprints_of_uneven_texts():
    """A text of many groups of shingles beside empty and short ones."""
    rng = random.Random(8)
    long = " ".join(f"w{rng.randrange(50)}" for _ in range(2000))
    texts = ["", None, "one two", long, " \t ", long[:900], "", long + " end"]
    got = simhash.fingerprints(pa.array(texts, pa.string()))
    assert [int(x) for x in got] == [_fingerprint(t or "") for t in texts]


def test_pieces():
    """Slices are bounded in texts and in bytes, and together they are the batch."""
    texts = ["x" * n for n in (0, 3, 40, 5, 5, 5, 0, 0, 0, 0)] + [None] * 5
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    parts = [p.column(0).to_pylist() for p in pieces(batch, "text", limit=10, rows=4)]
    assert sum(parts, []) == texts
    assert all(0 < len(p) <= 4 and (sum(len(t or "") for t in p) <= 10 or len(p) == 1) for p in parts)


@pytest.mark.parametrize("max_tree", [8192, 7])
def test_links_of_many(spark, max_tree):
    """Clusters with chains of links, in shards of one tree and of several, against all pairs."""
    rng = random.Random(3)
    values = set()
    for _ in range(12):
        v = rng.getrandbits(64)
        for _ in range(30):
            values.add(v)
            for _ in range(rng.choice([1, 2, 4, 6])):
                v ^= 1 << rng.randrange(64)
    signed = {v: v - (1 << 64) if v >> 63 else v for v in values}
    df = spark.createDataFrame([(s,) for s in signed.values()], "fp long")
    got = {r.node: r.root for r in simhash.label_components(simhash.link_values(df, 4, max_tree)).collect()}
    roots = _components({s: v for v, s in sorted(signed.items(), key=lambda x: x[1])})
    assert {s: got.get(s, s) for s in signed.values()} == roots


def test_blocks_always_share_one():
    rng = random.Random(1)
    for n in (10, 10**6, 10**9, 10**12):
        masks = simhash.plan_blocks(n, 4)
        for _ in range(2000):
            flip = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(not flip & m for m in masks)


def test_bpe(spark, texts):
    codec = bpe.default_codec()
    other = tiktoken.Encoding("own", pat_str=codec.pattern, mergeable_ranks=codec.ranks, special_tokens={})
    odd = ["", "  a\n\n b\t ", "don't I'LL we've", "\x1c\x85　x", "日本語テキスト 123 ½", "👩‍👩‍👧 naïve", "a" * 3000, "<|endoftext|>", "x\r\n\r\ny  z"]
    for text in [*texts.values(), *odd]:
        ids = codec.encode(text)
        assert ids == other.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    encoded = bpe.encode_documents(docs, codec)
    assert {r.doc_id: r.text for r in bpe.decode_documents(encoded, codec).collect()} == dict(enumerate(odd))
    for r in encoded.collect():
        ids = np.array(other.encode_ordinary(odd[r.doc_id]), "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(odd[r.doc_id].encode()).hexdigest())


@pytest.mark.parametrize("n", [0, 1, 2, 5, 1000])
def test_perfect_hash(n):
    keys = [f"k{i}".encode() for i in range(n)]
    own = bpe.PerfectHash(keys)
    assert sorted(own.slots(keys)) == list(range(n))
    assert own.slots([b"absent", b""]) == [-1, -1]


def test_word_pieces():
    rng = random.Random(2)
    for _ in range(200):
        vocabulary = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 8))}
        automaton = wordpiece.Automaton(vocabulary)

        def greedy(word):
            i = n = 0
            while i < len(word):
                size = next((k for k in range(len(word) - i, 0, -1) if word[i : i + k] in vocabulary), 0)
                if not size:
                    return 1
                i, n = i + size, n + 1
            return n

        for _ in range(60):
            word = bytes(rng.choice(b"abcd") for _ in range(rng.randint(0, 9)))
            assert automaton.count(word) == greedy(word), (vocabulary, word)


def test_token_counts(spark, texts):
    codec = bpe.default_codec()
    longest = max(map(len, codec.ranks))
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in queries.op2_token_counts(spark, SMALL).collect()}
    for i, text in texts.items():
        words, n = codec.split(text), 0
        for word in map(str.encode, words):
            while word:
                size = next(k for k in range(min(longest, len(word)), 0, -1) if word[:k] in codec.ranks)
                word, n = word[size:], n + 1
        assert got[i] == (len(words), n)


def test_counts_of_texts(texts):
    for sample in (list(texts.values()), ["a b c a b c", "a b\na b\n\n \na b", "", "#|é é é é", "x y z x y"]):
        counts, rates = textstats.stats(pa.array(sample, pa.string()))
        assert np.isfinite(rates).all()
        for own, text in zip(counts.tolist(), sample):
            words = re.findall(r"[^\x20\x09-\x0D]+", text)
            lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
            windows = Counter(zip(words, words[1:], words[2:]))
            hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
            assert own == [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)]


def test_repeated_words_of_many_types():
    rng = np.random.default_rng(0)
    words, border = rng.integers(0, 9, 500), np.array([0, 200, 200, 500])
    assert textstats.repeated_words(words, border, 9).tolist() == textstats.repeated_words(words, border, 1 << 21).tolist()


def test_rules(spark):
    rows = queries.op8_quality_rules(spark, "/root/testdata/sf0.01").collect()
    label = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    passed = [r for r in rows if not r.base_failed]
    assert all(not r.kept for r in rows if r.base_failed)
    good, bad = ([r.kept for r in passed if label.get(r.doc_id) == q] for q in (1, 0))
    assert np.mean(good) > 0.99 and (not bad or np.mean(bad) < 0.3)


def test_isolation():
    rng = np.random.default_rng(1)
    usual = np.stack([rng.normal(0.2, 0.02, 600), np.zeros(600)], 1)
    forest = rules.IsolationForest(usual, np.zeros(2), np.ones(2), trees=40)
    points = np.array([[0.2, 0.5], [0.9, 0.0], [0.9, 0.9], [0.2, 0.0]])
    odd, top = forest.scores(points), np.quantile(forest.scores(usual), 0.99, axis=0)
    assert (odd > top).tolist() == [[False, True], [True, False], [True, True], [False, False]]

    def path(c, t, x, node=0, depth=0):
        """Splits down to a leaf, walked one by one."""
        v = forest.value[c, t, node]
        if depth == forest.depth or v == np.inf:
            return forest.path[c, t, node]
        return path(c, t, x, 2 * node + 1 + (x >= v), depth + 1)

    for i, point in enumerate(points):
        for c in range(2):
            mean = np.mean([path(c, t, point[c]) for t in range(40)])
            assert odd[i, c] == pytest.approx(2 ** (-mean / forest.norm))
    good = np.array([True, True, False])
    assert rules.calibrate(np.array([0.1, 0.2, 0.9]), good, 0.0) == pytest.approx(0.55)
    assert rules.calibrate(np.array([0.1, 0.2, 0.15]), good, 0.0, 0.8) == pytest.approx(0.5)


def test_base_rules(texts):
    """base_failed by its words: fewer than 50 words, or more than half of them in windows found twice."""
    sample = [*texts.values(), "a " * 49, "a b c d " * 20, " ".join(map(str, range(50))), " ".join(map(str, range(49)))]
    counts, _ = textstats.stats(pa.array(sample, pa.string()))
    for (n, _, _, _, repeats_), failed in zip(counts.tolist(), rules.base_failed(counts)):
        assert failed == (n < 50 or 100 * repeats_ > 50 * n)
    assert rules.base_failed(counts)[-4:].tolist() == [True, True, False, True]


def test_odd_in_one_statistic(spark):
    """Documents like the good ones but in one statistic go: repeated lines, digits, long words, symbols."""
    rng = random.Random(9)
    stock = ["".join(rng.choice("aeiourstnlmd") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    line = lambda n=10: " ".join(rng.choice(stock) for _ in range(n)).capitalize() + "."
    good = {i: "\n".join(line() for _ in range(rng.randint(8, 30))) for i in range(400)}
    again = line(5)
    odd = {
        1000: "\n".join(x for _ in range(7) for x in (line(15), again)),
        1001: " ".join(str(rng.randrange(10**6)) for _ in range(90)),
        1002: " ".join("".join(rng.choice(stock) for _ in range(40)) for _ in range(90)),
        1003: "\n".join(line() + " # | $ %" for _ in range(12)),
    }
    docs = spark.createDataFrame([*good.items(), *odd.items()], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(300)], "doc_id long, quality int")
    rows = {r.doc_id: r for r in rules.judge(docs, labels).collect()}
    assert not any(rows[i].base_failed for i in odd) and not any(rows[i].kept for i in odd)
    assert sum(rows[i].kept for i in good) >= 398


def test_ranking_by_plain_loops():
    """The weights are where the pairs' logistic loss, summed one by one, is least; the threshold is a quantile of the scores."""
    rng = np.random.default_rng(8)
    label = (rng.random(80) < 0.6).astype(int)
    rates = rng.random((80, 12)) + 0.3 * label[:, None] * rng.random(12)
    own = quality.Ranking(rates, label, pairs=300, l2=0.01, seed=2)
    x = np.clip((quality.features(rates) - own.mean) / own.spread, -8, 8)
    draw = np.random.default_rng(2)
    good, bad = draw.choice(np.flatnonzero(label == 1), 300), draw.choice(np.flatnonzero(label == 0), 300)

    def loss(w):
        total = 0.0
        for g, b in zip(good, bad):
            total += math.log1p(math.exp(-sum(float(v) for v in (x[g] - x[b]) * w)))
        return total / 300 + 0.005 * float(w @ w)

    least = loss(own.w)
    for _ in range(12):
        assert loss(own.w + 0.02 * rng.normal(size=len(own.w))) > least
    ranked = sorted(float(v @ own.w) for v in x)
    below = sum(v < own.threshold for v in ranked)
    assert abs(below - (label == 0).sum()) <= 1
    assert ((own.scores(rates) >= 0.5) == (x @ own.w >= own.threshold)).all()


@pytest.mark.parametrize("name, column, least", [("op1_language_id", "lang", 0.95), ("op6_quality_ranking", "quality", 0.95)])
def test_held_out(spark, name, column, least):
    sf_dir = "/root/testdata/sf0.1"
    truth = spark.read.parquet(f"{sf_dir}/{'documents' if column == 'lang' else 'labels'}.parquet").select("doc_id", column)
    held = queries.QUERIES[name](spark, sf_dir).where("held_out").join(truth, "doc_id")
    right = F.col("lang_pred") == F.col("lang") if column == "lang" else F.col("predicted") == F.col("quality")
    r = held.agg(F.avg(right.cast("double")).alias("a"), F.min("score").alias("low"), F.max("score").alias("high"), F.count("*").alias("n")).first()
    assert r.n > 300 and r.a > least and r.low >= 0 and r.high <= 1


def test_lm(spark, texts):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    held = {r.doc_id for r in docs.where(fold(F.col("doc_id"), 10) == 0).collect()}
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", _lower(t)), None] for i, t in texts.items()}
    counts = Counter(x for i, t in tokens.items() if i not in held for x in t)
    total, types = sum(counts.values()), len(counts)
    few, many = ({r.doc_id: r for r in lm.score_documents(docs, fold(F.col("doc_id"), 10) == 0, max_broadcast=m, vocabulary=200).collect()} for m in (300, 10**6))
    for r in queries.op4_lm_scores(spark, SMALL).collect():
        own = tokens[r.doc_id]
        base = sum(math.log10((counts[x] + 0.1) / (total + 0.1 * (types + 1))) for x in own)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id in held, len(own), sum(counts[x] > 0 for x in own), total)
        assert r.base_score == pytest.approx(base) and few[r.doc_id].base_score == pytest.approx(base) and few[r.doc_id].n_known == r.n_known
        assert few[r.doc_id].score == pytest.approx(many[r.doc_id].score, rel=1e-6)


@pytest.fixture(scope="module")
def small_model(spark, texts):
    """A model with groups, words beyond the vocabulary and words that are not broadcast."""
    whole, lm.GROUP = lm.GROUP, 20
    docs = spark.createDataFrame(sorted(texts.items())[:40], "doc_id long, text string")
    table = lm.count_tokens(docs)
    counts = lm.Counts(table, 1500, 400)
    model = lm.train(docs, counts, shard_tokens=4000)
    lm.GROUP = whole
    return {bytes(r.token): r.n for r in table.collect()}, counts, model


def _plain_logs(n, counts, model, context, word, known):
    """log p(word | context) by plain loops; context: the words before, latest first, None before the start. known: what this context's other words share."""
    v = {w: i for i, w in enumerate(counts.vocabulary)}
    groups = len(counts.borders) - 1
    place = lambda w: len(v) + lm.BUCKETS if w is None else v.get(w, len(v) + lm.bucket_of(w))
    hidden = sum(model.vector[place(w)].astype(float) * model.weight[j] for j, w in enumerate(context))
    if "classes" not in known:
        known["classes"] = [float(hidden @ t) + float(b) for t, b in zip(model.target, model.bias)]
        known["total"] = math.log(sum(map(math.exp, known["classes"])))
        for w, c in n.items():
            if w not in v:
                known.setdefault(lm.bucket_of(w), []).append(c)
    scores = known["classes"]
    share = lambda values, i: values[i] - (known["total"] if values is scores else math.log(sum(map(math.exp, values))))
    if word not in v:
        b = lm.bucket_of(word)
        own = known.get(b, [])
        return share(scores, counts.head + groups + b) + math.log((n.get(word, 0) + 0.1) / (sum(own) + 0.1 * (len(own) + 1)))
    if v[word] < counts.head:
        return share(scores, v[word])
    g = next(g for g in range(groups) if v[word] < counts.borders[g + 1])
    inside = range(counts.borders[g], counts.borders[g + 1])
    return share(scores, counts.head + g) + share([float(hidden @ model.word[i]) + float(model.word_bias[i]) for i in inside], inside.index(v[word]))


def test_lm_probabilities_sum_to_one(small_model):
    n, counts, model = small_model
    assert len(n) > 1500 > 401 == len(counts.vocabulary) and len(counts.borders) > 10
    unseen = {}
    while len(unseen) < lm.BUCKETS:
        word = b"never-%d" % random.randrange(10**9)
        unseen[lm.bucket_of(word)] = word
    for context in ([None] * 4, [counts.vocabulary[3], counts.vocabulary[300], b"never", None]):
        known = {}
        logs = [_plain_logs(n, counts, model, context, w, known) for w in [*n, *unseen.values()]]
        assert sum(map(math.exp, logs)) == pytest.approx(1, rel=1e-4)


def test_lm_scores_by_plain_loops(spark, small_model):
    n, counts, model = small_model
    words = lm.Words(counts)
    text = b" ".join([*counts.vocabulary[1:6], *counts.vocabulary[200:260:7], b"never-seen", *list(n)[-5:], counts.vocabulary[2]])
    tokens = [*text.split(), lm.END]
    codes = np.array([words[w] for w in tokens])
    sequence, at = lm.sequences(codes, np.array([0, len(codes)]), words.context, model.start)
    got = model.log_probabilities(sequence, at, words.classes[codes], np.where(codes < 401, codes, -1))
    for i, w in enumerate(tokens):
        context = [tokens[i - 1 - j] if i > j else None for j in range(lm.CONTEXT)]
        own = _plain_logs(n, counts, model, context, w, {})
        if w not in counts.vocabulary:
            b = lm.bucket_of(w)
            own -= math.log((n.get(w, 0) + 0.1) / (counts.bucket[b, 0] + 0.1 * (counts.bucket[b, 1] + 1)))
        assert got[i] == pytest.approx(own, abs=1e-4)


def test_lm_step_does_not_list_all_types(small_model):
    """What a step costs depends on its tokens: the types counted, hundreds of thousands, are not gone through."""
    import copy

    _, counts, model = small_model
    rng = np.random.default_rng(0)
    texts, got = [rng.integers(0, 401, 300) for _ in range(3)], []
    for n in (counts.n, None):
        own, mine = copy.copy(counts), lm._copy(model)
        own.n = n
        lm._learn(mine, own, texts, np.random.default_rng(1))
        got.append(mine.flat())
    assert (got[0] == got[1]).all() and (got[0] != model.flat()).any()


def test_lm_update_by_plain_loops(small_model):
    model = lm._copy(small_model[2])
    rng = np.random.default_rng(0)
    rows, values = rng.integers(0, 50, 400), rng.normal(size=(400, lm.WIDTH)).astype(np.float32)
    x, state = model.vector.astype(float), model.state["vector"].astype(float)
    for r in set(rows.tolist()):
        g = values[rows == r].astype(float).sum(0) / 100
        state[r] += g**2
        x[r] -= 0.08 * g / np.sqrt(state[r])
    model._update("vector", rows, values.T, 100, 0.08)
    assert np.allclose(model.vector, x, atol=1e-6) and np.allclose(model.state["vector"], state, rtol=1e-4)


def test_lm_does_not_depend_on_partitions(spark, texts):
    docs = spark.createDataFrame(sorted(texts.items())[:60], "doc_id long, text string")
    scores = []
    for n in (1, 3, 8):
        rows = lm.score_documents(docs.repartition(n), fold(F.col("doc_id"), 10) == 0, shard_tokens=5000).collect()
        scores.append([x for _, x in sorted((r.doc_id, r.score) for r in rows)])
    assert scores[0] == pytest.approx(scores[1], rel=1e-6) and scores[0] == pytest.approx(scores[2], rel=1e-6)


def test_lm_learns(spark):
    sf_dir = "/root/testdata/sf0.01"
    r = queries.op4_lm_scores(spark, sf_dir).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r.s > r.b


def _windows(units, size):
    where = defaultdict(list)
    for i in sorted(units):
        for s in range(len(units[i]) - size + 1):
            where[tuple(units[i][s : s + size])].append((i, s))
    return where


def _gone(units, size, later):
    out = defaultdict(set)
    for places in _windows(units, size).values():
        if len(places) > 1:
            for i, s in places[1 if later else 0 :]:
                out[i] |= set(range(s, s + size))
    return out


#: With tiny limits every frequent key takes the way by digests, and every batch is split.
LIMITS = [repeats.Limits(), repeats.Limits(group_rows=2, block_bytes=100, held_runs=50, held_bytes=500), repeats.Limits(group_windows=9, group_bytes=40, block_bytes=60)]


def _made(seed, alphabet, parts):
    rng = random.Random(seed)
    shared = ["".join(rng.choice(alphabet) for _ in range(60)) for _ in range(4)]
    docs = {}
    for i in range(25):
        pieces = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))]
        for _ in range(parts):
            s = rng.choice(shared)
            a, b = sorted((rng.randint(0, 60), rng.randint(0, 60)))
            pieces += [s[a:b], "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 9)))]
        docs[i] = "".join(pieces)
    docs[25] = docs[3]
    docs[26] = docs[3]
    docs[27] = ""
    docs[28] = "ab ab " * 20
    # rulers and padding, alone and within other text
    docs[29], docs[30], docs[31] = "-" * 90, "x " + "-" * 70 + " y", "a b " + "- " * 40 + docs[3]
    docs[32], docs[33] = "-" * 25 + "=" * 60 + "ab" * 40, "a b c " * 12 + "| " * 30 + "a b c " * 9
    docs[34] = "q" + "ab" * 35 + "-" * 13 + "a b c " * 9
    return docs


@pytest.mark.parametrize("limits", LIMITS, ids=["groups", "digests", "windows"])
@pytest.mark.parametrize("keep", ["none", "first"])
def test_suffix_dedup(spark, keep, limits):
    docs = _made(5, "ab é", 4)
    got = _kernel_rows(spark, docs, lambda d: suffix_dedup.measure_repeats(d, window=12, keep=keep, limits=limits))
    units = {i: t.encode() for i, t in docs.items()}
    gone = _gone(units, 12, keep == "first")
    for i, raw in units.items():
        kept = bytes(b for p, b in enumerate(raw) if p not in gone[i])
        spans = sum(p - 1 not in gone[i] for p in gone[i])
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(raw), len(gone[i]), spans, hashlib.sha256(kept).hexdigest()), i


@pytest.mark.parametrize("limits", LIMITS, ids=["groups", "digests", "windows"])
def test_substring_dedup(spark, limits):
    docs = _made(6, "ab  ", 5)
    got = _kernel_rows(spark, docs, lambda d: substring_dedup.measure_repeats(d, window=6, keep_text=True, limits=limits))
    units = {i: t.split() for i, t in docs.items()}
    gone = _gone(units, 6, True)
    for i, words in units.items():
        kept = " ".join(w for p, w in enumerate(words) if p not in gone[i])
        assert (got[i].n_words, got[i].n_removed, got[i].kept_text) == (len(words), len(gone[i]), kept), i


def _text_exchanges(run):
    """Shuffles of whole texts in the plan as it ran, those that read another one again left out; joins as large tables have them."""
    from pyspark.sql import SparkSession

    spark, setting = SparkSession.getActiveSession(), "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(setting, "-1")
    try:
        df = run(spark, SMALL)
        df.collect()
        plan = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.conf.unset(setting)
    ran = re.findall(r"[ -] Exchange \((\d+)\)", plan.split("== Initial Plan ==")[0])
    return sum(bool(re.search(rf"^\({i}\) Exchange *\nInput \[\d+\]: \[.*\btext#", plan, re.M)) for i in ran)


def test_suffix_dedup_deals_texts_once(spark):
    assert _text_exchanges(queries.op5_suffix_dedup) == 1


def test_substring_dedup_deals_texts_once(spark):
    assert _text_exchanges(queries.op7_substring_dedup) == 1


def _by_hash(spark, n):
    """n ids in the order of their hash."""
    return [r.id for r in spark.range(n).orderBy(F.xxhash64("id"), "id").collect()]


def test_ranking_learns_from_all_labels(spark):
    """The one bad row tells, wherever it stands among 13 000."""
    ids = _by_hash(spark, 13_000)
    docs = spark.createDataFrame([(i, "### $$$ ###" if i == ids[-1] else f"some usual words and {i % 7}") for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i != ids[-1])) for i in ids], "doc_id long, quality int")
    got = {r.doc_id: r.predicted for r in quality.score_documents(docs, labels).collect()}
    assert got == {i: int(i != ids[-1]) for i in ids}


def test_ranking_in_blocks(spark):
    """Every row is in the means, in each round of pairs and in the threshold; results do not depend on partitions."""
    rng = np.random.default_rng(3)
    rates = rng.random((700, len(textstats.RATES)))
    label = (rng.random(700) < 0.1 + 0.8 * rates[:, 0]).astype(int)
    rows = spark.createDataFrame([(int(y), x.tolist(), i) for i, (x, y) in enumerate(zip(rates, label))], "label int, rates array<double>, h long")
    table, blocks = quality.in_blocks(rows, int(label.sum()), int((1 - label).sum()), 20, 8)
    assert blocks == 35
    found = list(quality._unpacked(pa.Table.from_pandas(table.toPandas(), preserve_index=False).to_batches()))
    assert all(len(good) and len(bad) for _, good, bad, _ in found)
    assert sorted(x for *_, first in found for x in first[:, 0].tolist()) == sorted(rates[:, 0].tolist())
    own, other = (quality.learn(rows.repartition(k), pairs=2000, block=20, rarer=8) for k in (1, 5))
    assert (own.w == other.w).all() and own.threshold == other.threshold
    x = quality.features(rates)
    assert np.allclose(own.mean, x.mean(0)) and np.allclose(own.spread, x.std(0) + 1e-6)
    assert own.threshold == pytest.approx(np.quantile(own.scaled(rates) @ own.w, (label == 0).mean()))
    assert ((own.scores(rates) >= 0.5) == label).mean() > 0.7


@pytest.mark.parametrize("share", [0.0, 0.013, 0.5, 1.0])
def test_quantile(spark, share):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, 500), np.full(300, 0.25), [1e9, -1e-300, 1e-300]])
    assert quality.quantile(spark.createDataFrame([(float(v),) for v in x], "x double"), share) == pytest.approx(np.quantile(x, share), abs=1e-15)


def test_rules_learn_from_all_labels(spark):
    """Good rows are found, wherever they stand among 12 040."""
    ids = _by_hash(spark, 12_040)
    good = set(ids[12_000:])
    docs = spark.createDataFrame([(i, " ".join(f"word{(i + k) % 997}" for k in range(60)) + ("" if i in good else " ##" * 30)) for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i in good)) for i in ids], "doc_id long, quality int")
    rows = rules.judge(docs, labels).collect()
    assert not any(r.base_failed for r in rows) and {r.doc_id for r in rows if r.kept} == good


def test_trees_draw_from_all_rows(spark):
    rng = np.random.default_rng(2)
    h, x = rng.integers(-(2**63), 2**63 - 1, 5000), rng.random((5000, 2))
    rows = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(h, x)], "h long, points array<double>")
    own, other = (rules.draw(rows.repartition(k), 5000, 2, 30, 64) for k in (1, 6))
    for c in range(2):
        assert all(len(v) == 64 and np.isin(v, x[:, c]).all() for v in own[c])
        assert all((v == w).all() for v, w in zip(own[c], other[c]))
        assert len(set(np.concatenate(own[c]).tolist())) > 1200  # 1920 draws out of 5000
    few = rules.draw(rows.limit(9), 9, 2, 3, 64)
    assert [len(v) for c in few for v in c] == [9] * 6


def test_calibration_of_counts():
    rng = np.random.default_rng(4)
    for most in (0.0, 0.01, 0.2):
        scores, good, times = rng.permutation(60) / 60, rng.random(60) < 0.8, rng.integers(1, 9, 60)
        want = rules.calibrate(np.repeat(scores, times), np.repeat(good, times), most, 2.0)
        assert rules.calibrate(scores, good, most, 2.0, times) == want


@pytest.mark.parametrize("later", [False, True])
def test_long_runs_are_split(later):
    """Windows of a run are listed once, whatever it is split into; those that go round are settled."""
    text = np.frombuffer(b"-" * 10_000 + b"abc" + b"ab" * 300, np.uint8)
    key, doc, a, n, off, within, settled = suffix_dedup.Bytes(200).runs(text, np.array([0, len(text)]), later)
    assert n.max() >= 9000 and n[~settled].max() < 500
    listed = np.zeros(len(text) - 199, int)
    for first, many, known in zip(a, n, settled):
        if not known:
            listed[first : first + many] += 1
    assert listed.max() == 1
    seen, need = set(), {bytes(text[i : i + 200]) for i in range(len(text) - 199)}
    for i in np.flatnonzero(listed):
        seen.add(bytes(text[i : i + 200]))
    assert seen == need
    parts = repeats.split_long((np.array([7, 8]), np.array([0, 1]), np.array([5, 0]), np.array([9, 2]), np.array([0, 1]), np.array([True, False])), 4)
    assert [x.tolist() for x in parts[:4]] == [[7, 7, 7, 8], [0, 0, 0, 1], [5, 9, 13, 0], [4, 4, 1, 2]]


def _kernel_rows(spark, docs, run):
    return {r.doc_id: r for r in run(spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)).collect()}


def test_digests_of_windows():
    units = substring_dedup.Words(5)
    d, e = units.digests(b"a b c d e f a b c d e", 7)
    assert len(d) == len(e) == 7 and d[0] == d[6] and e[0] == e[6] and len(set(d.tolist())) == 6


def test_hot_key_is_handed_on():
    units = suffix_dedup.Bytes(8)
    piece = b"abcdefgh"
    rows = [{"h": 1, "s": 0, "id": i, "tag": 0, "a": 0, "m": int(repeats.packed(1, 0, 0)), "piece": piece} for i in range(7)]
    rows += [{"h": 2, "s": 0, "id": i, "tag": 0, "a": 0, "m": int(repeats.packed(1, 0, 0)), "piece": b"zzzzzzzz"} for i in range(2)]
    kind = pa.schema([("h", pa.int64()), ("s", pa.int32()), ("id", pa.int64()), ("tag", pa.int32()), ("a", pa.int32()), ("m", pa.int64()), ("piece", pa.binary())])
    batches = pa.Table.from_pylist(rows, kind).to_batches(max_chunksize=3)
    out = pa.Table.from_batches(list(repeats._compare(units, False, repeats.Limits(group_rows=3))(iter(batches)))).to_pylist()
    handed = [r for r in out if r["piece"] is not None]
    assert sorted(r["id"] for r in handed) == list(range(7)) and sorted(r["id"] for r in out if r["piece"] is None) == [0, 1]
    digests = pa.Table.from_batches(list(repeats._digested(units)(iter(pa.Table.from_pylist(handed, pa.schema([("id", pa.int64()), ("tag", pa.int32()), ("a", pa.int32()), ("n", pa.int32()), ("off", pa.int32()), ("piece", pa.binary())])).to_batches()))))
    again = pa.Table.from_batches(list(repeats._neighbours(["d", "e"], True, ["id", "a"])(iter(digests.to_batches(max_chunksize=2)))))
    assert sorted(again.column("id").to_pylist()) == list(range(7))


def test_rows_that_repeat(spark):
    long = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, long), (1, long), (2, "x " + long)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed) for r in substring_dedup.measure_repeats(docs).collect())
    assert got == [(1, 0), (1, 0), (2, 60)]
    assert {r.n_removed for r in suffix_dedup.measure_repeats(docs).collect()} == {len(long)}


def test_previous_factors():
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice("ab") for _ in range(rng.randint(0, 25)))
        order = sorted(range(len(text)), key=lambda i: text[i:])
        common = lambda a, b: len(os.path.commonprefix([text[a:], text[b:]]))
        lcp = np.array([0, *[common(a, b) for a, b in zip(order, order[1:])]][: len(order)], np.int64)
        got = suffix_dedup.longest_previous(np.array(order, np.int64), lcp).tolist()
        assert got == [max((common(i, j) for j in range(i)), default=0) for i in order]


def test_characters_stay_whole(spark):
    shared = "".join(map(chr, range(0x100, 0x128)))
    docs = spark.createDataFrame([(1, "a" + shared + "b", 42), (2, "xy" + shared + "z", 43)], "doc_id long, text string, n_chars long")
    out = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs, 21, "first", length_col="n_chars").collect()}
    assert out[1].text == "a" + shared + "b" and out[2].text == "xyz" and out[2].n_chars == 3


def test_pipeline(spark, texts):
    """Each stage on what the one before kept, against brute force."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stored(stages["quality_rules"](spark, docs, SMALL))
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rules.judge(docs, labels).where("kept").collect()}

    first = stored(stages["near_duplicates"](spark, kept, SMALL))
    assert sorted(r.doc_id for r in first.collect()) == firsts({r.doc_id: r.text for r in kept.collect()})

    clean = stored(stages["repeated_passages"](spark, first, SMALL))
    own = {r.doc_id: r.text for r in first.collect()}
    gone = _gone({i: t.encode() for i, t in own.items()}, 200, True)
    for r in clean.collect():
        raw = own[r.doc_id].encode()
        cut = gone[r.doc_id]
        whole = [c for c, at in _characters(raw) if not set(at) <= cut]
        assert r.text == "".join(whole) and r.n_chars == len(r.text)

    free = stored(stages["benchmark_decontamination"](spark, clean, SMALL))
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    left = {r.doc_id: r for r in decontam.report(decontam.find_hits(clean, bench)).collect()}
    assert {r.doc_id for r in free.collect()} == {i for i, r in left.items() if not r.contaminated}
    untouched = {r.doc_id: r.text for r in clean.collect() if not left[r.doc_id].n_hit}
    assert {r.doc_id: r.text for r in free.collect() if r.doc_id in untouched} == untouched

    last = stages["byte_bpe"](spark, free, SMALL).collect()
    codec = bpe.default_codec()
    assert {r.doc_id: r.token_ids for r in last} == {r.doc_id: np.array(codec.encode(r.text), "<u4").tobytes() for r in free.collect()}
    ran = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id: r.ids_sha256 for r in ran} == {r.doc_id: r.ids_sha256 for r in last}


def _characters(raw):
    at = 0
    for c in raw.decode():
        n = len(c.encode())
        yield c, range(at, at + n)
        at += n
