"""Every operator and stage on nulls, empty, long and repeated rows, empty tables and clashing column names."""

import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import bpe, decontam, langid, lm, quality, rules, simhash, substring_dedup, suffix_dedup, wordpiece
from tessera.llm.common import drop_stored, fold, fresh, stored
from tessera.session import shared_dir
from tests.llm.conftest import AWKWARD

EMPTY = hashlib.sha256(b"").hexdigest()


@pytest.fixture(scope="module")
def codec():
    return bpe.default_codec()


def _operators(labels, benchmark, codec):
    return {
        "langid": lambda d: langid.identify(d, langid.fit(d)),
        "wordpiece": lambda d: wordpiece.count_tokens(d, list(codec.ranks), codec.pattern),
        "decontam": lambda d: decontam.report(decontam.find_hits(d, benchmark)),
        "lm": lambda d: lm.score_documents(d, fold(F.col("doc_id"), 10) == 0),
        "suffix": lambda d: suffix_dedup.measure_repeats(d),
        "quality": lambda d: quality.score_documents(d, labels),
        "substring": lambda d: substring_dedup.measure_repeats(d, keep_text=True),
        "rules": lambda d: rules.judge(d, labels),
        "simhash": lambda d: simhash.components(d),
        "bpe": lambda d: bpe.encode_documents(d, codec),
    }


NAMES = ["langid", "wordpiece", "decontam", "lm", "suffix", "quality", "substring", "rules", "simhash", "bpe"]


@pytest.mark.parametrize("name", NAMES)
def test_awkward_rows(name, awkward, nothing, labels, benchmark, codec):
    run = _operators(labels, benchmark, codec)[name]
    rows = run(awkward).collect()
    key = lambda x: (x is not None, x or 0)
    assert sorted((r.doc_id for r in rows), key=key) == sorted((r[0] for r in AWKWARD), key=key)
    same = [r for r in rows if r.doc_id == 4]
    assert len(same) == 2 and same[0] == same[1]
    assert run(nothing).collect() == []
    of = {r.doc_id: r for r in rows if r.doc_id in (1, 2, 3, 8)}
    if name == "langid":
        assert of[1].lang_pred == of[2].lang_pred == of[8].lang_pred == "und" and of[3].lang_pred in ("en", "de")
        assert all(0 <= r.score <= 1 for r in rows)
    if name == "decontam":
        assert of[1].n_words == of[2].n_words == 0 and of[2].items_sha256 == EMPTY and of[3].n_hit == 20 and of[3].n_items == 1 and not of[3].contaminated
        assert same[0].n_hit == 3 and same[0].n_items == 1
    if name == "lm":
        assert of[1].n_tokens == of[2].n_tokens == of[8].n_tokens == 1 and of[3].n_tokens == 30_001
    if name == "suffix":
        assert of[1].n_bytes == 0 and of[1].kept_sha256 == EMPTY and of[3].n_removed == 0 and same[0].n_removed == 0
    if name == "substring":
        assert of[1].kept_sha256 == EMPTY and of[3].n_words == 30_000 and of[3].n_removed == 0 and of[8].kept_text == ""
    if name == "rules":
        assert of[1].base_failed and not of[1].kept and of[2].n_words == 0 and of[3].n_words == 30_000
    if name == "simhash":
        assert of[1].fingerprint == of[8].fingerprint == "0" * 16 and of[2].component_id is None and same[0].component_id == 4
        assert {r.component_id for r in rows if r.doc_id == 7} == {4}
    if name == "bpe":
        assert of[1].n_tokens == 0 and of[1].ids_sha256 == of[1].decoded_sha256 == EMPTY


def test_stages(spark, awkward, nothing, labels, benchmark, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (awkward, nothing):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            if k < 4:
                assert out.columns == docs.columns
                assert [x.dataType for x in out.schema] == [x.dataType for x in docs.schema]
            rows = out.collect()
            assert docs is awkward or not rows
            if docs is awkward and k == 1:  # zero fingerprints link, whole copies link; one row of each stays
                assert sorted((r.doc_id is not None, r.doc_id or 0) for r in rows) == [(False, 0), (False, 0), (True, 3), (True, 4)]
            if docs is awkward and k == 2:
                assert len(rows) == len(AWKWARD) and {r.n_chars for r in rows if r.doc_id == 1} == {None}


def test_labels_of_one_class(spark, awkward):
    one = spark.createDataFrame([(3, 1)], "doc_id long, quality int")
    assert {r.score for r in quality.score_documents(awkward, one).collect()} == {1.0}
    assert {r.score for r in quality.score_documents(awkward, one.where("1 = 0")).collect()} == {0.5}
    assert [r.kept for r in rules.judge(awkward, one.where("1 = 0")).collect() if r.doc_id == 3] == [True]


def test_blocks_of_a_large_benchmark(awkward, benchmark):
    whole = sorted(map(str, decontam.find_hits(awkward, benchmark).collect()))
    assert sorted(map(str, decontam.find_hits(awkward, benchmark, max_block_bytes=40).collect())) == whole


def test_cut_passages(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"Vor – {passage.upper()}! After ü", "x")], "doc_id long, text string, score string")
    assert decontam.decontaminate(docs, bench).collect()[0].text == "Vor – ! After ü"
    assert decontam.decontaminate(docs, bench, min_items=1).collect() == []


def test_long_words_are_not_remembered(codec):
    """Words of 100 kB are counted and encoded, and no worker keeps them."""
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdefgh") for _ in range(100_000)) for _ in range(3)]
    automaton = wordpiece.Automaton(codec.ranks)
    for text in texts:
        assert automaton.counts([text, "the", text]) == 2 * automaton.count(text.encode()) + automaton.count(b"the")
    assert list(automaton.known) == ["the"]
    assert [codec.decode(np.frombuffer(x, "<u4").tolist()) for x in codec.encode_batch(texts)] == [t.encode() for t in texts]
    assert max(map(len, codec.known), default=0) <= bpe.MAX_REMEMBERED


def test_a_block_is_compact():
    """A benchmark of 8 MB: the arrays that go to every worker are some 30 bytes a window."""
    rng = np.random.default_rng(0)
    stock = [f"w{i}" for i in range(20_000)]
    items = [(str(k), " ".join(stock[i] for i in rng.integers(0, 20_000, 300))) for k in range(4600)]
    block = decontam.Windows(items, 8)
    size = len(block.text) + sum(x.nbytes for arrays in block.lengths.values() for x in arrays)
    assert sum(len(t) for _, t in items) > 7 << 20 and len(block.lengths[8][1]) > 1_300_000 and size < 70e6


def test_shared_folder_is_asked_for():
    """Off local mode there is no folder to fall back to."""

    class Elsewhere:
        class sparkContext:
            master, applicationId = "spark://host:7077", "a"
            getCheckpointDir = staticmethod(lambda: None)

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Elsewhere)


def test_stored_tables_go(spark):
    df = stored(spark.range(3).toDF("id"))
    path = df._tessera_path.removeprefix("file://")
    assert os.path.isdir(path) and df.count() == 3
    drop_stored(df)
    assert not os.path.exists(path)


def test_fresh_names():
    assert fresh(["a", "__ID", "___id"], "__id", "a", "__id") == ["____id", "_a", "_____id"]
