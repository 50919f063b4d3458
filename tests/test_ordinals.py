"""Ordinals cost one shuffle, and overlaps are sorted with no more columns than asked for."""

from pyspark.sql import functions as F

from tessera.operators.ordinals import with_ordinal
from tessera.plans import fixtures


def test_numbered_without_a_second_shuffle(spark):
    out = with_ordinal(spark.range(100).select((F.col("id") * 37 % 100).alias("k")), ["k"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning" not in plan
    assert all(r.ordinal == r.k for r in out.collect()) and out.columns == ["k", "ordinal"]


def test_only_what_is_asked_for(spark):
    slim = fixtures.ordered_overlaps(spark, "/root/testdata/sf0.001", "q_id", "length")
    assert slim.columns == ["ordinal", "q_id", "length"]
    sorted_ = slim._jdf.queryExecution().optimizedPlan().toString()
    assert "t_begin" not in sorted_ and "cigar" not in sorted_
    whole = fixtures.ordered_overlaps(spark, "/root/testdata/sf0.001").select("ordinal", "q_id", "length")
    assert sorted(map(tuple, slim.collect())) == sorted(map(tuple, whole.collect()))
