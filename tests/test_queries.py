"""Every registered query with SQL gives its rows; the others run. The training-data part may be missing."""

import math
import os

import duckdb
import pytest

import __spark_entry__

SMALL = "/root/testdata/sf0.001"
FOUND, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def tables():
    found = duckdb.connect()
    for name in sorted(os.listdir(SMALL)):
        found.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{name}'")
    return found


def _rows(columns, rows):
    at = [columns.index(c) for c in sorted(columns)]
    plain = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", [n for n in FOUND if n in SQL])
def test_against_sql(spark, tables, name):
    ours = FOUND[name](spark, SMALL)
    theirs = tables.execute(SQL[name])
    columns = [d[0] for d in theirs.description]
    assert sorted(columns) == sorted(ours.columns)
    assert _rows(ours.columns, ours.collect()) == _rows(columns, theirs.fetchall())


@pytest.mark.parametrize("name", ["consensus_poa", "polish_contigs", "correct_fragments"])
def test_runs(spark, name):
    assert FOUND[name](spark, SMALL).count() > 0


def test_polished_is_nearer(spark):
    from pyspark.sql import functions as F

    from tessera.plans import fixtures

    truth = fixtures.drafts(spark, SMALL).select("ordinal", "truth", F.col("data").alias("draft"))
    r = FOUND["polish_contigs"](spark, SMALL).join(truth, "ordinal").agg(F.sum(F.levenshtein("data", "truth")).alias("after"), F.sum(F.levenshtein("draft", "truth")).alias("before")).first()
    assert r.after < r.before / 4


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_fixture_figures(spark):
    """The figures of the breaking points that the fixtures are documented with."""
    from pyspark.sql import functions as F

    r = FOUND["breaking_points"](spark, "/root/testdata/sf0.01").agg(F.count("*"), F.sum("t_first"), F.sum("t_last")).first()
    assert tuple(r) == (112_772, 107_301_488, 133_589_296)
