import pytest

LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))

#: Nulls, empty and very long texts, ties, repeated rows; extra columns whose names operators use themselves.
AWKWARD = [
    (1, None, None, "s", 0),
    (2, "", "en", None, 0),
    (3, LONG, "en", "s", len(LONG)),
    (4, "The same text twice over, the same text.", "en", "s", 1),
    (4, "The same text twice over, the same text.", "en", "s", 1),
    (None, "a row without an id, für Ümläute und 日本語 words", None, None, None),
    (None, None, None, None, None),
    (7, "The same text twice over, the same text.", "de", "s", 1),
    (8, " \t\n ", "de", "s", 3),
]
EXTRA = "score double, fp long, id long, tag int, found string, n_words long, kept boolean, h long, root long, row long, __label int, "
EXTRA += "__id long, __th long, __tag int, __found string, __copy boolean, __n_words long, __hit_words string, __item_ids string, own long, copy boolean, name long, a.b string"


@pytest.fixture(scope="session")
def awkward(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(AWKWARD, "doc_id long, text string, lang string, source string, n_chars long")
    for part in EXTRA.split(", "):
        name, kind = part.split()
        df = df.withColumn(name, F.lit(None).cast(kind))
    return df


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.where("1 = 0")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(3, 1, 0), (4, 0, 0), (None, 1, 0), (7, None, 1), (2, 1, 1), (2, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.createDataFrame([(1, "same text twice"), (2, None), (None, "row without"), (3, ""), (4, " ".join(f"word{i % 977}x{i}" for i in range(100, 120))), (4, "für")], "item_id long, text string")
