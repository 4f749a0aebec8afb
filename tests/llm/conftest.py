import pytest

ODD = [
    (1, "a b c d e f g", "s1"),
    (2, "a  b\tc d e f\ng", "s1"),
    (3, None, "s2"),
    (4, "", None),
    (5, " \t ", "s2"),
    (5, " \t ", "s2"),
    (None, "no id at all", "s3"),
    (6, "word", "s1"),
    (7, "ünïcödé ñ " * 40, None),
    (8, "long " * 60_000, "s9"),
    (9, "A B C D E F G", "s1"),
    (10, "x" * 3000, "s2"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and further columns with names that operators use."""
    rows = [(i, t, s, "en", 0, "x", True) for i, t, s in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, size int, shard string, kept boolean").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, None, None), (6, 0, 1), (None, 1, 1), (6, 1, 1), (9, 0, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
