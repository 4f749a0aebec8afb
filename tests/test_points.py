import pytest

from strandlake.operators import dashboard as H
from strandlake.plans import queries


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(f"v{i:03}", float(-i), 1.0, 1, 300 - i) for i in range(300)], "aa string, score double, q double, c0 long, c2 long")


def test_small_points_stride(rows):
    assert sorted(r["rank"] for r in H.volcano(rows, "score", "q", "aa", points=120).collect()) == [*range(1, 21), *range(21, 301, 3)]
    assert sorted(r["rank"] for r in H.scatter(rows, "c0", "c2", "aa", points=90).collect()) == [*range(1, 21), *range(21, 301, 4)]


def test_registered_plots_use_the_operators_defaults(rows, monkeypatch):
    matrix = rows.selectExpr("aa", "score as raw2", "q as q2", "c0", "c2")
    monkeypatch.setattr(queries, "_analysed", lambda spark, sf_dir: matrix)
    assert queries.volcano_points(None, "").count() == queries.scatter_points(None, "").count() == 300
