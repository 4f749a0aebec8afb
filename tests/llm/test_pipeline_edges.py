"""The pipeline's stages on rows without doc_id, repeated doc_ids, empty texts and clashing columns."""

from collections import Counter

import pytest

import corpus_pipeline as P

WORDS = [f"w{k}" for k in range(400)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("edges")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def docs(spark):
    a, b, c = " ".join(WORDS[:60]), " ".join(WORDS[1:61]), " ".join(WORDS[100:160])
    rows = [
        (5, a, "s"), (5, b, "s"), (7, c, "s"), (7, "", None), (None, a + " more", "t"), (None, c + " more", None), (None, None, "t"),
        (9, " ".join(WORDS[200:260]), "t"), (9, " ".join(WORDS[200:260]), "t"), (10, " \t", "s"), (11, "you idiot " * 3, "s"),
    ]
    names = "doc_id long, text string, source string, kept int, part string, norm int, copy int, score int, component int"
    return spark.createDataFrame([(*r, 1, "x", 2, 3, 4, 6) for r in rows], names)


def rows(df):
    return Counter((r.doc_id, r.text, r.source) for r in df.collect())


def test_toxic_documents_go(spark, docs, folder):
    out = P.drop_toxic(spark, docs, folder)
    assert out.columns == docs.columns and rows(docs) - rows(out) == Counter({(11, "you idiot " * 3, "s"): 1})


def test_one_row_of_equal_texts_stays(spark, docs, folder):
    out = P.drop_copies(spark, docs, folder)
    gone = rows(docs) - rows(out)
    assert out.columns == docs.columns and gone == Counter({(9, " ".join(WORDS[200:260]), "t"): 1, (None, None, "t"): 1})
    assert {(r.kept, r.part, r.norm, r.score) for r in out.collect()} == {(1, "x", 2, 4)}


def test_one_text_of_linked_ones_stays(spark, docs, folder):
    out = P.drop_near_copies(spark, P.drop_copies(spark, docs, folder), folder)
    left = rows(out)
    assert out.columns == docs.columns
    assert sum(n for (i, t, _), n in left.items() if i == 5) == 1  # both texts of doc_id 5 are linked
    assert not any(i is None and t for (i, t, _) in left)  # the rows without doc_id are linked with 5 and 7
    assert left[7, " ".join(WORDS[100:160]), "s"] == 1 and left[9, " ".join(WORDS[200:260]), "t"] == 1 and left[10, " \t", "s"] == 1


def test_mixed_and_packed(spark, docs, folder):
    out = P.mix(spark, docs, folder)
    assert out.columns == docs.columns and set(rows(out)) <= set(rows(docs)) and not any(not (t or "").split() for _, t, _ in rows(out))
    pieces = P.pack(spark, docs, folder).collect()
    assert Counter(r.doc_id for r in pieces) == Counter(r.doc_id for r in docs.collect())


def test_empty_tables(spark, docs, folder):
    for name, stage in P.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0, name
