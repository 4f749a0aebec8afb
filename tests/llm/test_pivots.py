"""The Jaccard join's rounds of pivots and documents without doc_id, against brute force."""

import random

import pytest

from strandlake.llm.near_dup import jaccard_components

from .test_regions import brute, drifting


def test_a_document_without_id_carries_links(spark):
    words = [f"w{k}" for k in range(60)]
    one, bridge, two = words[:50], words[4:54], words[8:58]  # one and two share 42 of 58
    alone = [f"v{k}" for k in range(30)]
    rows = [(1, " ".join(one)), (None, " ".join(bridge)), (2, " ".join(two)), (None, " ".join(alone)), (None, " ".join(alone[1:])), (3, "")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), width=1).collect()), key=str)
    assert got == sorted([(1, 50, 1), (None, 50, 1), (2, 50, 1), (None, 30, None), (None, 29, None), (3, 0, 3)], key=str)


def test_one_id_with_several_texts(spark):
    a, b = [f"a{k}" for k in range(40)], [f"b{k}" for k in range(40)]
    rows = [(1, " ".join(a)), (5, " ".join(a[:-2])), (5, " ".join(b)), (9, " ".join(b[2:])), (9, " ".join(b[2:]))]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), width=1).collect())
    assert got == [(1, 40, 1), (5, 38, 1), (5, 40, 5), (9, 38, 5), (9, 38, 5)]


@pytest.mark.parametrize(("seed", "pivots", "large"), [(2, 2, 3), (3, 4, 6)])
def test_rounds_of_pivots_lose_no_link(spark, seed, pivots, large):
    rng = random.Random(seed)
    sets = [{f"{k}x{w}" for w in s} for k in range(4) for s in drifting(rng, 120)]
    # A family whose members are all within the radius of each other, and a chain of neighbours.
    sets += [{f"f{w}" for w in range(60)} - {f"f{rng.randrange(60)}" for _ in range(3)} for _ in range(25)]
    sets += [{f"c{w}" for w in range(k, k + 40)} for k in range(0, 90, 3)]
    sets = [frozenset(s) for s in sets]
    rows = [(k, " ".join(sorted(s))) for k, s in enumerate(sets)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in jaccard_components(docs, width=1, large_group=large, pivots=pivots, large_shingles=500, part_entries=200, most_partitions=3).collect()}
    assert got == dict(enumerate(brute(sets)))
