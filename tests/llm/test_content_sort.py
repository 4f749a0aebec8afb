"""The content sort: splitters, and groups of copies that span partitions."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strandlake.llm.exact_dedup import choose_splitters, exact_dedup, place

TEXTS = ["", " ", "a", "a b", "a  b", "a\tb", "a\x85b", "aé", "a\U0001f600", "b" * 400, "b" * 399 + "c", "hot text " * 20]


def rows(n=900, seed=5):
    rng = random.Random(seed)
    ids = [*range(n - 40), *[None] * 20, *[7] * 20]
    rng.shuffle(ids)
    return [(i, TEXTS[-1] if rng.random() < 0.4 else rng.choice([*TEXTS, None, f"text {rng.randrange(200)}"])) for i in ids]


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_splitters_part_texts_and_hot_groups():
    sample = [("apple", 1), ("apply", 2), ("hot", 3), ("hot", 4), ("hot", 5), ("hot", None), ("zoo", 6)]
    cuts = choose_splitters(sample, 7)
    assert {"s": "apply", "d": None} in cuts and {"s": "h", "d": None} in cuts and {"s": "hot", "d": 4} in cuts
    assert choose_splitters([], 9) == [] and choose_splitters(sample, 1) == []


def test_binary_search_agrees_with_counting(spark):
    table = [(normal(t), i) for i, t in rows()]
    cuts = choose_splitters(table, 60)
    assert len(cuts) > 30

    def behind(text, doc, cut):
        return text > cut["s"] or (text == cut["s"] and (cut["d"] is None or doc is None or doc >= cut["d"]))

    got = spark.createDataFrame(table, "t string, i long").select("t", "i", place(F.col("t"), F.col("i"), cuts, "bigint").alias("p")).collect()
    assert all(r.p == sum(behind(r.t, r.i, c) for c in cuts) for r in got)


@pytest.mark.parametrize("partition_bytes", [300, 5000, 1 << 20])
def test_groups_that_span_partitions(spark, partition_bytes):
    table = rows()
    groups = defaultdict(list)
    for i, t in table:
        groups[normal(t)].append(i)
    keep = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(5)
    got = exact_dedup(docs, partition_bytes=partition_bytes).collect()
    want = sorted((str(i), str(keep[normal(t)]), len(groups[normal(t)]), hashlib.sha256(normal(t).encode()).hexdigest()) for i, t in table)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) == len({r.text_sha256 for r in kept}) and all(r.doc_id == r.keep_id for r in kept)


def test_clashing_columns_are_carried(spark):
    names = ["doc_id", "text", "norm", "part", "run", "head", "edge", "sha", "row", "least", "n", "before", "last", "Kept"]
    docs = spark.createDataFrame([(k, t, *range(12)) for k, t in enumerate(["x", "x", "y", None])], names)
    out = exact_dedup(docs, carry=True)
    assert set(out.columns) == {"doc_id", "keep_id", "group_size", "kept", "text_sha256", "text", *names[2:-1]}
    assert {(r.doc_id, r.text, r.kept, r.norm, r.part, r.sha) for r in out.collect()} == {(0, "x", True, 0, 1, 5), (1, "x", False, 0, 1, 5), (2, "y", True, 0, 1, 5), (3, None, True, 0, 1, 5)}


def test_one_shuffle_of_the_texts(spark, tmp_path):
    spark.createDataFrame([(k, f"t{k % 3}") for k in range(50)], "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    seen = []
    import strandlake.llm.exact_dedup as module

    real = module.stage

    def watch(df, label):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, label)

    module.stage = watch
    try:
        exact_dedup(spark.read.parquet(f"{tmp_path}/d")).count()
    finally:
        module.stage = real
    assert len(seen) == 1 and seen[0].count("Exchange") == 1
