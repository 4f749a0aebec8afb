"""Suffix dedup against brute force: rows without doc_id, repeated doc_ids, and the suffix array itself."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from strandlake.llm.suffix_dedup import LENGTH, remove_repeats, suffix_array

WORDS = [f"w{k}" for k in range(3000)]


def some(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def brute(rows, order):
    """Rows (doc_id, text) in the order of the corpus -> Counter of (doc_id, n_bytes, n_removed, n_spans, sha)."""
    seen, out = {}, Counter()
    for place, (doc, text) in enumerate(sorted(rows, key=order)):
        data = (text or "").encode()
        same = (doc, data)
        gone = bytearray(len(data))
        for j in range(len(data) - LENGTH + 1):
            piece = data[j : j + LENGTH]
            if piece in seen and not (seen[piece][0] == same and seen[piece][1] == j):
                gone[j : j + LENGTH] = b"\1" * LENGTH
            seen.setdefault(piece, (same, j))
        kept = bytes(x for x, g in zip(data, gone, strict=True) if not g)
        out[doc, len(data), sum(gone), len([s for s in bytes(gone).split(b"\0") if s]), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.fixture(scope="module")
def row_of(spark):
    """The hash that orders rows that share a doc_id, as Spark computes it."""
    from pyspark.sql import functions as F

    def hashed(texts):
        rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.xxhash64("t").alias("h")).collect()
        return {r.t: r.h for r in rows}

    return hashed


def test_rows_without_id_and_with_one_id(spark, row_of):
    rng = random.Random(3)
    shared = [some(rng, 60) for _ in range(4)]
    rows = [(k, some(rng, 10) + shared[k % 4] + some(rng, 10)) for k in range(8)]
    rows += [(None, some(rng, 20) + shared[0]), (None, some(rng, 90)), (None, shared[1] + some(rng, 50) + shared[1]), (None, None)]
    rows += [(7, some(rng, 80)), (7, some(rng, 30) + shared[3]), (7, shared[2]), (2**63 - 1, some(rng, 40) + shared[0])]
    rows += [(100, some(rng, 70))] * 3 + [(None, some(rng, 75))] * 2 + [(101, "x" * 5000), (102, "")]
    h = row_of([t for _, t in rows])

    def order(r):
        doc, text = r
        return doc is None, h[text] if doc is None else doc, h[text] & (2**31 - 1)

    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = remove_repeats(docs).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute(rows, order)


def test_suffix_array_orders_bytes():
    rng = random.Random(5)
    raw = np.frombuffer(bytes(rng.choice(b"ab") for _ in range(300)) * 3 + bytes(range(256)) + b"\xff" * 250, np.uint8)
    begin = np.arange(len(raw) - LENGTH + 1)
    group = np.array([rng.randrange(2) for _ in begin])
    strings = [(group[b], bytes(raw[b : b + LENGTH])) for b in begin]
    often = Counter(strings)
    want = sorted((b for b in begin if often[strings[b]] > 1), key=lambda b: (strings[b], b))
    order, again = suffix_array(raw, begin, group)
    assert begin[order].tolist() == want
    assert again.tolist() == [k > 0 and strings[want[k]] == strings[want[k - 1]] for k in range(len(want))]
    assert len(suffix_array(raw, begin[:0], group[:0])[0]) == 0


def test_many_parts_in_few_tasks(spark):
    rng = random.Random(9)
    shared = [some(rng, 40) for _ in range(5)]
    rows = [(k, some(rng, 5) + rng.choice(shared) + some(rng, 5) + rng.choice(shared)) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = remove_repeats(docs, part_bytes=300, most_partitions=3).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute(rows, lambda r: r[0])
