"""What makes two sets candidates: as many common regions as linked sets have, against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from strandlake.llm import near_dup
from strandlake.llm.near_dup import candidates, digest, local_components, node_of, region_edges, replicate, shingles

from .test_regions import brute


def grouped(texts, parts=3, keys=(), counts=()):
    """The smallest node of each text's group, as the cluster finds them."""
    keys, counts = np.array(keys, np.uint64), np.array(counts, np.uint32)
    entries = [row for b in replicate(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])]), 1, 75, keys, counts, parts, parts) for row in b.to_pylist()]
    entries.sort(key=lambda r: r["part"])
    tables = list(region_edges(iter([pa.RecordBatch.from_pylist(entries, pa.schema([("part", pa.int64()), ("entries", pa.binary())]))]), 75))
    met = {}
    for t in tables:
        for r in t.to_pylist():
            shared, need = met.get((r["a"], r["b"]), (0, r["need"]))
            met[r["a"], r["b"]] = shared + r["shared"], min(need, r["need"])
    edges = [pair for pair, (shared, need) in met.items() if shared >= need]
    nodes = [node_of(digest(shingles(t.encode(), 1))) for t in texts]
    root = dict(zip(*(x.tolist() for x in local_components(*(np.array(x, np.int64) for x in zip(*edges, strict=True)))), strict=True)) if edges else {}
    return [root.get(x, x) for x in nodes]


@pytest.mark.parametrize("paired", [64, 2])
def test_linked_sets_are_candidates(monkeypatch, paired):
    monkeypatch.setattr(near_dup, "_MOST_PAIRED", paired)
    rng = random.Random(paired)
    for _ in range(12):
        sets = []
        for size in (3, 12, 45, 90, 300, 700):
            base = rng.sample(range(4 * size), size)
            for _ in range(rng.randint(2, 9)):
                change = rng.randint(0, size // 4)
                sets.append(frozenset(base[rng.randint(0, change) :]) | {10**6 + rng.randrange(10**6) for _ in range(rng.randint(0, change))})
        sets = list(dict.fromkeys(sets))
        found, links = grouped([" ".join(f"w{x}" for x in sorted(s)) for s in sets], rng.choice([1, 3, 50])), brute(sets)
        assert all(found[i] == found[root] for i, root in enumerate(links))


def test_unrelated_texts_in_a_chain_of_shared_shingles_are_no_group(spark):
    """Each text shares a shingle with the next one, as in large tables by chance."""
    texts = [" ".join([f"x{k}"] + [f"t{k}w{j}" for j in range(150)] + [f"x{k + 1}"]) for k in range(60)]
    near = [texts[7].replace("t7w3 ", ""), texts[30] + " more"]
    docs = spark.createDataFrame([(k, k, t) for k, t in enumerate(texts + near)], "doc_id long, rid long, text string")
    groups = candidates(docs, 75, 1, 3, 1000, 1_500_000, 4)[1]
    assert groups.count() == 4 and groups.select("group").distinct().count() == 2


def test_short_unrelated_texts_in_a_chain_are_no_group(spark):
    """Sets of 30 shingles: linked ones share 26 at least, so one shared by chance makes no candidates."""
    texts = [" ".join([f"x{k}"] + [f"t{k}w{j}" for j in range(28)] + [f"x{k + 1}"]) for k in range(60)]
    near = [texts[7].replace("t7w3 ", ""), texts[30] + " more"]
    docs = spark.createDataFrame([(k, k, t) for k, t in enumerate(texts + near)], "doc_id long, rid long, text string")
    groups = candidates(docs, 75, 1, 3, 1000, 1_500_000, 4)[1]
    assert groups.count() == 4 and groups.select("group").distinct().count() == 2


def test_sets_of_texts_hashed_together():
    """Words of all lengths up to 70 bytes, blanks and bytes of any kind: equal words, and only these, have equal hashes."""
    rng = random.Random(4)
    texts = [b"", b" \t", b"a", b"a\0", b"\0a", b"A b", b"a\x0b\x0c B ", b"a \xc2\xa0\x1c b", b"q" * 64, b"Q" * 65, b"q" * 66 + b" z"]
    texts += [bytes(rng.choice(b"aAbB \t\n\0\x1c\xc3") for _ in range(rng.randint(0, 70))) for _ in range(500)]
    texts += [b" ".join(rng.choice([b"n", b"NN", b"n" * 9, b"m" * 70]) for _ in range(rng.randint(1, 30))) for _ in range(500)]
    sets, seen = list(near_dup.shingle_sets(texts, 3)), {}
    for text, found in zip(texts, sets, strict=True):
        words = text.lower().split()
        naive = {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()
        assert len(found) == len(naive) and (shingles(text, 3) == found).all()
        assert seen.setdefault(frozenset(naive), found.tobytes()) == found.tobytes()
    assert len(set(seen.values())) == len(seen)
