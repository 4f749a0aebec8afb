"""The registered queries against brute force over the whole small tables, and held-out accuracy of the scores."""

import hashlib
import re
import wave
from collections import Counter, defaultdict
from io import BytesIO

import duckdb
import public_tokenizers
import pytest

import corpus_pipeline
from strandlake.llm import queries

SMALL, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs():
    return dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SMALL}/documents.parquet'").fetchall())


def word_sets(docs):
    out = {}
    for i, t in docs.items():
        w = t.encode().lower().split()
        out[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def components(docs):
    sets, up = word_sets(docs), {i: i for i in docs}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in sets:
            n = len(sets[i] & sets[j])
            if i < j and n and 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in docs}


def test_jaccard_join(spark, docs):
    rows = queries.op2_jaccard_join(spark, SMALL).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == components(docs)


def test_suffix_dedup(spark, docs):
    seen, want = set(), {}
    for i in sorted(docs):
        b = docs[i].encode()
        gone = bytearray(len(b))
        for j in range(len(b) - 99):
            if b[j : j + 100] in seen:
                gone[j : j + 100] = b"\1" * 100
            seen.add(b[j : j + 100])
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want[i] = (len(b), sum(gone), len([s for s in bytes(gone).split(b"\0") if s]), hashlib.sha256(kept).hexdigest())
    rows = queries.op6_suffix_dedup(spark, SMALL).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == want


def test_mixing_comes_near_its_targets(spark):
    rows = queries.op1_source_mixing(spark, MORE).collect()
    total = sum(r["size"] for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r.source_size, r.target].append(r)
    assert abs(sum(r.taken for r in rows) - total) < 20_000
    assert abs(sum(t for _, t in by) - total) < 1e-3 * total
    assert all(t <= 3 * s + 1e-9 for s, t in by)


def test_packing_leaves_little_padding(spark):
    rows = queries.op9_packing(spark, MORE).collect()
    used = defaultdict(int)
    for r in rows:
        used[r.sequence_id] += r.length
    waste = sum(0 if n & (n - 1) == 0 else 2048 - n for n in used.values())
    assert waste < 0.03 * sum(used.values())


def test_packing_ids_are_those_of_whole_texts(spark, docs):
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: [*tok.encode(t, add_special_tokens=False).ids, 1] for i, t in docs.items()}
    for r in queries.op9_packing(spark, SMALL).collect():
        piece = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert (r.ids_crc32, r.doc_tokens) == (zlib.crc32(piece), len(ids[r.doc_id]))


def test_token_counts_agree_with_slices(spark, docs):
    from strandlake.llm.token_counts import encoding

    enc, lengths = encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for r in queries.op8_token_counts(spark, SMALL).collect():
        data, at, want = docs[r.doc_id].encode(), 0, Counter()
        ends = r.section_ends
        for n in lengths[enc.encode_ordinary(docs[r.doc_id])].tolist():
            share = Counter(next(k for k, e in enumerate(ends) if b < e) for b in range(at, at + n))
            want[max(share, key=lambda k: (share[k], -k))] += 1
            at += n
        assert [want[k] for k in range(len(ends))] == r.section_tokens and ends[-1] == len(data)


def test_media_round_trip(spark, docs):
    from strandlake.llm.media import media_columns

    for r in media_columns(spark.read.parquet(f"{SMALL}/documents.parquet"), with_media=True).collect():
        with wave.open(BytesIO(r.media)) as f:
            assert f.readframes(f.getnframes())[: r.n_bytes] == docs[r.doc_id].encode()


@pytest.mark.parametrize(("query", "label", "least"), [(queries.op4_toxicity, "toxic", 0.93), (queries.op5_quality, "quality", 0.95)])
def test_held_out_accuracy(spark, query, label, least):
    truth = dict(duckdb.sql(f"SELECT doc_id, {label} FROM '{MORE}/labels.parquet'").fetchall())
    rows = [r for r in query(spark, MORE).collect() if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in rows) >= least * len(rows)


def test_pipeline_stages(spark, docs):
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = corpus_pipeline.drop_toxic(spark, table, SMALL)
    assert kept.columns == table.columns and set(kept.collect()) <= set(table.collect())
    unique = corpus_pipeline.drop_copies(spark, table, SMALL).collect()
    first = {}
    for i in sorted(docs):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", docs[i]), i)
    assert sorted(r.doc_id for r in unique) == sorted(first.values())
    near = corpus_pipeline.drop_near_copies(spark, table, SMALL).collect()
    assert sorted(r.doc_id for r in near) == sorted(i for i, (_, c) in components(docs).items() if c == i)
    mixed = corpus_pipeline.mix(spark, table, SMALL)
    assert mixed.columns == table.columns
    taken = {r.doc_id: r.taken // max(1, r["size"]) for r in queries.op1_source_mixing(spark, SMALL).collect()}
    assert Counter(r.doc_id for r in mixed.select("doc_id").collect()) == Counter({i: n for i, n in taken.items() if n})


def test_pipeline_runs(spark):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert rows and all(0 < r.length <= 2048 for r in rows)
