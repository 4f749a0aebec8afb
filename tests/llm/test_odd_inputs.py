"""Each operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest

from strandlake.llm.exact_dedup import exact_dedup
from strandlake.llm.media import media_columns
from strandlake.llm.mixing import mix_sources, repeat_documents, targets
from strandlake.llm.near_dup import jaccard_components
from strandlake.llm.packing import pack_documents
from strandlake.llm.quality import quality_scores
from strandlake.llm.sharding import shard_documents
from strandlake.llm.suffix_dedup import remove_repeats
from strandlake.llm.token_counts import token_counts
from strandlake.llm.toxicity import toxicity_scores

from .conftest import ODD

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_exact_dedup(odd):
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t, _ in ODD}
    size = Counter(re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, _ in ODD)
    least = {}
    for i, t in norm.items():
        if i is not None:
            least[t] = min(i, least.get(t, i))
    rows = exact_dedup(odd).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        t = norm[r.doc_id]
        assert (r.keep_id, r.group_size, r.text_sha256) == (least.get(t), size[t], hashlib.sha256(t.encode()).hexdigest())
    assert sum(r.kept for r in rows) == len(size)
    whole = exact_dedup(odd, carry=True).filter("kept").collect()
    assert {r.text for r in whole} <= {t for _, t, _ in ODD} and len(whole) == len(size)


def test_sharding(odd):
    rows = shard_documents(odd, shards=3, bucket_bytes=50_000).collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((i, t) for i, t, _ in ODD)
    for s in range(3):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert all(r.grown_shard in (r.shard, 3) for r in rows)
    grown = {r.doc_id: r.shard for r in shard_documents(odd, shards=4).collect()}
    assert all(grown[r.doc_id] == r.grown_shard for r in rows)


def test_mixing(odd):
    rows = mix_sources(odd).collect()
    size = {i: len((t or "").split()) for i, t, _ in ODD}
    assert len(rows) == len(ODD)
    assert all(r["size"] == size[r.doc_id] and r.taken == r.copies * r["size"] and r.copies <= 3 for r in rows)
    assert sum(r.taken for r in rows) <= sum(r["size"] for r in rows)
    again = {(r.doc_id, r.taken) for r in mix_sources(odd.repartition(2)).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}
    copies = repeat_documents(odd, mix_sources(odd))
    assert copies.columns == odd.columns
    assert Counter(r.doc_id for r in copies.collect()) == Counter({r.doc_id: r.copies for r in rows if r.copies})


def test_targets_share_the_excess_until_none_is_above():
    assert targets([10, 10, 100], [1, 2, 3], 120, 3) == [22.5, 30.0, 67.5]
    assert targets([0, 0], [1, 2], 0, 3) == [0.0, 0.0]


def test_jaccard_join(odd):
    rows = jaccard_components(odd).collect()
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str)
    one = {1: (3, 1), 2: (3, 1), 9: (3, 1), 3: (0, 3), 4: (0, 4), 5: (0, 5), 6: (1, 6), None: (1, None), 7: (2, 7), 8: (1, 8), 10: (1, 10)}
    assert got == sorted(((i, *one[i]) for i, _, _ in ODD), key=str)


def test_suffix_dedup(odd):
    rows = {r.doc_id: r for r in remove_repeats(odd, with_text=True).collect()}
    assert rows[10].n_removed == 2999 and rows[10].n_spans == 1
    assert rows[8].n_removed == 300_000 - 5 and rows[3].n_bytes == rows[4].n_bytes == 0
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed for r in rows.values())


def test_media(odd):
    rows = media_columns(odd, with_media=True).collect()
    for r in rows:
        text = next(t for i, t, _ in ODD if i == r.doc_id) or ""
        data = text.encode()
        data += bytes(-len(data) % 64 if data else 64)
        assert (r.payload_sha256, r.payload_bytes, r.tail_crc32) == (hashlib.sha256(data).hexdigest(), len(data), zlib.crc32(data[-64:]))
        assert hashlib.sha256(r.media).hexdigest() == r.media_sha256 and len(r.media) == r.media_bytes
    assert len(rows) == len(ODD)


def test_token_counts(odd):
    rows = token_counts(odd, BYTES, public_tokenizers.PATTERN).collect()
    assert len(rows) == len(ODD)
    assert all(sum(r.section_tokens) == r.n_tokens and r.section_ends[-1] == r.n_bytes for r in rows)
    two = {r.doc_id: r for r in token_counts(odd, BYTES, public_tokenizers.PATTERN, fields=("source", "text")).collect()}
    assert two[1].section_fields == [0, 1] and two[3].n_bytes == 2


def test_packing(odd):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORDS)
    rows = pack_documents(odd, WORDS, with_ids=True).collect()
    whole = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t, _ in ODD}
    import numpy as np

    for i, ids in whole.items():
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: (r.start, r.sequence_id, r.offset))
        times = sum(k == i for k, _, _ in ODD)
        assert [x for r in mine[::times] for x in np.frombuffer(r.ids, "<u4").tolist()] == ids and len(mine) % times == 0
        assert all(r.ids_crc32 == zlib.crc32(r.ids) and r.doc_tokens == len(ids) for r in mine)
    for s in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_scores(odd, labels):
    for score in (quality_scores, toxicity_scores):
        rows = score(odd, labels).collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
        assert score(odd, labels.limit(0)).count() == len(ODD)
    carried = toxicity_scores(odd, labels, carry=True)
    assert set(odd.columns) < set(carried.columns) and carried.count() == len(ODD)


@pytest.mark.parametrize(
    "apply",
    [exact_dedup, shard_documents, mix_sources, jaccard_components, remove_repeats, media_columns, lambda d: token_counts(d, BYTES, public_tokenizers.PATTERN), lambda d: pack_documents(d, WORDS)],
)
def test_empty_tables(none, apply):
    assert apply(none).count() == 0
