"""Joining regions, and what it rests on, against brute force."""

import random

import numpy as np
import pytest

from strandlake.llm.near_dup import join_regions, local_components, region_edges
from strandlake.llm.packing import cutting_stock, encoder
from strandlake.llm.token_counts import attribute
from strandlake.llm.toxicity import Lexicon, context_scores
from strandlake.llm.trees import fit


def brute(sets):
    up = list(range(len(sets)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def drifting(rng, universe=200):
    """Sets in chains: each is a changed copy of an earlier one, so links reach farther than the radius."""
    base = [frozenset(rng.sample(range(universe), rng.randint(5, 60))) for _ in range(rng.randint(1, 4))]
    out = set()
    for _ in range(rng.randint(2, 40)):
        s = set(rng.choice(sorted(out, key=sorted) if out and rng.random() < 0.5 else base))
        for _ in range(rng.randint(0, 12)):
            if s and rng.random() < 0.5:
                s.discard(rng.choice(sorted(s)))
            else:
                s.add(rng.randrange(universe))
        if s:
            out.add(frozenset(s))
    return sorted(out, key=sorted)


def test_no_link_is_lost():
    rng = random.Random(11)
    for _ in range(150):
        sets = drifting(rng)
        if len(sets) > 1:
            assert join_regions([np.array(sorted(s), np.uint64) for s in sets], 75) == brute(sets)


def test_local_components():
    nodes, root = local_components(np.array([5, 3, 9, 20]), np.array([3, 7, 20, 21]))
    assert dict(zip(nodes.tolist(), root.tolist(), strict=True)) == {3: 3, 5: 3, 7: 3, 9: 9, 20: 9, 21: 9}


def test_an_empty_part_has_no_edges():
    assert list(region_edges(iter([]), 75)) == []


@pytest.mark.parametrize("demand", [{}, {256: 5}, {1: 7}, {100: 3, 156: 3}, {k: 1 + k % 5 for k in range(1, 257)}])
def test_patterns_hold_the_demand(demand):
    made = {}
    for often, pattern in cutting_stock(demand, 256):
        assert often > 0 and sum(k * a for k, a in pattern.items()) <= 256
        for k, a in pattern.items():
            made[k] = made.get(k, 0) + often * a
    assert made == demand


def test_words_are_encoded_as_the_tokenizer_does():
    import public_tokenizers

    enc, rng = encoder(public_tokenizers.path("word_bpe_49k.json")), random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyzABC'éñßÉÜ0123456789.,!?-~<|>_\"中 ́İ"
    words = ["".join(rng.choice(letters.replace(" ", "")) for _ in range(rng.randint(1, 14))) for _ in range(5000)]
    words += ["it's", "''s", "<|endoftext|>", "a<|endoftext|>b", "x" * 5000]
    for w in words:
        assert enc._word(w.encode()) == enc.whole(w.encode()), w
    text = "  ".join(words[:500]) + "\x1c \x85 q"
    assert np.frombuffer(enc.encode(text.encode()), "<u4").tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


def test_tokens_over_a_boundary():
    assert attribute([4, 7, 10], [5, 10], "majority")[0].tolist() == [1, 2]
    assert attribute([4, 7, 10], [5, 10], "start")[0].tolist() == [2, 1]
    assert attribute([4, 7, 10], [5, 10], "end")[0].tolist() == [1, 2]
    assert attribute([2], [1, 2], "majority")[0].tolist() == [1, 0]
    assert attribute([], [0], "majority")[0].tolist() == [0]


def test_misspelled_terms_and_quotations():
    lexicon = Lexicon({"idiot", "scum"}, {"lowe"})
    kinds = {w: lexicon.kind(w) for w in ("idiot", "Idi0t!", "idot", "idioot", "idiiot", "scun", "loweing", "idiom", "edits")}
    assert kinds == {"idiot": 1, "Idi0t!": 1, "idot": 2, "idioot": 2, "idiiot": 2, "scun": 0, "loweing": 3, "idiom": 2, "edits": 0}
    said, meant = context_scores('he said "you idiot" to me', lexicon), context_scores("you idiot go", lexicon)
    assert said[4] > 0 and said[3] == 0 and meant[3] > 0 and meant[4] == 0


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.5)).astype(float)
    forest = fit(x[:1500], y[:1500])
    assert ((forest.score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95
    assert fit(x[:0], y[:0]).score(x[:3]).tolist() == [0.5] * 3
