"""Batched approximate matching against the definition: every start, every length, the edit distance of each window."""

import random

import pytest

from strandlake.operators.banded import best_windows


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def naive(needle, hay, subs, indels):
    at = hay.find(needle)
    if at >= 0:
        return 0, at, at + len(needle)
    m = len(needle)
    found = [(d, s, n) for s in range(len(hay)) for n in range(max(1, m - indels), m + indels + 1) if s + n <= len(hay) and (d := distance(needle, hay[s : s + n])) <= subs + indels]
    return (min(found)[0], min(found)[1], min(found)[1] + min(found)[2]) if found else (-1, -1, -1)


@pytest.mark.parametrize(("length", "subs", "indels"), [(1, 0, 1), (4, 1, 1), (8, 2, 1), (12, 2, 2), (9, 0, 0)])
def test_windows(length, subs, indels):
    rng = random.Random(length)
    for _ in range(6):
        needle = bytes(rng.choice(b"ACGT") for _ in range(length))
        hays = [b"", needle, needle[1:], needle + needle[::-1], b"A" * 40]
        for _ in range(40):
            part = bytearray(needle)
            for _ in range(rng.randint(0, 3)):
                k = rng.randrange(len(part) + 1)
                part[k : k + rng.randint(0, 1)] = bytes(rng.choice(b"ACGTN") for _ in range(rng.randint(0, 2)))
            hays.append(bytes(rng.choice(b"ACGT") for _ in range(rng.randint(0, 15))) + bytes(part) + bytes(rng.choice(b"ACGT") for _ in range(rng.randint(0, 15))))
        got = best_windows(needle, hays, subs, indels).T.tolist()
        assert [tuple(x) for x in got] == [naive(needle, h, subs, indels) for h in hays]


def test_nothing_to_match():
    assert best_windows(b"", [b"ACGT"], 2, 1).T.tolist() == [[-1, -1, -1]] and best_windows(b"ACG", [], 2, 1).shape == (3, 0)
