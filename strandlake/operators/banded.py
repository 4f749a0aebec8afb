"""Approximate matching of a short needle in many reads at once, within a budget of edits.

One row of the edit matrix is kept for all reads of a batch, and all reads step through their bases together; a
row's insertions are a running minimum, so no cell is computed on its own. The first pass lets an occurrence start
anywhere and gives the least distance at each end. Only where that is within the budget are windows compared in
full, a start at a time for all lengths.
"""

from __future__ import annotations

import numpy as np

_BATCH = 1024


def padded(hays: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The reads as columns of a matrix of bytes, zeros behind their ends, and their lengths."""
    lengths = np.array([len(h) for h in hays], np.int64)
    out = np.zeros((int(lengths.max(initial=0)), len(hays)), np.uint8)
    for k, h in enumerate(hays):
        out[: len(h), k] = np.frombuffer(h, np.uint8)
    return out, lengths


def _rows(needle: np.ndarray, start: np.ndarray, columns, free: bool):
    """The last cell of the edit matrix after each of the columns (the reads' bases at one place), for all reads."""
    steps = np.arange(len(needle) + 1, dtype=np.int16)[:, None]
    cells = start
    for place, bases in enumerate(columns):
        new = np.empty_like(cells)
        new[0] = 0 if free else place + 1
        np.minimum(cells[:-1] + (needle[:, None] != bases), cells[1:] + 1, out=new[1:])
        new -= steps
        np.minimum.accumulate(new, axis=0, out=new)
        new += steps
        cells = new
        yield cells[-1]


def _near(needle: np.ndarray, hays: list[bytes], subs: int, indels: int):
    """The best window (score, start, end) of each read, or -1: lowest score, then earliest start, then shortest."""
    m, budget = len(needle), subs + indels
    least = max(m - indels, 1)
    out = np.full((3, len(hays)), -1, np.int64)
    bases, lengths = padded(hays)
    start = np.repeat(np.arange(m + 1, dtype=np.int16)[:, None], len(hays), axis=1)
    ends = [np.flatnonzero((last <= budget) & (i < lengths)) for i, last in enumerate(_rows(needle, start, bases, True))]
    read = np.concatenate([np.zeros(0, np.int64), *ends])
    end = np.repeat(np.arange(len(ends)) + 1, [len(e) for e in ends])
    if not len(read):
        return out
    lens = np.arange(least, m + indels + 1)
    begin = (end[:, None] - lens).ravel()
    keys = (np.repeat(read, len(lens)) * (bases.shape[0] + 1) + begin)[begin >= 0]
    keys = np.unique(keys)
    read, begin = np.divmod(keys, bases.shape[0] + 1)
    start = np.repeat(np.arange(m + 1, dtype=np.int16)[:, None], len(read), axis=1)
    columns = (bases[np.minimum(begin + c, bases.shape[0] - 1), read] for c in range(m + indels))
    scores, sizes = np.full(len(read), budget + 1, np.int64), np.zeros(len(read), np.int64)
    for c, last in enumerate(_rows(needle, start, columns, False), 1):
        better = (c >= least) & (begin + c <= lengths[read]) & (last < scores)
        scores[better], sizes[better] = last[better], c
    kept = scores <= budget
    read, begin, scores, sizes = read[kept], begin[kept], scores[kept], sizes[kept]
    order = np.lexsort((begin, scores, read))
    first = order[np.concatenate([[True], read[order][1:] != read[order][:-1]])] if len(order) else order
    out[:, read[first]] = scores[first], begin[first], begin[first] + sizes[first]
    return out


def best_windows(needle: bytes, hays: list[bytes], subs: int, indels: int) -> np.ndarray:
    """Rows score, start, end for each read, -1 where no window is within subs + indels edits of the needle.

    Windows are as long as the needle, give or take indels. An exact occurrence needs a search only."""
    out = np.full((3, len(hays)), -1, np.int64)
    if not needle:
        return out
    rest = []
    for k, h in enumerate(hays):
        at = h.find(needle)
        if at >= 0:
            out[:, k] = 0, at, at + len(needle)
        elif len(h) >= max(len(needle) - indels, 1):
            rest.append(k)
    letters = np.frombuffer(needle, np.uint8)
    for a in range(0, len(rest), _BATCH):
        some = rest[a : a + _BATCH]
        out[:, some] = _near(letters, [hays[k] for k in some], subs, indels)
    return out
