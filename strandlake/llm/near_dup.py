"""N-gram Jaccard join in a metric space.

1 - Jaccard is a metric, so triangle inequalities bound what can be within the radius (0.25 for a similarity
of 0.75). The join is exact and works in two rounds of regions.

First the single shingles are the pivots. A document's distance to the pivot {s} is below 1 only if it holds s,
ties go to the first in one order of all shingles (known frequent ones last), and the radius bounds how far down
this order a document must be replicated so that every linked pair meets in a region, or in several: larger sets
go a few regions further, and two of them are candidates only if they meet as often as linked ones must. Two unrelated
texts that share one shingle so stay apart; else, in a large table, such chance meetings would chain most documents to
one group. Pairs are counted in regions of few sets only, about as many as there are entries; the sets of a region
that is beyond this are candidates at once, as a star.

Then documents are the pivots: inside a group of candidates the documents within the radius of a pivot are its
Voronoi region and linked through it. A document of another region is a boundary document of this one if its
distance to the pivot is at most the region's radius plus the join's; it is compared in full, as a pivot of its
own, unless the region has no member in its triangle-inequality window that isn't in its component already.

A small group is joined so in one task. A large one is dealt over many: each has all pivots of the round and a
share of the documents. What is linked with a pivot joins its region, and regions that share a document become one.
A document whose window reaches no document outside its region is done, as are the pivots. If too many are left,
these get regions of their own, by single shingles counted among them alone, and another round with twice as many
pivots, to any depth. Only verified links are connected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_texts, on_workers, stage

#: Odd multipliers of the words of a shingle, from the fractional parts of square roots.
_MIX = (0x9E3779B97F4A7C15, 0xBB67AE8584CAA73B, 0x3C6EF372FE94F82B, 0xA54FF53A5F1D36F1, 0x510E527FADE682D1, 0x9B05688C2B3E6C1F, 0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179)
_CHUNK = 1_500_000
_TOGETHER = 1 << 18
_MOST_MEETINGS = 8
#: Pairs are counted in regions of at most so many sets, and so many pairs for each entry of a part.
_MOST_PAIRED, _PAIRS_PER_ENTRY = 64, 2


def hash_words(data):
    """Where the words of some bytes start, and their 64-bit hashes. data: uint8, with a blank at each end.

    All words take their next eight bytes together; the few of more than 64 bytes are hashed one by one."""
    import numpy as np
    import xxhash

    blank = ((data >= 9) & (data <= 13)) | (data == 32)
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    lower = np.zeros(len(data) + 8, np.uint8)
    np.add(data, 32 * ((data >= 65) & (data <= 90)).astype(np.uint8), out=lower[: len(data)])
    eights = np.ndarray(len(data), np.dtype("<u8"), lower, strides=(1,))
    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

    def mixed(h):
        h ^= h >> np.uint64(33)
        h *= np.uint64(_MIX[4] | 1)
        h ^= h >> np.uint64(29)
        h *= np.uint64(_MIX[2] | 1)
        h ^= h >> np.uint64(32)
        return h

    hashes = mixed((eights[starts] & masks[np.minimum(lengths, 8)]) + lengths.astype(np.uint64) * np.uint64(_MIX[0]))
    for at in range(8, 64, 8):
        long = np.flatnonzero(lengths > at)
        if not len(long):
            break
        hashes[long] = mixed(hashes[long] * np.uint64(_MIX[1]) + (eights[starts[long] + at] & masks[np.minimum(lengths[long] - at, 8)]))
    for k in np.flatnonzero(lengths > 64).tolist():
        hashes[k] = xxhash.xxh3_64_intdigest(lower[starts[k] : starts[k] + lengths[k]].tobytes())
    return starts, hashes


def mix_shingles(hashes, width: int):
    """The hashes of all runs of width words."""
    import numpy as np

    out = np.full(len(hashes) - width + 1, width, np.uint64)
    for j in range(width):
        out += hashes[j : len(hashes) - width + 1 + j] * np.uint64(_MIX[j])
    out ^= out >> np.uint64(31)
    out *= np.uint64(_MIX[0])
    out ^= out >> np.uint64(29)
    return out


def shingle_sets(texts: list[bytes], width: int = 5):
    """For each text the sorted 64-bit hashes of its distinct shingles; a text of fewer words is one shingle, no words
    none. Texts of about _TOGETHER bytes are hashed at once."""
    import numpy as np

    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= _TOGETHER):
            size += len(texts[end]) + 1
            end += 1
        some = texts[at:end]
        starts, hashes = hash_words(np.frombuffer(b" " + b" ".join(some) + b" ", np.uint8))
        ends = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in some]) + 1).tolist()
        runs = mix_shingles(hashes, width) if len(hashes) >= width else hashes[:0]
        first = 0
        for last in ends:
            n = last - first
            out = runs[first : last - width + 1].copy() if n >= width else mix_shingles(hashes[first:last], n) if n else hashes[:0]
            out.sort()
            same = out[1:] == out[:-1]
            yield out[np.concatenate([[True], ~same])] if same.any() else out
            first = last
        at = end


def shingles(text: bytes, width: int = 5):
    """The set of one text, as shingle_sets has it."""
    return next(shingle_sets([text], width))


def digest(hashes) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(hashes.tobytes())


def node_of(key: bytes) -> int:
    """The start of a digest, as a number for the graph of candidates; sets that share it are compared anyway."""
    return int.from_bytes(key[:8], "little", signed=True)


def shingle_keys(hashes, parts: int):
    """The part of each shingle and its key: the part and the upper half of the hash. Shingles that share a key
    are counted and ordered together, everywhere alike."""
    import numpy as np

    part = (hashes & np.uint64(0xFFFFFFFF)) % np.uint64(parts)
    return part, (part << np.uint64(32)) | (hashes >> np.uint64(32))


def survey(batches, width: int, parts: int):
    """doc_id, rid, text -> a row per document: doc_id, rid, n, digest, node; and packed counts of shingles for each part."""
    import numpy as np
    import pyarrow as pa

    names = ["part", "doc_id", "rid", "n", "digest", "node", "counts"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary()]

    def table(*columns):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def counted():
        key, counts = np.unique(shingle_keys(np.concatenate(held), parts)[1], return_counts=True)
        upper, counts, part = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.minimum(counts, 65535).astype(np.uint16), (key >> np.uint64(32)).astype(np.int64)
        keys, starts = np.unique(part, return_index=True)
        none = [None] * len(keys)
        return table(keys, none, none, none, none, none, [upper[a:b].tobytes() + counts[a:b].tobytes() for a, b in zip(starts, [*starts[1:], len(part)], strict=True)])

    held, size, seen, turn = [], 0, set(), None
    for batch in batches:
        turn = batch.column(1)[0].as_py() % parts if turn is None and batch.num_rows else turn
        ns, digests = [], []
        for h in shingle_sets(binary_texts(batch.column(2)), width):
            d = digest(h)
            ns.append(len(h))
            digests.append(d)
            if d not in seen:
                seen.add(d)
                held.append(h)
                size += len(h)
            if size > _CHUNK:
                yield counted()
                held, size, seen = [], 0, set()
        nodes = [node_of(d) for d in digests]
        # Documents only pass through the parts, so they are dealt round: copies of one text have the same node.
        yield table([(turn + k) % parts for k in range(len(nodes))], batch.column(0), batch.column(1), ns, digests, nodes, [None] * len(nodes))
        turn += len(nodes)
    if size:
        yield counted()


def count_shingles(batches, least: int):
    """The rows ordered by part -> the documents as they are, and shingle keys that at least least texts have."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute

    names = ["doc_id", "rid", "n", "digest", "node", "key", "texts"]

    def summed(part, held):
        upper, counts = (np.concatenate(x) for x in zip(*held, strict=True))
        values, place = np.unique(upper, return_inverse=True)
        total = np.bincount(place, counts).astype(np.int64)
        often = total >= least
        if often.any():
            none = pa.nulls(int(often.sum()), pa.int64())
            keys = (np.int64(part) << 32) | values[often].astype(np.int64)
            yield pa.RecordBatch.from_arrays([none, none, none, pa.nulls(len(keys), pa.binary()), none, pa.array(keys), pa.array(total[often])], names)

    now, held = None, []
    for batch in batches:
        docs = batch.filter(pa.compute.is_valid(batch.column("node")))
        if docs.num_rows:
            none = pa.nulls(docs.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([docs.column(c) for c in names[:5]] + [none, none], names)
        counted = batch.filter(pa.compute.is_valid(batch.column("counts")))
        for part, packed in zip(counted.column("part").to_pylist(), counted.column("counts").to_pylist(), strict=True):
            if part != now and held:
                yield from summed(now, held)
                held = []
            now = part
            n = len(packed) // 6
            held.append((np.frombuffer(packed, np.uint32, n), np.frombuffer(packed, np.uint16, n, 4 * n)))
    if held:
        yield from summed(now, held)


def frequent_shingles(counts: DataFrame, most: int):
    """Keys (sorted) and counts of the most frequent shingles, at most `most`. Without a count in common they are
    cut by key. They only set the order of the pivots, so the bound costs time and never a link."""
    import numpy as np

    top = 10_000
    tally = counts.groupBy(F.least("texts", F.lit(top)).alias("t")).agg(F.count(F.lit(1)).alias("n")).collect()
    least, total = None, 0
    for t, n in sorted(((r["t"], r["n"]) for r in tally), reverse=True):
        if total + n > most:
            break
        least, total = t, total + n
    if least is None:
        kept = counts.orderBy(F.col("texts").desc(), "key").limit(most if tally else 0)
    else:
        kept = counts.filter(F.col("texts") >= least)
    rows = kept.select("key", "texts").toArrow()
    keys, texts = rows.column(0).to_numpy(), rows.column(1).to_numpy()
    order = np.argsort(keys)
    return keys[order].astype(np.uint64), np.minimum(texts[order], 2**31).astype(np.uint32)


def meetings(n, percent: int):
    """In how many regions at least a set of n shingles meets each one of n or more that it is linked with. It grows
    with n and never exceeds what the two share."""
    import numpy as np

    return np.minimum(_MOST_MEETINGS, 1 + 2 * percent * n // (100 + percent) // 8)


def replicate(batches, width: int, percent: int, keys, texts, key_parts: int, parts: int):
    """text -> for each part of the shingles, packed entries (shingle, set, size) of the pivots a set goes to.

    A set of n shingles that is linked with one of m <= n shares at least percent of n, so k of its first
    n - ceil(percent n) + k shingles are shared; if it is the smaller one of a pair, so are k of its first
    n - ceil(2 percent / (100 + percent) n) + k, its core. These k are the same for both: the first that they share
    in the order of all shingles. k is meetings(n), which is the least for the smaller set.

    The size has two bits below it: whether two pivots of the set share a key, as these are one region, and the core.
    """
    import numpy as np
    import pyarrow as pa

    held, seen, size = [], set(), 0

    def packed():
        h, s, n = (np.concatenate(x) for x in zip(*held, strict=True))
        part = ((h & np.uint64(0xFFFFFFFF)) % np.uint64(parts)).astype(np.int64)
        at = np.argsort(part, kind="stable")
        h, s, n = (h >> np.uint64(32)).astype(np.uint32)[at], s[at], n[at]
        keys, starts = np.unique(part[at], return_index=True)
        ends = [*starts[1:], len(at)]
        blobs = [s[a:b].tobytes() + h[a:b].tobytes() + n[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], ["part", "entries"])

    # Which hashes may be frequent, by 24 bits of theirs: most are not, and needn't be looked up.
    maybe = np.zeros(1 << 24, bool)
    maybe[(keys & np.uint64(0xFFFFFF)).astype(np.int64)] = True
    maybe = np.packbits(maybe, bitorder="little")

    for batch in batches:
        for h in shingle_sets(binary_texts(batch.column(0)), width):
            n = len(h)
            d = digest(h)
            if not n or d in seen:
                continue
            seen.add(d)
            if len(keys):
                upper = (h >> np.uint64(32)).astype(np.uint32)
                look = np.flatnonzero((maybe[(upper & np.uint32(0xFFFFFF)) >> np.uint32(3)] >> (upper & np.uint32(7)).astype(np.uint8)) & np.uint8(1))
                _, key = shingle_keys(h[look], key_parts)
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                found = keys[at] == key
                late = np.zeros(n, bool)
                late[look[found]] = True
                h = np.concatenate([h[~late], h[late][np.argsort(texts[at[found]], kind="stable")]])
            k = int(meetings(n, percent))
            first = h[: n - -(-percent * n // 100) + k]
            core = n - -(-2 * percent * n // (100 + percent)) + k
            region = (((first & np.uint64(0xFFFFFFFF)) % np.uint64(parts)) << np.uint64(32)) | (first >> np.uint64(32))
            sizes = np.full(len(first), 4 * n + 2 * (len(np.unique(region)) < len(region)), np.uint32)
            sizes[:core] += 1
            held.append((first, np.full(len(first), node_of(d), np.int64), sizes))
            size += len(first)
            if size > _CHUNK:
                yield packed()
                held, seen, size = [], set(), 0
    if held:
        yield packed()


def local_components(a, b):
    """The smallest node of each node's component, for edges between the nodes a and b."""
    import numpy as np

    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, root[i], least)
        np.minimum.at(root, root[j], least)
        root = root[root]
        if (root == before).all():
            return nodes, nodes[root]


def region_edges(batches, percent: int):
    """The entries, ordered by part -> pairs of sets (a, b; b is the smaller node) that meet in the part's regions: in
    how many, and in how many of all parts they must to be candidates. What a large region holds is a star of pairs
    that need no more. One part is held at a time."""
    import numpy as np
    import pyarrow as pa

    def table(a, b, shared, need):
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (np.maximum(a, b), np.minimum(a, b), shared, need)], ["a", "b", "shared", "need"])

    def met(held):
        s, h, n = (np.concatenate(x) for x in zip(*held, strict=True))
        entries = len(h)
        at = np.argsort((h.astype(np.uint64) << np.uint64(32)) | n)
        h, s, n = h[at], s[at], n[at]
        # A segment is a stretch of a region without a gap in size too wide for a link.
        wide = (h[1:] == h[:-1]) & (100 * (n[:-1] >> 2).astype(np.int64) >= percent * (n[1:] >> 2).astype(np.int64))
        some = np.zeros(len(h), bool)
        some[1:] |= wide
        some[:-1] |= wide
        h, s, n = h[some], s[some], n[some]
        at = np.lexsort((s, n, h))
        h, s, n = h[at], s[at], n[at]
        # Copies of a text have the same entries.
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (s[1:] != s[:-1]) | (n[1:] != n[:-1])
        h, s, n = h[fresh], s[fresh], n[fresh]
        if len(h) < 2:
            return
        core, shaky, size = (n & 1).astype(bool), (n & 2).astype(bool), (n >> 2).astype(np.int64)
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (100 * size[:-1] < percent * size[1:])
        segment = np.cumsum(new) - 1
        count = np.bincount(segment)
        order = np.argsort(count, kind="stable")
        large = np.zeros(len(count), bool)
        large[order] = np.cumsum(count[order] * (count[order] - 1) // 2) > _PAIRS_PER_ENTRY * entries
        large |= count > _MOST_PAIRED

        link = ~new[1:] & (s[1:] != s[:-1]) & (large & (np.bincount(segment, core) > 0))[segment[1:]]
        if link.any():
            nodes, root = local_components(s[:-1][link], s[1:][link])
            far = nodes != root
            yield table(nodes[far], root[far], np.ones(far.sum()), np.zeros(far.sum()))

        pairs, i, step = [], np.flatnonzero(~large[segment]), 0
        while len(i):
            step += 1
            i = i[i + step < len(h)]
            i = i[segment[i + step] == segment[i]]
            j = i + step
            # The smaller set comes first; of two of one size either core will do.
            link = (s[i] != s[j]) & (100 * size[i] >= percent * size[j]) & (core[i] | (core[j] & (size[i] == size[j])))
            p, q = i[link], j[link]
            need = np.where(shaky[p] | shaky[q], 1, meetings(size[p], percent))
            pairs.append((np.maximum(s[p], s[q]), np.minimum(s[p], s[q]), need))
        if pairs and sum(len(x[0]) for x in pairs):
            a, b, need = (np.concatenate(x) for x in zip(*pairs, strict=True))
            at = np.lexsort((b, a))
            a, b, need = a[at], b[at], need[at]
            start = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            yield table(a[start], b[start], np.diff([*start, len(a)]), np.minimum.reduceat(need, start))

    now, held = None, []
    for batch in batches:
        for part, entries in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if part != now and held:
                yield from met(held)
                held = []
            now = part
            n = len(entries) // 16
            held.append((np.frombuffer(entries, np.int64, n), np.frombuffer(entries, np.uint32, n, 8 * n), np.frombuffer(entries, np.uint32, n, 12 * n)))
    if held:
        yield from met(held)


def connected(edges: DataFrame) -> DataFrame:
    """Stars (a, b): b is the smallest node of a's component. Alternates large and small stars until nothing moves, in
    a number of rounds that grows with the logarithm of the nodes; all on the cluster."""
    edges = stage(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "near-edges")
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stage(large, "near-large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")
        edges = stage(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "near-small")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            return edges
        before = now


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


def shared_only(sets):
    """The sets without the shingles that no other of them holds."""
    import numpy as np

    flat = np.concatenate(sets)
    flat.sort()
    twice = np.unique(flat[1:][flat[1:] == flat[:-1]])
    del flat
    if not len(twice):
        return [s[:0] for s in sets]
    return [s[twice[np.minimum(np.searchsorted(twice, s), len(twice) - 1)] == s] for s in sets]


def join_regions(sets, percent: int):
    """The component (its smallest index) of each of several sets of sorted hashes, where two sets are linked
    if 100 * intersection >= percent * union."""
    import numpy as np

    m, union = len(sets), _Union(len(sets))
    sizes = np.array([len(s) for s in sets], np.int64)
    if m == 2:
        shared = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [0, 0] if 100 * shared >= percent * (sizes.sum() - shared) else [0, 1]
    sets = shared_only(sets)
    kept = np.array([len(s) for s in sets], np.int64)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(kept)])
    order = np.argsort(ids, kind="stable")
    holders = np.repeat(np.arange(m), kept)[order]
    first = np.concatenate([[0], np.cumsum(np.bincount(ids))])
    radius = 1 - percent / 100

    def compare(i: int):
        """The sets that share a shingle with set i, which of them are linked with it, and their distances."""
        mine = ids[starts[i] : starts[i + 1]]
        begin, count = first[mine], first[mine + 1] - first[mine]
        at = np.repeat(begin - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        near, shared = np.unique(holders[at], return_counts=True) if len(mine) else (np.array([i]), np.array([sizes[i]]))
        shared[near == i] = sizes[i]
        united = sizes[near] + sizes[i] - shared
        return near, 100 * shared >= percent * united, 1 - shared / united

    covered, probed = np.zeros(m, bool), np.zeros(m, bool)
    regions = []
    for p in range(m):
        if covered[p]:
            continue
        near, linked, far = compare(p)
        probed[p] = True
        ball = near[linked]
        for x in ball:
            union.join(p, int(x))
        covered[ball] = True
        if len(ball) > 1:
            reach = far <= far[linked].max() + radius + 1e-9
            regions.append((ball, far[linked], near[reach], far[reach]))
    for ball, inside, reach, outside in regions:
        for x, d in zip(reach.tolist(), outside.tolist(), strict=True):
            if probed[x]:
                continue
            mine = union.find(x)
            window = ball[inside >= d - radius - 1e-9].tolist()
            if all(union.find(y) == mine for y in window):
                continue
            probed[x] = True
            near, linked, _ = compare(x)
            for y in near[linked]:
                union.join(x, int(y))
    return [union.find(i) for i in range(m)]


def solve(batches, width: int, percent: int):
    """Rows (group, whole, doc_id, rid, digest, text), ordered by group -> for each set its digest, the digest of its
    component's set with the smallest doc_id, that doc_id, and whole."""
    import pyarrow as pa

    names = ["digest", "root", "component_id", "whole"]

    def solved(found, whole):
        keys = sorted(found, key=lambda k: (found[k][0] is None, found[k][0], k))
        roots = join_regions([found[k][1] for k in keys], percent) if len(keys) > 1 else [0] * len(keys)
        out = [(k, keys[r], found[keys[r]][0], whole) for k, r in zip(keys, roots, strict=True)]
        kinds = (pa.binary(), pa.binary(), pa.int64(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    now, of, found, seen = None, None, {}, set()
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(5)]
        for group, whole, doc, rid, key, h in zip(*columns, shingle_sets(binary_texts(batch.column(5)), width), strict=True):
            if group != now:
                if found:
                    yield solved(found, of)
                now, of, found, seen = group, whole, {}, set()
            if (doc, rid) in seen:
                continue
            seen.add((doc, rid))
            if digest(h) == key and (key not in found or found[key][0] is None or (doc is not None and doc < found[key][0])):
                found[key] = doc, h
    if found:
        yield solved(found, of)


def compare_with_pivots(batches, width: int):
    """Rows (group, share, pivot, digest, text), ordered by these with pivots first -> group, pivot's digest, digest,
    shared shingles and size of the union, for each document of the share and each pivot that it shares any with."""
    import numpy as np
    import pyarrow as pa

    names = ["group", "pivot", "digest", "shared", "united"]
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
    now, pivots, seen, index, out = None, {}, set(), None, []

    def table():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(4)]
        for group, share, is_pivot, key, h in zip(*columns, shingle_sets(binary_texts(batch.column(4)), width), strict=True):
            if (group, share) != now:
                now, pivots, seen, index = (group, share), {}, set(), None
            if key in (pivots if is_pivot else seen):
                continue
            if digest(h) != key:
                continue
            if is_pivot:
                pivots[key] = h
                continue
            seen.add(key)
            if index is None:
                keys = list(pivots)
                if not keys:
                    continue
                flat = np.concatenate([pivots[k] for k in keys])
                owner = np.repeat(np.arange(len(keys)), [len(pivots[k]) for k in keys])
                at = np.argsort(flat, kind="stable")
                index = keys, flat[at], owner[at]
            keys, flat, owner = index
            begin, end = np.searchsorted(flat, h, "left"), np.searchsorted(flat, h, "right")
            count = end - begin
            places = np.repeat(begin - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            for k, n in enumerate(np.bincount(owner[places], minlength=len(keys)).tolist()):
                if n and keys[k] != key:
                    out.append((group, keys[k], key, n, len(h) + len(pivots[keys[k]]) - n))
        if out:
            yield table()
            out = []


def candidates(texts: DataFrame, percent: int, width: int, frequent_texts: int, most_frequent: int, part_entries: int, most_partitions: int):
    """The sets of texts (doc_id, rid, n, digest, node), and the groups (node, group) of those that meet in a region."""
    spark = texts.sparkSession
    at_least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    key_parts = max(at_least, size // (8 * part_entries) + 1)
    surveyed = texts.select("doc_id", "rid", "text").mapInArrow(on_workers(survey, width, key_parts), "part long, doc_id long, rid long, n long, digest binary, node long, counts binary")
    dealt = surveyed.repartition(min(key_parts, most_partitions), "part").sortWithinPartitions("part")
    counted = dealt.mapInArrow(on_workers(count_shingles, frequent_texts), "doc_id long, rid long, n long, digest binary, node long, key long, texts long")
    seen = stage(counted, "near-survey")
    sets = seen.filter("n is not null").select("doc_id", "rid", "n", "digest", "node")
    keys, often = frequent_shingles(seen.filter("key is not null").select("key", "texts"), most_frequent)

    total = sets.agg(F.sum("n").alias("n")).first()["n"] or 0
    parts = max(at_least, total * (100 - percent) // 100 // part_entries + 1)
    entries = texts.select("text").mapInArrow(on_workers(replicate, width, percent, keys, often, key_parts, parts), "part long, entries binary")
    gathered = entries.repartition(min(parts, most_partitions), "part").sortWithinPartitions("part")
    pairs = gathered.mapInArrow(on_workers(region_edges, percent), "a long, b long, shared long, need long")
    often = pairs.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.min("need").alias("need")).filter("shared >= need")
    stars = connected(often.select("a", "b"))
    return sets, stars.select(F.col("a").alias("node"), F.col("b").alias("group")).union(stars.select(F.col("b").alias("node"), F.col("b").alias("group")).distinct())


def same_row(left: DataFrame, right: DataFrame) -> DataFrame:
    """Joins on (doc_id, rid), where no doc_id equals no doc_id; the columns of left and the others of right.

    Both grow with the input, so neither is broadcast, however small it is just now."""
    others = [c for c in right.columns if c not in ("doc_id", "rid")]
    keys = right.select(F.col("doc_id").alias("__doc_id"), F.col("rid").alias("__rid"), *others)
    return left.hint("merge").join(keys, (F.col("rid") == F.col("__rid")) & F.col("doc_id").eqNullSafe(F.col("__doc_id"))).select(*left.columns, *others)


def by_size(members: DataFrame, large_group: int, large_shingles: int) -> tuple[DataFrame, DataFrame]:
    """The members of groups that one task can join, and those of larger ones."""
    members = stage(members, "near-members")
    sizes = members.groupBy("group").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("w"))
    large = stage(sizes.filter((F.col("k") > 2) & ((F.col("k") > large_group) | (F.col("w") > large_shingles))).select("group"), "near-large")
    return members.join(large, "group", "left_anti"), members.join(large, "group", "left_semi")


def label_nodes(batches):
    """Rows (group, a, b), ordered by group: nodes that belong together -> group, node, label: the smallest of them."""
    import pyarrow as pa

    def labelled(group, pairs):
        nodes = sorted({x for pair in pairs for x in pair})
        index, union = {x: k for k, x in enumerate(nodes)}, _Union(len(nodes))
        for a, b in pairs:
            union.join(index[a], index[b])
        columns = [group] * len(nodes), nodes, [nodes[union.find(k)] for k in range(len(nodes))]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["group", "node", "label"])

    now, pairs = None, []
    for batch in batches:
        for group, a, b in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if group != now and pairs:
                yield labelled(now, pairs)
                pairs = []
            now = group
            pairs.append((a, b))
    if pairs:
        yield labelled(now, pairs)


def pivot_round(texts: DataFrame, members: DataFrame, width: int, percent: int, pivots: int, share_shingles: int, turn: int):
    """Compares the members (group, digest, doc_id, rid, n, label) of large groups with about so many pivots of theirs.

    Gives the links found (a, b), and the members that may have further ones. Members with one label are known to
    be connected. Each document of a group has the same chance to be a pivot; a group's documents are dealt over
    shares of about share_shingles shingles."""
    sizes = members.groupBy("group").agg(F.count(F.lit(1)).alias("k"), F.ceil(F.sum("n") / share_shingles).cast("int").alias("shares"))
    sized = stage(members.join(sizes, "group").withColumn("pivot", F.pmod(F.xxhash64("digest", F.lit(turn)), F.col("k")) < pivots), "near-pivots")
    dealt = sized.select("group", F.pmod(F.hash("digest"), F.col("shares")).alias("share"), F.lit(False).alias("pivot"), "digest", "doc_id", "rid")
    copied = sized.filter("pivot").select("group", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "pivot", "digest", "doc_id", "rid")
    rows = same_row(texts, dealt.union(copied)).select("group", "share", "pivot", "digest", "text")
    ordered = rows.repartition("group", "share").sortWithinPartitions("group", "share", F.col("pivot").desc())
    met = stage(ordered.mapInArrow(on_workers(compare_with_pivots, width), "group long, pivot binary, digest binary, shared long, united long"), "near-met")
    far = met.withColumns({"linked": 100 * F.col("shared") >= percent * F.col("united"), "d": 1 - F.col("shared") / F.col("united")})
    links = far.filter("linked").select(F.col("digest").alias("a"), F.col("pivot").alias("b"))

    # What a member is linked with gets one label; the pairs are as many as pivots and labels, not as members.
    own = sized.filter("pivot").select("group", "digest", F.col("digest").alias("node")).union(sized.filter("label is not null").select("group", "digest", F.col("label").alias("node")))
    near = far.filter("linked").select("group", "digest", F.col("pivot").alias("node")).union(own).groupBy("group", "digest").agg(F.sort_array(F.collect_set("node")).alias("nodes"))
    near = stage(near, "near-nodes")
    pairs = near.select("group", F.get("nodes", F.lit(0)).alias("a"), F.explode("nodes").alias("b")).distinct()
    labels = stage(pairs.repartition("group").sortWithinPartitions("group").mapInArrow(on_workers(label_nodes), "group long, node binary, label binary"), "near-labels")
    labelled = near.select("group", "digest", F.get("nodes", F.lit(0)).alias("node")).join(labels, ["group", "node"]).select("group", "digest", "label")

    # A document outside the component of a pivot is at least this far from it; without a shared shingle it is at 1.
    # Nothing that is linked with a document nearer than that, less the radius, lies outside.
    of_pivot = labels.select("group", F.col("node").alias("pivot"), F.col("label").alias("home"))
    known = stage(far.join(of_pivot, ["group", "pivot"]).join(labelled, ["group", "digest"], "left").select("group", "pivot", "digest", "d", F.col("label").eqNullSafe(F.col("home")).alias("inside")), "near-known")
    outside = known.groupBy("group", "pivot").agg(F.coalesce(F.min(F.when(~F.col("inside"), F.col("d"))), F.lit(1.0)).alias("gap"))
    closed = known.filter("inside").join(outside, ["group", "pivot"]).filter(F.col("gap") > F.col("d") + (1 - percent / 100) + 1e-9)
    done = closed.select("digest").union(sized.filter("pivot").select("digest")).distinct()
    rest = members.drop("label").join(done, "digest", "left_anti").join(labelled.select("digest", "label"), "digest", "left")
    return links, stage(rest, "near-rest")


def jaccard_components(
    docs: DataFrame, percent: int = 75, width: int = 5, frequent_texts: int = 3, most_frequent: int = 1 << 20, part_entries: int = 1_500_000, most_partitions: int = 10_000,
    large_group: int = 5000, large_shingles: int = 2_000_000, pivots: int = 16, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles (size of its set), component_id (smallest doc_id reachable by links),
    component (equal for what is linked, also without any doc_id; null for empty sets), text_hash (xxhash64 of the text).

    Sets hold 64-bit hashes of the word shingles (A-Z lower-cased, words between ASCII blanks). Equal sets are
    linked and joined once. Shingles that frequent_texts texts or more have come last in the order of the
    pivots, by their number of texts, as far as most_frequent of them go; that bounds what is broadcast, and the
    order has no influence on the result.

    A group of more than large_group candidates, or of more than large_shingles shingles, is joined in many tasks,
    a round of about `pivots` pivots after the other, twice as many each time. The limits have no influence on
    the result either.

    - null, empty or blank text: n_shingles 0, linked with nothing: component_id is its own doc_id.
    - texts of fewer than width words: one shingle, linked with equal texts only.
    - null doc_id: linked like others, also as the only link between two others; component_id is null only if no
      document that it reaches has a doc_id.
    - repeated rows: linked with each other; rows with one doc_id and different texts: each by its own text.
    - very long texts: whole. empty table: no rows. Further columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("rid"), F.col(text_col).alias("text"))
    limits = (percent, width, frequent_texts, most_frequent, part_entries, most_partitions)
    sets, groups = candidates(texts, *limits)
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    firsts = stage(sets.filter("n > 0").groupBy("digest", "node").agg(F.min(row).alias("row"), F.max("n").alias("n")).select("digest", "node", "row.doc_id", "row.rid", "n"), "near-sets")
    members = firsts.join(groups, "node").select("group", "digest", "doc_id", "rid", "n", F.lit(None).cast("binary").alias("label"))
    small, large = by_size(members, large_group, large_shingles)
    small, links, turn = [small.withColumn("whole", F.lit(True))], [], 0
    while not large.isEmpty():
        found, rest = pivot_round(texts, large, width, percent, pivots << turn, large_shingles, turn)
        links.append(found)
        left, large = by_size(rest, large_group, large_shingles)
        small.append(left.withColumn("whole", F.lit(False)))
        turn += 1
        if large.isEmpty():
            break
        again = stage(same_row(texts, large.select("doc_id", "rid")).dropDuplicates(["doc_id", "rid"]), "near-large-texts")
        fresh = candidates(again, *limits)[1].join(firsts.select("digest", "node"), "node").select("digest", "group")
        left, large = by_size(large.drop("group").join(fresh, "digest").select(*members.columns), large_group, large_shingles)
        small.append(left.withColumn("whole", F.lit(False)))

    table = small[0]
    for more in small[1:]:
        table = table.unionByName(more)
    grouped = same_row(texts, table.select("group", "whole", "digest", "doc_id", "rid")).select("group", "whole", "doc_id", "rid", "digest", "text")
    solved = grouped.repartition("group").sortWithinPartitions("group").mapInArrow(on_workers(solve, width, percent), "digest binary, root binary, component_id long, whole boolean")
    if links:
        solved = stage(solved, "near-solved")
        for found in links:
            solved = solved.unionByName(found.select(F.col("a").alias("digest"), F.col("b").alias("root"), F.lit(None).cast("long").alias("component_id"), F.lit(False).alias("whole")))
        stars = connected(solved.filter("not whole").select(F.col("digest").alias("a"), F.col("root").alias("b")))
        reached = stars.union(stars.select(F.col("b").alias("a"), "b").distinct()).select(F.col("a").alias("digest"), F.col("b").alias("root"))
        least = reached.join(firsts, "digest").groupBy("root").agg(F.min("doc_id").alias("component_id"))
        solved = solved.filter("whole").select("digest", "root", "component_id").union(reached.join(least, "root").select("digest", "root", "component_id"))
    # A set that met no other is a component of its own.
    known = firsts.join(solved.select("digest", "root", "component_id"), "digest", "left")
    alone = F.col("root").isNull()
    known = stage(known.select("digest", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("root", "digest").alias("component")), "near-components")
    linked = sets.filter("n > 0").join(known, "digest").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "component", F.col("rid").alias("text_hash"))
    empty = sets.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("binary").alias("component"), F.col("rid").alias("text_hash"))
    return linked.union(empty)
