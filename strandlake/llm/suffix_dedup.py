"""Suffix-array dedup by prefix-free parsing.

A rolling hash over 32-byte grams triggers the phrase ends: the smallest hash in the grams of a 100-byte string is
its trigger, so equal strings have equal triggers at equal places whatever surrounds them. The strings that share
a trigger start next to each other; together they are an extended phrase (their bytes, up to 168). The parse of the
corpus is its sequence of extended phrases, the dictionary the distinct ones, each with its first place.

Corpus order of two equal strings is decided in two steps. The suffixes of the parse are sorted by their first
phrase and their place; as a phrase holds its strings whole, that is as far as the parse's suffix array is needed:
all occurrences of a phrase but the first are repeats through and through. Then the first occurrences of different
phrases with one trigger are set side by side, and the suffix array of these dictionary entries (each suffix cut
after 100 bytes, with its trigger's place) is built by refining the order word by word. In it equal strings are
neighbours in the order of the corpus, so each repeated string follows its first occurrence. It compares bytes.
Phrases are compared by 128-bit fingerprints, with their trigger's hash, their length and its place.
Only the dictionary's bytes move a second time, so a highly repetitive corpus costs little more than its parse.

A place in the corpus is (null id, doc_id, row, byte). row is a hash of the text, so that rows that share a
doc_id, or have none, are documents of their own.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_texts, on_workers, stage

LENGTH, GRAM = 100, 32
_BASE = 0x9E3779B97F4A7C15
_SEGMENT = 1 << 18
_NO_ID = 1 << 31  # in row: the document has no id and comes last
_TABLES: dict = {}


def _tables(size: int):
    """Random values of the byte values, and the powers of the base and of its inverse up to size."""
    import numpy as np

    if len(_TABLES.get("up", ())) < size:
        values = np.frombuffer(b"".join(hashlib.blake2b(bytes([i]), digest_size=24).digest() for i in range(256)), np.uint64).reshape(256, 3)
        _TABLES["byte"], _TABLES["gram"], _TABLES["other"] = (values[:, k].copy() for k in range(3))
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            powers = np.full(size, base, np.uint64)
            powers[0] = 1
            _TABLES[name] = np.multiply.accumulate(powers)
    return _TABLES


def gram_hashes(raw):
    """The hash of each 32-byte gram, put together from those of its halves."""
    import numpy as np

    h = _tables(1)["gram"][raw]
    for half in (1, 2, 4, 8, 16):
        h = h[:-half] * np.uint64(_BASE) + h[half:]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    return h


def range_hashes(raw, begin, end, values: str = "byte"):
    """A 64-bit hash of raw[begin:end] for each pair, from running sums; another one for other values of the bytes."""
    import numpy as np

    t = _tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(t[values][raw] * t["up"][: len(raw)], out=sums[1:])
    h = (sums[end] - sums[begin]) * t["down"][begin]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32)) ^ (end - begin).astype(np.uint64)


def parse(raw, starts, ends):
    """The extended phrases of the texts raw[start:end]: first and last string start, trigger and its hash, and two
    hashes of the content."""
    import numpy as np

    none, no_hash = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(raw) < LENGTH:
        return none, none, none, no_hash, no_hash, no_hash
    hashes = gram_hashes(raw)
    least = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    for half in (1, 2, 4, 8, 16, 32):
        least = np.minimum(least[:-half], least[half:])
    least = np.minimum(least[:-5], least[5:])  # 69 grams of a string of 100 bytes
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    last = np.repeat(ends - LENGTH, ends - starts)
    begins = np.flatnonzero(np.arange(len(at)) <= last[: len(at)])
    if not len(begins):
        return none, none, none, no_hash, no_hash, no_hash
    trigger = at[begins]
    new = np.flatnonzero(np.concatenate([[True], (trigger[1:] != trigger[:-1]) | (begins[1:] != begins[:-1] + 1)]))
    first, final, trigger = begins[new], begins[np.concatenate([new[1:], [len(begins)]]) - 1], trigger[new]
    end = final + LENGTH
    return first, final, trigger, hashes[trigger], range_hashes(raw, first, end), range_hashes(raw, first, end, "other")


#: The columns of an entry of the parse: document, row, content, first string start, trigger's hash, strings after
#: the first, trigger's place in the phrase.
_ENTRY = ("i8", "u4", "u8", "u8", "u4", "u4", "u1", "u1")


def pack_entries(columns) -> bytes:
    import numpy as np

    return b"".join(np.ascontiguousarray(c, k).tobytes() for c, k in zip(columns, _ENTRY, strict=True))


def unpack_entries(blob: bytes):
    import numpy as np

    kinds = [np.dtype(k) for k in _ENTRY]
    n, at, columns = len(blob) // sum(k.itemsize for k in kinds), 0, []
    for k in kinds:
        columns.append(np.frombuffer(blob, k, n, at))
        at += n * k.itemsize
    return columns


def phrases(batches, parts: int):
    """doc, row, text -> for each part of the triggers, packed entries of the parse."""
    import numpy as np
    import pyarrow as pa

    def packed(group):
        raw = np.frombuffer(b"".join(x[3] for x in group), np.uint8)
        sizes = np.array([len(x[3]) for x in group], np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        first, final, trigger, h, one, two = parse(raw, starts, ends)
        if not len(first):
            return None
        text = np.searchsorted(ends, first, "right")
        doc, row = np.array([x[0] for x in group], np.int64)[text], np.array([x[1] for x in group], np.int64)[text]
        base = np.array([x[2] for x in group], np.int64)[text] - starts[text]
        part = ((h & np.uint64(0xFFFFFFFF)) % np.uint64(parts)).astype(np.int64)
        at = np.argsort(part, kind="stable")
        columns = [c[at] for c in (doc, row, one, two, first + base, h >> np.uint64(32), final - first, trigger - first)]
        keys, begin = np.unique(part[at], return_index=True)
        return keys, [pack_entries([c[a:b] for c in columns]) for a, b in zip(begin, [*begin[1:], len(at)], strict=True)]

    def flushed():
        rows = [(int(k), b) for out in done if out for k, b in zip(*out, strict=True)]
        by_part: dict[int, list] = {}
        for k, b in rows:
            by_part.setdefault(k, []).append(b)
        return pa.RecordBatch.from_arrays([pa.array([k for k, v in by_part.items() for _ in v], pa.int64()), pa.array([b for v in by_part.values() for b in v], pa.binary())], ["part", "entries"])

    group, size, done = [], 0, []
    for batch in batches:
        for doc, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), binary_texts(batch.column(2)), strict=True):
            for at in range(0, max(1, len(text) - LENGTH + 1), _SEGMENT):
                piece = text[at : at + _SEGMENT + LENGTH - 1]
                group.append((doc, row, at, piece))
                size += len(piece)
                if size >= _SEGMENT:
                    done.append(packed(group))
                    group, size = [], 0
                if len(done) >= 32:
                    yield flushed()
                    done = []
    if group:
        done.append(packed(group))
    if done:
        yield flushed()


def first_places(batches):
    """Entries ordered by part -> ranges of starts that are repeats (doc, row, lo, hi), and the dictionary entries to
    be set side by side (with their trigger's place and key). One part is held at a time."""
    import numpy as np
    import pyarrow as pa

    def placed(part, blobs):
        doc, row, one, two, lo, h, span, place = (np.concatenate(x) for x in zip(*map(unpack_entries, blobs), strict=True))
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        several = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
        if not len(several):
            return
        doc, row, one, two, lo, h, span, place = (c[several] for c in (doc, row, one, two, lo, h, span, place))
        shape = (span.astype(np.uint16) << 8) | place
        order = np.lexsort((lo, row, doc, row >= _NO_ID, shape, two, one, h))
        doc, row, one, two, lo, h, span, place, shape = (c[order] for c in (doc, row, one, two, lo, h, span, place, shape))
        new_h = np.concatenate([[True], h[1:] != h[:-1]])
        first = new_h | np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1]) | (shape[1:] != shape[:-1])])
        phrase, trigger = np.cumsum(first) - 1, np.cumsum(new_h) - 1
        at_first = np.flatnonzero(first)[phrase]
        repeat = (doc != doc[at_first]) | (row != row[at_first]) | (lo != lo[at_first])
        rival = first & (np.bincount(trigger, first)[trigger] > 1)
        for mask, with_key in ((repeat, False), (rival, True)):
            if mask.any():
                begin = lo[mask].astype(np.int64)
                key = (np.int64(part) << 32) | h[mask].astype(np.int64)
                nothing = pa.nulls(int(mask.sum()), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc[mask]), pa.array(row[mask].astype(np.int64)), pa.array(begin), pa.array(begin + span[mask]), pa.array(begin + place[mask]) if with_key else nothing, pa.array(key) if with_key else nothing],
                    ["doc", "row", "lo", "hi", "place", "key"],
                )

    now, blobs = None, []
    for batch in batches:
        for part, entries in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if part != now and blobs:
                yield from placed(now, blobs)
                blobs = []
            now = part
            blobs.append(entries)
    if blobs:
        yield from placed(now, blobs)


def dictionary_bytes(batches):
    """doc, row, text, wanted -> the dictionary entries with their bytes."""
    import pyarrow as pa

    for batch in batches:
        out = []
        for doc, row, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), binary_texts(batch.column(2)), batch.column(3).to_pylist(), strict=True):
            out += [(x["key"], doc, row, x["lo"], x["place"], text[x["lo"] : x["hi"] + LENGTH]) for x in wanted]
        if out:
            kinds = (*[pa.int64()] * 5, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["key", "doc", "row", "lo", "place", "bytes"])


def words(raw):
    """The eight bytes from each place on as one number, so that numbers are ordered as the bytes are."""
    import numpy as np

    out = raw.astype(np.uint64)
    for half in (1, 2, 4):
        out = (out[:-half] << np.uint64(8 * half)) | out[half:]
    return out


def suffix_array(raw, begin, group):
    """The order of the strings raw[b : b + LENGTH] by (group, bytes, place in begin), without those that no other
    equals in both, and which of them equal the one before. Words refine the order; only ties go on."""
    import numpy as np

    word = words(raw)
    order = np.argsort(group, kind="stable")
    value = group[order]
    for at in (None, *range(0, LENGTH - 8, 8), LENGTH - 8):
        if at is not None:
            here = word[begin[order] + at]
            by = np.lexsort((here, value))
            order, value, here = order[by], value[by], here[by]
        if not len(order):
            return order, np.zeros(0, bool)
        new = np.concatenate([[True], value[1:] != value[:-1]])
        if at is not None:
            new[1:] |= here[1:] != here[:-1]
        value = np.cumsum(new)
        tied = np.bincount(value)[value] > 1
        order, value = order[tied], value[tied]
    return order, np.concatenate([[False], value[1:] == value[:-1]]) if len(order) else np.zeros(0, bool)


def sort_suffixes(batches):
    """Dictionary entries ordered by (key, place in the corpus) -> ranges of starts whose strings come earlier too."""
    import numpy as np
    import pyarrow as pa

    def repeats(rows):
        key, doc, row, lo, place = (np.array(c, np.int64) for c in list(zip(*rows, strict=True))[:5])
        data = [r[5] for r in rows]
        raw = np.frombuffer(b"".join(data), np.uint8)
        sizes = np.array([len(b) for b in data], np.int64)
        counts = np.maximum(sizes - LENGTH + 1, 0)
        entry = np.repeat(np.arange(len(rows)), counts)
        inside = np.arange(len(entry)) - np.repeat(np.cumsum(counts) - counts, counts)
        begin = (np.cumsum(sizes) - sizes)[entry] + inside
        suffix = (np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])) * 256)[entry] + (place - lo)[entry] - inside
        order, again = suffix_array(raw, begin, suffix)
        at = np.sort(order[again])
        if not len(at):
            return None
        cut = np.flatnonzero((at[1:] != at[:-1] + 1) | (entry[at[1:]] != entry[at[:-1]]))
        head, tail = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])]
        start, of = lo[entry[head]] + inside[head], entry[head]
        return pa.RecordBatch.from_arrays([pa.array(doc[of]), pa.array(row[of]), pa.array(start), pa.array(start + tail - head)], ["doc", "row", "lo", "hi"])

    rows, last = [], None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if len(rows) >= 10_000 and row[0] != last:
                if (out := repeats(rows)) is not None:
                    yield out
                rows = []
            last = row[0]
            if not rows or row[:4] != rows[-1][:4]:  # repeated rows of the input bring an entry twice
                rows.append(row)
    if rows and (out := repeats(rows)) is not None:
        yield out


def remove(batches, with_text: bool):
    """doc_id, text, ranges of repeated starts -> what is left of each text."""
    import pyarrow as pa

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: len(names)]
    for batch in batches:
        rows = []
        for doc, text, ranges in zip(batch.column(0).to_pylist(), binary_texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            kept, at, removed, spans, open_until = [], 0, 0, 0, -1
            for lo, hi in sorted((x["lo"], x["hi"]) for x in ranges or ()):
                end = min(hi + LENGTH, len(text))
                if end <= at and spans or lo >= len(text):
                    continue
                if lo > open_until:
                    spans += 1
                begin = max(lo, at)
                kept.append(text[at:begin])
                removed += end - begin
                at = open_until = end
            kept.append(text[at:])
            rest = b"".join(kept)
            rows.append((doc, len(text), removed, spans, hashlib.sha256(rest).hexdigest(), *([rest] if with_text else [])))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def remove_repeats(docs: DataFrame, part_bytes: int = 32 << 20, most_partitions: int = 10_000, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes, if with_text).

    Removes each UTF-8 byte that a 100-byte string covers which also starts earlier (smaller doc_id, or the same
    document and earlier start). Strings never cross documents and are judged on the input. The triggers are dealt
    over parts of about part_bytes of text; beyond most_partitions a task takes several parts, one by one.

    - null text: the empty text. Texts under 100 bytes lose nothing.
    - rows with one doc_id and different texts: documents of their own, in the order of a hash of their texts.
    - rows without doc_id: likewise, after all others.
    - repeated rows (same doc_id or none, same text): one document; each of them loses the same bytes, and none
      loses them to another of them.
    - a cut may split a character: kept is bytes. Very long texts are parsed whole, in overlapping segments.
    - empty table: no rows. Further columns are ignored.
    """
    spark = docs.sparkSession
    doc, text = F.col(id_col).cast("long"), F.col(text_col)
    hashed = F.xxhash64(text)
    row = F.col("hashed").bitwiseAND(F.lit(_NO_ID - 1)) + F.when(F.col("doc_id").isNull(), F.lit(_NO_ID)).otherwise(0)
    texts = docs.select(doc.alias("doc_id"), hashed.alias("hashed"), text.alias("text")).select("doc_id", F.coalesce("doc_id", "hashed").alias("doc"), row.alias("row"), "text")
    total = texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // part_bytes + 1)
    tasks = min(parts, most_partitions)
    entries = texts.select("doc", "row", "text").mapInArrow(on_workers(phrases, parts), "part long, entries binary")
    dealt = entries.repartition(tasks, "part").sortWithinPartitions("part")
    found = stage(dealt.mapInArrow(on_workers(first_places), "doc long, row long, lo long, hi long, place long, key long"), "suffix-first")
    wanted = found.filter("key is not null").groupBy("doc", "row").agg(F.collect_list(F.struct("lo", "hi", "place", "key")).alias("wanted"))
    holders = texts.select("doc", "row", "text").join(wanted, ["doc", "row"])
    rivals = holders.mapInArrow(on_workers(dictionary_bytes), "key long, doc long, row long, lo long, place long, bytes binary")
    ordered = rivals.repartition(tasks, "key").sortWithinPartitions("key", F.col("row") >= _NO_ID, "doc", "row", "lo")
    late = stage(ordered.mapInArrow(on_workers(sort_suffixes), "doc long, row long, lo long, hi long"), "suffix-late")
    ranges = found.filter("key is null").select("doc", "row", "lo", "hi").union(late).groupBy("doc", "row").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    return texts.join(ranges, ["doc", "row"], "left").select("doc_id", "text", "ranges").mapInArrow(on_workers(remove, with_text), schema)
