"""Packing documents into fixed sequences by cutting-stock column generation.

A document's tokens are cut every capacity tokens; the full pieces and the remainder are counted in a
histogram over length classes of `unit` tokens. A linear program over patterns (how many pieces of each class
one sequence holds) covers the histogram; its columns are priced by knapsack dynamic programming, so only
useful patterns are ever made. The rounded patterns are then dealt to the ranked pieces of each class. Only
the histogram (at most capacity / unit rows) and the patterns come to the driver.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary_texts, on_workers, stage

END_ID = 1
_ENCODERS: dict = {}
_CACHE_WORDS = 600_000
#: Stands for the end of a word in the byte-pair merger; no UTF-8 text holds this byte.
_WORD_END = b"\xff"
#: The tokenizer's own pattern, for the letters that _PLAIN admits.
_PLAIN = re.compile("[!-~\u00df-\u00f6\u00f8-\u00ff]+")
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z\u00df-\u00f6\u00f8-\u00ff0-9]+")


class WordEncoder:
    """Token ids of whole texts. This tokenizer drops white space and never joins across it, so a text's ids
    are those of its blank-separated words one after the other, and each distinct word is encoded once.

    A word of printable ASCII and small Latin-1 letters is lower-cased and cut by the tokenizer's own pattern, and
    the pieces are merged by a compiled byte-pair merger over the tokenizer's own merges; any other word goes
    through the tokenizer as it is. Tests hold both ways together.
    """

    def __init__(self, path: str):
        import json

        import numpy as np
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer, self.words, self.pieces = Tokenizer.from_file(path), {}, {}
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letter = {c: bytes([b]) for b, c in _byte_letters().items()}

        def as_bytes(token: str) -> bytes:
            end = token.endswith("</w>")
            return b"".join(letter[c] for c in (token[:-4] if end else token)) + _WORD_END * end

        # Ends of words are merged first, then the merges in their order; single bytes are never merged into.
        ranks = {bytes([b]) + _WORD_END: b for b in range(255)}
        ids = {b: model["vocab"][c + "</w>"] for b, c in _byte_letters().items() if b < 255}
        merges = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        for i, (x, y) in enumerate(merges):
            token = as_bytes(x + y)
            if token not in ranks:
                ranks[token] = 256 + i
                ids[256 + i] = model["vocab"][x + y]
        single = 256 + len(merges)
        for b, c in _byte_letters().items():
            ranks[bytes([b])] = single + b
            ids[single + b] = model["vocab"][c]
        self.id_of = np.zeros(single + 256, "<u4")
        for rank, i in ids.items():
            self.id_of[rank] = i
        self.merge = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def encode(self, text: bytes) -> bytes:
        words, known = text.split(), self.words
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            pass
        if len(known) > _CACHE_WORDS:
            known.clear()
        extra = {}
        for w in {w for w in words if w not in known}:
            (known if len(w) <= 64 else extra)[w] = self._word(w)
        if extra:
            return b"".join([extra[w] if w in extra else known[w] for w in words])
        return b"".join(map(known.__getitem__, words))

    def _word(self, word: bytes) -> bytes:
        text = word.decode(errors="replace").lower()
        if not _PLAIN.fullmatch(text) or "<|" in text:
            return self.whole(word)
        pieces = self.pieces
        out = []
        for piece in _PIECES.findall(text):
            got = pieces.get(piece)
            if got is None:
                got = self.id_of[self.merge(piece.encode() + _WORD_END)].tobytes()
                if len(pieces) > _CACHE_WORDS:
                    pieces.clear()
                if len(piece) <= 64:
                    pieces[piece] = got
            out.append(got)
        return b"".join(out)

    def whole(self, word: bytes) -> bytes:
        """The word through the tokenizer itself."""
        import numpy as np

        return np.array(self.tokenizer.encode(word.decode(errors="replace"), add_special_tokens=False).ids, "<u4").tobytes()


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def cut_pieces(batches, path: str, capacity: int, with_ids: bool):
    """doc_id, text -> pieces of at most capacity tokens."""
    import numpy as np
    import pyarrow as pa

    encode, end = encoder(path).encode, np.array([END_ID], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]
    for batch in batches:
        ids, rows, parts = batch.column(0).to_pylist(), [], []
        for doc, text in zip(ids, binary_texts(batch.column(1)), strict=True):
            tokens = encode(text) + end
            n = len(tokens) // 4
            for start in range(0, n, capacity):
                piece = tokens[4 * start : 4 * (start + capacity)]
                rows.append((doc, start, len(piece) // 4, zlib.crc32(piece), n))
                if with_ids:
                    parts.append(piece)
        if rows:
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(parts, pa.binary())] if with_ids else []), names)


def knapsack(values, weights, capacity: int):
    """The unbounded knapsack by dynamic programming: best value, and how often each item is in it."""
    import numpy as np

    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        k = np.searchsorted(weights, c, "right")
        best[c] = best[c - 1]
        if k:
            got = best[c - weights[:k]] + values[:k]
            i = int(got.argmax())
            if got[i] > best[c] + 1e-12:
                best[c], choice[c] = got[i], i
    counts, c = np.zeros(len(weights), np.int64), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            counts[choice[c]] += 1
            c -= weights[choice[c]]
    return best[capacity], counts


def cutting_stock(demand: dict[int, int], capacity: int, gap: float = 2e-3, most_columns: int = 20_000):
    """Patterns [(how often, {class: pieces})] that hold exactly the demand {class: pieces}, classes in units.

    Column generation with a revised simplex; it ends when Farley's bound shows the program to be within
    gap of its optimum, or after most_columns columns, should it turn in circles; every demand is packed all the
    same. Fractional pattern counts are rounded down and what they leave is filled greedily.
    """
    import numpy as np

    w = np.array(sorted(k for k, v in demand.items() if v), np.int64)
    if not len(w):
        return []
    b = np.array([demand[k] for k in w], float)
    columns = [np.zeros(len(w), np.int64) for _ in w]
    for i, size in enumerate(w):
        columns[i][i] = capacity // size
    inverse = np.diag(1.0 / (capacity // w))
    x, low = inverse @ b, 0.0
    for _ in range(most_columns):
        duals = inverse.sum(axis=0)
        value, made = knapsack(np.maximum(duals, 0), w, capacity)
        low = max(low, duals @ b / value) if value > 0 else low
        if value <= 1 + 1e-9 or x.sum() - low <= gap * x.sum():
            break
        d = inverse @ made
        ratio = np.where(d > 1e-12, x / np.where(d > 1e-12, d, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        x -= step * d
        x[out] = step
        pivot = inverse[out] / d[out]
        inverse -= np.outer(d, pivot)
        inverse[out] = pivot
        columns[out] = made
        np.maximum(x, 0, out=x)
    often = np.floor(x + 1e-9).astype(np.int64)
    left = b.astype(np.int64) - sum(int(n) * c for n, c in zip(often, columns, strict=True))
    for i in np.flatnonzero(left < 0):  # only by rounding errors
        while left[i] < 0:
            k = next(k for k in range(len(w)) if often[k] and columns[k][i])
            often[k] -= 1
            left = left + columns[k]
    patterns = [(int(n), {int(k): int(a) for k, a in zip(w, c, strict=True) if a}) for n, c in zip(often, columns, strict=True) if n]
    while left.any():
        room, pattern = capacity, {}
        for i in np.flatnonzero(left)[::-1]:
            if a := min(int(left[i]), room // int(w[i])):
                pattern[int(w[i])] = a
                room -= a * int(w[i])
        times = min(int(left[np.searchsorted(w, k)]) // a for k, a in pattern.items())
        for k, a in pattern.items():
            left[np.searchsorted(w, k)] -= a * times
        patterns.append((times, pattern))
    return patterns


def _deal_table(patterns):
    """For each class: first rank, first sequence and pieces per sequence of each pattern that uses it."""
    table: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for often, pattern in patterns:
        for k, a in pattern.items():
            table.setdefault(k, []).append((used.get(k, 0), sequence, a))
            used[k] = used.get(k, 0) + often * a
        sequence += often
    return table


def deal(batches, table, out):
    """Adds the sequence of a piece from the rank in its class."""
    import numpy as np
    import pyarrow as pa

    arrays = {k: tuple(np.array(c) for c in zip(*rows, strict=True)) for k, rows in table.items()}
    for batch in batches:
        kinds, ranks = batch.column("kind").to_numpy(), batch.column("rank").to_numpy()
        sequence = np.zeros(len(kinds), np.int64)
        for k in np.unique(kinds):
            at = kinds == k
            first, base, a = arrays[int(k)]
            j = np.searchsorted(first, ranks[at], "right") - 1
            sequence[at] = base[j] + (ranks[at] - first[j]) // a[j]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in out), pa.array(sequence)], [*out, "sequence_id"])


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, unit: int = 8, slice_rows: int = 1000, most_slices: int = 1_000_000, gap: float = 2e-3, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, 32-bit little-endian, if with_ids).

    The program over the length classes (of unit ids each) is solved to within gap of its optimum; rounding adds at
    most one pattern a class. Ranks inside a class come from slices of about slice_rows pieces, most_slices at most.

    Every document ends with id 1. Each id lies in exactly one piece; a sequence holds at most capacity ids.

    - null or blank text: one piece with the end id alone. null doc_id: packed like others.
    - repeated rows: each is packed; the pieces of identical rows are told apart by sequence_id and offset.
    - very long texts: cut every capacity tokens. empty table: no rows. Further columns are ignored.
    """
    spark = docs.sparkSession
    fields = [T.StructField(c, T.LongType()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
    schema = T.StructType(fields + ([T.StructField("ids", T.BinaryType())] if with_ids else []))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = stage(texts.mapInArrow(on_workers(cut_pieces, tokenizer, capacity, with_ids), schema), "pack-pieces")
    kind = F.ceil(F.col("length") / unit).cast("int")
    demand = {r["kind"]: r["n"] for r in pieces.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not demand:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
    table = _deal_table(cutting_stock(demand, capacity // unit, gap))

    slices = F.array(*[F.lit(min(most_slices, max(1, -(-demand.get(k, 0) // slice_rows)))) for k in range(max(demand) + 1)])
    placed = pieces.withColumn("kind", kind).withColumn("slice", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), slices[F.col("kind")]))
    sums = placed.groupBy("kind", "slice").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("kind").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("kind", "slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("kind", "slice").orderBy(F.col("doc_id").asc_nulls_last(), "start", "ids_crc32")
    ranked = placed.withColumn("inside", F.row_number().over(inside)).join(offsets, ["kind", "slice"]).withColumn("rank", (F.col("before") + F.col("inside") - 1).cast("long"))
    out = [*schema.fieldNames(), "kind", "rank"]
    dealt = ranked.select(*out).mapInArrow(
        on_workers(deal, table, out),
        T.StructType([*schema.fields, T.StructField("kind", T.IntegerType()), T.StructField("rank", T.LongType()), T.StructField("sequence_id", T.LongType())]),
    )
    before = Window.partitionBy("sequence_id").orderBy(F.col("kind").desc(), "rank").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")).select(*schema.fieldNames(), "sequence_id", "offset")
