"""A quality classifier: histogram gradient-boosted trees over statistics of the whole document."""

from __future__ import annotations

import re
import zlib
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary_texts, on_workers
from .trees import fit

_CHUNK = 1 << 20
_MARKUP = re.compile(rb"<[a-zA-Z/!][^>]{0,200}>|https?://|[{};=]")

FEATURES = (
    "bytes", "words", "lines", "mean_word", "sd_word", "distinct_words", "top_word", "repeats_next", "upper", "digits", "spaces",
    "non_ascii", "punctuation", "symbols", "pipes", "bangs", "period", "comma", "distinct_bytes", "entropy", "deflate", "mean_line",
    "repeated_lines", "lines_end_well", "bullet_lines", "words_end_symbol", "words_with_symbol", "short_words", "long_words", "top_pair", "markup",
    "title_words", "longest_word", "repeated_pairs", "caps_words",
)


def statistics(text: bytes) -> list[float]:
    """FEATURES of one text, over all its bytes. An empty text has zeros."""
    import numpy as np

    if not text:
        return [0.0] * len(FEATURES)
    n = len(text)
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words, lines = text.split(), text.split(b"\n")
    w = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    tally = Counter(words)
    pairs = Counter(zip(words, words[1:], strict=False))
    p = count[count > 0] / n
    packer, packed = zlib.compressobj(1), 0
    for at in range(0, n, _CHUNK):
        packed += len(packer.compress(text[at : at + _CHUNK]))
    packed += len(packer.flush())
    full = [x for x in lines if x.strip()]
    symbols = frozenset(b"#$%&*+<=>@[\\]^_`{|}~")
    ends = Counter(x[-1] for x in words)
    letters = max(1, count[65:91].sum() + count[97:123].sum())
    punctuation = count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum()
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), float(np.log1p(len(lines))), lengths.mean(), lengths.std(), len(tally) / w,
        max(tally.values(), default=0) / w, sum(c for (a, b), c in pairs.items() if a == b) / w, count[65:91].sum() / letters,
        count[48:58].sum() / n, (count[32] + count[9:14].sum()) / n, count[128:].sum() / n, punctuation / n, sum(count[x] for x in symbols) / n,
        count[124] / n, count[33] / n, count[46] / w, count[44] / w, (count > 0).sum() / 256, float(-(p * np.log2(p)).sum()), packed / n,
        float(np.log1p(n / len(lines))), 1 - len(set(full)) / max(1, len(full)), sum(x.rstrip()[-1:] in b".!?" for x in full) / max(1, len(full)),
        sum(x.lstrip()[:1] in b"-*#>|" for x in full) / max(1, len(full)), sum(c for x, c in ends.items() if x in symbols or x == 33) / w,
        sum(c for x, c in tally.items() if not symbols.isdisjoint(x)) / w, (lengths <= 2).mean(), (lengths >= 15).mean(),
        max(pairs.values(), default=0) / w, len(_MARKUP.findall(text)) / w, sum(c for x, c in tally.items() if x[:1].isupper()) / w,
        float(np.log1p(lengths.max())), 1 - len(pairs) / max(1, len(words) - 1), sum(c for x, c in tally.items() if len(x) > 1 and x.isupper()) / w,
    ]


def measure(batches):
    """doc_id, text, label -> doc_id, label, features."""
    import pyarrow as pa

    for batch in batches:
        rows = [statistics(t) for t in binary_texts(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "label", "features"])


def score(batches, forest):
    """doc_id, text, held_out -> doc_id, held_out, score."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        texts = binary_texts(batch.column(1))
        x = np.array([statistics(t) for t in texts], float).reshape(len(texts), len(FEATURES))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(forest.score(x))], ["doc_id", "held_out", "score"])


def remainder(parts: int, id_col: str = "doc_id") -> Column:
    """crc32 of doc_id as text, modulo parts; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts


def training_rows(labels: DataFrame, label: str, parts: int, held: int, sample_rows: int) -> DataFrame:
    """At most sample_rows labelled ids outside the held-out part, by hash order; one row per id."""
    ids = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (remainder(parts) != held))
    one = ids.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    return one.orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id").limit(sample_rows)


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 3, held: int = 1, sample_rows: int = 20_000, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (probability of label 1), predicted (score >= threshold).

    Trees are fitted on the driver to statistics of at most sample_rows labelled documents outside the
    held-out part (crc32(doc_id) mod parts = held); every document is scored, from its text alone.

    - null or empty text: the score of a document whose statistics are 0. null doc_id: scored, never learned.
    - null labels are not learned; several labels of one doc_id count as their maximum.
    - no labels, or one class only: every score is the smoothed share of class 1.
    - repeated rows get equal scores. Very long texts are measured whole. empty table: no rows.
    - further columns are ignored.
    """
    import numpy as np

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), (remainder(parts, id_col) == held).alias("held_out"))
    chosen = training_rows(labels, label, parts, held, sample_rows)
    known = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")
    rows = known.mapInArrow(on_workers(measure), "doc_id long, label int, features array<double>").toArrow()
    order = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")
    x = np.array(rows.column("features").to_pylist(), float).reshape(len(order), len(FEATURES))[order]
    forest = fit(x, rows.column("label").to_numpy().astype(float)[order])
    schema = T.StructType.fromDDL("doc_id long, held_out boolean, score double")
    return texts.mapInArrow(on_workers(score, forest), schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
