"""Token counts by section: whole documents are encoded once and tokens attributed by their offsets.

The byte-level tokenizer's tokens are slices of the text's UTF-8 bytes, so the running sum of token lengths
gives each token's span. The spans are interval-joined to the sections of the document (its lines, or the
fields it was put together from), and a token that crosses a boundary goes to one section by the rule.
"""

from __future__ import annotations

import base64

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary_texts, on_workers

RULES = ("majority", "start", "end")
_ENCODINGS: dict = {}


def encoding(path: str, pattern: str):
    """A tiktoken encoding and the length in bytes of each id."""
    import numpy as np
    import tiktoken

    if path not in _ENCODINGS:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            lengths[i] = len(token)
        _ENCODINGS[path] = tiktoken.Encoding("sections", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths
    return _ENCODINGS[path]


def attribute(token_ends, section_ends, rule: str):
    """The number of tokens of each section. Spans are half-open byte ranges, both lists end at the same byte.

    start: a token belongs to the section of its first byte. end: to that of its last byte. majority: to the
    section that has most of its bytes, the earlier one if several have as many.
    """
    import numpy as np

    ends = np.asarray(token_ends, np.int64)
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    bounds = np.asarray(section_ends, np.int64)
    owner = np.searchsorted(bounds, starts, "right")
    last = np.searchsorted(bounds, ends - 1, "right")
    if rule == "end":
        owner = last
    elif rule == "majority":
        for i in np.flatnonzero(owner != last):
            cuts = np.concatenate([[starts[i]], bounds[owner[i] : last[i]], [ends[i]]])
            owner[i] += int(np.diff(cuts).argmax())
    return np.bincount(owner, minlength=len(bounds)), int((owner != last).sum() if rule == "start" else (np.searchsorted(bounds, starts, "right") != last).sum())


def count_sections(batches, path: str, pattern: str, rule: str):
    """doc_id, fields (array of strings) -> a row per document: its sections' ends and token counts."""
    import numpy as np
    import pyarrow as pa

    encode, lengths = encoding(path, pattern)
    for batch in batches:
        fields = batch.column(1)
        parts, rows = fields.offsets.to_pylist(), []
        values = binary_texts(fields.values)
        for i, doc in enumerate(batch.column(0).to_pylist()):
            texts = [t.decode(errors="replace").encode() for t in values[parts[i] : parts[i + 1]]]
            whole = b"".join(texts)
            raw = np.frombuffer(whole, np.uint8)
            field_ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
            lines = np.flatnonzero(raw == 10) + 1
            ends = np.union1d(lines, field_ends[field_ends > 0]) if len(raw) else np.zeros(1, np.int64)
            ids = encode.encode_ordinary(whole.decode())
            token_ends = np.cumsum(lengths[np.array(ids, np.int64)]) if ids else np.zeros(0, np.int64)
            counts, crossing = attribute(token_ends, ends, rule)
            owner = np.searchsorted(field_ends, ends, "left")
            rows.append((doc, len(raw), len(ids), crossing, ends, counts, owner))
        if rows:
            kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "n_tokens", "n_crossing", "section_ends", "section_tokens", "section_fields"])


def token_counts(docs: DataFrame, tokenizer: str, pattern: str, rule: str = "majority", fields: tuple[str, ...] = ("text",), id_col: str = "doc_id") -> DataFrame:
    """One row per row of docs: n_bytes, n_tokens, n_crossing (tokens over a boundary) and, for each section in
    order, where it ends (section_ends, in bytes), its tokens (section_tokens) and its field (section_fields).

    The fields are put together without a separator and encoded once; a section is a line of a field, with its
    newline. The tokens of all sections add up to n_tokens.

    - null or empty fields: no bytes; if all are, one section of no tokens. null doc_id is kept.
    - repeated rows give repeated results. empty table: no rows. Very long texts are encoded whole.
    - ill-formed UTF-8 is read with replacement characters. Further columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    schema = T.StructType.fromDDL("doc_id long, n_bytes long, n_tokens long, n_crossing long, section_ends array<bigint>, section_tokens array<bigint>, section_fields array<bigint>")
    whole: Column = F.array(*[F.coalesce(F.col(c), F.lit("")) for c in fields])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole.alias("fields")).mapInArrow(on_workers(count_sections, tokenizer, pattern, rule), schema)
