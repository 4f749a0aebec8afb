"""Media columns: payloads stored as WAV, read back by the wave module, with spectral-peak fingerprints.

The samples, with silence before and after so that each of them is inside several frames, are cut into overlapping
frames and a short-time Fourier transform gives each frame's spectrum. The strongest local peak of a frame is a
landmark; it is paired with the frame's next strongest peaks and with the next landmarks. A pair is coded as
(first bin, second bin, distance), where the distance is that of the frames, or FAN_OUT and the second peak's rank
within one frame, and stored with the frame of the first as its time.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary_texts, on_workers

RATE, FRAME, HOP, PEAKS, FAN_OUT, BLOCK = 8000, 128, 32, 8, 2, 1024
SILENCE = -128  # of a byte 0
ALIGN = 64
MOST_PAIRS = 250_000  # of a batch of results, or those of one text


def padded(data: bytes, align: int = ALIGN) -> bytes:
    """data with bytes 0 up to a positive multiple of align."""
    return data + bytes(-len(data) % align if data else align)


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(RATE)
        f.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as f:
        return f.readframes(f.getnframes())


def landmarks(payload: bytes):
    """The bins of each frame's strongest spectral peaks in order, -1 where there are fewer. Frames are done in blocks."""
    import numpy as np

    samples = np.frombuffer(payload, np.uint8).astype(np.float32) - 128
    edge = FRAME - HOP
    samples = np.pad(samples, (edge, edge + -(len(samples) + edge) % HOP), constant_values=SILENCE)
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    window = np.hanning(FRAME).astype(np.float32)
    peaks = np.empty((len(frames), PEAKS), np.int32)
    for at in range(0, len(frames), BLOCK):
        block = frames[at : at + BLOCK]
        power = np.abs(np.fft.rfft((block - block.mean(axis=1, keepdims=True)) * window, axis=1))
        inner = power[:, 1:-1]
        top = np.where((inner >= power[:, :-2]) & (inner > power[:, 2:]), inner, 0)
        best = np.argsort(-top, axis=1, kind="stable")[:, :PEAKS]
        peaks[at : at + BLOCK] = np.where(np.take_along_axis(top, best, axis=1) > 1e-3, best + 1, -1)
    return peaks


def fingerprint(payload: bytes):
    """Times and codes of all landmark pairs, ordered by time, then by distance."""
    import numpy as np

    peaks = landmarks(payload)
    first = peaks[:, 0]
    others = np.full((len(peaks), FAN_OUT + PEAKS - 1), -1, np.int32)  # the second bin of a frame's pairs, by distance
    for step in range(1, FAN_OUT + 1):
        others[:-step, step - 1] = first[step:]
    others[:, FAN_OUT:] = peaks[:, 1:]
    paired = (others >= 0) & (first >= 0)[:, None]
    codes = (first[:, None] << 16) | (others << 4) | np.arange(1, others.shape[1] + 1, dtype=np.int32)
    return np.nonzero(paired)[0].astype(np.int32), codes[paired]


_FIELDS = ("doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
           "peak_times array<int>, peak_codes array<int>")  # fmt: skip


def store_and_read(batches, with_media: bool):
    import pyarrow as pa

    for batch in batches:
        rows, media_out, pairs = [], [], 0
        for doc, text in zip(batch.column(0).to_pylist(), binary_texts(batch.column(1)), strict=True):
            media = to_wav(padded(text))
            back = from_wav(media)
            times, codes = fingerprint(back)
            rows.append((doc, len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-ALIGN:]), len(media), hashlib.sha256(media).hexdigest(), times, codes))
            if with_media:
                media_out.append(media)
            pairs += len(times)
            if pairs >= MOST_PAIRS:
                yield _batch(pa, rows, media_out, with_media)
                rows, media_out, pairs = [], [], 0
        if rows:
            yield _batch(pa, rows, media_out, with_media)


def _batch(pa, rows, media, with_media):
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
    names = [f.split()[0] for f in _FIELDS.split(", ")]
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns + ([pa.array(media, pa.binary())] if with_media else []), names + (["media"] if with_media else []))


def media_columns(docs: DataFrame, with_media: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: sizes and digests of the payload read back and of the stored WAV, and the
    fingerprint as time-coded arrays peak_times and peak_codes (and the WAV itself in media, if with_media).

    - null or empty text: a payload of 64 bytes 0, which is silent and has no pairs.
    - null doc_id is kept. Repeated rows give repeated results; equal texts give equal values.
    - short texts and the end of a text: framed like the rest, padded with silence; every other text has pairs.
      Places of peaks don't depend on loudness: a few of the shortest texts (a single letter, say) share theirs.
    - very long texts: whole; the spectrum is computed in blocks of frames. empty table: no rows.
    - further columns are ignored.
    """
    schema = T.StructType.fromDDL(_FIELDS + (", media binary" if with_media else ""))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(on_workers(store_and_read, with_media), schema)
