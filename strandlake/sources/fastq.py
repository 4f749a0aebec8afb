"""The fastq data source: batch and streaming readers over plain or gzipped FASTQ, strict or resilient.

Framing is sequential, so a file is one partition; give a round many shards to read it in parallel. Files are local
(on a mount of all executors) or in a store that Arrow's file systems open, such as hdfs://, s3:// and gs://.
Register it with `spark.dataSource.register(FastqDataSource)`.
"""

from __future__ import annotations

import gzip
import json
import os
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "source_id int, source_name string, ordinal long, header string, seq string, sep string, qual string"
SUFFIXES = (".fastq", ".fq", ".fastqsanger", ".fastq.gz", ".fq.gz", ".fastqsanger.gz")
_BASES = frozenset(b"ACGTNacgtn")


def lines(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """Lines end at a newline only; one carriage return before it is dropped; the last line needs no newline."""
    rest = b""
    for chunk in chunks:
        *whole, rest = (rest + chunk).split(b"\n")
        for line in whole:
            yield line.removesuffix(b"\r")
    if rest:
        yield rest.removesuffix(b"\r")


def strict_records(rows: Iterable[bytes]) -> Iterator[tuple[bytes, bytes, bytes, bytes]]:
    """Every four lines are a record; a shorter rest is dropped."""
    rows = iter(rows)
    return zip(rows, rows, rows, rows, strict=False)


def _is_bases(line: bytes) -> bool:
    return bool(line) and _BASES.issuperset(line)


class _Lines:
    """Lines that can be looked at before they are taken."""

    def __init__(self, rows: Iterable[bytes]):
        self.source, self.ahead = iter(rows), []

    def peek(self, k: int = 0) -> bytes | None:
        while len(self.ahead) <= k and (line := next(self.source, None)) is not None:
            self.ahead.append(line)
        return self.ahead[k] if len(self.ahead) > k else None

    def take(self) -> bytes | None:
        line = self.peek()
        del self.ahead[:1]
        return line

    def skip_to_header(self) -> None:
        while (line := self.peek()) is not None and not line.startswith(b"@"):
            self.take()


def resilient_records(rows: Iterable[bytes]) -> Iterator[tuple[bytes, bytes, bytes, bytes]]:
    """Records of a damaged file: whatever cannot be framed comes out as a record that fails validation, and
    reading goes on at the next line that starts with @.

    Where a quality line is due, a line that starts with @ is the quality, unless bases and a separator follow:
    then the quality is missing and the line is the next header."""
    at = _Lines(rows)
    while (header := at.take()) is not None:
        if not header.startswith(b"@"):
            yield header, b"", b"", b""
            at.skip_to_header()
            continue
        seq = at.peek()
        if seq is None or seq.startswith(b"@"):
            yield header, b"", b"", b""
            continue
        at.take()
        sep = at.peek()
        if sep is None or not sep.startswith(b"+"):
            yield header, seq, sep or b"", b""
            at.skip_to_header()
            continue
        at.take()
        qual, bases, plus = at.peek(), at.peek(1), at.peek(2)
        missing = qual is None or (qual.startswith(b"@") and bases is not None and _is_bases(bases) and plus is not None and plus.startswith(b"+"))
        yield header, seq, sep, b"" if missing else at.take() or b""


def _store(path: str):
    """The file system of a URI such as hdfs://, s3:// or gs://, and the path in it; None for local files."""
    if "://" not in path or path.startswith("file://"):
        return None, path.removeprefix("file://")
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path)


def open_bytes(path: str):
    """A file for reading, local or in an object store, opened anew by each task and unpacked if its name ends in .gz."""
    store, inside = _store(path)
    raw = open(inside, "rb") if store is None else store.open_input_stream(inside, compression=None)
    return gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw


def list_files(path: str) -> list[str]:
    """The FASTQ files of a folder in the order of their names, or the file itself."""
    store, inside = _store(path)
    if store is None:
        return sorted(os.path.join(inside, f) for f in os.listdir(inside) if f.endswith(SUFFIXES)) if os.path.isdir(inside) else [inside]
    from pyarrow.fs import FileSelector, FileType

    if store.get_file_info(inside).type != FileType.Directory:
        return [path]
    base = path.rstrip("/")
    return sorted(f"{base}/{f.base_name}" for f in store.get_file_info(FileSelector(inside)) if f.type == FileType.File and f.base_name.endswith(SUFFIXES))


def chunks_of(path: str, size: int = 1 << 20) -> Iterator[bytes]:
    with open_bytes(path) as f:
        while chunk := f.read(size):
            yield chunk


def read_file(path: str, mode: str = "resilient", most: int | None = None) -> Iterator[tuple[int, str, str, str, str]]:
    """ordinal, header, seq, sep, qual of each record, latin-1 decoded; at most `most` of them."""
    records = (strict_records if mode == "strict" else resilient_records)(lines(chunks_of(path)))
    for ordinal, record in enumerate(records):
        if most is not None and ordinal >= most:
            return
        yield (ordinal, *(x.decode("latin-1") for x in record))


def record_batches(path: str, source: int, mode: str, most: int | None, rows: int = 4096):
    """The records of a file as Arrow batches in the order of SCHEMA."""
    import pyarrow as pa

    fields = [("source_id", pa.int32()), ("source_name", pa.string()), ("ordinal", pa.int64()), *((c, pa.string()) for c in ("header", "seq", "sep", "qual"))]
    records, name = read_file(path, mode, most), os.path.basename(path)
    while held := list(islice(records, rows)):
        columns = [[source] * len(held), [name] * len(held), *zip(*held, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


class _File(InputPartition):
    def __init__(self, index: int, path: str):
        super().__init__(index)
        self.index, self.path = index, path


def _paths(options) -> list[str]:
    """The files of the option paths (a JSON list, whose order numbers the sources) or path (a file or folder)."""
    if options.get("paths"):
        return json.loads(options["paths"])
    if not options.get("path"):
        raise ValueError("fastq needs the option path or paths")
    return list_files(options["path"])


def stable_id(path: str) -> int:
    """A number of 31 bits for a file, the same whatever other files there are."""
    return zlib.crc32(path.encode()) & 0x7FFFFFFF


class _Options:
    def __init__(self, options):
        self.options, self.mode = options, options.get("mode", "resilient")
        self.most = int(options["maxReadsPerSource"]) if options.get("maxReadsPerSource") else None
        if self.mode not in ("strict", "resilient"):
            raise ValueError("mode is strict or resilient")

    def read(self, partition):
        return record_batches(partition.path, partition.index, self.mode, self.most)


class _Reader(_Options, DataSourceReader):
    def partitions(self):
        return [_File(i, p) for i, p in enumerate(_paths(self.options))]


class _StreamReader(_Options, DataSourceStreamReader):
    """A micro-batch is the files that have come since the last one; the offset lists those that were there. Files
    come in any order, so a source's number is made of its path."""

    def initialOffset(self):
        return {"files": []}

    def latestOffset(self):
        return {"files": _paths(self.options)}

    def partitions(self, start, end):
        known = set(start["files"])
        return [_File(stable_id(p), p) for p in end["files"] if p not in known]

    def commit(self, end):
        pass


class FastqDataSource(DataSource):
    """Options: path or paths, mode (resilient or strict), maxReadsPerSource."""

    @classmethod
    def name(cls):
        return "fastq"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):
        return _StreamReader(self.options)


def peek(path: str, most_bytes: int = 256 * 1024) -> dict:
    """Whether the first record is valid, its length, and an estimate of the read length (150 without records)."""
    taken, parts = 0, []
    for chunk in chunks_of(path, 64 * 1024):
        parts.append(chunk)
        taken += len(chunk)
        if taken >= most_bytes:
            break
    records = list(zip(range(16), resilient_records(lines(parts)), strict=False))
    lengths = [len(r[1]) for _, r in records if r[1]]
    ok = bool(records) and records[0][1][0].startswith(b"@") and _is_bases(records[0][1][1]) and len(records[0][1][1]) == len(records[0][1][3])
    return {"valid": ok, "first_length": lengths[0] if lengths else 0, "read_length": round(sum(lengths) / len(lengths)) if lengths else 150}


def estimated_length(paths: list[str], default: int = 150, most_bytes: int = 4096) -> int:
    """The length of the second line in the first bytes of the first file, or the default without one."""
    if not paths:
        return default
    with open_bytes(paths[0]) as f:
        rows = f.read(most_bytes).split(b"\n")
    return len(rows[1].removesuffix(b"\r")) or default if len(rows) > 1 else default


def check_name(path: str) -> None:
    if not path.lower().endswith(SUFFIXES):
        raise ValueError(f"{path}: expected a name ending in one of {', '.join(SUFFIXES)}")


def duplicate_files(paths: list[str], part: int = 64 * 1024) -> list[list[str]]:
    """Groups of files that are probably the same: equal size, first and last bytes."""
    import hashlib

    groups: dict[str, list[str]] = {}
    for path in paths:
        size = os.path.getsize(path)
        with open(path, "rb") as f:
            head = f.read(part)
            f.seek(max(0, size - part))
            tail = f.read(part)
        groups.setdefault(hashlib.sha256(str(size).encode() + head + tail).hexdigest(), []).append(path)
    return [g for g in groups.values() if len(g) > 1]
