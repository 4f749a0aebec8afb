import gzip

import pytest
from pyspark.sql import functions as F

from strandlake.functions.seq import is_valid_record
from strandlake.sources.fastq import FastqDataSource, duplicate_files, estimated_length, list_files, lines, peek, read_file, resilient_records, strict_records

GOOD = b"@a x\nACGT\n+\nIIII\n"
BROKEN = {
    "missing separator": b"@b\nACGT\nIIII\n",
    "missing quality": b"@b\nACGT\n+\n",
    "bad base": b"@b\nACXT\n+\nIIII\n",
    "length mismatch": b"@b\nACGT\n+\nIII\n",
    "bad quality byte": b"@b\nACGT\n+\nII I\n",
    "empty id": b"@\nACGT\n+\nIIII\n",
    "junk": b"junk\nmore junk\n",
}


def valid(r):
    h, s, p, q = r
    return len(h) > 1 and h[:1] == b"@" and p[:1] == b"+" and bool(s) and set(s) <= set(b"ACGTNacgtn") and len(s) == len(q) and all(33 <= x <= 126 for x in q)


@pytest.mark.parametrize("kind", BROKEN)
def test_each_damage_costs_one_record(kind):
    rows = list(resilient_records(lines([GOOD + BROKEN[kind] + GOOD])))
    assert sum(map(valid, rows)) == 2
    assert sum(not valid(r) for r in rows) == 1


def test_every_split_into_two_chunks_gives_the_same_records():
    data = GOOD.replace(b"\n", b"\r\n") + b"@c\nACGT\n+\n@III\n" + BROKEN["missing quality"] + GOOD + b"@d\nAC"
    whole = list(resilient_records(lines([data])))
    for k in range(len(data)):
        assert list(resilient_records(lines([data[:k], data[k:]]))) == whole
    assert whole[1] == (b"@c", b"ACGT", b"+", b"@III")
    assert whole[-1] == (b"@d", b"AC", b"", b"")


def test_quality_that_starts_like_a_header():
    rows = list(resilient_records(lines([b"@a\nACGT\n+\n@b\nACGT\n+\nIIII\n"])))
    assert rows == [(b"@a", b"ACGT", b"+", b""), (b"@b", b"ACGT", b"+", b"IIII")]
    rows = list(resilient_records(lines([b"@a\nACGT\n+\n@III\nACGT\n"])))
    assert rows == [(b"@a", b"ACGT", b"+", b"@III"), (b"ACGT", b"", b"", b"")]


def test_strict_mode_drops_the_rest():
    assert len(list(strict_records(lines([GOOD * 3 + b"@x\nAC\n"])))) == 3


def test_data_source_reads_plain_and_gzip_alike(spark, tmp_path):
    spark.dataSource.register(FastqDataSource)
    plain, packed = tmp_path / "one.fastq", tmp_path / "two.fastq.gz"
    plain.write_bytes(GOOD * 5 + BROKEN["junk"] + GOOD)
    packed.write_bytes(gzip.compress(plain.read_bytes()))
    rows = spark.read.format("fastq").load(str(tmp_path))
    assert rows.count() == 14 and rows.filter(is_valid_record(*(F.col(c) for c in ("header", "seq", "sep", "qual")))).count() == 12
    assert {(r.source_id, r.source_name) for r in rows.select("source_id", "source_name").distinct().collect()} == {(0, "one.fastq"), (1, "two.fastq.gz")}
    assert spark.read.format("fastq").option("maxReadsPerSource", 2).load(str(tmp_path)).count() == 4
    assert spark.read.format("fastq").option("mode", "strict").load(str(tmp_path)).count() == 2 * 6
    assert peek(str(plain)) == {"valid": True, "first_length": 4, "read_length": 4}
    assert len(list(read_file(str(packed), most=3))) == 3


def test_duplicates(tmp_path):
    for name, data in (("a.fq", GOOD), ("b.fq", GOOD), ("c.fq", GOOD + GOOD)):
        (tmp_path / name).write_bytes(data)
    assert [sorted(p[-4:] for p in g) for g in duplicate_files([str(tmp_path / f"{c}.fq") for c in "abc"])] == [["a.fq", "b.fq"]]


def test_stream_takes_new_files_only(spark, tmp_path):
    spark.dataSource.register(FastqDataSource)
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.fastq").write_bytes(GOOD * 2)
    query = spark.readStream.format("fastq").load(str(folder)).writeStream.format("memory").queryName("fastq_rows").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    (folder / "b.fastq").write_bytes(GOOD * 3)
    query.processAllAvailable()
    query.stop()
    assert spark.table("fastq_rows").count() == 5


def test_estimates_and_uris(tmp_path):
    path = tmp_path / "a.fastq.gz"
    path.write_bytes(gzip.compress(b"@r\r\n" + b"A" * 33 + b"\r\n+\n"))
    empty = tmp_path / "b.fastq"
    empty.write_bytes(b"")
    assert estimated_length([str(path)]) == 33 and estimated_length([]) == estimated_length([str(empty)]) == 150
    assert list_files(f"file://{tmp_path}") == [str(path), str(empty)] == list_files(str(tmp_path))
    assert [len(r[2]) for r in read_file(f"file://{path}")] == [33]
