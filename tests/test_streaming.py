import threading
import time

from strandlake.operators.demux import Round, Settings, demultiplex, variant_counts
from strandlake.sources.fastq import FastqDataSource
from strandlake.streaming.counts import drop_duplicate_reads, read_stream, running_counts
from strandlake.streaming.progress import cancel, cancellable, watched

TINY = Round("r0", "GGGGGAAAAACCCCC", "TTTTTGGGGG", 1, 9)


def fastq(names, seq="GGGGGAAAAACCCCCATGGCTAAAGG"):
    return "".join(f"@{n}\n{seq}\n+\n{'I' * len(seq)}\n" for n in names)


def test_running_counts_are_the_batch_counts(spark, tmp_path):
    folder = tmp_path / "reads"
    folder.mkdir()
    (folder / "a.fastq").write_text(fastq(["x", "y"]) + fastq(["z"], "GGGGGAAAAACCCCCTTTGCTAAAGG"))
    query = running_counts(read_stream(spark, str(folder)), [TINY]).writeStream.outputMode("complete").format("memory").queryName("running").start()
    query.processAllAvailable()
    (folder / "b.fastq").write_text(fastq(["x"]))
    query.processAllAvailable()
    query.stop()
    spark.dataSource.register(FastqDataSource)
    batch = variant_counts(demultiplex(spark.read.format("fastq").load(str(folder)), [TINY], Settings()))
    assert sorted(map(tuple, spark.table("running").collect())) == sorted(map(tuple, batch.collect())) == [("r0", "ATGGCTAAA", 3), ("r0", "TTTGCTAAA", 1)]


def test_stream_keeps_each_read_once(spark, tmp_path):
    folder = tmp_path / "reads"
    folder.mkdir()
    (folder / "a.fastq").write_text(fastq(["x", "x", "y"]))
    query = drop_duplicate_reads(read_stream(spark, str(folder))).select("read_id").writeStream.format("memory").queryName("once").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.read_id for r in spark.table("once").collect()) == ["x", "y"]


def test_a_read_counts_once_in_a_round(spark, tmp_path):
    folder = tmp_path / "reads"
    folder.mkdir()
    (folder / "a.fastq").write_text(fastq(["x", "y"]))
    query = drop_duplicate_reads(read_stream(spark, str(folder)), {"a.fastq": 0, "0.fastq": 0, "c.fastq": 1}).writeStream.format("memory").queryName("rounds_once").start()
    query.processAllAvailable()
    (folder / "0.fastq").write_text(fastq(["x", "z"]))  # sorts before the first file
    (folder / "c.fastq").write_text(fastq(["x"]))
    query.processAllAvailable()
    query.stop()
    rows = spark.table("rounds_once").collect()
    assert sorted((r.round_key, r.read_id) for r in rows) == [(0, "x"), (0, "y"), (0, "z"), (1, "x")]
    assert len({(r.source_id, r.source_name) for r in rows}) == 3 == len({r.source_id for r in rows})


def test_progress_is_reported_and_reads_are_limited(spark, tmp_path):
    folder, seen, ended = tmp_path / "reads", [], []
    folder.mkdir()
    (folder / "a.fastq").write_text(fastq(["x", "y", "z"]))
    spark.dataSource.register(FastqDataSource)
    with watched(spark, seen.append, ended.append):
        query = spark.readStream.format("fastq").option("maxReadsPerSource", 2).load(str(folder)).writeStream.format("memory").queryName("told").start()
        query.processAllAvailable()
        query.stop()
        for _ in range(100):
            if ended:
                break
            time.sleep(0.1)
    assert spark.table("told").count() == 2 and seen[-1]["total_rows"] == 2 and ended == [None]


def test_work_can_be_cancelled(spark):
    failed = []

    def work():
        with cancellable(spark, "slow"):
            try:
                spark.range(2 * 10**9).selectExpr("sum(hash(id))").collect()
            except Exception as e:
                failed.append(e)

    thread = threading.Thread(target=work)
    thread.start()
    for _ in range(100):
        time.sleep(0.1)
        cancel(spark, "slow")
        if failed:
            break
    thread.join(60)
    assert failed
