"""Running counts over a stream of FASTQ files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandlake.functions.seq import is_valid_record, read_id
from strandlake.operators.demux import Settings, demultiplex
from strandlake.operators.enrich import master_matrix
from strandlake.sources.fastq import FastqDataSource


def read_stream(spark: SparkSession, folder: str, mode: str = "resilient") -> DataFrame:
    """Records of a folder's files; a micro-batch is the files that are new."""
    spark.dataSource.register(FastqDataSource)
    return spark.readStream.format("fastq").option("mode", mode).load(folder)


def running_counts(reads: DataFrame, rounds, settings: Settings = Settings()) -> DataFrame:
    """round, dna, n so far; use the update or complete output mode."""
    return demultiplex(reads, rounds, settings).filter("bucket = 'passed_qc'").groupBy("round", "dna").agg(F.count(F.lit(1)).alias("n"))


def drop_duplicate_reads(reads: DataFrame, rounds: dict[str, int] | None = None, watermark: str | None = None) -> DataFrame:
    """Each read id of a round once, whichever of the round's files it is in; rounds maps a file's name to its round, and
    without it every file is a round of its own. A stream keeps the copy that comes first; the first in locked
    order is a batch matter. The state holds every read id, unless reads has a column ts and watermark a delay
    after which copies no longer come."""
    valid = is_valid_record(*(F.col(c) for c in ("header", "seq", "sep", "qual")))
    of = F.col("source_name") if rounds is None else F.try_element_at(F.create_map(*[F.lit(x) for p in rounds.items() for x in p]), F.col("source_name"))
    out = reads.filter(valid).withColumns({"round_key": of, "read_id": read_id(F.col("header"))})
    if watermark is not None:
        return out.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["round_key", "read_id"])
    return out.dropDuplicates(["round_key", "read_id"])


def run_matrix(reads: DataFrame, rounds, folder: str, settings: Settings = Settings()) -> StreamingQuery:
    """Writes the matrix of all reads so far to folder/batch=n with each micro-batch. Counts are incremental; the
    statistics are not, so they are computed anew from the counts."""
    names = [r.name for r in rounds]

    def write(counts: DataFrame, batch: int) -> None:
        denominators = counts.groupBy("round").agg(F.sum("n").alias("passed"))
        master_matrix(counts, denominators, names).write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    return running_counts(reads, rounds, settings).writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/_checkpoint").foreachBatch(write).start()
