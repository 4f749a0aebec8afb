"""Tables written to the shared folder, where a plan should be cut and survive lost executors."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Where it is unset, a local master gets a
    temporary folder, and a cluster an error: its executors would each write to a disk of their own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="strandlake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def staging_dir(spark: SparkSession) -> str:
    """The folder of this application's staged tables."""
    return f"{shared_dir(spark)}/strandlake-{spark.sparkContext.applicationId}"


def drop_staged(spark: SparkSession) -> None:
    """Deletes what this application has staged. Results that were not yet written or collected read these tables."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staging_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back. Shuffle files that only served the write are released."""
    spark = df.sparkSession
    path = f"{staging_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    release(spark)
    return spark.read.parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished queries now instead of at some later collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def spread(df: DataFrame) -> DataFrame:
    """Deals the rows over the cores where df has fewer partitions than these, for work that costs far more than a
    shuffle of its rows. Large inputs have enough partitions and stay where they are, as streams do, and what comes
    from a shuffle: counting its partitions would run it."""
    if df.isStreaming or re.search(r"\b(Repartition\w*|RebalancePartitions|Aggregate|Join|Window|Sort)\b", df._jdf.queryExecution().optimizedPlan().toString()):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def settle(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns that the planner computes once. It would copy a plain projection into every later use of it,
    and a filter on a column made of columns made of columns grows without bound; a generator of one row stops that."""
    kept = [F.col(c) for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))
