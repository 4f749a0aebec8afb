"""What the corpus operators share: reading tables, texts as bytes, and the library's staged tables and workers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.tables import release, settle, shared_dir, stage
from strandlake.workers import on_workers

__all__ = ["BLANKS", "WORD", "binary_texts", "load", "on_workers", "release", "settle", "shared_dir", "stage", "text_or_empty"]

#: A run of the six ASCII blanks, as a Java and Python pattern.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def binary_texts(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column, null as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
