"""The corpus pipeline: each stage takes what its predecessor kept, written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import load, stage
from strandlake.llm.exact_dedup import exact_dedup
from strandlake.llm.mixing import mix_sources, repeat_documents
from strandlake.llm.near_dup import jaccard_components
from strandlake.llm.packing import pack_documents
from strandlake.llm.toxicity import toxicity_scores


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity operator does not reject, in all their columns.

    Null, empty and very long texts are scored like others, rows without doc_id too; repeated rows share a score."""
    return toxicity_scores(docs, load(spark, sf_dir, "labels"), carry=True).filter("predicted = 0").select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, that of the smallest doc_id. Null and empty texts are one group, and of
    repeated rows one stays; without any doc_id in the group, one of its rows."""
    return exact_dedup(docs, carry=True).filter("kept").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each group of linked documents: that of the smallest doc_id, then of the smallest hash.

    Rows without doc_id or with one that is used several times take part by their texts. Texts without words are
    linked with nothing and stay. Repeated rows stay together: the stage before has dropped them."""
    found = jaccard_components(docs).select("doc_id", "text_hash", "component")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    best = found.filter("component is not null").groupBy("component").agg(first).select("first.doc_id", "first.text_hash")
    kept = best.union(found.filter("component is null").select("doc_id", "text_hash")).distinct().select(F.col("doc_id").alias("__doc_id"), F.col("text_hash").alias("__hash"))
    same = (F.xxhash64("text") == F.col("__hash")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__doc_id"))
    return docs.join(kept, same, "left_semi")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix; one that is taken several times has as many rows. Documents without words are never
    taken; rows without source are a source of their own; repeated rows share what the mix takes of them."""
    return repeat_documents(docs, mix_sources(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their sequences; rows of one doc_id are told apart by these."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("jaccard_join", drop_near_copies), ("source_mixing", mix), ("packing", pack)]

#: SQL expresses neither the learned scores nor the packing; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
