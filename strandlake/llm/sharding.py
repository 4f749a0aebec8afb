"""Sharding by a two-pass external shuffle, with DataFrame functions only.

Pass one scatters each record by seeded hashes into a shard and, inside it, one of the shard's buckets, of
which there are so many that a bucket fits into memory. Pass two gathers a bucket, puts its records into an order
that depends on them alone, Fisher-Yates shuffles it (Spark's shuffle function) and numbers the records after
those of the shard's earlier buckets. A task takes its buckets in order, so its random numbers are the same in
every run, also where a lost task is run again.

The shard is the one whose hash with doc_id is the largest (rendezvous hashing), so it depends on doc_id and
the number of shards only, and one more shard takes records only into itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty

_RESULTS = ("shard", "slot", "grown_shard")
_SMALL_BUCKETS = 200_000  # counts of so many buckets, 16 bytes each, may be broadcast
_HEAVY = 1000  # rows of which there are more than this, and than one in so many, are spread


def shard_of(key: Column, shards: int, seed: int) -> tuple[Column, Column]:
    """The shard of key among shards, and among one more."""
    scores = F.array(*[F.xxhash64(F.lit(seed), key, F.lit(j)) for j in range(shards + 1)])
    best = F.array_max(F.slice(scores, 1, shards))
    shard = (F.array_position(scores, best) - 1).cast("int")
    return shard, F.when(scores[shards] > best, F.lit(shards)).otherwise(shard).cast("int")


def numbered_copies(records: DataFrame, rows: int) -> DataFrame:
    """Adds copy: 0, but 0, 1, 2, ... for rows that repeat more than _HEAVY times and one in _HEAVY of all rows.

    There are at most _HEAVY such rows. They are counted instead of moved, and made anew from the counts."""
    same = records.select(F.xxhash64("row").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    often = [r["h"] for r in same.filter(F.col("n") > max(_HEAVY, rows // _HEAVY)).collect()]
    if not often:
        return records.withColumn("copy", F.lit(0).cast("long"))
    heavy = F.xxhash64("row").isin(often)
    counted = records.filter(heavy).groupBy("row").agg(F.count(F.lit(1)).alias("n"))
    again = counted.select("row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy"))
    return records.filter(~heavy).withColumn("copy", F.lit(0).cast("long")).unionByName(again)


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 20, bucket_bytes: int = 8 << 20, most_partitions: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with shard, slot (gapless from 0 in a shard, shuffled) and grown_shard.

    All three depend on the rows, the seed and the sizes given here, not on how docs is partitioned. Beyond
    most_partitions buckets a task takes several of them, one after the other.

    - null doc_id: hashed like a value of its own. null text stays null and weighs nothing.
    - repeated rows and equal texts: each is a record of its own; records with one doc_id share a shard, and
      are spread over its buckets by the rest of the row, very many identical rows by their number.
    - empty table: no rows; some shards may be empty, their slots then don't exist.
    - very long texts: a bucket is as large as bucket_bytes on average, or its largest text.
    - further columns are carried, whatever their names; columns named shard, slot or grown_shard are replaced.
      Columns of type map can't be hashed or ordered and raise.
    """
    kept = [c for c in docs.columns if c.lower() not in _RESULTS]
    weight = docs.agg(F.sum(F.octet_length(text_or_empty(text_col)) + 8).alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    per_shard = max(1, math.ceil((weight["bytes"] or 0) / (shards * bucket_bytes)))
    buckets = shards * per_shard

    records = numbered_copies(docs.select(F.struct(*[F.col(c) for c in kept]).alias("row")), weight["rows"])
    shard, grown = shard_of(F.col("row")[id_col], shards, seed)
    spread = F.pmod(F.xxhash64(F.lit(seed + 1), "row", "copy"), F.lit(per_shard))
    scattered = records.withColumn("bucket", (shard * per_shard + spread).cast("long"))
    counts = scattered.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(F.floor(F.col("bucket") / per_shard)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))

    record = F.struct(F.xxhash64(F.lit(seed + 2), "row", "copy").alias("key"), "copy", "row")
    gathered = scattered.select("bucket", record.alias("r")).repartition(min(buckets, most_partitions), "bucket").groupBy("bucket").agg(F.collect_list("r").alias("rs"))
    mixed = gathered.select("bucket", F.array_sort("rs").alias("rs")).sortWithinPartitions("bucket").select("bucket", F.shuffle("rs", seed).alias("rs"))
    dealt = mixed.select("bucket", F.posexplode("rs").alias("at", "r"))
    numbered = dealt.join(F.broadcast(offsets) if buckets <= _SMALL_BUCKETS else offsets, "bucket")
    return numbered.select(
        F.floor(F.col("bucket") / per_shard).cast("int").alias("shard"),
        (F.col("offset") + F.col("at")).cast("long").alias("slot"),
        F.col("r.row").alias("row"),
    ).select(*[F.col("row")[c].alias(c) for c in kept], "shard", "slot", shard_of(F.col("row")[id_col], shards, seed)[1].alias("grown_shard"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder of Parquet files per shard; slot has the order."""
    sharded.write.partitionBy("shard").parquet(path)
