"""The law of the shards rebuilt on the registered query, and slots that don't depend on the input's partitions."""

from collections import Counter, defaultdict

import duckdb
import xxhash
from pyspark.sql import functions as F

from strandlake.llm import queries
from strandlake.llm.sharding import shard_documents

MORE = "/root/testdata/sf0.01"
M = (1 << 64) - 1


def hash_long(value, seed):
    """Spark's xxhash64 of one long, which is that of its eight bytes."""
    return xxhash.xxh64_intdigest(value.to_bytes(8, "little", signed=True), seed & M)


def hash_int(value, seed):
    return xxhash.xxh64_intdigest(value.to_bytes(4, "little", signed=True), seed & M)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def naive_shard(doc, shards):
    return max(range(shards), key=lambda j: signed(hash_int(j, hash_long(doc, hash_int(20, 42)))))


def test_law_of_the_query(spark):
    import zlib

    texts = dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{MORE}/documents.parquet'").fetchall())
    rows = queries.op10_sharding(spark, MORE).collect()
    assert Counter(r.doc_id for r in rows) == Counter(list(texts))
    slots = defaultdict(list)
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 8, zlib.crc32(data), "key")
        assert (r.shard, r.grown_shard) == (naive_shard(r.doc_id, 24), naive_shard(r.doc_id, 25))
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and len(slots) == 24


def test_slots_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{MORE}/documents.parquet").select("doc_id", "text")
    runs = [{r.doc_id: (r.shard, r.slot) for r in shard_documents(d, bucket_bytes=20_000).collect()} for d in (docs, docs.repartition(7), docs.repartitionByRange(3, "text"))]
    assert runs[0] == runs[1] == runs[2]
    one = sorted(runs[0], key=lambda i: runs[0][i])
    assert one != sorted(one)


def test_identical_rows_are_spread_and_kept(spark):
    same = spark.range(4000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("copied text").alias("text"), F.lit(1).alias("bucket"))
    rest = spark.range(100).select((F.col("id") + 6).alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit(2).alias("bucket"))
    out = shard_documents(same.union(rest), shards=3, bucket_bytes=2000)
    rows = out.collect()
    assert Counter((r.doc_id, r.text, r.bucket) for r in rows) == Counter({(5, "copied text", 1): 4000}) + Counter({(i, None, 2): 1 for i in range(6, 106)})
    for s in range(3):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    among = sorted(r.slot for r in rows if r.doc_id != 5 and r.shard == next(x.shard for x in rows if x.doc_id == 5))
    assert among and among[-1] - among[0] > 1000
