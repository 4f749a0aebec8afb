"""Exact dedup by content sort.

Splitters sampled from the normalised texts range-partition them, an external sort inside each partition places
equal texts next to each other, and each text is compared in full with the one before it: that alone decides
where a run of equal texts begins. Runs that touch the edge of a partition meet in a small pass over the edges,
two texts a partition at most.

A splitter between two different texts is cut to the shortest beginning that parts them. One inside a group of
copies is the whole text with a doc_id, so a group that holds a third of all rows spans many partitions.
"""

from __future__ import annotations

import json
import math
import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, settle, stage, text_or_empty

_RESULTS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
_ROW = 64  # bytes that a row weighs besides its text


def choose_splitters(sample: list[tuple[str, object]], parts: int) -> list[dict]:
    """At most parts - 1 ascending splitters {s, d} at even shares of the sample's bytes.

    What is at or behind (s, d) in the order (text, doc_id) goes right; d is None where s alone decides."""
    rows = sorted(sample, key=lambda r: (r[0], r[1] is None, 0 if r[1] is None else r[1]))
    weights = [len(t) + _ROW for t, _ in rows]
    total, seen, out = sum(weights), 0, []
    for k, (text, doc) in enumerate(rows):
        if k and seen * parts >= (len(out) + 1) * total and len(out) < parts - 1:
            before = rows[k - 1][0]
            if text != before:
                out.append({"s": text[: len(os.path.commonprefix([before, text])) + 1], "d": None})
            elif doc is not None and doc != rows[k - 1][1]:
                out.append({"s": text, "d": doc})
        seen += weights[k]
    return out


def place(text: Column, doc: Column, splitters: list[dict], doc_type: str) -> Column:
    """How many splitters the row (text, doc) is at or behind, by binary search. No doc is behind every doc."""
    if not splitters:
        return F.lit(0)
    cuts = F.from_json(F.lit(json.dumps(splitters)), f"array<struct<s:string,d:{doc_type}>>")

    def step(at: Column, _) -> Column:
        mid = F.shiftright(at["lo"] + at["hi"], 1)
        cut = F.get(cuts, mid)
        right = (text > cut["s"]) | ((text == cut["s"]) & (cut["d"].isNull() | doc.isNull() | (doc >= cut["d"])))
        pair = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
        return F.when(at["lo"] >= at["hi"], at).when(right, pair(mid + 1, at["hi"])).otherwise(pair(at["lo"], mid))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(splitters)).alias("hi"))
    rounds = math.ceil(math.log2(len(splitters) + 1))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, lambda at: at["lo"])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False, partition_bytes: int = 64 << 20, most_partitions: int = 20_000, sample_bytes: int = 16 << 20) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256 (and all columns of docs if carry).

    Two texts are equal when they are identical after each run of ASCII blanks becomes one space. Of equal
    texts the smallest doc_id stays. About sample_bytes of texts come to the driver for the splitters, which
    only decide where a row is sorted and never the result.

    - null text: the empty text. Empty texts are equal to each other, but not to a text of blanks (" ").
    - null doc_id: sorts last; it stays only if its whole group has no doc_id.
    - repeated rows (same doc_id, same text): group_size counts them all, exactly one has kept = true. They
      are sorted in one partition, which spills.
    - empty table: no rows. Very long texts are compared whole.
    - further columns of docs are ignored, or carried under their own names whatever these are; columns of docs
      that have the name of a result column are replaced by the result.
    """
    spark = docs.sparkSession
    replaced = {*_RESULTS, id_col.lower(), text_col.lower()}
    extra = [c for c in docs.columns if c.lower() not in replaced] if carry else []
    row = F.struct(F.col(text_col).alias("text"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(extra)])
    keyed = settle(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *([row.alias("row")] if carry else [])), {"norm": F.regexp_replace(text_or_empty(), BLANKS, " ")}).drop("text")

    total = docs.agg(F.sum(F.octet_length(text_or_empty(text_col)) + _ROW).alias("n")).first()["n"] or 0
    parts = min(most_partitions, max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // partition_bytes + 1))
    norm = F.regexp_replace(text_or_empty(text_col), BLANKS, " ")
    sample = docs.sample(min(1.0, sample_bytes / max(1, total)), seed=3).select(norm.alias("norm"), F.col(id_col).alias("doc_id")).collect()
    splitters = choose_splitters([(r["norm"], r["doc_id"]) for r in sample], parts)
    dealt = keyed.withColumn("part", place(F.col("norm"), F.col("doc_id"), splitters, keyed.schema["doc_id"].dataType.simpleString())).repartitionById(parts, "part")

    order = Window.partitionBy("part").orderBy("norm", F.col("doc_id").asc_nulls_last())
    compared = dealt.select("*", F.lag("norm").over(order).alias("before"), F.lead("norm").over(order).isNull().alias("last"))
    heads = compared.withColumn("head", F.coalesce(F.col("norm") != F.col("before"), F.lit(True)))
    runs = heads.select("*", F.sum(F.col("head").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
    edge = F.when(F.col("before").isNull() | F.col("last"), F.col("norm"))
    slim = runs.select("doc_id", "part", "run", "head", edge.alias("edge"), F.sha2(F.col("norm").cast("binary"), 256).alias("sha"), *(["row"] if carry else []))
    run = Window.partitionBy("part", "run")
    marked = stage(slim.select("*", F.min("doc_id").over(run).alias("least"), F.count(F.lit(1)).over(run).alias("n")), "exact-runs")

    found = marked.drop("edge").join(F.broadcast(edge_runs(marked)), ["part", "run"], "left")
    merged = F.col("size").isNotNull()
    results = [
        F.col("doc_id"),
        F.when(merged, F.col("keep")).otherwise(F.col("least")).alias("keep_id"),
        F.coalesce("size", "n").alias("group_size"),
        (F.col("head") & F.coalesce("leads", F.lit(True))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    ]
    carried = [F.col("row.text").alias(text_col), *[F.col(f"row.c{k}").alias(c) for k, c in enumerate(extra)]] if carry else []
    return found.select(*results, *carried)


def edge_runs(marked: DataFrame) -> DataFrame:
    """part, run, keep, size, leads of the runs at the edges of partitions, after those of equal texts are merged.

    Neighbours among the edge texts are compared in full. There are two a partition at most, so one task has
    them all: their number is bounded by most_partitions and doesn't grow with the rows."""
    at = Window.orderBy("part", "run")
    edges = marked.filter("edge is not null").select("part", "run", "edge", "least", "n")
    again = (F.col("part") == F.lag("part").over(at)) & (F.col("run") == F.lag("run").over(at))
    same = F.col("edge") == F.lag("edge").over(at)
    told = edges.select("part", "run", "least", "n", F.coalesce(again, F.lit(False)).alias("again"), F.coalesce(~same, F.lit(True)).cast("long").alias("new"))
    chained = told.select("*", F.sum("new").over(at.rowsBetween(Window.unboundedPreceding, 0)).alias("chain"))
    chain = Window.partitionBy("chain")
    place = F.struct("part", "run")
    out = chained.filter("not again").select("part", "run", F.min("least").over(chain).alias("keep"), F.sum("n").over(chain).alias("size"), (place == F.min(place).over(chain)).alias("leads"))
    return out
