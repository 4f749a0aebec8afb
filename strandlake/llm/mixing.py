"""Mixing sources to target weights by weighted fair queueing.

A document that comes up for the e-th time in its source's shuffled order has the virtual finish time
(cumulative words of the source up to and with it) / (weight of the source). All appearances are range-sorted
by that time and the order is cut where the words reach the budget. Sources that have given all their
appearances leave the queue, and the others share what is left by weight.

Cumulative sums never gather a source: words are summed per (source, slice of the shuffled order, which is a range of
the keys that shuffle), the slice
sums become offsets, and only a slice of about slice_rows rows is ordered at once (a larger one, sorted on disk if
need be, where most_slices would be exceeded: the sums of a source's slices are ordered in one task).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stage


def word_count(column: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(seed: int, *columns: Column) -> Column:
    """A number of 60 bits from the MD5 of the columns as text, null as empty: rows are shuffled by its order."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: list[int], weights: list[float], budget: float, repeats: int) -> list[float]:
    """Shares of the budget by weight; a share above repeats * size stops there and the rest is shared again."""
    out, open_, left = [0.0] * len(sizes), list(range(len(sizes))), float(budget)
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > repeats * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(repeats * sizes[i])
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, repeats: int = 3, seed: int = 11, slice_rows: int = 1000, most_slices: int = 1_000_000, max_sources: int = 100_000, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken, copies.

    Sources in code-point order (null last) get the weights in turn. The budget is share of all words.

    - null source: a source of its own, the last. null or blank text: size 0, taken 0.
    - null doc_id: ordered by its hash like others. Repeated rows are records of their own; ties in the order
      are between identical rows only.
    - empty table: no rows. No words at all: every target and taken is 0.
    - a text longer than what is left of the budget ends the mix: the total stays below the budget by less
      than the longest text.
    - further columns of docs are ignored. More than max_sources sources raise, as one row per source comes
      to the driver.
    """
    spark = docs.sparkSession
    size = word_count(text_col)
    base = stage(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size")).withColumn("key", shuffle_key(seed, F.col("doc_id"), F.col("size"), F.col("source"))),
        "mix-sizes",
    )
    totals = base.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows")).orderBy(F.col("source").asc_nulls_last()).limit(max_sources + 1).collect()
    if len(totals) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    sizes, rows = [r["words"] for r in totals], sum(r["rows"] for r in totals)
    w = [float(weights[i % len(weights)]) for i in range(len(totals))]
    budget = share * sum(sizes)
    goal = targets(sizes, w, budget, repeats)
    listed = spark.createDataFrame([(i, r["source"], sizes[i], w[i], goal[i]) for i, r in enumerate(totals)], "sid int, __source string, source_size long, weight double, target double")

    slices = min(most_slices, max(1, math.ceil(rows / slice_rows)))
    # A row per source, of which there are at most max_sources.
    placed = base.join(F.broadcast(listed), base["source"].eqNullSafe(listed["__source"])).withColumn("slice", F.floor(F.col("key") / F.lit(2**60 // slices + 1)))
    sums = placed.groupBy("sid", "slice").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("sid").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("sid", "slice", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("sid", "slice").orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, 0)
    flow = stage(
        placed.withColumn("inside", F.sum("size").over(inside)).join(offsets, ["sid", "slice"]).select("doc_id", "source", "size", "source_size", "target", "sid", "key", "weight", (F.col("before") + F.col("inside")).alias("words")),
        "mix-flow",
    )

    def place(epoch: Column) -> Column:
        finish = (F.col("words") + epoch * F.col("source_size")) / F.col("weight")
        return F.struct(finish.alias("finish"), F.col("sid"), epoch.cast("int").alias("epoch"), F.col("key"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc"))

    cut = _cut(flow, place, budget, repeats)
    copies = F.lit(0)
    if cut is not None:
        edge = F.struct(F.lit(cut["finish"]).alias("finish"), F.lit(cut["sid"]).cast("int").alias("sid"), F.lit(cut["epoch"]).cast("int").alias("epoch"), F.lit(cut["key"]).cast("long").alias("key"), F.lit(cut["doc"]).cast("long").alias("doc"))
        copies = sum(((place(F.lit(e)) <= edge).cast("int") for e in range(repeats)), F.lit(0))
    taken = flow.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(0))
    return taken.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), F.col("copies").cast("int").alias("copies"))


def _cut(flow: DataFrame, place, budget: float, repeats: int):
    """The last place in the global order up to which the words stay within the budget."""
    appearances = flow.filter("size > 0").select(F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("e"), "*").select(place(F.col("e")).alias("p"), "size")
    ordered = stage(appearances.repartitionByRange("p").sortWithinPartitions("p").withColumn("part", F.spark_partition_id()), "mix-order")
    sums = sorted((r["part"], r["words"]) for r in ordered.groupBy("part").agg(F.sum("size").alias("words")).collect())
    left = budget
    for part, words in sums:
        if words > left:
            break
        left -= words
    else:
        part = None
    running = Window.partitionBy("part").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    inside = ordered.filter(F.col("part") == part).withColumn("sum", F.sum("size").over(running)).filter(F.col("sum") <= left)
    last = inside.agg(F.max("p").alias("p")).first()["p"] if part is not None else None
    if last is None:
        last = (ordered if part is None else ordered.filter(F.col("part") < part)).agg(F.max("p").alias("p")).first()["p"]
    return last


def repeat_documents(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents of the mix, each as often as it was taken; mixed is mix_sources(docs).

    Rows are found by doc_id, source and size. Rows alike in these (repeated rows, or several without doc_id) share
    their copies out: their appearances are dealt round, so that together they have as many as the mix took of
    them. The order among them is that of a hash of the text.

    - null doc_id or source: equal to null. Documents of no words are never taken. empty table: no rows.
    - the columns of docs come back whatever their names.
    """
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    keys = [F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), word_count(text_col).alias("size")]
    taken = mixed.filter("copies > 0").groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("times")).select(*[F.col(c).alias(f"of_{c}") for c in ("doc_id", "source", "size")], "times")
    single = mixed.filter("size > 0").groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").isEmpty()
    same = (F.col("size") == F.col("of_size")) & F.col("doc_id").eqNullSafe(F.col("of_doc_id")) & F.col("source").eqNullSafe(F.col("of_source"))
    found = docs.select(*keys, F.xxhash64(text_col).alias("hash"), row).filter("size > 0").join(taken, same)
    if single:
        copies = F.col("times")
    else:
        group = Window.partitionBy("doc_id", "source", "size")
        found = found.select("*", F.row_number().over(group.orderBy("hash")).alias("nth"), F.count(F.lit(1)).over(group).alias("rows"))
        copies = F.floor((F.col("times") + F.col("rows") - F.col("nth")) / F.col("rows"))
    repeated = found.select("row", copies.cast("int").alias("copies")).filter("copies > 0")
    return repeated.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select(*[F.col("row")[c].alias(c) for c in docs.columns])
