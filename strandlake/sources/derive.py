"""Reads derived from the events table by integer arithmetic, so that every operator has input to run on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.seq import CODONS, STOPS, reverse_complement
from strandlake.operators.demux import Round
from strandlake.operators.ssm import Site
from strandlake.tables import settle, spread

BARCODE = "ACGTTGCAAGCTTC"
ANCHORS = ("GCTCAGATCG", "GCTCAGATTG", "GCTCAGACAG")
TAIL = "CAATCGATCGATCGATCGATGC"
RV_PRIMER = "GCATCGATCGATCGATCGATTG"
SELECTED = "GCTTGGAAA"
ROUNDS = tuple(Round(f"Round_{i}", BARCODE + a, RV_PRIMER, 1, 9) for i, a in enumerate(ANCHORS))

#: Two mutated sites between their anchors, with flanks, for the dual-anchor engine.
FLANK = "GATTACAGATCC"
SITES = (
    Site("S1", "GCAACTGGCTAGAATTCCG", "GGAAGCTAGCGAATTCAAT", 3, "GCT"),
    Site("S2", "TTCGGACCTGAACGTATGC", "CCATTGGTCAGCATCGGAA", 3, "TAC"),
)
SSM_BARCODES = ("AACCGGTTAACG", "TTGGCCAATTGC", "CTCTAGAGCTGA")


def codon(k: Column) -> Column:
    return F.substring(F.lit("".join(CODONS)), 1, 192).substr((k % 64 * 3 + 1).cast("int"), F.lit(3))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id"))


def short_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, ordinal, header, seq, sep, qual: multiplexed short reads with every kind of damage."""
    e, u = F.col("event_id"), F.col("user_id")
    third = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (e % 3 + 1).cast("int"))
    primer = F.concat(F.lit(BARCODE), third(ANCHORS))
    other = F.concat(F.lit(BARCODE), third(ANCHORS[1:] + ANCHORS[:1]))
    head = (
        F.when(e % 20 == 7, "AC" * 12)
        .when(e % 37 == 6, F.concat(F.lit("GG"), F.substring(primer, 3, 22)))
        .when(e % 31 == 5, F.concat(F.lit("G"), F.substring(primer, 2, 23)))
        .when(e % 29 == 4, F.concat(F.lit("N"), F.substring(primer, 2, 23)))
        .otherwise(primer)
    )
    cds = F.when(e % 6 == 2, SELECTED).otherwise(F.concat(codon(u), codon(u * 7 + e % 4), codon(u + e % 3)))
    whole = F.concat(head, cds, F.when(e % 43 == 9, other).otherwise(TAIL))
    kept = F.substring(whole, 1, 300).substr(F.lit(1), F.when(e % 41 == 8, 30).otherwise(300))
    base = settle(events(spark, sf_dir), {"sense": kept})
    n = F.length("sense")
    noisy = F.concat(F.repeat(F.lit("I"), F.lit(24)), F.repeat(F.lit("%"), F.lit(9)), F.repeat(F.lit("I"), F.lit(300))).substr(F.lit(1), n)
    qual = F.when(e % 25 == 3, F.repeat(F.lit("$"), n)).when(e % 17 == 2, noisy).otherwise(F.repeat(F.lit("I"), n))
    anti = e % 10 == 0
    read = settle(base, {"s": F.when(anti, reverse_complement(F.col("sense"))).otherwise(F.col("sense")), "q": F.when(anti, F.reverse(qual)).otherwise(qual)})
    seq = F.when(e % 53 == 10, F.concat(F.lit("X"), F.substring("s", 2, 300))).when(e % 23 == 11, F.lower("s")).otherwise(F.col("s"))
    name = F.when(e % 50 == 0, e + 3).otherwise(e)
    tag = F.when(e % 7 == 0, "").otherwise(F.concat(F.lit(" qs:f:"), (e % 30).cast("string"), F.lit(".5")))
    return settle(read, {"seq": seq, "qual": F.when(e % 59 == 12, F.substring("q", 2, 300)).otherwise(F.col("q"))}).select(
        (e % 6).cast("int").alias("source_id"), e.alias("ordinal"), F.concat(F.lit("@r"), name.cast("string"), tag).alias("header"), "seq",
        F.lit("+").alias("sep"), "qual",
    )


def site_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, ordinal, header, seq, sep, qual: barcoded reads over two sites, with edits in anchors and sites."""
    e, u = F.col("event_id"), F.col("user_id")
    barcode = F.element_at(F.array(*[F.lit(b) for b in SSM_BARCODES]), (e % 3 + 1).cast("int"))
    barcode = F.when(e % 19 == 4, F.concat(F.lit("T"), F.substring(barcode, 2, 11))).when(e % 27 == 5, "GTGTGTGTGTGT").otherwise(barcode)
    one, two = SITES
    fw = F.when(e % 13 == 3, one.fw_anchor[:5] + "A" + one.fw_anchor[6:]).when(e % 17 == 5, one.fw_anchor[:9] + one.fw_anchor[10:]).when(e % 33 == 7, "ACACACACACACACACACA").otherwise(one.fw_anchor)
    first = F.when(e % 4 == 1, one.wt_dna).when((e % 3 == 2) & (e % 5 < 2), "TGG").otherwise(codon(u))
    first = F.when(e % 22 == 9, F.concat(first, F.lit("A"))).otherwise(first)
    second = F.when(e % 4 == 2, two.wt_dna).otherwise(codon(u * 5 + e % 2))
    rv = F.when(e % 47 == 11, F.concat(F.lit(two.rv_anchor[:8]), F.lit("GG"), F.lit(two.rv_anchor[8:]))).otherwise(two.rv_anchor)
    sense = F.concat(barcode, F.lit(FLANK), fw, first, F.lit(one.rv_anchor + FLANK + two.fw_anchor), second, rv, F.lit(FLANK))
    base = settle(events(spark, sf_dir), {"sense": sense})
    n, anti = F.length("sense"), e % 9 == 0
    level = F.when(e % 25 == 1, "$").when(e % 16 == 6, "/").otherwise("I")
    qual = F.concat(F.repeat(F.lit("I"), F.lit(43)), F.repeat(level, F.lit(3)), F.repeat(F.lit("I"), F.lit(300))).substr(F.lit(1), n)
    qual = F.when(e % 25 == 1, F.repeat(F.lit("$"), n)).otherwise(qual)
    s = F.when(anti, reverse_complement(F.col("sense"))).otherwise(F.col("sense"))
    seq = F.when(e % 61 == 1, F.concat(F.lit("X"), F.substring(s, 2, 400))).otherwise(s)
    return settle(base, {"seq": seq, "qual": F.when(anti, F.reverse(qual)).otherwise(qual)}).select(
        (e % 3).cast("int").alias("source_id"), e.alias("ordinal"), F.concat(F.lit("@n"), e.cast("string")).alias("header"),
        "seq", F.lit("+").alias("sep"), "qual",
    )


def _reference(length: int = 300, state: int = 0x5EED1234) -> str:
    """Sense codons from a linear congruential sequence."""
    sense = [c for c in CODONS if c not in STOPS]
    out = []
    for _ in range(length // 3):
        state = (1664525 * state + 1013904223) % 2**32
        out.append(sense[state % len(sense)])
    return "".join(out)


REFERENCE = _reference()
TARGET_SITES = [("T1", 61, 3), ("T2", 181, 3)]


def amplicon_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, ordinal, header, seq, sep, qual: full amplicons with two mutated codons and all kinds of damage."""
    e, u = F.col("event_id"), F.col("user_id")
    part = lambda a, b: F.lit(REFERENCE[a:b])
    one = F.when(e % 4 == 1, REFERENCE[60:63]).when((e % 3 == 2) & (e % 2 == 0), "TGG").otherwise(codon(u))
    two = F.when(e % 4 == 2, REFERENCE[180:183]).otherwise(codon(u * 5 + e % 2))
    near = F.when(e % 11 == 4, part(63, 110)).when(e % 13 == 5, F.concat(part(63, 90), F.lit("AC"), part(90, 120))).when(e % 17 == 6, F.concat(part(63, 80), part(81, 120))).otherwise(part(63, 120))
    whole = F.concat(part(0, 60), one, near, part(120, 180), two, part(183, 300))
    sense = F.when(e % 41 == 8, F.substring(whole, 1, 200)).when(e % 43 == 9, F.concat(whole, whole)).when(e % 47 == 3, F.concat(F.lit("GATTACA"), whole, F.lit("CCCTTT"))).otherwise(whole)
    base = settle(events(spark, sf_dir), {"sense": sense})
    n, anti = F.length("sense"), e % 9 == 0
    noisy = F.concat(F.repeat(F.lit("I"), F.lit(60)), F.repeat(F.lit("'"), F.lit(3)), F.repeat(F.lit("I"), F.lit(700))).substr(F.lit(1), n)
    qual = F.when(e % 31 == 3, F.repeat(F.lit("$"), n)).when(e % 16 == 6, noisy).otherwise(F.repeat(F.lit("I"), n))
    turned = settle(base, {"s": F.when(anti, reverse_complement(F.col("sense"))).otherwise(F.col("sense")), "q": F.when(anti, F.reverse(qual)).otherwise(qual)})
    name = F.when(e % 50 == 0, e + 30).otherwise(e)
    return turned.select(
        (e % 3).cast("int").alias("source_id"), e.alias("ordinal"), F.concat(F.lit("@t"), name.cast("string")).alias("header"),
        F.when(e % 53 == 10, F.concat(F.lit("X"), F.substring("s", 2, 700))).otherwise(F.col("s")).alias("seq"), F.lit("+").alias("sep"), F.col("q").alias("qual"),
    )
