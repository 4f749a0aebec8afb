"""Sequence and quality expressions. All are plain Columns, so they stay in code generation."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The standard genetic code, codons in T, C, A, G order.
BASES = "TCAG"
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = tuple("".join(c) for c in product(BASES, repeat=3))
STOPS = ("TAA", "TAG", "TGA")


def reverse_complement(seq: Column) -> Column:
    """Other letters than A, C, G, T stay as they are."""
    return F.reverse(F.translate(seq, "ATCG", "TAGC"))


def codons(seq: Column, whole: bool = False) -> Column:
    """The codons of seq; the last one may be short unless whole."""
    n = F.length(seq)
    stop = n - (n % 3) if whole else n
    return F.when(stop > 0, F.transform(F.sequence(F.lit(1), stop, F.lit(3)), lambda i: F.substr(seq, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def translate(seq: Column, length: int | None = None) -> Column:
    """One letter per codon; short or unknown codons give X, the empty sequence gives ''.

    If all sequences have one known length, the expression is unrolled and needs no lambda."""
    table = F.expr("map(" + ", ".join(f"'{c}', '{a}'" for c, a in zip(CODONS, AMINO_ACIDS, strict=True)) + ")")
    letter = lambda c: F.coalesce(F.try_element_at(table, c), F.lit("X"))
    if length is not None:
        return F.concat(*[letter(F.substring(seq, i, 3)) for i in range(1, length + 1, 3)])
    return F.array_join(F.transform(codons(seq), letter), "")


def gc_percent(seq: Column) -> Column:
    """N counts as a base; 0 for the empty sequence."""
    n = F.length(seq)
    return F.when(n > 0, 100.0 * (n - F.length(F.translate(seq, "GC", ""))) / n).otherwise(F.lit(0.0))


def has_no_stop(seq: Column) -> Column:
    """No whole codon in frame is a stop codon."""
    return ~F.exists(codons(seq, whole=True), lambda c: c.isin(*STOPS))


def mean_phred(qual: Column) -> Column:
    """Mean Phred+33 quality; 0 for the empty string."""
    n = F.length(qual)
    total = F.aggregate(F.split(qual, ""), F.lit(0), lambda a, c: a + F.when(c == "", 0).otherwise(F.ascii(c) - 33))
    return F.when(n > 0, total / n).otherwise(F.lit(0.0))


def dorado_header_q(header: Column) -> Column:
    """The read quality that the basecaller wrote in the header (qs:f:), else NULL."""
    return F.regexp_extract(header, r"(?:^|\s)qs:f:([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)(?=\s|$)", 1).try_cast("double")


def dorado_mean_q(qual: Column) -> Column:
    """-10 log10 of the mean error probability, without the first 60 bases of longer reads."""
    part = F.when(F.length(qual) > 60, F.substr(qual, F.lit(61))).otherwise(qual)
    n = F.length(part)
    error = F.aggregate(F.split(part, ""), F.lit(0.0), lambda a, c: a + F.when(c == "", 0.0).otherwise(F.pow(F.lit(10.0), -F.greatest(F.ascii(c) - 33, F.lit(0)) / 10.0)))
    return F.when(n > 0, F.when(error > 0, -10.0 * F.log10(error / n)).otherwise(F.lit(float("inf")))).otherwise(F.lit(0.0))


def dorado_read_q(header: Column, qual: Column) -> Column:
    """effective (header, else recalculated), header, recalculated, delta and source."""
    head, own = dorado_header_q(header), dorado_mean_q(qual)
    return F.struct(
        F.coalesce(head, own).alias("effective"), head.alias("header"), own.alias("recalculated"), (head - own).alias("delta"),
        F.when(head.isNotNull(), "header").otherwise("recalculated").alias("source"),
    )


def read_id(header: Column) -> Column:
    """The first word of the header, without @."""
    return F.element_at(F.split(F.regexp_replace(header, "^@", ""), r"\s", 2), 1)


def find(needle: Column, hay: Column, start: Column | int = 0) -> Column:
    """0-based place of needle in hay at or after start, -1 if there is none."""
    return F.call_function("locate", needle, hay, (F.lit(start) if isinstance(start, int) else start) + 1) - 1


def edit_distance(a: Column, b: Column, limit: int) -> Column:
    """Levenshtein distance, -1 above limit."""
    return F.call_function("levenshtein", a, b, F.lit(limit))


def barcode_penalty(padded: str, barcode: str) -> Column:
    """Penalty of a read's barcode, in a column padded on the left with '-': 1 for a missing or wrong base, 0.5
    for N. Written as one expression, which saves a call to the planner for each base."""
    at = [f"(CASE substring({padded}, {j}, 1) WHEN 'N' THEN 0.5D WHEN '{c}' THEN 0.0D ELSE 1.0D END)" for j, c in enumerate(barcode, 1)]
    return F.expr(" + ".join(at) or "0.0D")


def is_valid_record(header: Column, seq: Column, sep: Column, qual: Column) -> Column:
    """A FASTQ record with a named header, a separator, bases ACGTN and as many printable qualities."""
    whole = header.rlike("^@.") & sep.startswith("+") & seq.rlike("^[ACGTNacgtn]+$") & qual.rlike("^[!-~]+$") & (F.length(seq) == F.length(qual))
    return F.coalesce(whole, F.lit(False))


def mutation_label(name: Column, aa: Column) -> Column:
    """R233 with W gives R233W; another name gives name:W."""
    return F.when(name.rlike(r"^[A-Za-z*][0-9]+$"), F.concat(name, aa)).otherwise(F.concat(name, F.lit(":"), aa))
