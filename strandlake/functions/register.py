"""Sequence functions, the FASTQ source and the alignment events for plain SQL.

The functions are SQL expressions, so the planner inlines them and code generation compiles them.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from strandlake.functions.seq import AMINO_ACIDS, CODONS

_CODE = "map(" + ", ".join(f"'{c}', '{a}'" for c, a in zip(CODONS, AMINO_ACIDS, strict=True)) + ")"
_PHRED = "(ascii(substring({q}, i, 1)) - 33)"

#: name -> (parameters, type, body)
FUNCTIONS = {
    "reverse_complement": ("seq STRING", "STRING", "reverse(translate(seq, 'ATCG', 'TAGC'))"),
    "gc_percent": ("seq STRING", "DOUBLE", "CASE WHEN length(seq) > 0 THEN 100D * (length(seq) - length(replace(replace(seq, 'G', ''), 'C', ''))) / length(seq) ELSE 0D END"),
    "translate_dna": ("dna STRING", "STRING", f"CASE WHEN length(dna) > 0 THEN array_join(transform(sequence(1, length(dna), 3), i -> coalesce(try_element_at({_CODE}, substring(dna, i, 3)), 'X')), '') ELSE '' END"),
    "has_no_stop": ("dna STRING", "BOOLEAN", "CASE WHEN length(dna) >= 3 THEN NOT exists(sequence(1, length(dna) - 2, 3), i -> substring(dna, i, 3) IN ('TAA', 'TAG', 'TGA')) ELSE true END"),
    "mean_phred": ("qual STRING", "DOUBLE", f"CASE WHEN length(qual) > 0 THEN aggregate(sequence(1, length(qual)), 0D, (s, i) -> s + {_PHRED.format(q='qual')}) / length(qual) ELSE 0D END"),
    "rpm": ("n DOUBLE, total DOUBLE", "DOUBLE", "CASE WHEN total > 0 THEN n / total * 1000000D ELSE 0D END"),
    "log2_rpm_ratio": ("n DOUBLE, total DOUBLE, n0 DOUBLE, total0 DOUBLE, p DOUBLE", "DOUBLE", "log2(((CASE WHEN total > 0 THEN n / total * 1000000D ELSE 0D END) + p) / ((CASE WHEN total0 > 0 THEN n0 / total0 * 1000000D ELSE 0D END) + p))"),
    "mutation_label": ("site STRING, aa STRING", "STRING", "CASE WHEN site RLIKE '^[A-Za-z*][0-9]+$' THEN concat(site, aa) ELSE concat(site, ':', aa) END"),
}


class AlignmentEvents:
    """A row per difference of an alignment: type, ref_pos, read_pos, ref, alt. A run of inserted or deleted bases is
    one event, mismatches are one each. A null argument gives no rows."""

    def eval(self, cigar: str, read_start: int, reference: str, read: str):
        import re

        if cigar is None or read_start is None or reference is None or read is None:
            return
        i, j = 0, read_start
        for number, op in re.findall(r"(\d+)([MXID])", cigar):
            n = int(number)
            if op == "X":
                for k in range(n):
                    yield "substitution", i + k, j + k, reference[i + k], read[j + k]
            elif op == "I":
                yield "insertion", i, j, "", read[j : j + n]
            elif op == "D":
                yield "deletion", i, j, reference[i : i + n], ""
            i += n * (op != "I")
            j += n * (op != "D")


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Registers the functions, the table function alignment_events and the source fastq; their names."""
    from pyspark.sql.functions import udtf

    from strandlake.sources.fastq import FastqDataSource

    spark.dataSource.register(FastqDataSource)
    names = []
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {kind} RETURN {body}")
        names.append(prefix + name)
    spark.udtf.register(f"{prefix}alignment_events", udtf(AlignmentEvents, returnType="type string, ref_pos int, read_pos int, ref string, alt string"))
    return [*names, f"{prefix}alignment_events"]
