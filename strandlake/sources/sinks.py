"""Results as files: CSV with pandas' formatting, run statistics as JSON, QC reports, methods and provenance."""

from __future__ import annotations

import gzip
import hashlib
import json
import math
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators.demux import UNASSIGNED

CHUNK = 4 << 20


def cell(value) -> str:
    """None and NaN are blank, whole floats keep .0, infinities are inf and -inf, booleans True and False; text is
    quoted only where it has to be."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "" if math.isnan(value) else repr(value) if math.isfinite(value) else ("inf" if value > 0 else "-inf")
    text = str(value)
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in ',"\n\r') else text


def csv_chunks(columns: list[str], rows: Iterable, size: int = CHUNK) -> Iterator[str]:
    """Text of whole lines of at least size characters each (but the last); put together they are the file."""
    held, length = [",".join(map(cell, columns)) + "\n"], 0
    for row in rows:
        held.append(",".join(map(cell, row)) + "\n")
        length += len(held[-1])
        if length >= size:
            yield "".join(held)
            held, length = [], 0
    if held:
        yield "".join(held)


def write_csv(df: DataFrame, path: str, compress: bool = False) -> None:
    """One ordered file for download. Rows come to the driver partition by partition, never all at once."""
    opener = gzip.open if compress else open
    with opener(path, "wt", encoding="utf-8", newline="") as f:
        for chunk in csv_chunks(df.columns, df.toLocalIterator(prefetchPartitions=True)):
            f.write(chunk)


def format_csv(df: DataFrame) -> DataFrame:
    """The same lines as a column, for matrices too large for one file: doubles and booleans formatted natively."""
    def text(name: str, kind: str):
        c = F.col(f"`{name}`")
        if kind == "double":
            inf = F.lit(float("inf"))
            shown = F.when(c == inf, "inf").when(c == -inf, "-inf").otherwise(c.cast("string"))
            return F.when(c.isNull() | F.isnan(c), "").otherwise(shown)
        if kind == "boolean":
            return F.when(c.isNull(), "").when(c, "True").otherwise("False")
        s = F.coalesce(c.cast("string"), F.lit(""))
        return F.when(s.rlike('[,"\\n\\r]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)

    return df.select(F.concat_ws(",", *[text(n, k) for n, k in df.dtypes]).alias("value"))


def write_csv_folder(df: DataFrame, path: str, compress: bool = False) -> None:
    """Ordered part files of formatted lines, written by the executors; the header is a file name's worth of config."""
    writer = format_csv(df).write.mode("overwrite")
    (writer.option("compression", "gzip") if compress else writer).text(path)


def run_stats(funnel: DataFrame, rounds, unassigned, pseudocount: float, medians: dict[str, float] | None = None) -> str:
    """run_stats.json of engine A: keys sorted; malformed reads and medians only where there are any."""
    breakdown = {k: int(unassigned[k]) for k in UNASSIGNED}
    if not breakdown["malformed_fastq"]:
        del breakdown["malformed_fastq"]
    seen = {r["round"]: r.asDict() for r in funnel.collect()}
    empty = dict.fromkeys(funnel.columns[1:], 0)
    payload = {
        "schema_version": 2,
        "global_unassigned": int(unassigned["global_unassigned"]),
        "unassigned_breakdown": breakdown,
        "rounds": {r: {k: int(v) for k, v in (seen.get(r) or empty).items() if k != "round"} for r in rounds},
        "statistical_model": {
            "enrichment": "log2((RPM_destination + p_RPM) / (RPM_source + p_RPM))", "pseudocount": pseudocount, "pseudocount_unit": "RPM",
            "variance": "Enrich2-style four-term Poisson delta method with p_RPM converted per library to p_RPM * passed_qc / 1e6 reads",
        },
    }
    if medians:
        payload["library_median_enrich"] = medians
    return json.dumps(payload, sort_keys=True, indent=2)


def targeted_run_stats(settings, funnel: DataFrame, site_funnel: DataFrame, codons: DataFrame, combinations: DataFrame) -> str:
    """run_stats.json of engine C: settings, funnels, callability and exact counts."""
    rows = lambda df: [r.asDict() for r in df.collect()]
    sites = rows(site_funnel)
    for s in sites:
        s["callability"] = s["passed_qc"] / max(1, s["passed_qc"] + s["low_quality"] + s["not_covered"] + s["ambiguous"] + s["target_indel"])
    payload = {
        "schema_version": 3, "settings": vars(settings), "files": rows(funnel), "sites": sites,
        "exact_codons": rows(codons), "exact_combinations": rows(combinations),
        "statistical_model": {"enrichment": "log2((RPM + p) / (RPM_first + p))", "pseudocount_unit": "RPM", "family": "target"},
    }
    return json.dumps(payload, sort_keys=True, indent=2)


def callability(states: list[dict], rounds, sites: list[str]) -> str:
    """callability.csv of engine C: for each round and target the states and the share of reads that are callable, in the
    order of the design; every cell quoted."""
    columns = ["round", "target", "callable", "callable_full", "callable_rescued", "low_quality", "not_covered", "ambiguous", "target_indel", "stop_codon", "callability"]
    seen = {(r["round_idx"], r["site"]): r for r in states}
    rows = []
    for k, name in enumerate(rounds):
        for site in sites:
            r = seen.get((k, site), {})
            lost = sum(r.get(c, 0) for c in ("low_quality", "not_covered", "ambiguous", "target_indel"))
            good = r.get("passed_qc", 0)
            rows.append({c: r.get(c, 0) for c in columns[3:10]} | {"round": name, "target": site, "callable": good, "callability": f"{good / max(1, good + lost):.6f}"})
    return quoted_csv(columns, rows)


def qc_report(title: str, rounds: list[dict], unassigned: dict | None = None, warnings: Iterable[str] = ()) -> str:
    """A plain-text report: per round its buckets with their shares, then the unassigned and warnings."""
    out = [title, "=" * len(title), ""]
    for r in rounds:
        total = max(1, sum(v for k, v in r.items() if k not in ("round", "total_assigned") and isinstance(v, int)))
        out.append(str(r.get("round", r.get("source_id"))))
        out += [f"  {k:<28}{v:>12,}  {100 * v / total:6.2f} %" for k, v in r.items() if isinstance(v, int) and k not in ("round", "source_id")]
        out.append("")
    if unassigned:
        out += ["Unassigned", *[f"  {k:<28}{v:>12,}" for k, v in unassigned.items()], ""]
    out += [f"WARNING: {w}" for w in warnings]
    return "\n".join(out).rstrip() + "\n"


def median_warnings(medians: dict[str, float]) -> list[str]:
    return [f"library median of {k} is {v:.3f}: depth or dropout may have shifted the whole library" for k, v in medians.items() if abs(v) > 1]


def quoted_csv(columns: list[str], rows: Iterable[dict]) -> str:
    """Funnel tables: every cell quoted."""
    quote = lambda v: '"' + str("" if v is None else v).replace('"', '""') + '"'
    return "".join(",".join(map(quote, line)) + "\n" for line in (columns, *([r.get(c) for c in columns] for r in rows)))


METHODS = {
    "cdna": (
        "Short-read cDNA display", ["Reads with a mean quality below {min_read_q} are dropped; the others are uppercased and searched for each round's anchor on both strands.",
        "The barcode before the anchor is scored (mismatch or missing base 1, N 0.5); a read belongs to the best round if that scores at most 1 and beats the next by 1.",
        "The coding region is cut by its place after the forward primer and kept if it is complete, in frame, of mean quality {min_cds_q} and without stop codons.",
        "Variants are counted by DNA and summed by peptide; the DNA with most reads is dominant, the alphabetically first of equals."]),
    "ssm": (
        "Dual-anchor nanopore sites", ["Sites are found between two anchors with an edit budget of {max_subs} + {max_indels}; reads without a site are tried on the other strand, and both attempts count in the funnel.",
        "Sites of another length than designed, low mean quality or with stop codons are discarded; scores are ratios to the wild-type DNA."]),
    "targeted": (
        "Targeted full-amplicon nanopore", ["Reads are aligned in full (match 2, mismatch -3, gap 5 and 1) within a band around their k-mer diagonal that widens where needed.",
        "Targets are masked from quality control; a read that fails may still give a target whose flanks of {rescue_flank} bases are good.",
        "Rows with fewer than {min_baseline} reads in the first round are reported without a test."]),
}
STATISTICS = (
    "Scores are log2 ratios of reads per million with a pseudocount of {pseudocount} RPM; their variance is the Poisson delta method's.",
    "Z is the score over its standard error, p two-sided normal, q Benjamini-Hochberg within the family; centred scores subtract the family's median.",
)


def methods_text(engine: str, **parameters) -> str:
    """The methods of a run, with its parameters filled in."""
    title, steps = METHODS[engine]
    known = {"pseudocount": 0.5, "min_read_q": 20, "min_cds_q": 20, "max_subs": 2, "max_indels": 1, "rescue_flank": 30, "min_baseline": 10} | parameters
    lines = [f"{i}. {s.format(**known)}" for i, s in enumerate([*steps, *STATISTICS], 1)]
    return "\n".join([title, "-" * len(title), *lines]) + "\n"


def provenance(descriptors: list[dict], reference: str | None = None) -> dict:
    """SHA-256 of the inputs' descriptions, in order, and of the reference."""
    text = json.dumps(descriptors, sort_keys=True, separators=(",", ":"))
    out = {"inputs_sha256": hashlib.sha256(text.encode()).hexdigest(), "inputs": descriptors}
    return out | ({"reference_sha256": hashlib.sha256(reference.encode()).hexdigest()} if reference else {})


def read_matrix(spark, path: str) -> tuple[DataFrame, list[str]]:
    """A written matrix again, and its rounds as its header names them."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    rounds = [c.removeprefix("Count_") for c in df.columns if c.startswith("Count_")]
    numbers = [c for c in df.columns if c.startswith(("Count_", "RPM_", "Enrich", "Centered_", "Z_", "Pval_", "FDR_", "Var_", "Fitness"))]
    typed = {c: F.expr(f"try_cast(replace(`{c}`, 'inf', 'Infinity') AS DOUBLE)") for c in numbers}
    typed |= {f"Count_{r}": F.expr(f"try_cast(try_cast(`Count_{r}` AS DOUBLE) AS BIGINT)") for r in rounds}
    return df.withColumns(typed), rounds
