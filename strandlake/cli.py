"""Command line for targeted runs: validate, q-audit, benchmark, analyze and parity.

    python -m strandlake.cli VERB --config design.yaml [--limit N] [--out FOLDER]
"""

from __future__ import annotations

import argparse
import json
import sys
import time

import numpy as np


def _reads(spark, config, limit: int | None):
    """The reads of all rounds in their locked order, and the binding of sources to rounds."""
    from strandlake.sources.fastq import FastqDataSource

    files = [(f, k) for k, (_, paths) in enumerate(config["rounds"]) for f in paths]
    spark.dataSource.register(FastqDataSource)
    reader = spark.read.format("fastq").option("paths", json.dumps([f for f, _ in files]))
    if limit:
        reader = reader.option("maxReadsPerSource", limit)
    return reader.load(), {i: k for i, (_, k) in enumerate(files)}


def validate(config, **_) -> dict:
    sites = [{"name": t.name, "ntStart": t.start + 1, "length": t.end - t.start, "wtDna": t.wt_dna, "wtAa": t.wt_aa} for t in config["targets"]]
    return {"status": "valid", "referenceLength": len(config["reference"]), "sites": sites, "rounds": [n for n, _ in config["rounds"]], "qc": vars(config["settings"])}


def q_audit(config, spark, limit, **_) -> dict:
    """Quartiles of header and recalculated read quality for each round."""
    from pyspark.sql import functions as F

    from strandlake.functions.seq import dorado_read_q
    from strandlake.operators.dashboard import quantiles

    reads, bindings = _reads(spark, config, limit)
    rounds = F.create_map(*[F.lit(x) for p in bindings.items() for x in p])
    q = reads.select(F.try_element_at(rounds, F.col("source_id")).alias("round"), dorado_read_q(F.col("header"), F.col("qual")).alias("q")).select("round", "q.*")
    names = [n for n, _ in config["rounds"]]
    return {c: {names[r["round"]]: {k: v for k, v in r.asDict().items() if k != "round"} for r in quantiles(q.filter(F.col(c).isNotNull()), ["round"], c).collect()} for c in ("header", "recalculated", "delta")}


def benchmark(config, limit, **_) -> dict:
    """Speed and outcome of aligning the first reads of each file on this machine, sense first: the antisense
    strand is only tried if the sense one misses coverage or identity, and equal scores stay sense."""
    from strandlake.operators import align as A
    from strandlake.sources.fastq import read_file

    ref, s = A.Reference(np.frombuffer(config["reference"].encode(), np.uint8)), config["settings"]
    flip, began = bytes.maketrans(b"ACGT", b"TGCA"), time.time()
    total = good = anti = 0
    for _, paths in config["rounds"]:
        for path in paths:
            seqs = [r[2].upper().encode() for r in read_file(path, "strict", limit) if r[2]]
            fits = lambda a: a is not None and a.coverage >= s.min_coverage and a.identity >= s.min_identity
            sides = []
            for reads in (seqs, [x.translate(flip)[::-1] for x in seqs]):
                arrays = [np.frombuffer(x, np.uint8) for x in reads]
                sides.append(A.align(ref.seq, arrays, [ref.estimate(x) for x in arrays]))
            for sense, other in zip(*sides, strict=True):
                best = sense if fits(sense) or other is None or (sense is not None and sense.score >= other.score) else other
                total, good, anti = total + 1, good + fits(best), anti + (best is other and best is not sense)
    seconds = time.time() - began
    return {"reads": total, "fitting": good, "antisense": anti, "seconds": round(seconds, 3), "reads_per_second": round(total / max(seconds, 1e-9), 1)}


def analyze(config, spark, limit, out, **_) -> dict:
    from strandlake.plans.runs import run_targeted

    reads, bindings = _reads(spark, config, limit)
    return run_targeted(reads, config["reference"], config["targets"], [n for n, _ in config["rounds"]], bindings, out, config["settings"], config["min_baseline"])


def parity(config, limit, **_) -> dict:
    """Whether aligning reads one by one and in batches gives the same alignments."""
    from strandlake.operators import align as A
    from strandlake.sources.fastq import read_file

    ref, different, total = A.Reference(np.frombuffer(config["reference"].encode(), np.uint8)), 0, 0
    for _, paths in config["rounds"]:
        for path in paths:
            arrays = [np.frombuffer(r[2].upper().encode(), np.uint8) for r in read_file(path, "strict", limit) if r[2]]
            guesses = [ref.estimate(x) for x in arrays]
            for x, g, together in zip(arrays, guesses, A.align(ref.seq, arrays, guesses), strict=True):
                (alone,) = A.align(ref.seq, [x], [g])
                total += 1
                different += (alone and (alone.score, alone.cigar)) != (together and (together.score, together.cigar))
    return {"reads": total, "different": different, "equal": different == 0}


VERBS = {"validate": validate, "q-audit": q_audit, "benchmark": benchmark, "analyze": analyze, "parity": parity}


def main(arguments: list[str] | None = None) -> int:
    from strandlake.sources.config import load_targeted

    parser = argparse.ArgumentParser(prog="strandlake")
    parser.add_argument("verb", choices=VERBS)
    parser.add_argument("--config", required=True)
    parser.add_argument("--limit", type=int, default=500)
    parser.add_argument("--out", default="out")
    given = parser.parse_args(arguments)
    if given.limit < 1:
        parser.error("--limit must be at least 1")
    spark = None
    if given.verb in ("q-audit", "analyze"):
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.getOrCreate()
    print(json.dumps(VERBS[given.verb](load_targeted(given.config), spark=spark, limit=given.limit, out=given.out), indent=2, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
