"""Engines B and C over every event of a small table; engine B against reads and calls made in plain Python."""

import re
from collections import Counter

import pytest

from strandlake.functions.seq import CODONS
from strandlake.plans.queries import QUERIES
from strandlake.sources import derive as D

EVENTS = [(e, e * 7919 % 1000) for e in range(36)]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("small")
    spark.createDataFrame(EVENTS, "event_id long, user_id long").write.parquet(f"{folder}/events.parquet")
    return str(folder)


def back(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def site_read(e, u):
    codon = lambda k: CODONS[k % 64]
    one, two = D.SITES
    code = D.SSM_BARCODES[e % 3]
    code = "T" + code[1:] if e % 19 == 4 else "GTGTGTGTGTGT" if e % 27 == 5 else code
    fw = one.fw_anchor
    fw = fw[:5] + "A" + fw[6:] if e % 13 == 3 else fw[:9] + fw[10:] if e % 17 == 5 else "AC" * 9 + "A" if e % 33 == 7 else fw
    first = one.wt_dna if e % 4 == 1 else "TGG" if e % 3 == 2 and e % 5 < 2 else codon(u)
    first += "A" * (e % 22 == 9)
    second = two.wt_dna if e % 4 == 2 else codon(u * 5 + e % 2)
    rv = two.rv_anchor[:8] + "GG" + two.rv_anchor[8:] if e % 47 == 11 else two.rv_anchor
    seq = code + D.FLANK + fw + first + one.rv_anchor + D.FLANK + two.fw_anchor + second + rv + D.FLANK
    n = len(seq)
    qual = "$" * n if e % 25 == 1 else ("I" * 43 + ("/" if e % 16 == 6 else "I") * 3 + "I" * 300)[:n]
    if e % 9 == 0:
        seq, qual = back(seq), qual[::-1]
    return ("X" + seq[1:] if e % 61 == 1 else seq), qual


def distance(a, b):
    row = range(len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        if min(new) > 3:
            return 4
        row = new
    return row[-1]


def match(needle, hay):
    if (at := hay.find(needle)) >= 0:
        return 0, at, at + len(needle)
    m = len(needle)
    found = [(d, s, n) for s in range(len(hay)) for n in (m - 1, m, m + 1) if s + n <= len(hay) and (d := distance(needle, hay[s : s + n])) <= 3]
    return (min(found)[0], min(found)[1], sum(min(found)[1:])) if found else None


def call(seq, qual):
    """The round and, for each site, its bucket and bases."""
    scores = sorted((hit[0], r) for r, code in enumerate(D.SSM_BARCODES) if (hit := match(code, seq[:100])))
    clear = scores and scores[0][0] <= 2 and (len(scores) == 1 or scores[1][0] > scores[0][0])
    calls = []
    for s in D.SITES:
        fw = match(s.fw_anchor, seq)
        rv = match(s.rv_anchor, seq[fw[2] :]) if fw else None
        if not rv:
            calls.append((None, None))
            continue
        roi, q = seq[fw[2] : fw[2] + rv[1]], [ord(c) - 33 for c in qual[fw[2] : fw[2] + rv[1]]]
        bucket = "discard_roi_indel" if len(roi) != 3 else "discard_low_q_roi" if sum(q) / 3 < 15 else "discard_stop_codon" if roi in ("TAA", "TAG", "TGA") else "passed_qc"
        calls.append((bucket, roi))
    return (scores[0][1] if clear else None), calls


@pytest.fixture(scope="module")
def brute():
    """Counts by site, haplotypes, and the funnel of attempts."""
    sites, haps, funnel = Counter(), Counter(), Counter()
    for seq, qual in (site_read(*x) for x in EVENTS):
        if not re.fullmatch("[ACGTN]+", seq):
            funnel["malformed_fastq"] += 1
            continue
        if sum(map(ord, qual)) / len(qual) - 33 < 10:
            funnel["low_quality_read"] += 1
            continue
        for s, q in ((seq, qual), (back(seq), qual[::-1])):
            r, calls = call(s, q)
            passed = [(site.name, dna) for site, (bucket, dna) in zip(D.SITES, calls, strict=True) if bucket == "passed_qc"]
            if r is None:
                funnel["barcode_mismatch"] += 1
                continue
            funnel["no_site_extracted"] += not passed
            sites.update((f"Round_{r}", *x) for x in passed)
            if len(passed) == 2:
                haps[f"Round_{r}", "_".join(dna for _, dna in passed)] += 1
            if passed:
                break
    return sites, haps, funnel


def test_every_event_is_a_site_read(spark, small):
    got = {r.ordinal: (r.seq, r.qual) for r in D.site_reads(spark, small).collect()}
    assert got == {e: site_read(e, u) for e, u in EVENTS}


def test_site_counts_of_all_events(spark, small, brute):
    assert {(r.round, r.site, r.dna): r.n for r in QUERIES["ssm_site_counts"](spark, small).collect()} == brute[0]


def test_haplotypes_of_all_events(spark, small, brute):
    assert {(r.round, r.dna): r.n for r in QUERIES["ssm_haplotypes"](spark, small).collect()} == brute[1]


def test_attempts_of_all_events(spark, small, brute):
    got = QUERIES["ssm_attempt_funnel"](spark, small).first().asDict()
    assert got == {k: brute[2][k] for k in got} and sum(got.values()) > 0


def test_every_event_is_aligned_and_counted(spark, small):
    reads = D.amplicon_reads(spark, small).collect()
    assert sorted(r.ordinal for r in reads) == [e for e, _ in EVENTS]
    assert sorted(r.ordinal for r in QUERIES["targeted_align"](spark, small).collect()) == [e for e, _ in EVENTS]
    assert sum(r.total_reads for r in QUERIES["targeted_funnel"](spark, small).collect()) == len(EVENTS)


def test_every_read_is_matched(spark, small):
    got = {r.ordinal: r.score is not None and (r.score, r.start, r.end) for r in QUERIES["banded_match"](spark, small).collect()}
    assert got == {e: match(D.SITES[0].fw_anchor, site_read(e, u)[0]) or False for e, u in EVENTS}
