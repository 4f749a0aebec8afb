"""Checks of what users enter: names, primers, references, coding regions, input files and designs.

Checks return a list of complaints, empty if there are none; cleaners drop what isn't allowed.
"""

from __future__ import annotations

import os
import re
from collections import defaultdict
from collections.abc import Iterable

from strandlake.operators.ssm import Site
from strandlake.operators.targeted import resolve_targets

#: The limits of the inputs.
LONGEST = {"project": 100, "round": 50, "primer": 100, "reference": 50_000, "file": 255}
SHORTEST = {"primer": 10, "reference": 30, "anchor": 12}
CDS_RANGE = (-200, 10_000)
MOST_ROUNDS, MOST_FILES = 100, 1000
ALLOWED = {"project": r"[a-zA-Z0-9_.\- ]", "round": r"[A-Za-z0-9_]", "dna": r"[ACGTN]"}
FILE_ENDINGS = {"cdna": r"\.(fastq|fq)(\.gz)?", "targeted": r"\.(fastq|fq|fastqsanger)(\.gz)?"}


def clean(text: str, kind: str, longest: int | None = None) -> str:
    """Only the characters that a project name, a round name or DNA may have, at most as many as allowed."""
    text = text.upper() if kind == "dna" else text
    return "".join(re.findall(ALLOWED[kind], text))[: longest or LONGEST.get(kind)]


def check_name(text: str, kind: str) -> list[str]:
    text = text.strip() if kind == "project" else text
    if not text:
        return [f"a {kind} name is needed"]
    out = [f"the {kind} name has more than {LONGEST[kind]} characters"] if len(text) > LONGEST[kind] else []
    return out + ([] if re.fullmatch(f"{ALLOWED[kind]}+", text) else [f"{text!r} has characters that a {kind} name can't have"])


def check_dna(text: str, kind: str, label: str = "") -> list[str]:
    """A primer or a reference: letters and length."""
    label = label or kind
    if not text:
        return [f"{label}: a sequence is needed"]
    out = []
    if not SHORTEST[kind] <= len(text) <= LONGEST[kind]:
        out.append(f"{label}: {len(text)} bases, allowed are {SHORTEST[kind]} to {LONGEST[kind]}")
    return out + ([] if re.fullmatch("[ACGTN]+", text) else [f"{label}: only A, C, G, T and N are allowed"])


def check_cds(start, end) -> list[str]:
    """The coding region, counted from the end of the forward primer."""
    out = []
    for label, value in (("start", start), ("end", end)):
        if not isinstance(value, int) or isinstance(value, bool):
            out.append(f"CDS {label} must be a whole number")
        elif not CDS_RANGE[0] <= value <= CDS_RANGE[1]:
            out.append(f"CDS {label} must lie between {CDS_RANGE[0]} and {CDS_RANGE[1]}")
    if out:
        return out
    if end < start:
        return ["CDS end lies before its start"]
    return [] if (end - start + 1) % 3 == 0 else [f"a CDS of {end - start + 1} bases isn't divisible by 3"]


def check_rounds(rounds) -> list[str]:
    """All of engine A's rounds: names, primers and coding regions."""
    out = [] if 0 < len(rounds) <= MOST_ROUNDS else [f"between 1 and {MOST_ROUNDS} rounds are needed"]
    for r in rounds:
        found = [*check_name(r.name, "round"), *check_dna(r.fw_primer, "primer", "forward primer"), *check_dna(r.rv_primer, "primer", "reverse primer"), *check_cds(r.cds_start, r.cds_end)]
        out += [f"{r.name}: {x}" for x in found]
    return out


def check_file(path: str, size: int | None = None, tool: str = "cdna") -> list[str]:
    """The name and size of an input file; the size is looked up where the path is a local file."""
    name = os.path.basename(path)
    if size is None and os.path.exists(path):
        size = os.path.getsize(path)
    out = []
    if not 0 < len(name) <= LONGEST["file"] or re.search(r'[\x00-\x1f<>:"\\|?*]', name):
        out.append(f"{name!r} isn't a usable file name")
    if not re.search(f"{FILE_ENDINGS[tool]}$", name, re.I):
        out.append(f"{name}: not a FASTQ file by its name")
    if size is not None and size <= 0:
        out.append(f"{name}: the file is empty")
    return out


def repeated_inputs(paths: Iterable[str]) -> list[str]:
    """Inputs that are given more than once, by their real path."""
    times: dict[str, int] = defaultdict(int)
    for p in paths:
        times[p if "://" in p else os.path.realpath(p)] += 1
    return sorted(p for p, n in times.items() if n > 1)


def find_sites(reference: str, sites: Iterable[tuple[str, str, str]]) -> tuple[list[Site], list[str]]:
    """Engine B's sites (name, anchor before, anchor after) on the reference, and what is wrong with the design."""
    clean_reference = clean(reference, "dna", len(reference))
    out, wrong, taken = [], [], []
    if len(clean_reference) < SHORTEST["reference"]:
        return [], [f"the reference has fewer than {SHORTEST['reference']} bases"]
    for name, before, after in sites:
        fw, rv = ("".join(x.split()).upper() for x in (before, after))
        if min(len(fw), len(rv)) < SHORTEST["anchor"]:
            wrong.append(f"{name}: anchors need {SHORTEST['anchor']} bases")
            continue
        at = clean_reference.find(fw)
        end = at + len(fw)
        to = clean_reference.find(rv, end) if at >= 0 else -1
        if to < 0:
            wrong.append(f"{name}: the anchor {'before' if at < 0 else 'after'} the site isn't on the reference")
        elif to == end:
            wrong.append(f"{name}: no base lies between the anchors")
        else:
            out.append(Site(name, fw, rv, to - end, clean_reference[end:to]))
            taken.append((at, to + len(rv), name))
            if (to - end) % 3:
                wrong.append(f"{name}: {to - end} bases between the anchors aren't divisible by 3")
    taken.sort()
    wrong += [f"{a[2]} and {b[2]} overlap" for a, b in zip(taken, taken[1:], strict=False) if b[0] < a[1]]
    return out, wrong


def check_targeted(reference: str, sites: list[tuple[str, int, int]], cds_start: int, cds_end: int, most_sites: int = 100) -> list[str]:
    """Engine C's design: the reference, the coding region on it, and targets that are codons of it."""
    text = "".join(reference.split()).upper()
    out = check_dna(text, "reference")
    if len(sites) > most_sites:
        out.append(f"more than {most_sites} targets")
    if not 1 <= cds_start <= cds_end <= len(text):
        out.append("the CDS must lie on the reference")
    elif (cds_end - cds_start + 1) % 3:
        out.append("the length of the CDS isn't divisible by 3")
    try:
        resolve_targets(text, sites)
    except ValueError as e:
        out.append(str(e))
    return out + [f"{name}: not a codon of the CDS" for name, start, _ in sites if start < cds_start or start + 2 > cds_end or (start - cds_start) % 3]
