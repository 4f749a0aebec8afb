"""Run configurations: designs of the three engines, locked configurations and small parsers."""

from __future__ import annotations

import json
import os
from dataclasses import asdict

from strandlake.operators.demux import Round, Settings, check_rounds
from strandlake.operators.targeted import Target, TargetedSettings, resolve_targets, to_protein

LOCKED_VERSIONS = {"cdna": (1, 2), "targeted": (1, 2, 3, 4)}


def read_fasta(text: str) -> str:
    """The one sequence of a FASTA text."""
    records = [block.split("\n", 1) for block in text.replace("\r", "").split(">") if block.strip()]
    if len(records) != 1:
        raise ValueError(f"expected one FASTA record, found {len(records)}")
    return "".join(records[0][1].split()) if len(records[0]) > 1 else ""


def load_reference(spec: dict, folder: str = ".") -> str:
    """Exactly one of sequence, fasta and crispressoJson."""
    given = [k for k in ("sequence", "fasta", "crispressoJson") if spec.get(k)]
    if len(given) != 1:
        raise ValueError("the reference is exactly one of sequence, fasta and crispressoJson")
    if given[0] == "sequence":
        return spec["sequence"]
    with open(os.path.join(folder, spec[given[0]]), encoding="utf-8") as f:
        text = f.read()
    if given[0] == "fasta":
        return read_fasta(text)
    found = json.loads(text)
    while isinstance(found, dict):
        found = next((found[k] for k in ("amplicon_seq", "reference", "sequence", "args", "running_info") if k in found), None)
    if not found:
        raise ValueError("no amplicon sequence in the JSON")
    return found


def load_targeted(path: str) -> dict:
    """The design of engine C: reference, targets, rounds with their files, settings and the baseline minimum."""
    import yaml

    with open(path, encoding="utf-8") as f:
        raw = yaml.safe_load(f)
    if raw.get("schemaVersion") != 1:
        raise ValueError("schemaVersion must be 1")
    folder = os.path.dirname(os.path.abspath(path))
    reference, targets = resolve_targets(load_reference(raw["reference"], folder), [(s["name"], int(s["ntStart"]), int(s.get("length", 3))) for s in raw["sites"]])
    rounds = [(r["name"], [os.path.join(folder, f) for f in ([r["fastq"]] if isinstance(r["fastq"], str) else r["fastq"])]) for r in raw["rounds"]]
    if [n for n, _ in rounds] != [f"Round {i}" for i in range(len(rounds))]:
        raise ValueError("rounds are named Round 0, Round 1, ... in order")
    qc = raw.get("qc") or {}
    names = {"minReadQ": "min_read_q", "minTargetBaseQ": "min_base_q", "minReferenceCoverage": "min_coverage", "minAlignmentIdentity": "min_identity", "minProtectedIdentity": "min_protected_identity", "maxProtectedIndelBases": "max_protected_indels", "rescueFlankBases": "rescue_flank"}
    settings = TargetedSettings(**({"max_protected_indels": 0} | {names[k]: v for k, v in qc.items() if k in names}))
    return {"reference": reference, "targets": targets, "rounds": rounds, "settings": settings, "min_baseline": int(qc.get("minRound0CountToScore", 10))}


def load_cdna(path: str) -> tuple[list[Round], Settings, float]:
    """Rounds, settings and pseudocount of engine A from YAML."""
    import yaml

    with open(path, encoding="utf-8") as f:
        raw = yaml.safe_load(f)
    rounds = [Round(n, r["fw_primer"], r["rv_primer"], int(r["cds_start"]), int(r["cds_end"])) for n, r in raw["rounds"].items()]
    check_rounds(rounds)
    s = raw.get("settings") or {}
    return rounds, Settings(adaptive=bool(s.get("adaptive", True)), filter_stop=bool(s.get("filter_stop", True))), float(s.get("pseudocount", 0.5))


def bind_sources(bindings: list[int] | None, sources: int, rounds: int) -> dict[int, int] | None:
    """Source to round; one binding per source, each a round, every round bound."""
    if bindings is None:
        return None
    if len(bindings) != sources or set(bindings) != set(range(rounds)):
        raise ValueError("each source needs a round, and each round a source")
    return dict(enumerate(bindings))


def lock_cdna(rounds: list[Round], settings: Settings, pseudocount: float) -> str:
    return json.dumps({"tool": "cdna", "schema_version": 2, "rounds": [asdict(r) for r in rounds], "settings": asdict(settings), "pseudocount": pseudocount}, sort_keys=True, indent=2)


def lock_targeted(reference: str, targets: list[Target], settings: TargetedSettings, min_baseline: int) -> str:
    return json.dumps({"tool": "targeted", "schema_version": 4, "reference": reference, "targets": [asdict(t) for t in targets], "settings": asdict(settings), "min_baseline": min_baseline}, sort_keys=True, indent=2)


def unlock(text: str) -> dict:
    """A locked configuration of any known version, as the latest one; older ones get the defaults of their time."""
    raw = json.loads(text)
    known = LOCKED_VERSIONS.get(raw.get("tool"))
    if known is None or raw.get("schema_version") not in known:
        raise ValueError("not a locked configuration of a known version")
    version = raw["schema_version"]
    if raw["tool"] == "cdna":
        settings = Settings(**raw["settings"])
        return {"rounds": [Round(**r) for r in raw["rounds"]], "settings": settings, "pseudocount": raw.get("pseudocount", 1.0 if version < 2 else 0.5)}
    old = {"rescue_flank": 30} if version < 3 else {}
    settings = TargetedSettings(**(old | raw["settings"]))
    return {"reference": raw["reference"], "targets": [Target(**t) for t in raw["targets"]], "settings": settings, "min_baseline": raw.get("min_baseline", 10)}


def target_label(reference: str, start: int, cds_start: int = 1) -> str:
    """The amino acid and number of the codon at start (counted from 1), as in R233."""
    at = start - cds_start
    if at < 0 or at % 3:
        raise ValueError("the target doesn't start a codon")
    return f"{to_protein(reference[start - 1 : start + 2])}{at // 3 + 1}"


def parse_positions(text: str, cds_start: int = 1) -> list[int]:
    """First bases of the codons in a list such as "AA:21, nt:61 150": AA counts codons, a bare number too."""
    out = []
    for token in text.replace(",", " ").split():
        kind, _, number = token.rpartition(":")
        if not number.isdigit() or kind.lower() not in ("", "aa", "nt"):
            raise ValueError(f"{token}: expected AA:n, nt:n or n")
        out.append(int(number) if kind.lower() == "nt" else cds_start + 3 * (int(number) - 1))
    return out


def preview(head: str, rounds: list[Round]) -> list[dict]:
    """Where each round's parts lie on one read: a check of the design before a run."""
    out = []
    for r in rounds:
        at = head.upper().find(r.anchor)
        end = at + len(r.anchor)
        out.append({"round": r.name, "anchor_at": at, "cds": head[end + r.cds_start - 1 : end + r.cds_end] if at >= 0 else None, "rv_anchor_at": head.find(r.rv_anchor, end) if at >= 0 else -1})
    return out
