import csv
import json

from strandlake import cli
from strandlake.sources.derive import REFERENCE


def write(path, reads):
    path.write_text("".join(f"@{n} qs:f:30.0\n{s}\n+\n{'I' * len(s)}\n" for n, s in reads))


def test_a_design_from_file_to_matrix(tmp_path, capsys, spark):
    wild = REFERENCE
    mutant = wild[:60] + "TGG" + wild[63:180] + "CTG" + wild[183:]
    back = mutant[::-1].translate(str.maketrans("ACGT", "TGCA"))
    for k, n in enumerate((2, 6, 14)):
        reads = [(f"w{i}", wild) for i in range(20)] + [(f"m{i}", mutant if i % 2 else back) for i in range(n)] + [("w0", wild), ("long", wild * 2), ("part", wild[:150])]
        write(tmp_path / f"r{k}.fastq", reads[: len(reads) // 2])
        write(tmp_path / f"r{k}b.fastq", reads[len(reads) // 2 :])
    rounds = "\n".join(f"  - {{name: Round {k}, role: selection, fastq: [r{k}.fastq, r{k}b.fastq]}}" for k in range(3))
    (tmp_path / "design.yaml").write_text(
        f"schemaVersion: 1\nreference:\n  sequence: {wild}\nsites:\n  - {{name: A, ntStart: 61}}\n  - {{name: B, ntStart: 181, length: 3}}\nrounds:\n{rounds}\nqc: {{minRound0CountToScore: 1}}\n"
    )
    design = str(tmp_path / "design.yaml")
    said = {}
    for verb in ("validate", "q-audit", "benchmark", "parity", "analyze"):
        assert cli.main([verb, "--config", design, "--out", str(tmp_path / "out")]) == 0
        said[verb] = json.loads(capsys.readouterr().out)
    assert said["validate"]["referenceLength"] == 300 and [s["wtDna"] for s in said["validate"]["sites"]] == [wild[60:63], wild[180:183]]
    assert said["q-audit"]["header"]["Round 1"]["q_50"] == 30.0
    assert said["parity"]["equal"] and said["benchmark"]["reads"] == 60 + 22 + 9
    total = {k: sum(f[k] for f in said["analyze"]["files"]) for k in ("total_reads", "full_qc_passed", "duplicate_read_id", "concatemer_or_chimera", "partial_reference")}
    assert total == {"total_reads": 91, "full_qc_passed": 82, "duplicate_read_id": 3, "concatemer_or_chimera": 3, "partial_reference": 3}
    with open(tmp_path / "out" / "Exact_Combinations.csv", encoding="utf-8") as f:
        rows = {r["dna"]: r for r in csv.DictReader(f)}
    assert [rows["TGG|CTG"][f"Count_Round {k}"] for k in range(3)] == ["2", "6", "14"]
    with open(tmp_path / "out" / "Per_Target_Matrix.csv", encoding="utf-8") as f:
        matrix = {(r["Target"], r["Variant_AA"]): r for r in csv.DictReader(f)}
    assert float(matrix["A", "W"]["Enrichment_Round 2_vs_Round 0"]) > 0 and matrix["A", "W"]["Score_Eligible"] == "True"
    assert json.loads((tmp_path / "out" / "run_stats.json").read_text())["schema_version"] == 3
