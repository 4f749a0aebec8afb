import pytest

from strandlake.operators.demux import Round
from strandlake.sources import validate as V

GOOD = Round("R_0", "ACGTTGCAAGCTTC", "GCATCGATCGATCG", 1, 9)
REFERENCE = "GATTACAGATCCGCAACTGGCTAGAATTCCGGCTGGAAGCTAGCGAATTCAATGATTACA"


def test_cleaning_is_idempotent():
    assert V.clean(" a/c b-1.2_?", "project") == " ac b-1.2_" and V.clean("Round 1!", "round") == "Round1"
    assert V.clean("acgtnxz-", "dna", 4) == "ACGT" and V.clean(V.clean("x" * 200, "project"), "project") == "x" * 100


@pytest.mark.parametrize(("text", "kind", "ok"), [("a b.c", "project", True), ("  ", "project", False), ("R_1", "round", True), ("R 1", "round", False), ("x" * 51, "round", False), ("x" * 101, "project", False)])
def test_names(text, kind, ok):
    assert (V.check_name(text, kind) == []) == ok


@pytest.mark.parametrize(("text", "kind", "ok"), [("A" * 10, "primer", True), ("A" * 9, "primer", False), ("A" * 101, "primer", False), ("A" * 12 + "X", "primer", False), ("A" * 29, "reference", False), ("A" * 50_001, "reference", False), ("", "reference", False)])
def test_sequences(text, kind, ok):
    assert (V.check_dna(text, kind) == []) == ok


def test_coding_regions():
    assert V.check_cds(1, 9) == [] and V.check_cds(-200, -198) == []
    assert V.check_cds(9, 1) and V.check_cds(1, 8) and V.check_cds(None, 3) and V.check_cds(1.5, 3) and V.check_cds(-201, 0) and V.check_cds(1, 10_002)


def test_rounds():
    assert V.check_rounds([GOOD]) == [] and V.check_rounds([])
    bad = V.check_rounds([Round("R 0", "ACGT", "GCATCGATCGATCG", 1, 8)])
    assert len(bad) == 3 and all(x.startswith("R 0: ") for x in bad)


def test_files(tmp_path):
    empty, good = tmp_path / "a.fastq", tmp_path / "b.fq.gz"
    empty.write_bytes(b"")
    good.write_bytes(b"x")
    assert V.check_file(str(good)) == [] and V.check_file(str(empty)) and V.check_file("c.bam") and V.check_file("a|b.fq")
    assert V.check_file("x.fastqsanger", 5, "targeted") == [] and V.check_file("x.fastqsanger", 5) != []
    assert V.repeated_inputs([str(good), f"{tmp_path}/./b.fq.gz", str(empty), "s3://a/b.fq"]) == [str(good)]


def test_sites_on_the_reference():
    sites, wrong = V.find_sites(REFERENCE, [("S", "GCAACTGGCTAGAATTCCG", "GGAAGCTAGCGAATTCAAT")])
    assert wrong == [] and sites[0].wt_dna == "GCT" and sites[0].roi_len == 3
    assert V.find_sites("ACGT", [])[1] and V.find_sites(REFERENCE, [("S", "ACGT", "GGAAGCTAGCGAATTCAAT")])[1]
    assert "before" in V.find_sites(REFERENCE, [("S", "T" * 12, "GGAAGCTAGCGAATTCAAT")])[1][0]
    assert "after" in V.find_sites(REFERENCE, [("S", "GCAACTGGCTAGAATTCCG", "GATTACAGATCCG")])[1][0]
    both = V.find_sites(REFERENCE, [("S", "GCAACTGGCTAGAATTCCG", "GGAAGCTAGCGAATTCAAT"), ("T", "GCAACTGGCTAG", "GGAAGCTAGCGA")])[1]
    assert any("overlap" in x for x in both) and any("divisible" in x for x in both)


def test_targeted_designs():
    assert V.check_targeted(REFERENCE, [("T", 7, 3)], 1, 57) == []
    wrong = V.check_targeted(REFERENCE, [("T", 8, 3), ("T", 58, 9)], 1, 58)
    assert any("divisible" in x for x in wrong) and any("codon" in x for x in wrong)
    assert V.check_targeted("ACGT", [], 1, 3)
