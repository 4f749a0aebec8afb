from strandlake.functions import seq as Q
from strandlake.functions.register import register
from pyspark.sql import functions as F


def test_sql_functions_agree_with_columns(spark):
    names = register(spark, "sl_")
    assert "sl_alignment_events" in names
    rows = [("ACGTNACGTA",), ("ATGTAANNNGC",), ("",), ("TTTGGGCCC",)]
    table = spark.createDataFrame(rows, "s string")
    table.createOrReplaceTempView("sl_rows")
    got = spark.sql("SELECT s, sl_reverse_complement(s) a, sl_gc_percent(s) b, sl_translate_dna(s) c, sl_has_no_stop(s) d, sl_mean_phred(s) e FROM sl_rows")
    s = F.col("s")
    want = table.select(s, Q.reverse_complement(s), Q.gc_percent(s), Q.translate(s), Q.has_no_stop(s), Q.mean_phred(s))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert spark.sql("SELECT sl_mutation_label('R233', 'W') a, sl_mutation_label('loop', 'W') b, sl_rpm(2, 4) c, sl_log2_rpm_ratio(1, 2, 1, 4, 0.5) d").first()[:3] == ("R233W", "loop:W", 500000.0)


def test_events_table_function(spark):
    register(spark, "sl_")
    rows = spark.sql("SELECT * FROM sl_alignment_events('2M1X2I2M1D1M', 3, 'ACGTTAC', 'zzzACTAATTC')").collect()
    assert [tuple(r) for r in rows] == [("substitution", 2, 5, "G", "T"), ("insertion", 3, 6, "", "AA"), ("deletion", 5, 10, "A", "")]
    assert spark.sql("SELECT * FROM sl_alignment_events(NULL, 3, 'A', 'C')").count() == 0
