"""Records of equal inputs are worked out once."""

from pyspark.sql import functions as F

from allelix.operators import annotate, calling


def test_equal_sites_are_called_once(spark, monkeypatch):
    asked, called = [], calling._called
    monkeypatch.setattr(calling, "_called", lambda rows, *more: asked.append(rows.count()) or called(rows, *more))
    sites = spark.range(90).select("id", F.lit(1.5).alias("qual"), F.expr("CASE WHEN id < 80 THEN array('C') END AS alts"), F.array(F.lit(0.6), F.lit(0.4)).alias("qs"), F.expr("array(named_struct('pl', CASE WHEN id % 2 = 0 THEN array(90, 0, 90) END, 'own', id)) AS calls"))
    got = {r.id: r for r in calling.call_alleles(sites, 1).collect()}
    assert asked == [4] and sorted(got) == list(range(90)) and all(r.calls[0].own == i for i, r in got.items())
    assert {got[i].calls[0].gt for i in range(0, 80, 2)} == {"0/1"} and {got[i].calls[0].gt for i in range(1, 90, 2)} == {"./."}


def test_rows_written_alike_are_annotated_once(spark, monkeypatch):
    formed, forms = [], annotate._forms
    monkeypatch.setattr(annotate, "_forms", lambda rows: formed.append(rows.count()) or forms(rows))
    source = spark.range(60).selectExpr("'c' AS chrom", "5 AS pos", "'AG' AS ref", "'TG,CG' AS alt", "60 - id AS score")
    records = spark.range(70).selectExpr("id", "'c' AS chrom", "CASE WHEN id < 69 THEN 5 END AS pos", "'A' AS ref", "CASE id % 2 WHEN 0 THEN 'T' ELSE 'C' END AS alt")
    got = {r.id: (r.score, r.allele, r.matched) for r in annotate.tolerant(records, source, ["score"], ["score"]).collect()}
    assert got == {i: (1, i % 2, 2) if i < 69 else (None, None, None) for i in range(70)}
    assert formed == [3, 2]
