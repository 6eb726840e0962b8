"""Small inputs on which queries differed from their SQL, or worked a column out more than once."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from allelix.functions import variants as V
from allelix.operators import align, intervals, ligate, merge
from allelix.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture
def lines(spark, tmp_path):
    """A folder with the lines of some orders alone."""

    def make(condition):
        spark.read.parquet(f"{SF}/lineitem.parquet").where(condition).write.parquet(f"{tmp_path}/lineitem.parquet")
        return str(tmp_path)

    return make


def test_position_sets_has_a_row_for_each_operation(spark, lines):
    folder = lines("l_orderkey % 3 = 2")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet/*.parquet'")
    want = con.sql(catalog.oracle_sql()["position_sets"]).fetchall()
    got = [tuple(r) for r in catalog.queries()["position_sets"](spark, folder).collect()]
    assert sorted(got) == sorted(want) and ("not", 0) in got


def test_filters_work_calls_out_once(spark):
    """A filter that is pushed below the calls names them again and again, each time worked out anew."""
    for name in ("filter_expr_mac", "filter_expr_binomial", "view_major_af"):
        plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("sequence(0, 3") <= 1, name


def test_let_names_a_value_once(spark):
    """Counts and tails name their input once."""
    rows = spark.createDataFrame([(7, 20, ["0/1", "1|2", "./."])], "k int, n int, g array<string>").withColumn("calls", F.transform("g", lambda g: F.struct(g.alias("gt"))))
    text = str(V.allele_counts(F.col("calls"), F.lit(2))) + str(V.binomial_two_sided(F.col("k") + 0, F.col("n")))
    assert text.count("calls") == 1 and text.count("k +") + text.count("+(k") <= 1
    got = rows.select(V.allele_counts(F.col("calls"), F.lit(2)).alias("a"), V.binomial_two_sided(F.col("k"), F.col("n")).alias("p"), V.binomial_two_sided(F.lit(0), F.col("n")).alias("q")).first()
    assert got.a == [2, 1] and got.p == pytest.approx(2 * sum(math.comb(20, j) for j in range(8)) / 2**20) and got.q == pytest.approx(2 / 2**20)


def test_intervals_of_one_level_meet_in_one_join(spark):
    """Rows of a side are not copied to levels that the other one doesn't have."""
    left = spark.createDataFrame([("a", p, p + 1) for p in (5, 1023, 1024)], "chrom string, b int, e int")
    right = spark.createDataFrame([("a", 1000, 1100)], "chrom string, beg int, end_ int")
    met = intervals.overlapping(left, right, ("b", "e"), ("beg", "end_"))
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and sorted(r.b for r in met.collect()) == [1023, 1024]


def test_rounds_by_id_equal_round_after_round():
    """One pass over a position with many records, against rounds taken one by one."""
    rnd = random.Random(5)
    for n in (1, 2, 7, 60):
        todo = sorted((rnd.randrange(3), rnd.choice(["rs1", "rs2", "."])) for _ in range(n))
        left, numbers, k = list(range(n)), [0] * n, 0
        while left:
            chosen = {left[i] for i in merge.next_round("id", [(todo[j][0], 1, "A", [], todo[j][1], None) for j in left])}
            for i in chosen:
                numbers[i] = k
            left, k = [i for i in left if i not in chosen], k + 1
        assert merge.rounds_by_id(todo) == numbers


def test_equal_records_are_left_aligned_once(spark, monkeypatch):
    """Rounds and the bases before a place grow with different records, not with how often each comes."""
    asked, moved, fetch = [], align._moved, align.with_bases
    monkeypatch.setattr(align, "_moved", lambda rows, bits: asked.append(("moved", rows.count())) or moved(rows, bits))
    monkeypatch.setattr(align, "with_bases", lambda rows, *more: asked.append(("bases", rows.count())) or fetch(rows, *more))
    bases = spark.createDataFrame([("c", 1, "G" + "A" * 2999)], "chrom string, first int, bases string")
    copies = spark.range(300).select(F.lit("c").alias("chrom"), F.lit(2900).alias("pos"), F.lit("a").alias("ref"), F.when(F.col("id") % 2 == 0, "AA").otherwise("Aaa").alias("alt"), "id")
    got = {(r.pos, r.ref, r.alt, r.id) for r in align.left_align(copies, bases, ["id"]).collect()}
    assert got == {(1, "G", "GA" if i % 2 == 0 else "GAA", i) for i in range(300)}
    assert all(n <= 2 for _, n in asked)


@pytest.mark.parametrize("mode", ["none", "both"])
def test_sites_go_through_kinds_of_records(spark, mode):
    """Records are neither grouped by their keys to be marked nor brought into one list for each position."""
    row = lambda i: (i, "c", 7, ".", "A", ("C", "G", "AT", "C,AT")[i % 4])
    files = [spark.createDataFrame([row(i) for i in range(n)], "k int, chrom string, pos int, id string, ref string, alt string") for n in (1, 400, 400)]
    found = merge.intersect(files, ["k"], mode)
    plan = merge.sites(found, ["k"], mode)._jdf.queryExecution().optimizedPlan().toString()
    grouped = [line.split("]")[0] for line in plan.splitlines() if "Aggregate [" in line]
    assert grouped and not any("k#" in line for line in grouped) and "struct(row" not in plan and "row, named_struct" not in plan
    largest = merge.sites(found, ["k"], mode).groupBy("file").count().collect()
    assert {r.file: r["count"] for r in largest} == ({0: 1, 1: 300} if mode == "none" else {0: 1, 1: 100})


@pytest.mark.parametrize("how", ["left_semi", "left_anti"])
def test_overlaps_meet_by_places(spark, how):
    """Merged regions are joined to different places, and records by place: not all records of a bin to one key."""
    rows = spark.range(200).selectExpr("'c' AS chrom", "CAST(10 + id % 4 * 1000 AS INT) AS pos", "'ACG' AS ref", "'A' AS alt", "map('k', id) AS m", "id")
    regions = spark.createDataFrame([("c", 1, 12), ("c", 5, 1009), ("c", 3012, 90000)], "chrom string, beg int, end_ int")
    found = intervals.overlap(rows, regions, how=how, width=64)
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert not any("_bin" in line for line in joins[:1]) and "pos" in joins[0] and "_hit_pos" in joins[0]
    inside = {i for i in range(200) if i % 4 in (0, 3)}
    assert {r.id for r in found.collect()} == (inside if how == "left_semi" else set(range(200)) - inside)


def test_chunks_and_states_are_joined_from_stored_tables(spark, monkeypatch):
    """Extents and states are stored once, so that they are small tables of known size where calls meet them."""
    kept, keep = [], ligate.stored
    monkeypatch.setattr(ligate, "stored", lambda df: kept.append(df.columns) or keep(df))
    calls = spark.createDataFrame([("c", k, p, 0, "0|1") for k, p in ((0, 1), (0, 5), (1, 5), (1, 9))], "chrom string, chunk int, pos int, sample_id int, gt string")
    got = ligate.stitched(calls, ["pos"])
    assert len(kept) == 2 and sorted((r.pos, r.gt, r.chunk) for r in got.collect()) == [(1, "0|1", 0), (5, "0|1", 0), (9, "0|1", 1)]
