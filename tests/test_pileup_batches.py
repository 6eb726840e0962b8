"""Reads in batches of arrays: cuts between batches and blocks change nothing, and a query does not make rows of bases."""

import pyarrow as pa
from pyspark.sql import functions as F
from test_pileup import name_is_odd, random_reads, table

from allelix.operators import pileup
from allelix.operators import pileup_batches as B
from allelix.plans import catalog

SF = "/root/testdata/sf0.001"


def test_counts_equal_those_of_rows_for_any_batches(spark):
    reads = random_reads(6, 120)
    used = pileup.usable(table(spark, reads)).cache()
    want = {tuple(map(str, r)) for r in pileup.depths(pileup.observations(used)).collect()}
    try:
        for rows in (1, 7, 10000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
            assert {tuple(map(str, r)) for r in pileup.counted(used).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_blocks_are_given_out_when_too_many_are_held(monkeypatch):
    monkeypatch.setattr(B, "MOST_BLOCKS", 1)
    one = lambda pos, cigar: pa.RecordBatch.from_pydict({"sample": ["s"], "chrom": [None], "pos": pa.array([pos], pa.int32()), "mapq": pa.array([9], pa.int32()), "flag": pa.array([0], pa.int32()), "cigar": [cigar], "seq": ["ACGT" * 600], "qual": ["I" * 2400]})
    out = [r for b in B.counted(iter([one(5, "2400M"), one(1020, "600M9000N9M"), one(5, "2400M")]), None, 1) for r in b.to_pylist()]
    depth = {}
    for r in out:
        depth[r["pos"]] = depth.get(r["pos"], 0) + r["raw_depth"]
    assert depth == {p: 2 * (5 <= p < 2405) + (1020 <= p < 1620 or 10620 <= p < 10629) for p in [*range(5, 2405), *range(10620, 10629)]}
    assert all(r["chrom"] is None and r["sample"] == "s" for r in out)


def test_groups_stay_whole_and_names_have_their_hash():
    names = ["a", "a", "b", "b", "b", None, None, "c" * 300]
    batch = pa.RecordBatch.from_pydict({"k": names})
    for size in range(1, 9):
        groups = list(B.whole_groups((batch.slice(i, size) for i in range(0, 8, size)), ["k"]))
        assert [x for g in groups for x in g.column("k").to_pylist()] == names
        assert all(len({x for x in g.column("k").to_pylist()} & {x for o in groups if o is not g for x in o.column("k").to_pylist()}) == 0 for g in groups)
    texts = ["", "x", "r1.2.3", "q" * 400, *(f"read{i}" for i in range(50))]
    assert B.odd_names(pa.array(texts)).tolist() == [name_is_odd(t) for t in texts]


def test_queries_of_pileups_make_no_rows_of_bases(spark):
    """Bases were exploded and mates met in two windows; contigs' letters were digested for each read; indels were found three times."""
    assert "MapInArrow" not in catalog.queries()["pileup_indels"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    for name in ("pileup_depths", "pileup_records"):
        plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and plan.count("MapInArrow") == 2, name
        reads = [line for line in plan.splitlines() if "ACGTN" in line]
        assert reads and not any("ACGTACGT" in line for line in reads), name


def test_long_cigars_are_walked_in_proportion():
    runs, events = B._walk("1M1I" * 20000 + "1M")
    assert len(runs) == 20001 and len(events) == 20000 and events[-1].tolist() == [19999, 39999, 1, 0]


def test_piece_ends_are_those_of_the_sql(spark):
    """A read over the end of the second piece goes on with N."""
    from allelix.plans import pileups

    reads = pileups.reads(spark, SF).where("pos % 32 = 31").select(F.right("seq", F.lit(7)).alias("s")).distinct().collect()
    assert [r.s for r in reads] == ["N" * 7]
