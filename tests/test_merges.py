"""Intersections by rules and merges in rounds, against brute force and cases worked out by hand."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from allelix.operators import merge as M

SCHEMA = "k int, chrom string, pos int, id string, ref string, alts array<string>, qual double, filter string, info_dp int, calls array<struct<gt: string, ad: array<int>, pl: array<int>>>"


def kinds(ref, alt):
    out = set()
    for a in alt.split(","):
        if a[0] not in "<.*" and a != ref:
            if len(a) == len(ref):
                out.add("snp" if sum(x != y for x, y in zip(a, ref, strict=True)) == 1 else "mnp")
            elif a.startswith(ref) or ref.startswith(a):
                out.add("indel")
    return out


def same(a, b, mode):
    (ida, ra, aa), (idb, rb, ab) = a, b
    equal = (ra, aa) == (rb, ab)
    both = kinds(ra, aa) & kinds(rb, ab)
    shared = {x for x in aa.split(",") if x not in "*."} & set(ab.split(","))
    return {"none": equal, "all": True, "snps": equal or "snp" in both, "indels": equal or "indel" in both, "both": equal or bool(both & {"snp", "indel"}), "some": ra == rb and bool(shared), "id": ida == idb != "."}[mode]


@pytest.mark.parametrize("mode", M.COLLAPSE)
def test_intersections_equal_brute_force(spark, mode):
    rnd = random.Random(mode)
    alleles = [("A", "C"), ("A", "G"), ("A", "C,G"), ("A", "AT"), ("AT", "A"), ("A", "C,AT"), ("AC", "GT"), ("A", "<DEL>"), ("A", "."), ("A", "*"), ("A", "T,*")]
    files = [[(i, "1", rnd.randint(1, 6), rnd.choice([".", "x", "y"]), *rnd.choice(alleles)) for i in range(rnd.choice([0, 15, 25]))] for _ in range(4)]
    frames = [spark.createDataFrame(f, "k int, chrom string, pos int, id string, ref string, alt string") for f in files]
    got = M.intersect(frames, ["k"], mode)
    expected = {
        (i, r[0]): "".join("1" if any(o[2] == r[2] and same(r[3:], o[3:], mode) for o in other) else "0" for other in files) for i, f in enumerate(files) for r in f
    }
    assert {(r.file, r.k): r.present for r in got.collect()} == expected
    wanted = {k for k, v in expected.items() if v.count("1") >= 2}
    listed = []
    for i, f in enumerate(files):
        for r in sorted(f):
            if (i, r[0]) in wanted and not any(j != i and o[2] == r[2] and same(o[3:], r[3:], mode) for j, o in listed):
                listed.append((i, r))
    found = M.sites(M.intersect(frames, ["k"], mode, "+2"), ["k"], mode).collect()
    assert sorted((r.file, r.k) for r in found) == sorted((i, r[0]) for i, r in listed)


def record(rnd, k, ref, alts, name=None):
    n = len(alts)
    call = lambda: (rnd.choice(["/", "|"]).join(str(rnd.choice([".", *range(n + 1)])) for _ in range(2)), [rnd.randint(0, 40) for _ in range(n + 1)], [rnd.randint(0, 99) for _ in range((n + 1) * (n + 2) // 2)])
    return (k, "1", 100, name or rnd.choice([".", "a", "b"]), ref, alts, rnd.choice([None, 3.0, 7.5]), rnd.choice(["PASS", ".", "q10"]), rnd.randint(0, 9), [call(), call()])


def merged(spark, files, mode):
    frames = [spark.createDataFrame(f, SCHEMA) for f in files]
    return M.merge_files(frames, [2] * len(files), ["k"], mode, {"ad": "R", "pl": "G"}), frames


def shapes(spark, records, mode):
    """Of records (file, ref, alts): REF and ALTs of what they merge to."""
    files = {}
    for i, (file, ref, alts) in enumerate(records):
        files.setdefault(file, []).append((i, "1", 100, ".", ref, alts.split(",") if alts != "." else [], None, ".", 1, []))
    frames = [spark.createDataFrame(files.get(f, []), SCHEMA) for f in range(max(files) + 1)]
    return sorted((r.ref, ",".join(r.alts)) for r in M.merge_files(frames, [0] * len(frames), ["k"], mode).collect())


def test_what_merges_by_mode(spark):
    snps = [(0, "A", "C"), (1, "A", "G")]
    assert shapes(spark, snps, "none") == [("A", "C"), ("A", "G")] and shapes(spark, snps, "snps") == [("A", "C,G")] == shapes(spark, snps, "both")
    indels = [(0, "A", "AT"), (1, "ATG", "A")]
    assert shapes(spark, indels, "snps") == [("A", "AT"), ("ATG", "A")] and shapes(spark, indels, "both") == [("ATG", "ATTG,A")]
    assert shapes(spark, indels, "snp-ins-del") == [("A", "AT"), ("ATG", "A")]
    mixed = [(0, "A", "C"), (1, "A", "AT")]
    assert shapes(spark, mixed, "both") == [("A", "AT"), ("A", "C")] and shapes(spark, mixed, "all") == [("A", "C,AT")]
    assert shapes(spark, [(0, "A", "C"), (1, "AT", "CT")], "none") == [("AT", "CT")]
    assert shapes(spark, [(0, "A", "."), (1, "A", "G")], "none") == [("A", "G")]
    # one record of a file at a time: the second one waits for a round of its own
    assert shapes(spark, [(0, "A", "C"), (0, "A", "C"), (1, "A", "C")], "both") == [("A", "C"), ("A", "C")]
    assert shapes(spark, [(0, "A", "C"), (0, "A", "G"), (1, "A", "G")], "none") == [("A", "C"), ("A", "G")]


@pytest.mark.parametrize("mode", ["none", "snps", "indels", "both", "snp-ins-del", "all", "id"])
def test_no_record_and_no_allele_is_lost(spark, mode):
    rnd = random.Random(mode)
    pool = [("A", ["C"]), ("A", ["G", "C"]), ("A", ["AT"]), ("ATG", ["A"]), ("ATG", ["A", "CTG"]), ("AT", ["GC"]), ("A", []), ("A", ["<DEL>"]), ("A", ["T", "*"])]
    for _ in range(3):
        files = [[record(rnd, k, *rnd.choice(pool)) for k in range(rnd.randint(0, 4))] for _ in range(3)]
        df, frames = merged(spark, files, mode)
        placed = M.rounds(frames[0].withColumn("file", F.lit(0)).union(frames[1].withColumn("file", F.lit(1))).union(frames[2].withColumn("file", F.lit(2))), ["k"], mode).collect()
        assert sorted((r.file, r.k) for r in placed) == sorted((i, r[0]) for i, f in enumerate(files) for r in f)
        assert max(Counter((r.file, r.round) for r in placed).values(), default=1) == 1
        rows = {r.round: r for r in df.collect()}
        assert sum(r.info_dp for r in rows.values()) == sum(r[8] for f in files for r in f)
        for p in placed:
            k, _, _, _, ref, alts, qual, _, _, calls = next(r for r in files[p.file] if r[0] == p.k)
            out = rows[p.round]
            assert out.ref.startswith(ref) and (qual is None or out.qual >= qual)
            said = [ref, *alts]
            want = [out.ref, *(M.padded(a, ref, out.ref) for a in alts)]
            new = [out.ref, *out.alts]
            for call, got in zip(calls, out.calls[2 * p.file : 2 * p.file + 2], strict=True):
                split = lambda g: g.replace("|", "/").split("/")
                assert [x if x == "." else want[int(x)] for x in split(call[0])] == [x if x == "." else new[int(x)] for x in split(got.gt)] and ("|" in call[0]) == ("|" in got.gt)
                assert {new[i]: v for i, v in enumerate(got.ad) if v is not None} == dict(zip(want, call[1], strict=True)) and len(got.ad) == len(new)
                pair = lambda names, values: {frozenset([names[h], names[l]]): values[h * (h + 1) // 2 + l] for h in range(len(names)) for l in range(h + 1)}  # noqa: E741
                assert {g: v for g, v in pair(new, got.pl).items() if v is not None} == pair(want, call[2])
            assert len(said) == len(want)
        for r in rows.values():
            here = {p.file for p in placed if p.round == r.round}
            assert all(c.gt == "./." and c.ad is None for i, c in enumerate(r.calls) if i // 2 not in here)
            called = [x for c in r.calls for x in c.gt.replace("|", "/").split("/") if x != "."]
            assert r.an == len(called) and r.ac == [called.count(str(i + 1)) for i in range(len(r.alts))]


def test_empty_files_and_nulls(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert M.merge_files([empty, empty], [2, 2], ["k"]).count() == 0
    one = spark.createDataFrame([(1, "1", 5, None, "a", ["c", "<*>"], None, None, None, [(None, None, None), ("0/1", None, None)])], SCHEMA)
    r = M.merge_files([empty, one], [1, 2], ["k"], "both", {"ad": "R", "pl": "G"}).first()
    assert (r.id, r.ref, r.alts, r.qual, r.filter, r.info_dp, [c.gt for c in r.calls]) == (".", "A", ["C", "<*>"], None, ".", 0, ["./.", None, "0/1"])
    flat = empty.select("k", "chrom", "pos", "id", "ref", F.lit("A").alias("alt"))
    assert M.intersect([flat, flat], ["k"], "both").count() == 0 and M.sites(M.intersect([flat], ["k"]), ["k"]).count() == 0


POOL = [
    (2, "A", ["C"]), (2, "A", ["G", "C"]), (136, "A", ["AT"]), (264, "ATG", ["A"]), (266, "ATG", ["A", "CTG"]), (4, "AT", ["GC"]), (1, "A", []), (16, "A", ["<DEL>"]), (2, "A", ["T", "*"]),
    (1, "A", ["<*>"]), (16, "CT", ["G"]), (2, "AC", ["AG"]), (3, "A", ["C", "<*>"]), (4, "ATG", ["GTC"]),
]


@pytest.mark.parametrize("mode", ["none", "snps", "indels", "both", "snp-ins-del", "all"])
def test_rounds_by_shapes_equal_the_plain_rule(mode):
    rnd, dealer = random.Random(mode), M.Rounds(mode)
    for _ in range(100):
        pool = rnd.sample(POOL, rnd.randint(1, len(POOL)))
        todo = sorted(((rnd.randint(0, 3), *rnd.choice(pool)) for _ in range(rnd.randint(1, 60))), key=lambda x: x[0])
        todo = [(*x, ".", rnd.choice([0, 5, None]) if x[3] == ["<DEL>"] else None) for x in todo]
        left, plain = list(range(len(todo))), []
        while left:
            plain.append(sorted(left[i] for i in M.next_round(mode, [todo[i] for i in left])))
            left = [i for i in left if i not in plain[-1]]
        assert dealer.deal([x[0] for x in todo], [dealer.shape(x[1], x[2], tuple(x[3]), x[5]) for x in todo]) == plain


def test_fits_are_asked_by_shapes_not_by_records(monkeypatch):
    asked, fits = [], M._fits
    monkeypatch.setattr(M, "_fits", lambda *a: asked.append(a) or fits(*a))
    rnd, dealer = random.Random(1), M.Rounds("both")
    numbers = [rnd.choice([dealer.shape(k, r, tuple(a), None) for k, r, a in POOL[:6]]) for _ in range(3000)]
    dealt = dealer.deal([i // 1000 for i in range(3000)], numbers)
    assert sorted(i for r in dealt for i in r) == list(range(3000)) and len(asked) < 3000


def test_records_come_together_once_and_calls_are_made_then(spark):
    rows = [(i, "1", i % 2, ".", "A", ["C"], None, ".", i) for i in range(6)]
    files = [spark.createDataFrame(rows, "k int, chrom string, pos int, id string, ref string, alts array<string>, qual double, filter string, info_dp int") for _ in range(2)]
    for mode in ("id", "both"):
        df = M.merge_files(files, [1, 1], ["k"], mode, {"ad": "R"}, calls="array(struct(CASE WHEN x.info_dp > pos THEN '0/1' ELSE '0/0' END AS gt, array(x.info_dp, x.info_dp + 1) AS ad))")
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
        got = sorted((r.pos, r.info_dp, [(c.gt, c.ad) for c in r.calls]) for r in df.collect())
        assert got == sorted((i % 2, 2 * i, [("0/1" if i > i % 2 else "0/0", [i, i + 1])] * 2) for i in range(6))
