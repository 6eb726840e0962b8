"""Left alignment and REF checks against brute force, with repeats far longer than a window."""

import random

import pytest

from allelix.operators import align

SCHEMA = "k int, chrom string, pos int, ref string, alts array<string>, extra string"


def by_hand(reference, pos, alleles):
    """One base at a time: while all alleles end alike, the last base goes, and a base of the reference comes in front where one would be empty."""
    alleles = list(alleles)
    while len({a[-1] for a in alleles}) == 1:
        if min(map(len, alleles)) == 1:
            if pos == 1 or reference[pos - 2] == "N":
                break
            pos -= 1
            alleles = [reference[pos - 1] + a for a in alleles]
        alleles = [a[:-1] for a in alleles]
    while min(map(len, alleles)) > 1 and len({a[0] for a in alleles}) == 1:
        pos, alleles = pos + 1, [a[1:] for a in alleles]
    return pos, alleles[0], alleles[1:]


def run(spark, reference, rows, **options):
    pieces = spark.createDataFrame([("c", i + 1, reference[i : i + 700]) for i in range(0, len(reference), 700)], "chrom string, first int, bases string")
    got = align.left_align(spark.createDataFrame(rows, SCHEMA), pieces, ["k"], **options).collect()
    assert all(r.extra == "x" for r in got) and len(got) == len(rows)
    return {r.k: (r.pos, r.ref, r.alts) for r in got}


def test_repeats_longer_than_the_window(spark):
    reference = "G" + "A" * 3000 + "C" + "CAT" * 900 + "G" * 50
    rows = [
        (1, "c", 2900, "AA", ["A"], "x"), (2, "c", 20, "AAA", ["A"], "x"), (3, "c", 3001, "A", ["AAAA"], "x"), (4, "c", 5692, "ATCA", ["A"], "x"), (5, "c", 2900, "AAA", ["AA", "A"], "x"),
        (6, "c", 3001, "AC", ["A"], "x"), (7, "c", 5, "A", ["C"], "x"), (8, "c", 1, "GA", ["G"], "x"), (9, "c", 2900, "AA", ["<DEL>"], "x"), (10, "c", 2900, "A", [], "x"), (11, "c", 2900, "A", ["*", "AA"], "x"), (12, "c", 2900, "aa", ["a"], "x"),
        (13, None, 2900, "AA", ["A"], "x"), (14, "c", None, "AA", ["A"], "x"), (15, "c", 2900, None, ["A"], "x"), (16, "other", 2900, "AA", ["A"], "x"), (17, "c", 2900, "A", None, "x"),
    ]
    got = run(spark, reference, rows)
    assert got[1] == (1, "GA", ["G"]) and got[2] == (1, "GAA", ["G"]) and got[3] == (1, "G", ["GAAA"]) and got[5] == (1, "GAA", ["GA", "G"]) and got[12] == (1, "GA", ["G"])
    assert got[4] == by_hand(reference, 5692, ["ATCA", "A"]) and got[4][0] < 3010
    for k, chrom, pos, ref, alts, _ in rows[8:11] + rows[12:15] + rows[16:]:
        assert got[k] == (pos, ref, alts), k
    assert got[16] == (2900, "AA", ["A"]) and got[7] == (5, "A", ["C"])


@pytest.mark.parametrize("window", [1, 3, 64])
def test_random_alleles_equal_brute_force(spark, window):
    rnd = random.Random(window)
    reference = "".join(rnd.choice(["A", "C", "AC", "ACC", "AAAA", "GT", "N"]) for _ in range(300))
    rows = []
    for k in range(300):
        pos = rnd.randint(1, len(reference) - 6)
        ref = reference[pos - 1 : pos - 1 + rnd.randint(1, 5)]
        alts = {ref[: rnd.randint(1, len(ref))] + rnd.choice(["", "A", "C", "AC", ref, ref[-1:]]) for _ in range(rnd.choice([1, 1, 2, 3]))} - {ref}
        if alts:
            rows.append((k, "c", pos, ref, sorted(alts), "x"))
    got = run(spark, reference, rows, window=window)
    for k, _, pos, ref, alts, _ in rows:
        assert got[k] == by_hand(reference, pos, [ref, *alts]), (pos, ref, alts)


def test_no_rows(spark):
    assert run(spark, "ACGT", []) == {}


def test_reference_checks(spark):
    reference = spark.createDataFrame([("c", 1, "ACGTACGT")], "chrom string, first int, bases string")
    call = [("0/1", [5, 6], [1, 2, 3]), ("1|1", [7, 8], [4, 5, 6]), ("./.", None, None)]
    rows = [(1, "c", 1, "a", ["C"], call), (2, "c", 1, "G", ["A"], call), (3, "c", 1, "G", ["T"], call), (4, "c", 8, "TT", ["T"], call), (5, "c", 3, "N", ["<DEL>"], call), (6, "d", 1, "A", ["C"], call), (7, "c", 2, "T", ["A", "C"], [("1/2", [1, 2, 3], [0, 1, 2, 3, 4, 5])])]
    df = spark.createDataFrame(rows, "k int, chrom string, pos int, ref string, alts array<string>, calls array<struct<gt: string, ad: array<int>, pl: array<int>>>")
    assert {r.k: r.ref_ok for r in align.check_ref(df, reference, ["k"]).collect()} == {1: True, 2: False, 3: False, 4: False, 5: True, 6: False, 7: False}
    assert {r.k for r in align.check_ref(df, reference, ["k"], "exclude").collect()} == {1, 5}
    fixed = {r.k: r for r in align.check_ref(df, reference, ["k"], "set", {"ad": "R", "pl": "G"}).collect()}
    assert (fixed[2].ref, fixed[2].alts) == ("A", ["G"]) and [(c.gt, c.ad, c.pl) for c in fixed[2].calls] == [("1/0", [6, 5], [3, 2, 1]), ("0|0", [8, 7], [6, 5, 4]), ("./.", None, None)]
    assert (fixed[3].ref, fixed[3].alts, fixed[3].calls[0].gt) == ("A", ["T"], "0/1") and (fixed[4].ref, fixed[6].ref, fixed[1].ref) == ("TT", "A", "a")
    assert (fixed[7].ref, fixed[7].alts, fixed[7].calls[0].gt, fixed[7].calls[0].ad, fixed[7].calls[0].pl) == ("C", ["A", "T"], "1/0", [3, 2, 1], [5, 4, 2, 3, 1, 0])
    with pytest.raises(Exception, match="REF differs from the reference at c:1"):
        align.check_ref(df.where("k = 2"), reference, ["k"], "exit").collect()
    with pytest.raises(ValueError, match="no such mode"):
        align.check_ref(df, reference, ["k"], "fix")
