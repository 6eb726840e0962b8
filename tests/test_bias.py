"""Rank sums and exact tests against enumeration."""

import itertools
import math
import random

from pyspark.sql import functions as F

from allelix.operators import bias


def test_rank_sums_equal_pairs(spark):
    rnd = random.Random(1)
    rows = [(s, rnd.choice([None, *range(s + 1)]), rnd.random() < 0.3) for s in range(12) for _ in range(rnd.randint(1, 40))] + [(50, 3, True), (51, 3, False), (51, 4, None), (52, 7, True), (52, 7, False)]
    got = {r.site: r for r in bias.rank_sum(spark.createDataFrame(rows, "site int, v int, alt boolean"), ["site"], "v", F.col("alt")).collect()}
    for site in {r[0] for r in rows}:
        a, r = ([v for s, v, alt in rows if s == site and v is not None and alt is side] for side in (True, False))
        if not a and not r:
            assert site not in got
            continue
        u = sum((x > y) + (x == y) / 2 for x, y in itertools.product(a, r))
        n = len(a) + len(r)
        ties = sum(t * (t * t - 1) for t in ([*a, *r].count(x) for x in {*a, *r}))
        variance = len(a) * len(r) / 12 * (n + 1 - (ties / (n * (n - 1)) if n > 1 else 0))
        z = None if not a or not r else (u - len(a) * len(r) / 2) / math.sqrt(variance) if variance > 0 else 0.0
        assert (got[site].n_ref, got[site].n_alt) == (len(r), len(a)) and (got[site].z is None) == (z is None)
        assert z is None or abs(got[site].z - z) < 1e-9


def test_exact_tests_equal_all_tables(spark):
    rnd = random.Random(2)
    tables = [(0, 0, 0, 0), (3, 0, 0, 3), (10, 0, 0, 0), (1, 1, 1, 1), (0, 5, 7, 0), (400, 300, 20, 90)] + [tuple(rnd.randint(0, 12) for _ in range(4)) for _ in range(60)]
    df = spark.createDataFrame(tables, "a long, b long, c long, d long")
    got = df.select("*", bias.fisher_exact(*(F.col(x) for x in "abcd")).alias("p")).collect()
    for a, b, c, d, p in got:
        ways = {k: math.comb(a + b, k) * math.comb(c + d, a + c - k) for k in range(max(0, a + c - c - d), min(a + b, a + c) + 1)}
        assert abs(p - sum(w for w in ways.values() if w <= ways[a] * (1 + 1e-7)) / sum(ways.values())) < 1e-9


def test_strands(spark):
    rows = [(1, False, False)] * 5 + [(1, False, True)] * 5 + [(1, True, True)] * 6 + [(2, True, None)]
    got = {r.site: r for r in bias.strand_bias(spark.createDataFrame(rows, "site int, alt boolean, rev boolean"), ["site"], F.col("alt"), F.col("rev")).collect()}
    assert (got[1].rf, got[1].rr, got[1].af, got[1].ar) == (5, 5, 0, 6) and abs(got[1].phred + 4.343 * math.log(got[1].p)) < 1e-9
    assert (got[2].af, got[2].p, got[2].phred) == (0, 1.0, 0.0)
    assert bias.strand_bias(spark.createDataFrame([], "site int, alt boolean, rev boolean"), ["site"], F.col("alt"), F.col("rev")).count() == 0
