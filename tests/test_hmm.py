"""Decoding by spans against decoding of whole contigs and enumeration of all paths; scores and genetic maps by hand."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from allelix.operators import hmm


def sites(spark, rnd, n, places=False):
    rows = []
    for sample in (0, 1):
        for chrom in ("a", "b"):
            pos, good = 1, False
            for _ in range(n):
                pos += rnd.choice([1, 5, 40, 3000])
                good = good != (rnd.random() < 0.08)
                e = (rnd.randint(-2_000_000, -1), rnd.randint(-2_000_000, -1))
                rows.append((sample, chrom, pos, max(e) if not good else min(e), min(e) if not good else max(e), pos / 7000 if places and rnd.random() < 0.9 else None))
    rnd.shuffle(rows)
    return rows, spark.createDataFrame(rows, "sample_id int, chrom string, pos int, e0 long, e1 long, place double")


def whole(rows, into, out, places):
    """Best path, posterior and path scores of one sequence, site by site."""
    rows = sorted(rows)
    pos = np.array([r[0] for r in rows])
    e = np.array([r[1:3] for r in rows])
    share = hmm.shares_between(np.array([np.nan if r[3] is None else r[3] for r in rows])) if places else None
    t = hmm.transitions(np.diff(pos, prepend=pos[:1]), into, out, share)
    half = round(math.log(0.5) * hmm.SCALE)
    score, back = hmm.best(np.array([half, half]), e, t)
    path = [int(score.argmax())]
    for i in range(len(rows) - 1, 0, -1):
        path.append(int(back[i, path[-1]]))
    a, b = hmm.summed(np.log([0.5, 0.5]), e / hmm.SCALE, t / hmm.SCALE), hmm.summed_back(np.zeros(2), e / hmm.SCALE, t / hmm.SCALE)
    both = a + b
    return pos.tolist(), path[::-1], np.exp(both[:, 1] - hmm.log_sum(both, 1)), e, t, half


@pytest.mark.parametrize(("span", "places"), [(1, False), (300, False), (4000, True), (1 << 20, False)])
def test_spans_equal_whole_contigs(spark, span, places):
    rows, df = sites(spark, random.Random(span), 60, places)
    df = df if places else df.drop("place")
    decoded = hmm.decode(df, 1e-3, 2e-3, span)
    got = {(r.sample_id, r.chrom, r.pos): (r.state, r.posterior) for r in decoded.collect()}
    runs = []
    for key in itertools.product((0, 1), ("a", "b")):
        pos, path, posterior, *_ = whole([r[2:] for r in rows if r[:2] == key], 1e-3, 2e-3, places)
        assert [got[(*key, p)][0] for p in pos] == path
        assert np.allclose([got[(*key, p)][1] for p in pos], posterior)
        for state, run in itertools.groupby(zip(pos, path, posterior, strict=True), lambda x: x[1]):
            run = list(run)
            if state:
                q = [min(99.0, -10 * math.log10(max(1 - x[2], 1e-300))) for x in run]
                runs.append((*key, run[0][0], run[-1][0], len(run), round(sum(q) / len(q), 4)))
    found = sorted((r.sample_id, r.chrom, r.beg, r.end_, r.n, round(r.qual, 4)) for r in hmm.segments(decoded).collect())
    assert [r[:5] for r in found] == [r[:5] for r in sorted(runs)] and len(runs) > 3
    assert np.allclose([r[5] for r in found], [r[5] for r in sorted(runs)], atol=1e-3)


def test_path_is_the_best_of_all(spark):
    rnd = random.Random(4)
    rows = [(i * 10 + 1, rnd.randint(-3_000_000, -1), rnd.randint(-3_000_000, -1), None) for i in range(9)]
    _, path, posterior, e, t, half = whole(rows, 1e-2, 2e-2, False)
    score = lambda p: half + e[0][p[0]] + sum(t[i][p[i - 1]][p[i]] + e[i][p[i]] for i in range(1, 9))
    every = list(itertools.product((0, 1), repeat=9))
    assert tuple(path) == max(every, key=score)
    weight = np.exp([score(p) / hmm.SCALE for p in every])
    assert np.allclose(posterior, [sum(w for w, p in zip(weight, every, strict=True) if p[i]) / weight.sum() for i in range(9)])


def test_scores_of_calls(spark):
    calls = spark.createDataFrame([("0/0", 0.5), ("0|1", 0.2), ("1/1", 0.2), ("./.", 0.2), ("1", 0.2), ("0/0", 0.0), ("0/0", 1.0), ("1/2", 0.3), (None, 0.3), ("0/0", None)], "gt string, af double")
    got = {(r.gt, r.af): (r.e0, r.e1) for r in hmm.autozygosity_scores(calls, 20.0).collect()}
    ln = lambda x: round(math.log(x) * 1e6)
    assert got == {("0/0", 0.5): (ln(0.98 * 0.25 + 0.01 * 0.5 + 0.01 * 0.25), ln(0.98 * 0.5 + 0.01 * 0.5)), ("0|1", 0.2): (ln(0.01 * 0.64 + 0.98 * 0.32 + 0.01 * 0.04), ln(0.01)), ("1/1", 0.2): (ln(0.01 * 0.64 + 0.01 * 0.32 + 0.98 * 0.04), ln(0.01 * 0.8 + 0.98 * 0.2))}
    pl = spark.createDataFrame([([0, 10, 100], 0.5), ([7, 7, 7], 0.5), (None, 0.5), ([0], 0.5)], "pl array<int>, af double")
    r, = hmm.autozygosity_scores(pl).collect()
    s = 1 + 0.1 + 1e-10
    assert (r.e0, r.e1) == (ln((0.25 + 0.05 + 0.25e-10) / s), ln((0.5 + 0.5e-10) / s))


def test_places_on_a_map(spark):
    where = spark.createDataFrame([("c", 100, 1.0), ("c", 200, 3.0), ("c", 1200, 4.0), ("d", 5, 9.0)], "chrom string, pos int, cm double")
    rows = [("c", p) for p in (1, 100, 150, 199, 200, 700, 1200, 5000)] + [("d", 4), ("e", 7), ("c", 150)]
    got = hmm.with_places(spark.createDataFrame(rows, "chrom string, pos int"), where).collect()
    assert len(got) == len(rows)
    assert {(r.chrom, r.pos): r.place and round(r.place, 6) for r in got} == {
        ("c", 1): 0.01, ("c", 100): 0.01, ("c", 150): 0.02, ("c", 199): 0.0298, ("c", 200): 0.03, ("c", 700): 0.035, ("c", 1200): 0.04, ("c", 5000): 0.04, ("d", 4): 0.09, ("e", 7): None,
    }


def test_empty_and_nulls(spark):
    schema = "sample_id string, chrom string, pos int, e0 long, e1 long"
    assert hmm.segments(hmm.decode(spark.createDataFrame([], schema), 1e-3, 1e-3)).count() == 0
    odd = spark.createDataFrame([(None, "a", 1, 0, 0), ("s", None, 1, 0, 0), ("s", "a", None, 0, 0), ("s", "a", 1, None, 0), ("s", "a", 2, -9_000_000, 0)], schema)
    got = hmm.decode(odd, 1e-3, 1e-3)
    assert [(r.sample_id, r.pos, r.state) for r in got.collect()] == [("s", 2, 1)]
    assert [tuple(r)[:5] for r in hmm.segments(got).collect()] == [("s", "a", 2, 2, 1)]
    assert got.where(F.col("posterior") > 0.99).count() == 1
