"""Multiallelic calls against plain loops over sets, samples and genotypes."""

import itertools
import math
import random

import numpy as np

from allelix.operators import calling

SCHEMA = "k int, alts array<string>, qs array<double>, calls array<struct<pl: array<int>>>"


def by_hand(n, qs, calls, samples):
    at = lambda i, j: max(i, j) * (max(i, j) + 1) // 2 + min(i, j)
    single = lambda x: float(np.float32(x))
    rows = []
    for pl in calls:
        if pl is None or len(pl) != n * (n + 1) // 2 or None in pl or not any(pl):
            rows.append(None)
        else:
            p = [10 ** (-x / 10) for x in pl]
            rows.append([x / sum(p) for x in p])
    sets = [(a,) for a in range(n)] + [(a, b) for a in range(n) for b in range(a)] + [(a, b, c) for a in range(n) for b in range(a) for c in range(b)]
    best, found = None, {}
    for s in sets:
        if len(s) > 1 and any(qs[a] == 0 for a in s):
            continue
        f = {a: 1.0 if len(s) == 1 else single(qs[a] / sum(qs[x] for x in s)) for a in s}
        values = [sum(f[a] * f[b] * p[at(a, b)] for a, b in itertools.product(s, s)) for p in rows if p]
        values = [v for v in values if v > 0]
        if values:
            found[s] = sum(map(math.log, values)) + sum(a > 0 for a in s) * calling.log_prior(samples)
            if best is None or found[s] > found[best] + 1e-12:
                best = s
    best = best or (0,)
    kept = sorted({0, *best})
    ref = found.get((0,), 0.0)
    others = [v for s, v in found.items() if s != (0,)]
    both = np.logaddexp.reduce([ref, *others])
    qual = None if not found else calling.PHRED * ((ref if len(kept) > 1 else np.logaddexp.reduce(others)) - both)
    out = []
    for p in rows:
        if p is None or len(kept) == 1:
            out.append(("./." if p is None else "0/0", 0))
            continue
        w = {(i, j): (p[at(kept[i], kept[j])] * single(qs[kept[i]]) * single(qs[kept[j]]) * (1 if i == j else 2) if {kept[i], kept[j]} <= set(best) else 0.0) for j in range(len(kept)) for i in range(j + 1)}
        order = sorted(w, key=lambda g: (g[0] != g[1], g[1], g[0]))
        top = max(order, key=w.get)
        share = w[top] / sum(w.values()) if sum(w.values()) else 0
        out.append((f"{top[0]}/{top[1]}" if share else "0/0", 0 if not share else 127 if share >= 1 else math.floor(min(127, calling.PHRED * math.log(1 - share)))))
    return kept, qual, out


def test_calls_equal_loops(spark):
    rnd = random.Random(6)
    rows = []
    for k in range(150):
        n = rnd.choice([1, 2, 2, 3, 4, 5])
        qs = [rnd.choice([0.0, 0.1, 0.7, 2.3]) for _ in range(n)]
        qs[0] = qs[0] or 0.5
        size = n * (n + 1) // 2
        one = lambda size=size: rnd.choice([None, [0] * size, [rnd.choice([0, 3, 20, 60, 200]) for _ in range(size)], [rnd.randint(0, 90) for _ in range(size)], [rnd.randint(0, 255) for _ in range(size)], [5]])
        rows.append((k, [f"A{i}" for i in range(n - 1)], qs, [(one(),) for _ in range(5)]))
    got = {r.k: r for r in calling.call_alleles(spark.createDataFrame(rows, SCHEMA), 5).collect()}
    variants = 0
    for k, alts, qs, calls in rows:
        kept, qual, out = by_hand(len(alts) + 1, qs, [c[0] for c in calls], 5)
        r = got[k]
        assert r.kept == kept and [c.gt for c in r.calls] == [c[0] for c in out], (k, r, kept, out)
        assert all(abs(a.gq - b[1]) <= 1 for a, b in zip(r.calls, out, strict=True))
        if len(alts) and qual is not None:
            assert abs(r.qual - qual) < 1e-6 * max(1, abs(qual))
        variants += len(kept) > 1
    assert variants > 40


def test_nothing_to_call(spark):
    rows = [(1, [], [1.0], [([0],)]), (2, ["C"], [1.0, 0.5], [(None,), ([0, 0, 0],)]), (3, ["C"], None, [([50, 0, 50],)]), (4, ["C"], [1.0, 1.0], []), (5, ["C"], [0.0, 1.0], [([255, 90, 0],), (None,)])]
    got = {r.k: (r.kept, r.qual is None, [c.gt for c in r.calls]) for r in calling.call_alleles(spark.createDataFrame(rows, SCHEMA), 2).collect()}
    assert got[1][0] == [0] and got[2] == ([0], True, ["./.", "./."]) and got[4] == ([0], True, [])
    assert got[3][0] in ([0], [0, 1]) and got[5] == ([0, 1], False, ["1/1", "./."])
    assert calling.call_alleles(spark.createDataFrame([], SCHEMA), 2).count() == 0


def test_trios_equal_loops(spark):
    rnd = random.Random(8)
    rows = []
    for k in range(60):
        n = rnd.choice([2, 2, 3])
        one = lambda n=n: rnd.choice([[rnd.randint(0, 60) for _ in range(n * (n + 1) // 2)], [rnd.randint(0, 20) for _ in range(n * (n + 1) // 2)], None if rnd.random() < 0.1 else [9] * (n * (n + 1) // 2)])
        rows.append((k, [f"A{i}" for i in range(n - 1)], [0.6, *(rnd.choice([0.3, 1.0]) for _ in range(n - 1))], [(one(),) for _ in range(4)]))
    df = spark.createDataFrame(rows, SCHEMA)
    single = {r.k: r for r in calling.call_alleles(df, 4).collect()}
    joint = {r.k: r for r in calling.call_alleles(df, 4, trios=[(3, 0, 2)], novel=1e-3).collect()}
    changed = 0
    for k, _, qs, calls in rows:
        kept, best = joint[k].kept, set(joint[k].best)
        assert (kept, joint[k].calls[1]) == (single[k].kept, single[k].calls[1])
        pairs = [(i, j) for j in range(len(kept)) for i in range(j + 1)]
        at = lambda i, j: j * (j + 1) // 2 + i
        w = {}
        for s in (3, 0, 2):
            p = calls[s][0] and [10 ** (-x / 10) for x in calls[s][0]]
            w[s] = p and {(i, j): p[at(kept[i], kept[j])] / sum(p) * qs[kept[i]] * qs[kept[j]] * (1 if i == j else 2) if {kept[i], kept[j]} <= best else 0 for i, j in pairs}
        if len(kept) == 1 or None in w.values():
            assert joint[k].calls == single[k].calls
            continue
        value = {}
        for f, m, c in itertools.product(pairs, repeat=3):
            inherited = sum(tuple(sorted((x, y))) == c for x in f for y in m) / 4
            value[f, m, c] = w[0][f] * w[2][m] * w[3][c] * (1e-3 + (1 - 1e-3) * inherited)
        top = max(value.values())
        got = tuple(tuple(map(int, joint[k].calls[s].gt.split("/"))) for s in (0, 2, 3))
        assert value[got] > top * (1 - 1e-9)
        for who, s in enumerate((0, 2, 3)):
            share = sum(v for g, v in value.items() if g[who] == got[who]) / sum(value.values())
            assert abs(joint[k].calls[s].gq - (127 if share >= 1 else math.floor(min(127, calling.PHRED * math.log(1 - share))))) <= 1
        changed += [joint[k].calls[s].gt for s in (0, 2, 3)] != [single[k].calls[s].gt for s in (0, 2, 3)]
    assert changed > 3
