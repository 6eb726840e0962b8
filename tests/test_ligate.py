"""Stitching of phased chunks against a walk from chunk to chunk."""

import math
import random

from allelix.operators import ligate

SCHEMA = "chrom string, chunk int, pos int, alt string, sample_id int, gt string"


def turn(gt, flag):
    return "|".join(reversed(gt.split("|"))) if flag and gt.count("|") == 1 else gt


def expected(rows):
    out, marks = {}, {}
    for chrom in {r[0] for r in rows}:
        for s in {r[4] for r in rows if r[0] == chrom}:
            chunks = {}
            for _, c, pos, alt, sample, gt in (r for r in rows if r[0] == chrom):
                chunks.setdefault(c, {}).setdefault((pos, alt), {})[sample] = gt
            order, state, quality, left = sorted(chunks), False, None, set()
            for i, c in enumerate(order):
                same = crossed = None
                if i:
                    before = chunks[order[i - 1]]
                    zone = sorted(k for k in before.keys() | chunks[c].keys() if min(chunks[c])[0] <= k[0] <= max(before)[0])
                    half, earlier = (len(zone) + 1) // 2, state
                    if zone:
                        same = crossed = 0
                        for k in zone:
                            a, b = (x.get(k, {}).get(s, "").split("|") for x in (before, chunks[c]))
                            if len(a) == len(b) == 2 and a[0] != a[1] and "." not in a + b:
                                same, crossed = same + (a == b), crossed + (a == b[::-1])
                        state = False if same == crossed else state != (crossed > same)
                    for n, k in enumerate(zone):
                        a, b = before.get(k, {}).get(s), chunks[c].get(k, {}).get(s)
                        if n < half:
                            out[chrom, *k, s] = (turn(a, earlier), order[i - 1]) if a else (b, c)
                        else:
                            out[chrom, *k, s] = (turn(b or a, state), c if b else order[i - 1])
                    left |= set(zone)
                f = same / (same + crossed) if same and crossed else 0
                quality = None if same is None else 99 if not (same and crossed) else int(99 * (0.7 + f * math.log(f) + (1 - f) * math.log(1 - f)) / 0.7)
                marks[chrom, c, s] = (same, crossed, state, quality)
                for k, calls in chunks[c].items():
                    after = chunks[order[i + 1]] if i + 1 < len(order) else None
                    if k not in left and not (after and k[0] >= min(after)[0]):
                        out[chrom, *k, s] = (turn(calls[s], state), c)
    return out, marks


def test_stitching_equals_a_walk(spark):
    rnd, rows = random.Random(7), []
    for chrom, chunks in (("x", 12), ("y", 5), ("z", 1)):
        for c in range(chunks):
            start = c * 10000
            for pos in sorted(rnd.sample(range(start, start + rnd.choice([9000, 14000, 14000, 14000])), 40)) + [start + 10000 + 50 * i for i in range(8)] + [start + 50 * i for i in range(8)]:
                if rnd.random() < 0.85:
                    for alt in rnd.choice([["A"], ["A", "C"]]):
                        for s in range(3):
                            gt = rnd.choice(["0|1", "0|1", "0|1", "1|0", "1|2", "1|1", "0/1", ".|1", "1", "."])
                            rows.append((chrom, c * 2, pos, alt, s, turn(gt, (c * 5 + s) % 3 == 0)))
    rows = list({(*r[:5],): r for r in rows}.values())
    df = spark.createDataFrame(rows, SCHEMA)
    out, marks = expected(rows)
    got = {(r.chrom, r.chunk, r.sample_id): (r.same, r.crossed, r.turned, r.quality) for r in ligate.links(df, ["pos", "alt"]).collect()}
    assert got == marks and {m[2] for m in marks.values()} == {True, False}
    records = ligate.stitched(df, ["pos", "alt"]).collect()
    assert len(records) == len(out)
    assert {(r.chrom, r.pos, r.alt, r.sample_id): (r.gt, r.chunk) for r in records} == out
    assert ligate.stitched(df.limit(0), ["pos", "alt"]).count() == 0
