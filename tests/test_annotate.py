"""Tolerant annotation against loops over all pairs."""

import random

from allelix.operators import annotate


def strip(pos, ref, alt):
    while ref and alt and ref[-1] == alt[-1]:
        ref, alt = ref[:-1], alt[:-1]
    while ref and alt and ref[0] == alt[0]:
        pos, ref, alt = pos + 1, ref[1:], alt[1:]
    return pos, ref, alt


def padded(r1, a1, r2, a2):
    tail = r1[len(r2) :]
    return r1 == r2 + tail and a1 == a2 + tail


def expected(record, sources):
    chrom, pos, ref, alt, end = record
    if None in (pos, ref, alt):
        return None, None, None, None
    usable = sorted((s for s in sources if s[0] == chrom and None not in s[1:4]), key=lambda s: s[5])
    for s in usable:
        if (s[1], s[2]) == (pos, ref) and not (alt.startswith("<") and end is not None and s[4] != end):
            alts = s[3].split(",")
            if alt == "." and alts != ["."] or "," in alt and alt == s[3]:
                return s[5], None, None, 1
            if alt in alts:
                i = alts.index(alt)
                return s[5], s[6][i] if alt != "." else None, i if alt != "." else None, 1
    if not (ref.isalpha() and alt.isalpha()):
        return None, None, None, None
    up = (ref.upper(), alt.upper())
    for tier in (2, 3):
        for s in usable:
            for i, a in enumerate(s[3].split(",")):
                if not (a.isalpha() and s[2].isalpha()):
                    continue
                v = (s[2].upper(), a.upper())
                if s[1] == pos and (padded(*up, *v) or padded(*v, *up)) if tier == 2 else strip(s[1], *v) == strip(pos, *up):
                    return s[5], s[6][i], i, tier
    return None, None, None, None


def test_matches_equal_loops(spark):
    rnd = random.Random(5)
    genome = "ACGGTTACAAATTC"

    def alleles():
        pos, n = rnd.randint(1, 8), rnd.randint(1, 4)
        ref = genome[pos - 1 : pos - 1 + n]
        kind = rnd.random()
        if kind < 0.1:
            return pos, ref[0], rnd.choice(["<DEL>", ".", "*"]), rnd.choice([None, 20, 30])
        one = lambda: rnd.choice([ref[0], ref[0] + ref, ref[:-1] or "G", ref + "T", "T" + ref[1:], ref[:1] + "A" + ref[1:], ref.lower()])
        return pos, ref if rnd.random() < 0.9 else ref.lower(), ",".join(dict.fromkeys(one() for _ in range(rnd.choice([1, 1, 1, 2])))), rnd.choice([None, 20])

    schema = "chrom string, pos int, ref string, alt string, fin int"
    records = [(rnd.choice("xy"), *alleles()) for _ in range(400)] + [("x", None, "A", "C", None), ("x", 3, None, "C", None), ("x", 3, "A", None, None), ("z", 1, "A", "C", None)]
    sources = [(rnd.choice("xy"), *alleles(), i) for i in range(60)]
    sources = [(*s, [f"{s[5]}:{j}" for j in range(len(s[3].split(",")))]) for s in sources] + [("x", 3, None, "C", None, 900, []), ("x", None, "A", "C", None, 901, ["q"])]
    left = spark.createDataFrame([(*r, i) for i, r in enumerate(records)], schema + ", nr int")
    right = spark.createDataFrame(sources, schema + ", o int, per array<string>")
    got = annotate.tolerant(left, right, ["o", "per"], ["o"], ("per",), "fin").collect()
    assert len(got) == len(records)
    seen = set()
    for r in got:
        want = expected(records[r.nr], sources)
        if records[r.nr][3] == "." and r.o is not None:
            assert (r.o, r.matched) == (want[0], 1)
        else:
            assert (r.o, r.per, r.allele, r.matched) == want, (records[r.nr], [s for s in sources if s[5] in (r.o, want[0])])
        seen.add(r.matched)
    assert seen == {1, 2, 3, None}
    assert annotate.tolerant(left, right.limit(0), ["o"], ["o"]).where("o IS NULL AND matched IS NULL").count() == len(records)
    assert annotate.tolerant(left.limit(0), right, ["o"], ["o"]).count() == 0


def test_long_alleles(spark):
    long = "ACGT" * 5000
    records = spark.createDataFrame([("x", 5, long, long + "A"), ("x", 5, "A", long)], "chrom string, pos int, ref string, alt string")
    source = spark.createDataFrame([("x", 5 + len(long), "G", "AG", 1)], "chrom string, pos int, ref string, alt string, o int")
    assert sorted((len(r.ref), r.matched) for r in annotate.tolerant(records, source, ["o"], ["o"]).collect()) == [(1, None), (len(long), 3)]
