"""Pileups against loops over reads, SAM text, and cases of pairs."""

import collections
import itertools
import random
import re

from pyspark.sql import functions as F

from allelix.operators import pileup
from allelix.sources.alignments import read_sam

READS = "sample string, qname string, flag int, chrom string, pos int, mapq int, cigar string, mate_chrom string, mate_pos int, seq string, qual string"


def name_is_odd(name):
    h, low = 0, 0xFFFFFFFF
    for c in name.encode():
        h = (h * 31 + c) & low
    h = (h + (~(h << 15) & low)) & low
    h ^= h >> 10
    h = (h + (h << 3)) & low
    h ^= h >> 6
    h = (h + (~(h << 11) & low)) & low
    return (h ^ (h >> 16)) & 1 == 1


def walk(read):
    """{position: (index in the read or None where deleted)} and the events at the bases before them."""
    at, i, places, events, before = read["pos"], 0, {}, [], ""
    for n, op in re.findall(r"(\d+)([MIDNSHP=X])", read["cigar"]):
        n = int(n)
        if op in "M=X":
            places |= {at + j: i + j for j in range(n)}
        if op == "D":
            places |= {at + j: None for j in range(n)}
        if op in "ID" and before and before in "M=X":
            events.append((at - 1, read["seq"][i : i + n].upper() if op == "I" else "", n if op == "D" else 0))
        at, i = at + n * (op in "MDN=X"), i + n * (op in "MIS=X")
        before = before if op == "P" else op
    return places, events


def expected(reads, overlaps=True):
    seen, events = [], collections.Counter()
    used = [r for r in reads if r["flag"] & 0x704 == 0 and r["cigar"] not in (None, "*") and r["seq"] != "*"]
    quals = {id(r): [ord(c) - 33 for c in ("" if r["qual"] in (None, "*") else r["qual"])] + [30] * len(r["seq"]) for r in used}
    values = {}
    for r in used:
        places, found = walk(r)
        for e in found:
            events[r["sample"], r["chrom"], *e] += 1
        values[id(r)] = {p: [r["seq"][i].upper(), quals[id(r)][i]] if i is not None else ["-", 0] for p, i in places.items()}
    for a, b in itertools.combinations(used, 2) if overlaps else ():
        pair = all(x["flag"] & 10 == 2 and x["mate_chrom"] in ("=", x["chrom"]) and x["mate_pos"] == y["pos"] for x, y in ((a, b), (b, a)))
        if not pair or (a["sample"], a["chrom"], a["qname"]) != (b["sample"], b["chrom"], b["qname"]):
            continue
        a, b = (a, b) if (a["pos"], not a["flag"] & 64) < (b["pos"], not b["flag"] & 64) else (b, a)
        first = name_is_odd(a["qname"])
        va, vb = values[id(a)], values[id(b)]
        for p in va.keys() & vb.keys():
            (ba, qa), (bb, qb) = va[p], vb[p]
            if ba == "-" or bb == "-":
                va[p][1], vb[p][1] = (int(qa * 0.8) if first else 0), (0 if first else int(qb * 0.8))
            elif ba == bb:
                va[p][1], vb[p][1] = (min(qa + qb, 200), 0) if first else (0, min(qa + qb, 200))
            elif qa != qb:
                va[p][1], vb[p][1] = (int(qa * 0.8), 0) if qa > qb else (0, int(qb * 0.8))
            else:
                va[p][1], vb[p][1] = (int(qa * 0.8), 0) if first else (0, int(qb * 0.8))
    for r in used:
        seen += [(r["sample"], r["chrom"], p, b, q, r["mapq"], r["flag"] & 16 != 0, "S" in r["cigar"]) for p, (b, q) in values[id(r)].items() if b != "-"]
    return sorted(seen), events


def random_reads(seed, n=150):
    rnd, reads = random.Random(seed), []

    def cigar():
        parts = [f"{rnd.randint(1, 4)}S"] if rnd.random() < 0.3 else []
        for k in range(rnd.randint(1, 4)):
            parts += [rnd.choice(["1P2I", "3I", "2D", "30N", "2I1D", "1D1I"])] if k else []
            parts += [f"{rnd.randint(1, 9)}{rnd.choice('MM=X')}"]
        return "".join(parts + (["2H"] if rnd.random() < 0.1 else []))

    for i in range(n):
        where = sorted(rnd.randint(1, 60) for _ in range(2)) if rnd.random() < 0.8 else [rnd.randint(1, 60)] * 2
        proper, sample, chrom = rnd.random() < 0.85, f"s{rnd.randint(0, 1)}", f"c{rnd.randint(0, 1)}"
        for k in range(2):
            c = cigar()
            length = sum(int(x) for x, op in re.findall(r"(\d+)([A-Z=])", c) if op in "MIS=X")
            flag = 1 + 2 * proper + (64 if k == 0 else 128) + 16 * (rnd.random() < 0.5) + 0x400 * (rnd.random() < 0.05)
            quality = rnd.choice(["*", None, "".join(chr(33 + rnd.randint(0, 120 if i % 9 == 0 else 6)) if i % 9 else "~" for _ in range(length))])
            reads.append(dict(sample=sample, qname=f"read{i}", flag=flag, chrom=chrom, pos=where[k], mapq=rnd.randint(0, 70), cigar=c, mate_chrom=rnd.choice(["=", chrom]), mate_pos=where[1 - k], seq="".join(rnd.choice("ACGTacgtN") for _ in range(length)), qual=quality))
    return reads


def table(spark, reads):
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in READS.split(", ")) for r in reads], READS)


def test_observations_equal_loops(spark):
    for seed in (1, 2):
        reads = random_reads(seed)
        used = pileup.usable(table(spark, reads))
        for overlaps in (True, False):
            got = pileup.observations(used, overlaps).select("sample", "chrom", "pos", "base", "q", "mapq", "reverse", "clipped").collect()
            assert sorted(map(tuple, got)) == expected(reads, overlaps)[0]
        events = {(r.sample, r.chrom, r.pos, r.inserted, r.deleted): r.n for r in pileup.indels(used).collect()}
        assert events == dict(expected(reads)[1])


def test_counts_and_records_equal_loops(spark):
    reads = random_reads(3)
    seen = expected(reads)[0]
    counts = pileup.depths(pileup.observations(pileup.usable(table(spark, reads))))
    good = [x for x in seen if x[3] in "ACGT" and x[4] >= 1]
    got = {(r.sample, r.chrom, r.pos): r for r in counts.collect()}
    assert set(got) == {x[:3] for x in seen}
    shares = collections.defaultdict(lambda: [0.0] * 4)
    for key, r in got.items():
        mine = [x for x in good if x[:3] == key]
        sums = [sum(max(4, min(x[4], x[5], 60, 63)) for x in mine if x[3] == b) for b in "ACGT"]
        assert (r.raw_depth, r.depth, r.qs) == (sum(x[:3] == key for x in seen), len(mine), sums)
        assert r.adf == [sum(x[3] == b and not x[6] for x in mine) for b in "ACGT"] and r.adr == [sum(x[3] == b and x[6] for x in mine) for b in "ACGT"]
        assert (r.mq0, r.clipped) == (sum(x[5] == 0 for x in mine), sum(x[7] for x in mine))
        if mine:
            shares[key[1:]] = [s + q / sum(sums) for s, q in zip(shares[key[1:]], sums, strict=True)]
    bases = "".join(random.Random(4).choice("ACGTN") for _ in range(70))
    reference = spark.createDataFrame([("c0", 1, bases), ("c1", 1, bases[:40])], "chrom string, first long, bases string")
    records = {(r.chrom, r.pos): r for r in pileup.records(counts, reference).collect()}
    assert set(records) == set(shares)
    for (chrom, pos), r in records.items():
        ref = (bases if chrom == "c0" else bases[:40]).ljust(pos, "N")[pos - 1]
        share = dict(zip("ACGT", shares[chrom, pos], strict=True))
        others = sorted((b for b in "ACGT" if b != ref and share[b] > 0), key=lambda b: (-round(share[b], 9), -ord(b)))
        assert (r.ref, r.alts) == (ref, others), (chrom, pos)
        assert all(abs(x - share.get(b, 0)) < 1e-9 for x, b in zip(r.qs, [ref, *others], strict=True))
        here = [x for x in good if x[1:3] == (chrom, pos)]
        assert r.dp4 == [sum((x[3] == ref) is own and x[6] is rev for x in here) for own in (True, False) for rev in (False, True)]
        assert r.dp == sum(x[1:3] == (chrom, pos) for x in seen) and abs(r.mq0f - sum(x[5] == 0 for x in here) / len(here)) < 1e-9
        for c in r.calls:
            assert c.ad == [sum(x[0] == c.sample and x[3] == b for x in here) for b in [ref, *others]] and c.dp == sum(x[0] == c.sample for x in here)


def test_indels_become_records(spark):
    one = dict(sample="s", flag=0, chrom="c", pos=3, mapq=9, mate_chrom="*", mate_pos=0, qual="*")
    reads = [one | dict(qname=f"a{i}", cigar="2M2D2M", seq="GTCC") for i in range(3)] + [one | dict(qname="b", cigar="2M2I2M", seq="GTTTAC"), one | dict(qname="c", cigar="1S2I3M", seq="AAAGTA")]
    reference = spark.createDataFrame([("c", 1, "AC"), ("c", 3, "GTACCC")], "chrom string, first long, bases string")
    events = pileup.indels(pileup.usable(table(spark, reads)))
    got = {tuple(r)[:6] for r in pileup.indel_records(events, reference).collect()}
    assert got == {("c", 4, "TAC", "T", 3, 3), ("c", 4, "T", "TTT", 1, 1)}
    assert pileup.indel_records(events, reference, 2).count() == 1


def test_names_that_repeat_and_reads_without_bases(spark):
    left = dict(sample="s", qname="n", flag=1 + 2 + 64, chrom="c", pos=1, mapq=9, cigar="4M", mate_chrom="=", mate_pos=3, seq="ACGT", qual="IIII")
    right = left | dict(flag=1 + 2 + 128, pos=3, mate_pos=1, seq="GTAC")
    seen = pileup.observations(pileup.usable(table(spark, [left, left, left, right, right])))
    q = sorted(seen.where("pos = 3").agg(F.collect_list("q")).first()[0])
    assert q == [0, 0, 40, 80, 80]
    odd = [left | dict(cigar="*"), left | dict(cigar=None), left | dict(seq="*"), left | dict(pos=None), left | dict(flag=4), left | dict(qname=None, mate_pos=None), left | dict(qname="*")]
    assert pileup.observations(pileup.usable(table(spark, odd))).count() == 8
    nothing = pileup.observations(pileup.usable(table(spark, [])))
    reference = spark.createDataFrame([], "chrom string, first long, bases string")
    assert pileup.records(pileup.depths(nothing), reference).count() == 0 and pileup.indel_records(pileup.indels(pileup.usable(table(spark, []))), reference).count() == 0


def test_sam_text(spark, tmp_path):
    (tmp_path / "x.sam").write_text("@HD\tVN:1.6\n@RG\tID:g1\tSM:ann\n@RG\tID:g2\tSM:bob\nr1\t99\tc\t5\t60\t4M\t=\t7\t6\tACGT\tIIII\tNM:i:1\tRG:Z:g1\nr1\t147\tc\t7\t60\t4M\t=\t5\t-6\tGTAA\tIIII\tRG:Z:g2\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII\n@odd\t0\tc\t9\t1\t2M\td\t9\t0\tAC\t*\n")
    (tmp_path / "y.sam").write_text("@RG\tID:g1\tSM:cy\nr3\t0\tc\t1\t7\t2M\t*\t0\t0\tAC\t*\tRG:Z:g1\n")
    rows = {(r.qname, r.flag): r for r in read_sam(spark, str(tmp_path)).collect()}
    assert len(rows) == 5 and [rows[k].sample for k in (("r1", 99), ("r1", 147), ("r2", 4), ("@odd", 0), ("r3", 0))] == ["ann", "bob", "x", "x", "cy"]
    assert (rows["r1", 99].nm, rows["r1", 99].mate_chrom, rows["r1", 99].mate_pos, rows["r2", 4].chrom, rows["@odd", 0].mate_chrom) == (1, "c", 7, None, "d")
    counts = pileup.depths(pileup.observations(pileup.usable(read_sam(spark, str(tmp_path)))))
    assert counts.count() == 4 + 4 + 2 + 2
