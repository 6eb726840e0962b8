"""Operators on small inputs, and every registered query against its SQL on the smallest tables."""

import gzip
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from allelix.functions import expressions, formats
from allelix.functions import variants as V
from allelix.operators import annotate, intervals, islands, models, normalize, sets
from allelix.plans import catalog
from allelix.sources import tables, vcf

SF = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events".split()


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 6)
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    want = duck.sql(catalog.oracle_sql()[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    key = lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=key)
    theirs = sorted((tuple(plain(x) for x in r) for r in duck.sql(f"SELECT {', '.join(columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()), key=key)
    assert mine == theirs


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_region_specs():
    assert intervals.parse_region("chr1:1,000-2k") == ("chr1", 1000, 2000)
    assert intervals.parse_region("chr1:5-") == ("chr1", 5, None)
    assert intervals.parse_region("chr1:7") == ("chr1", 7, 7)
    assert intervals.parse_region("chrX") == ("chrX", 1, None)
    for bad in ("", "chr1:9-3"):
        with pytest.raises(ValueError):
            intervals.parse_region(bad)


@pytest.mark.parametrize("mode", [0, 1, 2])
def test_overlap_across_bins(spark, mode):
    rng = np.random.default_rng(mode)
    recs = [(f"c{i % 2}", int(rng.integers(1, 300)), "A" * int(rng.integers(1, 40)), "<DEL>" if i % 7 == 0 else "C" * int(rng.integers(1, 60)), i) for i in range(150)]
    regs = [(f"c{i % 2}", b := int(rng.integers(1, 300)), b + int(rng.integers(-1, 30))) for i in range(25)]
    records, regions = spark.createDataFrame(recs, "chrom string, pos int, ref string, alt string, k int"), spark.createDataFrame(regs, "chrom string, beg int, end_ int")

    def stop(r):
        n = 1 if mode == 0 else len(r[2]) if mode == 1 else max(len(r[2]), 0 if r[3][0] == "<" else len(r[3]))
        return r[1] + n - 1

    pairs = [(r[4], g[1], g[2]) for r in recs for g in regs if g[0] == r[0] and g[1] <= g[2] and r[1] <= g[2] and stop(r) >= g[1]]
    inner = intervals.overlap(records, regions, mode, "inner", 16).select("k", "region_beg", "region_end").collect()
    assert sorted(map(tuple, inner)) == sorted(pairs)
    hits = {p[0] for p in pairs}
    assert sorted(r.k for r in intervals.overlap(records, regions, mode, "left_semi", 16).collect()) == sorted(hits)
    assert sorted(r.k for r in intervals.overlap(records, regions, mode, "left_anti", 16).collect()) == sorted(set(range(150)) - hits)


def test_expression_language(spark):
    calls = "array<struct<sample_id: int, gt: string, dp: int>>"
    rows = [("c1", 5, "rs1", "A", "T,C", 50.0, "PASS", 10, ["T", "C"], [(0, "0/1", 5), (1, "1/1", 30), (2, "./.", None)]), ("c2", 6, ".", "A", "G", None, "q10;s50", 90, ["G"], [(0, "0|0", 60), (1, "1", 2), (2, "1/2", 9)])]
    df = spark.createDataFrame(rows, f"chrom string, pos int, id string, ref string, alt string, qual double, filter string, info_dp int, alts array<string>, calls {calls}")
    schema = expressions.Schema({"QUAL": "qual", "POS": "pos", "DP1": "info_dp"}, {"CHROM": "chrom", "ID": "id", "REF": "ref", "ALT": "alt", "FILTER": "filter"}, {"DP": "dp"})

    def passing(text):
        truth = expressions.compile_filter(text, schema)
        return [r.pos for r in df.where(truth.site).collect()]

    for text, want in {
        "QUAL>=50": [5], "30<QUAL": [5], "QUAL!=50": [6], "QUAL=50": [5], "!(QUAL>10)": [6], "POS%2==0": [6], "POS/0>5": [5, 6], "-POS<-5": [6], 'ALT="C"': [5], 'ID!="rs1"': [6],
        'FILTER="PASS"': [], 'FILTER="."': [5], 'FILTER~"q10"': [6], 'FILTER="s50;q10"': [6], 'CHROM~"1$"': [5], 'CHROM!~"1$"': [6], "FMT/DP>50": [6], "FMT/DP[0]>50": [6], "FMT/DP[1]<5 | POS=5": [5, 6],
        'GT="hom" & FMT/DP>50': [6], 'GT="het" & FMT/DP>10': [], 'GT="het" && FMT/DP>10': [5, 6], 'GT="mis"': [5], 'GT="hap"': [6], 'GT="Aa"': [6], 'GT!="mis" & FMT/DP<3': [6],
        "N_PASS(FMT/DP>8)=2": [6], "F_PASS(FMT/DP>8)>0.5": [6], "MAX(FMT/DP)=30": [5], "COUNT(FMT/DP)=2": [5], "MEDIAN(FMT/DP)=9": [6], "sMAX(FMT/DP)=30": [5], "STDEV(FMT/DP)>20": [6], "abs(-3)=3 & POS=5": [5],
    }.items():
        assert passing(text) == want, text
    mask = expressions.compile_filter('GT="alt" & FMT/DP>4', schema).mask
    assert [r.m for r in df.select(mask.alias("m")).collect()] == [[True, True, False], [False, False, True]]
    for bad in ("QUAL>", "NOPE=1", "QUAL>1)", 'QUAL="x"', "(QUAL>1)+2", "nope(QUAL)"):
        with pytest.raises(expressions.ExpressionError):
            expressions.compile_filter(bad, schema)


def test_format_language(spark):
    df = spark.createDataFrame([("c", 1, None, [("0/1", 3)])], "chrom string, pos int, qual double, calls array<struct<gt: string, dp: int>>")
    assert df.select(formats.compile_format("%CHROM\\t%QUAL 100%[ %GT/%DP]\\n", {}).alias("x")).first().x == "c\t. 100% 0/1/3\n"
    for bad in ("[a", "a]", "[[a]]", "%NOPE"):
        with pytest.raises(formats.FormatError):
            formats.compile_format(bad, {})


def test_alleles(spark):
    df = spark.createDataFrame([("A", "T"), ("AC", "GT"), ("AC", "AT"), ("A", "AT"), ("ATG", "A"), ("AC", "GTT"), ("A", "."), ("A", "<DEL>"), ("A", "*")], "r string, a string")
    assert [x.t for x in df.select(V.allele_type(F.col("r"), F.col("a")).alias("t")).collect()] == ["snp", "mnp", "snp", "indel", "indel", "other", "ref", "symbolic", "overlap"]
    cut = [tuple(x.t) for x in spark.createDataFrame([(10, "GCAT", "GCT"), (10, "AAA", "AA"), (10, "CTT", "CTG"), (10, "A", "<X>")], "p int, r string, a string").select(V.trimmed(F.col("p"), F.col("r"), F.col("a")).alias("t")).collect()]
    assert cut == [(11, "CA", "C"), (10, "AA", "A"), (12, "T", "G"), (10, "A", "<X>")]
    got = spark.range(1).select(V.gather_genotypes(F.array(*map(F.lit, range(6))), F.array(F.lit(0), F.lit(2))).alias("g"), V.gather(F.array(*map(F.lit, range(3))), F.array(F.lit(0), F.lit(2))).alias("r")).first()
    assert (got.g, got.r) == ([0, 3, 5], [0, 2])
    for k, n in ((0, 0), (2, 10), (5, 10), (7, 9)):
        low = min(k, n - k)
        want = min(1.0, 2 * sum(math.comb(n, i) for i in range(low + 1)) / 2**n) if n else 0.0
        assert abs(spark.range(1).select(V.binomial_two_sided(F.lit(k), F.lit(n)).alias("p")).first().p - want) < 1e-12


def test_sets_and_annotation(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "k int") for xs in ([1, 2, 3], [2, 3, 4]))
    both = sets.presence([a, b], ["k"])
    pick = lambda w: sorted(r.k for r in both.where(sets.matches(F.col("mask"), w, 2)).collect())
    assert (pick("=2"), pick("+1"), pick("-1"), pick("~10")) == ([2, 3], [1, 2, 3, 4], [1, 4], [1])
    recs = spark.createDataFrame([("c", 10, "GCAT", "GCT")], "chrom string, pos int, ref string, alt string")
    src = spark.createDataFrame([("c", 11, "CA", "C", "hit", 2), ("c", 11, "CA", "C", "later", 3)], "chrom string, pos int, ref string, alt string, tag string, o int")
    assert annotate.canonical(recs, src, ["tag"], ["o"]).first().tag == "hit"
    row = spark.range(1).select(*(f(F.lit(h), F.lit(n)).alias(f.__name__) for f, h, n in ((annotate.only_missing, ".", "x"), (annotate.only_present, ".", "x"), (annotate.replaced, "a", "x"), (annotate.appended, "a;x", "x;y")))).first()
    assert tuple(row) == ("x", ".", "x", "a;x;y")
    ok = normalize.check_reference(recs, spark.createDataFrame([("c", 10, "g")], "chrom string, pos int, base string")).first()
    assert ok.ref_ok is True


def test_models(spark):
    rng = np.random.default_rng(1)
    emissions, steps, start = rng.standard_normal((6, 2)), rng.standard_normal((6, 2, 2)), np.zeros(2)
    import itertools

    value = lambda p: start[p[0]] + emissions[0, p[0]] + sum(steps[i, p[i - 1], p[i]] + emissions[i, p[i]] for i in range(1, 6))
    assert tuple(models.viterbi(emissions, steps, start)) == max(itertools.product((0, 1), repeat=6), key=value)
    calls = [(0, "c", i * 1000, "0/0" if 40 <= i < 120 or i % 2 else "0/1") for i in range(160)]
    found = models.autozygous_segments(spark.createDataFrame(calls, "sample_id int, chrom string, pos int, gt string"), het=0.5).collect()
    assert len(found) == 1 and abs(found[0].beg - 40_000) <= 3000 and abs(found[0].end_ - 119_000) <= 3000
    values = [("one", int(x)) for x in rng.normal(30, 4, 800)] + [("two", int(x)) for x in np.concatenate([rng.normal(15, 3, 400), rng.normal(45, 3, 400)])]
    out = {r.chrom: r for r in models.mixture_components(spark.createDataFrame(values, "chrom string, bin int"), 61).collect()}
    assert out["one"].components == 1 and out["two"].components == 2 and abs(out["two"].low_mean - 15) < 1.5 and abs(out["two"].high_mean - 45) < 1.5


def test_text_sources_round_trip(spark, tmp_path):
    rows = [("c2", 5, "rs1", "A", "T", 50.5, "PASS", 7, [("0/1", 3), ("./.", 0)]), ("c1", 9, ".", "AC", "A,<DEL>", None, ".", 8, [("1", 1), ("0|0", 2)])] * 20
    df = spark.createDataFrame(rows, "chrom string, pos int, id string, ref string, alt string, qual double, filter string, info_dp int, calls array<struct<gt: string, dp: int>>")
    vcf.write_vcf(df, f"{tmp_path}/out", ["c1", "c2"], ["S1", "S2"])
    text = "\n".join(r.value for r in spark.read.text(f"{tmp_path}/out").collect()) + "\n"
    body = "".join(line + "\n" for line in text.splitlines() if not line.startswith("#"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.vcf").write_text("##x\n#CHROM\n" + body)
    with gzip.open(tmp_path / "in/b.vcf.gz", "wt") as f:
        f.write(body)
    spark.dataSource.register(vcf.VcfDataSource)
    read = spark.read.format("vcf").option("split", 100).load(f"{tmp_path}/in")
    assert read.count() == 80
    got = {(r.chrom, r.pos, r.qual, r.info, tuple(r.samples)) for r in read.collect()}
    assert got == {("c2", 5, 50.5, "DP=7", ("0/1:3", "./.:0")), ("c1", 9, None, "DP=8", ("1:1", "0|0:2"))}
    assert read.select(vcf.info_map(F.col("info")).alias("m")).first().m == {"DP": read.first().info[3:]}
    (tmp_path / "r.bed").write_text("#c\nc1\t0\t10\n")
    assert tuple(tables.read_regions(spark, f"{tmp_path}/r.bed").first()) == ("c1", 1, 10)
    (tmp_path / "x.fa").write_text(">c1 text\nACG\nt\n>c2\nGG\n")
    fasta = tables.read_fasta(spark, f"{tmp_path}/x.fa")
    assert sorted(map(tuple, fasta.collect())) == [("c1", "ACGT"), ("c2", "GG")]
    assert sorted(map(tuple, tables.reference_bases(fasta, 3).collect())) == [("c1", 0, "ACG"), ("c1", 1, "T"), ("c2", 0, "GG")]
    (tmp_path / "p.ped").write_text("f kid dad mum 1\nf dad 0 0 1\n")
    assert [tuple(r) for r in tables.read_pedigree(spark, f"{tmp_path}/p.ped").collect()] == [("f", "kid", "dad", "mum", "1"), ("f", "dad", None, None, "1")]


def _runs(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(3)


def _chains(positions, gap):
    groups = []
    for p in positions:
        if groups and p - groups[-1][-1] <= gap:
            groups[-1].append(p)
        else:
            groups.append([p])
    return groups


@pytest.mark.parametrize("span", [1, 4, 16, 1 << 14])
def test_islands_do_not_depend_on_spans(spark, span):
    rng = np.random.default_rng(span)
    pos = sorted(rng.choice(np.arange(1, 130), 90, replace=False).tolist())
    dp = [int(x) for x in rng.choice([3, 12, 14], 90)]
    rows = [("a", p, d) for p, d in zip(pos, dp, strict=True)] + [("b", p, 3) for p in range(1, 60)] + [("b", None, 3)]
    want = [("b", 1, 59, 3, 59)]
    for i, (p, d) in enumerate(zip(pos, dp, strict=True)):
        if i and p == pos[i - 1] + 1 and d // 10 == dp[i - 1] // 10:
            _, beg, _, low, n = want[-1]
            want[-1] = ("a", beg, p, min(low, d), n + 1)
        else:
            want.append(("a", p, p, d, 1))
    got = islands.depth_blocks(_runs(spark, rows, "chrom string, pos int, dp int"), 10, span).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)
    # one indel of each cluster, and SNPs apart from indels
    kinds = [("A", "C") if x else ("A", "AT") for x in rng.random(90) < 0.6]
    quals = [None if q < 2 else float(q) for q in rng.integers(0, 6, 90)]
    records = [("a", p, r, a, q, i) for i, (p, (r, a), q) in enumerate(zip(pos, kinds, quals, strict=True))]
    sites = _runs(spark, records, "chrom string, pos int, ref string, alt string, qual double, k int")
    indels = [r for r in records if r[3] == "AT"]
    for gap in (0, 1, 3, 9):
        far = [r[5] for r in records if r[3] == "C" and all(abs(r[1] - x[1]) > gap for x in indels)]
        assert sorted(r.k for r in islands.snp_gap(sites, gap, span).collect()) == far
        best = [min((r for r in indels if r[1] in c), key=lambda r: (-(-1.0 if r[4] is None else r[4]), r[1])) for c in _chains([r[1] for r in indels], gap)]
        assert sorted(r.k for r in islands.indel_gap(sites, gap, ["k"], span).collect()) == sorted(r[5] for r in best)


@pytest.mark.parametrize(("span", "block"), [(1, 2), (8, 7), (1 << 14, 1 << 16)])
def test_moving_mean_and_numbers_do_not_depend_on_blocks(spark, span, block):
    pos = sorted(np.random.default_rng(block).choice(np.arange(1, 400), 60, replace=False).tolist())
    rows = _runs(spark, [("a", p, float(p % 7)) for p in pos] + [("b", 5, 1.0)], "chrom string, pos int, v double")
    got = {(r.chrom, r.pos): r.m for r in islands.moving_mean(rows, "v", 5, "m", block, span).collect()}
    want = {("a", p): np.mean([x % 7 for x in pos[max(0, i - 2) : i + 3]]) for i, p in enumerate(pos)} | {("b", 5): 1.0}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("span", [1, 5, 32, 1 << 22])
def test_merged_regions_and_blocks_do_not_depend_on_spans(spark, span):
    rng = np.random.default_rng(span)
    regions = [("a", int(b), int(b + n)) for b, n in zip(rng.integers(1, 300, 25), rng.integers(0, 12, 25), strict=True)]
    odd = [("a", 9, 3), ("a", None, 4), ("b", 10, 90), ("b", 12, 20)]
    for gap in (0, 3, 40):
        want = []
        for _, b, e in sorted(regions):
            if want and b <= want[-1][2] + gap + 1:
                want[-1] = ("a", want[-1][1], max(e, want[-1][2]))
            else:
                want.append(("a", b, e))
        got = intervals.merge_regions(_runs(spark, regions + odd, "chrom string, beg int, end_ int"), gap, span)
        assert sorted(tuple(r) for r in got.collect()) == [*want, ("b", 10, 90)]
    blocks = [("a", b, b + 6, s, b + s) for b in range(1, 300, 9) for s in (0, 1)]
    sites = [("a", int(p), int(s)) for p, s in zip(rng.choice(np.arange(1, 320), 80, replace=False), rng.integers(0, 2, 80), strict=True)]
    filled = intervals.fill_from_blocks(_runs(spark, sites, "chrom string, pos int, sample_id int"), _runs(spark, blocks, "chrom string, pos int, end_ int, sample_id int, dp int"), span=span)
    held = {(s, p): dp for _, b, e, s, dp in blocks for p in range(b, e + 1)}
    assert {(r.sample_id, r.pos): r.block_dp for r in filled.collect()} == {(s, p): held.get((s, p)) for _, p, s in sites}


def test_numbers_are_shown_with_six_digits_and_even_ties(spark):
    values = [0.00123456, 0.0123456, 0.00034567, -0.00012345, 100000.5, 100001.5, 1234565.0, 999999.5, 9.9999995, 1e-5, 12.5, -0.0, 3e38, 123456.0, 0.1, 1e10]
    import numpy as np

    from allelix.sources import vcf

    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", vcf.shown_number(F.col("v")).alias("s")).collect()
    assert {r.i: r.s for r in rows} == {i: ("%g" % float(np.float32(v))).replace("-0", "-0" if v else "0") for i, v in enumerate(values)}
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (float("-inf"),)], "v double").select(vcf.shown_number(F.col("v")).alias("s")).collect()
    assert [r.s for r in odd] == [".", ".", "inf", "-inf"]


def test_overlaps_of_records_with_maps(spark):
    from allelix.operators import intervals

    rows = spark.createDataFrame([("c", 10, "A" * 500, {"DP": "3", "AF": None}, [{"x": 1}]), ("c", 10, "A" * 500, {"DP": "4", "AF": None}, None), ("c", 900, "A" * 500, {}, []), ("c", 10, "A" * 500, None, [])], "chrom string, pos int, ref string, info map<string,string>, more array<map<string,int>>")
    regions = spark.createDataFrame([("c", 300, 301)], "chrom string, beg int, end_ int")
    assert intervals.overlap(rows, regions, width=64).count() == 3 and intervals.overlap(rows, regions, how="left_anti", width=64).collect()[0].pos == 900


def test_binom_takes_the_alleles_of_the_genotype(spark):
    from allelix.functions import expressions as E

    call = "gt string, ad array<int>"
    rows = spark.createDataFrame([(1, [("0/2", [20, 0, 20])]), (2, [("0/1", [20, 0, 20])]), (3, [("./.", [20, 0, 20])]), (4, [("0/3", [5, 5])]), (5, [("1", [6, 6])]), (6, [(None, [6, 6])])], f"k int, calls array<struct<{call.replace('gt ', 'gt: ').replace('ad ', 'ad: ')}>>")
    schema = E.Schema({}, {}, {"AD": "ad"}, call_arrays=frozenset(["AD"]))
    truth = E.compile_filter("binom(FMT/AD)>0.5", schema)
    assert {r.k for r in rows.where(truth.site).collect()} == {1, 4, 5, 6}
