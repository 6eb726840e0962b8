"""Queries of pileup, calling, conversion and sequence models."""

from __future__ import annotations

from pyspark.sql import functions as F

from allelix.operators import hmm, intervals, models
from allelix.plans import fixtures as fx
from allelix.plans.registry import query
from allelix.sources import vcf

S, G, R, AB = (f"WITH {x} " for x in (fx.SITES, f"{fx.SITES}, {fx.GTS}", f"{fx.SITES}, {fx.REGIONS}", f"{fx.SITES}, {fx.SETS}"))
K = ", ".join(fx.KEY)
READ_COLUMNS = {"chrom": "chrom", "start": "pos", "seq": "substr('ACGTACGTACGT', CAST(1 + l_partkey % 4 AS INT), 8)", "mapq": "info_dp", "flag": "CAST((l_orderkey % 2) * 16 + CASE WHEN l_partkey % 19 = 0 THEN 1024 ELSE 0 END AS INT)"}
READS = f"reads AS (SELECT {', '.join(f'{e} AS {n}' for n, e in READ_COLUMNS.items())} FROM sites)"
PILE = f"{READS}, bases AS (SELECT *, CAST(start + i AS INT) AS pos, substr(seq, CAST(i + 1 AS INT), 1) AS base FROM (SELECT *, unnest(range(0, 8)) AS i FROM reads WHERE mapq >= 5 AND flag & 1796 = 0))"


def _reads(spark, sf_dir):
    return fx.sites(spark, sf_dir).selectExpr(*(f"{e} AS {n}" for n, e in READ_COLUMNS.items()))


@query(f"{S}, {PILE} SELECT chrom, pos, count(*) AS depth, count_if(base = 'A') AS n_a, count_if(base = 'C') AS n_c, count_if(base = 'G') AS n_g, count_if(base = 'T') AS n_t, count_if(flag & 16 <> 0) AS reverse, CAST(sum(mapq) AS BIGINT) AS mapq_sum FROM bases GROUP BY chrom, pos")
def mpileup_counts(spark, sf_dir):
    return models.pileup(_reads(spark, sf_dir), 5)


@query(f"{S}, {PILE}, c AS (SELECT chrom, pos, count_if(base = 'A') AS n_ref, count_if(base <> 'A') AS n_alt FROM bases GROUP BY chrom, pos), p AS (SELECT *, [n_alt * 20, (n_ref + n_alt) * 3, n_ref * 20] AS x FROM c), q AS (SELECT *, list_transform(x, lambda v: v - list_min(x)) AS y FROM p) SELECT chrom, pos, ['0/0', '0/1', '1/1'][list_position(y, 0)] AS gt, least(list_sort(y)[2], 127) AS gq FROM q")
def call_genotypes(spark, sf_dir):
    counts = models.pileup(_reads(spark, sf_dir), 5).select("chrom", "pos", F.col("n_a").alias("n_ref"), (F.col("depth") - F.col("n_a")).alias("n_alt"))
    return models.call_biallelic(counts).select("chrom", "pos", "gt", "gq")


@query(f"{G}, w AS (SELECT {K}, list(gt ORDER BY sample_id) AS g FROM gts GROUP BY ALL), d AS (SELECT *, substr(g[3], 1, 1) AS a, substr(g[3], 3, 1) AS b FROM w WHERE len(list_filter([g[1], g[2], g[3]], lambda x: length(x) = 3 AND x NOT LIKE '%.%')) = 3) SELECT ((g[1] LIKE '%' || a || '%' AND g[2] LIKE '%' || b || '%') OR (g[1] LIKE '%' || b || '%' AND g[2] LIKE '%' || a || '%')) AS consistent, count(*) AS n FROM d GROUP BY 1")
def trio_consistency(spark, sf_dir):
    fits = models.mendelian(F.col("calls"), 2, 0, 1)
    return fx.variants(spark, sf_dir).select(fits.alias("consistent")).where("consistent IS NOT NULL").groupBy("consistent").agg(F.count("*").alias("n"))


@query(f"{S}, b AS (SELECT chrom, pos, unnest(list_concat([ref], list_filter(string_split(alt, ','), lambda a: regexp_full_match(a, '[ACGT]')))) AS b FROM sites WHERE length(ref) = 1), k AS (SELECT chrom, pos, array_to_string(list_sort(list_distinct(list(b))), '') AS bases FROM b GROUP BY chrom, pos) SELECT chrom, pos, bases, CASE bases {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in models.IUPAC.items())} ELSE bases END AS code FROM k")
def consensus_codes(spark, sf_dir):
    return models.consensus_bases(fx.sites(spark, sf_dir))


@query(f"{R}, c AS (SELECT s.*, EXISTS (SELECT 1 FROM regions r WHERE r.chrom = s.chrom AND s.pos <= r.end_ AND s.pos + length(s.ref) - 1 >= r.beg) AS coding FROM sites s), e AS (SELECT coding, ref, unnest(string_split(alt, ',')) AS a FROM c) SELECT CASE WHEN NOT coding THEN 'intergenic' WHEN a LIKE '<%' THEN 'feature_truncation' WHEN a = '.' THEN 'reference' WHEN (length(a) - length(ref)) % 3 <> 0 THEN 'frameshift' WHEN length(a) > length(ref) THEN 'inframe_insertion' WHEN length(a) < length(ref) THEN 'inframe_deletion' ELSE 'coding_sequence' END AS consequence, count(*) AS n FROM e GROUP BY 1")
def csq_classes(spark, sf_dir):
    sites = fx.sites(spark, sf_dir).select("chrom", "pos", "ref", "alt")
    rows = intervals.marked(sites, fx.regions(spark, sf_dir), "coding").select("ref", "coding", F.explode(F.split("alt", ",")).alias("a"))
    return rows.groupBy(models.consequence(F.col("ref"), F.col("a"), F.col("coding")).alias("consequence")).agg(F.count("*").alias("n"))


@query(f"{AB}, a2 AS (SELECT DISTINCT chrom, pos, ref, alt, 1 AS m FROM a), b2 AS (SELECT DISTINCT chrom, pos, ref, alt, 2 AS m FROM b), k AS (SELECT sum(m) AS mask FROM (SELECT * FROM a2 UNION ALL SELECT * FROM b2) GROUP BY chrom, pos, ref, alt), n AS (SELECT count_if(mask = 3) AS tp, count_if(mask = 2) AS fp, count_if(mask = 1) AS fn FROM k) SELECT tp, fp, fn, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1 FROM n")
def accuracy_scores(spark, sf_dir):
    return models.accuracy(fx.set_a(spark, sf_dir), fx.set_b(spark, sf_dir), ["chrom", "pos", "ref", "alt"])


@query(f"WITH {fx.REGIONS}, e AS (SELECT chrom, unnest(range(beg, end_ + 1)) AS pos FROM regions) SELECT chrom, CAST(pos AS INT) AS pos, count(*) AS blocks FROM e GROUP BY chrom, pos")
def convert_expand_blocks(spark, sf_dir):
    bases = fx.regions(spark, sf_dir).select("chrom", F.explode(F.sequence("beg", "end_")).alias("pos"))
    return bases.groupBy("chrom", "pos").agg(F.count("*").alias("blocks"))


@query(f"{G} SELECT {K}, chrom || ':' || CAST(pos AS VARCHAR) || '_' || ref || '_' || alt || ' ' || CAST(pos AS VARCHAR) || ' ' || ref || ' ' || alt || string_agg(CASE WHEN gt IN ('0/0', '0|0') THEN ' 1 0 0' WHEN gt IN ('0/1', '0|1') THEN ' 0 1 0' WHEN gt = '1/1' THEN ' 0 0 1' ELSE ' 0.33 0.33 0.33' END, '' ORDER BY sample_id) AS line FROM gts WHERE alt NOT LIKE '%,%' AND alt NOT LIKE '<%' AND alt <> '.' GROUP BY chrom, pos, ref, alt, {K}")
def convert_gen(spark, sf_dir):
    rows = fx.variants(spark, sf_dir).where(~F.col("alt").rlike("[,<]") & (F.col("alt") != "."))
    shares = F.transform("calls", lambda c: F.when(c["gt"].isin("0/0", "0|0"), " 1 0 0").when(c["gt"].isin("0/1", "0|1"), " 0 1 0").when(c["gt"] == "1/1", " 0 0 1").otherwise(" 0.33 0.33 0.33"))
    return rows.select(*fx.KEY, F.concat(F.concat_ws("", "chrom", F.lit(":"), "pos", F.lit("_"), "ref", F.lit("_"), "alt", F.lit(" "), "pos", F.lit(" "), "ref", F.lit(" "), "alt"), F.array_join(shares, "")).alias("line"))


@query(f"{G} SELECT {K}, string_agg(CASE WHEN gt LIKE '%.%' THEN '? ?' WHEN length(gt) = 1 THEN gt || ' -' WHEN gt LIKE '%|%' THEN replace(gt, '|', ' ') ELSE substr(gt, 1, 1) || '* ' || substr(gt, 3, 1) || '*' END, ' ' ORDER BY sample_id) AS line FROM gts GROUP BY {K}")
def convert_hap(spark, sf_dir):
    one = lambda c: F.when(c["gt"].contains("."), "? ?").when(F.length(c["gt"]) == 1, F.concat(c["gt"], F.lit(" -"))).when(c["gt"].contains("|"), F.replace(c["gt"], F.lit("|"), F.lit(" "))).otherwise(F.concat(F.replace(c["gt"], F.lit("/"), F.lit("* ")), F.lit("*")))
    return fx.variants(spark, sf_dir).select(*fx.KEY, F.array_join(F.transform("calls", one), " ").alias("line"))


@query(f"{S} SELECT chrom || chr(9) || CAST(pos AS VARCHAR) || chr(9) || id || chr(9) || ref || chr(9) || alt || chr(9) || coalesce(regexp_replace(regexp_replace(printf('%.6f', qual), '0+$', ''), '\\.$', ''), '.') || chr(9) || filter || chr(9) || 'DP=' || CAST(info_dp AS VARCHAR) AS line FROM sites")
def vcf_lines(spark, sf_dir):
    sites = fx.sites(spark, sf_dir)
    return sites.select(vcf.lines(sites).alias("line"))


_NUMBERS = ["l_discount * l_tax / 7", "l_extendedprice * 97", "-l_tax / 3000 * l_discount", "l_quantity * 100000 + 0.5", "l_extendedprice * 1e30 * l_tax"]
_SHOWN = ", ".join(f"printf('%g', CAST(CAST({e} AS FLOAT) AS DOUBLE)) AS v{i}" for i, e in enumerate(_NUMBERS))


@query(f"SELECT {K}, {_SHOWN} FROM lineitem".replace("printf('%g', CAST(CAST(-l_tax / 3000 * l_discount AS FLOAT) AS DOUBLE))", "replace(printf('%g', CAST(CAST(-l_tax / 3000 * l_discount AS FLOAT) AS DOUBLE)), '-0', CASE WHEN l_tax * l_discount = 0 THEN '0' ELSE '-0' END)"))
def vcf_numbers(spark, sf_dir):
    """Numbers as records show them: small, large, negative, and ties between two last digits."""
    rows = fx.table(spark, sf_dir, "lineitem")
    return rows.select(*fx.KEY, *(vcf.shown_number(F.expr(e.replace("1e30", "1e30D"))).alias(f"v{i}") for i, e in enumerate(_NUMBERS)))


@query()
def roh_segments(spark, sf_dir):
    return models.autozygous_segments(fx.genotypes(spark, sf_dir))


@query()
def polysomy_components(spark, sf_dir):
    return models.mixture_components(fx.genotypes(spark, sf_dir).select("chrom", F.col("dp").alias("bin")), 61)


_RARE = "0.1"
_HW = f"(p0 * (1 - af) * (1 - af) + 2 * p1 * af * (1 - af) + p2 * af * af)"
_STEP = "CAST(round(ln({}) * 1000000) AS BIGINT)"
_KEPT = "pow(1 - 0.02 - 0.01, gap)"
_UP, _DOWN = f"(0.02 / 0.03 * (1 - {_KEPT}))", f"(0.01 / 0.03 * (1 - {_KEPT}))"
_WAY = "held.v{i} + site.t{i}{j}"


def _next(j: int) -> str:
    stay, change = _WAY.format(i=0, j=j), _WAY.format(i=1, j=j)
    return f"v{j} := greatest({stay}, {change}) + site.e{j}, s{j} := CASE WHEN {stay} >= {change} THEN held.s0 ELSE held.s1 END || '{j}'"


#: The whole contig decoded site by site; paths are strings of states.
ROH_SQL = f"""{G}, one AS (SELECT * FROM gts WHERE alt NOT LIKE '%,%' AND alt NOT LIKE '<%' AND alt <> '.' QUALIFY row_number() OVER (PARTITION BY chrom, pos, sample_id ORDER BY {K}) = 1),
n AS (SELECT *, sum(CASE WHEN gt IN ('0/1', '0|1', '1') THEN 1 WHEN gt = '1/1' THEN 2 ELSE 0 END) OVER (PARTITION BY chrom, pos) / nullif(sum(CASE WHEN gt = './.' THEN 0 WHEN gt = '1' THEN 1 ELSE 2 END) OVER (PARTITION BY chrom, pos), 0)::DOUBLE AS af FROM one),
p AS (SELECT *, CASE WHEN gt = '0/0' THEN 1 - 2 * {_RARE} ELSE {_RARE} END AS p0, CASE WHEN gt IN ('0/1', '0|1') THEN 1 - 2 * {_RARE} ELSE {_RARE} END AS p1, CASE WHEN gt = '1/1' THEN 1 - 2 * {_RARE} ELSE {_RARE} END AS p2
  FROM n WHERE gt IN ('0/0', '0/1', '0|1', '1/1') AND af > 0 AND af < 1),
g AS (SELECT *, pos - lag(pos, 1, pos) OVER (PARTITION BY sample_id, chrom ORDER BY pos) AS gap FROM p),
e AS (SELECT sample_id, chrom, pos, {_STEP.format(_HW)} AS e0, {_STEP.format("(p0 * (1 - af) + p2 * af)")} AS e1, {_STEP.format(f"(1 - {_UP})")} AS t00, {_STEP.format(f"greatest({_UP}, 1e-300)")} AS t01, {_STEP.format(f"greatest({_DOWN}, 1e-300)")} AS t10, {_STEP.format(f"(1 - {_DOWN})")} AS t11 FROM g),
l AS (SELECT sample_id, chrom, list(struct_pack(v0 := 0::BIGINT, s0 := '', v1 := 0::BIGINT, s1 := '', e0 := e0, e1 := e1, t00 := t00, t01 := t01, t10 := t10, t11 := t11) ORDER BY pos) AS x, list(pos ORDER BY pos) AS places FROM e GROUP BY ALL),
f AS (SELECT sample_id, chrom, places, list_reduce(list_prepend(struct_pack(v0 := x[1].e0, s0 := '0', v1 := x[1].e1, s1 := '1', e0 := 0::BIGINT, e1 := 0::BIGINT, t00 := 0::BIGINT, t01 := 0::BIGINT, t10 := 0::BIGINT, t11 := 0::BIGINT), x[2:]),
  lambda held, site: struct_pack({_next(0)}, {_next(1)}, e0 := 0::BIGINT, e1 := 0::BIGINT, t00 := 0::BIGINT, t01 := 0::BIGINT, t10 := 0::BIGINT, t11 := 0::BIGINT)) AS r FROM l),
s AS (SELECT sample_id, chrom, unnest(places) AS pos, unnest(string_split(CASE WHEN r.v0 >= r.v1 THEN r.s0 ELSE r.s1 END, '')) AS state FROM f),
i AS (SELECT *, row_number() OVER (PARTITION BY sample_id, chrom ORDER BY pos) - row_number() OVER (PARTITION BY sample_id, chrom, state ORDER BY pos) AS island FROM s)
SELECT sample_id, chrom, CAST(min(pos) AS INT) AS beg, CAST(max(pos) AS INT) AS end_, count(*) AS n FROM i WHERE state = '1' GROUP BY sample_id, chrom, island"""


@query(ROH_SQL)
def roh_spans(spark, sf_dir):
    """Autozygous runs of each sample, by frequencies of its own cohort, decoded in spans of 2,000 positions."""
    rows = fx.genotypes(spark, sf_dir).where(~F.col("alt").rlike("[,<]") & (F.col("alt") != "."))
    one = rows.groupBy("chrom", "pos", "sample_id").agg(F.min_by("gt", F.struct(*fx.KEY)).alias("gt"))
    held = F.when(F.col("gt").isin("0/1", "0|1", "1"), 1).when(F.col("gt") == "1/1", 2).otherwise(0)
    counts = one.groupBy("chrom", "pos").agg((F.sum(held) / F.nullif(F.sum(F.when(F.col("gt") == "./.", 0).when(F.col("gt") == "1", 1).otherwise(2)), F.lit(0))).alias("af"))
    scored = hmm.autozygosity_scores(one.join(counts, ["chrom", "pos"]), 10.0)
    return hmm.segments(hmm.decode(scored, 0.02, 0.01, 2000)).select("sample_id", "chrom", "beg", "end_", "n")
