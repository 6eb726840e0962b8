"""Queries over the derived variant views: each has a Spark plan and the same result as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from allelix.functions import expressions as X
from allelix.functions import formats
from allelix.functions import variants as V
from allelix.operators import annotate, intervals, islands, normalize, sets, similarity, statistics
from allelix.plans import fixtures as fx
from allelix.plans.registry import query

S, G, R, AB = (f"WITH {x} " for x in (fx.SITES, f"{fx.SITES}, {fx.GTS}", f"{fx.SITES}, {fx.REGIONS}", f"{fx.SITES}, {fx.SETS}"))
K = ", ".join(fx.KEY)

# one character of an allele pair list in SQL
_TYPE_SQL = """CASE WHEN {a} IN ('.', '<*>') OR {a} = {r} THEN 'ref' WHEN {a} = '*' THEN 'overlap' WHEN {a} LIKE '<%' THEN 'symbolic'
 WHEN length({r}) = length({a}) AND len(list_filter(range(1, length({r}) + 1), lambda i: substr({r}, i, 1) <> substr({a}, i, 1))) = 1 THEN 'snp'
 WHEN length({r}) = length({a}) THEN 'mnp' WHEN starts_with({a}, {r}) OR starts_with({r}, {a}) THEN 'indel' ELSE 'other' END"""
TYPE = _TYPE_SQL.format(a="a", r="ref")
ALTS = f"alts AS (SELECT *, unnest(string_split(alt, ',')) AS a, unnest(range(1, len(string_split(alt, ',')) + 1)) AS k FROM sites)"
CLASS = "CASE WHEN gt LIKE '%.%' THEN 'mis' WHEN gt NOT LIKE '%/%' AND gt NOT LIKE '%|%' THEN 'hap' WHEN gt IN ('0/0', '0|0') THEN 'hom_ref' WHEN substr(gt, 1, 1) = substr(gt, 3, 1) THEN 'hom_alt' WHEN gt LIKE '%0%' THEN 'het' ELSE 'het_alt' END"
HITS = """regions r WHERE r.chrom = s.chrom AND s.pos <= r.end_ AND s.pos + length(s.ref) - 1 >= r.beg"""


def _alts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.sites(spark, sf_dir).select("*", F.posexplode(F.split("alt", ",")).alias("k", "a"))


# scans, projections and predicates


@query(f"{S} SELECT chrom, pos, ref, alt, qual, {K} FROM sites WHERE qual > 500 AND filter = 'PASS'")
def view_filter(spark, sf_dir):
    return fx.sites(spark, sf_dir).where("qual > 500 AND filter = 'PASS'").select("chrom", "pos", "ref", "alt", "qual", *fx.KEY)


@query(f"{S} SELECT chrom || ':' || CAST(pos AS VARCHAR) || '\t' || ref || '>' || alt || '\t' || CASE WHEN filter = '.' THEN 'none' ELSE filter END AS line FROM sites")
def query_format_sites(spark, sf_dir):
    rows = fx.variants(spark, sf_dir).withColumn("FLT", F.when(F.col("filter") == ".", "none").otherwise(F.col("filter")))
    return rows.select(formats.compile_format("%CHROM:%POS\\t%REF>%ALT\\t%FLT", {"FLT": "FLT"}).alias("line"))


@query(f"{G} SELECT chrom || ' ' || CAST(pos AS VARCHAR) || string_agg(' s' || CAST(sample_id AS VARCHAR) || '=' || gt || ':' || CAST(dp AS VARCHAR), '' ORDER BY sample_id) AS line, {K} FROM gts GROUP BY chrom, pos, {K}")
def query_format_samples(spark, sf_dir):
    return fx.variants(spark, sf_dir).select(formats.compile_format("%CHROM %POS[ s%SAMPLE=%GT:%DP]", {}).alias("line"), *fx.KEY)


@query(f"{S} SELECT CASE WHEN id = '.' THEN 'novel' ELSE 'known' END AS kind, count(*) AS n FROM sites GROUP BY 1")
def view_known_novel(spark, sf_dir):
    return fx.sites(spark, sf_dir).groupBy(F.when(F.col("id") == ".", "novel").otherwise("known").alias("kind")).agg(F.count("*").alias("n"))


@query(f"{S} SELECT len(CASE WHEN alt = '.' THEN [] ELSE string_split(alt, ',') END) + 1 AS n_alleles, count(*) AS n FROM sites GROUP BY 1")
def view_allele_number(spark, sf_dir):
    return fx.variants(spark, sf_dir).groupBy((F.size("alts") + 1).cast("long").alias("n_alleles")).agg(F.count("*").alias("n"))


@query(f"{S}, {ALTS} SELECT {TYPE} AS type, count(*) AS n, CAST(sum(CASE WHEN a NOT LIKE '<%' AND a NOT IN ('.', '*') THEN length(a) - length(ref) END) AS BIGINT) AS length_sum FROM alts GROUP BY 1")
def variant_types(spark, sf_dir):
    rows = _alts(spark, sf_dir).select(V.allele_type(F.col("ref"), F.col("a")).alias("type"), V.indel_length(F.col("ref"), F.col("a")).alias("length"))
    return rows.groupBy("type").agg(F.count("*").alias("n"), F.sum("length").cast("long").alias("length_sum"))


@query(f"{S} SELECT chrom, pos, {K}, CASE WHEN qual IS NULL OR qual < 300 THEN CASE WHEN filter IN ('PASS', '.') THEN 'lowq' ELSE filter || ';lowq' END WHEN filter = '.' THEN 'PASS' ELSE filter END AS filter FROM sites")
def filter_soft(spark, sf_dir):
    return sets.soft_filter(fx.sites(spark, sf_dir), F.coalesce(F.col("qual") >= 300, F.lit(False)), "lowq").select("chrom", "pos", *fx.KEY, "filter")


@query(f"{G} SELECT {K}, sample_id, CASE WHEN dp < 20 THEN './.' ELSE gt END AS gt FROM gts")
def filter_set_genotypes(spark, sf_dir):
    calls = F.transform("calls", lambda c: F.struct(c["sample_id"].alias("sample_id"), F.when(c["dp"] < 20, "./.").otherwise(c["gt"]).alias("gt")))
    return fx.variants(spark, sf_dir).select(*fx.KEY, F.inline(calls))


SCHEMA = X.Schema(
    {"QUAL": "qual", "POS": "pos", "INFO_DP": "info_dp", "DPV": "array(cast(info_dp as double), cast(info_dp % 7 as double), cast(info_dp % 3 as double))"},
    {"CHROM": "chrom", "ID": "id", "REF": "ref", "ALT": "alt", "FILTER": "filter", "TAG": "tag"},
    {"DP": "dp", "AD": "ad"},
    flags={"FLAG": "flag"},
    call_arrays=frozenset({"AD"}),
)


def _filtered(text):
    def run(spark, sf_dir):
        rows = fx.variants(spark, sf_dir).withColumns({"flag": F.col("pos") % 3 == 0, "tag": F.when(F.col("pos") % 5 > 0, F.concat(F.lit("t"), (F.col("pos") % 5).cast("string")))})
        if "AD" in text:
            rows = fx.once(rows.withColumn("calls", F.transform("calls", lambda c: c.withField("ad", F.array(c["dp"] - F.floor(c["dp"] / 3), F.floor(c["dp"] / 3))))))
        return rows.where(X.compile_filter(text, SCHEMA).site).select("chrom", "pos", *fx.KEY)

    return run


_HET, _N_MIS = "(g[i] IN ('0/1', '0|1', '1/2'))", "len(list_filter(g, lambda x: x = './.'))"
_TYPES = "list_sort(list_distinct(list_transform(CASE WHEN alt = '.' THEN ['.'] ELSE string_split(alt, ',') END, lambda a: " + TYPE + ")))"
_ALLELES = "list_filter(flatten(list_transform(g, lambda x: string_split_regex(x, '[/|]'))), lambda x: x <> '.')"
#: Depths of the two alleles that a genotype names, or else the first two.
_DEPTH = "(CASE WHEN substr(g[s], {i}, 1) = '1' THEN d[s] - d[s] // 3 ELSE d[s] // 3 END)"
_PAIR = [f"(CASE WHEN regexp_full_match(g[s], '[01][/|][01]') THEN {_DEPTH.format(i=i)} ELSE {other} END)" for i, other in ((1, "d[s] // 3"), (3, "d[s] - d[s] // 3"))]
_BINOM = """CASE WHEN {n} = 0 THEN 0.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least({k}, {n} - {k}) + 1), lambda j: exp(lgamma({n} + 1) - lgamma(j + 1) - lgamma({n} - j + 1) - {n} * ln(2.0))))) END"""
_WIDE = f"{G}, w AS (SELECT chrom, pos, ref, alt, id, qual, filter, info_dp, {K}, list(gt ORDER BY sample_id) AS g, list(dp ORDER BY sample_id) AS d FROM gts GROUP BY ALL)"
for _name, _text, _sql in (
    ("numbers", "QUAL>600 && INFO_DP<=25", "qual > 600 AND info_dp <= 25"),
    ("missing", 'QUAL!=500 || ID="."', "coalesce(qual <> 500, true) OR id = '.'"),
    ("arithmetic", "(QUAL+INFO_DP*2)/3>=200 & POS%7=3", "(qual + info_dp * 2) / 3 >= 200 AND pos % 7 = 3"),
    ("any_sample", "FMT/DP>55", "len(list_filter(d, lambda x: x > 55)) > 0"),
    ("same_sample", 'GT="het" & FMT/DP>50', "len(list_filter(range(1, 5), lambda i: g[i] IN ('0/1', '0|1', '1/2') AND d[i] > 50)) > 0"),
    ("any_two_samples", 'GT="mis" && FMT/DP>50', "len(list_filter(g, lambda x: x = './.')) > 0 AND len(list_filter(d, lambda x: x > 50)) > 0"),
    ("n_pass", "N_PASS(FMT/DP<20)>=2", "len(list_filter(d, lambda x: x < 20)) >= 2"),
    ("f_pass", 'F_PASS(GT="RR")>0.5', "len(list_filter(g, lambda x: x = '0/0')) > 2"),
    ("reducers", "MAX(FMT/DP)-MIN(FMT/DP)<15 & AVG(FMT/DP)>10", "list_max(d) - list_min(d) < 15 AND list_avg(d) > 10"),
    ("strings", 'ALT="T,C" & CHROM~"[135]$"', "len(list_intersect(string_split(alt, ','), ['T', 'C'])) > 0 AND regexp_matches(chrom, '[135]$')"),
    ("filter_set", 'FILTER="q10" | !(QUAL>100)', "filter = 'q10' OR NOT coalesce(qual > 100, false)"),
    ("selected_sample", "FMT/DP[2]>=30", "d[3] >= 30"),
    ("flag", "FLAG && QUAL>300", "pos % 3 = 0 AND qual > 300"),
    ("not_flag", "!FLAG", "pos % 3 <> 0"),
    ("not_group", "!(FLAG) & POS>10000", "pos % 3 <> 0 AND pos > 10000"),
    ("genotype_upper", 'GT="HET" & FMT/DP>=58', f"len(list_filter(range(1, 5), lambda i: {_HET} AND d[i] >= 58)) > 0"),
    ("genotype_regex", 'N_PASS(GT~"^1")>=3', "len(list_filter(g, lambda x: x LIKE '1%')) >= 3"),
    ("missing_strings", "TAG=TAG", "true"),
    ("missing_string", 'TAG!="t2"', "pos % 5 <> 2"),
    ("type_equal", 'TYPE="snp"', f"{_TYPES} = ['snp']"),
    ("type_overlap", 'TYPE~"indel"', f"list_contains({_TYPES}, 'indel')"),
    ("lower_case_names", "qual>700 & n_alt=2", "qual > 700 AND alt LIKE '%,%'"),
    ("f_missing", "F_MISSING>=0.5 & N_SAMPLES=4", f"{_N_MIS} >= 2"),
    ("mac", "MAC=1", f"list_min(list_concat(list_transform(CASE WHEN alt = '.' THEN [] ELSE range(1, len(string_split(alt, ',')) + 1) END, lambda k: len(list_filter({_ALLELES}, lambda x: x = CAST(k AS VARCHAR)))), [len({_ALLELES}) - list_sum(list_transform(range(0, CASE WHEN alt = '.' THEN 1 ELSE len(string_split(alt, ',')) + 1 END), lambda k: CASE WHEN k = 0 THEN 0 ELSE len(list_filter({_ALLELES}, lambda x: x = CAST(k AS VARCHAR))) END))])) = 1"),
    ("ilen", "ILEN<0", "len(list_filter(string_split(alt, ','), lambda a: a NOT LIKE '<%' AND a NOT IN ('.', '*') AND length(a) < length(ref))) > 0"),
    ("values_of_samples", "FMT/AD[:1]>=19", "len(list_filter(d, lambda x: x // 3 >= 19)) > 0"),
    ("value_of_sample", "FMT/AD[1:0]>35", "d[2] - d[2] // 3 > 35"),
    ("range_of_samples", "FMT/DP[1-2]>=59", "d[2] >= 59 OR d[3] >= 59"),
    ("list_of_samples", "FMT/DP[0,3]<2", "d[1] < 2 OR d[4] < 2"),
    ("site_vector", "DPV[1-]=0", "info_dp % 7 = 0 OR info_dp % 3 = 0"),
    ("sums_within_samples", "sSUM(FMT/AD)=FMT/DP & FMT/DP>59", "len(list_filter(d, lambda x: x > 59)) > 0"),
    ("binomial", "binom(FMT/AD)>0.02 & FMT/DP>24", f"len(list_filter(range(1, 5), lambda s: d[s] > 24 AND ({_BINOM.format(k=_PAIR[0], n='(' + ' + '.join(_PAIR) + ')')}) > 0.02)) > 0"),
):
    query(f"{_WIDE} SELECT chrom, pos, {K} FROM w WHERE {_sql}", name=f"filter_expr_{_name}")(_filtered(_text))


# regions and positions


@query(f"{R} SELECT chrom, pos, {K} FROM sites s WHERE EXISTS (SELECT 1 FROM {HITS})")
def region_overlap_semi(spark, sf_dir):
    return intervals.overlap(fx.sites(spark, sf_dir), fx.regions(spark, sf_dir)).select("chrom", "pos", *fx.KEY)


@query(f"{R} SELECT chrom, pos, {K} FROM sites s WHERE NOT EXISTS (SELECT 1 FROM {HITS})")
def region_overlap_anti(spark, sf_dir):
    rows = fx.sites(spark, sf_dir).select("chrom", "pos", "ref", "alt", *fx.KEY)
    return intervals.overlap(rows, fx.regions(spark, sf_dir), how="left_anti").select("chrom", "pos", *fx.KEY)


@query(f"{R} SELECT s.chrom, r.beg AS region_beg, r.end_ AS region_end, count(*) AS n FROM sites s, {HITS} GROUP BY ALL")
def region_counts(spark, sf_dir):
    return intervals.overlap(fx.sites(spark, sf_dir), fx.regions(spark, sf_dir), how="inner").groupBy("chrom", "region_beg", "region_end").agg(F.count("*").alias("n"))


@query(f"{R}, m AS (SELECT *, max(end_) OVER (PARTITION BY chrom ORDER BY beg, end_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM regions), i AS (SELECT *, sum(CASE WHEN reach IS NULL OR beg > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY beg, end_) AS island FROM m) SELECT chrom, min(beg) AS beg, max(end_) AS end_ FROM i GROUP BY chrom, island")
def regions_merged(spark, sf_dir):
    return intervals.merge_regions(fx.regions(spark, sf_dir))


@query(f"{AB} SELECT 'and' AS op, count(*) AS n FROM (SELECT chrom, pos FROM a INTERSECT SELECT chrom, pos FROM b) UNION ALL SELECT 'or', count(*) FROM (SELECT chrom, pos FROM a UNION SELECT chrom, pos FROM b) UNION ALL SELECT 'not', count(*) FROM (SELECT chrom, pos FROM a EXCEPT SELECT chrom, pos FROM b)")
def position_sets(spark, sf_dir):
    both = sets.presence([fx.set_a(spark, sf_dir), fx.set_b(spark, sf_dir)], ["chrom", "pos"])
    # counted without a key: an operation that leaves no position has a row too
    counts = both.agg(F.count_if(F.col("mask") == 3).alias("and"), F.count("*").alias("or"), F.count_if(F.col("mask") == 1).alias("not"))
    return counts.unpivot([], ["and", "or", "not"], "op", "n")


@query(f"{S} SELECT chrom, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos FROM sites GROUP BY chrom")
def index_stats(spark, sf_dir):
    return fx.sites(spark, sf_dir).groupBy("chrom").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


@query(f"{S}, i AS (SELECT pos - 1 AS b, pos + length(ref) - 2 AS e FROM sites) SELECT CASE WHEN b >> 14 = e >> 14 THEN 4681 + (b >> 14) WHEN b >> 17 = e >> 17 THEN 585 + (b >> 17) WHEN b >> 20 = e >> 20 THEN 73 + (b >> 20) WHEN b >> 23 = e >> 23 THEN 9 + (b >> 23) ELSE 0 END AS bin, count(*) AS n FROM i GROUP BY 1")
def index_bins(spark, sf_dir):
    return fx.sites(spark, sf_dir).groupBy(V.variant_bin(F.col("pos"), F.col("pos") + F.length("ref") - 1).cast("long").alias("bin")).agg(F.count("*").alias("n"))


# sorts and limits


@query(f"{S}, o AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY pos, upper(ref), upper(alt), {K}) AS rn FROM sites) SELECT chrom, pos, ref, alt, rn FROM o WHERE rn <= 10")
def head_by_contig(spark, sf_dir):
    w = Window.partitionBy("chrom").orderBy("pos", F.upper("ref"), F.upper("alt"), *fx.KEY)
    return fx.sites(spark, sf_dir).withColumn("rn", F.row_number().over(w).cast("long")).where("rn <= 10").select("chrom", "pos", "ref", "alt", "rn")


@query(f"{S} SELECT chrom, pos, ref, alt, qual FROM sites WHERE qual IS NOT NULL ORDER BY qual DESC, chrom, pos, {K} LIMIT 100")
def top_quality(spark, sf_dir):
    return fx.sites(spark, sf_dir).where("qual IS NOT NULL").orderBy(F.desc("qual"), "chrom", "pos", *fx.KEY).limit(100).select("chrom", "pos", "ref", "alt", "qual")


# sets of files


@query(f"{AB}, k AS (SELECT chrom, pos, ref, alt, 1 AS bit FROM a UNION ALL SELECT chrom, pos, ref, alt, 2 FROM b), m AS (SELECT chrom, pos, ref, alt, bit_or(bit) AS mask FROM k GROUP BY ALL) SELECT mask, count(*) AS n FROM m GROUP BY mask")
def isec_exact(spark, sf_dir):
    return sets.presence([fx.set_a(spark, sf_dir), fx.set_b(spark, sf_dir)], ["chrom", "pos", "ref", "alt"]).groupBy("mask").agg(F.count("*").alias("n"))


@query(f"{AB} SELECT chrom, pos, ref, alt, {K} FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.chrom = b.chrom AND a.pos = b.pos AND a.ref = b.ref AND a.alt = b.alt)")
def isec_complement(spark, sf_dir):
    return fx.set_a(spark, sf_dir).join(fx.set_b(spark, sf_dir), ["chrom", "pos", "ref", "alt"], "left_anti").select("chrom", "pos", "ref", "alt", *fx.KEY)


@query(f"{AB}, u AS (SELECT * FROM a UNION ALL SELECT * FROM b), d AS (SELECT *, row_number() OVER (PARTITION BY chrom, pos, ref, alt ORDER BY {K}) AS rn FROM u) SELECT chrom, pos, ref, alt, {K} FROM d WHERE rn = 1")
def concat_distinct(spark, sf_dir):
    both = fx.set_a(spark, sf_dir).unionByName(fx.set_b(spark, sf_dir))
    return sets.first_of(both, ["chrom", "pos", "ref", "alt"], fx.KEY).select("chrom", "pos", "ref", "alt", *fx.KEY)


@query(f"{AB} SELECT chrom, count(*) AS n, CAST(sum(pos) AS BIGINT) AS pos_sum FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY chrom")
def concat_all(spark, sf_dir):
    return fx.set_a(spark, sf_dir).unionByName(fx.set_b(spark, sf_dir)).groupBy("chrom").agg(F.count("*").alias("n"), F.sum("pos").alias("pos_sum"))


@query(f"{AB}, u AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT chrom, pos, ref, alt, max(qual) AS qual, CAST(sum(info_dp) AS BIGINT) AS dp_sum, min(info_dp) AS dp_min, max(info_dp) AS dp_max, coalesce(array_to_string(list_sort(list_distinct(list(id) FILTER (id <> '.'))), ';'), '') AS id, coalesce(array_to_string(list_sort(list_distinct(list(filter) FILTER (filter NOT IN ('.', 'PASS')))), ';'), '') AS filter FROM u GROUP BY chrom, pos, ref, alt")
def merge_records(spark, sf_dir):
    return sets.merge_records([fx.set_a(spark, sf_dir), fx.set_b(spark, sf_dir)])


# normalisation


@query(f"{S}, {ALTS} SELECT chrom, pos, ref, a AS alt, CAST(k AS INT) AS alt_number, {K} FROM alts")
def norm_split(spark, sf_dir):
    return normalize.split_alleles(fx.variants(spark, sf_dir)).select("chrom", "pos", "ref", "alt", "alt_number", *fx.KEY)


@query(f"{G}, e AS (SELECT *, unnest(string_split(alt, ',')) AS a, unnest(range(1, len(string_split(alt, ',')) + 1)) AS k FROM gts) SELECT {K}, CAST(k AS INT) AS alt_number, sample_id, regexp_replace(regexp_replace(regexp_replace(gt, '[' || CASE k WHEN 1 THEN '2-9' ELSE '13-9' END || ']', '0', 'g'), CAST(k AS VARCHAR), 'x', 'g'), 'x', '1', 'g') AS gt FROM e")
def norm_split_genotypes(spark, sf_dir):
    return normalize.split_alleles(fx.variants(spark, sf_dir)).select(*fx.KEY, "alt_number", F.inline("calls")).select(*fx.KEY, "alt_number", "sample_id", "gt")


@query(f"{S}, {ALTS}, p AS (SELECT *, length(ref) AS lr, length(a) AS la FROM alts WHERE a NOT LIKE '<%' AND a NOT IN ('.', '*')), t AS (SELECT *, coalesce(list_min(list_filter(range(1, least(lr, la)), lambda i: substr(ref, lr - i + 1, 1) <> substr(a, la - i + 1, 1))) - 1, least(lr, la) - 1) AS tail FROM p), u AS (SELECT *, substr(ref, 1, lr - tail) AS r2, substr(a, 1, la - tail) AS a2 FROM t), h AS (SELECT *, coalesce(list_min(list_filter(range(1, least(length(r2), length(a2))), lambda i: substr(r2, i, 1) <> substr(a2, i, 1))) - 1, least(length(r2), length(a2)) - 1) AS head FROM u) SELECT chrom, CAST(pos + head AS INT) AS pos, substr(r2, head + 1) AS ref, substr(a2, head + 1) AS alt, {K}, CAST(k AS INT) AS alt_number FROM h")
def norm_trim(spark, sf_dir):
    rows = normalize.split_alleles(fx.variants(spark, sf_dir)).where(~F.col("alt").startswith("<") & ~F.col("alt").isin(".", "*"))
    return normalize.trim(rows).select("chrom", "pos", "ref", "alt", *fx.KEY, "alt_number")


@query(f"{S}, {ALTS}, m AS (SELECT * FROM alts WHERE length(ref) = length(a) AND length(ref) > 1 AND a NOT LIKE '<%'), e AS (SELECT *, unnest(range(1, length(ref) + 1)) AS i FROM m UNION ALL SELECT *, 1 AS i FROM alts WHERE length(ref) = 1 AND length(a) = 1 AND a NOT IN ('.', '*')) SELECT chrom, CAST(pos + i - 1 AS INT) AS pos, substr(ref, i, 1) AS ref, substr(a, i, 1) AS alt, {K} FROM e WHERE substr(ref, i, 1) <> substr(a, i, 1)")
def norm_atomize(spark, sf_dir):
    rows = normalize.split_alleles(fx.variants(spark, sf_dir)).where((F.length("ref") == F.length("alt")) & ~F.col("alt").startswith("<") & ~F.col("alt").isin(".", "*"))
    return normalize.atomize(rows).select("chrom", "pos", "ref", "alt", *fx.KEY)


@query(f"{S}, p AS (SELECT * FROM sites WHERE alt NOT LIKE '<%' AND alt <> '.'), l AS (SELECT chrom, pos, max(length(ref)) AS n FROM p GROUP BY chrom, pos), f AS (SELECT p.chrom, p.pos, n, max(ref) FILTER (length(ref) = n) AS longest, count(*) AS records FROM p JOIN l ON p.chrom = l.chrom AND p.pos = l.pos GROUP BY ALL), x AS (SELECT p.chrom, p.pos, p.ref, unnest(string_split(p.alt, ',')) AS a FROM p) SELECT f.chrom, f.pos, longest AS ref, array_to_string(list_sort(list_distinct(list(a || substr(longest, length(ref) + 1)))), ',') AS alt, max(records) AS records FROM f JOIN x ON f.chrom = x.chrom AND f.pos = x.pos GROUP BY f.chrom, f.pos, longest")
def norm_join(spark, sf_dir):
    return normalize.join_alleles(fx.sites(spark, sf_dir).where("alt NOT LIKE '<%' AND alt <> '.'"))


for _mode, _keys in (("exact", "chrom, pos, ref, alt"), ("all", "chrom, pos"), ("id", "chrom, pos, id")):

    def _dedup(spark, sf_dir, keys=_keys):
        return sets.first_of(fx.sites(spark, sf_dir), keys.split(", "), fx.KEY).select("chrom", "pos", "ref", "alt", *fx.KEY)

    query(f"{S}, d AS (SELECT *, row_number() OVER (PARTITION BY {_keys} ORDER BY {K}) AS rn FROM sites) SELECT chrom, pos, ref, alt, {K} FROM d WHERE rn = 1", name=f"norm_rmdup_{_mode}")(_dedup)


# annotation

PANEL = "panel AS (SELECT DISTINCT chrom, pos, ref, alt, 'k' || CAST(pos % 97 AS VARCHAR) AS tag, CAST(pos % 50 AS INT) AS score FROM sites WHERE l_orderkey % 4 = 0)"


def _panel(spark, sf_dir):
    return fx.sites(spark, sf_dir).where("l_orderkey % 4 = 0").selectExpr("chrom", "pos", "ref", "alt", "'k' || CAST(pos % 97 AS STRING) AS tag", "CAST(pos % 50 AS INT) AS score").distinct()


@query(f"{S}, {PANEL} SELECT s.chrom, s.pos, s.ref, s.alt, {', '.join('s.' + k for k in fx.KEY)}, p.tag, p.score FROM sites s LEFT JOIN panel p ON s.chrom = p.chrom AND s.pos = p.pos AND s.ref = p.ref AND s.alt = p.alt")
def annotate_exact(spark, sf_dir):
    return annotate.exact(fx.sites(spark, sf_dir), _panel(spark, sf_dir), ["tag", "score"], ["tag", "score"]).select("chrom", "pos", "ref", "alt", *fx.KEY, "tag", "score")


@query(f"{S}, {PANEL}, p2 AS (SELECT chrom, pos, ref, min(score) AS score FROM panel GROUP BY chrom, pos, ref) SELECT s.chrom, s.pos, {', '.join('s.' + k for k in fx.KEY)}, CASE WHEN id = '.' THEN 'v' || CAST(s.pos AS VARCHAR) ELSE id END AS id, coalesce(p2.score, -1) AS score, p2.score IS NOT NULL AS marked FROM sites s LEFT JOIN p2 ON s.chrom = p2.chrom AND s.pos = p2.pos AND s.ref = p2.ref")
def annotate_modes(spark, sf_dir):
    first = _panel(spark, sf_dir).groupBy("chrom", "pos", "ref").agg(F.min("score").alias("score"))
    joined = fx.sites(spark, sf_dir).join(first, ["chrom", "pos", "ref"], "left")
    return joined.select("chrom", "pos", *fx.KEY, annotate.only_missing(F.col("id"), F.concat(F.lit("v"), F.col("pos").cast("string"))).alias("id"), F.coalesce("score", F.lit(-1)).alias("score"), F.col("score").isNotNull().alias("marked"))


@query(f"{R} SELECT s.chrom, s.pos, {', '.join('s.' + k for k in fx.KEY)}, min(r.beg) AS region_beg FROM sites s LEFT JOIN regions r ON r.chrom = s.chrom AND s.pos <= r.end_ AND s.pos + length(s.ref) - 1 >= r.beg GROUP BY ALL")
def annotate_regions(spark, sf_dir):
    return annotate.by_region(fx.sites(spark, sf_dir), fx.regions(spark, sf_dir), fx.KEY).select("chrom", "pos", *fx.KEY, "region_beg")


# statistics


@query(f"""{S}, {ALTS}, t AS (SELECT *, {TYPE} AS type FROM alts), r AS (SELECT {K}, max(alt) AS alt, bool_or(type = 'snp') AS snp, bool_or(type = 'mnp') AS mnp, bool_or(type IN ('indel')) AS indel, bool_or(type IN ('other', 'symbolic')) AS other FROM t GROUP BY {K})
SELECT count(*) AS records, count_if(alt = '.') AS no_alts, count_if(snp) AS snps, count_if(mnp) AS mnps, count_if(indel) AS indels, count_if(other) AS others, count_if(alt LIKE '%,%') AS multiallelic FROM r""")
def stats_summary(spark, sf_dir):
    return statistics.summary(fx.sites(spark, sf_dir))


@query(f"{S}, {ALTS}, t AS (SELECT *, {TYPE} AS type FROM alts) SELECT r.x || '>' || s.x AS change, CAST(coalesce(sum(CASE WHEN type = 'snp' AND ref = r.x AND a = s.x THEN 1 END), 0) AS BIGINT) AS n FROM (SELECT unnest(['A', 'C', 'G', 'T']) AS x) r JOIN (SELECT unnest(['A', 'C', 'G', 'T']) AS x) s ON r.x <> s.x LEFT JOIN t ON ref = r.x AND a = s.x GROUP BY 1")
def stats_substitutions(spark, sf_dir):
    return statistics.substitutions(fx.sites(spark, sf_dir))


@query(f"{S}, {ALTS}, t AS (SELECT *, {TYPE} AS type, (ref IN ('A', 'G') AND a IN ('A', 'G')) OR (ref IN ('C', 'T') AND a IN ('C', 'T')) AS ts FROM alts) SELECT count_if(ts) AS ts, count_if(NOT ts) AS tv, count_if(ts AND k = 1) AS ts_first, count_if(NOT ts AND k = 1) AS tv_first FROM t WHERE type = 'snp' AND length(ref) = 1")
def stats_tstv(spark, sf_dir):
    return statistics.tstv(fx.sites(spark, sf_dir))


@query(f"{S} SELECT CAST(floor(qual) AS BIGINT) AS bin, count(*) AS n FROM sites GROUP BY 1")
def stats_quality(spark, sf_dir):
    return fx.sites(spark, sf_dir).groupBy(F.floor("qual").alias("bin")).agg(F.count("*").alias("n"))


@query(f"{S}, {ALTS}, t AS (SELECT *, {TYPE} AS type FROM alts) SELECT CAST(length(a) - length(ref) AS BIGINT) AS length, count(*) AS n FROM t WHERE type IN ('indel', 'other') GROUP BY 1")
def stats_indel_lengths(spark, sf_dir):
    return statistics.indel_lengths(fx.sites(spark, sf_dir))


@query(f"{G} SELECT least(dp // 5, 10) * 5 AS bin, count(*) AS n, count(*) * 1.0 / sum(count(*)) OVER () AS share FROM gts GROUP BY 1")
def stats_depth(spark, sf_dir):
    return statistics.depth_bins(fx.genotypes(spark, sf_dir), 5, 10)


@query(f"""{G}, {ALTS.replace('sites', 'sites')}, c AS (SELECT *, {CLASS} AS cls FROM gts) SELECT sample_id, count_if(cls = 'hom_ref') AS hom_ref, count_if(cls = 'hom_alt') AS hom_alt, count_if(cls IN ('het', 'het_alt')) AS het, count_if(cls = 'hap') AS hap, count_if(cls = 'mis') AS missing, CAST(sum(dp) AS BIGINT) AS depth FROM c GROUP BY sample_id""")
def stats_per_sample(spark, sf_dir):
    return statistics.per_sample(fx.genotypes(spark, sf_dir))


@query(f"{G}, c AS (SELECT {K}, count_if(gt NOT LIKE '%.%' AND (gt LIKE '%1%')) AS with_alt, CAST(sum(length(gt) - length(replace(gt, '1', ''))) AS INT) AS ac1, CAST(sum(length(gt) - length(regexp_replace(gt, '[0-9]', '', 'g'))) AS INT) AS an FROM gts GROUP BY {K}) SELECT {K}, ac1, an FROM c")
def allele_counts(spark, sf_dir):
    rows = fx.variants(spark, sf_dir)
    return rows.select(*fx.KEY, F.coalesce(F.get(V.allele_counts(F.col("calls"), F.greatest(F.size("alts"), F.lit(1))), F.lit(0)), F.lit(0)).alias("ac1"), V.allele_number(F.col("calls")).alias("an"))


@query(f"{G}, c AS (SELECT {K}, sum(length(gt) - length(replace(gt, '1', ''))) AS ac, sum(length(gt) - length(regexp_replace(gt, '[0-9]', '', 'g'))) AS an FROM gts GROUP BY {K}) SELECT CASE WHEN an = 0 THEN NULL WHEN ac = 1 THEN 0 ELSE CAST(ac * 100 // an AS BIGINT) END AS bin, count(*) AS n FROM c GROUP BY 1")
def stats_af_bins(spark, sf_dir):
    return statistics.af_bins(fx.variants(spark, sf_dir))


@query(f"{AB}, ka AS (SELECT DISTINCT chrom, pos, ref, alt FROM a), kb AS (SELECT DISTINCT chrom, pos, ref, alt FROM b), j AS (SELECT coalesce(ka.chrom, kb.chrom) AS chrom, ka.pos IS NOT NULL AS in_a, kb.pos IS NOT NULL AS in_b FROM ka FULL OUTER JOIN kb ON ka.chrom = kb.chrom AND ka.pos = kb.pos AND ka.ref = kb.ref AND ka.alt = kb.alt) SELECT chrom, count_if(in_a AND NOT in_b) AS only_a, count_if(in_b AND NOT in_a) AS only_b, count_if(in_a AND in_b) AS shared FROM j GROUP BY chrom")
def stats_two_files(spark, sf_dir):
    return statistics.two_files(fx.set_a(spark, sf_dir), fx.set_b(spark, sf_dir))


@query(f"{G}, c AS (SELECT {K}, sample_id, CASE WHEN gt NOT LIKE '%.%' THEN length(gt) - length(regexp_replace(gt, '[1-9]', '', 'g')) END AS d FROM gts) SELECT x.sample_id AS sample_a, y.sample_id AS sample_b, count(*) AS sites, count_if(x.d = y.d) AS matches, CAST(sum(abs(x.d - y.d)) AS BIGINT) AS discordance FROM c x JOIN c y ON {' AND '.join(f'x.{k} = y.{k}' for k in fx.KEY)} AND x.sample_id < y.sample_id WHERE x.d IS NOT NULL AND y.d IS NOT NULL GROUP BY 1, 2")
def gtcheck_pairs(spark, sf_dir):
    return similarity.sample_pairs(fx.variants(spark, sf_dir))


@query(f"{G}, c AS (SELECT {K}, sample_id, CASE WHEN gt NOT LIKE '%.%' THEN length(gt) - length(regexp_replace(gt, '[1-9]', '', 'g')) END AS d FROM gts), p AS (SELECT x.sample_id AS sample_a, y.sample_id AS sample_b, count_if(x.d = y.d) AS matches FROM c x JOIN c y ON {' AND '.join(f'x.{k} = y.{k}' for k in fx.KEY)} AND x.sample_id <> y.sample_id WHERE x.d IS NOT NULL AND y.d IS NOT NULL GROUP BY 1, 2) SELECT sample_a, sample_b, matches, row_number() OVER (PARTITION BY sample_a ORDER BY matches DESC, sample_b) AS rank FROM p QUALIFY rank <= 2")
def gtcheck_top(spark, sf_dir):
    return similarity.best_matches(similarity.sample_pairs(fx.variants(spark, sf_dir)), 2)


# order-dependent operators


@query(f"{S}, d AS (SELECT chrom, pos, min(info_dp) AS dp FROM sites GROUP BY chrom, pos), f AS (SELECT *, CASE WHEN pos = lag(pos) OVER w + 1 AND dp // 10 = lag(dp) OVER w // 10 THEN 0 ELSE 1 END AS new FROM d WINDOW w AS (PARTITION BY chrom ORDER BY pos)), i AS (SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY pos) AS island FROM f) SELECT chrom, min(pos) AS beg, max(pos) AS end_, min(dp) AS min_dp, count(*) AS n FROM i GROUP BY chrom, island")
def gvcf_blocks(spark, sf_dir):
    sites = fx.sites(spark, sf_dir).groupBy("chrom", "pos").agg(F.min("info_dp").alias("dp"))
    return islands.depth_blocks(sites, 10)


@query(f"{S}, {ALTS}, t AS (SELECT *, {TYPE} AS type FROM alts), x AS (SELECT DISTINCT chrom, pos FROM t WHERE type IN ('indel', 'other')), y AS (SELECT DISTINCT chrom, pos, {K} FROM t WHERE type = 'snp') SELECT chrom, pos, {K} FROM y WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.chrom = y.chrom AND x.pos BETWEEN y.pos - 3 AND y.pos + 3)")
def filter_snp_gap(spark, sf_dir):
    return islands.snp_gap(fx.sites(spark, sf_dir), 3).select("chrom", "pos", *fx.KEY)


@query(f"{S}, {ALTS}, t AS (SELECT *, {TYPE} AS type FROM alts), x AS (SELECT DISTINCT chrom, pos, qual, {K} FROM t WHERE type IN ('indel', 'other')), f AS (SELECT *, CASE WHEN pos - lag(pos) OVER w <= 2 THEN 0 ELSE 1 END AS new FROM x WINDOW w AS (PARTITION BY chrom ORDER BY pos, {K})), i AS (SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY pos, {K} ROWS UNBOUNDED PRECEDING) AS island FROM f) SELECT chrom, pos, {K} FROM i QUALIFY row_number() OVER (PARTITION BY chrom, island ORDER BY coalesce(qual, -1) DESC, pos, {K}) = 1")
def filter_indel_gap(spark, sf_dir):
    return islands.indel_gap(fx.sites(spark, sf_dir), 2, fx.KEY).select("chrom", "pos", *fx.KEY)


@query(f"{G}, blocks AS (SELECT chrom, pos, pos + 3 AS end_, sample_id, max(dp) AS dp FROM gts WHERE pos % 5 = 0 GROUP BY ALL), asked AS (SELECT DISTINCT chrom, pos, sample_id FROM gts WHERE pos % 5 <> 0) SELECT s.chrom, s.pos, s.sample_id, b.dp AS block_dp FROM asked s LEFT JOIN blocks b ON s.chrom = b.chrom AND s.sample_id = b.sample_id AND s.pos BETWEEN b.pos AND b.end_")
def merge_gvcf_fill(spark, sf_dir):
    rows = fx.genotypes(spark, sf_dir)
    blocks = rows.where("pos % 5 = 0").groupBy("chrom", "pos", "sample_id").agg(F.max("dp").alias("dp")).withColumn("end_", F.col("pos") + 3)
    return intervals.fill_from_blocks(rows.where("pos % 5 <> 0").select("chrom", "pos", "sample_id").distinct(), blocks)


@query(f"{S}, d AS (SELECT chrom, pos, avg(info_dp) AS dp FROM sites GROUP BY chrom, pos) SELECT chrom, pos, avg(dp) OVER (PARTITION BY chrom ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) AS smooth FROM d")
def moving_average(spark, sf_dir):
    return islands.moving_mean(fx.sites(spark, sf_dir).groupBy("chrom", "pos").agg(F.avg("info_dp").alias("dp")), "dp", 10, "smooth")
