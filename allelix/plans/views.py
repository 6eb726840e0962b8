"""Queries of views, merges of samples, statistics of genotypes and the reference."""

from __future__ import annotations

from pyspark.sql import functions as F

from allelix.functions import variants as V
from allelix.operators import align, normalize, sets, views
from allelix.plans import fixtures as fx
from allelix.plans import merges
from allelix.plans.core import _ALLELES, _TYPES, CLASS
from allelix.plans.registry import query

K = ", ".join(fx.KEY)
WIDE = f"""WITH {fx.SITES}, {fx.GTS}, w AS (
 SELECT chrom, pos, ref, alt, id, qual, filter, info_dp, {K}, list(gt ORDER BY sample_id) AS g FROM gts GROUP BY ALL)"""
N_ALT = "(CASE WHEN alt = '.' THEN 0 ELSE len(string_split(alt, ',')) END)"
COUNTS = f"list_transform(range(1, {N_ALT} + 1), lambda k: len(list_filter({_ALLELES}, lambda x: x = CAST(k AS VARCHAR))))"
NREF = f"CAST(coalesce(list_sum({COUNTS}), 0) AS BIGINT)"
HET = "list_filter(g, lambda x: x IN ('0/1', '0|1', '1/2'))"
SUBSET = "[g[1], g[3]]"


def _view(sql: str, name: str):
    """Registers a predicate on the wide form: its records as keys."""

    def add(predicate):
        def run(spark, sf_dir):
            return fx.variants(spark, sf_dir).where(predicate()).select("chrom", "pos", *fx.KEY)

        return query(f"{WIDE} SELECT chrom, pos, {K} FROM w WHERE {sql}", name=name)(run)

    return add


_view(f"len({HET}) > 0", "view_genotype_het")(lambda: views.has_class(F.col("calls"), "het", "het_alt"))
_view("len(list_filter(g, lambda x: x = './.')) = 0", "view_genotype_not_missing")(lambda: ~views.has_class(F.col("calls"), "mis"))
_view("len(list_filter(g, lambda x: regexp_matches(x, '[1-9]'))) = 1", "view_private")(lambda: views.is_private(F.col("calls")))
_view("len(list_filter(g, lambda x: x LIKE '%/%')) = 0", "view_phased")(lambda: views.all_phased(F.col("calls")))
_view("len(list_filter(g, lambda x: x <> './.')) = 0", "view_uncalled")(lambda: views.is_uncalled(F.col("calls")))
_view(f"{NREF} >= 5", "view_min_ac")(lambda: views.count_of(F.col("calls"), F.size("alts")) >= 5)
_view(
    f"list_max(list_concat({COUNTS}, [len({_ALLELES}) - {NREF}])) >= 0.75 * len({_ALLELES})", "view_major_af"
)(lambda: views.count_of(F.col("calls"), F.size("alts"), "major") >= 0.75 * V.allele_number(F.col("calls")))
_view(f"least({NREF}, len({_ALLELES}) - {NREF}) = 2", "view_minor_ac")(lambda: views.count_of(F.col("calls"), F.size("alts"), "minor") == 2)
_view(f"len(list_intersect({_TYPES}, ['snp', 'mnp'])) > 0", "view_types")(
    lambda: F.exists(F.split("alt", ","), lambda a: V.allele_type(F.col("ref"), a).isin("snp", "mnp"))
)
_view(f"len(list_intersect({_TYPES}, ['indel', 'symbolic'])) = 0", "view_types_excluded")(
    lambda: ~F.exists(F.split("alt", ","), lambda a: V.allele_type(F.col("ref"), a).isin("indel", "symbolic"))
)
_view(f"{N_ALT} = 1", "view_biallelic")(lambda: F.size("alts") + 1 == 2)
_view("filter IN ('.', 'PASS')", "view_apply_filters")(lambda: F.col("filter").isin(".", "PASS"))


@query(f"""{WIDE}, s AS (SELECT chrom, pos, alt, {K}, {SUBSET} AS g FROM w)
SELECT chrom, pos, {K}, array_to_string({COUNTS}, ',') AS ac, CAST(len({_ALLELES}) AS INT) AS an FROM s""")
def view_sample_subset(spark, sf_dir):
    rows = views.keep_samples(fx.variants(spark, sf_dir), [0, 2])
    return rows.select("chrom", "pos", *fx.KEY, F.array_join(F.col("ac").cast("array<string>"), ",").alias("ac"), "an")


@query(f"""{WIDE}, s AS (SELECT *, string_split(alt, ',') AS a, list_filter(range(1, {N_ALT} + 1), lambda k: list_contains({_ALLELES}, CAST(k AS VARCHAR))) AS u FROM w)
SELECT chrom, pos, {K}, array_to_string(list_transform(u, lambda k: a[k]), ',') AS alt,
 array_to_string(list_transform(g, lambda x: CASE WHEN list_contains(u, 2) AND NOT list_contains(u, 1) THEN replace(x, '2', '1') ELSE x END), ' ') AS gts FROM s
 WHERE alt <> '.'""")
def view_trim_alts(spark, sf_dir):
    rows = views.without_unused_alts(fx.variants(spark, sf_dir).where("alt <> '.'"))
    return rows.select("chrom", "pos", *fx.KEY, F.array_join("alts", ",").alias("alt"), F.array_join(F.transform("calls", lambda c: c["gt"]), " ").alias("gts"))


@query(f"""{WIDE}, s AS (SELECT *, {N_ALT} AS n, list_filter(range(0, {N_ALT} + 1), lambda k: k = 0 OR list_contains({_ALLELES}, CAST(k AS VARCHAR))) AS u FROM w)
SELECT {K}, array_to_string(list_transform(range(0, 4), lambda c: array_to_string(list_transform(u, lambda k: CAST((info_dp + k * 7 + c * 3) % 41 AS VARCHAR)), ',') || ':' ||
 array_to_string(flatten(list_transform(range(1, len(u) + 1), lambda h: list_transform(range(1, h + 1), lambda l: CAST((info_dp * 5 + (u[l] + u[h] * (u[h] + 1) // 2) * 11 + c) % 97 AS VARCHAR)))), ',')), ' ') AS lists FROM s""")
def view_trim_lists(spark, sf_dir):
    """Depths and likelihoods of the alleles that some call holds."""
    rows = views.without_unused_alts(merges.calls_with_lists(fx.variants(spark, sf_dir)), {"ad": "R", "pl": "G"})
    joined = lambda v: F.array_join(v.cast("array<string>"), ",")
    return rows.select(*fx.KEY, F.array_join(F.transform("calls", lambda c: F.concat_ws(":", joined(c["ad"]), joined(c["pl"]))), " ").alias("lists"))


@query(f"""WITH {fx.SITES}, {fx.GTS}, c AS (SELECT {K}, {CLASS} AS cls FROM gts),
n AS (SELECT {K}, count_if(cls = 'hom_ref') AS rr, count_if(cls = 'het') AS ra, count_if(cls = 'hom_alt') AS aa FROM c GROUP BY {K}),
p AS (SELECT *, rr + ra + aa AS t, (2 * rr + ra) / (2.0 * (rr + ra + aa)) AS p FROM n WHERE rr + ra + aa > 0),
e AS (SELECT *, p * p * t AS e0, 2 * p * (1 - p) * t AS e1, (1 - p) * (1 - p) * t AS e2 FROM p)
SELECT {K}, rr, ra, aa, CASE WHEN e0 > 0 THEN (rr - e0) * (rr - e0) / e0 ELSE 0 END + CASE WHEN e1 > 0 THEN (ra - e1) * (ra - e1) / e1 ELSE 0 END
 + CASE WHEN e2 > 0 THEN (aa - e2) * (aa - e2) / e2 ELSE 0 END AS chi2 FROM e""")
def stats_hwe(spark, sf_dir):
    return views.hardy_weinberg(fx.genotypes(spark, sf_dir), fx.KEY)


@query(f"{WIDE} SELECT chrom, count(*) AS singletons FROM w WHERE {NREF} = 1 GROUP BY chrom")
def stats_singletons(spark, sf_dir):
    rows = fx.variants(spark, sf_dir).where(views.count_of(F.col("calls"), F.size("alts")) == 1)
    return rows.groupBy("chrom").agg(F.count("*").alias("singletons"))


_SIDE = "SELECT chrom, pos, ref, alt, sample_id, min(gt) AS gt FROM gts WHERE l_orderkey % 3 <> {} GROUP BY ALL"


@query(f"""WITH {fx.SITES}, {fx.GTS}, x AS (SELECT * EXCLUDE (gt), {CLASS} AS c FROM ({_SIDE.format(0)})), y AS (SELECT * EXCLUDE (gt), {CLASS} AS c FROM ({_SIDE.format(1)}))
SELECT x.sample_id, x.c AS left_class, y.c AS right_class, count(*) AS n FROM x JOIN y USING (chrom, pos, ref, alt, sample_id) GROUP BY ALL""")
def stats_concordance(spark, sf_dir):
    calls = fx.genotypes(spark, sf_dir)
    return views.concordance(calls.where("l_orderkey % 3 <> 0"), calls.where("l_orderkey % 3 <> 1"), ["chrom", "pos", "ref", "alt"])


@query(f"""WITH {fx.SITES}, {fx.SETS},
x AS (SELECT DISTINCT chrom, pos, unnest(string_split(alt, ',')) AS al, ref FROM a), y AS (SELECT DISTINCT chrom, pos, unnest(string_split(alt, ',')) AS al, ref FROM b)
SELECT 'some' AS collapse, count(*) AS n FROM (SELECT DISTINCT chrom, pos FROM x JOIN y USING (chrom, pos, ref, al))
UNION ALL SELECT 'all', count(*) FROM (SELECT chrom, pos FROM x INTERSECT SELECT chrom, pos FROM y)
UNION ALL SELECT 'snps', count(*) FROM (SELECT chrom, pos FROM x WHERE length(ref) = 1 AND length(al) = 1 AND al NOT IN ('.', '*') AND al <> ref
 INTERSECT SELECT chrom, pos FROM y WHERE length(ref) = 1 AND length(al) = 1 AND al NOT IN ('.', '*') AND al <> ref)""")
def isec_collapse(spark, sf_dir):
    alleles = [df.select("chrom", "pos", "ref", F.explode(F.split("alt", ",")).alias("al")) for df in (fx.set_a(spark, sf_dir), fx.set_b(spark, sf_dir))]
    snps = [df.where((F.length("ref") == 1) & (V.allele_type(F.col("ref"), F.col("al")) == "snp")) for df in alleles]
    some = sets.presence(alleles, ["chrom", "pos", "ref", "al"]).where("mask = 3").select("chrom", "pos").distinct().select(F.lit("some").alias("collapse"))
    shared = lambda inputs, name: sets.presence(inputs, ["chrom", "pos"]).where("mask = 3").select(F.lit(name).alias("collapse"))
    return some.union(shared(alleles, "all")).union(shared(snps, "snps")).groupBy("collapse").agg(F.count("*").alias("n"))


REFERENCE = "ACGTTTTTACACACAGGA"
BASE = "substr('" + REFERENCE + "', CAST(1 + ({p}) % 18 AS INT), 1)"
INDELS = f"""indels AS (SELECT chrom, pos, {K}, CAST(1 + l_linenumber % 3 AS INT) AS n, l_partkey % 2 = 0 AS deletion,
 {BASE.format(p="pos")} AS b0, {BASE.format(p="pos + 1")} || CASE WHEN l_linenumber % 3 >= 1 THEN {BASE.format(p="pos + 2")} ELSE '' END
 || CASE WHEN l_linenumber % 3 >= 2 THEN {BASE.format(p="pos + 3")} ELSE '' END AS s FROM sites)"""


def _indels(spark, sf_dir):
    rows = fx.sites(spark, sf_dir).withColumn("b0", F.expr(BASE.format(p="pos")))
    s = F.concat(*(F.when(F.col("l_linenumber") % 3 >= i, F.expr(BASE.format(p=f"pos + {i + 1}"))).otherwise("") for i in range(3)))
    rows = rows.withColumn("s", s)
    longer = F.concat("b0", "s")
    return rows.withColumn("ref", F.when(F.col("l_partkey") % 2 == 0, longer).otherwise(F.col("b0"))).withColumn("alt", F.when(F.col("l_partkey") % 2 == 0, F.col("b0")).otherwise(longer))


def _reference(spark):
    """Five contigs of 24,000 bases in pieces of 1,000."""
    pieces = spark.range(5 * 24).select(F.concat(F.lit("chr"), (F.col("id") % 5 + 1).cast("string")).alias("chrom"), (F.floor(F.col("id") / 5) * 1000 + 1).alias("first"))
    base = lambda p: F.substr(F.lit(REFERENCE), (p % 18 + 1).cast("int"), F.lit(1))
    return pieces.withColumn("bases", F.array_join(F.transform(F.sequence(F.col("first"), F.col("first") + 999), base), ""))


@query(f"""WITH {fx.SITES}, {INDELS}, k AS (SELECT *, coalesce(list_min(list_filter(range(0, least(pos, 256) - 1), lambda i: {BASE.format(p="pos - i")} <> substr(s, CAST(n - i % n AS INT), 1))), least(pos, 256) - 1) AS moved FROM indels),
t AS (SELECT *, CAST(moved % n AS INT) AS turn, {BASE.format(p="pos - moved")} AS anchor FROM k),
m AS (SELECT *, anchor || substr(s, n - turn + 1, turn) || substr(s, 1, n - turn) AS longer FROM t)
SELECT chrom, CAST(pos - moved AS INT) AS pos, CASE WHEN deletion THEN longer ELSE anchor END AS ref, CASE WHEN deletion THEN anchor ELSE longer END AS alt, {K} FROM m""")
def norm_left_align(spark, sf_dir):
    return align.left_align(_indels(spark, sf_dir).drop("alts"), _reference(spark), fx.KEY).select("chrom", "pos", "ref", "alt", *fx.KEY)


#: Every second 2,000 bases repeat two bases; elsewhere they are scattered.
_SPARSE = "CASE WHEN (({p}) - ({p}) % 2000) / 2000 % 2 = 1 THEN substr('AC', CAST(1 + ({p}) % 2 AS INT), 1) ELSE substr('ACGT', CAST(1 + (({p}) * ({p}) % 1009 + ({p}) % 97 * 3) % 4 AS INT), 1) END"
_LENGTH = "(1 + l_linenumber % 4)"


def _run(p: str, n: str) -> str:
    return " || ".join(f"CASE WHEN {n} > {i} THEN {_SPARSE.format(p=f'{p} + {i}')} ELSE '' END" for i in range(4))


@query(f"""WITH {fx.SITES}, base AS (SELECT p, {_SPARSE.format(p="p")} AS b FROM (SELECT unnest(range(1, 20020)) AS p)),
x AS (SELECT base.p, k.n, base.b <> o.b AS differs FROM base CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS n) k JOIN base o ON o.p = base.p + k.n),
m AS (SELECT p, n, coalesce(max(CASE WHEN differs THEN p END) OVER (PARTITION BY n ORDER BY p), 1) AS anchor FROM x),
s AS (SELECT chrom, pos, {K}, l_partkey % 2 = 0 AS deletion, {_LENGTH} AS n FROM sites),
t AS (SELECT s.*, anchor, {_SPARSE.format(p="anchor")} AS b, {_SPARSE.format(p="anchor")} || {_run("anchor + 1", "s.n")} AS longer FROM s JOIN m ON m.p = s.pos AND m.n = s.n)
SELECT chrom, CAST(anchor AS INT) AS pos, CASE WHEN deletion THEN longer ELSE b END AS ref, CASE WHEN deletion THEN b ELSE longer END AS alt, {K} FROM t""")
def norm_left_align_repeats(spark, sf_dir):
    """Deleted and doubled strings in repeats of 2,000 bases."""
    rows = fx.sites(spark, sf_dir).withColumn("_b", F.expr(_SPARSE.format(p="pos"))).withColumn("_l", F.expr(f"_b || {_run('pos + 1', _LENGTH)}"))
    deletion = F.col("l_partkey") % 2 == 0
    rows = rows.withColumn("ref", F.when(deletion, F.col("_l")).otherwise(F.col("_b"))).withColumn("alt", F.when(deletion, F.col("_b")).otherwise(F.col("_l")))
    return align.left_align(rows, _sparse_reference(spark), fx.KEY).select("chrom", "pos", "ref", "alt", *fx.KEY)


def _sparse_reference(spark):
    pieces = spark.range(5 * 21).select(F.concat(F.lit("chr"), (F.col("id") % 5 + 1).cast("string")).alias("chrom"), (F.floor(F.col("id") / 5) * 1000 + 1).alias("first"))
    return pieces.withColumn("bases", F.expr(f"array_join(transform(sequence(first, first + 999), p -> {_SPARSE.format(p='p')}), '')"))


_RB = BASE.format(p="pos")


@query(f"""{WIDE}, r AS (SELECT *, {_RB} || CASE WHEN length(ref) > 1 THEN {BASE.format(p="pos + 1")} || {BASE.format(p="pos + 2")} ELSE '' END AS f, CASE WHEN alt = '.' THEN [] ELSE string_split(alt, ',') END AS a FROM w),
s AS (SELECT *, CASE WHEN ref <> f AND list_contains(a, f) THEN list_position(a, f) ELSE 0 END AS k FROM r),
g AS (SELECT *, list_transform(g, lambda x: CASE WHEN k = 0 THEN x WHEN x LIKE '%|%' THEN array_to_string(list_transform(string_split(x, '|'), lambda y: CASE y WHEN '0' THEN CAST(k AS VARCHAR) WHEN CAST(k AS VARCHAR) THEN '0' ELSE y END), '|')
  ELSE array_to_string(list_transform(string_split(x, '/'), lambda y: CASE y WHEN '0' THEN CAST(k AS VARCHAR) WHEN CAST(k AS VARCHAR) THEN '0' ELSE y END), '/') END) AS h FROM s)
SELECT {K}, f AS ref, array_to_string(list_transform(a, lambda x, i: CASE WHEN i = k THEN ref ELSE x END), ',') AS alt, array_to_string(h, ' ') AS gts FROM g""")
def norm_set_ref(spark, sf_dir):
    """REF set to the reference's bases, ALTs and genotypes exchanged where an ALT has them."""
    rows = align.check_ref(fx.variants(spark, sf_dir), _reference(spark), fx.KEY, "set")
    return rows.select(*fx.KEY, "ref", F.array_join("alts", ",").alias("alt"), F.array_join(F.transform("calls", lambda c: c["gt"]), " ").alias("gts"))


@query(f"WITH {fx.SITES} SELECT chrom, count_if(substr(ref, 1, 1) = {BASE.format(p='pos')}) AS matching, count_if(substr(ref, 1, 1) <> {BASE.format(p='pos')}) AS mismatching FROM sites GROUP BY chrom")
def norm_check_ref(spark, sf_dir):
    rows = normalize.with_reference(fx.sites(spark, sf_dir), _reference(spark), 1)
    same = F.substring("ref", 1, 1) == F.col("before")
    return rows.groupBy("chrom").agg(F.count_if(same).alias("matching"), F.count_if(~same).alias("mismatching"))


_ONE = "SELECT chrom, pos, ref, {i} AS file, min_by(a, [a, g]) AS a, min_by(g, [a, g]) AS g FROM (SELECT chrom, pos, ref, CASE WHEN alt = '.' THEN [] ELSE string_split(alt, ',') END AS a, list(gt ORDER BY sample_id) AS g, {k} FROM gts WHERE l_orderkey % 3 <> {i} GROUP BY chrom, pos, ref, alt, {k}) GROUP BY chrom, pos, ref"


@query(f"""WITH {fx.SITES}, {fx.GTS}, r AS ({_ONE.format(i=0, k=K)} UNION ALL {_ONE.format(i=1, k=K)}),
u AS (SELECT chrom, pos, ref, list_sort(list_distinct(flatten(list(a)))) AS alts FROM r GROUP BY chrom, pos, ref),
e AS (SELECT u.*, f.file, s.sample_id FROM u CROSS JOIN (SELECT unnest([0, 1]) AS file) f CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS sample_id) s),
j AS (SELECT e.*, r.a, r.g[e.sample_id + 1] AS x FROM e LEFT JOIN r USING (chrom, pos, ref, file)),
n AS (SELECT *, list_transform(string_split_regex(x, '[/|]'), lambda v: CASE WHEN v IN ('.', '0') THEN v WHEN CAST(v AS INT) > len(a) THEN '.' ELSE CAST(list_position(alts, a[CAST(v AS INT)]) AS VARCHAR) END) AS y FROM j)
SELECT chrom, pos, ref, array_to_string(alts, ',') AS alt, file, sample_id, CASE WHEN x IS NULL THEN './.' WHEN x LIKE '%|%' THEN array_to_string(y, '|') ELSE array_to_string(y, '/') END AS gt FROM n""")
def merge_samples(spark, sf_dir):
    rows = fx.variants(spark, sf_dir)
    return views.merge_samples([rows.where("l_orderkey % 3 <> 0"), rows.where("l_orderkey % 3 <> 1")], fx.SAMPLES)
