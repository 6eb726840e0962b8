"""The query of multiallelic calls; its SQL works sets, samples and genotypes out as rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from allelix.operators import calling
from allelix.plans import fixtures as fx
from allelix.plans.merges import calls_with_lists
from allelix.plans.registry import query

K = ", ".join(fx.KEY)
_QS = "CAST((info_dp * ({i} + 3) + l_partkey) % 11 AS DOUBLE) / 10"
_PRIOR = repr(calling.log_prior(fx.SAMPLES))
_FLOAT = "CAST(CAST({} AS FLOAT) AS DOUBLE)"
CALL_SQL = f"""WITH {fx.SITES}, s AS (SELECT {K}, info_dp, CASE WHEN alt = '.' THEN 1 ELSE length(alt) - length(replace(alt, ',', '')) + 2 END AS n, row_number() OVER () AS r FROM sites),
a AS (SELECT r, i, {_QS.format(i="i")} AS q FROM (SELECT *, unnest(range(n)) AS i FROM s)),
g AS (SELECT r, k AS sample, i, j, pow(10.0, -(((info_dp * 5 + (j + i * (i + 1) // 2) * 11 + k) % 97)) / 10.0) AS x FROM (SELECT *, unnest(range(i + 1)) AS j FROM (SELECT *, unnest(range(n)) AS i FROM (SELECT *, unnest([0, 1, 2, 3]) AS k FROM s)))),
t AS (SELECT r, sample, sum(x) AS total, count(*) AS m FROM g GROUP BY ALL HAVING sum(x) < count(*)), p AS (SELECT g.*, x / total AS v FROM g JOIN t USING (r, sample)),
z AS (SELECT r, [i] AS als, i * 1.0 AS o FROM a UNION ALL SELECT x.r, [x.i, y.i], 1000 + x.i * 10 + y.i FROM a x JOIN a y ON x.r = y.r AND y.i < x.i AND x.q > 0 AND y.q > 0
  UNION ALL SELECT x.r, [x.i, y.i, w.i], 2000 + x.i * 100 + y.i * 10 + w.i FROM a x JOIN a y ON x.r = y.r AND y.i < x.i AND x.q > 0 AND y.q > 0 JOIN a w ON w.r = x.r AND w.i < y.i AND w.q > 0),
e AS (SELECT z.r, o, als, a.i, CASE WHEN len(als) = 1 THEN 1.0 ELSE {_FLOAT.format("q / sum(q) OVER (PARTITION BY z.r, o)")} END AS f FROM (SELECT *, unnest(als) AS i FROM z) z JOIN a ON a.r = z.r AND a.i = z.i),
v AS (SELECT b.r, b.o, sample, sum(b.f * c.f * CASE WHEN b.i = c.i THEN 1.0 ELSE 2.0 END * p.v) AS val FROM e b JOIN e c ON b.r = c.r AND b.o = c.o AND c.i <= b.i JOIN p ON p.r = b.r AND p.i = b.i AND p.j = c.i GROUP BY ALL),
l AS (SELECT v.r, v.o, any_value(als) AS als, sum(ln(val)) + any_value(len(list_filter(als, lambda x: x > 0))) * ({_PRIOR}) AS lk FROM v JOIN z ON z.r = v.r AND z.o = v.o WHERE val > 0 GROUP BY v.r, v.o),
b AS (SELECT r, list_sort(arg_max(als, struct_pack(lk := lk, o := -o))) AS best, coalesce(max(CASE WHEN o = 0 THEN lk END), 0) AS rl, max(CASE WHEN o <> 0 THEN lk END) AS top FROM l GROUP BY r),
u AS (SELECT b.r, any_value(best) AS best, any_value(rl) AS rl, any_value(top) + ln(sum(exp(lk - top))) AS sl FROM b LEFT JOIN l ON l.r = b.r AND l.o <> 0 GROUP BY b.r),
c AS (SELECT *, list_sort(list_distinct(list_prepend(0, best))) AS kept, greatest(rl, coalesce(sl, rl)) AS m FROM u),
d AS (SELECT *, -4.34294 * (CASE WHEN len(kept) > 1 THEN rl ELSE coalesce(sl, -1e9) END - (m + ln(exp(rl - m) + exp(coalesce(sl - m, -1e9))))) AS qual FROM c),
h AS (SELECT d.r, p.sample, p.i, p.j, CASE WHEN p.i = p.j THEN p.i ELSE 1000 + p.i * 10 + p.j END AS o, CASE WHEN list_contains(best, p.i) AND list_contains(best, p.j) THEN p.v * {_FLOAT.format("x.q")} * {_FLOAT.format("y.q")} * CASE WHEN p.i = p.j THEN 1.0 ELSE 2.0 END ELSE 0.0 END AS w
  FROM d JOIN p USING (r) JOIN a x ON x.r = p.r AND x.i = p.i JOIN a y ON y.r = p.r AND y.i = p.j WHERE list_contains(kept, p.i) AND list_contains(kept, p.j)),
k AS (SELECT r, sample, sum(w) AS total, max(w) AS w, arg_max(struct_pack(i := i, j := j), struct_pack(w := w, o := -o)) AS g FROM h GROUP BY ALL),
y AS (SELECT d.r, q.sample, CASE WHEN k.r IS NULL THEN './.' WHEN len(kept) = 1 OR total <= 0 THEN '0/0' ELSE CAST(list_position(kept, g.j) - 1 AS VARCHAR) || '/' || CAST(list_position(kept, g.i) - 1 AS VARCHAR) END || ':' ||
  CAST(CAST(CASE WHEN k.r IS NULL OR len(kept) = 1 OR total <= 0 THEN 0 WHEN w / total >= 1 THEN 127 ELSE floor(least(-4.34294 * ln(1 - w / total), 127.0)) END AS INT) AS VARCHAR) AS call FROM d CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS sample) q LEFT JOIN k ON k.r = d.r AND k.sample = q.sample)
SELECT {K}, array_to_string(kept, ',') AS kept, round(qual, 3) AS qual, array_to_string(list(call ORDER BY sample), ' ') AS calls FROM s JOIN d USING (r) JOIN y USING (r) GROUP BY ALL"""


@query(CALL_SQL)
def call_multiallelic(spark, sf_dir):
    """Alleles, qualities and genotypes of all sites, from likelihoods of every genotype."""
    rows = calls_with_lists(fx.variants(spark, sf_dir))
    qs = F.expr(f"transform(sequence(0, size(alts)), i -> {_QS.format(i='i')})")
    called = calling.call_alleles(rows.withColumn("qs", qs), fx.SAMPLES)
    calls = F.array_join(F.transform("calls", lambda c: F.concat_ws(":", c["gt"], c["gq"].cast("string"))), " ")
    return called.select(*fx.KEY, F.array_join(F.col("kept").cast("array<string>"), ",").alias("kept"), F.round("qual", 3).alias("qual"), calls.alias("calls"))


@query()
def call_trios(spark, sf_dir):
    """The same sites with samples 2, 0 and 1 called together as child, father and mother."""
    rows = calls_with_lists(fx.variants(spark, sf_dir)).withColumn("qs", F.expr(f"transform(sequence(0, size(alts)), i -> {_QS.format(i='i')})"))
    called = calling.call_alleles(rows, fx.SAMPLES, trios=[(2, 0, 1)])
    calls = F.array_join(F.transform("calls", lambda c: F.concat_ws(":", c["gt"], c["gq"].cast("string"))), " ")
    return called.select(*fx.KEY, F.array_join(F.col("kept").cast("array<string>"), ",").alias("kept"), calls.alias("calls"))
