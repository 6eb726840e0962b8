"""Queries of bias tests over windows of 200 positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from allelix.operators import bias
from allelix.plans import fixtures as fx
from allelix.plans.registry import query

S = f"WITH {fx.SITES}, o AS (SELECT chrom, pos // 200 AS site, info_dp AS v, l_partkey % 3 = 0 AS alt, (l_linenumber + l_partkey % 3) % 2 = 0 AS rev FROM sites)"


def _observations(spark, sf_dir):
    return fx.sites(spark, sf_dir).select("chrom", F.expr("pos div 200").alias("site"), F.col("info_dp").alias("v"), F.expr("l_partkey % 3 = 0").alias("alt"), F.expr("(l_linenumber + l_partkey % 3) % 2 = 0").alias("rev"))


@query(f"""{S}, r AS (SELECT *, rank() OVER (PARTITION BY chrom, site ORDER BY v) + (count(*) OVER (PARTITION BY chrom, site, v) - 1) / 2.0::DOUBLE AS mean_rank FROM o),
t AS (SELECT chrom, site, sum(c * (c * c - 1.0::DOUBLE)) AS ties FROM (SELECT chrom, site, v, count(*)::DOUBLE AS c FROM o GROUP BY ALL) GROUP BY ALL),
s AS (SELECT chrom, site, count_if(NOT alt)::DOUBLE AS r, count_if(alt)::DOUBLE AS a, coalesce(sum(CASE WHEN alt THEN mean_rank END), 0) AS w FROM r GROUP BY ALL),
v AS (SELECT *, r * a / 12 * (r + a + 1 - CASE WHEN r + a > 1 THEN ties / ((r + a) * (r + a - 1)) ELSE 0 END) AS variance FROM s JOIN t USING (chrom, site))
SELECT chrom, site, CAST(r AS BIGINT) AS n_ref, CAST(a AS BIGINT) AS n_alt, round(CASE WHEN r > 0 AND a > 0 THEN CASE WHEN variance <= 0 THEN 0 ELSE (w - a * (a + 1) / 2 - r * a / 2) / sqrt(variance) END END, 6) AS z FROM v""")
def bias_rank_sum(spark, sf_dir):
    """Depths of every third record against those of the others."""
    found = bias.rank_sum(_observations(spark, sf_dir), ["chrom", "site"], "v", F.col("alt"))
    return found.select("chrom", "site", "n_ref", "n_alt", F.round("z", 6).alias("z"))


_CHOOSE = "(lgamma({n} + 1.0) - lgamma({k} + 1.0) - lgamma({n} - {k} + 1.0))"


@query(f"""{S}, c AS (SELECT chrom, site, CAST(count_if(NOT alt AND NOT rev) AS BIGINT) AS rf, CAST(count_if(NOT alt AND rev) AS BIGINT) AS rr, CAST(count_if(alt AND NOT rev) AS BIGINT) AS af, CAST(count_if(alt AND rev) AS BIGINT) AS ar FROM o GROUP BY ALL),
k AS (SELECT *, unnest(range(greatest(0, rf + af - af - ar), least(rf + rr, rf + af) + 1)) AS k FROM c),
p AS (SELECT *, exp({_CHOOSE.format(n="(rf + rr)", k="k")} + {_CHOOSE.format(n="(af + ar)", k="(rf + af - k)")} - {_CHOOSE.format(n="(rf + rr + af + ar)", k="(rf + af)")}) AS q FROM k WHERE rf + af - k <= af + ar AND rf + af - k >= 0),
s AS (SELECT *, max(CASE WHEN k = rf THEN q END) OVER (PARTITION BY chrom, site) AS seen FROM p)
SELECT chrom, site, rf, rr, af, ar, round(least(sum(CASE WHEN q <= seen * (1 + 1e-7) THEN q ELSE 0 END), 1), 6) AS p FROM s GROUP BY ALL""")
def bias_strand(spark, sf_dir):
    """Strands of every third record against those of the others."""
    found = bias.strand_bias(_observations(spark, sf_dir), ["chrom", "site"], F.col("alt"), F.col("rev"))
    return found.select("chrom", "site", "rf", "rr", "af", "ar", F.round("p", 6).alias("p"))
