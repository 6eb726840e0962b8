"""Stitching of chunks of 4,000 positions that share 500 with the next; a third of chunks and samples is the other way round."""

from __future__ import annotations

from pyspark.sql import functions as F

from allelix.operators import ligate
from allelix.plans import fixtures as fx
from allelix.plans.registry import query

KEY = ["pos", "ref", "alt", *fx.KEY]
K = ", ".join(KEY)
TURNED = "CASE WHEN (chunk + sample_id) % 3 = 0 AND gt = '0|1' THEN '1|0' ELSE gt END"

# the chunks are walked through one by one, each sample's state handed on
WALK = f"""WITH RECURSIVE {fx.SITES}, {fx.GTS}, held AS (SELECT *, CAST(pos // 4000 AS INT) AS chunk FROM gts UNION ALL SELECT *, CAST(pos // 4000 - 1 AS INT) FROM gts WHERE pos >= 4000 AND pos % 4000 < 500),
c AS (SELECT chrom, chunk, {K}, sample_id, {TURNED} AS gt FROM held),
ext AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY chunk) AS nr FROM (SELECT chrom, chunk, min(pos) AS lo, max(pos) AS hi FROM c GROUP BY ALL)),
zones AS (SELECT e.chrom, e.chunk AS prev, n.chunk AS next, n.lo, e.hi FROM ext e JOIN ext n ON e.chrom = n.chrom AND n.nr = e.nr + 1),
za AS (SELECT z.prev, z.next, c.* FROM c JOIN zones z ON c.chrom = z.chrom AND c.chunk = z.prev AND c.pos >= z.lo), zb AS (SELECT z.prev, z.next, c.* FROM c JOIN zones z ON c.chrom = z.chrom AND c.chunk = z.next AND c.pos <= z.hi),
m AS (SELECT chrom, prev, next, {K}, sample_id, za.gt AS ga, zb.gt AS gb FROM za FULL JOIN zb USING (chrom, prev, next, {K}, sample_id)),
n AS (SELECT chrom, next AS chunk, sample_id, count_if(ga LIKE '_|_' AND ga = gb AND ga[1] <> ga[3]) AS same, count_if(ga LIKE '_|_' AND gb LIKE '_|_' AND ga[1] <> ga[3] AND ga = reverse(gb)) AS crossed FROM m GROUP BY ALL),
grid AS (SELECT chrom, chunk, nr, sample_id, same, crossed FROM ext CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS sample_id) LEFT JOIN n USING (chrom, chunk, sample_id)),
walk AS (SELECT *, false AS turned FROM grid WHERE nr = 1 UNION ALL SELECT g.*, CASE WHEN g.same IS NULL THEN w.turned WHEN g.same = g.crossed THEN false ELSE xor(CAST(w.turned AS INT), CAST(g.crossed > g.same AS INT)) = 1 END
 FROM grid g JOIN walk w ON g.chrom = w.chrom AND g.sample_id = w.sample_id AND g.nr = w.nr + 1)"""


def _calls(spark, sf_dir):
    chunk = "CAST(pos div 4000 AS INT)"
    held = fx.genotypes(spark, sf_dir).withColumn("chunk", F.explode(F.expr(f"CASE WHEN pos >= 4000 AND pos % 4000 < 500 THEN array({chunk}, {chunk} - 1) ELSE array({chunk}) END")))
    return held.select("chrom", "chunk", *KEY, "sample_id", F.expr(TURNED).alias("gt"))


@query(f"""{WALK} SELECT chrom, chunk, sample_id, same, crossed, turned, CAST(CASE WHEN same > 0 AND crossed > 0 THEN floor(99 * (0.7 + f * ln(f) + (1 - f) * ln(1 - f)) / 0.7) WHEN same IS NOT NULL THEN 99 END AS BIGINT) AS quality
FROM (SELECT *, same / nullif(same + crossed, 0)::DOUBLE AS f FROM walk)""")
def ligate_links(spark, sf_dir):
    """Agreement of each chunk with the one before, and whether it is turned round."""
    return ligate.links(_calls(spark, sf_dir), KEY)


@query(f"""{WALK}, p AS (SELECT *, dense_rank() OVER w AS place FROM m WINDOW w AS (PARTITION BY chrom, prev ORDER BY {K})), h AS (SELECT *, 2 * place <= max(place) OVER (PARTITION BY chrom, prev) + 1 AS early FROM p),
i AS (SELECT h.*, a.turned AS ta, b.turned AS tb FROM h JOIN walk a ON a.chrom = h.chrom AND a.chunk = h.prev AND a.sample_id = h.sample_id JOIN walk b ON b.chrom = h.chrom AND b.chunk = h.next AND b.sample_id = h.sample_id),
o AS (SELECT chrom, {K}, sample_id, CASE WHEN early THEN coalesce(ga, gb) ELSE coalesce(gb, ga) END AS gt, CASE WHEN early THEN ta AND ga IS NOT NULL ELSE tb END AS turn, CASE WHEN early AND ga IS NOT NULL OR NOT early AND gb IS NULL THEN prev ELSE next END AS chunk FROM i
 UNION ALL SELECT chrom, {K}, sample_id, gt, turned, chunk FROM c JOIN walk USING (chrom, chunk, sample_id) WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.chrom = c.chrom AND (m.prev = c.chunk OR m.next = c.chunk) AND {' AND '.join(f'm.{k} = c.{k}' for k in KEY)}))
SELECT chrom, {K}, sample_id, CASE WHEN turn AND gt LIKE '_|_' THEN reverse(gt) ELSE gt END AS gt, chunk FROM o""")
def ligate_records(spark, sf_dir):
    """All records once, in phase from chunk to chunk."""
    return ligate.stitched(_calls(spark, sf_dir), KEY)
