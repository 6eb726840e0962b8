"""Tolerant annotation of the records by a source that writes them with other ends and starts."""

from __future__ import annotations

from pyspark.sql import functions as F

from allelix.operators import annotate
from allelix.plans import fixtures as fx
from allelix.plans.registry import query

K = ", ".join(fx.KEY)
# of three source rows one is as it is, one has two bases more at both ends, one begins one base earlier
SOURCE = {
    "chrom": "chrom",
    "pos": "CAST(CASE WHEN alt LIKE '%,%' OR alt LIKE '<%' OR alt = '.' OR l_orderkey % 3 < 2 THEN pos ELSE pos - 1 END AS INT)",
    "ref": "CASE WHEN alt LIKE '%,%' OR alt LIKE '<%' OR alt = '.' OR l_orderkey % 3 = 0 THEN ref WHEN l_orderkey % 3 = 1 THEN ref || 'ca' ELSE 'G' || ref END",
    "alt": "CASE WHEN alt LIKE '%,%' OR alt LIKE '<%' OR alt = '.' OR l_orderkey % 3 = 0 THEN alt WHEN l_orderkey % 3 = 1 THEN alt || 'ca' ELSE 'G' || alt END",
    "fin": "CASE WHEN alt LIKE '<%' THEN CAST(pos + info_dp % 3 AS INT) END",
    "score": "info_dp",
    "by_price": "l_extendedprice", "by_order": "l_orderkey", "by_line": "l_linenumber", "by_part": "l_partkey",
}
ORDER = ["score", "by_price", "by_order", "by_line", "by_part"]
O = ", ".join(ORDER)
SHOWN = ", ".join(f"{e} AS {n}" for n, e in SOURCE.items())
SAME_END = "coalesce(list_max(list_filter(range(0, least(length({r}), length({a})) + 1), lambda i: right(upper({r}), i) = right(upper({a}), i))), 0)"
SAME_START = "list_max(list_filter(range(0, least(length({r}), length({a})) + 1), lambda i: left({r}, i) = left({a}, i)))"


def _forms(name: str, key: str) -> str:
    """SQL of the rows with bases on both sides: what they end with (tail), and what is left of them (p, r, a)."""
    return f"""{name}_t AS (SELECT *, CAST({SAME_END.format(r='ref', a='one')} AS INT) AS n FROM {name} WHERE regexp_full_match(ref, '[A-Za-z]+') AND regexp_full_match(one, '[A-Za-z]+')),
{name}_s AS (SELECT *, right(upper(ref), n) AS tail, left(upper(ref), length(ref) - n) AS sr, left(upper(one), length(one) - n) AS sa FROM {name}_t),
{name}_c AS (SELECT *, pos + h AS p, substr(sr, 1 + h) AS r, substr(sa, 1 + h) AS a FROM (SELECT *, CAST({SAME_START.format(r='sr', a='sa')} AS INT) AS h FROM {name}_s))"""


ORACLE = f"""WITH {fx.SITES}, src AS (SELECT {SHOWN} FROM sites), tgt AS (SELECT *, alt AS one, CASE WHEN alt LIKE '<%' THEN CAST(pos + l_partkey % 2 AS INT) END AS fin FROM sites),
one AS (SELECT *, unnest(string_split(alt, ',')) AS one, generate_subscripts(string_split(alt, ','), 1) - 1 AS nr FROM src), {_forms('tgt', K)}, {_forms('one', O)},
hits AS (SELECT {K}, 1 AS tier, {O}, CASE WHEN t.alt = '.' OR t.alt LIKE '%,%' THEN -1 ELSE nr END AS nr FROM tgt t JOIN one s ON t.chrom = s.chrom AND t.pos = s.pos AND t.ref = s.ref AND (t.alt = '.' OR t.alt = s.alt OR t.alt = s.one) AND (t.fin IS NULL OR t.fin = s.fin)
 UNION ALL SELECT {K}, 2, {O}, nr FROM tgt_c t JOIN one_c s ON t.chrom = s.chrom AND t.pos = s.pos AND t.sr = s.sr AND t.sa = s.sa AND (starts_with(t.tail, s.tail) OR starts_with(s.tail, t.tail))
 UNION ALL SELECT {K}, 3, {O}, nr FROM tgt_c t JOIN one_c s ON t.chrom = s.chrom AND t.p = s.p AND t.r = s.r AND t.a = s.a),
best AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY {K} ORDER BY tier, {O}, nr) = 1)
SELECT chrom, pos, {K}, score, CAST(CASE WHEN b.nr >= 0 THEN b.nr END AS INT) AS allele, tier AS matched FROM tgt LEFT JOIN best b USING ({K})"""


@query(ORACLE)
def annotate_tolerant(spark, sf_dir):
    """Every record with the first source row of the same alleles, however written."""
    records = fx.sites(spark, sf_dir).withColumn("fin", F.expr("CASE WHEN alt LIKE '<%' THEN CAST(pos + l_partkey % 2 AS INT) END"))
    source = fx.sites(spark, sf_dir).selectExpr(*(f"{e} AS {n}" for n, e in SOURCE.items()))
    return annotate.tolerant(records, source, ["score"], ORDER, end="fin").select("chrom", "pos", *fx.KEY, "score", "allele", "matched")
