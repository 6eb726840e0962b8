"""Queries of pileups over reads derived from ``lineitem``: two mates of 40 bases for each row.

Contigs and reads are letters of digests: a read is a stretch of its contig with one base of its own, so that all
rows have different reads, and six CIGARs shift, clip, split and delete them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from allelix.operators import pileup
from allelix.plans import fixtures as fx
from allelix.plans.registry import query

LETTERS = "'0123456789abcdef', 'ACGTACGTACGTACGT'"
BASES_OF = f"translate(md5(chrom || ':' || CAST({{}} AS VARCHAR(20))), {LETTERS})"
ROW = {
    "name": "'r' || CAST(l_orderkey AS VARCHAR(20)) || '.' || CAST(l_linenumber AS VARCHAR(20)) || '.' || CAST(l_partkey AS VARCHAR(20)) || '.' || CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR(20))",
    "chrom": fx.SITE_COLUMNS["chrom"],
    "first": fx.SITE_COLUMNS["pos"],
    "apart": "CAST(CAST(l_quantity AS INT) % 45 AS INT)",
    "kind": "l_partkey",
    "sample": "'s' || CAST(l_orderkey % 3 AS VARCHAR(4))",
}
READ = {
    "sample": "sample",
    "qname": "name",
    "chrom": "chrom",
    "pos": "CAST(first + k * apart AS INT)",
    "mate_pos": "CAST(first + (1 - k) * apart AS INT)",
    "flag": "CAST(1 + CASE WHEN kind % 19 = 0 THEN 0 ELSE 2 END + CASE WHEN k = 0 THEN 96 ELSE 144 END + CASE WHEN (kind + k) % 31 = 0 THEN 1024 ELSE 0 END AS INT)",
    "mapq": "CAST(kind % 61 AS INT)",
    "cigar": """CASE (kind + k) % 6 WHEN 0 THEN '40M' WHEN 1 THEN '5S20M2I13M' WHEN 2 THEN '12M3D28M'
      WHEN 3 THEN '10M60N30M' WHEN 4 THEN '3H8M1P4I28=' ELSE '15M1D5X20M' END""",
    "k": "k",
    "kind": "kind",
}
PLAIN = f"substr({BASES_OF.format('pos // 32')} || {BASES_OF.format('pos // 32 + 1')}, CAST(1 + pos % 32 AS INT), 32) || substr({BASES_OF.format('(pos + 32) // 32')}, CAST(1 + pos % 32 AS INT), 8)"
LINE = {
    "sample": "sample", "qname": "qname", "chrom": "chrom", "pos": "pos", "mate_chrom": "'='", "mate_pos": "mate_pos", "flag": "flag", "mapq": "mapq", "cigar": "cigar",
    "seq": "substr(rpad(plain, 40, 'N'), 1, 13) || substr('ACGTN', CAST(1 + kind % 5 AS INT), 1) || substr(rpad(plain, 40, 'N'), 15, 26)",
    "qual": "translate(md5(qname), '0123456789abcdef', '!#%''+/3579;=?ACE') || substr(translate(md5(CAST(k AS VARCHAR(4)) || qname), '0123456789abcdef', '!#%''+/3579;=?ACE'), 1, 8)",
}


def _list(columns: dict[str, str], spark: bool) -> list[str]:
    shown = [f"{e} AS {n}" for n, e in columns.items()]
    # both of them divide whole numbers, each by its own operator and with its own mark inside quotes
    return [s.replace(" // ", " div ").replace("''", "\\'") for s in shown] if spark else shown


#: The same columns from the letters of the read's piece of its contig and the next one, filled up with N (``piece``), which are
#: made once for each piece, and from digests of which only the letters that count are translated.
FROM_PIECE = LINE | {
    "seq": "substr(piece, CAST(1 + pos % 32 AS INT), 13) || substr('ACGTN', CAST(1 + kind % 5 AS INT), 1) || substr(piece, CAST(15 + pos % 32 AS INT), 26)",
    "qual": "translate(md5(qname) || substr(md5(CAST(k AS VARCHAR(4)) || qname), 1, 8), '0123456789abcdef', '!#%''+/3579;=?ACE')",
}


def reads(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "lineitem").selectExpr(*_list(ROW, True)).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    # five contigs of 20,000 places: few pieces, whatever the number of reads
    pieces = contigs(spark, sf_dir).selectExpr("chrom AS _chrom", "first AS _first", f"bases || {BASES_OF.format('first div 32 + 1')} || 'NNNNNNNN' AS piece")
    named = rows.selectExpr(*_list(READ, True)).withColumn("_at", F.expr("pos div 32 * 32"))
    met = named.join(F.broadcast(pieces), (F.col("chrom") == F.col("_chrom")) & (F.col("_at") == F.col("_first")))
    return met.selectExpr(*_list(FROM_PIECE, True))


def contigs(spark, sf_dir):
    """The contigs' pieces of 32 bases, as far as reads go."""
    last = fx.sites(spark, sf_dir).groupBy("chrom").agg(F.max("pos").alias("last"))
    pieces = last.select("chrom", F.explode(F.expr("sequence(0, (last + 300) div 32)")).alias("c"))
    return pieces.selectExpr("chrom", "c * 32 AS first", f"{BASES_OF.format('c')} AS bases")


READS = f"""rows AS (SELECT {', '.join(_list(ROW, False))} FROM lineitem),
named AS (SELECT {', '.join(_list(READ, False))} FROM rows CROSS JOIN (SELECT unnest([0, 1]) AS k) two),
reads AS (SELECT k, {', '.join(_list(LINE, False))} FROM (SELECT *, {PLAIN} AS plain FROM named) WHERE flag & 1796 = 0),
split AS (SELECT *, unnest(regexp_extract_all(cigar, '[0-9]+[A-Z=]')) AS part, generate_subscripts(regexp_extract_all(cigar, '[0-9]+[A-Z=]'), 1) AS nr FROM reads),
parts AS (SELECT *, right(part, 1) AS op, CAST(left(part, length(part) - 1) AS INT) AS n FROM split),
ops AS (SELECT *, CAST(pos + sum(CASE WHEN op IN ('M', 'D', 'N', '=', 'X') THEN n ELSE 0 END) OVER w - CASE WHEN op IN ('M', 'D', 'N', '=', 'X') THEN n ELSE 0 END AS INT) AS ref_at,
 CAST(1 + sum(CASE WHEN op IN ('M', 'I', 'S', '=', 'X') THEN n ELSE 0 END) OVER w - CASE WHEN op IN ('M', 'I', 'S', '=', 'X') THEN n ELSE 0 END AS INT) AS read_at
 FROM parts WINDOW w AS (PARTITION BY qname, k ORDER BY nr))"""
# mates meet base by base; a name's hash is summed up over its letters and mixed step by step
PILED = f"""{READS},
steps AS (SELECT *, unnest(range(n)) AS i FROM ops WHERE op IN ('M', '=', 'X', 'D')),
bases AS (SELECT sample, qname, k, chrom, ref_at + i AS place, flag, mapq, CASE WHEN op = 'D' THEN '-' ELSE substr(seq, CAST(read_at + i AS INT), 1) END AS base,
 CASE WHEN op = 'D' THEN NULL ELSE ascii(substr(qual, CAST(read_at + i AS INT), 1)) - 33 END AS q, cigar LIKE '%S%' AS clipped FROM steps),
h0 AS (SELECT qname, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(qname, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda s, x: (s * 31 + x) & 4294967295) AS h FROM (SELECT DISTINCT qname FROM reads)),
h1 AS (SELECT qname, (h + 4294967295 - ((h * 32768) & 4294967295)) & 4294967295 AS h FROM h0), h2 AS (SELECT qname, xor(h, h // 1024) AS h FROM h1),
h3 AS (SELECT qname, (h * 9) & 4294967295 AS h FROM h2), h4 AS (SELECT qname, xor(h, h // 64) AS h FROM h3),
h5 AS (SELECT qname, (h + 4294967295 - ((h * 2048) & 4294967295)) & 4294967295 AS h FROM h4), h6 AS (SELECT qname, xor(h, h // 65536) % 2 AS odd FROM h5),
met AS (SELECT a.*, b.base AS mb, b.q AS mq, (odd <> a.k) AS keeps FROM bases a JOIN h6 USING (qname)
 LEFT JOIN bases b ON a.qname = b.qname AND a.k <> b.k AND a.place = b.place AND a.flag & 2 <> 0 AND b.flag & 2 <> 0 WHERE a.base <> '-'),
obs AS (SELECT sample, chrom, CAST(place AS INT) AS pos, base, mapq, flag & 16 <> 0 AS rev, clipped,
 CASE WHEN mb IS NULL THEN q WHEN mb <> '-' AND mb = base THEN CASE WHEN keeps THEN least(q + mq, 200) ELSE 0 END WHEN mb <> '-' AND q > mq THEN q * 4 // 5 WHEN mb <> '-' AND q < mq THEN 0
 WHEN keeps THEN q * 4 // 5 ELSE 0 END AS q FROM met),
good AS (SELECT *, q >= 1 AND base <> 'N' AS ok, greatest(least(q, mapq, 60, 63), 4) AS w FROM obs),
letters AS (SELECT unnest(['A', 'C', 'G', 'T']) AS b)"""
COUNTS = ", ".join(f"CAST({e.format(b=b)} AS BIGINT) AS {n}_{b.lower()}" for b in "ACGT" for n, e in (("f", "count_if(ok AND base = '{b}' AND NOT rev)"), ("r", "count_if(ok AND base = '{b}' AND rev)"), ("q", "coalesce(sum(CASE WHEN ok AND base = '{b}' THEN w END), 0)")))


@query(f"WITH {PILED} SELECT sample, chrom, pos, count(*) AS raw_depth, count_if(ok)::BIGINT AS depth, {COUNTS}, count_if(ok AND mapq = 0)::BIGINT AS mq0, CAST(coalesce(sum(CASE WHEN ok THEN least(mapq, 60) END), 0) AS BIGINT) AS mapq_sum, count_if(ok AND clipped)::BIGINT AS clipped FROM good GROUP BY sample, chrom, pos")
def pileup_depths(spark, sf_dir):
    """Counts of all bases by strand and quality for each sample and position, mates merged."""
    counts = pileup.counted(pileup.usable(reads(spark, sf_dir)))
    lists = [F.get(n, F.lit(i)).alias(f"{s}_{b.lower()}") for i, b in enumerate("ACGT") for n, s in (("adf", "f"), ("adr", "r"), ("qs", "q"))]
    return counts.select("sample", "chrom", "pos", "raw_depth", "depth", *lists, "mq0", "mapq_sum", "clipped")


REF_AT = "substr(" + " || ".join(BASES_OF.format(f"pos // 32{s}") for s in ("", " + 1")) + ", CAST(1 + pos % 32 AS INT), {})"


@query(f"""WITH {READS}, events AS (SELECT a.sample, a.chrom, a.ref_at - 1 AS pos, CASE WHEN a.op = 'I' THEN substr(a.seq, a.read_at, a.n) ELSE '' END AS ins, CASE WHEN a.op = 'D' THEN a.n ELSE 0 END AS del, a.flag & 16 = 0 AS fwd
 FROM ops a JOIN ops b ON a.qname = b.qname AND a.k = b.k AND b.nr = CASE WHEN a.cigar LIKE '%P%' AND a.op = 'I' THEN a.nr - 2 ELSE a.nr - 1 END WHERE a.op IN ('I', 'D') AND b.op IN ('M', '=', 'X')),
by_sample AS (SELECT sample, chrom, pos, ins, del, count(*) AS n, count_if(fwd) AS f FROM events GROUP BY ALL)
SELECT chrom, CAST(pos AS INT) AS pos, {REF_AT.format('CAST(1 + del AS INT)')} AS ref, {REF_AT.format('1')} || ins AS alt, CAST(sum(n) AS BIGINT) AS n, CAST(sum(f) AS BIGINT) AS n_forward, count(*)::INT AS n_samples
 FROM by_sample GROUP BY chrom, pos, ins, del HAVING max(n) >= 2""")
def pileup_indels(spark, sf_dir):
    """Insertions and deletions that two or more reads of one sample show, as records."""
    found = pileup.indel_records(pileup.indels(pileup.usable(reads(spark, sf_dir))), contigs(spark, sf_dir), 2)
    return found.select("chrom", "pos", "ref", "alt", "n", "n_forward", F.size("calls").alias("n_samples"))


@query(f"""WITH {PILED}, s AS (SELECT chrom, pos, sample, base, CAST(sum(w) AS DOUBLE) AS w, count_if(NOT rev) AS f, count_if(rev) AS r FROM good WHERE ok GROUP BY ALL),
t AS (SELECT *, w / sum(w) OVER (PARTITION BY chrom, pos, sample) AS share FROM s),
u AS (SELECT chrom, pos, base, sum(share) AS q, sum(f) AS f, sum(r) AS r FROM t GROUP BY ALL),
v AS (SELECT *, {REF_AT.format('1')} AS ref FROM u),
x AS (SELECT chrom, pos, any_value(ref) AS ref, coalesce(string_agg(CASE WHEN base <> ref THEN base END, ',' ORDER BY round(q, 9) DESC, base DESC), '.') AS alt, CAST(floor(1000 * coalesce(sum(CASE WHEN base = ref THEN q END), 0) + 1e-6) AS BIGINT) AS ref_qs,
 CAST(coalesce(sum(CASE WHEN base = ref THEN f END), 0) AS BIGINT) AS ref_f, CAST(coalesce(sum(CASE WHEN base = ref THEN r END), 0) AS BIGINT) AS ref_r, CAST(coalesce(sum(CASE WHEN base <> ref THEN f END), 0) AS BIGINT) AS alt_f, CAST(coalesce(sum(CASE WHEN base <> ref THEN r END), 0) AS BIGINT) AS alt_r FROM v GROUP BY chrom, pos),
d AS (SELECT chrom, pos, count(*) AS dp, round(coalesce(sum(CASE WHEN ok THEN least(mapq, 60) END), 0) / nullif(count_if(ok), 0), 6) AS mq, round(count_if(ok AND mapq = 0) / nullif(count_if(ok), 0), 6) AS mq0f FROM good GROUP BY ALL)
SELECT chrom, pos, ref, alt, ref_qs, dp, ref_f, ref_r, alt_f, alt_r, CAST(mq AS DOUBLE) AS mq, CAST(mq0f AS DOUBLE) AS mq0f FROM x JOIN d USING (chrom, pos)""")
def pileup_records(spark, sf_dir):
    """Records of all positions with bases: alleles in the order of their qualities, counts by strand, mapping qualities; REF's share in thousandths."""
    found = pileup.records(pileup.counted(pileup.usable(reads(spark, sf_dir))), contigs(spark, sf_dir))
    strands = [F.get("dp4", F.lit(i)).alias(n) for i, n in enumerate(("ref_f", "ref_r", "alt_f", "alt_r"))]
    alt = F.when(F.size("alts") > 0, F.array_join("alts", ",")).otherwise(".")
    return found.select("chrom", "pos", "ref", alt.alias("alt"), F.floor(F.get("qs", F.lit(0)) * 1000 + 1e-6).alias("ref_qs"), "dp", *strands, F.round("mq", 6).alias("mq"), F.round("mq0f", 6).alias("mq0f"))
