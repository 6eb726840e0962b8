"""Variant-shaped views of the driver's tables, by the same expressions in Spark and in DuckDB.

A record is a row of ``lineitem``; (l_orderkey, l_linenumber, l_partkey, l_extendedprice) tells
records apart, so that no view needs a global row number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelix.session import once

SITE_COLUMNS = {
    "chrom": "'chr' || CAST(1 + l_suppkey % 5 AS VARCHAR(4))",
    "pos": "CAST(1 + (l_orderkey * 7 + l_partkey * 3) % 20000 AS INT)",
    "id": "CASE WHEN l_partkey % 11 = 0 THEN 'rs' || CAST(l_partkey AS VARCHAR(20)) ELSE '.' END",
    "ref": "CASE WHEN l_partkey % 7 IN (0,1) THEN substr('ACGTACGT', CAST(1 + l_partkey % 4 AS INT), 3) ELSE substr('ACGT', CAST(1 + l_partkey % 4 AS INT), 1) END",
    "alt": """CASE WHEN l_partkey % 7 = 0 THEN substr('ACGT', CAST(1 + l_partkey % 4 AS INT), 1)
      WHEN l_partkey % 7 = 1 THEN substr('ACGTACGT', CAST(1 + l_partkey % 4 AS INT), 2) || 'G'
      WHEN l_partkey % 7 = 2 THEN substr('ACGT', CAST(1 + l_partkey % 4 AS INT), 1) || 'TT'
      WHEN l_partkey % 7 = 3 THEN substr('CGTA', CAST(1 + l_partkey % 4 AS INT), 1) || ',' || substr('GTAC', CAST(1 + l_partkey % 4 AS INT), 1)
      WHEN l_partkey % 23 = 4 THEN '<DEL>' WHEN l_partkey % 29 = 5 THEN '.'
      ELSE substr('GTAC', CAST(1 + l_partkey % 4 AS INT), 1) END""",
    "qual": "CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE round(l_extendedprice / 100.0, 1) END",
    "filter": "CASE l_returnflag WHEN 'R' THEN 'q10' WHEN 'A' THEN 'PASS' ELSE '.' END",
    "info_dp": "CAST(l_quantity AS INT)",
    "l_orderkey": "l_orderkey",
    "l_linenumber": "l_linenumber",
    "l_partkey": "l_partkey",
    "l_extendedprice": "l_extendedprice",
}
KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
SAMPLES = 4
GT = """CASE WHEN (l_orderkey * 3 + pos * (sample_id + 1)) % 17 = 0 THEN './.'
      WHEN (l_orderkey * 3 + pos * (sample_id + 1)) % 17 < 8 THEN '0/0'
      WHEN (l_orderkey * 3 + pos * (sample_id + 1)) % 17 < 12 THEN '0/1'
      WHEN (l_orderkey * 3 + pos * (sample_id + 1)) % 17 < 14 THEN '0|1'
      WHEN (l_orderkey * 3 + pos * (sample_id + 1)) % 17 = 14 AND alt LIKE '%,%' THEN '1/2'
      WHEN (l_orderkey * 3 + pos * (sample_id + 1)) % 17 = 15 THEN '1'
      ELSE '1/1' END"""
#: For Spark alone.
ALTS = "CASE WHEN alt = '.' THEN CAST(array() AS array<string>) ELSE split(alt, ',') END"
DP = "CAST((info_dp * (sample_id + 2)) % 61 AS INT)"
REGION_COLUMNS = {
    "chrom": "'chr' || CAST(1 + o_custkey % 5 AS VARCHAR(4))",
    "beg": "CAST(1 + (o_orderkey * 11) % 20000 AS INT)",
    "end_": "CAST(1 + (o_orderkey * 11) % 20000 + o_custkey % 40 AS INT)",
}


def _select(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in columns.items())


SITES = f"sites AS (SELECT {_select(SITE_COLUMNS)} FROM lineitem)"
GTS = f"gts AS (SELECT *, {GT} AS gt, {DP} AS dp FROM sites CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS sample_id) k)"
REGIONS = f"regions AS (SELECT DISTINCT {_select(REGION_COLUMNS)} FROM orders)"
SETS = "a AS (SELECT * FROM sites WHERE l_orderkey % 3 <> 0), b AS (SELECT * FROM sites WHERE l_orderkey % 3 <> 1)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*(f"{e} AS {n}" for n, e in SITE_COLUMNS.items()))


def genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long form: a row for each record and sample."""
    rows = sites(spark, sf_dir).withColumn("sample_id", F.explode(F.sequence(F.lit(0), F.lit(SAMPLES - 1))))
    return rows.selectExpr("*", f"{GT} AS gt", f"{DP} AS dp")


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide form: alts as an array, and calls as an array of structs in sample order."""
    calls = f"transform(sequence(0, {SAMPLES - 1}), sample_id -> struct(sample_id, {GT} AS gt, {DP} AS dp))"
    return once(sites(spark, sf_dir).withColumn("alts", F.expr(ALTS)).withColumn("calls", F.expr(calls)))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*(f"{e} AS {n}" for n, e in REGION_COLUMNS.items())).distinct()


def set_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites(spark, sf_dir).where("l_orderkey % 3 <> 0")


def set_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites(spark, sf_dir).where("l_orderkey % 3 <> 1")
