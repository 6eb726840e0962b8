"""Sections of the statistics report, each a tidy table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from allelix.functions import variants as V
from allelix.operators.sets import presence


def _types(sites: DataFrame) -> DataFrame:
    rows = sites.select("*", F.posexplode(F.split("alt", ",")).alias("k", "a"))
    return rows.withColumn("type", V.allele_type(F.col("ref"), F.col("a")))


def summary(sites: DataFrame) -> DataFrame:
    """Counts of records by the kinds of allele they hold, without a shuffle of records."""
    kinds = F.transform(F.split("alt", ","), lambda a: V.allele_type(F.col("ref"), a))
    rows = sites.select("alt", kinds.alias("kinds"))
    has = lambda *names: F.count_if(F.arrays_overlap("kinds", F.array(*map(F.lit, names))))
    return rows.agg(
        F.count("*").alias("records"), F.count_if(F.col("alt") == ".").alias("no_alts"), has("snp").alias("snps"), has("mnp").alias("mnps"),
        has("indel").alias("indels"), has("other", "symbolic").alias("others"), F.count_if(F.col("alt").contains(",")).alias("multiallelic"),
    )


def substitutions(sites: DataFrame) -> DataFrame:
    """Counts of all twelve changes of one base, 0 for those that don't occur."""
    seen = _types(sites).where("type = 'snp' AND length(ref) = 1").groupBy(F.concat("ref", F.lit(">"), "a").alias("change")).agg(F.count("*").alias("n"))
    every = sites.sparkSession.createDataFrame([(f"{r}>{a}", 0) for r in "ACGT" for a in "ACGT" if r != a], "change string, n long")
    return seen.unionByName(every).groupBy("change").agg(F.sum("n").alias("n"))


def tstv(sites: DataFrame) -> DataFrame:
    """Transitions and transversions over all ALTs and over first ALTs."""
    ts, first = V.is_transition(F.col("ref"), F.col("a")), F.col("k") == 0
    return _types(sites).where("type = 'snp' AND length(ref) = 1").agg(
        F.count_if(ts).alias("ts"), F.count_if(~ts).alias("tv"), F.count_if(ts & first).alias("ts_first"), F.count_if(~ts & first).alias("tv_first")
    )


def indel_lengths(sites: DataFrame) -> DataFrame:
    return _types(sites).where("type IN ('indel', 'other')").groupBy((F.length("a") - F.length("ref")).cast("long").alias("length")).agg(F.count("*").alias("n"))


def depth_bins(calls: DataFrame, width: int, most: int) -> DataFrame:
    """Genotypes by depth bin, the last one open, and their share."""
    binned = calls.groupBy((F.least(F.floor(F.col("dp") / width), F.lit(most)) * width).alias("bin")).agg(F.count("*").alias("n"))
    return binned.select("bin", "n", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))  # at most ``most`` + 1 rows


def per_sample(calls: DataFrame) -> DataFrame:
    of = lambda *names: F.count_if(F.col("class").isin(*names))
    return calls.withColumn("class", V.gt_class(F.col("gt"))).groupBy("sample_id").agg(
        of("hom_ref").alias("hom_ref"), of("hom_alt").alias("hom_alt"), of("het", "het_alt").alias("het"), of("hap").alias("hap"), of("mis").alias("missing"), F.sum("dp").alias("depth")
    )


def af_bins(variants: DataFrame) -> DataFrame:
    """Records by whole percents of the first ALT's frequency; singletons are bin 0, without calls null."""
    every = F.flatten(F.transform("calls", lambda c: V.gt_alleles(c["gt"])))
    ac, an = F.size(F.filter(every, lambda x: x == 1)), V.allele_number(F.col("calls"))
    bin_ = F.when(an == 0, F.lit(None)).when(ac == 1, F.lit(0)).otherwise(F.floor(ac * 100 / an)).cast("long")
    return variants.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))


def two_files(a: DataFrame, b: DataFrame) -> DataFrame:
    only = lambda m: F.count_if(F.col("mask") == m)
    return presence([a, b], ["chrom", "pos", "ref", "alt"]).groupBy("chrom").agg(only(1).alias("only_a"), only(2).alias("only_b"), only(3).alias("shared"))
