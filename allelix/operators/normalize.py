"""Splitting, trimming, atomising and joining of alleles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allelix.functions.variants import trimmed

CHUNK = 1 << 14


def split_alleles(variants: DataFrame) -> DataFrame:
    """A record for each ALT: alt, alt_number (from 1), and genotypes in which other ALTs are REF.

    A record without ALT stays, with alt ``.`` and number 1.
    """
    alts = F.when(F.size("alts") > 0, F.col("alts")).otherwise(F.array(F.lit(".")))
    rows = variants.withColumn("_alts", alts).select("*", F.posexplode("_alts").alias("_k", "_alt"))
    number = F.col("_k") + 1

    def relabel(gt: Column) -> Column:
        # every allele is one digit or more between separators; x stands for the kept one meanwhile
        parts = F.transform(F.split(gt, "[/|]"), lambda a: F.when(a == ".", a).when(a.cast("int") == number, "1").otherwise("0"))
        return F.when(gt.contains("|"), F.array_join(parts, "|")).otherwise(F.array_join(parts, "/"))

    calls = F.transform("calls", lambda c: c.withField("gt", relabel(c["gt"]))) if "calls" in variants.columns else None
    out = rows.withColumn("alt", F.col("_alt")).withColumn("alt_number", number.cast("int"))
    out = out.withColumn("calls", calls) if calls is not None else out
    return out.drop("_alts", "_k", "_alt", "alts")


def trim(records: DataFrame) -> DataFrame:
    """Records with common ends of REF and ALT taken off; for one ALT each."""
    return records.withColumn("_t", trimmed(F.col("pos"), F.col("ref"), F.col("alt"))).withColumn("pos", F.col("_t.pos")).withColumn("ref", F.col("_t.ref")).withColumn("alt", F.col("_t.alt")).drop("_t")


def atomize(records: DataFrame) -> DataFrame:
    """A record for each differing base of REF and an ALT of the same length."""
    rows = records.withColumn("_i", F.explode(F.sequence(F.lit(1), F.length("ref"))))
    base = lambda c: F.substr(F.col(c), F.col("_i"), F.lit(1))
    rows = rows.withColumn("_r", base("ref")).withColumn("_a", base("alt")).where("_r <> _a")
    return rows.withColumn("pos", (F.col("pos") + F.col("_i") - 1).cast("int")).withColumn("ref", F.col("_r")).withColumn("alt", F.col("_a")).drop("_i", "_r", "_a")


def join_alleles(records: DataFrame) -> DataFrame:
    """One record for each position: the longest REF, and every distinct ALT padded to it, sorted."""
    longest = F.max(F.struct(F.length("ref").alias("n"), F.col("ref").alias("ref")))
    pairs = F.flatten(F.collect_set(F.transform(F.split("alt", ","), lambda a: F.struct(F.col("ref").alias("r"), a.alias("a")))))
    grouped = records.groupBy("chrom", "pos").agg(longest.alias("l"), pairs.alias("pairs"), F.count("*").alias("records"))
    padded = F.array_sort(F.array_distinct(F.transform("pairs", lambda p: F.concat(p["a"], F.substr(F.col("l.ref"), F.length(p["r"]) + 1, F.col("l.n"))))))
    return grouped.select("chrom", "pos", F.col("l.ref").alias("ref"), F.array_join(padded, ",").alias("alt"), "records")


def check_reference(records: DataFrame, reference: DataFrame) -> DataFrame:
    """``records`` with ``ref_ok``: whether REF is what the reference (chrom, pos, base) holds at its first base; null beyond it."""
    base = reference.select(F.col("chrom").alias("_c"), F.col("pos").alias("_p"), F.upper("base").alias("_b"))
    joined = records.join(base, (F.col("chrom") == F.col("_c")) & (F.col("pos") == F.col("_p")), "left")
    return joined.withColumn("ref_ok", F.upper(F.substring("ref", 1, 1)) == F.col("_b")).drop("_c", "_p", "_b")


def with_reference(records: DataFrame, reference: DataFrame, reach: int, chunk: int = CHUNK) -> DataFrame:
    """``records`` with ``before``: up to ``reach`` reference bases that end with the one at POS.

    ``reference`` has chrom, first (the position of its first base) and bases, pieces of any length. Each is cut
    so that every chunk of positions has its bases and those before it in one row; the join is by contig and chunk.
    """
    last = F.col("first") + F.length("bases") - 1
    # a piece serves the chunks that it holds bases of, and the one after
    pieces = reference.select("chrom", "first", "bases", F.explode(F.sequence(F.floor(F.col("first") / chunk), F.floor((last + reach) / chunk))).alias("chunk"))
    low, high = F.greatest(F.col("first"), F.col("chunk") * chunk - reach), F.least(last, (F.col("chunk") + 1) * chunk - 1)
    cut = pieces.where(low <= high).select("chrom", "chunk", low.alias("low"), F.substr("bases", (low - F.col("first") + 1).cast("int"), (high - low + 1).cast("int")).alias("bases"))
    rows = F.array_sort(F.collect_list(F.struct("low", "bases")))
    whole = cut.groupBy(F.col("chrom").alias("_c"), F.col("chunk").alias("_k")).agg(rows.alias("r")).select("_c", "_k", F.get("r", F.lit(0))["low"].alias("_low"), F.array_join(F.transform("r", lambda x: x["bases"]), "").alias("_b"))
    joined = records.join(whole, (F.col("chrom") == F.col("_c")) & (F.floor(F.col("pos") / chunk) == F.col("_k")), "left")
    end = (F.col("pos") - F.col("_low") + 1).cast("int")
    start = F.greatest(end - reach + 1, F.lit(1))
    return joined.withColumn("before", F.when(end > 0, F.substr("_b", start, end - start + 1))).drop("_c", "_k", "_low", "_b")
