"""Alignments in text form (SAM)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """qname, flag, chrom, pos, mapq, cigar, mate_chrom, mate_pos, length, seq, qual, read_group, nm and sample of SAM text.

    The sample is that of the read group in the same file's header; reads without one take the file's name without its ending.
    ``=`` as the mate's contig becomes the read's own, ``*`` contigs null. Files are split by lines, however long they are; numbers that are none become null.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"))
    p = F.split("value", "\t")
    of = lambda parts, key: F.regexp_replace(F.get(F.filter(parts, lambda a: a.startswith(key)), F.lit(0)), "^" + key, "")
    groups = lines.where(F.col("value").startswith("@RG\t")).select("_file", of(p, "ID:").alias("read_group"), of(p, "SM:").alias("_sample"))
    groups = groups.groupBy("_file", "read_group").agg(F.min("_sample").alias("_sample"))
    at = lambda i: F.get("p", F.lit(i))
    known = lambda c: F.when(c != "*", c)
    reads = lines.where(~F.col("value").rlike("^(@[A-Za-z][A-Za-z]\t|$)")).select("_file", p.alias("p")).where(F.size("p") >= 11)
    tags = F.slice("p", F.lit(12), F.size("p"))
    fields = reads.select(
        "_file", at(0).alias("qname"), at(1).try_cast("int").alias("flag"), known(at(2)).alias("chrom"), at(3).try_cast("int").alias("pos"), at(4).try_cast("int").alias("mapq"), at(5).alias("cigar"),
        F.when(at(6) == "=", known(at(2))).otherwise(known(at(6))).alias("mate_chrom"), at(7).try_cast("int").alias("mate_pos"), at(8).try_cast("int").alias("length"), at(9).alias("seq"), at(10).alias("qual"),
        of(tags, "RG:Z:").alias("read_group"), of(tags, "NM:i:").try_cast("int").alias("nm"),
    )
    stem = F.regexp_replace(F.regexp_extract("_file", "([^/]*)$", 1), "\\.sam(\\.gz)?$", "")
    return fields.join(groups, ["_file", "read_group"], "left").withColumn("sample", F.coalesce("_sample", stem)).drop("_file", "_sample")
