"""Small text tables: regions, references, pedigrees, genetic maps, allele frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """chrom, beg, end_ (1-based, inclusive) of a tab file; a ``.bed`` file counts from 0 and excludes the end."""
    shift = 1 if path.removesuffix(".gz").endswith(".bed") else 0
    rows = spark.read.text(path).where(~F.col("value").rlike("^(#|track|browser|$)")).select(F.split("value", "\t").alias("p"))
    beg = F.get("p", F.lit(1)).cast("int")
    return rows.select(F.get("p", F.lit(0)).alias("chrom"), (beg + shift).alias("beg"), F.coalesce(F.get("p", F.lit(2)).cast("int"), beg).alias("end_"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """chrom, seq: one record for each sequence; split at the header mark so that a record stays whole."""
    raw = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    name = F.regexp_extract("value", "^(\\S+)", 1)
    return raw.select(name.alias("chrom"), F.upper(F.regexp_replace(F.regexp_replace("value", "^[^\\n]*\\n?", ""), "\\s+", "")).alias("seq"))


def reference_bases(fasta: DataFrame, width: int = 1 << 14) -> DataFrame:
    """chrom, chunk, bases: pieces of ``width`` bases, for joins by (chrom, position div width)."""
    last = F.floor((F.length("seq") - 1) / width)
    chunks = fasta.where(F.length("seq") > 0).select("chrom", "seq", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk"))
    return chunks.select("chrom", "chunk", F.substr("seq", (F.col("chunk") * width + 1).cast("int"), F.lit(width)).alias("bases"))


def read_pedigree(spark: SparkSession, path: str) -> DataFrame:
    """family, child, father, mother, sex of a white-space table; 0 is nobody."""
    p = F.split(F.trim("value"), "\\s+")
    rows = spark.read.text(path).where(~F.col("value").rlike("^\\s*(#|$)"))
    known = lambda i: F.when(F.get(p, F.lit(i)) != "0", F.get(p, F.lit(i)))
    return rows.select(F.get(p, F.lit(0)).alias("family"), F.get(p, F.lit(1)).alias("child"), known(2).alias("father"), known(3).alias("mother"), F.get(p, F.lit(4)).alias("sex"))


def read_genetic_map(spark: SparkSession, path: str) -> DataFrame:
    """pos, cm of a white-space table of position, rate and map place; the header line is left out."""
    p = F.split(F.trim("value"), "\\s+")
    rows = spark.read.text(path).where(F.col("value").rlike("^\\s*[0-9]"))
    return rows.select(F.get(p, F.lit(0)).cast("int").alias("pos"), F.get(p, F.lit(2)).cast("double").alias("cm"))


def read_frequencies(spark: SparkSession, path: str) -> DataFrame:
    """chrom, pos, ref, alt, af of a tab file in which REF and ALT stand in one column with a comma between."""
    p = F.split("value", "\t")
    alleles = F.split(F.get(p, F.lit(2)), ",")
    rows = spark.read.text(path).where(~F.col("value").rlike("^(#|$)"))
    return rows.select(F.get(p, F.lit(0)).alias("chrom"), F.get(p, F.lit(1)).cast("int").alias("pos"), F.get(alleles, F.lit(0)).alias("ref"), F.get(alleles, F.lit(1)).alias("alt"), F.get(p, F.lit(3)).cast("double").alias("af"))


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """Features of a GFF3 file: chrom, type, beg, end_, strand, phase, id, name, parent, biotype.

    Prefixes ``gene:`` and ``transcript:`` of identifiers are taken off; ``is_gene`` tells genes, which are named
    so or have no parent. Phase is null where it is a dot; comments and ``biological_region`` lines are left out.
    """
    p = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").rlike("^(#|$)")).select(p.alias("p")).where(F.size("p") >= 9)
    attributes = F.split(F.get("p", F.lit(8)), ";")
    of = lambda *keys: F.get(F.filter(attributes, lambda a: F.substring_index(F.trim(a), "=", 1).isin(*keys)), F.lit(0))
    value = lambda *keys: F.regexp_replace(of(*keys), "^[^=]*=", "")
    bare = lambda c: F.regexp_replace(c, "^(gene|transcript):", "")
    kind = F.get("p", F.lit(2))
    return rows.where(kind != "biological_region").select(
        F.get("p", F.lit(0)).alias("chrom"), kind.alias("type"), F.get("p", F.lit(3)).cast("int").alias("beg"), F.get("p", F.lit(4)).cast("int").alias("end_"),
        F.get("p", F.lit(6)).alias("strand"), F.when(F.get("p", F.lit(7)) != ".", F.get("p", F.lit(7)).cast("int")).alias("phase"),
        bare(value("ID")).alias("id"), value("Name").alias("name"), bare(value("Parent")).alias("parent"), value("biotype", "gene_biotype").alias("biotype"),
        ((kind == "gene") | F.coalesce(value("ID").startswith("gene:"), F.lit(False)) | of("Parent").isNull()).alias("is_gene"),
    )
