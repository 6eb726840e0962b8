"""Gaps, islands and moving windows along a contig, span by span."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from allelix.functions.variants import allele_type
from allelix.operators import spans


def _within(*order: str) -> WindowSpec:
    return Window.partitionBy("chrom", "_span").orderBy(*order)


def depth_blocks(sites: DataFrame, width: int, span: int = spans.SPAN) -> DataFrame:
    """Runs of adjacent positions whose depth lies in the same bin; ``sites`` has a row for each position.

    Rows without a position are left out; a null depth ends a run. An empty table gives no rows.
    """
    w = _within("pos")
    level = F.floor(F.col("dp") / width)
    same = (F.col("pos") == F.lag("pos").over(w) + 1) & (level == F.lag(level).over(w))
    marked = spans.with_neighbours(sites.select("chrom", "pos", "dp"), 1, 0, span).withColumn("_new", F.when(same, 0).otherwise(1))
    placed = marked.where("_home").withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = placed.groupBy("chrom", "_span", "_island").agg(
        F.min("pos").alias("beg"), F.max("pos").alias("end_"), F.min("dp").alias("min_dp"), F.count("*").alias("n"), F.max("_new").alias("_starts")
    )
    border = (F.col("beg") == F.col("_span") * span) | (F.col("end_") == (F.col("_span") + 1) * span - 1)
    joined = spans.chained(pieces, border, F.col("_starts") == 1, ["beg"])
    # a piece apart from a border is named by itself
    own = F.when(F.col("_chain").isNull(), F.col("beg"))
    blocks = joined.groupBy("chrom", "_chain", own.alias("_own"))
    return blocks.agg(F.min("beg").alias("beg"), F.max("end_").alias("end_"), F.min("min_dp").alias("min_dp"), F.sum("n").alias("n")).drop("_chain", "_own")


def _has(*kinds: str):
    return F.exists(F.split("alt", ","), lambda a: allele_type(F.col("ref"), a).isin(*kinds))


def snp_gap(sites: DataFrame, gap: int, span: int = spans.SPAN) -> DataFrame:
    """Records with a SNP that have no indel within ``gap`` positions; records without a position are left out."""
    near = _within("pos").rangeBetween(-gap, gap)
    typed = sites.withColumn("_indel", _has("indel", "other")).withColumn("_snp", _has("snp"))
    # of a neighbouring span only the indels matter
    seen = spans.with_neighbours(typed.where("_indel OR _snp"), gap, gap, span).where("_home OR _indel")
    marked = seen.withColumn("_near", F.max("_indel").over(near))
    return marked.where("_home AND NOT _near AND _snp").select(*sites.columns)


def indel_gap(sites: DataFrame, gap: int, order: list[str], span: int = spans.SPAN) -> DataFrame:
    """The indel of highest QUAL of each cluster in which neighbours are at most ``gap`` apart.

    The best of each span's part of a cluster is taken first, then the best of the parts. A missing
    QUAL is lowest; ties go to the first by position and ``order``. Records without a position are left out.
    """
    w = _within("pos", *order)
    seen = spans.with_neighbours(sites.where(_has("indel", "other")), gap, 0, span)
    marked = seen.withColumn("_new", F.when(F.col("pos") - F.lag("pos").over(w) <= gap, 0).otherwise(1))
    placed = marked.where("_home").withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    part = Window.partitionBy("chrom", "_span", "_island")
    ranking = [F.coalesce("qual", F.lit(-1.0)).desc(), "pos", *order]
    described = placed.withColumns({
        "_beg": F.min("pos").over(part), "_end": F.max("pos").over(part), "_starts": F.max("_new").over(part), "_rank": F.row_number().over(part.orderBy(*ranking)),
    })
    pieces = described.where("_rank = 1")
    border = (F.col("_starts") == 0) | (F.col("_end") >= (F.col("_span") + 1) * span - gap)
    joined = spans.chained(pieces, border, F.col("_starts") == 1, ["_beg"])
    best = Window.partitionBy("chrom", "_chain").orderBy(*ranking)
    last = joined.where("_chain IS NOT NULL").withColumn("_rank", F.row_number().over(best)).where("_rank = 1")
    return joined.where("_chain IS NULL").unionByName(last).select(*sites.columns)


def moving_mean(rows: DataFrame, value: str, width: int, name: str, block_rows: int = spans.BLOCK_ROWS, span: int = spans.SPAN) -> DataFrame:
    """Mean over a window of ``width`` positions about each, shorter at the ends of a contig.

    Rows are numbered along the contig and worked on in blocks of ``block_rows`` that see their neighbours' ends.
    """
    ahead, behind = width // 2, width - width // 2 - 1
    numbers = spans.numbered(rows.select("chrom", "pos", F.col(value).alias("_value")), ["pos"], "_row", span)
    seen = spans.with_neighbours(numbers, ahead, behind, block_rows, at="_row")
    w = _within("_row").rowsBetween(-ahead, behind)
    return seen.withColumn(name, F.avg("_value").over(w)).where("_home").select("chrom", "pos", name)
