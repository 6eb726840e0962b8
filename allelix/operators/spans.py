"""Order-dependent work along a contig without one task for each contig.

A contig is cut into spans of a fixed number of positions. What reaches a fixed distance gets copies
of the rows near a border in the neighbouring span. What can chain on without end is first reduced
span by span; only the pieces at borders, at most two for each span, are then looked at along the
contig.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Positions of a span.
SPAN = 1 << 14
#: Rows of a block, where order counts rows and not positions.
BLOCK_ROWS = 1 << 16


def span_of(position: Column, span: int = SPAN) -> Column:
    return F.floor(position / span).cast("long")


def with_neighbours(rows: DataFrame, before: int, after: int, span: int = SPAN, at: str = "pos") -> DataFrame:
    """Rows with ``_span`` and ``_home``: once in their own span, and a copy in each other one that is to see them.

    A span sees the rows up to ``before`` ahead of its first and ``after`` behind its last ``at``.
    """
    first, last = span_of(F.col(at) - after, span), span_of(F.col(at) + before, span)
    placed = rows.where(F.col(at).isNotNull()).withColumn("_span", F.explode(F.sequence(first, last)))
    return placed.withColumn("_home", F.col("_span") == span_of(F.col(at), span))


def chained(pieces: DataFrame, border: Column, starts: Column, order: list[str]) -> DataFrame:
    """Pieces with ``_chain``, null for those apart from a border: they are whole.

    ``starts`` is true where a piece doesn't go on from the one before it. Pieces at borders are few,
    so that these alone are put in order along their contig.
    """
    w = Window.partitionBy("chrom").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    at_border = pieces.where(border).withColumn("_chain", F.sum(F.when(starts, 1).otherwise(0)).over(w))
    return pieces.where(~border).withColumn("_chain", F.lit(None).cast("long")).unionByName(at_border)


def numbered(rows: DataFrame, order: list[str], name: str, span: int = SPAN) -> DataFrame:
    """Rows with their number along the contig, from 0, as sums of the spans' counts before."""
    spans = rows.where("pos IS NOT NULL").withColumn("_span", span_of(F.col("pos"), span))
    before = Window.partitionBy("chrom").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    counts = spans.groupBy("chrom", "_span").agg(F.count("*").alias("_n"))
    offsets = counts.select(F.col("chrom").alias("_c"), F.col("_span").alias("_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("chrom", "_span").orderBy(*order)) - 1
    joined = spans.withColumn("_inside", inside).join(offsets, F.col("chrom").eqNullSafe(F.col("_c")) & (F.col("_span") == F.col("_s")))
    return joined.select(*rows.columns, (F.col("_inside") + F.col("_offset")).alias(name))
