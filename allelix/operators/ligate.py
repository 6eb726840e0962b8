"""Stitching of phased chunks: neighbouring chunks overlap, and the later one is turned round where its haplotypes are the other way.

Calls are in long form: chrom, chunk (whole numbers in the order of the contig), sample_id, gt and ``key``, columns
with ``pos`` that tell records of a chunk apart. An overlap goes from the first position of a chunk to the last of the one
before; no position may lie in more than two chunks. Only one row for each chunk and sample is ever put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from allelix.session import stored

BLOCK = 1 << 12
#: The best quality, and the share of entropy that it is scaled by.
BEST, SCALE = 99.0, 0.7


def _pair(gt: Column) -> Column:
    """The two alleles of a phased heterozygote, null for all other calls."""
    a, b = F.regexp_extract(gt, "^([0-9]+)\\|([0-9]+)$", 1), F.regexp_extract(gt, "^([0-9]+)\\|([0-9]+)$", 2)
    return F.when((a != "") & (a != b), F.struct(a.alias("a"), b.alias("b")))


def _turned(gt: Column, turn: Column) -> Column:
    return F.when(turn, F.regexp_replace(gt, "^([^/|]+)\\|([^/|]+)$", "$2|$1")).otherwise(gt)


def _zoned(calls: DataFrame) -> DataFrame:
    """``calls`` with ``_link``, the earlier chunk of the overlap that a row lies in, and ``_later``: whether it is of the later one."""
    extents = calls.groupBy("chrom", "chunk").agg(F.min("pos").alias("_first"), F.max("pos").alias("_last"))
    w = Window.partitionBy("chrom").orderBy("chunk")
    # stored, as are states: of known size, so that calls aren't shuffled to meet a small table
    near = extents.select("chrom", "chunk", F.lead("_first").over(w).alias("_next"), F.lag("_last").over(w).alias("_before"), F.lag("chunk").over(w).alias("_previous"))
    near = stored(near)
    later = F.coalesce(F.col("pos") <= F.col("_before"), F.lit(False))
    link = F.when(later, F.col("_previous")).when(F.col("pos") >= F.col("_next"), F.col("chunk"))
    return calls.join(near, ["chrom", "chunk"]).withColumns({"_link": link, "_later": later}).drop("_next", "_before")


def _met(zoned: DataFrame, key: list[str]) -> DataFrame:
    """The two calls of each record and sample in an overlap; of repeated records the first by the call's text."""
    sides = [F.min(F.when(F.col("_later") == later, F.col("gt"))).alias(n) for n, later in (("_a", False), ("_b", True))]
    return zoned.where("_link IS NOT NULL").groupBy("chrom", "_link", "sample_id", *key).agg(*sides, F.max(F.when(F.col("_later"), F.col("chunk"))).alias("_after"))


def _states(zoned: DataFrame, key: list[str]) -> DataFrame:
    a, b = _pair(F.col("_a")), _pair(F.col("_b"))
    same, crossed = F.count_if((a["a"] == b["a"]) & (a["b"] == b["b"])), F.count_if((a["a"] == b["b"]) & (a["b"] == b["a"]))
    counts = _met(zoned, key).groupBy("chrom", F.col("_link").alias("_previous"), "sample_id").agg(same.alias("same"), crossed.alias("crossed"))
    grid = zoned.groupBy("chrom", "chunk", "sample_id").agg(F.max("_previous").alias("_previous")).join(counts, ["chrom", "_previous", "sample_id"], "left")
    w = Window.partitionBy("chrom", "sample_id").orderBy("chunk")
    since = Window.partitionBy("chrom", "sample_id", "_group").orderBy("chunk")
    # as many for as against starts anew, unturned; from there on each majority against turns all that follows
    grouped = grid.withColumn("_group", F.sum(F.when(F.col("same") == F.col("crossed"), 1).otherwise(0)).over(w))
    turned = F.sum(F.when(F.col("crossed") > F.col("same"), 1).otherwise(0)).over(since) % 2 == 1
    f = F.col("same") / (F.col("same") + F.col("crossed"))
    mixed = F.floor(BEST * (SCALE + f * F.log(f) + (1 - f) * F.log(1 - f)) / SCALE)
    quality = F.when((F.col("same") > 0) & (F.col("crossed") > 0), mixed).when(F.col("same").isNotNull(), F.lit(int(BEST)).cast("long"))
    states = grouped.withColumns({"turned": turned, "quality": quality})
    return states


def links(calls: DataFrame, key: list[str]) -> DataFrame:
    """For each chunk and sample: same and crossed (phased heterozygotes that agree with the chunk before, or the other way round), turned and quality.

    ``turned`` says whether the chunk's calls are turned round: as the chunk before, or the opposite where more are crossed; not where
    as many are (none, too). Without an overlap it stays as it was, and the counts and the quality are null. The quality falls with the
    entropy of the two counts, 99 where one of them is zero.
    """
    return _states(_zoned(calls), key).select("chrom", "chunk", "sample_id", "same", "crossed", "turned", "quality")


def stitched(calls: DataFrame, key: list[str]) -> DataFrame:
    """Every record once for each of its samples: chrom, ``key``, sample_id, gt and the chunk it is of.

    The records of an overlap, in the order of ``key``, are of the earlier chunk in the first half and of the later one in the second
    (the middle one of an odd number belongs to the first); one that only the other chunk has is taken from there, turned as the half's
    own chunk in the second half and not at all in the first.
    """
    zoned = _zoned(calls)
    states = stored(_states(zoned, key).select("chrom", "chunk", "sample_id", "_previous", "turned"))
    alone = zoned.where("_link IS NULL").join(states.select("chrom", "chunk", "sample_id", "turned"), ["chrom", "chunk", "sample_id"])
    outside = alone.select("chrom", *key, "sample_id", _turned(F.col("gt"), F.col("turned")).alias("gt"), "chunk")
    # the place of each record in its overlap: counts of blocks are summed up, records numbered inside blocks
    block = F.floor(F.col("pos") / BLOCK)
    sites = zoned.where("_link IS NOT NULL").select("chrom", "_link", *key).distinct().withColumn("_block", block)
    blocks = sites.groupBy("chrom", "_link", "_block").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("chrom", "_link")
    sums = blocks.select("chrom", "_link", "_block", (F.sum("_n").over(w.orderBy("_block")) - F.col("_n")).alias("_before"), F.sum("_n").over(w).alias("_all"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("chrom", "_link", "_block").orderBy(*key))
    halves = sites.join(sums, ["chrom", "_link", "_block"]).select("chrom", "_link", *key, (2 * place <= F.col("_all") + 1).alias("_early"))
    turns = states.select("chrom", F.col("chunk").alias("_link"), "sample_id", "turned")
    # a sample may be in one of the two chunks only
    met = _met(zoned, key).join(halves, ["chrom", "_link", *key]).join(turns, ["chrom", "_link", "sample_id"], "left")
    after = states.select("chrom", F.col("_previous").alias("_link"), "sample_id", F.col("turned").alias("_after_turned"))
    both = met.join(after, ["chrom", "_link", "sample_id"], "left")
    first = F.when(F.col("_a").isNotNull(), _turned(F.col("_a"), F.col("turned"))).otherwise(F.col("_b"))
    second = _turned(F.coalesce("_b", "_a"), F.coalesce("_after_turned", F.lit(False)))
    from_later = F.when(F.col("_early"), F.col("_a").isNull()).otherwise(F.col("_b").isNotNull())
    inside = both.select("chrom", *key, "sample_id", F.when(F.col("_early"), first).otherwise(second).alias("gt"), F.when(from_later, F.col("_after")).otherwise(F.col("_link")).alias("chunk"))
    return outside.unionByName(inside)
