"""Set operations on record sets: one shuffle by key, with partial aggregation before it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def presence(inputs: list[DataFrame], keys: list[str]) -> DataFrame:
    """Every distinct key with ``mask``, in which bit i tells that input i has it."""
    tagged = [df.select(*keys, F.lit(1 << i).alias("_bit")) for i, df in enumerate(inputs)]
    return reduce(DataFrame.unionByName, tagged).groupBy(*keys).agg(F.bit_or("_bit").alias("mask"))


def matches(mask: Column, wanted: str, n: int) -> Column:
    """``=k``, ``+k``, ``-k`` inputs (exactly, at least, at most) or ``~0101`` (exactly these)."""
    kind, value = wanted[0], wanted[1:]
    if kind == "~":
        if len(value) != n or set(value) - set("01"):
            raise ValueError(f"a pattern of {n} digits is needed: {wanted!r}")
        return mask == sum(1 << i for i, c in enumerate(value) if c == "1")
    count = F.bit_count(mask)
    return {"=": count == int(value), "+": count >= int(value), "-": count <= int(value)}[kind]


def first_of(records: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first record of each key, by ``order``, as a partially aggregated minimum rather than a sort."""
    rest = [c for c in records.columns if c not in keys and c not in order]
    row = F.struct(*order, *rest)
    found = records.groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("_row"))
    return found.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in [*order, *rest] if c not in keys))


def soft_filter(records: DataFrame, passes: Column, name: str) -> DataFrame:
    """Records that fail get ``name`` added to FILTER; records that pass and had none become PASS."""
    held = F.col("filter")
    failed = F.when(held.isin("PASS", "."), name).otherwise(F.concat(held, F.lit(";" + name)))
    return records.withColumn("filter", F.when(~passes, failed).when(held == ".", "PASS").otherwise(held))


def merge_records(inputs: list[DataFrame]) -> DataFrame:
    """Records of equal alleles as one: highest QUAL, depths summed, identifiers and filters joined."""
    rows = reduce(DataFrame.unionByName, inputs)
    joined = lambda c, none: F.array_join(F.array_sort(F.collect_set(F.when(~F.col(c).isin(*none), F.col(c)))), ";")
    return rows.groupBy("chrom", "pos", "ref", "alt").agg(
        F.max("qual").alias("qual"), F.sum("info_dp").alias("dp_sum"), F.min("info_dp").alias("dp_min"), F.max("info_dp").alias("dp_max"),
        joined("id", ["."]).alias("id"), joined("filter", [".", "PASS"]).alias("filter"),
    )
