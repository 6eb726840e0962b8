"""Comparison of samples: pairs are formed inside each record, so that records aren't joined."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from allelix.functions import variants as V


def sample_pairs(variants: DataFrame) -> DataFrame:
    """Of each pair of samples: sites where both are called, equal dosages, and the sum of differences."""
    called = F.filter(F.transform("calls", lambda c: F.struct(c["sample_id"].alias("s"), V.dosage(c["gt"]).alias("d"))), lambda c: c["d"].isNotNull())
    rows = variants.select(called.alias("c"))
    pairs = F.flatten(F.transform("c", lambda x: F.transform(F.filter("c", lambda y: y["s"] > x["s"]), lambda y: F.struct(x["s"].alias("sample_a"), y["s"].alias("sample_b"), F.abs(x["d"] - y["d"]).alias("d")))))
    return rows.select(F.inline(pairs)).groupBy("sample_a", "sample_b").agg(F.count("*").alias("sites"), F.count_if(F.col("d") == 0).alias("matches"), F.sum("d").cast("long").alias("discordance"))


def best_matches(pairs: DataFrame, k: int) -> DataFrame:
    """The ``k`` samples most alike to each."""
    both = pairs.select("sample_a", "sample_b", "matches").union(pairs.select(F.col("sample_b"), F.col("sample_a"), F.col("matches")))
    w = Window.partitionBy("sample_a").orderBy(F.desc("matches"), "sample_b")
    return both.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
