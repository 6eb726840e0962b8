"""Whether bases of ALT differ from those of REF in quality, place or strand, from counts.

Observations are counted by (site, value) before they are brought together, so that a site's group holds
one row for each different value, however deep it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_sum(observations: DataFrame, keys: list[str], value: str, is_alt: Column) -> DataFrame:
    """``keys``, n_ref, n_alt and z: the normal score of the rank sum of ALT's values, corrected for ties; above 0 where they are larger.

    Without values on one side z is null, without any spread 0. Null values and null sides are left out.
    """
    side = observations.select(*keys, F.col(value).alias("_v"), is_alt.alias("_alt")).where("_v IS NOT NULL AND _alt IS NOT NULL")
    counts = side.groupBy(*keys, "_v").agg(F.count_if(~F.col("_alt")).cast("double").alias("r"), F.count_if(F.col("_alt")).cast("double").alias("a"))
    before = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("_below", F.coalesce(F.sum("r").over(before), F.lit(0.0)))
    t = F.col("r") + F.col("a")
    sums = ranked.groupBy(*keys).agg(F.sum("r").alias("r"), F.sum("a").alias("a"), F.sum(F.col("a") * (F.col("_below") + F.col("r") / 2)).alias("u"), F.sum(t * (t * t - 1)).alias("ties"))
    n = F.col("r") + F.col("a")
    variance = F.col("r") * F.col("a") / 12 * (n + 1 - F.when(n > 1, F.col("ties") / (n * (n - 1))).otherwise(0.0))
    z = F.when((F.col("r") > 0) & (F.col("a") > 0), F.when(variance <= 0, 0.0).otherwise((F.col("u") - F.col("r") * F.col("a") / 2) / F.sqrt(variance)))
    return sums.select(*keys, F.col("r").cast("long").alias("n_ref"), F.col("a").cast("long").alias("n_alt"), z.alias("z"))


def fisher_exact(n11: Column, n12: Column, n21: Column, n22: Column) -> Column:
    """Two-sided probability of a table of counts that is as rare as this one or rarer, its margins given; 1 for an empty one.

    Probabilities follow from each other along the possible tables, relative to the one seen.
    """
    first, left = n11 + n12, n11 + n21
    low, high = F.greatest(F.lit(0), left - n21 - n22), F.least(first, left)
    # the logarithm of the ratio of the tables k + 1 and k in the first cell
    step = lambda k: F.log((first - k) * (left - k)) - F.log((k + 1) * (n21 + n22 - left + k + 1))
    steps = lambda a, b: F.when(b > a, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))
    start = F.aggregate(steps(low, n11), F.lit(0.0), lambda s, k: s - step(k))

    def add(s: Column, k: Column) -> Column:
        now = s["now"] + step(k)
        return F.struct(now.alias("now"), (s["all"] + F.exp(now)).alias("all"), (s["rare"] + F.when(now <= 1e-7, F.exp(now)).otherwise(0.0)).alias("rare"))

    begin = F.transform(F.array(start), lambda x: F.struct(x.alias("now"), F.exp(x).alias("all"), F.when(x <= 1e-7, F.exp(x)).otherwise(0.0).alias("rare")))
    done = F.transform(begin, lambda b: F.aggregate(steps(low, high), b, add, lambda s: s["rare"] / s["all"]))
    return F.least(F.get(done, F.lit(0)), F.lit(1.0))


def strand_bias(observations: DataFrame, keys: list[str], is_alt: Column, is_reverse: Column) -> DataFrame:
    """``keys``, the four counts (rf, rr, af, ar: REF and ALT on forward and reverse strands) and ``p`` of Fisher's exact test, with ``phred`` of it."""
    of = lambda alt, reverse: F.count_if((is_alt == alt) & (is_reverse == reverse)).cast("long")
    counts = observations.groupBy(*keys).agg(of(False, False).alias("rf"), of(False, True).alias("rr"), of(True, False).alias("af"), of(True, True).alias("ar"))
    tested = counts.withColumn("p", fisher_exact(*(F.col(c) for c in ("rf", "rr", "af", "ar"))))
    return tested.withColumn("phred", F.abs(-4.343 * F.log(F.greatest("p", F.lit(1e-300)))))
