"""Pileup, calling and sequence models."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allelix.functions import variants as V

#: The standard codes of sets of bases.
IUPAC = {"AC": "M", "AG": "R", "AT": "W", "CG": "S", "CT": "Y", "GT": "K", "ACG": "V", "ACT": "H", "AGT": "D", "CGT": "B", "ACGT": "N"}


def pileup(reads: DataFrame, min_mapq: int = 0, forbidden_flags: int = 0x704) -> DataFrame:
    """Depth, bases and strands of each covered position, of reads (chrom, start, seq, mapq, flag) without gaps."""
    used = reads.where((F.col("mapq") >= min_mapq) & (F.col("flag").bitwiseAND(forbidden_flags) == 0))
    bases = used.select("chrom", "flag", "mapq", F.col("start"), F.posexplode(F.split("seq", "")).alias("i", "base")).where("base <> ''")
    of = lambda b: F.count_if(F.col("base") == b).alias(f"n_{b.lower()}")
    return bases.groupBy("chrom", (F.col("start") + F.col("i")).cast("int").alias("pos")).agg(
        F.count("*").alias("depth"), *(of(b) for b in "ACGT"), F.count_if(F.col("flag").bitwiseAND(16) != 0).alias("reverse"), F.sum("mapq").cast("long").alias("mapq_sum")
    )


def call_biallelic(counts: DataFrame, error: int = 20, half: int = 3) -> DataFrame:
    """Genotype, its quality and scaled likelihoods from n_ref and n_alt: phred costs of an error and of a fair draw."""
    costs = F.array(F.col("n_alt") * error, (F.col("n_ref") + F.col("n_alt")) * half, F.col("n_ref") * error)
    rows = counts.withColumn("pl", F.transform(costs, lambda x: (x - F.array_min(costs)).cast("long")))
    best = F.array_position("pl", F.lit(0)) - 1
    second = F.get(F.array_sort("pl"), F.lit(1))
    return rows.withColumn("gt", F.element_at(F.array(F.lit("0/0"), F.lit("0/1"), F.lit("1/1")), (best + 1).cast("int"))).withColumn("gq", F.least(second, F.lit(127).cast("long")))


def mendelian(calls: Column, child: int, father: int, mother: int) -> Column:
    """Whether the child's two alleles can come from one parent each; null unless all are diploid and called."""
    of = lambda s: F.get(F.transform(F.filter(calls, lambda c: c["sample_id"] == s), lambda c: V.gt_alleles(c["gt"])), F.lit(0))
    c, f, m = of(child), of(father), of(mother)
    sound = lambda a: (F.size(a) == 2) & ~F.exists(a, lambda x: x.isNull())
    a, b = F.get(c, F.lit(0)), F.get(c, F.lit(1))
    fits = (F.array_contains(f, a) & F.array_contains(m, b)) | (F.array_contains(f, b) & F.array_contains(m, a))
    return F.when(sound(c) & sound(f) & sound(m), fits)


def consensus_bases(sites: DataFrame) -> DataFrame:
    """The code of REF and all its single-base ALTs at each position."""
    single = sites.where(F.length("ref") == 1).select("chrom", "pos", F.explode(F.array_union(F.array("ref"), F.filter(F.split("alt", ","), lambda a: a.rlike("^[ACGT]$")))).alias("b"))
    key = F.array_join(F.array_sort(F.collect_set("b")), "")
    codes = F.create_map(*(F.lit(x) for kv in IUPAC.items() for x in kv))
    return single.groupBy("chrom", "pos").agg(key.alias("bases")).withColumn("code", F.coalesce(F.element_at(codes, F.col("bases")), F.col("bases")))


def consequence(ref: Column, alt: Column, coding: Column) -> Column:
    """Class of one ALT by its place and its change of length."""
    change = F.length(alt) - F.length(ref)
    return (
        F.when(~coding, "intergenic").when(alt.startswith("<"), "feature_truncation").when(alt == ".", "reference").when(change % 3 != 0, "frameshift")
        .when(change > 0, "inframe_insertion").when(change < 0, "inframe_deletion").otherwise("coding_sequence")
    )


def accuracy(truth: DataFrame, called: DataFrame, keys: list[str]) -> DataFrame:
    """True and false positives, false negatives, precision, recall and their harmonic mean."""
    from allelix.operators.sets import presence

    n = presence([truth, called], keys).agg(*(F.count_if(F.col("mask") == m).alias(c) for m, c in ((3, "tp"), (2, "fp"), (1, "fn"))))
    ratio = lambda a, b: F.when(b > 0, a / b)
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return n.select("tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def viterbi(emissions: np.ndarray, steps: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Most likely states: log emissions [n, k], log transitions into each observation [n, k, k], log start."""
    n, k = emissions.shape
    score, back = start + emissions[0], np.zeros((n, k), dtype=np.int64)
    for i in range(1, n):
        all_ways = score[:, None] + steps[i]
        back[i] = all_ways.argmax(axis=0)
        score = all_ways.max(axis=0) + emissions[i]
    path = np.empty(n, dtype=np.int64)
    path[-1] = score.argmax()
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def distance_steps(pos: np.ndarray, into: float, out: float) -> np.ndarray:
    """Log transitions of two states whose chance of a change grows with the distance."""
    gap = np.diff(pos, prepend=pos[0]).astype(np.float64)
    p, q = 0.5 * (1 - np.exp(-2 * into * gap)), 0.5 * (1 - np.exp(-2 * out * gap))
    return np.log(np.maximum(np.stack([np.stack([1 - p, p], axis=1), np.stack([q, 1 - q], axis=1)], axis=1), 1e-300))


def autozygous_segments(calls: DataFrame, into: float = 1e-4, out: float = 1e-3, error: float = 0.01, het: float = 0.35) -> DataFrame:
    """Runs of the autozygous state of each sample and contig, decoded over called diploid sites."""
    kinds = calls.select("sample_id", "chrom", "pos", V.gt_class(F.col("gt")).alias("cls")).where("cls NOT IN ('mis', 'hap')")
    sites = kinds.groupBy("sample_id", "chrom", "pos").agg(F.max(F.col("cls").isin("het", "het_alt")).alias("het"))

    def decode(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pos")
        seen = frame["het"].to_numpy()
        emissions = np.log(np.where(seen[:, None], [het, error], [1 - het, 1 - error]))
        path = viterbi(emissions, distance_steps(frame["pos"].to_numpy(), into, out), np.log([0.5, 0.5]))
        edge = np.flatnonzero(np.diff(path, prepend=0, append=0)).reshape(-1, 2)
        pos = frame["pos"].to_numpy()
        return pd.DataFrame({"sample_id": frame["sample_id"].iloc[0], "chrom": frame["chrom"].iloc[0], "beg": pos[edge[:, 0]], "end_": pos[edge[:, 1] - 1], "n": edge[:, 1] - edge[:, 0]}).astype({"n": "int64"})

    return sites.groupBy("sample_id", "chrom").applyInPandas(decode, "sample_id int, chrom string, beg int, end_ int, n long")


def mixture_components(values: DataFrame, bins: int) -> DataFrame:
    """Per contig, whether one or two normal components describe a histogram better (by BIC), and their means.

    ``values`` has chrom and bin; counts by bin are made before any group is formed.
    """
    counts = values.groupBy("chrom", "bin").agg(F.count("*").alias("n")).where(F.col("bin").between(0, bins - 1))

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        x, w = frame["bin"].to_numpy(dtype=np.float64), frame["n"].to_numpy(dtype=np.float64)
        order = np.argsort(x)
        x, w = x[order], w[order]
        total = w.sum()

        def normal(m: float, v: float) -> np.ndarray:
            return np.exp(-0.5 * (x - m) ** 2 / v) / np.sqrt(2 * np.pi * v)

        m = (w * x).sum() / total
        v = max((w * (x - m) ** 2).sum() / total, 0.25)
        one = (w * np.log(np.maximum(normal(m, v), 1e-300))).sum()
        half = np.searchsorted(np.cumsum(w), total / 2)
        means, variances, share = np.array([x[half // 2], x[min(len(x) - 1, (half + len(x)) // 2)]]), np.array([v, v]) / 2, np.array([0.5, 0.5])
        for _ in range(100):
            dens = np.stack([s * normal(a, b) for s, a, b in zip(share, means, variances, strict=True)])
            resp = w * dens / np.maximum(dens.sum(axis=0), 1e-300)
            mass = np.maximum(resp.sum(axis=1), 1e-9)
            share, means = mass / total, (resp * x).sum(axis=1) / mass
            variances = np.maximum((resp * (x - means[:, None]) ** 2).sum(axis=1) / mass, 0.25)
        two = (w * np.log(np.maximum(sum(s * normal(a, b) for s, a, b in zip(share, means, variances, strict=True)), 1e-300))).sum()
        k = 2 if -2 * two + 5 * np.log(total) < -2 * one + 2 * np.log(total) else 1
        return pd.DataFrame({"chrom": [frame["chrom"].iloc[0]], "components": [k], "low_mean": [float(means.min()) if k == 2 else float(m)], "high_mean": [float(means.max()) if k == 2 else float(m)], "n": [int(total)]})

    return counts.groupBy("chrom").applyInPandas(fit, "chrom string, components int, low_mean double, high_mean double, n long")
