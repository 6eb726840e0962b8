"""Hidden states along contigs, decoded span by span.

A contig is cut into spans of positions. Of each span and sequence of states a small matrix is made: the best score (or the
summed probability) of getting from each state at its first site to each state at its last. These are
chained along the contig, one row for each span, which gives the scores with which each span is entered
and the state in which the best path leaves it. Every span is then decoded by itself, and the path is the
one that a decoding of the whole contig finds. Scores are whole millionths of natural logarithms, so that
sums don't depend on how a contig is cut.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from allelix.functions import variants as V
from allelix.operators.intervals import overlapping
from allelix.session import cut

SCALE = 1_000_000
#: Positions of a span.
SPAN = 1 << 20
#: A score below all others.
NEVER = -(1 << 60)


def transitions(gaps: np.ndarray, into: float, out: float, shares: np.ndarray | None = None) -> np.ndarray:
    """Scores [n, from, to] of two states over distances: chances ``into`` and ``out`` of a change at each base, compounded; then scaled by ``shares``."""
    rate = into + out
    kept = np.power(1 - rate, np.maximum(gaps, 0).astype(np.float64))
    up, down = into / rate * (1 - kept), out / rate * (1 - kept)
    if shares is not None:
        up, down = up * shares, down * shares
    p = np.stack([np.stack([1 - up, up], axis=1), np.stack([down, 1 - down], axis=1)], axis=1)
    return np.maximum(np.rint(np.log(np.maximum(p, 1e-300)) * SCALE), NEVER).astype(np.int64)


def shares_between(places: np.ndarray) -> np.ndarray:
    """Recombination between neighbouring places of a genetic map, at most 1; 1 where a place is unknown."""
    steps = np.diff(places, prepend=places[:1])
    return np.where(np.isnan(steps), 1.0, np.minimum(np.abs(steps), 1.0))


def best(entry: np.ndarray, emissions: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best scores of each state after the last site, and for each site the state before it; ``entry`` has the scores at the first site without its emission."""
    score, back = entry + emissions[0], np.zeros(emissions.shape, np.int8)
    for i in range(1, len(emissions)):
        ways = score[:, None] + steps[i]
        back[i] = ways.argmax(axis=0)
        score = ways.max(axis=0) + emissions[i]
    return score, back


def log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis=axis))


def summed(entry: np.ndarray, emissions: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Log probabilities [n, k] of all that comes up to each site."""
    out = np.empty(emissions.shape)
    out[0] = entry + emissions[0]
    for i in range(1, len(emissions)):
        out[i] = log_sum(out[i - 1][:, None] + steps[i], 0) + emissions[i]
    return out


def summed_back(leave: np.ndarray, emissions: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Log probabilities [n, k] of all that comes after each site."""
    out = np.empty(emissions.shape)
    out[-1] = leave
    for i in range(len(emissions) - 1, 0, -1):
        out[i - 1] = log_sum(steps[i] + emissions[i] + out[i], 1)
    return out


def decode(sites: DataFrame, into: float, out: float, span: int = SPAN) -> DataFrame:
    """``sites`` with ``state`` (0 or 1, of the best path) and ``posterior`` (the probability of state 1 at the site, by all paths).

    ``sites`` has sample_id, chrom, pos and the scores e0 and e1 (long), one row for each sample and position, and may have ``place``
    (Morgans), by which changes are scaled. State 1 is entered with ``into`` and left with ``out`` at each base; both begin with equal chances. Rows
    without sample, contig, position or scores are left out. Results are the same for every ``span``; of equally
    good paths one is taken.
    """
    columns = ["sample_id", "chrom", "pos", "e0", "e1", *(["place"] if "place" in sites.columns else [])]
    rows = sites.select(*columns).dropna(subset=columns[:5]).withColumn("span", F.floor(F.col("pos") / span).cast("long"))
    kind = rows.schema["sample_id"].dataType.simpleString()

    def read(frame: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
        frame = frame.sort_values("pos")
        pos = frame["pos"].to_numpy(np.int64)
        shares = shares_between(frame["place"].to_numpy(np.float64)) if "place" in frame else None
        return frame, frame[["e0", "e1"]].to_numpy(np.int64), transitions(np.diff(pos, prepend=pos[:1]), into, out, shares)

    def matrices(frame: pd.DataFrame) -> pd.DataFrame:
        frame, emissions, steps = read(frame)
        tops, sums = [], []
        for s in (0, 1):
            entry = np.full(2, NEVER)
            entry[s] = 0
            tops += best(entry, emissions, steps)[0].tolist()
            sums += summed(np.where(entry < 0, -1e30, 0.0), emissions / SCALE, steps / SCALE)[-1].tolist()
        one, last = frame.iloc[0], frame.iloc[-1]
        place = lambda r: float(r["place"]) if "place" in frame else float("nan")
        return pd.DataFrame({"sample_id": [one["sample_id"]], "chrom": [one["chrom"]], "span": [int(one["span"])], "first": [int(one["pos"])], "last": [int(last["pos"])], "p0": [place(one)], "p1": [place(last)], "best": [tops], "sums": [sums]})

    spans = rows.groupBy("sample_id", "chrom", "span").applyInPandas(matrices, f"sample_id {kind}, chrom string, span long, first long, last long, p0 double, p1 double, best array<long>, sums array<double>")
    along = spans.groupBy("sample_id", "chrom").agg(F.array_sort(F.collect_list(F.struct("span", "first", "last", "p0", "p1", "best", "sums"))).alias("s"))
    mapped = "place" in sites.columns

    def chain(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for s in frame["s"]:
                n = len(s)
                gaps = np.array([0, *(s[i]["first"] - s[i - 1]["last"] for i in range(1, n))])
                here, there = (np.array([x[c] for x in s], np.float64) for c in ("p0", "p1"))  # null is nan
                jumps = np.abs(np.concatenate([[0.0], here[1:] - there[:-1]]))
                steps = transitions(gaps, into, out, np.where(np.isnan(jumps), 1.0, np.minimum(jumps, 1.0)) if mapped else None)
                tops, sums = np.array([list(x["best"]) for x in s]).reshape(n, 2, 2), np.array([list(x["sums"]) for x in s]).reshape(n, 2, 2)
                half = np.rint(np.log(0.5) * SCALE).astype(np.int64)
                enter, ends, enter_sum, leave_sum = np.empty((n, 2), np.int64), np.empty((n, 2), np.int64), np.empty((n, 2)), np.zeros((n, 2))
                for i in range(n):
                    enter[i] = half if i == 0 else (ends[i - 1][:, None] + steps[i]).max(axis=0)
                    ends[i] = (enter[i][:, None] + tops[i]).max(axis=0)
                    enter_sum[i] = np.log(0.5) if i == 0 else log_sum(log_sum(enter_sum[i - 1][:, None] + sums[i - 1], 0)[:, None] + steps[i] / SCALE, 0)
                state = np.empty(n, np.int64)
                for i in range(n - 1, -1, -1):
                    if i == n - 1:
                        state[i] = ends[i].argmax()
                    else:
                        first = (enter[i + 1] + tops[i + 1][:, state[i + 1]]).argmax()
                        state[i] = (ends[i] + steps[i + 1][:, first]).argmax()
                        leave_sum[i] = log_sum(steps[i + 1] / SCALE + log_sum(sums[i + 1] + leave_sum[i + 1], 1), 1)
                found.append([{"span": s[i]["span"], "enter": enter[i].tolist(), "state": int(state[i]), "enter_sum": enter_sum[i].tolist(), "leave_sum": leave_sum[i].tolist()} for i in range(n)])
            yield pd.DataFrame({"sample_id": frame["sample_id"], "chrom": frame["chrom"], "x": found})

    known = along.mapInPandas(chain, f"sample_id {kind}, chrom string, x array<struct<span: long, enter: array<long>, state: int, enter_sum: array<double>, leave_sum: array<double>>>")
    known = cut(known.select("sample_id", "chrom", F.inline("x")))

    def inside(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        frame, emissions, steps = read(left)
        to = right.iloc[0]
        _, back = best(np.array(to["enter"]), emissions, steps)
        path = np.empty(len(frame), np.int64)
        path[-1] = to["state"]
        for i in range(len(frame) - 1, 0, -1):
            path[i - 1] = back[i, path[i]]
        both = summed(np.array(to["enter_sum"]), emissions / SCALE, steps / SCALE) + summed_back(np.array(to["leave_sum"]), emissions / SCALE, steps / SCALE)
        posterior = np.exp(both[:, 1] - log_sum(both, 1))
        return pd.DataFrame({"sample_id": frame["sample_id"], "chrom": frame["chrom"], "pos": frame["pos"], "state": path, "posterior": posterior, "span": frame["span"]})

    grouped = rows.groupBy("sample_id", "chrom", "span").cogroup(known.groupBy("sample_id", "chrom", "span"))
    return grouped.applyInPandas(inside, f"sample_id {kind}, chrom string, pos int, state int, posterior double, span long")


def segments(decoded: DataFrame) -> DataFrame:
    """Runs of state 1 of ``decode``: sample_id, chrom, beg, end_, n (sites) and qual (the mean phred quality of their posteriors, 99 at most).

    Runs are made span by span; only those that reach the first or last site of their span are then put together along the contig.
    """
    whole = Window.partitionBy("sample_id", "chrom", "span")
    inside = whole.orderBy("pos")
    before = F.lag("state").over(inside)
    marked = decoded.withColumns({"_new": F.when((F.col("state") == 1) & (F.coalesce(before, F.lit(0)) == 0), 1).otherwise(0), "_low": F.min("pos").over(whole), "_high": F.max("pos").over(whole)})
    numbered = marked.withColumn("_run", F.sum("_new").over(inside)).where("state = 1")
    quality = F.least(-10 * F.log10(F.greatest(1 - F.col("posterior"), F.lit(1e-300))), F.lit(99.0))
    runs = numbered.groupBy("sample_id", "chrom", "span", "_run", "_low", "_high").agg(F.min("pos").alias("beg"), F.max("pos").alias("end_"), F.count("*").alias("n"), F.sum(quality).alias("q"))
    border = (F.col("beg") == F.col("_low")) | (F.col("end_") == F.col("_high"))
    # spans without a run at their first site are there too, so that a run is not joined over them
    spans = decoded.groupBy("sample_id", "chrom", "span").agg(F.min(F.struct("pos", "state"))["state"].alias("_first"))
    order = Window.partitionBy("sample_id", "chrom").orderBy("span")
    numbers = spans.select("sample_id", "chrom", "span", F.row_number().over(order).alias("_at"))
    along = Window.partitionBy("sample_id", "chrom").orderBy("beg")
    joined = runs.where(border).join(numbers, ["sample_id", "chrom", "span"])
    goes_on = (F.col("beg") == F.col("_low")) & (F.lag("_reaches").over(along)) & (F.lag("_at").over(along) == F.col("_at") - 1)
    joined = joined.withColumn("_reaches", F.col("end_") == F.col("_high")).withColumn("_starts", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("_chain", F.sum("_starts").over(along))
    merged = joined.groupBy("sample_id", "chrom", "_chain").agg(F.min("beg").alias("beg"), F.max("end_").alias("end_"), F.sum("n").alias("n"), F.sum("q").alias("q")).drop("_chain")
    every = merged.unionByName(runs.where(~border).select("sample_id", "chrom", "beg", "end_", "n", "q"))
    return every.select("sample_id", "chrom", "beg", "end_", "n", (F.col("q") / F.col("n")).alias("qual"))


def autozygosity_scores(calls: DataFrame, unlikely: float = 30.0) -> DataFrame:
    """``calls`` (with gt or pl, and af) with scores of two states: e0 by Hardy-Weinberg shares of genotypes, e1 without heterozygotes.

    ``pl`` are phred likelihoods of 0/0, 0/1 and 1/1; without that column genotypes count, other ones having ``unlikely`` as phred. Calls that
    are missing or haploid, equal likelihoods, and frequencies of 0 or 1 tell nothing and are left out.
    """
    af = F.col("af")
    if "pl" in calls.columns:
        p = F.transform(F.slice("pl", 1, 3), lambda x: F.pow(F.lit(10.0), -x / 10.0))
        known = (F.size("pl") >= 3) & (F.size(F.array_distinct(F.slice("pl", 1, 3))) > 1)
    else:
        cls = V.gt_class(F.col("gt"))
        rare = 10 ** (-unlikely / 10)
        p = F.array(*(F.when(cls == c, 1 - 2 * rare).otherwise(rare) for c in ("hom_ref", "het", "hom_alt")))
        known = cls.isin("hom_ref", "het", "hom_alt")
    rows = calls.where(known & (af > 0) & (af < 1)).withColumn("_p", p).withColumn("_sum", F.aggregate("_p", F.lit(0.0), lambda s, x: s + x))
    of = lambda i: F.get("_p", F.lit(i)) / F.col("_sum")
    hw = of(0) * (1 - af) * (1 - af) + 2 * of(1) * af * (1 - af) + of(2) * af * af
    az = of(0) * (1 - af) + of(2) * af
    score = lambda x: F.round(F.log(F.greatest(x, F.lit(1e-300))) * SCALE).cast("long")
    return rows.withColumns({"e0": score(hw), "e1": score(az)}).drop("_p", "_sum")


def with_places(sites: DataFrame, genetic_map: DataFrame) -> DataFrame:
    """``sites`` with ``place`` in Morgans, between two entries of the map (chrom, pos, cm) in proportion; before the first and after the last entry theirs."""
    w = Window.partitionBy("chrom").orderBy("pos")
    bound = genetic_map.groupBy(F.col("chrom").alias("_c")).agg(F.min_by("cm", "pos").alias("_cm0"), F.max_by("cm", "pos").alias("_cm1"), F.min("pos").alias("_p0"))
    pieces = genetic_map.select("chrom", F.col("pos").alias("_a"), F.col("cm").alias("_x"), F.lead("pos").over(w).alias("_b"), F.lead("cm").over(w).alias("_y")).where("_b > _a").withColumn("_z", F.col("_b") - 1)
    keys = sites.select("chrom", "pos").distinct()
    met = overlapping(keys.withColumn("_pos", F.col("pos")), pieces, ("pos", "_pos"), ("_a", "_z"))
    inside = met.select("chrom", "pos", (F.col("_x") + (F.col("_y") - F.col("_x")) * (F.col("pos") - F.col("_a")) / (F.col("_b") - F.col("_a"))).alias("_cm"))
    joined = sites.join(inside, ["chrom", "pos"], "left").join(bound, F.col("chrom") == F.col("_c"), "left")
    cm: Column = F.coalesce("_cm", F.when(F.col("pos") < F.col("_p0"), F.col("_cm0")).otherwise(F.col("_cm1")))
    return joined.withColumn("place", cm / 100).select(*sites.columns, "place")
