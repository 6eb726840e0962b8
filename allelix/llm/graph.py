"""Connected components of link tables, and helpers for sorted partitions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelix.session import cut

#: Links of one node from which on it is a hub: there are at most twice as many hubs as ``links / HUB_LINKS``.
HUB_LINKS = 100_000
#: Hubs that are sent to all workers at most (16 bytes each); with more links a hub needs more of them.
MOST_HUBS = 50_000


def with_smallest(rows: DataFrame, low: DataFrame, least: int) -> DataFrame:
    """``rows`` (a, b) with the number m of ``low`` (k, m, n) for each a, without one task for the rows of a hub.

    Hubs, nodes with more than ``least`` rows, are looked up where the rows are: their table is
    broadcast, and its size is bounded through ``least``. All others are joined by a shuffle.
    """
    hubs = F.broadcast(low.where(F.col("n") > least).select(F.col("k").alias("hub"), F.col("m").alias("hub_m")))
    marked = rows.join(hubs, F.col("a") == F.col("hub"), "left")
    of_hubs = marked.where("hub IS NOT NULL").select("a", "b", F.col("hub_m").alias("m"))
    others = marked.where("hub IS NULL").select("a", "b").join(low.where(F.col("n") <= least), F.col("a") == F.col("k")).select("a", "b", "m")
    return of_hubs.union(others)


def components(edges: DataFrame, hub_links: int = HUB_LINKS) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): root is the smallest node of its component.

    Alternating large and small stars, until a round changes nothing: the number of rounds grows with
    the logarithm of the longest path. Minima are combined before their shuffle; the joins that follow
    look hubs up without a shuffle (``with_smallest``). Each round is stored in the shared checkpoint
    folder. Self-links and repeated links do no harm; rows with a null are left out; a node with
    self-links only is missing.
    """
    links = cut(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    now, before = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first(), None
    while now != before:
        least = max(hub_links, 4 * now[0] // MOST_HUBS)
        smallest = lambda x: x.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))

        def spread(rows: DataFrame, low: DataFrame) -> DataFrame:
            # a node can't have more rows than there are
            return with_smallest(rows, low, least) if 2 * now[0] > least else rows.join(low, F.col("a") == F.col("k")).select("a", "b", "m")

        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = smallest(both).select(F.col("a").alias("k"), F.least("a", "m").alias("m"), "n")
        large = spread(both.where("b > a"), low).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = smallest(large).select(F.col("a").alias("k"), "m", "n")
        pairs = spread(large, low).select(F.inline(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))))
        links = cut(pairs.where("a <> b").distinct())
        before, now = now, links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def local_roots(n: int, a: np.ndarray, b: np.ndarray, roots: np.ndarray | None = None) -> np.ndarray:
    """Smallest index reachable from each of ``n`` by links a-b, given those of earlier links."""
    roots = np.arange(n) if roots is None else roots
    while True:
        low = np.minimum(roots[a], roots[b])
        new = roots.copy()
        np.minimum.at(new, roots[a], low)
        np.minimum.at(new, roots[b], low)
        while True:
            further = new[new]
            if (further == new).all():
                break
            new = further
        if (new == roots).all():
            return new
        roots = new


def key_runs(batches: Iterable[pa.RecordBatch], n_keys: int, least: int = 2) -> Iterator[list[np.ndarray]]:
    """Columns of each run of rows that are equal in the first ``n_keys`` columns, if it has ``least`` rows.

    The partition must be sorted by those columns; all columns are numbers without nulls.
    """
    held: list[list[np.ndarray]] = []

    def split(columns: list[np.ndarray], last: bool) -> tuple[list[list[np.ndarray]], list[np.ndarray]]:
        n = len(columns[0])
        change = np.zeros(max(0, n - 1), dtype=bool)
        for k in columns[:n_keys]:
            change |= k[1:] != k[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), n]
        if not last:
            rest = [c[cuts[-2] :] for c in columns]
            cuts = cuts[:-1]
        else:
            rest = []
        sizes = np.diff(cuts)
        return [[c[cuts[i] : cuts[i + 1]] for c in columns] for i in np.flatnonzero(sizes >= least).tolist()], rest

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
        if held and all((k == held[0][i][0]).all() for i, k in enumerate(columns[:n_keys])):
            held.append(columns)  # the run goes on: join its parts once only
            continue
        if held:
            columns = [np.concatenate(x) for x in zip(*held, columns, strict=True)]
        found, rest = split(columns, last=False)
        yield from found
        held = [rest]
    if held:
        found, _ = split([np.concatenate(x) for x in zip(*held, strict=True)], last=True)
        yield from found
