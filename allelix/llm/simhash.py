"""SimHash near-duplicates searched with BK-trees.

Distinct fingerprints are dealt to shards so that any two within the radius meet in at least one:
the 64 bits are cut into blocks, and of radius + b blocks two such fingerprints agree in b. Only as many
of the agreeing bits are used as leave a shard some thousand fingerprints. Each shard's fingerprints
form a BK-tree whose children are keyed by their distance to the parent; a search follows only the
edges that the triangle inequality leaves within the radius. A shard gives back a spanning forest of its
links, from which components are made.

Trees are built and searched in the shard's own task. They are not broadcast: together they hold all
fingerprints, which have no bound and may not pass through the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelix.llm.common import chunks, table
from allelix.llm.graph import components, key_runs, local_roots
from allelix.session import cut, ship_package

SHINGLE_WORDS, SEED, RADIUS = 3, 42, 3
LEAF = 16
#: Points that look for their links in one walk through a tree.
QUERIES = 4096
#: Fingerprints of a shard, about.
TREE_ROWS = 4096
#: A shard of more fingerprints is dealt out anew, by more of their bits, as often as it takes.
SHARD_ROWS = 32_768


def fingerprint(text: str, width: int = SHINGLE_WORDS) -> int:
    words = text.encode().lower().split()  # ASCII letters and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1])).tolist()
    ends = (ends - 1).tolist()
    hashes = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :], strict=False)] or [xxhash.xxh64_intdigest(joined, SEED)]
    h = np.array(hashes, dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 1 << 16):
        counts += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0])


class BKTree:
    """BK-tree over distinct 64-bit fingerprints, with small buckets of them at the leaves."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.followed = self.left_out = 0  # edges of nodes that a search came to
        # a node is (index of its point, {distance: child}) or an array of indices
        self.root = self._build(np.arange(len(points)))

    def _build(self, members: np.ndarray):
        top: dict[int, object] = {}
        stack = [(top, 0, members)]
        while stack:
            parent, edge, members = stack.pop()
            if len(members) <= LEAF:
                parent[edge] = members
                continue
            far = np.bitwise_count(self.points[members[1:]] ^ self.points[members[0]])
            order = np.argsort(far, kind="stable")
            edges, begin = np.unique(far[order], return_index=True)
            children: dict[int, object] = {}
            parent[edge] = (int(members[0]), children)
            for e, part in zip(edges.tolist(), np.split(members[1:][order], begin[1:]), strict=True):
                stack.append((children, e, part))
        return top[0]

    def search(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of query, index of point) of every pair within ``radius``."""
        found_q, found_p = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        stack = [(self.root, np.arange(len(queries)))]
        while stack:
            node, asked = stack.pop()
            if isinstance(node, np.ndarray):
                near = np.bitwise_count(queries[asked][:, None] ^ self.points[node][None, :]) <= radius
                q, p = np.nonzero(near)
                found_q.append(asked[q])
                found_p.append(node[p])
                continue
            center, children = node
            far = np.bitwise_count(queries[asked] ^ self.points[center]).astype(np.int64)
            hit = asked[far <= radius]
            found_q.append(hit)
            found_p.append(np.full(len(hit), center))
            for edge, child in children.items():
                on = asked[np.abs(far - edge) <= radius]
                self.followed, self.left_out = self.followed + len(on), self.left_out + len(asked) - len(on)
                if len(on):
                    stack.append((child, on))
        return np.concatenate(found_q), np.concatenate(found_p)


def forest(points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the points within ``radius`` of each other: at most one for each point."""
    tree, roots = BKTree(points), np.arange(len(points))
    for i in range(0, len(points), QUERIES):
        q, p = tree.search(points[i : i + QUERIES], radius)
        roots = local_roots(len(points), q + i, p, roots)
    linked = np.flatnonzero(roots != np.arange(len(points)))
    return points[linked], points[roots[linked]]


def routes(radius: int, blocks: int, bits: int = 64) -> list[int]:
    """Bit masks, of which two fingerprints within ``radius`` agree in all bits of at least one; of each at most ``bits``."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    agree = blocks - radius
    parts = [[1 << b for b in range(x, y)] for x, y in zip(cuts, cuts[1:], strict=False)]
    # the bits are taken from all agreeing blocks in turn
    share = [[bits // agree + (i < bits % agree) for i in range(agree)] for _ in parts]
    return [sum(sum(part[: share[0][i]]) for i, part in enumerate(chosen)) for chosen in combinations(parts, agree)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _dealt(rows: DataFrame, masks: list[int], first_shard: int = 0) -> DataFrame:
    """Every fingerprint once for each mask: the mask's number as ``shard``, its bits as ``key``."""
    keys = F.array(*(F.struct(F.lit(first_shard + i).alias("shard"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)))
    return rows.select("fp", F.inline(keys)).select("shard", "key", "fp")


def links(fingerprints: DataFrame, radius: int = RADIUS, tree_rows: int = TREE_ROWS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links (a, b) of distinct fingerprints (column fp) that connect all those within ``radius``."""
    ship_package(fingerprints.sparkSession)
    n = fingerprints.count()
    bits = max(0, (n // tree_rows).bit_length() - 1)
    # the fewest blocks that agree and have so many bits
    blocks = next(b for b in range(radius + 1, 65) if (b - radius) * (64 // b) >= bits or b == 64)
    masks = routes(radius, blocks, bits)
    dealt, n_shards = _dealt(fingerprints, masks), len(masks)
    settled: list[DataFrame] = []
    # those in large shards are dealt anew by more of their bits; in the last turn no shard can be large
    for finer in (radius + 5, radius + 9, radius + 13):
        large = cut(dealt.groupBy("shard", "key").agg(F.count("*").alias("n")).where(F.col("n") > shard_rows).select(F.col("shard").alias("large_shard"), F.col("key").alias("large_key")))
        if large.isEmpty():
            break
        known = dealt.join(large, (F.col("shard") == F.col("large_shard")) & (F.col("key") == F.col("large_key")), "left")
        settled.append(known.where("large_key is null").select("shard", "key", "fp"))
        masks = routes(radius, finer)
        dealt, n_shards = _dealt(known.where("large_key is not null").select("fp").distinct(), masks, n_shards), n_shards + len(masks)
    dealt = reduce(DataFrame.union, [*settled, dealt])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, fp in key_runs(batches, 2):
            a, b = forest(np.unique(fp).view(np.uint64), radius)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return dealt.repartition("shard", "key").sortWithinPartitions("shard", "key").mapInArrow(run, "a long, b long")


def with_fingerprints(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row of ``docs``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            found = np.array([fingerprint(t, width) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "fp"])

    ship_package(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def near_duplicates(docs: DataFrame, width: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """fingerprint and component_id of every row of ``docs``.

    Null and empty texts and those without words have fingerprint zero and are linked like any
    others. Repeated rows and equal texts share a fingerprint, so that they cost the search nothing.
    A component's id is its smallest doc_id; null doc_ids count only where there is no other one.
    Other columns are not read; an empty table gives no rows.
    """
    marked = cut(with_fingerprints(docs, width))
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    linked = components(links(distinct.select("fp"), radius))
    rooted = distinct.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id")).select(F.col("root").alias("r"), "component_id")
    classes = rooted.join(smallest, F.col("root") == F.col("r")).select(F.col("fp").alias("class_fp"), "component_id")
    joined = marked.join(classes, F.col("fp") == F.col("class_fp"))
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fingerprint and component_id of every row of documents: see ``near_duplicates``."""
    return near_duplicates(table(spark, sf_dir, "documents"))
