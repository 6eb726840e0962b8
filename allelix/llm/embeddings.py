"""Near-duplicate vectors by sorted projection passes.

In each pass vectors are ordered by a concatenation of signs of random projections, so that vectors
at a small angle tend to stand near each other. Each is compared with a window of those before it,
and further back as long as comparisons find links. Verified links of all passes are united; links
are then counted, exactly, among the members of each component.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelix.llm.common import table
from allelix.llm.graph import components, local_roots
from allelix.session import cut, ship_package

THRESHOLD = 0.95
#: Passes at least, and the share of pairs at the threshold that all passes together may miss.
PASSES, MISSED = 24, 1e-3
BITS = 63
WINDOW = 256
BLOCK = 128
#: Members of a component that are compared with each other in one group.
GROUP_ROWS = 2048
SEED = 20_240_601


def hyperplanes(dimensions: int, passes: int) -> np.ndarray:
    return np.random.default_rng([SEED, dimensions]).standard_normal((dimensions, passes * BITS))


def passes_for(n: int, threshold: float = THRESHOLD, window: int = WINDOW) -> int:
    """Passes over ``n`` spread-out vectors, growing with the logarithm of ``n`` and faster.

    In one pass a pair meets if it agrees in the leading bits that leave about a window of vectors;
    it agrees in a bit with the share of the half circle that its angle leaves.
    """
    bits = max(0.0, math.log2(max(n, 1) / window))
    meets = (1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi) ** bits
    return max(PASSES, math.ceil(math.log(MISSED) / math.log1p(-meets))) if meets < 1 else PASSES


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision, without overflow or underflow."""
    rows = rows.astype(np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one dimension as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _by_dimension(batch: pa.RecordBatch, at: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each dimension among the batch's vectors."""
    column = batch.column(at)
    sizes = np.asarray(column.value_lengths())
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield rows, _matrix(column.take(pa.array(rows)))


class WindowPass:
    """Links of a stream of vectors that arrive in the order of a pass."""

    def __init__(self, threshold: float, window: int):
        self.threshold, self.window = threshold, window
        self.blocks: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A spanning forest of the links of a new block with itself and with the ones before it."""
        seen, reach = [(ids, rows)], 0
        a, b = np.nonzero(np.triu(rows @ rows.T >= self.threshold, 1))
        found_a, found_b, base = [a], [b], len(ids)
        used = 0
        for old_ids, old in reversed(self.blocks):
            a, b = np.nonzero(rows @ old.T >= self.threshold)
            used += 1
            reach += len(old_ids)
            found_a.append(a)
            found_b.append(b + base)
            base += len(old_ids)
            seen.append((old_ids, old))
            if reach >= self.window and not len(a):
                break
        # blocks that this one did not come to are out of reach of later ones
        self.blocks = [*self.blocks[len(self.blocks) - used :], (ids, rows)]
        names = np.concatenate([x for x, _ in seen])
        roots = local_roots(base, np.concatenate(found_a), np.concatenate(found_b))
        at = np.flatnonzero(roots != np.arange(base))
        return names[at], names[roots[at]]


def links(vectors: DataFrame, threshold: float = THRESHOLD, passes: int = PASSES, window: int = WINDOW) -> DataFrame:
    """Links (a, b) that connect the vectors (rep, embedding) found at ``threshold`` or more."""

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for whole in batches:
            for begin in range(0, whole.num_rows, 1000):
                batch = whole.slice(begin, 1000)
                for at, rows in _by_dimension(batch, 1):
                    d = rows.shape[1]
                    if d not in planes:
                        planes[d] = hyperplanes(d, passes)
                    signs = (unit(rows) @ planes[d] >= 0).reshape(len(at), passes, BITS)
                    keys = signs @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                    part = batch.take(pa.array(np.tile(at, passes)))
                    order = [pa.array(np.repeat(np.arange(passes, dtype=np.int32), len(at))), pa.array(np.full(len(at) * passes, d, dtype=np.int32)), pa.array(keys.T.reshape(-1))]
                    yield pa.RecordBatch.from_arrays([*order, part.column(0), part.column(1)], names=["pass", "d", "key", "rep", "embedding"])

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = engine = None
        for batch in batches:
            place = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
            cuts = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1).tolist(), len(place)] if len(place) else [0]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if at is None or (place[x] != at).any():
                    at, engine = place[x], WindowPass(threshold, window)
                ids, rows = batch.column(3).to_numpy()[x:y], unit(_matrix(batch.column(4).slice(x, y - x)))
                for i in range(0, y - x, BLOCK):
                    a, b = engine.add(ids[i : i + BLOCK], rows[i : i + BLOCK])
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    kind = vectors.schema["embedding"].dataType.simpleString()
    projected = vectors.select("rep", "embedding").mapInArrow(project, f"pass int, d int, key long, rep long, embedding {kind}")
    order = ("pass", "d", "key", "rep")
    return projected.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(compare, "a long, b long")


def count_links(members: DataFrame, threshold: float = THRESHOLD, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(rep, linked): copies of other members (root, rep, copies, embedding) at ``threshold`` or more.

    A component's members are cut into parts; each pair of parts is one group of bounded size.
    """
    sizes = members.groupBy("root").agg(F.count("*").alias("n")).select(F.col("root").alias("r"), F.ceil(F.col("n") / group_rows).cast("int").alias("parts"))
    placed = members.join(sizes, F.col("root") == F.col("r")).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    paired = placed.select("root", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"), "rep", "copies", "embedding")
    groups = paired.select("root", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "rep", "copies", "embedding")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            held = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            i, j, part, rep, copies = (held.column(k).to_numpy() for k in range(1, 6))
            out = np.zeros(len(rep), dtype=np.int64)
            for at, rows in _by_dimension(held, 6):
                rows = unit(rows)
                first = part[at] == i[0]
                second = part[at] == j[0]
                for begin in range(0, len(at), 512):
                    mine = slice(begin, begin + 512)
                    near = rows[mine] @ rows.T >= threshold
                    # in a group of two parts only links between them count, else each pair once
                    near &= (first[mine][:, None] & second[None, :]) | (second[mine][:, None] & first[None, :])
                    k = np.arange(begin, min(begin + 512, len(at)))
                    near[k - begin, k] = False
                    out[at[mine]] += near @ copies[at]
            return pa.RecordBatch.from_arrays([pa.array(rep), pa.array(out)], names=["rep", "linked"])

        pending: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            start = 0
            for n, k in enumerate(keys):
                if k != key:
                    if n > start:
                        pending.append(batch.slice(start, n - start))
                    if pending:
                        yield counted(pending)
                    pending, key, start = [], k, n
            if len(keys) > start:
                pending.append(batch.slice(start))
        if pending:
            yield counted(pending)

    found = groups.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(run, "rep long, linked long")
    return found.groupBy("rep").agg(F.sum("linked").alias("linked"))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, passes: int | None = None) -> DataFrame:
    """n_links, component_id and kept of every row of ``vectors``; as many passes as ``passes_for`` says if none are named.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing and
    stay. Equal vectors are compared as one and count as links of each other; vectors of different
    dimensions don't link. A null vec_id takes part and counts as larger than all others. Other
    columns are not read; an empty table gives no rows.
    """
    ship_package(vectors.sparkSession)
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), "embedding")
    e = F.col("embedding")
    sound = F.coalesce(F.exists(e, lambda x: x != 0) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))), F.lit(False))
    classes = rows.where(sound).groupBy("embedding").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))
    # a class is named by its smallest vec_id, which a row of another class may share: by its content as well
    classes = cut(classes.select(F.xxhash64("embedding", "first_id").alias("rep"), "first_id", "copies", "embedding"))
    linked = cut(components(links(classes, threshold, passes or passes_for(classes.count(), threshold))))
    members = classes.join(linked, F.col("rep") == F.col("node")).select("root", "rep", "copies", "embedding", "first_id")
    counts = count_links(members, threshold).select(F.col("rep").alias("c"), "linked")
    smallest = members.groupBy("root").agg(F.min("first_id").alias("component_id")).select(F.col("root").alias("r"), "component_id")
    named = members.join(smallest, F.col("root") == F.col("r")).join(counts, F.col("rep") == F.col("c")).select(F.col("rep").alias("m"), "component_id", "linked")
    full = classes.join(named, F.col("rep") == F.col("m"), "left").select(
        F.col("embedding").alias("vector"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "first_id").alias("component_id")
    )
    joined = rows.withColumn("key", F.when(sound, e)).join(full, F.col("key") == F.col("vector"), "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors: see ``near_duplicates``."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
