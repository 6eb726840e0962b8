"""One document of each group of near copies: SimHash and BK-trees first, then an exact check and the rest.

Documents are near copies if their sets of five-word shingles have a Jaccard similarity of 0.8 or more.

1. Every text gets the SimHash of its five-word shingles in 256 bits. BK-trees (``simhash.links``) over the
   first 64 name pairs within three bits, which are checked by their whole shingle sets and united.
2. Sets at a similarity of 0.8 differ in about ten of 64 bits, at which a BK-tree has nothing left to
   leave out. So what the trees can't see is found by prefixes of the sets: in any one order of all shingles,
   two sets of similarity t share a shingle among the first ``n - ceil(t n) + 1`` of each. The order
   puts shingles that a sample knows as frequent last; any order gives the same result. Pairs that share
   one, whose sizes and places allow the similarity and whose 256 bits differ in at most ``FAR``
   (similar sets differ in 39, give or take 6) are candidates, unless their sketches rule them out. A sketch
   is the parity of a set's number of shingles in each of ``SKETCH_BITS`` slots: two sets differ in at least
   as many shingles as their sketches in bits, so that no similar pair is lost.
3. A group's candidates are not all emitted: in a round each set names its ``NEAREST`` candidates outside its
   component, those are checked by whole sets and united. A round that unites nothing is followed by one
   that names more, up to all, and the end comes when each candidate outside a component has been checked.

Equality of shingles and of whole sets rests on 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelix.llm.blocks import release, stored
from allelix.llm.common import BoundedCache, chunks
from allelix.llm.graph import components
from allelix.llm.simhash import RADIUS
from allelix.llm.simhash import links as tree_links
from allelix.session import cut, ship_package

WIDTH, SEED = 5, 42
#: Similarity as a fraction.
OVER, UNDER = 4, 5
SAMPLE_ROWS = 10_000
#: Shingles known as frequent, at most: the only thing that is sent to all workers beside the slots.
FREQUENT = 100_000
#: Bits of 256 in which candidates differ at most: over six standard deviations more than similar sets do.
FAR = 76
#: The same for the first 64 bits, of which similar sets differ in 10, give or take 3.
FAR_FIRST = 28
#: Slots of a sketch: it tells pairs apart up to some 4,000 shingles, beyond that ever fewer.
SKETCH_BITS = 2048
#: Pairs whose sketches are compared at once.
SKETCH_PAIRS = 1 << 14
#: Candidates that a set names in a list and round at first, and how many times more after a round that unites nothing: all, then.
NEAREST, WIDER = 2, 64
#: Candidates of a list's set beyond which a round names all of them.
ALL = 64
SLOTS = 1 << 23
SETS = 256
WORD_KEYS = 100_000
_FACTORS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


class WordHashes(dict):
    """64-bit hashes of words; results never depend on what it holds."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_KEYS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, SEED)
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _FACTORS[1]
    h = (h ^ (h >> np.uint64(27))) * _FACTORS[2]
    return h ^ (h >> np.uint64(31))


def shingles(text: str, known: WordHashes) -> np.ndarray:
    """Distinct shingle hashes in ascending order; a text of fewer words is one shingle, one without words none."""
    words = text.encode().lower().split()  # ASCII letters and ASCII white space only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(WIDTH, len(h))
    n = len(h) - width + 1
    total = np.full(n, width, dtype=np.uint64)
    for i in range(width):
        total = mixed(total * _FACTORS[0] + h[i : i + n])
    return np.unique(total)


def fingerprint(held: np.ndarray) -> np.ndarray:
    """SimHash of a set of shingle hashes in 256 bits, as four signed numbers; zeros for the empty set."""
    if not len(held):
        return np.zeros(4, dtype=np.int64)
    ones = np.zeros(256, dtype=np.int64)
    for i in range(0, len(held), 1 << 13):
        part = held[i : i + (1 << 13)]
        lanes = np.stack([part, *(mixed(part + f) for f in _FACTORS)], axis=1)
        ones += np.unpackbits(lanes.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return np.packbits(ones * 2 > len(held), bitorder="little").view("<i8")


def sketch(held: np.ndarray) -> bytes:
    """Whether each slot holds an odd number of the set's shingles, in bits."""
    return np.packbits((np.bincount((held % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1).astype(bool)).tobytes()


def name(held: np.ndarray) -> int:
    """A set's name: a signed 64-bit hash of all its shingles."""
    return xxhash.xxh64_intdigest(held.tobytes(), SEED) - (1 << 63)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return (OVER + UNDER) * both >= OVER * (len(a) + len(b))


def frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, ranks): the most frequent shingles of a sample of texts, ascending; more frequent ones have larger ranks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for _, texts in chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingles(t, known) for t in texts]).view(np.int64))], names=["key"])

    n = docs.count()
    share = min(1.0, SAMPLE_ROWS / max(n, 1))
    sample = docs.select("text").where(F.pmod(F.xxhash64(F.xxhash64("text")), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = sample.mapInArrow(run, "key long").groupBy("key").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "key").limit(FREQUENT).toPandas()
    keys, counts = rows["key"].to_numpy(dtype=np.int64).view(np.uint64), rows["n"].to_numpy(dtype=np.int64)
    order = np.argsort(keys)
    return keys[order], counts[order]


def prefix(held: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first shingles of a set, as many as two sets that are alike must share one of."""
    n = len(held)
    if not n:
        return held
    keys, ranks = known
    rank = np.zeros(n, dtype=np.int64)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, held), len(keys) - 1)
        rank = np.where(keys[at] == held, ranks[at], 0)
    # ``held`` ascends, so that a stable sort leaves equal ranks in order
    return held[np.argsort(rank, kind="stable")][: n - -(-OVER * n // UNDER) + 1]


LANES = ["fp", "fp1", "fp2", "fp3"]
MARKED = "doc_id long, th long, rep long, fp long, fp1 long, fp2 long, fp3 long, size int, prefix array<long>, sketch binary"


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, the shingle set's name, and, in the first row of a set in each task, what belongs to the set."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent(docs))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, met = WordHashes(), set()
        for batch, texts in chunks(batches):
            out: list[list] = [[] for _ in range(8)]
            for text in texts:
                held = shingles(text, known)
                rep = name(held)
                row = (rep, *[None] * 7)
                if rep not in met:
                    met.add(rep)
                    row = (rep, *fingerprint(held).tolist(), len(held), prefix(held, sent.value).view(np.int64), sketch(held))
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            if len(met) > WORD_KEYS:
                met.clear()
            kinds = [*[pa.int64()] * 5, pa.int32(), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=[f.split()[0] for f in MARKED.split(", ")])
        del known, met
        release()

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text").mapInArrow(run, MARKED)


def whole_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of numbers, cut between two values of the first, by which the partition is sorted."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
        if not batch.num_rows:
            continue
        cut_at = int(np.searchsorted(columns[0], columns[0][-1]))
        if cut_at:
            yield [np.concatenate(x) for x in zip(*held, [c[:cut_at] for c in columns], strict=True)]
            held = []
        elif held and held[-1][0][-1] != columns[0][0]:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held = []
        held.append([c[cut_at:] for c in columns])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def candidates(key: np.ndarray, rep: np.ndarray, size: np.ndarray, pos: np.ndarray, lanes: list[np.ndarray], root: np.ndarray, most: int = FAR, sketches: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, bits that differ) of rows of one key that may be alike and have different roots; nothing is held."""
    i, step = np.arange(len(key)), 0
    while len(i):
        step += 1
        i = i[i + step < len(key)]
        i = i[key[i] == key[i + step]]
        j = i + step
        far = np.zeros(len(i), dtype=np.int64)
        for lane in lanes:
            far += np.bitwise_count((lane[i] ^ lane[j]).view(np.uint64))
        ok = (far <= most) & (root[i] != root[j]) & (rep[i] != rep[j]) & possible(size, pos, i, j)
        if sketches is not None and ok.any():
            ok[ok] = told_alike(sketches, size, i[ok], j[ok])
        if ok.any():
            yield i[ok], j[ok], far[ok]


_LIST = "key long, rep long, size int, pos int, fp long, fp1 long, fp2 long, fp3 long"
_LIST_NAMES = [f.split()[0] for f in _LIST.split(", ")]


def shared_prefixes(rows: DataFrame) -> DataFrame:
    """Places of the prefixes' shingles at which a set has a candidate: of lists of equal sets the first alone.

    All sets have the shingles that they share in the same order, so that what the first of these lists
    leaves out by its places the others leave out too.
    """

    def some(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rep, both, fp in whole_runs(batches):
            near, size, pos = np.zeros(len(key), dtype=bool), both >> 32, both & 0xFFFFFFFF
            for i, j, _ in candidates(key, rep, size, pos, [fp], rep, FAR_FIRST):
                near[i] = near[j] = True
            if near.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[near]) for c in (key, rep, size.astype(np.int32), pos.astype(np.int32))], names=_LIST_NAMES[:4])

    sets = rows.where("prefix IS NOT NULL")
    def nearer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rep, size, pos, *lanes in whole_runs(batches):
            near = np.zeros(len(key), dtype=bool)
            for i, j, _ in candidates(key, rep, size, pos, lanes, rep):
                near[i] = near[j] = True
            near[1:] &= (key[1:] != key[:-1]) | (rep[1:] != rep[:-1])  # a set that several tasks have met counts once
            if near.any():
                key, rep, size, pos, *lanes = (c[near] for c in (key, rep, size, pos, *lanes))
                begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                n = np.diff([*begin.tolist(), len(key)])
                members = np.repeat(mixed(np.add.reduceat(mixed(rep.view(np.uint64)), begin) + n.astype(np.uint64)), n).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (members, np.repeat(np.add.reduceat(pos.astype(np.int64), begin), n), key, rep, size, pos, *lanes)], names=["members", "places", *_LIST_NAMES])

    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for members, _, key, *rest in whole_runs(batches):
            begin = np.concatenate(([True], members[1:] != members[:-1]))
            keep = key == key[begin][np.cumsum(begin) - 1]
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (key, *rest)], names=_LIST_NAMES)

    # size and place travel in one number, and three of the four lanes only where the first one leaves a candidate, sketches where all four do
    placed = sets.select("rep", "size", "fp", F.posexplode("prefix").alias("pos", "key")).select("key", "rep", (F.shiftleft(F.col("size").cast("long"), 32) + F.col("pos")).alias("both"), "fp")
    found = cut(placed.repartition("key").sortWithinPartitions("key").mapInArrow(some, "key long, rep long, size int, pos int"))
    lanes = sets.select(F.col("rep").alias("node"), *LANES).dropDuplicates(["node"])
    by_key = found.join(lanes, F.col("rep") == F.col("node")).select(*_LIST_NAMES).repartition("key").sortWithinPartitions("key", "rep")
    alike_lists = by_key.mapInArrow(nearer, f"members long, places long, {_LIST}").repartition("members").sortWithinPartitions("members", "places", "key")
    sketches = sets.select(F.col("rep").alias("node"), "sketch").dropDuplicates(["node"])
    return alike_lists.mapInArrow(first, _LIST).join(sketches, F.col("rep") == F.col("node")).select(*_LIST_NAMES, "sketch")


def possible(size: np.ndarray, pos: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sets i and j of a list, if this is the first shingle they share, hold enough more for the similarity."""
    rest = np.minimum((size - pos)[i], (size - pos)[j]).astype(np.int64)
    return (OVER + UNDER) * rest >= OVER * (size[i].astype(np.int64) + size[j])


def told_alike(sketches: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the sketches (rows of 64-bit numbers) of sets i and j differ in no more bits than similar sets in shingles."""
    out = np.zeros(len(i), dtype=bool)
    for at in range(0, len(i), SKETCH_PAIRS):
        a, b = i[at : at + SKETCH_PAIRS], j[at : at + SKETCH_PAIRS]
        differ = np.bitwise_count(sketches[a] ^ sketches[b]).sum(axis=1, dtype=np.int64)
        out[at : at + SKETCH_PAIRS] = (OVER + UNDER) * differ <= (UNDER - OVER) * (size[a].astype(np.int64) + size[b])
    return out


def tree_pairs(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs of sets (a, b) whose fingerprints are linked by the trees, and of sets of one fingerprint."""
    sets = rows.where("prefix IS NOT NULL").select("fp", "rep").distinct()
    first = cut(sets.groupBy("fp").agg(F.min("rep").alias("first")))
    joined = tree_links(first.select("fp"), radius)
    one, two = (first.select(F.col("fp").alias(f"{x}_fp"), F.col("first").alias(f"{x}_first")) for x in "ab")
    linked = joined.join(one, F.col("a") == F.col("a_fp")).join(two, F.col("b") == F.col("b_fp")).select(F.col("a_first").alias("x"), F.col("b_first").alias("y"))
    same = sets.join(first.select(F.col("fp").alias("f"), F.col("first").alias("x")), F.col("fp") == F.col("f")).select("x", F.col("rep").alias("y")).where("x <> y")
    return linked.union(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def nearest(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], rep: np.ndarray, limit: int) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], bool]:
    """Of (i, j, bits) in both directions, the ``limit`` of each i, and whether any are left out."""
    i, j, far = (np.concatenate(x) for x in zip(*rows, strict=True))
    order = np.lexsort((rep[j], far, i))
    i, j, far = i[order], j[order], far[order]
    starts = np.concatenate(([True], i[1:] != i[:-1]))
    keep = np.arange(len(i)) - np.flatnonzero(starts)[np.cumsum(starts) - 1] < limit
    return [(i[keep], j[keep], far[keep])], not keep.all()


def _pairs_of(rep: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    two = np.unique(np.stack([np.minimum(rep[i], rep[j]), np.maximum(rep[i], rep[j])], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(two[:, 0]), pa.array(two[:, 1])], names=["a", "b"])


def pairs(lists: DataFrame, linked: DataFrame, limit: int = NEAREST) -> DataFrame:
    """Distinct pairs (a, b): in each list every set with its ``limit`` nearest candidates outside its component.

    A row of nulls says that candidates were left out. Beyond ``ALL`` none are, and nothing is held.
    Lists without the column ``sketch`` are taken by their other columns alone.
    """
    columns = [*_LIST_NAMES, *(["sketch"] if "sketch" in lists.columns else [])]
    named = lists.join(linked, F.col("rep") == F.col("node"), "left").select(*_LIST_NAMES, F.coalesce("root", "rep").alias("root"), *columns[len(_LIST_NAMES) :])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more = False
        for key, rep, size, pos, fp, fp1, fp2, fp3, root, *rest in whole_runs(batches):
            lanes, sketches = [fp, fp1, fp2, fp3], np.frombuffer(b"".join(rest[0]), dtype="<u8").reshape(len(key), -1) if rest else None
            best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for i, j, far in candidates(key, rep, size, pos, lanes, root, sketches=sketches):
                if limit > ALL:
                    yield _pairs_of(rep, i, j)
                    continue
                best += [(i, j, far), (j, i, far)]
                if sum(len(x[0]) for x in best) > 1_000_000 + limit * len(key):
                    best, cut_off = nearest(best, rep, limit)
                    more |= cut_off
            if best:
                ((i, j, _),), cut_off = nearest(best, rep, limit)
                more |= cut_off
                yield _pairs_of(rep, i, j)
        if more:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64())] * 2, names=["a", "b"])

    return named.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long").distinct()


def verified(likely: DataFrame, docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs whose whole sets are alike."""
    wanted = likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct()
    hashes = rows.join(wanted, F.col("rep") == F.col("node"), "left_semi").groupBy("rep").agg(F.min("th").alias("th")).select("th")
    texts = cut(texts_of(docs, hashes))
    left, right = (texts.select(F.col("rep").alias(f"{x}_rep"), F.col("text").alias(f"{x}_text")) for x in "ab")
    joined = likely.join(left, F.col("a") == F.col("a_rep")).join(right, F.col("b") == F.col("b_rep")).select("a", "b", "a_text", "b_text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = WordHashes(), BoundedCache(SETS)
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ok = np.zeros(len(a), dtype=bool)
            for i, two in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
                for k in held.missing(set(two)):
                    held[k] = shingles(batch.column(2 + two.index(k))[i].as_py() or "", known)
                ok[i] = alike(held[two[0]], held[two[1]])
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], names=["a", "b"])
        del known, held
        release()

    return joined.mapInArrow(run, "a long, b long")


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, text), one row of each set, for at least the text hashes (th) of ``wanted``.

    Others are left out where they are, by a bitmap of bounded size, so that not all texts are sent.
    """

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(SLOTS, dtype=bool)
        for batch in batches:
            bits[batch.column(0).to_numpy().view(np.uint64) % np.uint64(SLOTS)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])

    parts = wanted.coalesce(8).mapInArrow(mark, "bits binary").collect()
    bits = np.zeros(SLOTS // 8, dtype=np.uint8)
    for r in parts:
        bits |= np.frombuffer(r["bits"], dtype=np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, met = WordHashes(), set()
        for whole in batches:
            slot = whole.column(0).to_numpy().view(np.uint64) % np.uint64(SLOTS)
            hit = (sent.value[slot >> np.uint64(3)] >> (7 - (slot & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
            for i, th in zip(np.flatnonzero(hit).tolist(), whole.column(0).filter(pa.array(hit)).to_pylist(), strict=True):
                hit[i] = th not in met  # a copy was sent by this task
                met.add(th)
            for batch, texts in chunks([whole.filter(pa.array(hit))]):
                names = np.array([name(shingles(t, known)) for t in texts], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(names), batch.column(1)], names=["rep", "text"])
            if len(met) > WORD_KEYS:
                met.clear()
        del known, met
        release()

    return docs.select(F.xxhash64("text").alias("th"), "text").mapInArrow(run, "rep long, text string").dropDuplicates(["rep"])


def links(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, root) of the components of sets that are alike; ``rows`` are the marked ``docs``."""
    tried = cut(tree_pairs(rows))
    linked = cut(components(cut(verified(tried, docs, rows))))
    lists, limit = cut(shared_prefixes(rows)), NEAREST
    while True:
        named = cut(pairs(lists, linked, limit))
        all_named = named.where("a IS NULL").isEmpty()
        fresh = cut(named.where("a IS NOT NULL").join(tried, ["a", "b"], "left_anti"))
        found = None if fresh.isEmpty() else cut(verified(fresh, docs, rows))
        if found is not None and not found.isEmpty():
            # components that are known are stars: few rounds are left
            linked = cut(components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")).union(found)))
        elif not all_named:
            limit *= WIDER
        if all_named:
            return linked
        tried = tried.union(fresh)


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies in ``docs``, all columns: that of smallest doc_id, null ids last.

    Texts of fewer than five words are one shingle; null, empty and blank texts are alike. Of rows
    that share the smallest doc_id and the text one stays; a doc_id that is first in one group and
    also belongs to another stays in the first alone. Columns that are named like those made here
    do no harm; an empty table gives no rows.
    """
    ship_package(docs.sparkSession)
    rows = stored(marked(docs))
    linked = links(docs, rows)
    rooted = rows.join(linked, F.col("rep") == F.col("node"), "left").select("doc_id", "th", F.coalesce("root", "rep").alias("root"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("th").alias("hash"))).alias("first")
    kept = rooted.groupBy("root").agg(first).select(F.col("first.id").alias("first_id"), F.col("first.hash").alias("first_hash"))
    copies = rows.groupBy(F.col("doc_id").alias("copy_id"), F.col("th").alias("copy_hash")).agg(F.count("*").alias("copies"))
    kept = cut(kept.join(copies, F.col("first_id").eqNullSafe(F.col("copy_id")) & (F.col("first_hash") == F.col("copy_hash"))).select("first_id", "first_hash", "copies"))
    row_of = lambda x: docs["doc_id"].cast("long").eqNullSafe(x["first_id"]) & (F.xxhash64(docs["text"]) == x["first_hash"])
    once, often = kept.where("copies = 1"), kept.where("copies > 1")
    single = docs.join(once, row_of(once), "left_semi")
    return single.union(docs.join(often, row_of(often), "left_semi").dropDuplicates(["doc_id", "text"]))
