"""Batches of reads as arrays: runs of CIGARs, pooled qualities of mates, counts by position, insertions and deletions.

Spark deals reads to tasks, brings mates together and adds up what tasks have counted; here a batch of reads is worked
on at once. Names, bases and qualities are ASCII text, as SAM demands. CIGARs of a batch are walked once each.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bounds of pooled qualities, of mapping qualities and of what a base adds to the sums of qualities.
MOST_POOLED, MOST_MAPQ, LEAST_Q, MOST_Q = 200, 60, 4, 63
REVERSE = 0x10
#: Positions of a block of counts, and blocks that a task holds: they bound memory, never results.
BLOCK, MOST_BLOCKS = 1 << 10, 512
#: Columns of counts: all bases, A, C, G, T each forward and reverse, their qualities, and sums over counted bases.
COUNTS = ["raw_depth", *(f"_{s}{b}" for b in "ACGT" for s in "fr"), *(f"_q{b}" for b in "ACGT"), "mq0", "mapq_sum", "clipped"]
_CODE = np.full(256, 4, dtype=np.int64)
_CODE[np.frombuffer(b"ACGT", np.uint8)] = np.arange(4)
_NOTHING, _DELETED = 0, 1


def _walk(cigar: str) -> tuple[np.ndarray, np.ndarray]:
    """Runs (reference offset, length, place in the read or -1 where deleted) and events (offset of the base before, place in the read, inserted, deleted)."""
    ref = read = 0
    after, runs, events = "", [], []
    for n, op in re.findall("([0-9]+)([MIDNSHP=X])", cigar):
        n = int(n)
        if op in "M=XD" and n:
            runs.append((ref, n, -1 if op == "D" else read))
        if op in "ID" and after and after in "M=X":
            events.append((ref - 1, read, n if op == "I" else 0, n if op == "D" else 0))
        ref, read = ref + n * (op in "MDN=X"), read + n * (op in "MIS=X")
        after = after if op == "P" else op
    return np.array(runs, np.int64).reshape(-1, 3), np.array(events, np.int64).reshape(-1, 4)


_walk_short = lru_cache(maxsize=1 << 12)(_walk)


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ``counts[i]`` elements of each i: i, and their numbers from 0."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(np.arange(len(counts)), counts), np.arange(total) - np.repeat(ends - counts, counts)


def _text(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and lengths of a column of text."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), at[:-1], np.diff(at)


def _codes(column: pa.Array) -> tuple[np.ndarray, list]:
    """Numbers of a column's values, and the values with null at the end."""
    coded = column.dictionary_encode()
    values = [*coded.dictionary.to_pylist(), None]
    return coded.indices.fill_null(len(values) - 1).to_numpy(zero_copy_only=False).astype(np.int64), values


def _ints(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def borders(batch: pa.RecordBatch, key: list[str]) -> np.ndarray:
    """Whether each row but the first differs from the one before it in ``key``; nulls are equal."""
    out = np.zeros(max(batch.num_rows - 1, 0), bool)
    for name in key:
        a, b = batch.column(name).slice(1), batch.column(name).slice(0, max(batch.num_rows - 1, 0))
        out |= pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        if batch.column(name).null_count:
            out |= pc.xor(a.is_null(), b.is_null()).to_numpy(zero_copy_only=False)
    return out


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def whole_groups(batches: Iterable[pa.RecordBatch], key: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows that lie in order of ``key`` in batches that hold all rows of a key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and borders(_joined([held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1)]), key)[0]:
            yield _joined(held)
            held = []
        cuts = np.flatnonzero(borders(batch, key))
        if len(cuts):
            yield _joined([*held, batch.slice(0, int(cuts[-1]) + 1)])
            held = [batch.slice(int(cuts[-1]) + 1)]
        else:
            held.append(batch)
    if held:
        yield _joined(held)


def odd_names(names: pa.Array) -> np.ndarray:
    """Whether the hash of a read's name that chooses between mates is odd: 31-fold sums, then six rounds of shifts, in 32 bits."""
    data, starts, lengths = _text(names)
    power = np.cumprod(np.concatenate((np.ones(1, np.uint32), np.full(int(lengths.max(initial=1)), 31, np.uint32))), dtype=np.uint32)
    which, i = spread(lengths)
    terms = data[starts[which] + i].astype(np.uint32) * power[lengths[which] - 1 - i]
    sums = np.concatenate((np.zeros(1, np.uint32), np.cumsum(terms, dtype=np.uint32)))
    ends = np.cumsum(lengths)
    k = sums[ends] - sums[ends - lengths]
    k = k + ~(k << np.uint32(15))
    k = k ^ (k >> np.uint32(10))
    k = k + (k << np.uint32(3))
    k = k ^ (k >> np.uint32(6))
    k = k + ~(k << np.uint32(11))
    return (k ^ (k >> np.uint32(16))) & np.uint32(1) == 1


def partners(batch: pa.RecordBatch, key: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The row of each read's mate, -1 without one, and whether it keeps pooled qualities. Of a key, those in front lie before those behind."""
    n = batch.num_rows
    group = np.concatenate((np.zeros(1, np.int64), np.cumsum(borders(batch, key))))[:n]
    behind = batch.column("_behind").to_numpy(zero_copy_only=False).astype(bool)
    total, front = np.bincount(group), np.bincount(group, weights=~behind).astype(np.int64)
    start, front, total = (np.cumsum(total) - total)[group], front[group], total[group]
    rank = np.arange(n) - start - np.where(behind, front, 0)
    mate = start + rank + np.where(behind, 0, front)
    return np.where(rank < np.where(behind, front, total - front), mate, -1), odd_names(batch.column("qname")) != behind


def _laid_out(batch: pa.RecordBatch, pick: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (``pick`` 0) or events (1) of all reads: the read of each, a table of them by CIGAR, and where it lies in that."""
    codes, cigars = _codes(batch.column("cigar"))
    walks = [(_walk_short if len(c) < 256 else _walk)(c)[pick] for c in (c or "" for c in cigars)]
    counts = np.array([len(w) for w in walks])
    which, i = spread(counts[codes])
    return which, np.concatenate(walks), (np.cumsum(counts) - counts)[codes][which] + i


class Piled:
    """Aligned bases of a batch of reads, in the order of reads and positions: read, base and q, in runs of ``run_read``, ``ref``, ``read_at`` and ``n``."""

    def __init__(self, batch: pa.RecordBatch, key: list[str] | None):
        self.batch = batch
        pos = _ints(batch.column("pos"))
        seq, seq_at, self.lengths = _text(batch.column("seq"))
        qual, qual_at, _ = _text(batch.column("qual"))
        which, table, at = _laid_out(batch, 0)
        ref, n, read = pos[which] + table[at, 0], table[at, 1], table[at, 2]
        n = np.where(read >= 0, np.minimum(n, self.lengths[which] - read), n)
        some = n > 0
        which, ref, n, read = which[some], ref[some], n[some], read[some]
        aligned = read >= 0
        self.run_read, self.ref, self.n, self.read_at = which[aligned], ref[aligned], n[aligned], read[aligned]
        self.run, self.within = spread(self.n)
        self.read = self.run_read[self.run]
        self.base = seq[(seq_at[self.run_read] + self.read_at)[self.run] + self.within]
        self.q = qual[(qual_at[self.run_read] + self.read_at)[self.run] + self.within].astype(np.int16) - 33
        if key:
            mate, keeps = partners(batch, key)
            self._pool(mate, keeps, which, ref, n, read, aligned, seq, seq_at, qual, qual_at)

    def _pool(self, mate, keeps, which, ref, n, read, aligned, seq, seq_at, qual, qual_at) -> None:
        """Two mates over one position count once; runs of a read meet those of its mate by their order."""
        high = np.int64(1) << 32
        begins, ends = which * high + ref, which * high + ref + n
        of = mate[self.run_read]
        first = np.searchsorted(ends, of * high + self.ref, side="right")
        last = np.searchsorted(begins, of * high + self.ref + self.n, side="left")
        a, i = spread(np.where(of >= 0, np.maximum(last - first, 0), 0))
        b = first[a] + i
        low = np.maximum(self.ref[a], ref[b])
        met, j = spread(np.minimum(self.ref[a] + self.n[a], ref[b] + n[b]) - low)
        place = (np.cumsum(self.n) - self.n)[a] + low - self.ref[a]
        place = place[met] + j
        b, skip = b[met], (low - ref[b])[met] + j
        there = read[b] >= 0
        at = np.where(there, read[b] + skip, 0)
        mb = np.where(there, seq[np.where(there, seq_at[which[b]] + at, 0)], _DELETED) if len(seq) else np.zeros(0, np.uint8)
        mq = np.where(there, qual[np.where(there, qual_at[which[b]] + at, 0)].astype(np.int16) - 33, 0) if len(qual) else np.zeros(0, np.int16)
        q, base, own = self.q[place], self.base[place], keeps[self.read[place]]
        four_fifths = q * 4 // 5
        kept = np.where(own, four_fifths, 0)
        pooled = np.where(mb == base, np.where(own, np.minimum(q + mq, MOST_POOLED), 0), np.where(q > mq, four_fifths, np.where(q < mq, 0, kept)))
        self.q[place] = np.where(there, pooled, kept)

    def _of_reads(self, name: str) -> np.ndarray:
        return _ints(self.batch.column(name))

    def _clips(self) -> np.ndarray:
        codes, cigars = _codes(self.batch.column("cigar"))
        return np.array(["S" in re.findall("[0-9]+([MIDNSHP=X])", c or "") for c in cigars])[codes]

    def rows(self) -> pa.RecordBatch:
        """A row for each base."""
        read = pa.array(self.read)
        text = pa.StringArray.from_buffers(len(self.base), pa.py_buffer(np.arange(len(self.base) + 1, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(self.base)))
        columns = {
            "sample": self.batch.column("sample").take(read), "chrom": self.batch.column("chrom").take(read), "pos": pa.array((self.ref[self.run] + self.within).astype(np.int32)), "base": text,
            "q": pa.array(self.q.astype(np.int32)), "mapq": self.batch.column("mapq").take(read), "reverse": pa.array((self._of_reads("flag") & REVERSE != 0)[self.read]),
            "read_at": pa.array((self.read_at[self.run] + self.within + 1).astype(np.int32)), "read_length": pa.array(self.lengths[self.read].astype(np.int32)), "clipped": pa.array(self._clips()[self.read]),
        }
        return pa.RecordBatch.from_pydict(columns)

    def counts(self, min_q: int) -> tuple[list[tuple], np.ndarray, np.ndarray]:
        """Blocks (sample, chrom, number), cells (block times ``BLOCK`` plus place in it) and their counts."""
        samples, sample_names = _codes(self.batch.column("sample"))
        chroms, chrom_names = _codes(self.batch.column("chrom"))
        shift = BLOCK.bit_length() - 1
        first = self.ref >> shift
        run, i = spread(((self.ref + self.n - 1) >> shift) - first + 1)
        block = first[run] + i
        code = ((samples * len(chrom_names) + chroms)[self.run_read[run]] << 32) + block
        found, at = np.unique(code, return_inverse=True)
        low = np.maximum(self.ref[run], block << shift)
        n = np.minimum(self.ref[run] + self.n[run], (block + 1) << shift) - low
        piece, j = spread(n)
        cell = ((at << shift) + (low & (BLOCK - 1)))[piece] + j
        cells = np.arange(len(found) << shift)
        if len(cells) > 4 * len(cell):
            cells, cell = np.unique(cell, return_inverse=True)
        m = len(cells)
        mapq, reverse, clipped = np.minimum(self._of_reads("mapq"), MOST_MAPQ), (self._of_reads("flag") & REVERSE != 0).astype(np.int64), self._clips()
        base = _CODE[self.base]
        good = np.flatnonzero((base < 4) & (self.q >= min_q))
        read, where, base, quality = self.read[good], cell[good], base[good], mapq[self.read[good]]
        weight = np.maximum(np.minimum(np.minimum(self.q[good], quality), MOST_Q), LEAST_Q)
        sums = [
            np.bincount(cell, minlength=m), np.bincount(where * 8 + base * 2 + reverse[read], minlength=8 * m).reshape(m, 8), np.bincount(where * 4 + base, weights=weight, minlength=4 * m).reshape(m, 4),
            np.bincount(where[quality == 0], minlength=m), np.bincount(where, weights=quality, minlength=m), np.bincount(where[clipped[read]], minlength=m),
        ]
        blocks = [(sample_names[c // len(chrom_names)], chrom_names[c % len(chrom_names)], b) for c, b in zip((found >> 32).tolist(), (found & 0xFFFFFFFF).tolist(), strict=True)]
        return blocks, cells, np.column_stack(sums).astype(np.int64)


def _count_rows(blocks: list[tuple], cells: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    some = np.flatnonzero(counts[:, 0])
    block, place, counts = cells[some] // BLOCK, cells[some] % BLOCK, counts[some]
    names = [pa.array([b[i] for b in blocks], pa.string()).take(pa.array(block)) for i in (0, 1)]
    pos = np.array([b[2] for b in blocks], np.int64)[block] * BLOCK + place
    return pa.RecordBatch.from_arrays([*names, pa.array(pos.astype(np.int32)), *(pa.array(np.ascontiguousarray(c)) for c in counts.T)], names=["sample", "chrom", "pos", *COUNTS])


def counted(batches: Iterable[pa.RecordBatch], key: list[str] | None, min_q: int) -> Iterator[pa.RecordBatch]:
    """Counts of a task's reads: a row for each position and fill of the blocks it holds, all in one where reads lie by position."""
    held: dict[tuple, np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        keys = list(held)
        for i in range(0, len(keys), 64):
            part = keys[i : i + 64]
            yield _count_rows(part, np.arange(len(part) * BLOCK), np.concatenate([held.pop(k) for k in part]))

    for batch in whole_groups(batches, key) if key else batches:
        if not batch.num_rows:
            continue
        blocks, cells, counts = Piled(batch, key).counts(min_q)
        if len(cells) < len(blocks) * BLOCK:
            yield _count_rows(blocks, cells, counts)
            continue
        for i, block in enumerate(blocks):
            part = counts[i * BLOCK : (i + 1) * BLOCK]
            if block in held:
                held[block] += part
            else:
                if len(held) >= MOST_BLOCKS:
                    yield from flush()
                held[block] = part.copy()
    yield from flush()


def observed(batches: Iterable[pa.RecordBatch], key: list[str] | None) -> Iterator[pa.RecordBatch]:
    for batch in whole_groups(batches, key) if key else batches:
        if batch.num_rows:
            yield Piled(batch, key).rows()


def events(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Insertions and deletions right after aligned bases, one row each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        which, table, at = _laid_out(batch, 1)
        pos, (seq, starts, lengths) = _ints(batch.column("pos")), _text(batch.column("seq"))
        ref, read, inserted, deleted = (table[at, i] for i in range(4))
        n = np.maximum(np.minimum(inserted, lengths[which] - read), 0)
        event, i = spread(n)
        bases = np.ascontiguousarray(seq[(starts[which] + read)[event] + i])
        offsets = np.concatenate((np.zeros(1, np.int32), np.cumsum(n, dtype=np.int32)))
        yield pa.RecordBatch.from_pydict({
            "sample": batch.column("sample").take(pa.array(which)), "chrom": batch.column("chrom").take(pa.array(which)), "pos": pa.array((pos[which] + ref).astype(np.int32)),
            "inserted": pa.StringArray.from_buffers(len(n), pa.py_buffer(offsets), pa.py_buffer(bases)), "deleted": pa.array(deleted.astype(np.int32)),
            "forward": pa.array((_ints(batch.column("flag")) & REVERSE == 0)[which]),
        })
