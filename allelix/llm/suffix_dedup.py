"""Removal of long repeated byte strings with suffix arrays sorted bucket by bucket.

A cover of all positions makes far-apart suffixes comparable: of every 200-byte string the 96-byte
piece of least hash is sampled, so that equal strings hold a sample at equal offsets. (A cover by
residues would need ranks of a fixed share of all positions on every machine; this one has the same
property for equal strings and about one sample in 53 bytes.) The strings that share a sample are
a contiguous run of starts around it.

1. The samples are ranked: shards learn of every sample whether it occurs once, always amid the same
   run of bytes, or amid different ones. Equal ranks settle long ties without their bytes: runs that
   are equal as a whole are repeats.
2. Only for samples amid different bytes the runs themselves are sent, to one bucket for each sample.
   A shard sorts the suffixes and the reversed prefixes around the samples, one batch of buckets at a
   time; the lengths of common prefixes give classes of equal strings at every offset.
3. A bucket with very many different runs is split by its strings' 128-bit fingerprints instead.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from allelix.llm.blocks import answer, as_blocks, receive, send, shard_count, stored
from allelix.llm.common import table

LENGTH, SAMPLE = 200, 96
REACH = LENGTH - SAMPLE  # furthest that a string starts before its sample
WINDOW = REACH + 1
#: Bytes worked on at once; longer texts are cut into overlapping parts.
PART_BYTES = 1 << 18
#: Different runs around one sample from which on its bucket is split by fingerprints.
LARGE_BUCKET = 2_000
SHARD_BYTES = 24 << 20
UNIQUE, REPEATED, MIXED, LARGE = 0, 1, 2, 3
RUNS, STRINGS = 1, 2

_POSITION_BITS = np.uint64(26)
_POSITION = np.uint64((1 << 26) - 1)
_RANDOM = np.random.default_rng(7_919)
_TABLES = _RANDOM.integers(0, 1 << 63, size=(2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_powers: list[tuple[np.ndarray, np.ndarray]] = []


def _power_tables(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of the two odd factors and of their inverses modulo 2**64."""
    global _powers
    if not _powers or len(_powers[0][0]) < n:
        size = max(n, PART_BYTES + LENGTH + 1)
        _powers = []
        for factor in _FACTORS:
            pair = []
            for f in (factor, pow(factor, -1, 1 << 64)):
                steps = np.full(size, f, dtype=np.uint64)
                steps[0] = 1
                pair.append(np.multiply.accumulate(steps))
            _powers.append((pair[0], pair[1]))
    return _powers


class Fingerprints:
    """Two 64-bit fingerprints of any substring of a byte array."""

    def __init__(self, data: np.ndarray):
        self.tables = _power_tables(len(data) + 1)
        self.sums = []
        for (up, _), values in zip(self.tables, _TABLES, strict=True):
            total = np.zeros(len(data) + 1, dtype=np.uint64)
            np.cumsum(values[data] * up[: len(data)], out=total[1:])
            self.sums.append(total)

    def of(self, which: int, start, stop) -> np.ndarray:
        return (self.sums[which][stop] - self.sums[which][start]) * self.tables[which][1][start]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def sliding_minimum(keys: np.ndarray, width: int) -> np.ndarray:
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = keys
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


@dataclass
class Runs:
    """Runs of string starts that share a sample, in the coordinates of a block's bytes."""

    sample: np.ndarray  # fingerprint of the sample
    around: np.ndarray  # fingerprint of all the run's bytes, the sample's place in them included
    low: np.ndarray  # first start
    high: np.ndarray  # last start
    at: np.ndarray  # the sample's place


def find_runs(data: np.ndarray, ends: np.ndarray) -> Runs:
    """All runs of documents that stand in a row in ``data`` and stop at ``ends``."""
    starts = np.concatenate(([0], ends[:-1]))
    # parts of whole short documents, or overlapping parts of a long one
    parts: list[tuple[int, int]] = []
    begin = 0
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        if e - begin > PART_BYTES:
            if s > begin:
                parts.append((begin, s))
            begin = s
            while e - begin > PART_BYTES:
                parts.append((begin, begin + PART_BYTES))
                begin += PART_BYTES - LENGTH + 1
    if len(data) > begin:
        parts.append((begin, len(data)))
    columns: list[list[np.ndarray]] = [[] for _ in range(5)]
    for a, b in parts:
        if b - a < LENGTH:
            continue
        inner = ends[(ends > a) & (ends <= b)]
        valid = np.ones(b - a - LENGTH + 1, dtype=bool)
        # a string may not reach over the end of a document
        bounds = inner[inner < b] - a
        change = np.zeros(len(valid) + 1, dtype=np.int32)
        np.add.at(change, np.clip(bounds - LENGTH + 1, 0, len(valid)), 1)
        np.add.at(change, np.minimum(bounds, len(valid)), -1)
        valid &= np.cumsum(change[:-1]) == 0
        at = np.flatnonzero(valid)
        if not len(at):
            continue
        prints = Fingerprints(data[a:b])
        place = np.arange(b - a - SAMPLE + 1)
        samples = prints.of(0, place, place + SAMPLE)
        order = (mixed(samples) >> _POSITION_BITS) << _POSITION_BITS | place.astype(np.uint64)
        chosen = (sliding_minimum(order, WINDOW)[at] & _POSITION).astype(np.int64)
        first = np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (np.diff(at) > 1)))
        low, sample_at = at[first], chosen[first]
        high = at[np.concatenate((np.flatnonzero(first)[1:] - 1, [len(at) - 1]))]
        around = prints.of(1, low, high + LENGTH) + (sample_at - low).astype(np.uint64) * np.uint64(_FACTORS[0]) + (high - low).astype(np.uint64)
        for c, x in zip(columns, (samples[sample_at], mixed(around), low + a, high + a, sample_at + a), strict=True):
            c.append(x)
    joined = [np.concatenate(c) if c else np.zeros(0, dtype=np.uint64 if i < 2 else np.int64) for i, c in enumerate(columns)]
    return Runs(*joined)


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((mixed(h) >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)


class BlockRepeats:
    """What a block sends, and what it makes of the answers. The same rows give the same messages."""

    def __init__(self, rows: pa.Table, shards: int, large: int):
        text = rows["text"].combine_chunks() if isinstance(rows["text"], pa.ChunkedArray) else rows["text"]
        texts = text.fill_null("").cast(pa.large_binary())
        self.sizes = np.asarray(pa.compute.binary_length(texts), dtype=np.int64)
        self.raw = b"".join(texts.to_pylist())
        self.data = np.frombuffer(self.raw, dtype=np.uint8)
        self.ends = np.cumsum(self.sizes)
        self.shards, self.large = shards, large
        self.runs = find_runs(self.data, self.ends) if len(self.data) else Runs(*(np.zeros(0, dtype=np.uint64) for _ in range(2)), *(np.zeros(0, dtype=np.int64) for _ in range(3)))
        r = self.runs
        # runs in the order of shard, sample, bytes around; a class is a sample, a kind a class's bytes
        self.order = np.lexsort((r.around, r.sample, shard_of(r.sample, shards)))
        s, c = r.sample[self.order], r.around[self.order]
        new_class = np.concatenate(([True], s[1:] != s[:-1])) if len(s) else np.zeros(0, bool)
        new_kind = new_class | np.concatenate(([True], c[1:] != c[:-1])) if len(s) else new_class
        self.class_of, self.kind_of = np.cumsum(new_class) - 1, np.cumsum(new_kind) - 1
        self.class_at, self.kind_at = np.flatnonzero(new_class), np.flatnonzero(new_kind)

    def _by_shard(self, shard: np.ndarray) -> Iterator[tuple[int, slice]]:
        cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)] if len(shard) else [0]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield int(shard[a]), slice(a, b)

    def samples(self) -> Iterator[tuple[int, int, bytes]]:
        """Of each class: its sample, the bytes around the first run, the number of kinds, whether a kind repeats."""
        first = self.order[self.class_at]
        n = len(first)
        kinds = np.bincount(self.class_of[self.kind_at], minlength=n)
        repeats = np.bincount(self.class_of, minlength=n) > kinds
        record = np.empty(n, dtype=_SAMPLE_RECORD)
        record["sample"], record["around"] = self.runs.sample[first], self.runs.around[first]
        record["kinds"], record["repeats"] = np.minimum(kinds, 65_535), repeats
        for shard, part in self._by_shard(shard_of(record["sample"], self.shards)):
            yield shard, 0, record[part].tobytes()

    def learn(self, answers: dict[tuple[int, int], bytes]) -> None:
        """The class's state from the shards' first answers."""
        state = [np.zeros(0, dtype=np.uint8)]
        for shard, part in self._by_shard(shard_of(self.runs.sample[self.order[self.class_at]], self.shards)):
            state.append(np.frombuffer(zlib.decompress(answers[0, shard]), dtype=np.uint8))
            if len(state[-1]) != part.stop - part.start:
                raise ValueError("an answer doesn't fit its message")
        self.state = np.concatenate(state)

    def _mixed_kinds(self) -> tuple[np.ndarray, np.ndarray]:
        """Kinds of mixed classes, and the run that stands for each."""
        kinds = np.flatnonzero(self.state[self.class_of[self.kind_at]] == MIXED)
        return kinds, self.order[self.kind_at[kinds]]

    def _strings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, two fingerprints) of all strings in runs of large classes."""
        runs = self.order[np.flatnonzero(self.state[self.class_of] == LARGE)]
        low, n = self.runs.low[runs], (self.runs.high - self.runs.low + 1)[runs]
        starts = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])) if len(n) else low, n) + np.arange(n.sum())
        starts.sort()
        out = [[], []]
        for i in range(0, len(starts), 50_000):
            part = starts[i : i + 50_000]
            # strings of this part lie in pieces of the data; fingerprints need no more than these
            cuts = np.flatnonzero(np.diff(part) > 1 << 16) + 1
            for piece in np.split(part, cuts):
                a = int(piece[0])
                while len(piece):
                    inside = piece[piece + LENGTH <= a + PART_BYTES]
                    prints = Fingerprints(self.data[a : int(inside[-1]) + LENGTH])
                    for w in (0, 1):
                        out[w].append(mixed(prints.of(w, inside - a, inside - a + LENGTH)))
                    piece = piece[len(inside) :]
                    a = int(piece[0]) if len(piece) else a
        return starts, *(np.concatenate(x) if x else np.zeros(0, dtype=np.uint64) for x in out)

    def _string_keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        starts, h1, h2 = self._strings()
        order = np.lexsort((h2, h1, shard_of(h1, self.shards)))
        h1, h2 = h1[order], h2[order]
        new = np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))) if len(h1) else np.zeros(0, bool)
        return starts[order], np.cumsum(new) - 1, h1[new], h2[new], np.bincount(np.cumsum(new) - 1) if len(h1) else np.zeros(0, np.int64)

    def runs_and_strings(self) -> Iterator[tuple[int, int, bytes]]:
        kinds, runs = self._mixed_kinds()
        r = self.runs
        record = np.empty(len(runs), dtype=_RUN_RECORD)
        record["sample"], record["around"] = r.sample[runs], r.around[runs]
        record["offset"], record["starts"] = r.at[runs] - r.low[runs], r.high[runs] - r.low[runs] + 1
        record["repeats"] = np.bincount(self.kind_of, minlength=len(self.kind_at))[kinds] > 1
        for shard, part in self._by_shard(shard_of(record["sample"], self.shards)):
            pieces = [self.raw[a : b + LENGTH] for a, b in zip(r.low[runs[part]].tolist(), r.high[runs[part]].tolist(), strict=True)]
            yield shard, RUNS, (part.stop - part.start).to_bytes(4, "little") + zlib.compress(record[part].tobytes() + b"".join(pieces), 1)
        _, _, h1, h2, n = self._string_keys()
        record = np.empty(len(h1), dtype=_STRING_RECORD)
        record["h1"], record["h2"], record["repeats"] = h1, h2, n > 1
        for shard, part in self._by_shard(shard_of(h1, self.shards)):
            yield shard, STRINGS, record[part].tobytes()

    def covered(self, answers: dict[tuple[int, int], bytes]) -> np.ndarray:
        """True at every byte of a string that starts anywhere else too."""
        self.learn(answers)
        change = np.zeros(len(self.data) + 1, dtype=np.int32)
        r = self.runs
        whole = self.order[np.flatnonzero(self.state[self.class_of] == REPEATED)]
        np.add.at(change, r.low[whole], 1)
        np.add.at(change, r.high[whole] + LENGTH, -1)
        starts: list[np.ndarray] = []
        kinds, runs = self._mixed_kinds()
        if len(kinds):
            masks = []
            for shard, part in self._by_shard(shard_of(r.sample[runs], self.shards)):
                masks.append(np.frombuffer(zlib.decompress(answers[RUNS, shard]), dtype=np.uint8).reshape(-1, _MASK_BYTES))
                if len(masks[-1]) != part.stop - part.start:
                    raise ValueError("an answer doesn't fit its message")
            mask = np.zeros((len(self.kind_at), _MASK_BYTES), dtype=np.uint8)
            mask[kinds] = np.concatenate(masks)
            of_run = mask[self.kind_of]
            some = np.flatnonzero(of_run.any(axis=1))
            for i in range(0, len(some), 20_000):
                part = some[i : i + 20_000]
                row, bit = np.nonzero(np.unpackbits(of_run[part], axis=1, count=WINDOW))
                starts.append(r.low[self.order[part[row]]] + bit)
        if (self.state == LARGE).any():
            place, key, h1, _, _ = self._string_keys()
            flags = [np.frombuffer(zlib.decompress(answers[STRINGS, shard]), dtype=np.uint8) for shard, _ in self._by_shard(shard_of(h1, self.shards))]
            starts.append(place[np.concatenate(flags).astype(bool)[key]])
        for s in starts:
            np.add.at(change, s, 1)
            np.add.at(change, s + LENGTH, -1)
        return np.cumsum(change[:-1], dtype=np.int32) > 0


_SAMPLE_RECORD = np.dtype([("sample", "<u8"), ("around", "<u8"), ("kinds", "<u2"), ("repeats", "u1")])
_RUN_RECORD = np.dtype([("sample", "<u8"), ("around", "<u8"), ("offset", "u1"), ("starts", "u1"), ("repeats", "u1")])
_STRING_RECORD = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("repeats", "u1")])
_MASK_BYTES = -(-WINDOW // 8)


def _groups(new: np.ndarray) -> np.ndarray:
    return np.cumsum(new) - 1


def rank_samples(sent: list[bytes], large: int) -> list[bytes]:
    """The state of every class that the blocks' messages name."""
    records = np.concatenate([np.frombuffer(m, dtype=_SAMPLE_RECORD) for m in sent])
    order = np.argsort(records["sample"], kind="stable")
    s = records["sample"][order]
    group = _groups(np.concatenate(([True], s[1:] != s[:-1])))
    n = int(group[-1]) + 1
    around, first = records["around"][order], np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    entries = np.bincount(group, minlength=n)
    kinds = np.bincount(group, weights=records["kinds"][order], minlength=n)
    repeats = np.bincount(group, weights=records["repeats"][order], minlength=n) > 0
    differs = (np.bincount(group, weights=around != around[first][group], minlength=n) > 0) | (kinds > entries)
    state = np.where(differs, np.where(kinds > large, LARGE, MIXED), np.where((entries > 1) | repeats, REPEATED, UNIQUE)).astype(np.uint8)
    out = np.empty(len(records), dtype=np.uint8)
    out[order] = state[group]
    return _cut(out, sent, _SAMPLE_RECORD.itemsize)


def _cut(values: np.ndarray, sent: list[bytes], size: int) -> list[bytes]:
    ends = np.cumsum([len(m) // size for m in sent]).tolist()
    return [zlib.compress(values[a:b].tobytes(), 1) for a, b in zip([0, *ends], ends, strict=False)]


def rank_strings(sent: list[bytes]) -> list[bytes]:
    """Whether each string occurs in another message too, or repeats in its own."""
    records = np.concatenate([np.frombuffer(m, dtype=_STRING_RECORD) for m in sent])
    order = np.lexsort((records["h2"], records["h1"]))
    h1, h2 = records["h1"][order], records["h2"][order]
    group = _groups(np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))))
    dup = (np.bincount(group) > 1) | (np.bincount(group, weights=records["repeats"][order]) > 0)
    out = np.empty(len(records), dtype=np.uint8)
    out[order] = dup[group]
    return _cut(out, sent, _STRING_RECORD.itemsize)


def _words(rows: np.ndarray) -> list[np.ndarray]:
    """Bytes of each row as big-endian words, the last first, for lexsort."""
    padded = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), dtype=np.uint8)
    padded[:, : rows.shape[1]] = rows
    words = padded.view(">u8")
    return [words[:, i] for i in range(words.shape[1] - 1, -1, -1)]


def _suffix_order(bucket: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each row among those of its bucket in suffix order, and the common prefixes with the row before (-1: another bucket)."""
    order = np.lexsort((*_words(rows), bucket))
    s, b = rows[order], bucket[order]
    differ = s[1:] != s[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    common = np.concatenate(([-1], np.where(b[1:] == b[:-1], common, -1)))
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    return place, common


def sort_buckets(sent: list[bytes]) -> list[bytes]:
    """Of every run sent, which of its strings occur elsewhere: a bit for each start."""
    records, texts, bounds = [], [], [0]
    for m in sent:
        n, body = int.from_bytes(m[:4], "little"), zlib.decompress(m[4:])
        records.append(np.frombuffer(body[: n * _RUN_RECORD.itemsize], dtype=_RUN_RECORD))
        texts.append(body[n * _RUN_RECORD.itemsize :])
        bounds.append(bounds[-1] + n)
    runs, text = np.concatenate(records), np.frombuffer(b"".join(texts), dtype=np.uint8)
    size = runs["starts"].astype(np.int64) + LENGTH - 1
    begin = np.concatenate(([0], np.cumsum(size)[:-1]))
    # runs of equal bytes are one, and repeated as a whole
    order = np.lexsort((runs["around"], runs["sample"]))
    s, c = runs["sample"][order], runs["around"][order]
    new = np.concatenate(([True], (s[1:] != s[:-1]) | (c[1:] != c[:-1])))
    kind = np.empty(len(runs), dtype=np.int64)
    kind[order] = _groups(new)
    lead = order[new]
    whole = (np.bincount(kind) > 1) | (np.bincount(kind, weights=runs["repeats"]) > 0)
    bucket = _groups(np.concatenate(([True], s[new][1:] != s[new][:-1])))
    mask = np.zeros((len(lead), WINDOW), dtype=bool)
    # a batch of whole buckets at a time
    sizes = np.bincount(bucket)
    batch_of = (np.cumsum(sizes) // 8192)[bucket]
    for part in np.split(np.arange(len(lead)), np.flatnonzero(np.diff(batch_of)) + 1):
        r = lead[part]
        offset, starts = runs["offset"][r].astype(np.int64), runs["starts"][r].astype(np.int64)
        step = np.arange(REACH)
        before = begin[r][:, None] + offset[:, None] - 1 - step
        left = np.where(step < offset[:, None], text[np.maximum(before, 0)], 0).astype(np.uint8)
        after = begin[r][:, None] + offset[:, None] + SAMPLE + step
        right = np.where(after < (begin[r] + size[r])[:, None], text[np.minimum(after, len(text) - 1)], 0).astype(np.uint8)
        left_place, left_common = _suffix_order(bucket[part], left)
        right_place, right_common = _suffix_order(bucket[part], right)
        for depth in range(WINDOW):
            j = offset - depth  # the start that lies ``depth`` bytes before the sample
            rows = np.flatnonzero((j >= 0) & (j < starts))
            if len(rows) < 2:
                continue
            a = np.cumsum(left_common < depth)[left_place[rows]]
            b = np.cumsum(right_common < REACH - depth)[right_place[rows]]
            _, inverse, n = np.unique(a << 32 | b, return_inverse=True, return_counts=True)
            twice = n[inverse] > 1
            mask[part[rows[twice]], j[rows[twice]]] = True
    mask[whole] = np.arange(WINDOW) < runs["starts"][lead[whole]].astype(np.int64)[:, None]
    packed = np.packbits(mask, axis=1)[kind]
    return [zlib.compress(packed[a:b].tobytes(), 1) for a, b in zip(bounds, bounds[1:], strict=False)]


EXTRA = "n_bytes long, n_removed long, spans array<struct<start: long, stop: long>>, kept binary"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def found_rows(rows: pa.Table, sizes: np.ndarray, spans: list[list[dict]], raw: bytes) -> pa.Table:
    """The table of ``remove_repeats`` for a block's rows."""
    kept, removed, at = [], [], 0
    for n, gone in zip(sizes.tolist(), spans, strict=True):
        edges = [0, *(x for s in gone for x in (s["start"], s["stop"])), n]
        kept.append(b"".join(raw[at + a : at + b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
        removed.append(n - len(kept[-1]))
        at += n
    return pa.table({"doc": rows["doc"], "n_bytes": pa.array(sizes), "n_removed": pa.array(removed, pa.int64()), "spans": pa.array(spans, _SPANS), "kept": pa.array(kept, pa.binary())})


def remove_repeats(docs: DataFrame, large_bucket: int = LARGE_BUCKET, finish: Callable[..., pa.Table] = found_rows, schema: StructType | None = None) -> DataFrame:
    """All columns of ``docs`` in a struct ``doc``, with n_bytes, n_removed, the removed spans and the bytes kept.

    Every byte is removed that lies in a string of ``LENGTH`` bytes which starts anywhere else too,
    in the same text or another one. Null, empty and shorter texts lose nothing; repeated rows are
    copies of each other; an empty table gives no rows. ``finish`` makes other rows, of ``schema``.
    """
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col("text").alias("text"))
    blocks = as_blocks(held)
    shards = shard_count(blocks, SHARD_BYTES)
    asked = send(blocks, lambda _, rows: BlockRepeats(rows, shards, large_bucket).samples())
    ranked = stored(answer(asked, lambda _kind, _shard, sent: rank_samples(sent, large_bucket)))

    def second(block: int, rows: pa.Table, answers: dict) -> Iterable[pa.Table]:
        repeats = BlockRepeats(rows, shards, large_bucket)
        repeats.learn(answers)
        out = list(repeats.runs_and_strings())
        yield pa.table({"shard": pa.array([x[0] for x in out], pa.int64()), "block": pa.array([block] * len(out), pa.int64()), "kind": pa.array([x[1] for x in out], pa.int32()), "message": pa.array([x[2] for x in out], pa.binary())})

    fine = receive(blocks, ranked, second, "shard long, block long, kind int, message binary")
    settled = answer(fine, lambda kind, _shard, sent: sort_buckets(sent) if kind == RUNS else rank_strings(sent))

    def last(block: int, rows: pa.Table, answers: dict) -> Iterable[pa.Table]:
        repeats = BlockRepeats(rows, shards, large_bucket)
        gone = repeats.covered(answers)
        starts = (repeats.ends - repeats.sizes).tolist()
        spans = []
        for a, n in zip(starts, repeats.sizes.tolist(), strict=True):
            edge = np.flatnonzero(np.diff(gone[a : a + n].astype(np.int8), prepend=0, append=0))
            spans.append([{"start": int(x), "stop": int(y)} for x, y in edge.reshape(-1, 2)])
        yield finish(rows, repeats.sizes, spans, repeats.raw)

    return receive(blocks, ranked.union(settled), last, schema or StructType([held.schema["doc"], *_parse_datatype_string(EXTRA)]))


def without_spans(text: str, spans: list[dict]) -> str:
    """``text`` less spans of its bytes; what is left of a character that a span cuts goes too."""
    raw, at, out = text.encode(), 0, []
    for span in [*spans, {"start": len(raw), "stop": len(raw)}]:
        out.append(raw[at : span["start"]].decode(errors="ignore"))
        at = span["stop"]
    return "".join(out)


def keep_unrepeated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, without the repeated strings of their texts; n_chars follows.

    Null texts stay null and null n_chars of null texts too; a text that is repeated as a whole
    becomes empty; every other case is that of ``remove_repeats``.
    """
    names = docs.columns

    def finish(rows: pa.Table, sizes: np.ndarray, spans: list[list[dict]], raw: bytes) -> pa.Table:
        columns = dict(zip(names, rows["doc"].combine_chunks().flatten(), strict=True))
        texts = [t if not s else without_spans(t, s) for t, s in zip(columns["text"].to_pylist(), spans, strict=True)]
        columns["text"] = pa.array(texts, pa.string())
        if "n_chars" in names:
            columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(columns["n_chars"].type)
        return pa.table(columns)

    return remove_repeats(docs, finish=finish, schema=docs.schema)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of ``remove_repeats`` over all documents; a null doc_id stays null."""
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("doc.doc_id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
