"""N-gram language model in Elias-Fano levels.

Texts become blocks of word numbers. Shards first give every word a number (small for frequent words)
and its training count, then, for each order from 2 up, build a level of the trie from the n-grams
of all blocks: contexts, and under each its successors as one Elias-Fano sequence whose pointers
are monotone; a quantised probability belongs to each. A block asks for its distinct n-grams once.

Probabilities are interpolated absolute discounting: ``(count - D) / context`` of an order plus
``D * successors / context`` times the probability of the order below; the lowest order is the
unigram model with 0.1 added to each count, in which unknown words have a share.
"""

from __future__ import annotations

import mmap
import pickle
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelix.llm.blocks import answer, as_blocks, receive, send, shard_count, stored
from allelix.llm.common import table

ORDER = 3
DISCOUNT = 0.75
ADDED = 0.1
FOLDS, HELD_OUT = 10, 0
SHARD_BYTES = 16 << 20
#: Compression of blocks and messages.
LEVEL = 3
#: Quantised probabilities: code 0 is none, code c is 10 ** ((c - 255) * STEP).
STEP = 0.045
END = b"\n"  # no word holds white space
START_NUMBER = 1 << 62
VALUES = np.concatenate(([0.0], 10.0 ** ((np.arange(1, 256) - 255) * STEP)))


def quantised(p: np.ndarray) -> np.ndarray:
    """Nearest codes of probabilities in (0, 1]."""
    return np.clip(255 + np.rint(np.log10(p) / STEP), 1, 255).astype(np.uint8)


def is_training(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS != HELD_OUT


# ---------------------------------------------------------------- Elias-Fano


def _pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    out = []
    shifts = np.arange(width, dtype=np.uint64)
    for i in range(0, len(values), 1 << 15):
        part = values[i : i + (1 << 15), None] >> shifts & np.uint64(1)
        out.append(np.packbits(part.astype(np.uint8).reshape(-1), bitorder="little"))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint8)


class EliasFano:
    """A non-decreasing sequence: low bits packed, high bits in unary, with a count of ones by word."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.width, self.low, self.high, self.ones = n, width, low, high, ones

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        low = _pack_bits(values & np.uint64((1 << width) - 1), width) if width else np.zeros(0, dtype=np.uint8)
        bits = np.zeros(-(-((top >> width) + n + 1) // 64) * 64, dtype=np.uint8)
        bits[(values >> np.uint64(width)).astype(np.int64) + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little")
        ones = np.concatenate(([0], np.cumsum(np.bitwise_count(high.view("<u8")), dtype=np.int64))).astype("<i8")
        low = np.concatenate((low, np.zeros(-len(low) % 8, dtype=np.uint8)))
        return struct.pack("<4q", n, width, len(low), len(high)) + low.tobytes() + high.tobytes() + ones.tobytes()

    @staticmethod
    def read(buffer, at: int) -> tuple[EliasFano, int]:
        """The sequence at byte ``at`` of any buffer, a memory map for one, and the byte after it."""
        n, width, low_size, high_size = struct.unpack_from("<4q", buffer, at)
        at += 32
        low = np.frombuffer(buffer, dtype=np.uint8, count=low_size, offset=at)
        high = np.frombuffer(buffer, dtype=np.uint8, count=high_size, offset=at + low_size)
        at += low_size + high_size
        ones = np.frombuffer(buffer, dtype="<i8", count=high_size // 8 + 1, offset=at)
        return EliasFano(n, width, low, high, ones), at + len(ones) * 8

    def _low(self, first: int, last: int) -> np.ndarray:
        """Low bits of elements first..last-1; ``first`` is a multiple of 8."""
        if not self.width:
            return np.zeros(last - first, dtype=np.uint64)
        out = []
        weights = np.uint64(1) << np.arange(self.width, dtype=np.uint64)
        for i in range(first, last, 1 << 15):
            stop = min(last, i + (1 << 15))
            raw = self.low[i * self.width // 8 : -(-stop * self.width // 8)]
            bits = np.unpackbits(raw, bitorder="little", count=(stop - i) * self.width).reshape(-1, self.width)
            out.append((bits * weights).sum(axis=1, dtype=np.uint64))
        return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)

    def decode(self) -> np.ndarray:
        place = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))
        return (place - np.arange(self.n)).astype(np.uint64) << np.uint64(self.width) | self._low(0, self.n)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Single elements, by a search among the words' counts and inside one word."""
        i = np.asarray(i, dtype=np.int64)
        word = np.searchsorted(self.ones, i, side="right") - 1
        bits = np.unpackbits(self.high.reshape(-1, 8)[word], axis=1, bitorder="little")
        inside = (np.cumsum(bits, axis=1) == (i - self.ones[word] + 1)[:, None]).argmax(axis=1)
        out = (word * 64 + inside - i).astype(np.uint64) << np.uint64(self.width)
        for b in range(self.width):
            bit = i * self.width + b
            out |= ((self.low[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(np.uint64) << np.uint64(b)
        return out


class Level:
    """One level of the trie: contexts, their successors relative to the context, quantised values.

    Contexts are rows of word numbers; ``words`` numbers the level's successors densely, so that the
    successors of context p are the values from ``p * len(words)`` on of one monotone sequence.
    """

    def __init__(self, buffer):
        n_columns, n_contexts, n_grams = struct.unpack_from("<3q", buffer, 0)
        at = 24
        self.columns = np.frombuffer(buffer, dtype="<u8", count=n_columns * n_contexts, offset=at).reshape(n_columns, n_contexts)
        at += n_columns * n_contexts * 8
        self.words, at = EliasFano.read(buffer, at)
        self.pointers, at = EliasFano.read(buffer, at)
        self.successors, at = EliasFano.read(buffer, at)
        self.shares = np.frombuffer(buffer, dtype=np.uint8, count=n_contexts, offset=at)
        self.codes = np.frombuffer(buffer, dtype=np.uint8, count=n_grams, offset=at + n_contexts)

    @staticmethod
    def build(columns: np.ndarray, size: np.ndarray, words: np.ndarray, shares: np.ndarray, codes: np.ndarray) -> bytes:
        """From contexts (columns of numbers, sorted by row), their numbers of successors, and the successors in a row."""
        distinct, local = np.unique(words, return_inverse=True)
        parent = np.repeat(np.arange(len(size)), size)
        keys = parent.astype(np.uint64) * np.uint64(max(1, len(distinct))) + local.astype(np.uint64)
        pointers = np.concatenate(([0], np.cumsum(size)))
        head = struct.pack("<3q", columns.shape[0], columns.shape[1], len(words)) + np.ascontiguousarray(columns, dtype="<u8").tobytes()
        return head + EliasFano.encode(distinct) + EliasFano.encode(pointers) + EliasFano.encode(keys) + shares.tobytes() + codes.tobytes()

    def contexts(self, columns: np.ndarray) -> np.ndarray:
        """Index of each context (columns of numbers), or -1."""
        both = np.concatenate((self.columns, columns), axis=1)
        order = np.lexsort(both[::-1])
        same = (both[:, order[1:]] == both[:, order[:-1]]).all(axis=0)
        group = np.cumsum(np.concatenate(([True], ~same))) - 1
        n = self.columns.shape[1]
        found = np.full(group[-1] + 1 if len(group) else 0, -1)
        own = order < n
        found[group[own]] = order[own]
        out = np.empty(both.shape[1], dtype=np.int64)
        out[order] = found[group]
        return out[n:]

    def search(self, context: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Codes of successors, 0 where there is none. Many are asked for, so that the sequence is decoded once."""
        distinct = self.words.decode()
        local = np.minimum(np.searchsorted(distinct, words), max(0, len(distinct) - 1))
        ok = (context >= 0) & (len(distinct) > 0)
        if len(distinct):
            ok &= distinct[local] == words
        keys = np.where(ok, context, 0).astype(np.uint64) * np.uint64(max(1, len(distinct))) + local.astype(np.uint64)
        held = self.successors.decode()
        at = np.minimum(np.searchsorted(held, keys), max(0, len(held) - 1))
        out = np.zeros(len(words), dtype=np.uint8)
        if len(held):
            hit = ok & (held[at] == keys)
            out[hit] = self.codes[at[hit]]
        return out

    def successor(self, context: int, word: int) -> int:
        """The code of one successor: a search between two pointers, by single elements."""
        a, b = self.pointers.get(np.array([context, context + 1])).astype(np.int64).tolist()
        n = self.words.n
        lo, hi = 0, n
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if int(self.words.get(np.array([mid]))[0]) < word else (lo, mid)
        if lo == n or int(self.words.get(np.array([lo]))[0]) != word:
            return 0
        key = context * n + lo
        while a < b:
            mid = (a + b) // 2
            held = int(self.successors.get(np.array([mid]))[0])
            if held == key:
                return int(self.codes[mid])
            a, b = (mid + 1, b) if held < key else (a, mid)
        return 0


def mapped(blob: bytes) -> mmap.mmap:
    out = mmap.mmap(-1, max(1, len(blob)))
    out.write(blob)
    return out


# ---------------------------------------------------------------- messages


def _shuffled(a: np.ndarray) -> bytes:
    """Bytes of equal weight together: high bytes of small numbers compress to nothing."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if len(a) else b""


def packed(*arrays: np.ndarray) -> bytes:
    head = pickle.dumps([(len(a), a.dtype.str) for a in arrays])
    return zstandard.ZstdCompressor(level=LEVEL).compress(struct.pack("<I", len(head)) + head + b"".join(map(_shuffled, arrays)))


def unpacked(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = struct.unpack_from("<I", raw)[0]
    at, out = 4 + n, []
    for size, kind in pickle.loads(raw[4:at]):
        kind = np.dtype(kind)
        part = np.frombuffer(raw, dtype=np.uint8, count=size * kind.itemsize, offset=at)
        out.append(np.ascontiguousarray(part.reshape(kind.itemsize, size).T).reshape(-1).view(kind))
        at += size * kind.itemsize
    return out


def gaps(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Differences inside each run of ascending values; the first of a run (a mask) stays as it is."""
    out = np.diff(values, prepend=values[:1])
    out[first] = values[first]
    return out


def without_gaps(held: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The values of ``gaps``; sums may wrap around, their differences don't."""
    total, at = np.cumsum(held, dtype=np.uint64), np.flatnonzero(first)
    return total - (total[at] - held[at])[np.cumsum(first) - 1] if len(held) else total


def _run_starts(above: np.ndarray | None, first: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin, given those of the columns before and the last of them."""
    return first if above is None else first | np.concatenate(([True], above[1:] != above[:-1]))


def packed_grams(size: np.ndarray, count: np.ndarray, split: np.ndarray, words: np.ndarray, n: np.ndarray, columns: np.ndarray) -> bytes:
    """N-grams that ascend by context and word: both are sent as gaps."""
    of, first, above, held = np.zeros(len(words), dtype=bool), np.arange(columns.shape[1]) == 0, None, []
    of[np.cumsum(size) - size] = True
    for c in columns:
        first = _run_starts(above, first)
        held.append(gaps(c, first))
        above = c
    return packed(size.astype(np.uint32), count, split, gaps(words, of), n, *held)


def unpacked_grams(blob: bytes) -> list[np.ndarray]:
    """[successors of each context, its count, its parts, words, their counts, *columns of the contexts]"""
    size, count, split, words, n, *held = unpacked(blob)
    of, first, above, columns = np.zeros(len(words), dtype=bool), np.arange(len(size)) == 0, None, []
    of[np.cumsum(size) - size] = True
    for c in held:
        first = _run_starts(above, first)
        columns.append(above := without_gaps(c, first))
    return [size, count, split, without_gaps(words, of), n, *columns]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """A block's texts as places in its own list of words; the end of a text is a word."""

    doc_id: list
    sizes: np.ndarray
    tokens: np.ndarray
    words: list[bytes]

    @staticmethod
    def pack(batches: list[pa.RecordBatch]) -> bytes:
        number: dict[bytes, int] = {END: 0}
        doc_id, sizes, tokens = [], [], []
        for batch in batches:
            doc_id += batch.column(0).to_pylist()
            for text in batch.column(1):
                words = (text.as_py() or "").encode().lower().split()
                tokens.append(np.array([number.setdefault(w, len(number)) for w in words] + [0], dtype=np.uint32))
                sizes.append(len(words) + 1)
        ids = np.array([0 if d is None else d for d in doc_id], dtype=np.int64)
        # frequent words get small places, whose high bytes are zero
        stream = np.concatenate(tokens)
        order = np.argsort(-np.bincount(stream, minlength=len(number)), kind="stable")
        place = np.empty(len(order), dtype=np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        words = list(number)
        names = np.frombuffer(b" ".join([words[i] for i in order.tolist()]), dtype=np.uint8)
        return packed(ids, np.array([d is None for d in doc_id], dtype=np.uint8), np.array(sizes, dtype=np.uint32), place[stream], names)

    @staticmethod
    def unpack(payload) -> Words:
        ids, null, sizes, tokens, names = unpacked(bytes(payload))
        return Words([None if n else d for d, n in zip(ids.tolist(), null.tolist(), strict=True)], sizes.astype(np.int64), tokens.astype(np.int64), names.tobytes().split(b" "))

    def __post_init__(self):
        self.train = np.array([is_training(d) for d in self.doc_id], dtype=bool)
        self.token_train = np.repeat(self.train, self.sizes)
        self.first = np.zeros(len(self.tokens), dtype=bool)
        if len(self.sizes):
            self.first[np.concatenate(([0], np.cumsum(self.sizes)[:-1]))] = True

    def by_shard(self, shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        order = np.argsort(shard, kind="stable")
        cuts = np.flatnonzero(np.diff(shard[order])) + 1
        for part in np.split(order, cuts) if len(order) else []:
            yield int(shard[part[0]]), part

    # words

    def word_shards(self, shards: int) -> np.ndarray:
        return np.array([xxhash.xxh64_intdigest(w) % shards for w in self.words], dtype=np.int64)

    def ask_words(self, shards: int) -> Iterator[tuple[int, int, bytes]]:
        counts = np.bincount(self.tokens[self.token_train], minlength=len(self.words)).astype(np.uint64)
        for shard, part in self.by_shard(self.word_shards(shards)):
            yield shard, 0, packed(counts[part], np.frombuffer(b" ".join([self.words[i] for i in part.tolist()]), dtype=np.uint8))

    def learn_words(self, answers: dict, shards: int) -> None:
        number, count = np.empty(len(self.words), dtype=np.uint64), np.empty(len(self.words), dtype=np.uint64)
        for shard, part in self.by_shard(self.word_shards(shards)):
            number[part], count[part] = unpacked(answers[0, shard][16:])
        # from here on places ascend with numbers, and so do the n-grams of a message: their gaps are small
        order = np.argsort(number)
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        self.number, self.count, self.tokens = number[order], count[order], place[self.tokens]
        self.words = [self.words[i] for i in order.tolist()]

    # n-grams

    def grams(self, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each order from 2 on: (order, columns of the contexts, context of each n-gram, its word, n-gram of each token).

        N-grams are sorted by context; contexts before the start hold ``START_NUMBER``.
        """
        n_words = len(self.words)
        below = self.tokens  # (k-1)-gram of each token; one more number stands for what comes before a text
        columns = np.concatenate((self.number, [np.uint64(START_NUMBER)]))[None, :]
        n_below = n_words
        for k in range(2, order + 1):
            context = np.concatenate(([n_below], below[:-1])) if len(below) else below
            context[self.first] = n_below
            key, inverse = np.unique(context * n_words + self.tokens, return_inverse=True)
            of, word = key // n_words, key % n_words
            used, of = np.unique(of, return_inverse=True)
            yield k, columns[:, used], of, word, inverse
            columns = np.concatenate((np.concatenate((columns[:, used][:, of], self.number[word][None, :])), np.full((k, 1), START_NUMBER, dtype=np.uint64)), axis=1)
            below, n_below = inverse, len(key)

    def context_counts(self, columns: np.ndarray, starts: int) -> np.ndarray:
        """Training counts of one-word contexts."""
        at = np.minimum(np.searchsorted(self.number, columns[0]), max(0, len(self.number) - 1))
        return np.where(columns[0] == START_NUMBER, starts, self.count[at]).astype(np.uint64)

    def gram_shards(self, k: int, columns: np.ndarray, of: np.ndarray, word: np.ndarray, totals: Totals) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(shard of each n-gram, training count and number of parts of each context); a one-word context of many tokens is split by its successors."""
        h = np.full(columns.shape[1], k, dtype=np.uint64)
        for c in columns:
            h = mixed(h * np.uint64(31) + c)
        if k == 2:
            count = self.context_counts(columns, totals.starts)
            parts = count // np.uint64(totals.split) + np.uint64(1)
        else:
            count, parts = np.zeros(columns.shape[1], dtype=np.uint64), np.ones(columns.shape[1], dtype=np.uint64)
        part = mixed(self.number[word]) % parts[of]
        return (mixed(h[of] + part) % np.uint64(totals.shards)).astype(np.int64), count, parts

    def ask_grams(self, order: int, totals: Totals) -> Iterator[tuple[int, int, bytes]]:
        for k, columns, of, word, inverse in self.grams(order):
            counts = np.bincount(inverse[self.token_train], minlength=len(word)).astype(np.uint32)
            shard, count, parts = self.gram_shards(k, columns, of, word, totals)
            for s, part in self.by_shard(shard):
                used, size = np.unique(of[part], return_counts=True)
                yield s, k, packed_grams(size, count[used], parts[used], self.number[word[part]], counts[part], columns[:, used])

    def scores(self, answers: dict, order: int, totals: Totals) -> pa.Table:
        starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1])) if len(self.sizes) else np.zeros(0, np.int64)
        unigram = (self.count.astype(np.float64) + ADDED) / (totals.tokens + ADDED * (totals.words + 1))
        p = unigram[self.tokens]
        add = lambda x: np.add.reduceat(x, starts) if len(starts) else x
        base = add(np.log10(p))
        for k, columns, of, word, inverse in self.grams(order):
            shard, count, parts = self.gram_shards(k, columns, of, word, totals)
            own, share = np.zeros(len(word)), np.ones(columns.shape[1])
            for s, part in self.by_shard(shard):
                shares, codes = unpacked(answers[k, s])[:2]
                own[part] = VALUES[codes]
                used = np.unique(of[part])
                share[used] = np.where(shares == 0, 1.0, VALUES[shares])
            if k == 2:
                wide = np.flatnonzero(parts > 1)
                share[wide] = [min(1.0, DISCOUNT * totals.wide.get(int(c), 0) / n) for c, n in zip(columns[0][wide].tolist(), count[wide].tolist(), strict=True)]
            p = own[inverse] + share[of[inverse]] * p
        known = add((self.count > 0)[self.tokens].astype(np.int64))
        held_out = [d is not None and not t for d, t in zip(self.doc_id, self.train.tolist(), strict=True)]
        return pa.table({
            "doc_id": pa.array(self.doc_id, pa.int64()), "held_out": pa.array(held_out, pa.bool_()), "n_tokens": pa.array(self.sizes, pa.int64()),
            "n_known": pa.array(known, pa.int64()), "train_tokens": pa.array(np.full(len(self.sizes), totals.tokens), pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(add(np.log10(p)), pa.float64()),
        })


@dataclass
class Totals:
    """Figures of the whole training part. ``wide``: distinct successors of the contexts that are split, at most one for each shard."""

    shards: int
    tokens: int
    words: int
    starts: int
    split: int  # tokens of a context from which on its successors are split
    wide: dict[int, int]


def number_words(shard: int, shards: int, sent: list[bytes]) -> list[bytes]:
    """Numbers and total counts of the words that the messages name; frequent words get small numbers.

    Each answer starts with the shard's known words and training tokens, 8 bytes each.
    """
    index: dict[bytes, int] = {}
    asked, added = [], []
    for m in sent:
        counts, names = unpacked(m)
        places = [index.setdefault(w, len(index)) for w in names.tobytes().split(b" ")]
        asked.append(np.array(places))
        added.append(counts)
    total = np.zeros(len(index), dtype=np.uint64)
    for places, counts in zip(asked, added, strict=True):
        np.add.at(total, places, counts)
    order = sorted(index, key=lambda w: (-int(total[index[w]]), w))
    number = np.empty(len(index), dtype=np.uint64)
    number[[index[w] for w in order]] = np.arange(len(order), dtype=np.uint64) * np.uint64(shards) + np.uint64(shard)
    head = struct.pack(">2q", int((total > 0).sum()), int(total.sum()))
    return [head + packed(number[p], total[p]) for p in asked]


def build_level(sent: list[bytes]) -> tuple[bytes, tuple[np.ndarray, np.ndarray]]:
    """A level from the n-grams of all messages; contexts that are split, and their distinct successors here."""
    parts = [unpacked_grams(m) for m in sent]
    size, count, split, words, n = (np.concatenate([p[i] for p in parts]) for i in range(5))
    columns = np.concatenate([np.array(p[5:]) for p in parts], axis=1)
    of = np.repeat(np.arange(len(size)), size)
    keep = n > 0
    of, words, n = of[keep], words[keep], n[keep]
    order = np.lexsort((words, *columns[:, of][::-1]))
    of, words, n = of[order], words[order], n[order]
    rows = columns[:, of]
    new_context = np.concatenate(([True], (rows[:, 1:] != rows[:, :-1]).any(axis=0))) if len(of) else np.zeros(0, bool)
    new = new_context.copy()
    new[1:] |= words[1:] != words[:-1]
    at = np.flatnonzero(new)
    total = np.add.reduceat(n.astype(np.float64), at) if len(at) else np.zeros(0)
    context_of = (np.cumsum(new_context) - 1)[at]
    head = np.flatnonzero(new_context)
    successors = np.bincount(context_of, minlength=len(head))
    whole = np.bincount(context_of, weights=total, minlength=len(head))
    stated, wide = count[of[head]].astype(np.float64), split[of[head]] > 1
    whole = np.where(stated > 0, stated, whole)
    codes = quantised((total - DISCOUNT) / whole[context_of]) if len(at) else np.zeros(0, np.uint8)
    shares = np.where(wide, 0, quantised(np.minimum(1.0, DISCOUNT * successors / whole))) if len(head) else np.zeros(0)
    blob = Level.build(rows[:, head], successors, words[at], shares.astype(np.uint8), codes)
    return blob, (rows[0, head[wide]], successors[wide])


def answer_grams(sent: list[bytes]) -> list[bytes]:
    """Shares of the contexts and codes of the n-grams of each message; the first answer names the split contexts too."""
    blob, wide = build_level(sent)
    level = Level(mapped(blob))
    # all messages are looked up at once, so that the level is decoded and its contexts are sorted once
    parts = [unpacked_grams(m) for m in sent]
    size, words = (np.concatenate([p[i] for p in parts]) for i in (0, 3))
    found = level.contexts(np.concatenate([np.array(p[5:]) for p in parts], axis=1))
    shares = np.where(found >= 0, level.shares[np.maximum(found, 0)] if len(level.shares) else 0, 0).astype(np.uint8)
    codes = level.search(np.repeat(found, size), words)
    out, c, g = [], 0, 0
    for i, p in enumerate(parts):
        out.append(packed(shares[c : c + len(p[0])], codes[g : g + len(p[3])], *(wide if not i else (x[:0] for x in wide))))
        c, g = c + len(p[0]), g + len(p[3])
    return out


def wide_contexts(answers: DataFrame) -> dict[int, int]:
    """Distinct successors of the split contexts over all shards: at most a row for each shard."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m in batch.column(0):
                _, _, contexts, n = unpacked(m.as_py())
                if len(contexts):
                    yield pa.RecordBatch.from_arrays([pa.array(contexts.astype(np.int64)), pa.array(n.astype(np.int64))], names=["context", "n"])

    rows = answers.where("kind = 2").select("message").mapInArrow(run, "context long, n long").groupBy("context").agg(F.sum("n").alias("n")).collect()
    return {r["context"]: r["n"] for r in rows}


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame, order: int = ORDER, least_split: int = 10_000) -> DataFrame:
    """Unigram and model scores of every whole text, learned from the texts outside the held-out fold.

    A null or empty text is its end alone. A null doc_id is neither learned from nor held out;
    repeated rows are learned and scored each; other columns are not read; without training texts
    every token has the share of an unknown one; an empty table gives no rows.
    """
    blocks = as_blocks(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), pack=Words.pack)
    shards = shard_count(blocks, SHARD_BYTES)
    numbered = stored(answer(send(blocks, lambda _, w: w.ask_words(shards), Words.unpack), lambda _kind, shard, sent: number_words(shard, shards, sent)))
    figure = lambda at: F.conv(F.hex(F.substring("message", at, 8)), 16, 10).cast("long")
    by_shard = numbered.groupBy("shard").agg(F.max(figure(1)).alias("words"), F.max(figure(9)).alias("tokens"))
    row = by_shard.agg(F.sum("words").alias("words"), F.sum("tokens").alias("tokens")).first()
    starts = docs.where(F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % FOLDS != HELD_OUT)).count()
    tokens = row["tokens"] or 0
    totals = Totals(shards, tokens, row["words"] or 0, starts, max(least_split, tokens // shards), {})

    def second(block: int, words: Words, answers: dict) -> Iterable[pa.Table]:
        words.learn_words(answers, shards)
        out = list(words.ask_grams(order, totals))
        yield pa.table({"shard": pa.array([x[0] for x in out], pa.int64()), "block": pa.array([block] * len(out), pa.int64()), "kind": pa.array([x[1] for x in out], pa.int32()), "message": pa.array([x[2] for x in out], pa.binary())})

    asked = receive(blocks, numbered, second, "shard long, block long, kind int, message binary", Words.unpack)
    levels = stored(answer(asked, lambda _kind, _shard, sent: answer_grams(sent)))
    full = replace(totals, wide=wide_contexts(levels))

    def last(_: int, words: Words, answers: dict) -> Iterable[pa.Table]:
        words.learn_words(answers, shards)
        yield words.scores(answers, order, full)

    return receive(blocks, numbered.union(levels), last, SCHEMA, Words.unpack)


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a trigram model: see ``score_documents``."""
    return score_documents(table(spark, sf_dir, "documents"))
