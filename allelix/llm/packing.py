"""Packing of token sequences by Karmarkar-Karp multiway differencing.

A document's ids are cut into full windows and a rest. Rests are gathered in blocks; a block's rests
are shared among as few windows as can hold them by merging partial partitions whose imbalances
oppose each other, the largest imbalance first. If a window then exceeds the capacity, the block is
shared among one window more.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from bisect import insort
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from allelix.llm.blocks import release
from allelix.llm.common import BoundedCache, chunks, table
from allelix.session import ship_package

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 4096
END_ID = 2
#: Rests shared out together: bounds memory, and the padding to about a window for each block.
BLOCK_RESTS = 2048
#: Words held by a worker; fewer cost time, never results.
WORD_KEYS = 1_400_000
#: A run of letters whose lower case is one character each, with marks after it: the tokenizer cuts
#: between the two, and only there.
_SIMPLE = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,!?;:|#$%&*]*)")


class WordTokenizer:
    """Ids by the tokenizers library, each new word once.

    The tokenizer drops white space, lets nothing reach across it, lowers the case and cuts letters
    from marks, so that a text's ids are those of its words and marks in a row.
    """

    def __init__(self, path: str, words: int = WORD_KEYS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.chunks, self.words = BoundedCache(words * 3 // 7), BoundedCache(words)

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_words(self, words: list[str]) -> None:
        """Words of letters alone are encoded many in a row; each ends with its only token that ends a word."""
        for begin in range(0, len(words), 200):
            part = words[begin : begin + 200]
            raw = self._ids([" ".join(part)])[0]
            ends = (np.flatnonzero(self.ends_word[np.frombuffer(raw, dtype="<u4")]) * 4 + 4).tolist()
            if len(ends) != len(part):
                raise ValueError("the vocabulary does not end each word of letters once")
            self.words.update((w, raw[a:b]) for w, a, b in zip(part, [0, *ends], ends, strict=False))

    def packed(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [t.replace("\n", " ").split(" ") for t in texts]
        new = self.chunks.missing(set().union(*cut))
        simple, other = {}, []
        for c in new:
            if m := _SIMPLE.fullmatch(c):
                simple[c] = (m[1].lower(), m[2])
            else:
                other.append(c)
        self._learn_words(self.words.missing({w for w, _ in simple.values()}))
        marks = list({m for _, m in simple.values()} | set(other))
        known = dict(zip(marks, self._ids(marks), strict=True))
        self.chunks.update((c, self.words[w] + known[m]) for c, (w, m) in simple.items())
        self.chunks.update((c, known[c]) for c in other)
        get = self.chunks.__getitem__
        return [b"".join(map(get, c)) for c in cut]


@lru_cache(maxsize=2)
def word_tokenizer(path: str, words: int) -> WordTokenizer:
    return WordTokenizer(path, words)


def differencing(sizes: list[int], k: int) -> list[tuple[int, list[int]]]:
    """``k`` subsets of ``sizes`` with near-equal sums: (sum, indices) of those that hold anything.

    A partial partition keeps its non-empty subsets from the largest on; the other ones count as
    zero. Merging two puts the largest of one with the smallest of the other. Subsets are nodes of
    trees whose leaves are the indices.
    """
    n = len(sizes)
    if not n:
        return []
    # a subset is one number, its sum before its node, so that a partition is one ascending list
    bits = (2 * n).bit_length()
    low = (1 << bits) - 1
    children: list[tuple[int, int]] = []
    parts = {i: [s << bits | i] for i, s in enumerate(sizes)}
    heap = [(-s if k > 1 else 0, i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    fresh = n
    while len(heap) > 1:
        a, b = parts.pop(heapq.heappop(heap)[1]), parts.pop(heapq.heappop(heap)[1])
        if len(a) < len(b):
            a, b = b, a
        shared = len(a) + len(b) - k
        made = []
        if shared > 0:
            for one, two in zip(a[:shared], b[shared - 1 :: -1], strict=True):
                made.append((one >> bits) + (two >> bits) << bits | n + len(children))
                children.append((one & low, two & low))
            del a[:shared], b[:shared]
        if len(b) + len(made) == 1:  # most often: one more rest
            insort(a, (b or made)[0])
        else:
            a += b + made
            a.sort()
        parts[fresh] = a
        heapq.heappush(heap, ((a[0] >> bits if len(a) == k else 0) - (a[-1] >> bits), fresh))
        fresh += 1
    out = []
    for subset in reversed(parts[heap[0][1]]):
        leaves, stack = [], [subset & low]
        while stack:
            x = stack.pop()
            if x < n:
                leaves.append(x)
            else:
                stack.extend(children[x - n])
        out.append((subset >> bits, sorted(leaves)))
    return out


def share_out(sizes: list[int], capacity: int) -> list[tuple[int, list[int]]]:
    """As few near-equal windows as differencing fills without exceeding ``capacity``."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        windows = differencing(sizes, k)
        if all(total <= capacity for total, _ in windows):
            return windows
        k += max(1, k // 256)


def powers(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class Packer:
    """Pieces of the documents of one task, in sequences numbered from ``first``."""

    def __init__(self, first: int, capacity: int):
        self.next, self.capacity = first, capacity
        self.rests: list[tuple[int | None, int, bytes, int]] = []
        self.out: list[tuple] = []

    def _piece(self, doc, start: int, ids: bytes, total: int, offset: int) -> None:
        self.out.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, self.next, offset))

    def add(self, doc: int | None, ids: bytes) -> None:
        total, step, at = len(ids) // 4, self.capacity * 4, 0
        while len(ids) - at >= step:
            self._piece(doc, at // 4, ids[at : at + step], total, 0)
            self.next += 1
            at += step
        if at < len(ids):
            self.rests.append((doc, at // 4, ids[at:], total))
        if len(self.rests) >= BLOCK_RESTS:
            self._windows(self.rests)
            self.rests = []

    def _windows(self, rests: list) -> None:
        for _, members in share_out([len(r[2]) // 4 for r in rests], self.capacity):
            offset = 0
            for i in members:
                self._piece(*rests[i], offset)
                offset += len(rests[i][2]) // 4
            self.next += 1

    def finish(self) -> None:
        """The last block: what would leave its last window part empty goes to sequences that are powers of two long."""
        rests, self.rests = self.rests, []
        over = sum(len(r[2]) // 4 for r in rests) % self.capacity
        tail = []
        rests.sort(key=lambda r: len(r[2]))
        while over:
            doc, start, ids, total = rests.pop()
            n = len(ids) // 4
            if n > over:
                rests.append((doc, start, ids[: (n - over) * 4], total))
                ids, start, n = ids[(n - over) * 4 :], start + n - over, over
            tail.append((doc, start, ids, total))
            over -= n
        if rests:
            self._windows(rests)
        room = powers(sum(len(r[2]) // 4 for r in tail))
        offset = 0
        for doc, start, ids, total in tail:
            while ids:
                n = min(len(ids) // 4, room[0] - offset)
                self._piece(doc, start, ids[: n * 4], total, offset)
                ids, start, offset = ids[n * 4 :], start + n, offset + n
                if offset == room[0]:
                    room.pop(0)
                    self.next, offset = self.next + 1, 0


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_FIELDS = [f.split() for f in SCHEMA.split(", ")]


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, words: int = WORD_KEYS) -> DataFrame:
    """Pieces of all documents with their place in sequences of at most ``capacity`` tokens.

    A null or empty text is the end id alone; null doc_ids stay null; repeated rows are packed each;
    other columns are not read; an empty table gives no rows. Each input partition is packed by
    itself, so that there is no shuffle; sequence ids are unique through the partition's number.
    """
    ship_package(docs.sparkSession)
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId() << 33, capacity)

        def flush() -> pa.RecordBatch:
            rows, packer.out = packer.out, []
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _FIELDS]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[f[0] for f in _FIELDS])

        engine = word_tokenizer(path, words)
        for batch, texts in chunks(batches):
            for doc, ids in zip(batch.column(0).to_pylist(), engine.packed(texts), strict=True):
                packer.add(doc, ids + end)
            yield flush()
        packer.finish()
        yield flush()
        release()

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents: see ``pack``."""
    return pack(table(spark, sf_dir, "documents"))
