"""Token counts by rank-synchronous array merging.

Pre-tokens that have not been met before are held as one ragged array of symbol ids. In each
round every sequence finds its lowest-ranked adjacent pair and merges all its occurrences at once,
left to right; sequences without a mergeable pair leave the array. What survives is the count.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from allelix.llm.common import BoundedCache, chunks, table
from allelix.session import ship_package

VOCABULARY = "byte_bpe_50k.json"
TOKEN_LIMIT = 1024
CACHE_KEYS = 1_000_000
#: Symbols held in one ragged array; a longer pre-token is an array of its own.
ARRAY_SYMBOLS = 4_000_000
_NONE = np.int64(2**62)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies (a public rule)."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names, extra = {b: chr(b) for b in printable}, 0
    for b in range(256):
        if b not in names:
            names[b] = chr(256 + extra)
            extra += 1
    return [names[b] for b in range(256)]


class RankMerger:
    """Counts byte-level BPE symbols of many pre-tokens at once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.base = np.array([vocab[c] for c in byte_symbols()], dtype=np.int64)
        self.shift = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.shift + vocab[b] for a, b in pairs], dtype=np.int64)
        merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.merged = keys[order], order.astype(np.int64), merged
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.cache = BoundedCache(CACHE_KEYS)

    def merge(self, pieces: list[bytes]) -> np.ndarray:
        """Number of symbols left of each non-empty piece."""
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        out = np.zeros(len(pieces), dtype=np.int64)
        begin = 0
        while begin < len(pieces):
            reach = np.cumsum(lengths[begin:])
            end = begin + max(1, int(np.searchsorted(reach, ARRAY_SYMBOLS, side="right")))
            out[begin:end] = self._merge(pieces[begin:end], lengths[begin:end])
            begin = end
        return out

    def _merge(self, pieces: list[bytes], lengths: np.ndarray) -> np.ndarray:
        symbols = self.base[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        counts, owner = lengths.copy(), np.arange(len(pieces))
        sizes = lengths
        while len(symbols):
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            keys = np.empty(len(symbols), dtype=np.int64)
            keys[:-1] = symbols[:-1] * self.shift + symbols[1:]
            keys[starts + sizes - 1] = -1
            at = np.searchsorted(self.keys, keys)
            at[at == len(self.keys)] = 0
            ranks = np.where(self.keys[at] == keys, self.ranks[at], _NONE)
            lowest = np.minimum.reduceat(ranks, starts)
            counts[owner] = sizes
            live = lowest < _NONE
            if not live.all():
                keep = np.repeat(live, sizes)
                symbols, ranks, owner, sizes, lowest = symbols[keep], ranks[keep], owner[live], sizes[live], lowest[live]
                if not len(symbols):
                    break
            hit = ranks == np.repeat(lowest, sizes)
            # in a run of overlapping hits (a pair of equal symbols) every second one merges, from the left
            if (hit[1:] & hit[:-1]).any():
                index = np.arange(len(hit))
                run_start = np.maximum.accumulate(np.where(hit & ~np.concatenate(([False], hit[:-1])), index, 0))
                # a hit that ends a sequence can't be followed by one of the next: its last position never hits
                hit &= (index - run_start) % 2 == 0
            place = np.flatnonzero(hit)
            symbols[place] = self.merged[ranks[place]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[place + 1] = False
            sizes = np.add.reduceat(keep.astype(np.int64), np.concatenate(([0], np.cumsum(sizes)[:-1])))
            symbols = symbols[keep]
        return counts

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text; strings of special tokens in it count one each."""
        found: list[list[str]] = []
        specials: list[int] = []
        for text in texts:
            if self.special is not None and self.special.search(text):
                segments = self.special.split(text)
                found.append([p for s in segments for p in self.pattern.findall(s)])
                specials.append(len(segments) - 1)
            else:
                found.append(self.pattern.findall(text))
                specials.append(0)
        new = self.cache.missing(set().union(*found))
        self.cache.update(zip(new, self.merge([p.encode() for p in new]).tolist(), strict=True))
        get = self.cache.__getitem__
        return [sum(map(get, pieces)) + n for pieces, n in zip(found, specials, strict=True)]


@lru_cache(maxsize=2)
def merger(path: str) -> RankMerger:
    return RankMerger(path)


SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def token_counts(docs: DataFrame, vocabulary: str | None = None, limit: int = TOKEN_LIMIT) -> DataFrame:
    """Bytes and tokens of every whole text, one row per row of ``docs``.

    Null and empty texts have 0 tokens; a null doc_id stays null; repeated rows are counted each;
    other columns of ``docs`` are not read. Narrow: no shuffle, bounded memory per chunk of text.
    """
    ship_package(docs.sparkSession)
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = merger(path)
        for batch, texts in chunks(batches):
            tokens = np.array(engine.count(texts), dtype=np.int64)
            sizes = np.fromiter((len(t.encode()) for t in texts), dtype=np.int64, count=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sizes), pa.array(tokens), pa.array(tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of all documents: see ``token_counts``."""
    return token_counts(table(spark, sf_dir, "documents"))
