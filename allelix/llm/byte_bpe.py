"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a pre-token there is exactly one token that can end its encoding: the longest
suffix token that is compatible with the last token of the prefix before it. Storing that token per
prefix makes the encoding readable backwards from any prefix, lets bytes be appended exactly, and
lets an edit be re-encoded from the edited place onwards.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from allelix.llm.common import BoundedCache, chunks, table
from allelix.session import ship_package

RANKS = "byte_bpe_50k.tiktoken"
CACHE_KEYS = 500_000
PAIR_KEYS = 1_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def decode(tokens: dict[int, bytes], ids: Iterable[int]) -> bytes:
    """The bytes of the tokens in a row; they need not be whole characters."""
    return b"".join(map(tokens.__getitem__, ids))


class PrefixEncoder:
    """Encodes by a table of each prefix's last token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.lengths = {i: len(t) for t, i in ranks.items()}
        self.pattern = regex.compile(pattern)
        # the two tokens whose merge makes a token, found with the tokens of lower rank alone;
        # a token that merges can't reach is used for whole pre-tokens only
        self.parts: dict[int, tuple[int, int]] = {}
        self.reachable: set[int] = set()
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.parts[rank] = (rank, rank)
                self.reachable.add(rank)
                continue
            split = self._merged(token, rank)
            if len(split) == 2:
                self.parts[rank] = (split[0], split[1])
                self.reachable.add(rank)
        self.made = {pair: rank for rank, pair in self.parts.items() if len(self.tokens[rank]) > 1}
        self.usable = {t: i for t, i in ranks.items() if i in self.reachable}
        self.suffixes = ahocorasick.Automaton()
        for token, rank in ranks.items():
            if rank in self.reachable:
                self.suffixes.add_word(token.decode("latin-1"), (rank, len(token)))
        self.suffixes.make_automaton()
        self.fits: dict[int, bool] = {}
        self.cache = BoundedCache(CACHE_KEYS)

    def _merged(self, word: bytes, below: int) -> list[int]:
        """Plain lowest-rank-first merging of a short byte string with ranks under ``below``."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], below))
            if self.ranks.get(parts[best] + parts[best + 1], below) >= below:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        """True if the two tokens stay side by side when their bytes are encoded together.

        They do not if, undoing merges from the latest back, some pair that faces each other across
        the border would have merged before the merge that was undone.
        """
        a, b, before = left, right, 1 << 62
        answer = True
        while True:
            joint = self.made.get((a, b))
            if joint is not None and joint < before:
                answer = False
                break
            whole_a, whole_b = self.parts[a][0] == a, self.parts[b][0] == b
            if whole_a and whole_b:
                break
            # the merge of higher rank happened last; at equal rank the left one came first
            if not whole_a and (whole_b or a > b):
                before, a = a, self.parts[a][1]
            else:
                before, b = b + 1, self.parts[b][0]
        if len(self.fits) >= PAIR_KEYS:
            self.fits.clear()
        self.fits[left << 32 | right] = answer
        return answer

    def extend(self, text: bytes, last: list[int], begin: int = 0) -> list[int]:
        """Last tokens of the prefixes of ``text``, keeping those of its first ``begin`` bytes."""
        del last[begin:]
        last += [-1] * (len(text) - begin)
        fits = self.fits
        skipped = max(0, begin - self.longest)
        # at each end the automaton names the tokens that end there, from the longest to the single byte
        for end, (token, n) in self.suffixes.iter(text[skipped:].decode("latin-1")):
            end += skipped
            if end < begin or last[end] >= 0:
                continue
            if end + 1 == n:
                last[end] = token
                continue
            before = last[end - n]
            known = fits.get(before << 32 | token)
            if known or known is None and self.compatible(before, token):
                last[end] = token
        return last

    def read(self, last: list[int]) -> list[int]:
        ids, at = [], len(last)
        while at:
            ids.append(last[at - 1])
            at -= self.lengths[last[at - 1]]
        ids.reverse()
        return ids

    def append(self, text: bytes, last: list[int], more: bytes) -> tuple[bytes, list[int]]:
        """The prefix table of ``text + more`` from that of ``text``; only the new bytes are worked on."""
        return text + more, self.extend(text + more, last, len(text))

    def edit(self, text: bytes, last: list[int], start: int, stop: int, new: bytes) -> tuple[bytes, list[int]]:
        """The prefix table after ``text[start:stop]`` became ``new``: prefixes before it are kept."""
        edited = text[:start] + new + text[stop:]
        return edited, self.extend(edited, last[:start], start)

    def encode_piece(self, piece: bytes) -> list[int]:
        if piece in self.ranks:
            return [self.ranks[piece]]
        return self.read(self.extend(piece, []))

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers."""
        found = [self.pattern.findall(t) for t in texts]
        for piece in self.cache.missing(set().union(*found)):
            self.cache[piece] = array("I", self.encode_piece(piece.encode())).tobytes()
        get = self.cache.__getitem__
        return [b"".join(map(get, pieces)) for pieces in found]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed([text])[0], dtype="<u4").tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        return decode(self.tokens, ids)


@lru_cache(maxsize=2)
def encoder(path: str) -> PrefixEncoder:
    return PrefixEncoder(load_ranks(path))


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """Ids of every whole text: doc_id, n_tokens and ids (binary, little-endian unsigned 32-bit).

    Null and empty texts have no ids; null doc_ids stay null; repeated rows are encoded each; other
    columns are not read. Narrow: no shuffle.
    """
    ship_package(docs.sparkSession)
    path = ranks or public_tokenizers.path(RANKS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = encoder(path)
        for batch, texts in chunks(batches):
            ids = engine.encode_packed(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode_documents(encoded: DataFrame, ranks: str | None = None) -> DataFrame:
    """Digests of ids and of the bytes that they decode to; null ids are taken as none."""
    ship_package(encoded.sparkSession)
    path = ranks or public_tokenizers.path(RANKS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {i: t for t, i in load_ranks(path).items()}
        for batch in batches:
            doc_id, n_tokens, column = (batch.column(batch.schema.get_field_index(n)) for n in ("doc_id", "n_tokens", "ids"))
            a, b = [], []
            for x in column:
                ids = x.as_py() or b""
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(decode(tokens, np.frombuffer(ids, dtype="<u4").tolist())).hexdigest())
            yield pa.RecordBatch.from_arrays([doc_id, n_tokens, pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, SCHEMA)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of all documents and of what they decode to: see ``encode_documents`` and ``decode_documents``."""
    return decode_documents(encode_documents(table(spark, sf_dir, "documents")))
