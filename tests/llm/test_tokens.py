import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from allelix.llm import byte_bpe, packing, token_counts

IDS = [0, None, None, 2, 2]


def ids_for(n):
    return IDS + list(range(10, 10 + n - len(IDS)))


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(P.path(byte_bpe.RANKS)), special_tokens={})


def test_token_counts_are_those_of_the_library(make, odd_texts):
    library = Tokenizer.from_file(P.path(token_counts.VOCABULARY))
    got = token_counts.token_counts(make(odd_texts, ids_for(len(odd_texts)))).collect()
    want = sorted(((d is None, d or 0), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t in zip(ids_for(len(odd_texts)), odd_texts, strict=True))
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    assert token_counts.token_counts(make([])).collect() == []


def test_ragged_arrays_are_cut_and_merged_alike(monkeypatch):
    engine = token_counts.RankMerger(P.path(token_counts.VOCABULARY))
    pieces = [b"a" * n for n in range(1, 40)] + [b"abab" * 9, b"hello", b" the"]
    whole = engine.merge(pieces).tolist()
    monkeypatch.setattr(token_counts, "ARRAY_SYMBOLS", 16)
    assert engine.merge(pieces).tolist() == whole == [int(engine.merge([p])[0]) for p in pieces]


def test_a_full_cache_changes_nothing():
    engine = token_counts.RankMerger(P.path(token_counts.VOCABULARY))
    texts = [" ".join(f"w{i * j}" for i in range(50)) for j in range(20)]
    whole = engine.count(texts)
    engine.cache.clear()
    engine.cache.limit = 10
    assert [engine.count([t])[0] for t in texts] == whole


def test_encoding_is_that_of_the_library_and_decodes(make, odd_texts, reference):
    encoded = byte_bpe.encode_documents(make(odd_texts, ids_for(len(odd_texts))))
    got = sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.decode_documents(encoded).collect())
    want = []
    for t in odd_texts:
        ids = reference.encode_ordinary(t or "")
        want.append((len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert byte_bpe.encode_documents(make([])).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abenthr é\n0", max_size=60))
def test_random_texts_encode_alike(text):
    engine = byte_bpe.encoder(P.path(byte_bpe.RANKS))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=engine.ranks, special_tokens={})
    assert engine.encode(text) == library.encode_ordinary(text)


def test_appends_and_edits_keep_the_prefix_table():
    engine = byte_bpe.encoder(P.path(byte_bpe.RANKS))
    text, more = b"international", b"isation"
    table = engine.extend(text, [])
    joined, grown = engine.append(text, list(table), more)
    assert grown == engine.extend(joined, []) and engine.decode(engine.read(grown)) == joined
    edited, changed = engine.edit(joined, list(grown), 5, 8, b"XY")
    assert edited == joined[:5] + b"XY" + joined[8:] and changed == engine.extend(edited, [])


def rebuilt(rows, texts, ids, capacity):
    """Checks pieces against documents, and returns the padding and the sequences' lengths."""
    library = Tokenizer.from_file(P.path(packing.VOCABULARY))
    have = {}
    for d, t in zip(ids, texts, strict=True):
        have.setdefault(d, []).append(np.array(library.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4"))
    spans, sequences = {}, {}
    for r in rows:
        spans.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d, docs in have.items():
        assert sum(r.length for r in spans[d]) == sum(map(len, docs))
        for r in spans[d]:
            assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in docs)
        if len(docs) == 1:
            assert [r.start for r in sorted(spans[d], key=lambda r: r.start)] == np.cumsum([0] + [r.length for r in sorted(spans[d], key=lambda r: r.start)])[:-1].tolist()
    sizes = []
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
        sizes.append(at)
    return sum(0 if n & (n - 1) == 0 else capacity - n for n in sizes), sizes


@pytest.mark.parametrize("capacity,block", [(4096, 2048), (64, 8)])
def test_packing_keeps_every_id_once(make, odd_texts, capacity, block, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_RESTS", block)
    ids = ids_for(len(odd_texts))
    rows = packing.pack(make(odd_texts, ids).coalesce(1), capacity=capacity).collect()
    padding, sizes = rebuilt(rows, odd_texts, ids, capacity)
    assert padding <= 0.1 * sum(sizes)
    assert packing.pack(make([])).collect() == []


def test_differencing_is_balanced_and_whole():
    rng = np.random.default_rng(1)
    for n, k in ((1, 1), (5, 7), (200, 9), (300, 40)):
        sizes = rng.integers(1, 4000, n).tolist()
        parts = packing.differencing(sizes, k)
        assert sorted(i for _, m in parts for i in m) == list(range(n)) and len(parts) <= k
        assert all(total == sum(sizes[i] for i in m) for total, m in parts)
        if n > 5 * k:
            assert max(t for t, _ in parts) - min(t for t, _ in parts) < 200
    # [8, 7, 6, 5, 4] in two parts: the differences 1, 1, 4 give 14 and 16
    assert sorted(t for t, _ in packing.differencing([8, 7, 6, 5, 4], 2)) == [14, 16]
    assert packing.differencing([], 3) == []


def test_the_number_of_windows_rises_when_one_overflows():
    windows = packing.share_out([6, 6, 6], 10)
    assert len(windows) == 3 and all(t == 6 for t, _ in windows)
