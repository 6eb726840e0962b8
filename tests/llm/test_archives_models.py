import io
import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from allelix.llm import blocks, language_model, warc


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, 5, "x") for i, u, h in rows], "page_id long, url string, html string, payload int, revisit string")


def test_archives_keep_every_page(spark):
    big = "<p>" + "".join(random.Random(1).choice("abc é") for _ in range(300_000))
    rows = [(3, "http://a/é b", "same"), (1, None, "same"), (2, "u", "same"), (4, "u", None), (5, "u", ""), (None, "u", "alone"), (None, "u", "same"), (7, "u", big), (8, "u", big), (9, "u\r\nX: 1", "\r\n\r\n"), (1, "u", "same")]
    found = warc.archive_round_trip(pages(spark, rows)).collect()
    assert len(found) == len(rows)
    for r in found:
        payload = next((h or "").encode() for i, _, h in rows if i == r.page_id and warc.digest_of((h or "").encode()) == r.payload_digest)
        same = [i for i, _, h in rows if (h or "").encode() == payload and i is not None]
        assert r.payload_bytes == len(payload)
        first = min(same, default=None)
        if r.page_id == first or first is None:
            assert (r.record_type, r.refers_to, bytes(r.payload)) == ("response", None, payload)
        else:
            assert (r.record_type, r.refers_to, r.payload) == ("revisit", first, None)
    assert warc.archive_round_trip(pages(spark, rows).limit(0)).collect() == []
    kinds = Counter(r.record_type for r in warc.archive_round_trip(pages(spark, rows), least=5).collect())
    assert kinds == {"response": 10, "revisit": 1}


def archive(records):
    writer = warc.ArchiveWriter(records)
    for r in records:
        writer.add(r)
    return writer.out.getvalue()


def test_damaged_archives_are_refused():
    records = [warc.make_record(i, "http://x/", f"<html>{i}".encode() * 50, None, False) for i in range(30)]
    raw = archive(records)
    assert struct.unpack_from("<I", raw)[0] == warc.DICTIONARY_FRAME_MAGIC
    assert [warc.page_of(r.headers["WARC-Record-ID"]) for r in warc.read_archive(io.BytesIO(raw))] == list(range(30))
    for bad in (raw[8:], raw[:-3], raw[:6], b"\0" * 20, raw[:-40] + b"\0" * 40):
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(io.BytesIO(bad)))
    good = records[0]
    for change in (good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"WARC-Type: ", b"WARC-Type "), good + b"x", good.replace(b"WARC-Date", b"WARC-Dote"), good.replace(b"\r\nContent-Length: ", b"\r\nContent-Length: 9", 1)):
        with pytest.raises(warc.WarcError):
            warc.parse_record(change)


def test_sequences_come_back():
    rng = np.random.default_rng(0)
    for v in (*(np.sort(rng.integers(0, 10**k, 700)) for k in (1, 4, 9, 15)), np.zeros(0, int), np.array([0]), np.array([5, 5, 5])):
        read, at = language_model.EliasFano.read(blob := language_model.EliasFano.encode(v), 0)
        assert at == len(blob) and (read.decode() == v.astype(np.uint64)).all()
        assert not len(v) or (read.get(np.arange(len(v))) == v.astype(np.uint64)).all()


def test_levels_answer_from_a_memory_map(tmp_path):
    import mmap

    columns, size = np.array([[3, 9, 11]], dtype=np.uint64), np.array([2, 1, 3])
    words, codes = np.array([5, 70, 5, 1, 5, 1 << 40], dtype=np.uint64), np.array([1, 2, 3, 4, 5, 6], dtype=np.uint8)
    path = tmp_path / "level"
    path.write_bytes(language_model.Level.build(columns, size, words, np.array([9, 8, 7], dtype=np.uint8), codes))
    with path.open("rb") as file:
        level = language_model.Level(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))
        found = level.contexts(np.array([[11, 4, 3]], dtype=np.uint64))
        assert found.tolist() == [2, -1, 0]
        assert level.search(np.repeat(found, [3, 1, 2]), np.array([1, 1 << 40, 70, 5, 70, 6], dtype=np.uint64)).tolist() == [4, 6, 0, 0, 2, 0]
        assert [level.successor(2, 5), level.successor(2, 70), level.successor(0, 70)] == [5, 0, 2]


def brute_scores(texts, ids, order, split):
    lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t)
    docs = [[w for w in lower(t or "").translate(dict.fromkeys(range(9, 14), " ")).split(" ") if w] + ["\n"] for t in texts]
    train = [d is not None and zlib.crc32(str(d).encode()) % 10 != 0 for d in ids]
    c = Counter(w for ws, f in zip(docs, train, strict=True) if f for w in ws)
    n, v = sum(c.values()), len(c)
    grams, whole, kinds = (Counter() for _ in range(3))
    for ws, f in zip(docs, train, strict=True):
        for k in range(2, order + 1) if f else ():
            padded = [None] * (k - 1) + ws
            grams.update(tuple(padded[i : i + k]) for i in range(len(ws)))
    for g, m in grams.items():
        whole[g[:-1]] += m
        kinds[g[:-1]] += 1
    coded = lambda p: language_model.VALUES[language_model.quantised(np.array([p]))[0]]
    out = []
    for ws in docs:
        base = score = 0.0
        for i, w in enumerate(ws):
            p = (c[w] + 0.1) / (n + 0.1 * (v + 1))
            base += math.log10(p)
            for k in range(2, order + 1):
                g = tuple(([None] * (k - 1) + ws)[i : i + k])
                if m := whole[g[:-1]]:
                    share = min(1.0, 0.75 * kinds[g[:-1]] / m)
                    p = (coded((grams[g] - 0.75) / m) if grams[g] else 0.0) + (share if k == 2 and m >= split else coded(share)) * p
            score += math.log10(p)
        out.append((len(ws), sum(c[w] > 0 for w in ws), n, round(base, 6), round(score, 6)))
    return out


@pytest.mark.parametrize("order,split,block", [(2, 10_000, 6 << 20), (3, 40, 4000)])
def test_scores_against_brute_force(make, odd_texts, order, split, block, monkeypatch):
    rnd = random.Random(7)
    texts = odd_texts + [" ".join(rnd.choice(["The", "cat", "sat", "on", "mats", f"n{rnd.randint(0, 60)}"]) for _ in range(rnd.randint(1, 60))) for _ in range(80)]
    ids = [None, 4, 4, *range(10, 7 + len(texts))]
    original = language_model.as_blocks
    monkeypatch.setattr(language_model, "as_blocks", lambda df, pack: original(df, block_bytes=block, pack=pack))
    if split < 10_000:
        monkeypatch.setattr(language_model, "shard_count", lambda b, n: 600)  # then no context holds more than the split
    rows = language_model.score_documents(make(texts, ids), order, split).collect()
    want = brute_scores(texts, ids, order, split)
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in rows) == sorted(want)
    assert {r.doc_id: r.held_out for r in rows}[None] is False
    assert language_model.score_documents(make([])).collect() == []


def test_query_scores_with_trigrams(spark, make, tmp_path):
    rnd = random.Random(17)
    texts = [" ".join(rnd.choice(["the", "cat", "sat", "on", "mats"]) for _ in range(30)) for _ in range(60)]
    make(texts).write.parquet(f"{tmp_path}/documents.parquet")
    rows = language_model.op4_language_model(spark, str(tmp_path)).collect()
    assert sorted(round(r.score, 6) for r in rows) == sorted(x[-1] for x in brute_scores(texts, range(60), 3, 10_000))


def test_blocks_hold_every_row(make, odd_texts):
    held = blocks.as_blocks(make(odd_texts).select("doc_id", "text"), block_bytes=500)
    rows = [r for b in held.collect() for r in blocks.rows_of(b.payload).to_pylist()]
    assert sorted(r["doc_id"] for r in rows) == list(range(len(odd_texts)))
    assert held.count() > 3


def test_pipeline_stages_keep_columns_and_clean_documents(spark, make, tmp_path):
    rnd = random.Random(1)
    clean = [" ".join(f"{rnd.choice(['alpha', 'beta', 'gamma'])}{rnd.randint(0, 9999)}" for _ in range(90)) + "." for _ in range(40)]
    junk = [None, "short", " ".join(f"{w}###" for w in clean[0].split()), clean[3], clean[3]]
    make(clean + junk).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    counts = []
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality_rules" and len(corpus_pipeline.STAGES) == 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs, columns = spark.read.parquet(f"{tmp_path}/{name}"), docs.columns
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts == [42, 42, 40, 40]
    assert sorted(r.text for r in docs.collect()) == sorted(clean)
    assert corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().count() == 40
