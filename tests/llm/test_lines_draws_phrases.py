"""Line dedup, importance resampling and collocations against brute force, with odd and empty inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from allelix.llm import collocations as C
from allelix.llm import line_dedup, resampling

WHITE = " \t\n\x0b\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lines_by_hand(rows, chars=20, documents=3):
    holders = defaultdict(set)
    keys = lambda t: [x.strip(WHITE).translate(LOWER) for x in (t or "").split("\n")]
    for d, t in rows:
        for k in keys(t):
            if len(k) >= chars:
                holders[k].add(d)
    last = {k: max((d for d in ids if d is not None), default=None) for k, ids in holders.items() if len(ids) >= documents}
    out = []
    for d, t in rows:
        kept = [x for x, k in zip((t or "").split("\n"), keys(t), strict=True) if k not in last or last[k] == d]
        n = (t or "").count("\n") + 1
        out.append((d, n, n - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def lines_by_spark(df, **options):
    return sorted(((r.doc_id, len(r.lines), len(r.dropped), r.kept) for r in line_dedup.drop_shared_lines(df, **options).collect()), key=str)


def test_lines_equal_brute_force(make, odd_texts):
    shared = "All rights of this line are SHARED by many."
    wide = "ÄÖÜ straße naïve 日本語日本語 x"
    texts = [*odd_texts, *(f"{i}\n \t{shared}\r\nown line of document number {i}\n{shared.lower()}\n" for i in range(6)), *(f"{wide}\n{i}" for i in range(3)), shared, shared + "\n" + shared, "x" * 19 + "\n", "x" * 19 + "\n"]
    ids = list(range(len(texts)))
    ids[-1] = None  # a null id
    ids[-4] = ids[-5]  # repeated ids count once
    df = make(texts, ids)
    assert lines_by_spark(df) == lines_by_hand(list(zip(ids, texts, strict=True)))
    assert lines_by_spark(df.union(df)) == sorted(2 * lines_by_hand(list(zip(ids, texts, strict=True))), key=str)
    assert lines_by_spark(df, min_chars=1, min_documents=2) == lines_by_hand(list(zip(ids, texts, strict=True)), 1, 2)


def test_line_of_every_document_and_a_long_text(make):
    hot = "this very line stands in each of all documents"
    long = "\n".join([hot, *(f"{i} is a line of the long text alone" for i in range(30_000)), hot])
    texts = [long, *(f"{hot}\n{i}" for i in range(200))]
    got = lines_by_spark(make(texts))
    assert got == lines_by_hand(list(enumerate(texts)))
    assert [r[2] for r in sorted(got)][:2] == [2, 1] and sorted(got)[-1][2] == 0


def test_lines_of_an_empty_table(make):
    assert lines_by_spark(make([]).limit(0)) == []


def draw_by_hand(rows, target, grams, buckets, least, percent, seed):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
    runs = lambda t: [" ".join(w[i : i + n]) for w in [words(t)] for n in range(1, grams + 1) for i in range(len(w) - n + 1)]
    named = lambda t: [zlib.crc32(x.encode()) % buckets for x in runs(t)]
    s, t = Counter(b for _, x in rows for b in named(x)), Counter(b for x in target for b in named(x))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = []
    for d, x in rows:
        own = named(x)
        weight = sum(map(gain, own)) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(x)) >= least])
    inside = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(inside[: percent * len(inside) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize(("grams", "percent"), [(1, 10), (3, 55), (2, 100)])
def test_draw_equals_brute_force(make, odd_texts, grams, percent):
    rnd = random.Random(3)
    texts = [*odd_texts, *(" ".join(rnd.choice(["alpha", "Beta", "γάμμα", "d4", "e"]) for _ in range(rnd.randint(0, 60))) for _ in range(80))]
    ids = list(range(len(texts)))
    ids[3], ids[-1] = None, ids[-2]
    target = [None, "", "beta BETA e e alpha", "γάμμα γάμμα"]
    options = {"grams": grams, "buckets": 50, "min_words": 20, "percent": percent, "seed": "7"}
    got = resampling.importance_resampling(make(texts, ids), make(target), **options).collect()
    assert sorted((tuple(r) for r in got), key=str) == draw_by_hand(list(zip(ids, texts, strict=True)), target, grams, 50, 20, percent, "7")


def test_draw_of_ties_and_empty_tables(make):
    same = make(["word " * 30] * 40, [5] * 40)  # one id, one score
    ranks = [r.rank for r in resampling.importance_resampling(same, make(["word"]), percent=25).collect()]
    assert sorted(r for r in ranks if r) == list(range(1, 11)) and ranks.count(None) == 30
    empty = make([]).limit(0)
    assert resampling.importance_resampling(empty, make(["a"])).count() == 0
    assert {r.rank for r in resampling.importance_resampling(make(["a b", None]), empty).collect()} == {None}
    drawn = resampling.drawn_documents(make(["w " * 30, "v " * 30], [1, 2]), make(["v"]), percent=50)
    assert drawn.count() == 1 and drawn.columns == make([]).columns


def phrases_by_hand(rows, longest=3, least=10, percent=50, top=2000):
    f, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        totals[lang] += 0
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            totals[lang] += len(w)
            f[lang].update(tuple(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = {p[i : i + m] for p, a in found.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= percent * found[p[i : i + m]]}
        scored = []
        for p, a in found.items():
            if p not in gone:
                score, k = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, totals[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("longest", "top", "sizes"), [(3, 2000, {}), (3, 7, {"shard_bytes": 300, "bucket_bytes": 100}), (5, 40, {"shard_bytes": 1000}), (2, 2000, {})])
def test_phrases_equal_brute_force(make, odd_texts, longest, top, sizes):
    rnd = random.Random(longest)
    some = ["New", "york", "city", "of", "the", "naïve", "日本", "ß", "x\x00y", "\x1cq"]
    texts = [*odd_texts, *(rnd.choice([" ", "\t", ", ", "\r\n", "! "]).join(rnd.choice(some) for _ in range(rnd.randint(0, 40))) for _ in range(150)), *("new YORK city hall" for _ in range(30))]
    langs = [rnd.choice(["en", "de", None, "a\tb"]) for _ in texts]
    got = C.collocations(make(texts, langs=langs), longest, 10, 50, top, **sizes).collect()
    expected = phrases_by_hand(list(zip(langs, texts, strict=True)), longest, 10, 50, top)
    assert sorted(map(tuple, got)) == expected and len(expected) > 20


def test_phrases_of_an_empty_table_and_firsts_of_groups(spark, make):
    assert C.collocations(make([]).limit(0)).count() == 0
    assert C.collocations(make([None, "", ". !"])).count() == 0
    rows = [("en", f"p{i:04d}", i % 7, i % 50) for i in range(3000)] + [("de", "q", 1, 1)]
    df = spark.createDataFrame(rows, "lang string, phrase string, a long, score long")
    got = sorted((r.lang, r.rank, r.phrase) for r in C.first_of_each(df, 10, rank_rows=40).collect())
    best = sorted((r for r in rows if r[0] == "en"), key=lambda r: (-r[3], -r[2], r[1]))[:10]
    assert got == [("de", 1, "q"), *(("en", k, r[1]) for k, r in enumerate(best, 1))]


def test_scores_beyond_64_bits(spark):
    big = 3 * 10**12
    frequent = spark.createDataFrame([("en", 1, "a", big + 7), ("en", 1, "b", big + 1), ("en", 2, "a b", big)], "lang string, n int, phrase string, f long")
    got = C.with_weakest_cut(frequent.where("n = 2").withColumnRenamed("f", "a"), frequent).first()
    assert (got.l, got.r, got.score) == (big + 7, big + 1, 1_000_000 * big * big // ((big + 7) * (big + 1)))


def test_suffixes_are_in_order():
    rnd = np.random.default_rng(1)
    for n in (1, 2, 50, 400):
        ids = rnd.integers(0, 4, n).astype(np.int32)
        order = C.suffix_array(ids, 4).tolist()
        padded = [*ids.tolist(), 0, 0, 0, 0]
        keys = [padded[i : i + 4] for i in order]
        assert keys == sorted(keys) and sorted(order) == list(range(n))
