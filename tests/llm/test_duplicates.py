import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from allelix.llm import blocks, embeddings, graph, near_copies, simhash, suffix_dedup


def brute_components(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components_of_chains_stars_and_noise(spark):
    rnd = random.Random(1)
    pairs = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(200 + rnd.randrange(80), 200 + rnd.randrange(80)) for _ in range(50)]
    roots = brute_components(300, pairs)
    df = spark.createDataFrame([*pairs, *pairs[:5], (7, None)], "a long, b long")
    got = {r.node: r.root for r in graph.components(df).collect()}
    used = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == {x: roots[x] for x in used}
    assert graph.components(df.limit(0)).collect() == []


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_fingerprints_and_components(make, odd_texts):
    rnd = random.Random(8)
    base = " ".join(f"w{rnd.randint(0, 500)}" for _ in range(400))
    near = [" ".join(w if rnd.random() > 0.004 else "new" for w in base.split()) for _ in range(30)]
    texts = odd_texts + [base, *near]
    ids = [None, 3, 3, *range(10, 7 + len(texts))]
    rows = simhash.near_duplicates(make(texts, ids)).collect()
    prints = np.array([brute_fingerprint(t) for t in texts], dtype=np.uint64)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint) for r in rows) == sorted((d is None, d or 0, f"{int(p):016x}") for d, p in zip(ids, prints, strict=True))
    far = np.bitwise_count(prints[:, None] ^ prints[None, :])
    roots = brute_components(len(texts), zip(*np.nonzero(far <= 3), strict=True))
    smallest = {}
    for d, r in zip(ids, roots, strict=True):
        if d is not None:
            smallest[r] = min(d, smallest.get(r, d))
    want = sorted((d is None, d or 0, smallest[r]) for d, r in zip(ids, roots, strict=True))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in rows) == want
    assert simhash.near_duplicates(make([])).collect() == []


def brute_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or ({" ".join(words)} if words else set())


@pytest.mark.parametrize("sample,limit,most", [(10_000, 2, 64), (0, 1, 2)])
def test_near_copies_against_brute_force(spark, make, odd_texts, sample, limit, most, monkeypatch):
    for name, value in (("SAMPLE_ROWS", sample), ("NEAREST", limit), ("ALL", most)):
        monkeypatch.setattr(near_copies, name, value)
    rnd = random.Random(12)
    draw = lambda n: [f"w{rnd.randint(0, 900)}" for _ in range(n)]
    common = draw(30)
    texts = list(odd_texts)
    for _ in range(25):
        base = draw(rnd.randint(20, 250))
        for changes in range(8):  # about 5 shingles of each change: similarities on both sides of 0.8
            words = list(base)
            for at in rnd.sample(range(len(words)), min(changes, len(words))):
                words[at] = "new"
            texts.append(" ".join(words))
    texts += [" ".join(common + draw(rnd.randint(0, 12))) for _ in range(30)]
    whole = draw(40)
    texts += [" ".join(whole[:36]), " ".join(whole)]  # 32 of 36 shingles
    texts += [" ".join(whole[:n]) for n in (33, 29)]
    ids = [*range(5, len(texts) + 3), None, 5]
    sets = [brute_shingles(t) for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    roots = brute_components(len(texts), near)
    first = {}
    for i, r in enumerate(roots):
        first[r] = min(first.get(r, (True, 0)), (ids[i] is None, ids[i] or 0))
    got = near_copies.keep_first(make(texts, ids))
    assert got.columns == make(texts).columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == sorted(first.values())
    assert near_copies.keep_first(make([])).collect() == []


def test_near_copy_behind_many_nearer_candidates(make, monkeypatch):
    monkeypatch.setattr(near_copies, "SAMPLE_ROWS", 0)  # no shingle is known as frequent: lists are long
    rnd = random.Random(17)
    draw = lambda n: [f"w{rnd.randint(0, 1_000_000)}" for _ in range(n)]
    changed = lambda words, at, n: [*words[:at], *draw(n), *words[at + n :]]
    one = draw(104)
    two = changed(one, 40, 7)  # 89 of 111 shingles
    decoys = [changed(words, rnd.randint(5, 88), 9) for words in (one, two) for _ in range(80)]  # 87 of 113
    texts = [" ".join(words) for words in (one, two, *decoys)]
    sets = [brute_shingles(t) for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    roots = brute_components(len(texts), near)
    assert roots[1] == 0
    assert sorted(r.doc_id for r in near_copies.keep_first(make(texts)).collect()) == sorted(set(roots))


@pytest.mark.parametrize("limit,want,left_out", [(1, {(1, 2), (2, 3), (3, 4)}, True), (3, {(a, b) for b in range(2, 5) for a in range(1, b)}, False)])
def test_pairs_name_the_nearest_and_say_what_is_left_out(spark, limit, want, left_out):
    bits = (0, 1, 7, 31)
    lists = spark.createDataFrame([(9, k + 1, 50, 0, x, 0, 0, 0) for k, x in enumerate(bits)], near_copies._LIST)
    linked = spark.createDataFrame([], "node long, root long")
    rows = [tuple(r) for r in near_copies.pairs(lists, linked, limit).collect()]
    assert {r for r in rows if r != (None, None)} == want
    assert ((None, None) in rows) == left_out
    assert {tuple(r) for r in near_copies.pairs(lists, linked, near_copies.ALL + 1).collect()} == {(a, b) for b in range(2, 5) for a in range(1, b)}


def test_unlike_sets_of_a_group_are_not_paired_and_equal_lists_count_once(spark, make):
    near_copies.ship_package(spark)
    rnd = random.Random(19)
    draw = lambda n: [f"w{rnd.randint(0, 1_000_000)}" for _ in range(n)]
    base, twin, texts = draw(200), draw(200), []
    for _ in range(60):  # about 158 of 234 shingles of any two
        words = list(base)
        for part in range(4):
            words[50 * part + rnd.randint(4, 45)] = draw(1)[0]
        texts.append(" ".join(words))
    lists = near_copies.shared_prefixes(near_copies.stored(near_copies.marked(make([*texts, " ".join(twin), " ".join([*twin, "x"])]))))
    none = spark.createDataFrame([], "node long, root long")
    assert near_copies.pairs(lists, none, near_copies.ALL + 1).count() == 1
    assert lists.where("size = 197").count() == 1  # the twins share some 40 shingles of their prefixes


def test_pipeline_removes_near_copies(spark, make, tmp_path):
    rnd = random.Random(13)
    base = [f"w{rnd.randint(0, 5000)}" for _ in range(200)]
    texts = []
    for k in range(5):  # four changed words: 20 of 196 shingles
        words = list(base)
        for at in range(10 + k, 200, 50) if k else ():
            words[at] = f"new{k}"
        texts.append(" ".join(words))
    assert [r.doc_id for r in corpus_pipeline.near_duplicates(spark, make(texts), str(tmp_path)).collect()] == [0]


def test_repeated_ids_leave_one_row_of_each_group(make):
    rnd = random.Random(14)
    a, b = (" ".join(f"w{rnd.randint(0, 5000)}" for _ in range(100)) for _ in range(2))
    # 2 is the first of b's group only: its row in a's group goes
    kept = near_copies.keep_first(make([a, a + " x", b, b, b + " x"], [1, 2, 2, 2, 3])).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, a), (2, b)]


@pytest.mark.parametrize("tree_rows,shard_rows", [(4096, 20_000), (50, 40), (16, 1)])
def test_links_of_dense_fingerprints(spark, tree_rows, shard_rows):
    rng = np.random.default_rng(3)
    center = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    points = {int(c) for c in center}
    for c in center:
        for _ in range(60):
            p = int(c)
            for b in rng.integers(0, 64, rng.integers(1, 6)):
                p ^= 1 << int(b)
            points.add(p)
    points = np.array(sorted(points), dtype=np.uint64)
    roots = brute_components(len(points), zip(*np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= 3), strict=True))
    df = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long")
    found = {r.node: r.root for r in graph.components(simhash.links(df, 3, tree_rows, shard_rows)).collect()}
    groups, want = {}, {}
    for p, r in zip(points.view(np.int64).tolist(), roots, strict=True):
        want.setdefault(r, set()).add(p)
        groups.setdefault(found.get(p, p), set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_tree_search_is_exhaustive():
    rng = np.random.default_rng(4)
    points = np.unique(rng.integers(0, 1 << 20, 2000, dtype=np.uint64))
    q, p = simhash.BKTree(points).search(points[:100], 3)
    assert set(zip(q.tolist(), p.tolist(), strict=True)) == {(i, j) for i in range(100) for j in range(len(points)) if int(points[i] ^ points[j]).bit_count() <= 3}


def test_tree_search_follows_some_edges_and_leaves_others_out():
    points = np.unique(np.random.default_rng(5).integers(0, 1 << 63, simhash.TREE_ROWS, dtype=np.uint64))
    tree = simhash.BKTree(points)
    q, p = tree.search(points[:500], simhash.RADIUS)
    assert set(q.tolist()) == set(range(500)) and all(int(points[i] ^ points[j]).bit_count() <= 3 for i, j in zip(q, p, strict=True))
    assert tree.followed > 0 and tree.left_out > tree.followed / 4


def test_hubs_are_looked_up_like_others(spark):
    pairs = [(0, i) for i in range(1, 400)] + [(i, i + 1000) for i in range(1, 400, 7)]
    df = spark.createDataFrame(pairs, "a long, b long")
    assert {r.root for r in graph.components(df, hub_links=50).collect()} == {0}


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((60, 16))
    rows = [v.astype(np.float32).tolist() for b in base for v in [b, *(b + 0.25 * rng.standard_normal((3, 16)))]]
    dense = [(base[0] + 0.05 * rng.standard_normal(16)).astype(np.float32).tolist() for _ in range(400)]
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, rows[0], rows[0], [1.0, 2.0], [1.0, 2.0]]
    vectors = rows + dense + odd
    ids = [*range(len(vectors) - 2), None, 0]
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<float>, label int, rep int, root string")
    got = embeddings.near_duplicates(df).collect()
    sound = [v is not None and len(v) > 0 and None not in v and bool(np.isfinite(v).all()) and any(v) for v in vectors]
    unit = [np.array(v, dtype=np.float64) / np.linalg.norm(np.array(v, dtype=np.float64)) if s else None for v, s in zip(vectors, sound, strict=True)]
    near = [[j for j in range(len(vectors)) if j != i and sound[i] and sound[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95] for i in range(len(vectors))]
    roots = brute_components(len(vectors), [(i, j) for i, js in enumerate(near) for j in js])
    smallest = {}
    for d, r in zip(ids, roots, strict=True):
        smallest[r] = min(d, smallest.get(r, d)) if d is not None else smallest.get(r)
        smallest = {k: v for k, v in smallest.items() if v is not None}
    want = sorted((d is None, d or 0, len(js), smallest.get(r, -1)) for d, js, r in zip(ids, near, roots, strict=True))
    assert sorted((r.vec_id is None, r.vec_id or 0, r.n_links, -1 if r.component_id is None else r.component_id) for r in got) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert embeddings.near_duplicates(df.limit(0)).collect() == []


def test_passes_grow_with_the_rows():
    sizes = [embeddings.passes_for(n) for n in (0, 1, 10**4, 10**6, 10**8, 10**10)]
    assert sizes == sorted(sizes) and sizes[2] == embeddings.PASSES < sizes[4] < sizes[5] < 200
    assert embeddings.passes_for(10**6, 1.0) == embeddings.PASSES


def test_parts_of_components_count_alike(spark):
    rng = np.random.default_rng(9)
    rows = [(1, i, int(rng.integers(1, 4)), (np.ones(8) + 0.2 * rng.standard_normal(8)).astype(np.float32).tolist()) for i in range(90)]
    df = spark.createDataFrame(rows, "root long, rep long, copies long, embedding array<float>")
    whole = sorted(map(tuple, embeddings.count_links(df).collect()))
    assert sorted(map(tuple, embeddings.count_links(df, group_rows=7).collect())) == whole


def covered(texts, length=200):
    seen = {}
    raw = [(t or "").encode() for t in texts]
    for i, b in enumerate(raw):
        for p in range(len(b) - length + 1):
            seen.setdefault(b[p : p + length], []).append((i, p))
    out = [np.zeros(len(b), dtype=bool) for b in raw]
    for places in seen.values():
        if len(places) > 1:
            for i, p in places:
                out[i][p : p + length] = True
    return out


@pytest.mark.parametrize("large,block", [(2000, 6 << 20), (4, 1 << 15)])
def test_repeats_against_brute_force(make, odd_texts, large, block, monkeypatch):
    rnd = random.Random(3)
    letters = lambda n: "".join(rnd.choice("abcdefghij klmnop") for _ in range(n))
    common = letters(250)
    texts = odd_texts + ["a" * 1000, "ab" * 300, "x" * 199, "é" * 150 + "z" * 300, "é" * 150 + "y" * 300, odd_texts[8][:700]]
    texts += [letters(rnd.randint(0, 300)) + common[: rnd.randint(150, 250)] + letters(rnd.randint(0, 300)) for _ in range(50)]
    texts += [letters(2500) + common, letters(900)]
    monkeypatch.setattr(suffix_dedup, "as_blocks", lambda df: blocks.as_blocks(df, block_bytes=block))
    docs = make(texts).withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id")))
    rows = suffix_dedup.remove_repeats(docs, large).collect()
    want = []
    for t, c in zip(texts, covered(texts), strict=True):
        edge = np.flatnonzero(np.diff(c.astype(np.int8), prepend=0, append=0)).reshape(-1, 2).tolist()
        want.append((t or "", len(c), int(c.sum()), edge, bytes(np.frombuffer((t or "").encode(), np.uint8)[~c])))
    got = [(r.doc.text or "", r.n_bytes, r.n_removed, [[s.start, s.stop] for s in r.spans], bytes(r.kept)) for r in rows]
    assert sorted(got) == sorted(want)
    assert suffix_dedup.remove_repeats(docs.limit(0)).collect() == []


def test_runs_do_not_depend_on_parts(monkeypatch):
    rng = np.random.default_rng(2)
    data = rng.integers(97, 101, 9000, dtype=np.uint8)
    ends = np.array([10, 10, 700, 6500, 6600, 9000])
    whole = suffix_dedup.find_runs(data, ends)
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", 1500)
    parted = suffix_dedup.find_runs(data, ends)
    starts = lambda r: sorted((p, a) for lo, hi, a in zip(r.low.tolist(), r.high.tolist(), r.at.tolist(), strict=True) for p in range(lo, hi + 1))
    assert starts(whole) == starts(parted)


def test_cut_characters_go_whole():
    assert suffix_dedup.without_spans("aéz", [{"start": 2, "stop": 3}]) == "az"
    assert suffix_dedup.without_spans("aéz", []) == "aéz"
