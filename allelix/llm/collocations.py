"""Collocations: phrases whose words occur together far more often than apart.

Documents are dealt to shards. A shard turns its texts into one array of word ids, sorts all suffixes
of it by prefix doubling, and reads the counts of its n-grams off the intervals of the array in which
neighbouring suffixes agree in n words or more. A shard thus names an n-gram once, however often it
holds it, and sends its n-grams to buckets by hash, sorted and compressed; a bucket adds up what the
shards say. N-grams below the least count are gone after that, since every part of a frequent phrase is
frequent too. Cuts, scores and containment are joins on the frequent n-grams.

A message is sent only for buckets that a shard has n-grams of, so that there are never more messages
than n-grams of shards.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from allelix.llm.blocks import release, stored
from allelix.llm.common import table
from allelix.llm.line_dedup import LOWER, UPPER
from allelix.session import ship_package

MAX_WORDS = 3
MIN_COUNT = 10
CONTAINED_PERCENT = 50
TOP = 2000
SCALE = 1_000_000
NO_LANG = "und"
#: Bytes of text of a shard, and for each bucket; a longer text is a shard of its own.
SHARD_BYTES, BUCKET_BYTES = 12 << 20, 8 << 20
#: Rows of a language that are ranked together.
RANK_ROWS = 50_000
#: Every mark that ends a piece becomes one that no word can hold, and tabs become spaces.
_MARKS = bytes.maketrans(b",;:!?\n\x0b\x0c\r\t", b"......... ")


class _Words(dict):
    """Numbers of words in the order in which they come, from 1; 0 is the end of a piece."""

    def __init__(self):
        super().__init__({b".": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def word_ids(text: bytes, words: _Words) -> np.ndarray:
    """The words of a text as numbers, with 0 between and after its pieces."""
    tokens = text.lower().translate(_MARKS).replace(b".", b" . ").split()
    return np.fromiter(map(words.__getitem__, tokens), np.int32, len(tokens))


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Places of all suffixes, in order of their first ``depth`` ids at least, by doubling of ranked prefixes."""
    rank, known = ids.astype(np.int64), 1
    order = np.argsort(rank, kind="stable") if depth == 1 else None
    while known < depth:
        ahead = np.zeros_like(rank)
        ahead[:-known] = rank[known:]
        key = rank * (int(rank.max(initial=0)) + 1) + ahead
        order = np.argsort(key)
        known *= 2
        if known < depth:
            risen = key[order]
            rank = np.empty_like(rank)
            rank[order] = np.concatenate([[0], np.cumsum(risen[1:] != risen[:-1])])
    return order


def ngram_counts(ids: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n from 1: a place of each distinct n-gram inside pieces, in the order of the suffix array, and its count."""
    order = suffix_array(ids, longest)
    padded = np.concatenate([ids, np.zeros(longest, ids.dtype)])
    ends = np.flatnonzero(padded == 0)
    agree = np.ones(len(order) - 1, bool)
    for n in range(1, longest + 1):
        column = padded[order + (n - 1)]
        agree &= column[1:] == column[:-1]  # whether the common prefix with the suffix before has n ids
        starts = np.concatenate([[0], np.flatnonzero(~agree) + 1])
        counts, places = np.diff(starts, append=len(order)), order[starts]
        inside = ends[np.searchsorted(ends, places)] - places >= n
        yield places[inside], counts[inside]


def _sorted_words(words: _Words) -> tuple[list[bytes], np.ndarray]:
    """All words in byte order, and the number each old number becomes."""
    old = list(words)[1:]
    by_bytes = sorted(range(len(old)), key=old.__getitem__)
    renumbered = np.zeros(len(old) + 1, np.int32)
    renumbered[np.array(by_bytes, np.int64) + 1] = np.arange(1, len(old) + 1, dtype=np.int32)
    return [old[i] for i in by_bytes], renumbered


def shard_ngrams(lang: str, parts: list[np.ndarray], words: _Words, longest: int, buckets: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(buckets, keys, counts) of a language's n-grams in a shard, sorted by bucket; a key is the language, a tab and the phrase.

    The key of the empty phrase has the number of words.
    """
    prefix = lang.encode() + b"\t"
    names, renumbered = _sorted_words(words)
    ids = renumbered[np.concatenate([p for part in parts for p in (part, np.zeros(1, np.int32))])]
    hashes = np.array([0, *(xxhash.xxh64_intdigest(w, 7) for w in names)], np.uint64)
    first, later = pa.array([b"", *(prefix + w for w in names)], pa.large_binary()), pa.array([b"", *names], pa.large_binary())
    home = np.uint64(xxhash.xxh64_intdigest(prefix, 11))
    keys, counts, places = [pa.array([prefix], pa.large_binary())], [np.array([np.count_nonzero(ids)])], [np.array([home])]
    for n, (at, count) in enumerate(ngram_counts(ids, longest), 1):
        mixed = np.full(len(at), home, np.uint64)
        for k in range(n):
            mixed = (mixed ^ hashes[ids[at + k]]) * np.uint64(0x9E3779B97F4A7C15)
        columns = [(later if k else first).take(pa.array(ids[at + k])) for k in range(n)]
        keys.append(pc.binary_join_element_wise(*columns, pa.scalar(b" ", pa.large_binary())) if n > 1 else columns[0])
        counts.append(count)
        places.append(mixed)
    bucket = ((np.concatenate(places) >> np.uint64(20)) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
    order = np.argsort(bucket, kind="stable")
    return bucket[order], pa.concat_arrays(keys).take(pa.array(order)), np.concatenate(counts)[order]


def packed_counts(keys: pa.LargeBinaryArray, counts: np.ndarray) -> bytes:
    """Counts, lengths and bytes of keys, compressed."""
    ends = np.frombuffer(keys.buffers()[1], np.int64, len(keys) + 1, keys.offset * 8)
    data = keys.buffers()[2][int(ends[0]) : int(ends[-1])] if ends[-1] > ends[0] else b""
    raw = b"".join([np.int64(len(keys)).tobytes(), counts.astype(np.int64).tobytes(), np.diff(ends).astype(np.uint32).tobytes(), data])
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpacked_counts(message: bytes) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(message)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    counts, sizes = np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, np.uint32, n, 8 + 8 * n)
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw[8 + 12 * n :])]), counts


def frequent_ngrams(docs: DataFrame, longest: int = MAX_WORDS, least: int = MIN_COUNT, shard_bytes: int = SHARD_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(lang, n, phrase, f) of all phrases of 1 to ``longest`` words that a language's texts hold ``least`` times.

    n = 0 is the empty phrase: there f is the number of all words, for each language with a text, even if it is under ``least``.
    """
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket_bytes))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list[np.ndarray], _Words]] = {}
        size = 0

        def shard() -> Iterator[pa.RecordBatch]:
            for lang, (parts, words) in held.items():
                bucket, keys, counts = shard_ngrams(lang, parts, words, longest, buckets)
                edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
                for low in range(0, len(edges) - 1, 64):
                    ends = edges[low : low + 65].tolist()
                    sent = [packed_counts(keys.slice(a, b - a), counts[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[ends[:-1]].astype(np.int64)), pa.array(sent, pa.binary())], names=["bucket", "message"])
            release()

        for batch in batches:
            texts, langs = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                text = texts[i].as_py() or b""
                if size and size + len(text) > shard_bytes:
                    yield from shard()
                    held, size = {}, 0
                parts, words = held.setdefault(langs[i].as_py(), ([], _Words()))
                parts.append(word_ids(text, words))
                size += len(text)
        yield from shard()

    def merge(group: pa.Table) -> pa.Table:
        bucket, messages = group["bucket"], group["message"]
        keys, counts = zip(*(unpacked_counts(m.as_py()) for m in messages), strict=True)
        summed = pa.table({"k": pa.chunked_array(list(keys)), "c": np.concatenate(counts)}).group_by("k").aggregate([("c", "sum")])
        del keys, counts, bucket
        empty = pc.equal(pc.binary_slice(summed["k"].cast(pa.binary()), -1), b"\t")
        summed = summed.filter(pc.or_(empty, pc.greater_equal(summed["c_sum"], least)))
        named = [k.rsplit(b"\t", 1) for k in summed["k"].to_pylist()]
        release()
        return pa.table({
            "lang": pa.array([x[0].decode() for x in named], pa.string()),
            "n": pa.array([x[1].count(b" ") + 1 if x[1] else 0 for x in named], pa.int32()),
            "phrase": pa.array([x[1].decode() for x in named], pa.string()),
            "f": summed["c_sum"].combine_chunks().cast(pa.int64()),
        })

    ship_package(docs.sparkSession)
    sent = docs.select(F.col("text").cast("binary").alias("text"), F.coalesce("lang", F.lit(NO_LANG)).alias("lang")).mapInArrow(count, "bucket long, message binary")
    return sent.groupBy("bucket").applyInArrow(merge, "lang string, n int, phrase string, f long")


def _part(first: Column, count: Column) -> Column:
    return F.array_join(F.slice("w", first, count), " ")


def with_weakest_cut(candidates: DataFrame, frequent: DataFrame) -> DataFrame:
    """Candidates with l, r and score of their lowest-scoring cut, of equal ones the first."""
    cuts = candidates.withColumn("w", F.split("phrase", " ")).select("lang", "phrase", "n", "a", "w", F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"))
    sides = F.array(F.struct(F.lit(0).alias("side"), _part(F.lit(1), F.col("k")).alias("part")), F.struct(F.lit(1).alias("side"), _part(F.col("k") + 1, F.col("n") - F.col("k")).alias("part")))
    asked = cuts.select("lang", "phrase", "n", "a", "k", F.inline(sides))
    known = frequent.where("n > 0").select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), "f")
    found = asked.join(known, (F.col("lang") == F.col("_lang")) & (F.col("part") == F.col("_phrase")))
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("f")))
    cut = found.groupBy("lang", "phrase", "n", "a", "k").agg(of(0).alias("l"), of(1).alias("r"))
    # decimals of 38 digits hold a million times the square of any count up to 1e16; div is exact
    wide = lambda c: f"CAST({c} AS DECIMAL(19, 0))"
    score = F.expr(f"CAST(CAST({wide('a')} * {wide('a')} * CAST({SCALE} AS DECIMAL(19, 0)) AS DECIMAL(38, 0)) div CAST({wide('l')} * {wide('r')} AS DECIMAL(38, 0)) AS BIGINT)")
    best = cut.groupBy("lang", "phrase", "n", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", F.col("n").alias("words"), "a", "cut.l", "cut.r", "cut.score")


def inside_longer(candidates: DataFrame, longest: int) -> DataFrame:
    """(_lang, _phrase, longer): the largest count of a longer candidate that holds the phrase."""
    long_ones = candidates.where("n > 2").withColumn("w", F.split("phrase", " "))
    spans = long_ones.select("lang", "n", "a", "w", F.explode(F.sequence(F.lit(2), F.col("n") - 1)).alias("m")).select("lang", "n", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("m") + 1)).alias("i"))
    return spans.groupBy(F.col("lang").alias("_lang"), _part(F.col("i"), F.col("m")).alias("_phrase")).agg(F.max("a").alias("longer"))


def first_of_each(rows: DataFrame, top: int, rank_rows: int = RANK_ROWS) -> DataFrame:
    """``rows`` with ``rank``, the first ``top`` of each lang by falling score and count, then by phrase.

    A language's rows are dealt to groups of about ``rank_rows``; the firsts of groups meet in ever fewer
    groups, so that no task ranks a language that holds most of the rows.
    """
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    step = max(2, rank_rows // top)
    groups = -(-rows.count() // rank_rows)
    while groups > 1:
        w = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(groups))).orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).drop("rank")
        groups = groups // step
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return ranked.where(F.col("rank") <= top)


def collocations(docs: DataFrame, longest: int = MAX_WORDS, least: int = MIN_COUNT, contained_percent: int = CONTAINED_PERCENT, top: int = TOP, **sizes: int) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of 2 to ``longest`` words.

    Null and empty texts have no words, a null lang is ``und``; phrases never cross the marks that end a
    piece. Equal scores go by count, then by the bytes of the phrase. Repeated rows count each; texts are
    read whole, columns but text and lang not at all; an empty table gives no rows.
    """
    docs = docs.select("text", "lang")
    frequent = stored(frequent_ngrams(docs, longest, least, **sizes))
    candidates = frequent.where((F.col("n") >= 2) & (F.col("f") >= least)).withColumnRenamed("f", "a")
    scored = with_weakest_cut(candidates, frequent)
    longer = inside_longer(candidates, longest)
    joined = scored.join(longer, (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_phrase")), "left")
    alone = stored(joined.where(F.col("longer").isNull() | (100 * F.col("longer") < contained_percent * F.col("a"))).drop("_lang", "_phrase", "longer"))
    totals = frequent.where("n = 0").select(F.col("lang").alias("_lang"), F.col("f").alias("n"))
    return first_of_each(alone, top).join(totals, F.col("lang") == F.col("_lang")).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of each language of ``documents``; cases as in ``collocations``."""
    return collocations(table(spark, sf_dir, "documents"))


def _grams(n: int) -> str:
    words = " || ' ' || ".join(f"w[i + {k}]" for k in range(n))
    return f"SELECT lang, {n} AS n, {words} AS phrase, count(*) AS f FROM (SELECT lang, w, unnest(range(1, len(w) - {n} + 2)) AS i FROM pieces WHERE len(w) >= {n}) GROUP BY ALL"


ORACLE_SQL = rf"""WITH texts AS (SELECT coalesce(lang, '{NO_LANG}') AS lang, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
pieces AS (SELECT lang, regexp_extract_all(unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM texts),
f AS ({" UNION ALL ".join(_grams(n) for n in range(1, MAX_WORDS + 1))}),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE n >= 2 AND f >= {MIN_COUNT}),
cuts AS (SELECT *, unnest(range(1, n)) AS k FROM c),
s AS (SELECT cuts.lang, cuts.phrase, cuts.n AS words, cuts.f AS a, k, x.f AS l, y.f AS r, CAST((CAST({SCALE} AS HUGEINT) * cuts.f * cuts.f) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score FROM cuts
  JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(cuts.w[1:k], ' ') JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(cuts.w[k + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT DISTINCT c.lang, array_to_string(c.w[j:j + 1], ' ') AS phrase, c.f AS longer FROM (SELECT *, unnest(range(1, n)) AS j FROM c WHERE n > 2) c),
a AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.lang = b.lang AND i.phrase = b.phrase AND 100 * i.longer >= {CONTAINED_PERCENT} * b.a)),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM a)
SELECT r.lang, rank, phrase, a, l, r.r, n.n, score FROM r JOIN n ON r.lang = n.lang WHERE rank <= {TOP}"""
