"""Importance resampling towards a target distribution over hashed word n-grams.

A text's features are hashed into a fixed number of buckets. Every bucket has a gain, the logarithm of
how much more often the target uses it; a text's weight is the floored mean of the gains of its
features, and a random number of its own (Gumbel noise from a hash of seed and id) makes the highest
scores a draw without replacement. Scores are whole numbers: their exact histogram, summed from the
top, gives the cutoff and the rank at which each score begins, so that ranks inside a score are all
that is left to be numbered.

Buckets are made by the JVM and stored; counts, weights and suffix sums are numpy work on whole
columns. The driver sees the buckets' counts (as many as buckets) and the histogram: weights lie
between the smallest and the largest gain and noise between -3,200 and 23,000, some 100,000 scores
for a corpus of any size.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from allelix.llm.blocks import stored
from allelix.llm.common import table
from allelix.llm.line_dedup import LOWER, UPPER
from allelix.session import ship_package

#: What is no part of a word, once A-Z are lower-cased.
WORD_GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
BUCKETS = 10_000
GRAMS = 1
MIN_WORDS = 20
PERCENT = 10
SEED = "2024"


def features(texts: DataFrame, grams: int, buckets: int, *keep: Column) -> DataFrame:
    """``keep``, n_words and ``buckets``: the bucket of every run of 1 to ``grams`` consecutive words, repeats included."""
    lowered = F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER)
    words = texts.select(*keep, F.array_remove(F.split(lowered, WORD_GAP, -1), "").alias("w"))

    def runs(n: int) -> Column:
        starts = F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice("w", i, n), " "))

    every = F.concat(F.col("w"), *(runs(n) for n in range(2, grams + 1))) if grams > 1 else F.col("w")
    kept = [c for c in words.columns if c != "w"]
    return words.select(*kept, F.size("w").cast("long").alias("n_words"), F.transform(every, lambda x: (F.crc32(x.cast("binary")) % buckets).cast("int")).alias("buckets"))


def bucket_counts(rows: DataFrame, buckets: int) -> np.ndarray:
    """How many features of all ``rows`` each bucket holds."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], names=["bucket", "n"])

    found = rows.select("buckets").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # at most one row a bucket
    counts = np.zeros(buckets, np.int64)
    for r in found:
        counts[r["bucket"]] = r["n"]
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the source."""
    k, all_s, all_t = len(source), int(source.sum()), int(target.sum())
    top, low = float(all_s + k), float(all_t + k)
    return np.array([math.floor(1000 * math.log((float(t + 1) * top) / (float(s + 1) * low))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight: the floored mean gain of a row's features, 0 without any."""

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            sums = np.concatenate([[0], np.cumsum(gain[lists.flatten().to_numpy(zero_copy_only=False)])])[ends]
            n = np.diff(ends)
            weight = np.where(n > 0, np.floor_divide(np.diff(sums), np.maximum(n, 1)), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(weight, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    return rows.select("doc_id", "n_words", "buckets").mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def noise(seed: str) -> Column:
    """Whole Gumbel noise of a document, by its id alone; a null id is hashed as an empty one."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(scored: DataFrame, draw: int) -> DataFrame:
    """``scored`` with ``rank``, 1 to ``draw`` by falling score and then rising doc_id among rows with ``eligible``; null for all others.

    No score holds more than a share of 1 in 2,700 of distinct ids, whatever the weights: the noise is spread that far.
    """
    spark = scored.sparkSession
    histogram = scored.where("eligible").groupBy("score").agg(F.count("*").alias("n")).toPandas().sort_values("score", ascending=False)
    scores, upto = histogram["score"].to_numpy(np.int64), np.cumsum(histogram["n"].to_numpy(np.int64))
    if not draw or not len(scores):
        return scored.withColumn("rank", F.lit(None).cast("long"))
    last = int(np.searchsorted(upto, draw))  # the score in which the draw ends
    before = np.concatenate([[0], upto[:last]])
    offsets = spark.createDataFrame(list(zip(scores[: last + 1].tolist(), before.tolist(), strict=True)), "_score long, _before long")
    above = F.col("eligible") & (F.col("score") >= int(scores[last]))
    inside = F.row_number().over(Window.partitionBy("score").orderBy("doc_id", "n_features", "weight"))
    # one row for each score down to the cutoff, some 100,000 at most
    drawn = scored.where(above).join(F.broadcast(offsets), F.col("score") == F.col("_score"))
    place = (F.col("_before") + inside).cast("long")
    drawn = drawn.withColumn("rank", place).select(*scored.columns, F.when(F.col("rank") <= draw, F.col("rank")).alias("rank"))
    return drawn.unionByName(scored.where(~above).withColumn("rank", F.lit(None).cast("long")))


def importance_resampling(docs: DataFrame, target: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: str = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of each row of ``docs``; rank is null for rows that are not drawn.

    ``percent`` of the rows with at least ``min_words`` words are drawn, rounded down. Null and empty texts
    have no features, weight 0 and are not drawn. Rows of one id have the same noise and are ranked by id, then
    features, then weight; equal rows in any order. An empty target gives all buckets' gains from the source
    alone, empty ``docs`` no rows. Of either table only doc_id and text are read, texts whole.
    """
    ship_package(docs.sparkSession)
    rows = stored(features(docs, grams, buckets, F.col("doc_id").cast("long").alias("doc_id")))
    gain = gains(bucket_counts(rows, buckets), bucket_counts(features(target, grams, buckets), buckets))
    eligible = F.col("n_words") >= min_words
    scored = stored(weighed(rows, gain).select("doc_id", "n_features", "weight", (F.col("weight") + noise(seed)).alias("score"), eligible.alias("eligible")))
    draw = percent * scored.where("eligible").count() // 100
    return ranked(scored, draw).select("doc_id", "n_features", "weight", "score", "rank")


def drawn_documents(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, whose id is drawn; arguments and cases as in ``importance_resampling``."""
    ids = importance_resampling(docs, target, **options).where("rank IS NOT NULL").select(F.col("doc_id").alias("_drawn_id")).distinct()
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_drawn_id")), "left_semi")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of ``documents`` drawn towards the texts of ``benchmark``; cases as in ``importance_resampling``."""
    return importance_resampling(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_STEP = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
#: Each byte's remainder by eight steps of the polynomial, then one look-up for each byte of a word.
ORACLE_SQL = f"""WITH RECURSIVE bits AS (SELECT CAST(range AS BIGINT) AS b, CAST(range AS BIGINT) AS c, 0 AS k FROM range(256) UNION ALL SELECT b, {_STEP}, k + 1 FROM bits WHERE k < 8),
lookup AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT {_WORDS} AS w FROM benchmark),
f AS (SELECT rid, unnest(w) AS word FROM d), g AS (SELECT unnest(w) AS word FROM b),
v AS (SELECT word, hex(word) AS x FROM (SELECT word FROM f UNION SELECT word FROM g)),
h AS (SELECT word, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, length(x) // 2), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS INT), 2) AS BIGINT))),
  lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket FROM v, lookup),
fb AS (SELECT rid, bucket FROM f JOIN h USING (word)), s AS (SELECT bucket, count(*) AS n FROM fb GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM g JOIN h USING (word) GROUP BY bucket),
a AS (SELECT bucket, floor(1000 * ln(CAST(coalesce(t.n, 0) + 1 AS DOUBLE) * (SELECT count(*) + {BUCKETS} FROM f) / (CAST(s.n + 1 AS DOUBLE) * (SELECT count(*) + {BUCKETS} FROM g)))) AS gain FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT rid, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM fb JOIN a USING (bucket) GROUP BY rid),
z AS (SELECT rid, doc_id, len(d.w) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN w USING (rid)),
y AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM z),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {MIN_WORDS} ORDER BY score DESC, doc_id, n_features, weight) AS k FROM y)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score,
  CASE WHEN n_features >= {MIN_WORDS} AND k <= {PERCENT} * (SELECT count(*) FROM y WHERE n_features >= {MIN_WORDS}) // 100 THEN k END AS rank FROM r"""
