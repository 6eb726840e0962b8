"""Removal of lines that many documents share.

A line's key is the line without white space at its ends and with A-Z lower-cased. Keys are exploded
as two 64-bit hashes with the document's id; distinct documents are counted for each key, and lines of
keys over the threshold go, except in the document of the largest id that holds the key. What stays is
put together again by position. DataFrame operations only; texts are never exploded, so that a line
which a third of all documents hold costs its hash and position for each of them, and counting it is
pre-aggregated by (key, document) and then by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from allelix.llm.blocks import stored
from allelix.llm.common import table

WHITE = " \t\n\u000b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS = 20
MIN_DOCUMENTS = 3


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keyed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(id, row, h1, h2, at): the hashed keys of at least ``min_chars`` code points and their positions, from 0.

    ``row`` is a hash of the text: rows that are equal in id and text have the same positions to lose.
    """
    lowered = F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER)
    keys = F.transform(F.split(lowered, "\n", -1), lambda x: F.trim(x, F.lit(WHITE)))
    hashed = F.transform(keys, lambda x, i: F.when(F.length(x) >= min_chars, F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(1), x).alias("h2"), i.alias("at"))))
    long_ones = F.filter(hashed, lambda x: x.isNotNull())
    return docs.select(F.col("doc_id").alias("id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("row"), F.inline(long_ones))


def shared_keys(keyed: DataFrame, min_documents: int) -> DataFrame:
    """(k1, k2, last): keys that at least ``min_documents`` distinct ids hold, and the largest of these."""
    pairs = keyed.groupBy("h1", "h2", "id").agg(F.lit(1).alias("one"))
    counted = pairs.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("id").alias("last"))
    return counted.where(F.col("n") >= min_documents).select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), "last")


def drop_shared_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``doc_id``, ``lines`` (all lines), ``dropped`` (sorted positions, from 0) and ``kept`` (the text that stays), a row for each row of ``docs``.

    A null or empty text is one empty line and stays empty. Rows of one id, a null id included, are one
    document: they count once, a null id is the smallest, and each of them loses or keeps a key's lines alike.
    Within the document that keeps a key all its lines stay. Texts are read whole, other columns not at all;
    an empty table gives no rows. Keys are compared by 128 bits of hash.
    """
    docs = docs.select("doc_id", "text")
    keyed = keyed_lines(docs, min_chars)
    # stored, so that its size is known: a small one is broadcast by Spark, else both sides are dealt anew and a hot key's lines can be split
    shared = stored(shared_keys(keyed, min_documents))
    lost = keyed.join(shared, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2"))).where(~F.col("id").eqNullSafe(F.col("last")))
    # equal rows name the same positions: a set, which is made before rows are shuffled too
    drops = lost.groupBy("id", "row").agg(F.sort_array(F.collect_set("at")).alias("dropped"))
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("_row", F.xxhash64("text"))
    joined = rows.join(drops, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("_row") == F.col("row")), "left")
    placed = joined.select("doc_id", "text", _lines(F.col("text")).alias("lines"), F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))
    stays = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped")), lambda i: F.get("lines", i))
    return placed.select("doc_id", "lines", "dropped", F.when(F.size("dropped") == 0, F.col("text")).otherwise(F.array_join(stays, "\n")).alias("kept"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, dropped lines and the hash of what stays of every document; cases as in ``drop_shared_lines``."""
    done = drop_shared_lines(table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("dropped").cast("long").alias("n_dropped"), F.sha2("kept", 256).alias("kept_sha256")
    )


ORACLE_SQL = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
s AS (SELECT key, max(doc_id) AS last FROM (SELECT DISTINCT key, doc_id FROM k WHERE length(key) >= {MIN_CHARS}) GROUP BY key HAVING count(*) >= {MIN_DOCUMENTS}),
m AS (SELECT k.*, (s.key IS NOT NULL AND doc_id IS DISTINCT FROM s.last) AS gone FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count_if(gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid, doc_id"""
