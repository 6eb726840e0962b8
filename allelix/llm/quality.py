"""Quality rules whose thresholds follow the corpus.

Each metric of a text is a whole number. Per language and source its distribution is held in a
mergeable log-linear quantile sketch (counts of buckets with a relative width of 1/64), so that
sketches of sources add up to those of a language and those of languages to one of all. A text is
kept if none of its metrics lies further than ``FENCE`` spreads outside the middle half of its group.
DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from allelix.llm.blocks import stored
from allelix.llm.common import table
from allelix.session import cut

WORD_GAP = "[\\x20\\x09-\\x0D]+"
WHITE = " \t\n\u000b\f\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
FENCE = 4
#: A sketch of fewer texts gives way to that of the language, then to that of all.
MIN_GROUP = 30
BROADCAST_ROWS = 20_000
#: Metric: the least spread that counts, and whether low values are outliers too.
METRICS = {
    "symbol_permille": (10, False),
    "word_length_percent": (20, True),
    "dup_line_permille": (100, False),
    "repeat_permille": (50, False),
}
#: Positions that fit beside 40 bits of a window's hash.
_POSITION_BITS = 24


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _neighbours(items: Column, same) -> Column:
    """Items of a sorted array that are the same as the one before or after."""
    return F.filter(items, lambda x, j: ((j > 0) & same(x, F.get(items, j - 1))) | F.coalesce(same(x, F.get(items, j + 1)), F.lit(False)))


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows found twice or more in the text, the first ones included.

    Windows are sorted as 40 bits of their hash and their position, which leaves few candidates;
    those are compared as strings. Longer texts than positions fit are compared as strings at once.
    """

    def window(w: Column, i: Column) -> Column:
        return F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))

    def candidates(w: Column) -> Column:
        high = F.lit(-(1 << _POSITION_BITS)).cast("long")
        low = F.lit((1 << _POSITION_BITS) - 1).cast("long")
        keys = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(high).bitwiseOR(i.cast("long"))))
        near = _let(keys, lambda k: _neighbours(k, lambda a, b: a.bitwiseXOR(b).bitwiseAND(high) == 0))
        return F.when(F.size(w) < 1 << _POSITION_BITS, F.transform(near, lambda k: k.bitwiseAND(low).cast("int"))).otherwise(F.sequence(F.lit(0), F.size(w) - 3))

    def covered(w: Column) -> Column:
        named = F.array_sort(F.transform(candidates(w), lambda i: F.struct(window(w, i).alias("s"), i.alias("i"))))
        repeated = _let(named, lambda n: F.sort_array(F.transform(_neighbours(n, lambda a, b: a["s"] == b["s"]), lambda x: x["i"])))
        return _let(repeated, lambda p: F.aggregate(F.transform(p, lambda i, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - i, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x))

    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(covered(words))


def with_metrics(docs: DataFrame) -> DataFrame:
    """``docs`` with a struct column ``q`` of base figures, failure and metrics.

    A null text has no words. Columns of ``docs`` named like parts of ``q`` do no harm.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.trim(x, F.lit(WHITE))) > 0)
    with_words = docs.withColumn("q", F.struct(F.array_remove(F.split(text, WORD_GAP, -1), "").alias("w"), lines.alias("l")))
    w, ls = F.col("q.w"), F.col("q.l")
    base = with_words.withColumn(
        "q",
        F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            F.size(ls).cast("long").alias("n_lines"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
            repeat_words(w).alias("n_repeat_words"),
        ),
    )
    n, chars = F.greatest(F.col("q.n_words"), F.lit(1)), F.greatest(F.col("q.word_chars"), F.lit(1))
    per = lambda part, whole, scale: F.floor(F.col(f"q.{part}") * scale / whole).cast("long")
    return base.withColumn(
        "q",
        F.struct(
            "q.*",
            ((F.col("q.n_words") < MIN_WORDS) | (F.col("q.n_repeat_words") * 100 > F.col("q.n_words") * MAX_REPEAT_PERCENT)).alias("base_failed"),
            per("n_symbols", chars, 1000).alias("symbol_permille"),
            per("word_chars", n, 100).alias("word_length_percent"),
            per("n_dup_lines", F.greatest(F.col("q.n_lines"), F.lit(1)), 1000).alias("dup_line_permille"),
            per("n_repeat_words", n, 1000).alias("repeat_permille"),
        ),
    )


def bucket(value: Column) -> Column:
    """The sketch's bucket of a whole number: exact under 128, then 64 to each doubling."""
    shift = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    return shift * 64 + F.floor(value / F.pow(F.lit(2.0), shift)).cast("int")


def bucket_start(index: Column) -> Column:
    shift = F.greatest(F.floor(index / 64).cast("int") - 1, F.lit(0))
    return ((index - shift * 64) * F.pow(F.lit(2.0), shift)).cast("long")


def sketches(measured: DataFrame) -> DataFrame:
    """Counts by (lang, source, metric, bucket) of the texts that pass the base rules."""
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), bucket(F.col(f"q.{m}")).alias("bucket")) for m in METRICS))
    return measured.where(~F.col("q.base_failed")).select("lang", "source", F.inline(pairs)).groupBy("lang", "source", "metric", "bucket").agg(F.count("*").alias("n"))


def fences(sketch: DataFrame) -> DataFrame:
    """One row of bounds for each (lang, source) of ``sketch``, by the finest level with enough texts."""
    own = sketch.groupBy("lang", "source", "metric", "bucket").agg(F.sum("n").alias("n"))
    levels = []
    for level, keys in enumerate((["lang", "source"], ["lang"], [])):
        merged = own.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
        over = Window.partitionBy(*keys, "metric")
        ranked = merged.select(*keys, "metric", "bucket", F.sum("n").over(over).alias("all_n"), F.sum("n").over(over.orderBy("bucket")).alias("upto"))
        quartiles = ranked.groupBy(*keys, "metric").agg(
            F.first("all_n").alias("n"),
            bucket_start(F.min(F.when(F.col("upto") * 4 >= F.col("all_n"), F.col("bucket")))).alias("q1"),
            bucket_start(F.min(F.when(F.col("upto") * 4 >= F.col("all_n") * 3, F.col("bucket")))).alias("q3"),
        )
        aggs = []
        for m, (least, both) in METRICS.items():
            of = lambda c, m=m: F.max(F.when(F.col("metric") == m, F.col(c)))
            spread = F.greatest(of("q3") - of("q1"), F.lit(least)) * FENCE
            aggs.append((of("q3") + spread).alias(f"high_{m}"))
            if both:
                aggs.append((of("q1") - spread).alias(f"low_{m}"))
        wide = quartiles.groupBy(*keys).agg(F.max("n").alias("n"), *aggs)
        levels.append(wide.select(*(F.col(k).alias(f"k{level}_{k}") for k in keys), F.struct("n", *(c for c in wide.columns if c[:4] in ("high", "low_"))).alias(f"b{level}")))
    found = own.select("lang", "source").distinct()
    found = found.join(levels[0], F.col("lang").eqNullSafe(F.col("k0_lang")) & F.col("source").eqNullSafe(F.col("k0_source")), "left")
    found = found.join(levels[1], F.col("lang").eqNullSafe(F.col("k1_lang")), "left")
    found = found.join(F.broadcast(levels[2]), F.lit(True), "left")  # one row
    enough = F.when(F.col("b0.n") >= MIN_GROUP, F.col("b0")).when(F.col("b1.n") >= MIN_GROUP, F.col("b1")).otherwise(F.col("b2"))
    return found.select(F.col("lang").alias("fence_lang"), F.col("source").alias("fence_source"), enough.alias("fence"))


def judge(measured: DataFrame, bounds: DataFrame) -> DataFrame:
    """``measured`` with ``kept``; a group without bounds holds no text that passes the base rules."""
    inside = F.lit(True)
    for m, (_, both) in METRICS.items():
        inside &= F.col(f"q.{m}") <= F.col(f"fence.high_{m}")
        if both:
            inside &= F.col(f"q.{m}") >= F.col(f"fence.low_{m}")
    # a row for each language and source; beyond the checked size the join deals by key instead
    bounds = F.broadcast(bounds) if bounds.count() <= BROADCAST_ROWS else bounds
    joined = measured.join(bounds, F.col("lang").eqNullSafe(F.col("fence_lang")) & F.col("source").eqNullSafe(F.col("fence_source")), "left")
    return joined.withColumn("kept", ~F.col("q.base_failed") & F.coalesce(inside, F.lit(False))).drop("fence_lang", "fence_source", "fence")


def quality_rules(docs: DataFrame) -> DataFrame:
    """Base figures and the verdict of every text, one row per row of ``docs``.

    Null and empty texts have no words and fail; null languages and sources are groups of their own;
    repeated rows are judged each; other columns are not read; an empty table gives no rows.
    """
    measured = cut(with_metrics(docs.select("doc_id", "lang", "source", "text")).select("doc_id", "lang", "source", "q"))
    judged = judge(measured, cut(fences(cut(sketches(measured)))))
    return judged.select("doc_id", "q.n_words", "q.word_chars", "q.n_symbols", "q.n_dup_lines", "q.n_repeat_words", "q.base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that the quality rules keep."""
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), "lang", "source", "text")
    # measured once: the figures are stored beside the rows, for the sketches and then for the verdict
    measured = stored(with_metrics(held).select("doc", "lang", "source", "q"))
    bounds = cut(fences(cut(sketches(measured))))
    return judge(measured, bounds).where("kept").select("doc.*")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures and verdicts of all ``documents``; cases as in ``quality_rules``."""
    return quality_rules(table(spark, sf_dir, "documents"))


_METRIC_ROWS = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {m} AS v FROM measured WHERE NOT base_failed" for m in METRICS)
_LEVELS = {0: "lang, source, ", 1: "lang, ", 2: ""}
_SHIFT = "greatest(length(bin(v)) - 7, 0)"


def _level_sql(level: int) -> str:
    keys = _LEVELS[level]
    bounds = []
    for m, (least, both) in METRICS.items():
        q1, q3 = (f"max(CASE WHEN metric = '{m}' THEN {q} END)" for q in ("q1", "q3"))
        bounds.append(f"{q3} + {FENCE} * greatest({q3} - {q1}, {least}) AS high_{m}")
        if both:
            bounds.append(f"{q1} - {FENCE} * greatest({q3} - {q1}, {least}) AS low_{m}")
    start = "(min(b) FILTER ({}) - 64 * greatest(min(b) FILTER ({}) // 64 - 1, 0)) * (1 << greatest(min(b) FILTER ({}) // 64 - 1, 0)::INT)"
    q1, q3 = (start.replace("{}", f"upto * 4 >= all_n * {k}") for k in (1, 3))
    group = f"GROUP BY {keys[:-2]}" if keys else ""
    return f"""m{level} AS (SELECT {keys}metric, b, sum(n) AS n FROM sketch GROUP BY {keys}metric, b),
r{level} AS (SELECT {keys}metric, b, sum(n) OVER (PARTITION BY {keys}metric) AS all_n, sum(n) OVER (PARTITION BY {keys}metric ORDER BY b) AS upto FROM m{level}),
t{level} AS (SELECT {keys}metric, max(all_n) AS n, {q1} AS q1, {q3} AS q3 FROM r{level} GROUP BY {keys}metric),
f{level} AS (SELECT {keys}max(n) AS n, {", ".join(bounds)} FROM t{level} {group})"""


_BOUNDS = [f"{side}_{m}" for m, (_, both) in METRICS.items() for side in (("high", "low") if both else ("high",))]
_INSIDE = " AND ".join(f"q.{b.split('_', 1)[1]} {'<=' if b[0] == 'h' else '>='} CASE WHEN f0.n >= {MIN_GROUP} THEN f0.{b} WHEN f1.n >= {MIN_GROUP} THEN f1.{b} ELSE f2.{b} END" for b in _BOUNDS)

#: The common table expressions that judge a table ``source_docs`` (doc_id, text, lang, source).
JUDGED_SQL = rf"""tokens AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text,
  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM source_docs),
windows AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, w FROM tokens WHERE len(w) >= 3),
named AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM windows),
repeated AS (SELECT rid, i FROM named QUALIFY count(*) OVER (PARTITION BY rid, s) > 1),
covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM repeated) GROUP BY rid),
based AS (SELECT t.rid, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(translate(text, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols, len(ls) AS n_lines,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words FROM tokens t LEFT JOIN covered c ON t.rid = c.rid),
measured AS (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed,
  n_symbols * 1000 // greatest(word_chars, 1) AS symbol_permille, word_chars * 100 // greatest(n_words, 1) AS word_length_percent,
  n_dup_lines * 1000 // greatest(n_lines, 1) AS dup_line_permille, n_repeat_words * 1000 // greatest(n_words, 1) AS repeat_permille FROM based),
sketch AS (SELECT lang, source, metric, 64 * {_SHIFT} + (v >> {_SHIFT}::INT) AS b, count(*) AS n FROM ({_METRIC_ROWS}) GROUP BY ALL),
{_level_sql(0)},
{_level_sql(1)},
{_level_sql(2)},
judged AS (SELECT q.*, (NOT base_failed AND coalesce({_INSIDE}, false)) AS kept FROM measured q
  LEFT JOIN f0 ON q.lang IS NOT DISTINCT FROM f0.lang AND q.source IS NOT DISTINCT FROM f0.source
  LEFT JOIN f1 ON q.lang IS NOT DISTINCT FROM f1.lang LEFT JOIN f2 ON true)"""

ORACLE_SQL = f"""WITH source_docs AS (SELECT doc_id, text, lang, source FROM documents), {JUDGED_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"""
