"""Pileup of alignments: bases, insertions and deletions of reads by reference position, and the records made of them.

Alignments have sample, qname, flag, chrom, pos (1-based), mapq, cigar, mate_chrom, mate_pos, seq and qual
(text with an offset of 33). Mates are brought together read by read, in one shuffle and one sort of those reads that
can overlap their mate; from there on everything up to the counts happens on batches of reads as arrays. Tasks add
counts up in blocks of positions before they are shuffled, so that a position of any depth costs one row for each task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allelix.operators import pileup_batches as B
from allelix.operators import reference as R
from allelix.session import stored

#: Flags of a proper pair, of an unmapped mate, of the first read of a pair; unmapped, secondary,
#: failed or repeated reads; the quality of bases without one.
PROPER, MATE_UNMAPPED, FIRST, UNUSED, NO_QUALITY = 0x2, 0x8, 0x40, 0x704, 30
BASES = "ACGT"
#: What batches of reads have, and what mates have in common.
BATCH = ["sample", "chrom", "CAST(pos AS INT) AS pos", "CAST(mapq AS INT) AS mapq", "CAST(flag AS INT) AS flag", "cigar", "seq", "qual"]
MATES = ["sample", "chrom", "_low", "_high", "qname"]


def usable(alignments: DataFrame, min_mapq: int = 0, forbidden: int = UNUSED, required: int = 0) -> DataFrame:
    """Mapped reads with bases that pass the flags and ``min_mapq``, with qualities for all bases; nulls in these columns don't pass."""
    flags = (F.col("flag").bitwiseAND(forbidden) == 0) & (F.col("flag").bitwiseAND(required) == required)
    reads = alignments.where(flags & (F.col("mapq") >= min_mapq) & F.col("pos").isNotNull() & (F.col("pos") > 0) & (F.col("cigar") != "*") & (F.col("seq") != "*"))
    known = F.when(F.col("qual") == "*", "").otherwise(F.coalesce("qual", F.lit("")))
    return reads.withColumns({"seq": F.upper("seq"), "qual": F.rpad(known, F.length("seq"), chr(33 + NO_QUALITY))})


def _mates(reads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reads that no mate can overlap, and the others: mates in one task, in the order of places, keys, fronts and turns.

    Mates are proper pairs on one contig that name each other's positions. Of reads with one name and the same positions, the
    first of those in front go with the first of those behind and so on, in the order of flag, CIGAR, bases and qualities.
    Reads of one sample, one name and the same positions are held together.
    """
    same = F.col("mate_chrom").isin("=") | (F.col("mate_chrom") == F.col("chrom"))
    covered = F.aggregate(F.regexp_extract_all("cigar", F.lit("([0-9]+)[MDN=X]"), F.lit(1)), F.lit(0).cast("long"), lambda s, n: s + n.cast("long"))
    paired = (F.col("flag").bitwiseAND(PROPER) != 0) & (F.col("flag").bitwiseAND(MATE_UNMAPPED) == 0) & same & (F.col("qname") != "*") & ((F.col("mate_pos") <= F.col("pos")) | (F.col("mate_pos") < F.col("pos") + covered))
    known = F.coalesce(paired, F.lit(False))
    behind = F.when(F.col("pos") == F.col("mate_pos"), F.col("flag").bitwiseAND(FIRST) == 0).otherwise(F.col("pos") > F.col("mate_pos"))
    keyed = reads.where(known).withColumn("_behind", behind).selectExpr(*BATCH, "qname", "CAST(least(pos, mate_pos) AS INT) AS _low", "CAST(greatest(pos, mate_pos) AS INT) AS _high", "_behind").repartition(*MATES)
    # one number in front of the key, by which nearly all comparisons of the sort are settled
    place = F.shiftleft(F.hash("sample", "chrom").cast("long"), 32) + F.col("_low")
    return reads.where(~known).selectExpr(*BATCH), keyed.withColumn("_place", place).sortWithinPartitions("_place", *MATES, "_behind", "flag", "cigar", "seq", "qual").drop("_place")


def _by_batches(reads: DataFrame, overlaps: bool, schema: str, work: Callable) -> DataFrame:
    """``work`` on batches of reads, with the key of mates where they may overlap."""
    lone = lambda batches: work(batches, None)
    if not overlaps:
        return reads.selectExpr(*BATCH).mapInArrow(lone, schema)
    alone, met = _mates(reads)
    return alone.mapInArrow(lone, schema).unionByName(met.mapInArrow(lambda batches: work(batches, MATES), schema))


def observations(reads: DataFrame, overlaps: bool = True) -> DataFrame:
    """A row for each base of a usable read that is aligned to a position: sample, chrom, pos, base, q, mapq, reverse, read_at, read_length, clipped.

    With ``overlaps``, two mates over one position count once: equal bases pool their qualities on one of them and leave 0 on the
    other, of unequal ones the better keeps four fifths, as does a base beside a mate's deletion on the mate that keeps. Deletions,
    skipped stretches and clipped or inserted bases make no row. Rows keep qualities of 0; counts choose by quality.
    """
    return _by_batches(reads, overlaps, "sample string, chrom string, pos int, base string, q int, mapq int, reverse boolean, read_at int, read_length int, clipped boolean", B.observed)


def counted(reads: DataFrame, min_q: int = 1, overlaps: bool = True) -> DataFrame:
    """``depths`` of ``observations``, of which no rows are made: tasks add their reads' bases up in blocks of positions."""
    parts = _by_batches(reads, overlaps, ", ".join(["sample string", "chrom string", "pos int", *(f"{c} long" for c in B.COUNTS)]), lambda batches, key: B.counted(batches, key, min_q))
    sums = parts.groupBy("sample", "chrom", "pos").agg(*(F.sum(c).alias(c) for c in B.COUNTS))
    total = sum((F.col(f"_{s}{b}") for b in BASES for s in "fr"), F.lit(0).cast("long"))
    return sums.select("sample", "chrom", "pos", "raw_depth", total.alias("depth"), *_lists(), "mq0", "mapq_sum", "clipped")


def _lists() -> list[Column]:
    return [F.array(*(F.col(f"_{k}{b}") for b in BASES)).alias(n) for k, n in (("f", "adf"), ("r", "adr"), ("q", "qs"))]


def depths(seen: DataFrame, min_q: int = 1) -> DataFrame:
    """For each (sample, chrom, pos): raw_depth (all bases), depth, adf, adr and qs (arrays in the order A, C, G, T), mq0, mapq_sum and clipped.

    Everything but raw_depth counts A, C, G and T of quality ``min_q`` or more. A base adds to qs the lesser of its own and its
    read's quality, between 4 and 63.
    """
    good = F.col("base").isin(*BASES) & (F.col("q") >= min_q)
    weight = F.greatest(F.least("q", F.least("mapq", F.lit(B.MOST_MAPQ)), F.lit(B.MOST_Q)), F.lit(B.LEAST_Q))
    of = lambda b: good & (F.col("base") == b)
    each = {f"_{n}{b}": e(of(b)) for b in BASES for n, e in (("f", lambda c: F.count_if(c & ~F.col("reverse"))), ("r", lambda c: F.count_if(c & F.col("reverse"))), ("q", lambda c: F.sum(F.when(c, weight).otherwise(0))))}
    sums = seen.groupBy("sample", "chrom", "pos").agg(
        F.count("*").alias("raw_depth"), F.count_if(good).alias("depth"), *(c.cast("long").alias(n) for n, c in each.items()), F.count_if(good & (F.col("mapq") == 0)).alias("mq0"),
        F.sum(F.when(good, F.least("mapq", F.lit(B.MOST_MAPQ))).otherwise(0)).cast("long").alias("mapq_sum"), F.count_if(good & F.col("clipped")).alias("clipped"),
    )
    return sums.select("sample", "chrom", "pos", "raw_depth", "depth", *_lists(), "mq0", "mapq_sum", "clipped")


def indels(reads: DataFrame) -> DataFrame:
    """Insertions and deletions of usable reads: sample, chrom, pos (of the base before), inserted, deleted, n and n_forward.

    Only operations right after aligned bases count, so of an insertion and a deletion side by side the first.
    """
    found = reads.where(F.col("cigar").contains("I") | F.col("cigar").contains("D")).select("sample", "chrom", F.col("pos").cast("int").alias("pos"), "flag", "cigar", "seq")
    events = found.mapInArrow(B.events, "sample string, chrom string, pos int, inserted string, deleted int, forward boolean")
    return events.groupBy("sample", "chrom", "pos", "inserted", "deleted").agg(F.count("*").alias("n"), F.count_if("forward").alias("n_forward"))


def indel_records(events: DataFrame, reference: DataFrame, min_reads: int = 1) -> DataFrame:
    """Insertions and deletions as records (chrom, pos, ref, alt) with n, n_forward and ``calls`` (sample, n), where one sample has ``min_reads`` or more."""
    key = ["chrom", "pos", "inserted", "deleted"]
    calls = F.array_sort(F.collect_list(F.struct("sample", "n")))
    # stored, since their places are asked for bases, and they meet these: reads would be gone through for each
    found = stored(events.groupBy(*key).agg(F.sum("n").alias("n"), F.sum("n_forward").alias("n_forward"), F.max("n").alias("_most"), calls.alias("calls")).where(F.col("_most") >= min_reads))
    spans = found.select("chrom", "pos", "deleted", F.col("pos").alias("beg"), (F.col("pos") + F.col("deleted")).alias("end_")).distinct()
    bases = R.with_bases(spans.withColumn("_c", F.col("chrom")), reference, ["_c", "pos", "deleted"], "ref").withColumnRenamed("_c", "chrom")
    return found.join(bases, ["chrom", "pos", "deleted"]).select("chrom", "pos", "ref", F.concat(F.substr("ref", F.lit(1), F.lit(1)), "inserted").alias("alt"), "n", "n_forward", "calls")


def records(counts: DataFrame, reference: DataFrame) -> DataFrame:
    """Records of single bases from ``depths``: chrom, pos, ref, alts, qs, dp, dp4, mq, mq0f and calls (sample, dp, ad, adf, adr).

    A sample's qualities are scaled to a sum of one and added over samples; alleles other than REF come in falling order of that
    sum (ones equal to nine digits: T before G before C before A) and leave out bases not seen. Lists go by REF, then ALTs. Positions without a
    counted base have no record, REF is N where the reference has nothing; dp4 counts forward and reverse bases of REF, then of ALTs.
    """
    total = F.aggregate("qs", F.lit(0.0), lambda s, x: s + x)
    shares = F.transform("qs", lambda x: x / total)
    sample = F.when(F.col("depth") > 0, F.struct("sample", F.col("depth").alias("dp"), "adf", "adr", shares.alias("share")))
    site = counts.groupBy("chrom", "pos").agg(
        F.array_sort(F.collect_list(sample)).alias("_calls"), F.sum("raw_depth").alias("dp"), F.sum("depth").alias("_n"), F.sum("mq0").alias("_mq0"), F.sum("mapq_sum").alias("_mq"),
    )
    based = site.where("_n > 0").join(R.positions(reference), ["chrom", "pos"], "left").withColumn("ref", F.coalesce("base", F.lit("N")))
    added = lambda name, i: F.aggregate("_calls", F.lit(0.0), lambda s, c: s + F.get(c[name], F.lit(i)))
    alleles = F.array(*(F.struct(F.round(added("share", i), 9).alias("by"), F.lit(i).alias("i"), F.lit(b).alias("b"), added("share", i).alias("q")) for i, b in enumerate(BASES)))
    ranked = based.withColumn("_all", alleles)
    others = F.reverse(F.array_sort(F.filter("_all", lambda a: (a["b"] != F.col("ref")) & (a["q"] > 0))))
    own = F.filter("_all", lambda a: a["b"] == F.col("ref"))
    none = F.array(F.struct(F.lit(0.0).alias("by"), F.lit(-1).alias("i"), F.lit("N").alias("b"), F.lit(0.0).alias("q")))
    listed = ranked.withColumn("_order", F.concat(F.when(F.size(own) > 0, own).otherwise(none), others))
    pick = lambda c: F.transform("_order", lambda a: F.when(a["i"] < 0, F.lit(0).cast("long")).otherwise(F.get(c, F.greatest(a["i"], F.lit(0)))))

    def call(c: Column) -> Column:
        f, r = pick(c["adf"]), pick(c["adr"])
        return F.struct(c["sample"].alias("sample"), c["dp"].alias("dp"), F.zip_with(f, r, lambda x, y: x + y).alias("ad"), f.alias("adf"), r.alias("adr"))

    called = listed.withColumn("calls", F.transform("_calls", call))
    sums = lambda name, first: F.aggregate(
        "calls", F.lit(0).cast("long"), lambda s, c: s + (F.get(c[name], F.lit(0)) if first else F.aggregate(F.slice(c[name], F.lit(2), F.size(c[name])), F.lit(0).cast("long"), lambda t, x: t + x))
    )
    return called.select(
        "chrom", "pos", "ref", F.transform(F.slice("_order", F.lit(2), F.size("_order")), lambda a: a["b"]).alias("alts"), F.transform("_order", lambda a: a["q"]).alias("qs"), "dp",
        F.array(sums("adf", True), sums("adr", True), sums("adf", False), sums("adr", False)).alias("dp4"), (F.col("_mq") / F.col("_n")).alias("mq"), (F.col("_mq0") / F.col("_n")).alias("mq0f"), "calls",
    )
