"""Left alignment over repeats of any length, and REF checked against the reference.

With R the reference before a record, its alleles can be moved left as far as the strings R + REF and
R + ALT of all ALTs end alike. The length of their common ending is found by halving, in a window of the
reference before the record. Only records whose ending fills its window go on to the next round, from
where they have come to and with a window eight times as long: the number of rounds grows with the logarithm
of the longest repeat, and the bases that are read with its length.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allelix.functions import variants as V
from allelix.operators.reference import with_bases
from allelix.session import cut, once

#: Bases before a record that the first round looks at, and how much longer the window is in each round after it.
WINDOW, GROWTH, WIDEST = 256, 8, 1 << 20


def _right(text: Column, n: Column) -> Column:
    return F.substr(text, F.length(text) - n + 1, n)


def _longest(fits, limit: Column, bits: int) -> Column:
    """The largest n up to ``limit`` for which ``fits(n)``; it fits for all smaller ones too."""
    steps = F.array(*(F.lit(1 << b) for b in reversed(range(bits))))
    return F.aggregate(steps, F.lit(0), lambda s, x: F.when((s + x <= limit) & fits(s + x), s + x).otherwise(s))


def _moved(rows: DataFrame, bits: int) -> DataFrame:
    """One round: ``_alleles`` (REF first) at ``_at``, moved inside the known bases ``_before``; ``_open`` if they may go further."""
    told = F.transform("_alleles", lambda a: F.concat(F.col("_before"), a))
    rows = rows.withColumn("_t", told).withColumn("_least", F.array_min(F.transform("_alleles", F.length)))
    # endings are compared as bytes, of which none before the ending is looked at
    rows = rows.withColumn("_raw", F.transform("_t", lambda t: t.cast("binary")))
    alike = lambda n: F.forall("_raw", lambda t: _right(t, n) == _right(F.get("_raw", F.lit(0)), n))
    width = F.length("_before")
    rows = rows.withColumn("_k", _longest(alike, width + F.col("_least") - 1, bits))
    by = F.greatest(F.col("_k") - F.col("_least") + 1, F.lit(0))
    rows = rows.withColumn("_by", by).withColumn("_alleles", F.transform("_t", lambda t: F.substr(t, width - F.col("_by") + 1, F.length(t) - F.col("_k") - width + F.col("_by"))))
    rows = rows.withColumn("_at", (F.col("_at") - F.col("_by")).cast("int"))
    ends = F.transform("_alleles", lambda a: _right(a, F.lit(1)))
    alone = F.array_min(F.transform("_alleles", F.length)) == 1
    return rows.withColumn("_open", alone & (F.col("_at") > 1) & (F.size(F.array_distinct(ends)) == 1)).drop("_t", "_raw", "_least", "_k", "_by", "_before")


def left_align(records: DataFrame, reference: DataFrame, key: list[str], window: int = WINDOW) -> DataFrame:
    """``records`` with pos, ref and alts (or alt, joined by commas) at the leftmost of their equal places, and shared ends taken off.

    ``reference`` has chrom, first and bases (see ``reference``). All alleles of a record move together. Records of equal place and alleles
    are worked out once, and the bases before a place are fetched once, however many records it has; so ``key``, the columns
    that tell records apart, plays no part in it. Records
    with a symbol, a star or no ALT, an empty allele, an ALT equal to REF, or a null stay as they are; nothing moves over an N
    of the reference or a base that it doesn't have. Alleles come back in upper case.
    """
    records = once(records)
    own = ["chrom", "pos", "ref", "alts" if "alts" in records.columns else "alt"]
    named = {c: f"_key_{i}" for i, c in enumerate(own)}
    alts = F.col(named["alts"]) if "alts" in named else F.split(named["alt"], ",")
    rows = records.select(*(F.col(c).alias(n) for c, n in named.items())).distinct()
    rows = rows.select("*", F.col(named["chrom"]).alias("chrom"), F.col(named["pos"]).cast("int").alias("_at"), F.transform(F.concat(F.array(named["ref"]), alts), F.upper).alias("_alleles"))
    sound = F.forall("_alleles", lambda a: a.rlike("^[ACGTN]+$")) & (F.size("_alleles") > 1) & F.forall(F.slice("_alleles", 2, F.size("_alleles")), lambda a: a != F.get("_alleles", F.lit(0)))
    narrow = rows.where(sound & F.col("_at").isNotNull() & F.col("chrom").isNotNull())
    # stored before it is filtered: a filter that is pushed below a round would work the round out again for each name in it
    now = cut(_moved(narrow.withColumn("_before", F.lit("")), 24))
    done, active = now.where("NOT _open").drop("_open"), now.where("_open").drop("_open")
    while active.count():
        asked = active.select(F.col("chrom").alias("_c"), F.col("_at").alias("_p")).distinct()
        asked = asked.withColumns({"chrom": F.col("_c"), "beg": F.greatest(F.col("_p") - window, F.lit(1)), "end_": F.col("_p") - 1})
        known = with_bases(asked, reference, ["_c", "_p"], "_before").withColumn("_before", F.substring_index("_before", "N", -1))
        met = active.join(known, (F.col("chrom") == F.col("_c")) & (F.col("_at") == F.col("_p"))).drop("_c", "_p")
        now = cut(_moved(met.withColumn("_was", F.col("_at")), max(24, window.bit_length() + 1)))
        # where an N or the end of the reference stands before a record it goes no further
        further = F.col("_open") & (F.col("_at") < F.col("_was"))
        done = done.unionByName(now.where(~further).drop("_open", "_was"))
        active = now.where(further).drop("_open", "_was")
        window = min(window * GROWTH, WIDEST)
    # a shared beginning goes too, as long as each allele keeps a base
    least = F.array_min(F.transform("_alleles", F.length)) - 1
    begins = lambda n: F.forall("_alleles", lambda a: F.substr(a, F.lit(1), n) == F.substr(F.get("_alleles", F.lit(0)), F.lit(1), n))
    done = done.withColumn("_head", _longest(begins, least, 24))
    placed = done.select(*named.values(), (F.col("_at") + F.col("_head")).cast("int").alias("_pos"), F.transform("_alleles", lambda a: F.substr(a, F.col("_head") + 1, F.length(a))).alias("_new"))
    same = reduce(and_, (F.col(c) == F.col(n) for c, n in named.items()))
    joined = records.join(placed, same, "left")
    others = F.slice("_new", 2, F.size("_new"))
    out = {"pos": F.coalesce("_pos", F.col("pos")), "ref": F.coalesce(F.get("_new", F.lit(0)), F.col("ref"))}
    if "alts" in records.columns:
        out["alts"] = F.when(F.col("_new").isNotNull(), others).otherwise(F.col("alts"))
    if "alt" in records.columns:
        out["alt"] = F.when(F.col("_new").isNotNull(), F.array_join(others, ",")).otherwise(F.col("alt"))
    return joined.withColumns(out).select(*records.columns)


def check_ref(records: DataFrame, reference: DataFrame, key: list[str], mode: str = "warn", numbers: dict[str, str] | None = None) -> DataFrame:
    """Records whose REF is not what the reference holds: ``exit`` raises an error, ``warn`` adds ``ref_ok``, ``exclude`` drops them, ``set`` mends them.

    Mending puts the reference's bases as REF. Where an ALT has them, REF and that ALT change places, and alleles in ``gt``
    and the fields of ``numbers`` (``A``, ``R`` or ``G``) with them. REF that is a symbol, and an N before a symbolic ALT, are not
    checked. Where the reference has no base, a record is a mismatch that ``set`` leaves as it is. Records have ``alts``; ``calls`` may be there.
    """
    if mode not in ("exit", "warn", "exclude", "set"):
        raise ValueError(f"no such mode: {mode!r}")
    named = {c: f"_key_{i}" for i, c in enumerate(key)}
    asked = records.select(*key, "chrom", F.col("pos").alias("beg"), (F.col("pos") + F.length("ref") - 1).alias("end_"))
    known = with_bases(asked.where(~F.col("ref").startswith("<")) if "ref" in key else asked, reference, key, "_fasta").withColumnsRenamed(named)
    same = None
    for c, n in named.items():
        one = F.col(c).eqNullSafe(F.col(n))
        same = one if same is None else same & one
    rows = records.join(known, same, "left").drop(*named.values())
    exempt = F.col("ref").startswith("<") | ((F.upper("ref") == "N") & F.coalesce(F.get("alts", F.lit(0)).startswith("<"), F.lit(False)))
    ok = F.coalesce(exempt | (F.upper("ref") == F.col("_fasta")), F.lit(False))
    if mode == "warn":
        return rows.withColumn("ref_ok", ok).select(*records.columns, "ref_ok")
    if mode == "exclude":
        return rows.where(ok).select(*records.columns)
    if mode == "exit":
        text = F.concat(F.lit("REF differs from the reference at "), F.col("chrom"), F.lit(":"), F.col("pos").cast("string"), F.lit(": "), "ref", F.lit(" and "), F.coalesce("_fasta", F.lit("nothing")))
        return rows.withColumn("ref", F.when(ok, F.col("ref")).otherwise(F.raise_error(text).cast("string"))).select(*records.columns)
    mends = ~ok & F.coalesce(~F.col("_fasta").contains("N"), F.lit(False))
    place = F.when(mends & F.array_contains(F.transform("alts", F.upper), F.col("_fasta")), F.array_position(F.transform("alts", F.upper), F.col("_fasta")).cast("int")).otherwise(0)
    rows = rows.withColumns({"_mends": mends, "_swap": place})
    rows = rows.withColumn("_swapped", F.transform("alts", lambda a, i: F.when(i + 1 == F.col("_swap"), F.col("ref")).otherwise(a)))
    swapped = F.col("_swapped")
    out = {"alts": swapped, "ref": F.when(F.col("_mends"), F.col("_fasta")).otherwise(F.col("ref"))}
    if "alt" in records.columns:
        out["alt"] = F.when(F.col("_swap") > 0, F.array_join(swapped, ",")).otherwise(F.col("alt"))
    if "calls" in records.columns:
        out["calls"] = F.when(F.col("_swap") > 0, F.transform("calls", lambda c: _exchanged(c, numbers or {}))).otherwise(F.col("calls"))
    return rows.withColumns(out).select(*records.columns)


def _exchanged(call: Column, numbers: dict[str, str]) -> Column:
    swap = F.col("_swap")
    turn = lambda i: F.when(i == 0, swap).when(i == swap, 0).otherwise(i)
    parts = F.transform(F.split(call["gt"], "[/|]"), lambda a: F.when(a == ".", a).otherwise(turn(a.cast("int")).cast("string")))
    out = call.withField("gt", F.when(call["gt"].contains("|"), F.array_join(parts, "|")).otherwise(F.array_join(parts, "/")))
    every = F.transform(F.sequence(F.lit(0), F.size("alts")), turn)
    for name, kind in numbers.items():
        values = call[name]
        # a value for each ALT has none for REF: what was said of the ALT that is now REF is lost
        kept = F.transform(F.slice(every, 2, F.size("alts")), lambda i: F.when(i > 0, i - 1)) if kind == "A" else every
        out = out.withField(name, F.when(values.isNotNull(), V.gather_genotypes(values, kept) if kind == "G" else V.gather(values, kept)))
    return out
