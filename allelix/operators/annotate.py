"""Annotation joins and the rules by which found values meet held ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allelix.functions.variants import trimmed
from allelix.operators import intervals
from allelix.session import stored

ALLELES = ["chrom", "pos", "ref", "alt"]


def only_missing(held: Column, found: Column) -> Column:
    return F.when(held.isNull() | (held == "."), found).otherwise(held)


def only_present(held: Column, found: Column) -> Column:
    return F.when(held.isNull() | (held == "."), held).otherwise(F.coalesce(found, held))


def replaced(held: Column, found: Column) -> Column:
    return F.coalesce(found, held)


def appended(held: Column, found: Column) -> Column:
    return F.when(found.isNull(), held).when(held.isNull() | (held == "."), found).otherwise(F.array_join(F.array_distinct(F.concat(F.split(held, ";"), F.split(found, ";"))), ";"))


def exact(records: DataFrame, source: DataFrame, columns: list[str], order: list[str], keys: list[str] = ALLELES) -> DataFrame:
    """Left join by alleles; of several source rows the first by ``order`` counts."""
    first = source.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_found"))
    return records.join(first, keys, "left").select(*records.columns, *(F.col(f"_found.{c}").alias(c) for c in columns))


def canonical(records: DataFrame, source: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """As ``exact``, after common ends of REF and ALT are taken off on both sides; one ALT each."""
    keyed = lambda df: df.withColumn("_t", trimmed(F.col("pos"), F.col("ref"), F.col("alt")))
    left = keyed(records).select(*records.columns, F.struct("chrom", "_t.pos", "_t.ref", "_t.alt").alias("_key"))
    right = keyed(source).select(F.struct("chrom", "_t.pos", "_t.ref", "_t.alt").alias("_key"), *columns, *(c for c in order if c not in columns))
    return exact(left, right, columns, order, ["_key"]).select(*records.columns, *columns)


def by_region(records: DataFrame, regions: DataFrame, key: list[str]) -> DataFrame:
    """``records`` with the first begin of the regions that they overlap, null for none."""
    hits = intervals.overlap(records, regions, how="inner").groupBy(*key).agg(F.min("region_beg").alias("region_beg"))
    return records.join(hits, key, "left")


def _common_start(a: Column, b: Column) -> Column:
    """The longest common start of two texts without ``|``."""
    return F.regexp_extract(F.concat(a, F.lit("|"), b), "^([^|]*)[^|]*\\|\\1", 1)


def _ending(ref: Column, alt: Column) -> Column:
    return F.reverse(_common_start(F.reverse(ref), F.reverse(alt)))


def _without_end(text: Column, n: Column) -> Column:
    return F.substr(text, F.lit(1), F.length(text) - n)


def _forms(df: DataFrame) -> DataFrame:
    """Adds ``_plain`` (bases on both sides), ``_end`` (what REF and ALT end with in common), ``_short`` (both without it) and ``_core`` (pos, ref, alt without common starts too)."""
    ref, alt = F.upper("ref"), F.upper("_alt")
    plain = ref.rlike("^[A-Z]+$") & alt.rlike("^[A-Z]+$") & F.col("pos").isNotNull()
    ended = df.withColumns({"_plain": F.coalesce(plain, F.lit(False)), "_end": F.when(plain, _ending(ref, alt))})
    n = F.length("_end")
    short = ended.withColumn("_short", F.when(F.col("_plain"), F.struct(_without_end(ref, n).alias("ref"), _without_end(alt, n).alias("alt"))))
    head = F.length(_common_start(F.col("_short.ref"), F.col("_short.alt")))
    core = F.struct((F.col("pos") + head).cast("int").alias("pos"), F.substr("_short.ref", head + 1, F.length("_short.ref")).alias("ref"), F.substr("_short.alt", head + 1, F.length("_short.alt")).alias("alt"))
    return short.withColumn("_core", F.when(F.col("_plain"), core))


def tolerant(records: DataFrame, source: DataFrame, columns: list[str], order: list[str], per_allele: tuple[str, ...] = (), end: str | None = None) -> DataFrame:
    """``records`` with ``columns`` of the matching source row, ``matched`` (1, 2, 3, null without a match) and ``allele`` (its ALT's number from 0).

    Both have chrom, pos, ref and alt, sources with one ALT or several by commas. In falling precedence a row matches (1) by REF and by
    ALT, which may be one of the source's or its whole list, or by REF alone where the record's ALT is ``.``; (2) by alleles that
    differ by the same bases at their ends, in any case of letters; (3) by what is left of REF and ALT without common ends and starts,
    wherever they begin. In each, the first by ``order`` counts. ``per_allele`` columns are arrays of which the matched ALT's value is
    taken, null without one. With ``end``, a symbolic ALT whose record has a value there needs the same value in the source.

    Source rows are brought down to one for each way of writing, and then for each key, before they are joined, and records written
    alike ask once, so that neither side's hot keys make pairs; each step is an equi-join, and records themselves are joined once. Null REF, ALT or position match nothing.
    """
    ends = F.col(end).cast("int") if end else F.lit(None).cast("int")
    found = F.struct(*columns)
    # rows written alike differ in nothing but their order: the first of them is all that any step can take
    written = source.select("chrom", "pos", "ref", ends.alias("_at"), F.col("alt").alias("_list"), F.struct(*order).alias("_o"), found.alias("_v"))
    rows = stored(written.groupBy("chrom", "pos", "ref", "_at", "_list").agg(F.min_by("_v", "_o").alias("_v"), F.min("_o").alias("_o"))).withColumn("_alts", F.split("_list", ","))
    each = rows.select("*", F.posexplode("_alts").alias("_i", "_alt"))
    picked = F.struct(*((F.get(F.col(f"_v.{c}"), F.col("_i")) if c in per_allele else F.col(f"_v.{c}")).alias(c) for c in columns), F.col("_i").alias("allele"))
    whole = F.struct(*((F.get(F.col(f"_v.{c}"), F.lit(-1)) if c in per_allele else F.col(f"_v.{c}")).alias(c) for c in columns), F.lit(None).cast("int").alias("allele"))
    value, rank = F.struct(F.col("_o"), F.col("_i")), lambda i: F.struct(F.col("_o"), F.lit(i).alias("_i"))
    plain_key = ["chrom", "pos", "ref"]
    by_allele = each.select(*plain_key, "_alt", F.lit(-1).alias("_at"), value.alias("_r"), picked.alias("_f"))
    exact_rows = by_allele.unionByName(rows.select(*plain_key, F.explode(F.array(F.lit("."), F.when(F.size("_alts") > 1, F.col("_list")))).alias("_alt"), F.lit(-1).alias("_at"), rank(-1).alias("_r"), whole.alias("_f")))
    if end:
        exact_rows = exact_rows.unionByName(each.where(F.col("_alt").startswith("<")).where("_at IS NOT NULL").select(*plain_key, "_alt", "_at", value.alias("_r"), picked.alias("_f")))
    first = exact_rows.where("_alt IS NOT NULL").groupBy(*plain_key, "_alt", "_at").agg(F.min_by("_f", "_r").alias("_1"))
    # records written alike ask once
    keys = [*plain_key, "_alt", "_at"]
    told_at = F.coalesce(F.when(F.col("alt").startswith("<"), ends), F.lit(-1))
    asked = stored(records.select(*plain_key, F.col("alt").alias("_alt"), told_at.alias("_at")).distinct())
    step = _forms(asked.join(first, keys, "left"))
    forms = _forms(each.select(*plain_key, "_alt", value.alias("_r"), picked.alias("_f"))).where("_plain")
    # suffixes of one event at one position: distinct ones on both sides are compared, then joined back
    theirs = forms.groupBy("chrom", "pos", "_short", F.col("_end").alias("_their")).agg(F.min_by("_f", "_r").alias("_f"), F.min("_r").alias("_r"))
    ours = step.where("_plain AND _1 IS NULL").select("chrom", "pos", "_short", "_end").distinct()
    padded = ours.join(theirs, ["chrom", "pos", "_short"]).where(F.col("_end").startswith(F.col("_their")) | F.col("_their").startswith(F.col("_end")))
    second = padded.groupBy("chrom", "pos", "_short", "_end").agg(F.min_by("_f", "_r").alias("_2"))
    third = forms.groupBy("chrom", "_core").agg(F.min_by("_f", "_r").alias("_3"))
    joined = step.join(second, ["chrom", "pos", "_short", "_end"], "left").join(third, ["chrom", "_core"], "left")
    chosen = F.coalesce("_1", "_2", "_3")
    tier = F.when(F.col("_1").isNotNull(), 1).when(F.col("_2").isNotNull(), 2).when(F.col("_3").isNotNull(), 3)
    answers = stored(joined.where(tier.isNotNull()).select(*(F.col(c).alias(f"_{c}") for c in plain_key), "_alt", "_at", chosen.alias("_found"), tier.alias("_tier")))
    of = [F.col(c) == F.col(f"_{c}") for c in (*plain_key, "alt")] + [told_at == F.col("_at")]
    kept = [F.col(c) for c in records.columns if c not in (*columns, "matched", "allele")]
    return records.join(answers, of, "left").select(*kept, *(F.col("_found")[c].alias(c) for c in (*columns, "allele")), F.col("_tier").alias("matched"))
