"""Predicates and rewrites on the calls of a record: sample subsets, allele counts, classes of genotypes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allelix.functions import variants as V


def keep_samples(variants: DataFrame, samples: list[int]) -> DataFrame:
    """Calls of ``samples`` alone, in their order in the file, with ``ac`` and ``an`` counted anew."""
    rows = variants.withColumn("calls", F.filter("calls", lambda c: c["sample_id"].isin(samples)))
    return rows.withColumns({"ac": V.allele_counts(F.col("calls"), F.size("alts")), "an": V.allele_number(F.col("calls"))})


def without_unused_alts(variants: DataFrame, numbers: dict[str, str] | None = None) -> DataFrame:
    """ALTs that no call holds are taken out, and the alleles of the calls are numbered anew.

    Fields of calls in ``numbers`` keep their elements for the alleles that stay: one for each ALT (``A``), allele (``R``) or genotype (``G``).
    """
    every = F.array_distinct(F.flatten(F.transform("calls", lambda c: V.gt_alleles(c["gt"]))))
    used = V.let(every, lambda held: F.filter(F.sequence(F.lit(1), F.greatest(F.size("alts"), F.lit(1))), lambda k: F.exists(held, lambda x: x == k)))
    rows = variants.withColumn("_used", F.when(F.size("alts") > 0, used).otherwise(F.array().cast("array<int>")))

    def numbered(gt: Column) -> Column:
        parts = F.transform(F.split(gt, "[/|]"), lambda a: F.when(a.isin(".", "0"), a).otherwise(F.array_position("_used", a.cast("int")).cast("string")))
        return F.when(gt.contains("|"), F.array_join(parts, "|")).otherwise(F.array_join(parts, "/"))

    stay = F.concat(F.array(F.lit(0)), F.col("_used"))

    def trimmed(call: Column) -> Column:
        out = call.withField("gt", numbered(call["gt"]))
        for name, kind in (numbers or {}).items():
            kept = {"A": lambda v: V.gather(v, F.transform("_used", lambda k: k - 1)), "R": lambda v: V.gather(v, stay), "G": lambda v: V.gather_genotypes(v, stay)}[kind]
            out = out.withField(name, F.when(call[name].isNotNull(), kept(call[name])))
        return out

    calls = F.transform("calls", trimmed)
    return rows.withColumn("calls", calls).withColumn("alts", F.transform("_used", lambda k: F.get("alts", k - 1))).drop("_used")


def has_class(calls: Column, *names: str) -> Column:
    return F.exists(calls, lambda c: V.gt_class(c["gt"]).isin(*names))


def is_private(calls: Column) -> Column:
    """Exactly one sample holds an allele that is not REF."""
    return F.size(F.filter(calls, lambda c: F.exists(V.gt_alleles(c["gt"]), lambda a: a > 0))) == 1


def all_phased(calls: Column) -> Column:
    return F.forall(calls, lambda c: V.is_phased(c["gt"]))


def is_uncalled(calls: Column) -> Column:
    """No sample has an allele that is known."""
    return F.forall(calls, lambda c: F.forall(V.gt_alleles(c["gt"]), lambda a: a.isNull()))


def count_of(calls: Column, n_alt: Column, mode: str = "nref") -> Column:
    """Alleles counted by mode: all ALTs (nref), the first (alt1), the rarest allele (minor), the commonest (major), all but that (nonmajor)."""

    def counted(c: Column) -> Column:
        counts, total = c["counts"], c["total"]
        alts = F.aggregate(counts, F.lit(0), lambda s, x: s + x)
        every = lambda n: F.concat(F.array(total - n), counts)
        return {
            "nref": lambda: alts, "alt1": lambda: F.coalesce(F.get(counts, F.lit(0)), F.lit(0)), "minor": lambda: V.let(alts, lambda n: F.least(total - n, n)),
            "major": lambda: V.let(alts, lambda n: F.array_max(every(n))), "nonmajor": lambda: total - V.let(alts, lambda n: F.array_max(every(n))),
        }[mode]()

    return V.let(F.struct(V.allele_counts(calls, n_alt).alias("counts"), V.allele_number(calls).alias("total")), counted)


def hardy_weinberg(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Per record: diploid calls by class over the first ALT, and the chi-square of their deviation from equilibrium."""
    cls = V.gt_class(F.col("gt"))
    of = lambda *names: F.count_if(cls.isin(*names)).cast("double")
    n = calls.groupBy(*keys).agg(of("hom_ref").alias("rr"), of("het").alias("ra"), of("hom_alt").alias("aa"))
    total = F.col("rr") + F.col("ra") + F.col("aa")
    p = (2 * F.col("rr") + F.col("ra")) / (2 * total)
    part = lambda seen, expected: F.when(expected > 0, (seen - expected) * (seen - expected) / expected).otherwise(0.0)
    chi = part(F.col("rr"), p * p * total) + part(F.col("ra"), 2 * p * (1 - p) * total) + part(F.col("aa"), (1 - p) * (1 - p) * total)
    return n.where(total > 0).select(*keys, *(F.col(c).cast("long").alias(c) for c in ("rr", "ra", "aa")), chi.alias("chi2"))


def merge_samples(files: list[DataFrame], samples: int) -> DataFrame:
    """Records of equal position and REF as one, a row for each sample of each file (chrom, pos, ref, alt, file, sample_id, gt).

    ALTs are united and sorted, genotypes numbered anew by them; a file without the record has ``./.``,
    and an allele that its record does not list is a dot.
    Of several records of one file that share position and REF the first by ALT and genotypes counts.
    """
    parts = []
    for i, df in enumerate(files):
        row = F.struct("alts", F.transform("calls", lambda c: c["gt"]).alias("gts"), "calls")
        parts.append(df.groupBy("chrom", "pos", "ref").agg(F.min(row).alias("row")).select("chrom", "pos", "ref", F.lit(i).alias("file"), "row"))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    united = rows.groupBy("chrom", "pos", "ref").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("row.alts")))).alias("alts"), F.map_from_entries(F.collect_list(F.struct("file", "row"))).alias("rows"))
    every = united.withColumn("file", F.explode(F.sequence(F.lit(0), F.lit(len(files) - 1)))).withColumn("sample_id", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    held = every.withColumn("_row", F.try_element_at("rows", F.col("file"))).withColumn("_gt", F.get(F.filter("_row.calls", lambda c: c["sample_id"] == F.col("sample_id")), F.lit(0))["gt"])
    number = lambda a: F.when(a.isin(".", "0"), a).otherwise(F.coalesce(F.array_position("alts", F.get(F.col("_row.alts"), a.cast("int") - 1)).cast("string"), F.lit(".")))
    parts_of = F.transform(F.split("_gt", "[/|]"), number)
    gt = F.when(F.col("_gt").isNull(), "./.").when(F.col("_gt").contains("|"), F.array_join(parts_of, "|")).otherwise(F.array_join(parts_of, "/"))
    return held.select("chrom", "pos", "ref", F.array_join("alts", ",").alias("alt"), "file", "sample_id", gt.alias("gt"))


def concordance(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Genotype classes of the records and samples of two files against each other: sample_id, left_class, right_class, n."""
    of = lambda df, name: df.groupBy(*keys, "sample_id").agg(F.min("gt").alias("gt")).select(*keys, "sample_id", V.gt_class(F.col("gt")).alias(name))
    joined = of(left, "left_class").join(of(right, "right_class"), [*keys, "sample_id"])
    return joined.groupBy("sample_id", "left_class", "right_class").agg(F.count("*").alias("n"))
