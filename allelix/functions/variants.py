"""Column expressions over alleles and genotypes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PURINES, PYRIMIDINES = ("A", "G"), ("C", "T")


def let(value: Column, use) -> Column:
    """``use(value)``, for which ``value`` is worked out once, however often ``use`` names it and inside what loops."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def allele_type(ref: Column, alt: Column) -> Column:
    """ref, symbolic, overlap, snp, mnp or indel; other when lengths differ and neither allele starts the other."""
    same = F.length(ref) == F.length(alt)
    one = (F.length(ref) == 1) & (F.length(alt) == 1)
    differing = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.length(ref), F.lit(1))), lambda i: F.substr(ref, i, F.lit(1)) != F.substr(alt, i, F.lit(1))))
    nested = alt.startswith(ref) | ref.startswith(alt)
    return (
        F.when((alt == ".") | (alt == "<*>") | (alt == ref), "ref").when(alt == "*", "overlap").when(alt.startswith("<"), "symbolic")
        .when(one, "snp").when(same & (differing == 1), "snp").when(same, "mnp").when(nested, "indel").otherwise("other")
    )


def indel_length(ref: Column, alt: Column) -> Column:
    """Length of ALT less that of REF; null for symbols and missing alleles."""
    return F.when(~alt.startswith("<") & ~alt.isin(".", "*"), F.length(alt) - F.length(ref))


def is_transition(ref: Column, alt: Column) -> Column:
    return (ref.isin(*PURINES) & alt.isin(*PURINES)) | (ref.isin(*PYRIMIDINES) & alt.isin(*PYRIMIDINES))


def gt_alleles(gt: Column) -> Column:
    """Allele numbers of a genotype, null where missing."""
    # a separator of one character is no pattern that is compiled for each row
    return F.transform(F.split(F.replace(gt, F.lit("|"), F.lit("/")), "/"), lambda a: F.when(a != ".", a.cast("int")))


#: The usual spellings of a genotype's class, which need no look at the alleles.
USUAL_CLASSES = {"hom_ref": ("0/0", "0|0"), "het": ("0/1", "0|1", "1|0", "1/0"), "hom_alt": ("1/1", "1|1"), "mis": ("./.", ".|.", "."), "hap": ("0", "1")}


def gt_class(gt: Column) -> Column:
    """mis, hap, hom_ref, hom_alt, het or het_alt; usual spellings are looked up, others are taken apart."""

    def unusual(a: Column) -> Column:
        first, second = F.get(a, F.lit(0)), F.get(a, F.lit(1))
        return (
            F.when(F.exists(a, lambda x: x.isNull()), "mis").when(F.size(a) == 1, "hap").when((first == second) & (first == 0), "hom_ref")
            .when(first == second, "hom_alt").when((first == 0) | (second == 0), "het").otherwise("het_alt")
        )

    out = None
    for name, spellings in USUAL_CLASSES.items():
        out = F.when(gt.isin(*spellings), name) if out is None else out.when(gt.isin(*spellings), name)
    return out.otherwise(let(gt_alleles(gt), unusual))


def is_phased(gt: Column) -> Column:
    return gt.contains("|") | ~gt.contains("/")


def dosage(gt: Column) -> Column:
    """Number of alleles that are not REF; null if any is missing."""
    a = gt_alleles(gt)
    usual = F.when(gt.isin("0/0", "0|0", "0"), 0).when(gt.isin("0/1", "0|1", "1|0", "1"), 1).when(gt.isin("1/1", "1|1"), 2).when(gt.isin("./.", "."), F.lit(None).cast("int"))
    return usual.when(~F.exists(a, lambda x: x.isNull()), F.size(F.filter(a, lambda x: x > 0)))


def allele_counts(calls: Column, n_alt: Column) -> Column:
    """AC of each ALT over an array of calls with a field gt."""
    counts = lambda every: F.transform(F.sequence(F.lit(1), n_alt), lambda k: F.size(F.filter(every, lambda x: x == k)))
    return F.when(n_alt > 0, let(F.flatten(F.transform(calls, lambda c: gt_alleles(c["gt"]))), counts)).otherwise(F.array().cast("array<int>"))


def allele_number(calls: Column) -> Column:
    return F.size(F.filter(F.flatten(F.transform(calls, lambda c: gt_alleles(c["gt"]))), lambda x: x.isNotNull()))


def genotype_index(low: Column, high: Column) -> Column:
    """Place of an unordered diploid genotype in a likelihood list; null if an allele is."""
    a, b = F.least(low, high), F.greatest(low, high)
    return F.when(low.isNotNull() & high.isNotNull(), a + F.shiftright(b * (b + 1), 1))


def gather(values: Column, kept: Column) -> Column:
    """Elements of a per-allele list at the kept allele numbers."""
    return let(values, lambda v: F.transform(kept, lambda i: F.get(v, i)))


def genotypes_of(kept: Column) -> Column:
    """Places in a per-genotype list of the genotypes of the kept alleles, in their order; null where an allele is."""
    pairs = lambda k: F.flatten(F.transform(F.sequence(F.lit(0), F.size(k) - 1), lambda h: F.transform(F.sequence(F.lit(0), h), lambda l: genotype_index(F.get(k, l), F.get(k, h)))))
    return let(kept, pairs)


def gather_genotypes(values: Column, kept: Column) -> Column:
    """Elements of a per-genotype list for the kept alleles, in the order of the kept genotypes."""
    return gather(values, genotypes_of(kept))


def trimmed(pos: Column, ref: Column, alt: Column) -> Column:
    """(pos, ref, alt) without common ending bases, then without common starting bases; each allele keeps one."""
    most = F.least(F.length(ref), F.length(alt)) - 1
    same_from = lambda n, f: F.coalesce(F.array_min(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & (f(ref, i) != f(alt, i)))) - 1, F.greatest(n, F.lit(0)))
    tail = same_from(most, lambda s, i: F.substr(s, F.length(s) - i + 1, F.lit(1)))
    cut = F.struct(F.substr(ref, F.lit(1), F.length(ref) - tail).alias("r"), F.substr(alt, F.lit(1), F.length(alt) - tail).alias("a"))

    def left(x: Column) -> Column:
        n = F.least(F.length(x["r"]), F.length(x["a"])) - 1
        head = F.coalesce(F.array_min(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & (F.substr(x["r"], i, F.lit(1)) != F.substr(x["a"], i, F.lit(1))))) - 1, F.greatest(n, F.lit(0)))
        return F.struct((pos + head).cast("int").alias("pos"), F.substr(x["r"], head + 1, F.length(x["r"])).alias("ref"), F.substr(x["a"], head + 1, F.length(x["a"])).alias("alt"))

    plain = ~alt.startswith("<") & ~alt.isin(".", "*") & (F.length(ref) > 1) & (F.length(alt) > 1)
    return F.when(plain, F.element_at(F.transform(F.array(cut), left), 1)).otherwise(F.struct(pos.cast("int").alias("pos"), ref.alias("ref"), alt.alias("alt")))


def variant_bin(beg: Column, end: Column) -> Column:
    """Smallest bin of the five-level scheme (2**14 at the finest level) that holds a 1-based interval."""
    b, e = beg - 1, end - 1
    out = F.lit(0)
    for shift, offset in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)):
        out = F.when(F.shiftright(b, shift) == F.shiftright(e, shift), F.shiftright(b, shift) + offset).otherwise(out)
    return out


def phred(p: Column) -> Column:
    return -10 * F.log10(p)


def binomial_two_sided(k: Column, n: Column) -> Column:
    """Two-sided probability of k or a rarer count in n fair draws: min(1, twice the smaller tail); 0 without draws."""

    def drawn(d: Column) -> Column:
        k, n = d["k"], d["n"]
        low = F.least(k, n - k)
        # the tail from its far end: 1 + n / 1 * (1 + (n - 1) / 2 * (1 + ...))
        term = F.aggregate(F.when(low > 0, F.sequence(low, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>")), F.lit(1.0), lambda s, i: s * (n - i + 1) / i + 1.0)
        return F.when(n <= 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), 2 * term / F.pow(F.lit(2.0), n)))

    return let(F.struct(k.alias("k"), n.alias("n")), drawn)
