"""Multiallelic calling: the likeliest set of up to three alleles of a site, then a genotype for each sample.

A sample's likelihoods of all genotypes are scaled to a sum of one. A set's likelihood is the product over
samples of the mean over the genotypes that it allows, weighed by the alleles' shares among all bases; each
allele that is not REF costs the logarithm of the expected share of variant sites. All of it is array
expressions of one record, so that calling needs no shuffle; sets are made for any number of alleles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allelix.functions import variants as V
from allelix.session import once, stored

#: Expected share of variant sites, phred scale and the highest genotype quality.
THETA, PHRED, MOST_GQ = 1.1e-3, -4.34294, 127.0
#: Fixed value: the chance that a child's genotype is not inherited.
NOVEL = 1e-8


def log_prior(samples: int, theta: float = THETA) -> float:
    """Logarithm of ``theta`` times the sum of 1/i over all chromosomes of the samples but one, at most 0.99."""
    return math.log(min(theta * sum(1 / i for i in range(1, max(2 * samples, 2))), 0.99))


def _numbers(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _sets(n: Column) -> Column:
    """Sets of one, two and three of n alleles, larger numbers first in each."""
    every = _numbers(n)
    two = F.flatten(F.transform(every, lambda a: F.transform(_numbers(a), lambda b: F.array(a, b))))
    three = F.flatten(F.transform(every, lambda a: F.flatten(F.transform(_numbers(a), lambda b: F.transform(_numbers(b), lambda c: F.array(a, b, c))))))
    return F.concat(F.transform(every, lambda a: F.array(a)), two, three)


def probabilities(pl: Column) -> Column:
    """Genotype likelihoods scaled to a sum of one; null if there are none, one is missing, or all are zero."""
    p = F.transform(pl, lambda x: F.pow(F.lit(10.0), -x / 10.0))
    total = F.aggregate(p, F.lit(0.0), lambda s, x: s + x)
    told = F.exists(pl, lambda x: x > 0) & ~F.exists(pl, lambda x: x.isNull())
    return F.when(told, F.transform(p, lambda x: x / total))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _inherited(father: Column, mother: Column, child: Column) -> Column:
    """Share of the four ways to pass on one allele of each parent that give the child's genotype."""
    ways = [(x, y) for x in (father["i"], father["j"]) for y in (mother["i"], mother["j"])]
    gives = [F.when((F.least(x, y) == child["i"]) & (F.greatest(x, y) == child["j"]), 0.25).otherwise(0.0) for x, y in ways]
    return gives[0] + gives[1] + gives[2] + gives[3]


def _family(father: Column, mother: Column, child: Column, novel: float) -> Column:
    """All triples of genotypes that are possible at all: joint likelihood ``w``, their order, and the genotypes f, m and c."""
    likely = lambda w: F.filter(w, lambda x: x["w"] > 0)

    def triple(a: Column, b: Column, c: Column) -> Column:
        joint = a["w"] * b["w"] * c["w"] * (novel + (1 - novel) * _inherited(a["g"], b["g"], c["g"]))
        return F.struct(joint.alias("w"), F.struct(a["order"].alias("a"), b["order"].alias("b"), c["order"].alias("c")).alias("order"), a["g"].alias("f"), b["g"].alias("m"), c["g"].alias("c"))

    return F.flatten(F.transform(likely(father), lambda a: F.flatten(F.transform(likely(mother), lambda b: F.transform(likely(child), lambda c: triple(a, b, c))))))


def call_alleles(sites: DataFrame, samples: int, theta: float = THETA, trios: list[tuple[int, int, int]] | None = None, novel: float = NOVEL) -> DataFrame:
    """``sites`` with ``kept`` (numbers of the alleles called, REF first), ``best`` (the likeliest set), ``qual``, and calls with ``gt`` and ``gq``.

    ``sites`` has alts, qs (the share of each allele among all bases, REF first) and calls with pl (a likelihood for each genotype, as
    phred); all calls are diploid. Genotypes are numbered by ``kept`` and range over the likeliest set. Samples without likelihoods are ``./.``; at a site
    with REF alone all others are ``0/0``. Sets with an allele without share are only those of one. Of equally likely sets and genotypes the
    first counts: fewer alleles and lower numbers, homozygotes before others. The members of ``trios`` (places of child, father and mother
    among the calls) are called together: by the product of their likelihoods and the chance that the child inherits its genotype, or has
    it anew with ``novel``; their qualities are of the sums over what the others may have. A trio with a silent member is called singly. A site on which no sample tells anything has REF and a null quality.
    """
    # equal shares and likelihoods are worked out once; the stored table is of known size where sites meet it
    asked = F.struct(F.size("alts").alias("n"), F.col("qs").alias("qs"), F.transform("calls", lambda c: c["pl"]).alias("pl"))
    keyed = once(sites.withColumn("_asked", asked))
    told = stored(_called(keyed.select("_asked").distinct(), log_prior(samples, theta), trios or [], novel))
    joined = keyed.join(told.select(F.col("_asked").alias("_key"), F.struct("*").alias("_found")), F.col("_asked") == F.col("_key"))
    calls = F.zip_with("calls", "_found._calls", lambda c, t: c.withField("gt", t["gt"]).withField("gq", t["gq"]))
    kept = [calls.alias(c) if c == "calls" else F.col(c) for c in sites.columns if c not in ("best", "kept", "qual")]
    return joined.select(*kept, "_found.best", "_found.kept", "_found.qual")


def _called(asked: DataFrame, prior: float, trios: list[tuple[int, int, int]], novel: float) -> DataFrame:
    """``_asked`` (n ALTs, qs and pl of each call) with ``best``, ``kept``, ``qual``, and gt and gq of each call."""
    n = F.col("_n") + 1
    sites = asked.select("_asked", F.col("_asked.n").alias("_n"), F.col("_asked.qs").alias("qs"), F.transform("_asked.pl", lambda p: F.struct(p.alias("pl"))).alias("calls"))
    rows = sites.withColumn("_p", F.transform("calls", lambda c: F.when(F.size(c["pl"]) == F.shiftright(n * (n + 1), 1), probabilities(c["pl"]))))
    rows = rows.withColumn("_told", F.filter("_p", lambda p: p.isNotNull()))
    share = lambda i: F.coalesce(F.get("qs", i), F.lit(0.0))
    sets = F.filter(_sets(n), lambda s: (F.size(s) == 1) | F.forall(s, lambda a: share(a) > 0))
    rows = rows.withColumn("_sets", sets)

    def parts(s: Column) -> Column:
        """Genotypes that a set allows: their place and weight. Shares are single precision numbers."""
        whole = _total(F.transform(s, share))
        freq = lambda a: F.when(F.size(s) == 1, F.lit(1.0)).otherwise((share(a) / whole).cast("float").cast("double"))
        return F.flatten(F.transform(s, lambda a: F.transform(F.filter(s, lambda b: b <= a), lambda b: F.struct(V.genotype_index(a, b).alias("at"), (freq(a) * freq(b) * F.when(a == b, 1.0).otherwise(2.0)).alias("w")))))

    rows = rows.withColumn("_parts", F.transform("_sets", lambda s: F.struct(s.alias("set"), parts(s).alias("parts"))))

    def likelihood(x: Column) -> Column:
        each = F.transform("_told", lambda p: _total(F.transform(x["parts"], lambda g: g["w"] * F.get(p, g["at"]))))
        some = F.filter(each, lambda v: v > 0)
        cost = F.size(F.filter(x["set"], lambda a: a > 0)) * F.lit(prior)
        return F.struct(F.when(F.size(some) > 0, _total(F.transform(some, lambda v: F.log(v))) + cost).alias("lk"), x["set"].alias("set"))

    rows = rows.withColumn("_lk", F.filter(F.transform("_parts", likelihood), lambda x: x["lk"].isNotNull()))
    first = F.array_max(F.transform("_lk", lambda x, i: F.struct(x["lk"].alias("lk"), (-i).alias("i"), x["set"].alias("set"))))
    rows = rows.withColumn("best", F.array_sort(F.coalesce(first["set"], F.array(F.lit(0)))))
    rows = rows.withColumn("kept", F.array_sort(F.array_union(F.array(F.lit(0)), F.col("best"))))
    of_ref = lambda x: (F.size(x["set"]) == 1) & (F.get(x["set"], F.lit(0)) == 0)
    # a genotype of REF that no sample allows has the likelihood of an empty product
    ref = F.coalesce(F.get(F.filter("_lk", of_ref), F.lit(0))["lk"], F.lit(0.0))
    others = F.transform(F.filter("_lk", lambda x: ~of_ref(x)), lambda x: x["lk"])
    top = F.array_max(others)
    log_sum = top + F.log(_total(F.transform(others, lambda v: F.exp(v - top))))
    rows = rows.withColumns({"_ref": ref, "_sum": log_sum})
    most = F.greatest("_ref", "_sum")
    both = most + F.log(F.exp(F.col("_ref") - most) + F.exp(F.coalesce(F.col("_sum") - most, F.lit(-1e9))))
    variant = F.size("kept") > 1
    qual = F.when(F.size("_lk") > 0, PHRED * (F.when(variant, F.col("_ref")).otherwise(F.coalesce("_sum", F.lit(-1e9))) - both))
    k = F.size("kept")
    same = F.transform(_numbers(k), lambda i: F.struct(i.alias("i"), i.alias("j")))
    mixed = F.flatten(F.transform(_numbers(k), lambda j: F.transform(_numbers(j), lambda i: F.struct(i.alias("i"), j.alias("j")))))
    rows = rows.withColumns({"qual": qual, "_pairs": F.concat(same, mixed)})

    def weight(p: Column, g: Column) -> Column:
        a, b = F.get("kept", g["i"]), F.get("kept", g["j"])
        single = lambda x: share(x).cast("float").cast("double")
        own = F.get(p, V.genotype_index(a, b)) * single(a) * single(b) * F.when(a == b, 1.0).otherwise(2.0)
        return F.when(F.array_contains("best", a) & F.array_contains("best", b), own).otherwise(0.0)

    weighed = F.transform("_p", lambda p: F.when(p.isNotNull(), F.transform("_pairs", lambda g, i: F.struct(weight(p, g).alias("w"), (-i).alias("order"), g.alias("g")))))
    rows = rows.withColumn("_w", weighed)

    def call(c: Column, w: Column) -> Column:
        best = F.array_max(w)
        total = _total(F.transform(w, lambda x: x["w"]))
        text = F.concat_ws("/", best["g"]["i"].cast("string"), best["g"]["j"].cast("string"))
        p = best["w"] / total
        gq = F.when(total <= 0, 0).when(p >= 1, MOST_GQ).otherwise(F.floor(F.least(PHRED * F.log(1 - p), F.lit(MOST_GQ))))
        gt = F.when(w.isNull(), "./.").when(~variant | (total <= 0), "0/0").otherwise(text)
        return c.withField("gt", gt).withField("gq", F.when(w.isNotNull() & variant, gq.cast("int")).otherwise(0))

    rows = rows.withColumn("calls", F.zip_with("calls", "_w", call))
    for child, father, mother in trios:
        of = lambda i: F.get("_w", F.lit(i))
        rows = rows.withColumn("_trio", F.when(variant & of(child).isNotNull() & of(father).isNotNull() & of(mother).isNotNull(), _family(of(father), of(mother), of(child), novel)))
        rows = rows.withColumn("_first", F.array_max("_trio"))
        found = F.col("_first").isNotNull()
        total = _total(F.transform("_trio", lambda x: x["w"]))
        for place, who in ((child, "c"), (father, "f"), (mother, "m")):
            rows = rows.withColumn("calls", F.transform("calls", _member(place, who, found, total)))
    return rows.select("_asked", "best", "kept", "qual", F.transform("calls", lambda c: F.struct(c["gt"].alias("gt"), c["gq"].alias("gq"))).alias("_calls"))


def _member(place: int, who: str, found: Column, total: Column):
    """The rewriting of one member's call by the likeliest triple of its trio."""

    def rewrite(call: Column, i: Column) -> Column:
        g = F.col("_first")[who]
        mine = _total(F.transform(F.filter("_trio", lambda x: (x[who]["i"] == g["i"]) & (x[who]["j"] == g["j"])), lambda x: x["w"]))
        p = mine / total
        gq = F.when(p >= 1, MOST_GQ).otherwise(F.floor(F.least(PHRED * F.log(1 - p), F.lit(MOST_GQ)))).cast("int")
        joint = call.withField("gt", F.concat_ws("/", g["i"].cast("string"), g["j"].cast("string"))).withField("gq", gq)
        return F.when(found & (i == place), joint).otherwise(call)

    return rewrite
