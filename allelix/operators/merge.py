"""Intersections and merges of files whose records match by more than equality of four columns.

A rule by which two records of one position are one site is put as keys: records match when they share
one. Which files hold a site is then a bit mask over (position, key), made by partial aggregation, with
no pairs of records. Merging takes records of one position in rounds, in which each file gives one
record at most. Records are moved once, to their position, of whose list the rounds are told by the alleles
alone; calls can be made after that. A group holds the records of one position.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Iterator
from functools import reduce
from operator import and_, or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from allelix.functions import variants as V
from allelix.operators.sets import matches

COLLAPSE = ("none", "all", "snps", "indels", "both", "some", "id")
#: Kinds of alleles as bits; insertions and deletions are indels too, unless a mode tells them apart.
REF, SNP, MNP, INDEL, OTHER, INS, DEL = 1, 2, 4, 8, 16, 128, 256
#: Kinds whose records are merged though they share no allele.
MERGED = {"none": (), "snps": (SNP,), "indels": (INDEL,), "both": (SNP, INDEL), "snp-ins-del": (SNP, INS, DEL), "all": (), "id": ()}


def site_keys(mode: str) -> Column:
    """Keys (an array of strings) of a record with ref, alt and id; none for one that matches nothing, not even itself."""
    alts = F.split(F.upper("alt"), ",")
    whole = F.array(F.concat(F.lit("="), F.upper("ref"), F.lit(" "), F.upper("alt")))
    kind = lambda *names: F.exists(alts, lambda a: V.allele_type(F.upper("ref"), a).isin(*names))
    with_kind = lambda keys, condition, name: F.when(condition, F.concat(keys, F.array(F.lit(name)))).otherwise(keys)
    snps = lambda keys: with_kind(keys, kind("snp"), "snp")
    indels = lambda keys: with_kind(keys, kind("indel"), "indel")
    real = F.filter(alts, lambda a: ~a.isin("*", "."))
    return {
        "none": lambda: whole, "all": lambda: F.array(F.lit("")), "snps": lambda: snps(whole), "indels": lambda: indels(whole), "both": lambda: indels(snps(whole)),
        "some": lambda: F.array_distinct(F.transform(real, lambda a: F.concat(F.upper("ref"), F.lit(" "), a))),
        "id": lambda: F.when(F.col("id") != ".", F.array("id")).otherwise(F.array().cast("array<string>")),
    }[mode]()


def intersect(files: list[DataFrame], key: list[str], mode: str = "none", wanted: str | None = None) -> DataFrame:
    """Every record of every file with ``file``, ``mask`` (bit i: file i holds a matching record) and ``present`` (the mask as text, first file first).

    Records of one file are told apart by ``key``. ``wanted`` (see ``sets.matches``) keeps records by their mask. Mode ``none``
    asks for equal REF and ALT, ``some`` for equal REF and a shared ALT that is no star or dot, ``snps``, ``indels`` and
    ``both`` take any two records of that kind as one site, ``all`` any two of one position, ``id`` equal identifiers that
    are no dot. Letter case doesn't count. A record without keys has mask 0.
    """
    rows = reduce(DataFrame.unionByName, (df.withColumn("file", F.lit(i)) for i, df in enumerate(files)))
    # what records of equal alleles and identifier match is worked out once; alleles are told apart as they are written
    own = ["chrom", "pos", *(("id",) if mode == "id" else () if mode == "all" else ("ref", "alt"))]
    named = {c: f"_own_{i}" for i, c in enumerate(own)}
    alike = rows.groupBy(*own).agg(F.bit_or(F.expr("shiftleft(1L, file)")).alias("_files"))
    keyed = alike.select(*own, "_files", F.explode(site_keys(mode)).alias("_key"))
    held = keyed.groupBy("chrom", "pos", "_key").agg(F.bit_or("_files").alias("_bits"))
    masks = keyed.drop("_files").join(held, ["chrom", "pos", "_key"]).groupBy(*(F.col(c).alias(n) for c, n in named.items())).agg(F.bit_or("_bits").alias("_bits"))
    mask = F.coalesce("_bits", F.lit(0).cast("long"))
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(n)) for c, n in named.items()))
    marked = rows.join(masks, same, "left").withColumn("mask", mask).drop("_bits", *named.values())
    text = F.concat(*(F.when(F.col("mask").bitwiseAND(1 << i) != 0, "1").otherwise("0") for i in range(len(files))))
    marked = marked.withColumn("present", text)
    return marked.where(matches(F.col("mask"), wanted, len(files))) if wanted else marked


def sites(intersected: DataFrame, key: list[str], mode: str = "none") -> DataFrame:
    """Rows of ``intersect`` without those whose site an earlier file's listed row has: each site once, or once for each record of its first file.

    Rows of a position are gone through by file; one is listed unless a listed row of an earlier file has one of its keys. Rows of equal
    file and keys share their fate, so only these are gone through, however many rows a position has; ``key`` plays no part in it.
    """
    if mode in ("none", "all", "id"):
        # with one key at most, what is listed of a key is what its first file has
        single = intersected.withColumn("_key", F.get(site_keys(mode), F.lit(0)))
        first = F.min("file").over(Window.partitionBy("chrom", "pos", "_key"))
        return single.withColumn("_first", first).where("_key IS NULL OR file = _first").select(*intersected.columns)
    shown = intersected.withColumn("_keys", F.coalesce(F.array_sort(site_keys(mode)), F.array().cast("array<string>")))
    kinds = shown.select("chrom", "pos", "file", "_keys").distinct()
    here = kinds.groupBy("chrom", "pos", "file").agg(F.collect_list("_keys").alias("sets")).groupBy("chrom", "pos").agg(F.array_sort(F.collect_list(F.struct("file", "sets"))).alias("files"))
    none = F.struct(F.array().cast("array<string>").alias("keys"), F.array().cast("array<struct<file:int,keys:array<string>>>").alias("listed"))
    told = lambda s, k: F.coalesce(F.arrays_overlap(s["keys"], k), F.lit(False))

    def add(s: Column, f: Column) -> Column:
        fresh = F.filter(f["sets"], lambda k: ~told(s, k))
        return F.struct(F.array_union(s["keys"], F.flatten(fresh)).alias("keys"), F.concat(s["listed"], F.transform(fresh, lambda k: F.struct(f["file"].alias("file"), k.alias("keys")))).alias("listed"))

    listed = here.select(F.col("chrom").alias("_c"), F.col("pos").alias("_p"), F.explode(F.aggregate("files", none, add, lambda s: s["listed"])).alias("_l"))
    same = [F.col("chrom").eqNullSafe(F.col("_c")), F.col("pos").eqNullSafe(F.col("_p")), F.col("file") == F.col("_l.file"), F.col("_keys").eqNullSafe(F.col("_l.keys"))]
    return shown.join(listed, reduce(and_, same), "left_semi").select(*intersected.columns)


def kinds_of(mode: str) -> Column:
    """Kinds of a record's ALTs as one number; REF where it has none, or a reference block beside them."""

    def kind(a: Column) -> Column:
        t = V.allele_type(F.upper("ref"), a)
        longer = F.length(a) > F.length("ref")
        indel = F.when(longer, INS).otherwise(DEL) if mode == "snp-ins-del" else F.when(longer, INDEL | INS).otherwise(INDEL | DEL)
        return F.when(t == "snp", SNP).when(t == "mnp", MNP).when(t == "indel", indel).when(t.isin("other", "symbolic"), F.when(a.isin("<*>", "<NON_REF>"), REF).otherwise(OTHER)).otherwise(0)

    mask = F.aggregate(F.transform("alts", lambda a: kind(F.upper(a))), F.lit(0), lambda s, x: s.bitwiseOR(x))
    return F.when(mask == 0, REF).otherwise(mask)


def padded(alt: str, ref: str, longest: str) -> str:
    """An ALT of a record with REF ``ref``, said of the longer REF."""
    if alt[:1] in ("<", "*", ".") or not longest.startswith(ref):
        return alt
    return alt + longest[len(ref) :]


def _fits(mode: str, held_kinds: int, held_ref: str, held_alts: list[str], kinds: int, ref: str, alts: list[str]) -> bool:
    """Whether a record can join those of a round: by a kind the mode merges, a reference-only side, or a shared allele."""
    if mode == "all" or held_kinds == REF or kinds == REF or any(held_kinds & k and kinds & k for k in MERGED[mode]):
        return True
    if mode != "none" and held_kinds.bit_length() != kinds.bit_length():
        return False
    longest = max(held_ref, ref, key=len)
    if not longest.startswith(ref) or not longest.startswith(held_ref):
        return False
    return bool({padded(a, held_ref, longest) for a in held_alts} & {padded(a, ref, longest) for a in alts})


def next_round(mode: str, todo: list[tuple[int, int, str, list[str], str, int]]) -> list[int]:
    """Places in ``todo`` of the records that are merged next; records are (file, kinds, ref, alts, id, end of a symbol), in order of files. The rule as it stands, which ``Rounds`` follows shape by shape."""
    if mode == "id":
        chosen: dict[int, int] = {}
        for i, (file, _, _, _, name, _) in enumerate(todo):
            if name == todo[0][4]:
                chosen.setdefault(file, i)
        return list(chosen.values())
    kinds, ref, alts, end, taken = 0, "", [], None, []
    for i, (_, k, r, a, _, e) in enumerate(todo):
        if kinds and (not _fits(mode, kinds, ref, alts, k, r, a) or (end is not None and e is not None and end != e)):
            continue
        kinds, end = kinds | k, e if end is None else end
        longest = max(ref, r, key=len)
        alts = [padded(x, ref, longest) for x in alts] if ref else alts
        alts += [x for x in dict.fromkeys(padded(x, r, longest) for x in a) if x not in alts]
        ref = longest
        taken.append(i)
    # the commonest allele that is no reference leads; of equally common ones the first
    said = {i: [padded(x, todo[i][2], ref) for x in todo[i][3]] for i in taken}
    counts = {x: sum(s.count(x) for s in said.values()) for x in alts if x[:1] not in (".",) and x not in ("<*>", "<NON_REF>")}
    leader = max(counts, key=counts.get) if counts else None
    lead = 0
    for i in taken:
        for x, y in zip(said[i], todo[i][3], strict=True):
            if x == leader:
                lead |= _kind_of(mode, todo[i][2], y)
    lead = lead or REF
    by_file: dict[int, list[int]] = {}
    for i in taken:
        by_file.setdefault(todo[i][0], []).append(i)
    everything = reduce(lambda s, t: s | t[1], todo, 0)
    chosen = {}
    for file, places in by_file.items():
        own = reduce(lambda s, t: s | t[1], (t for t in todo if t[0] == file), 0)
        for i in places:
            k = todo[i][1]
            if lead & own and not lead & k:
                continue
            if lead == REF or (not lead & own and k & REF) or leader in said[i]:
                chosen[file] = i
                break
        if file not in chosen and mode != "none":
            for i in places:
                k = todo[i][1]
                shared = [x for x in MERGED[mode] if everything & x]
                if mode == "all" or any(k & x for x in shared) or (k & REF and (shared or everything & REF)) or (everything & REF and any(k & x for x in MERGED[mode])):
                    chosen[file] = i
                    break
    return list(chosen.values()) or [0]


class Rounds:
    """Deals the records of a position to rounds by their alleles, in time that grows with the records of a position and the shapes among them.

    Records of one shape (kinds, ref, alts, end of a symbol) share their fate but for their places. A round takes the first
    record left and goes on through the others, each of which may widen what fits; once no shape left would widen it, the
    others count by their shapes. What is known of shapes and widths is kept from position to position, up to ``MOST``.
    """

    MOST = 1 << 17

    def __init__(self, mode: str) -> None:
        self.mode = mode
        self.forget()

    def forget(self) -> None:
        self.shapes: dict[tuple, int] = {}
        self.shape_of: list[tuple[int, str, tuple[str, ...], int | None]] = []
        #: what a round holds so far: kinds, ref, alts, end
        self.held: list[tuple[int, str, tuple[str, ...], int | None]] = [(0, "", (), None)]
        self.held_ids = {self.held[0]: 0}
        self.steps: list[dict[int, int]] = [{}]
        self.leaders: dict[int, list[str]] = {}
        self.said: dict[tuple[int, int], tuple[list[str], list[tuple[int, int]]]] = {}
        self.leads: dict[tuple[int, int, int], int] = {}
        self.chances: dict[tuple[int, int, int, int, int], dict[int, int]] = {}

    def shape(self, kinds: int, ref: str, alts: tuple[str, ...], end: int | None) -> int:
        key = (kinds, ref, alts, end)
        if key not in self.shapes:
            self.shapes[key] = len(self.shape_of)
            self.shape_of.append(key)
        return self.shapes[key]

    def step(self, held: int, shape: int) -> int:
        """What a round holds with a record of ``shape`` more; -1 where that one doesn't fit."""
        if shape not in self.steps[held]:
            (kinds, ref, alts, end), (k, r, a, e) = self.held[held], self.shape_of[shape]
            if kinds and (not _fits(self.mode, kinds, ref, list(alts), k, r, list(a)) or (end is not None and e is not None and end != e)):
                self.steps[held][shape] = -1
            else:
                longest = max(ref, r, key=len)
                new = [padded(x, ref, longest) for x in alts] if ref else list(alts)
                new += [x for x in dict.fromkeys(padded(x, r, longest) for x in a) if x not in new]
                state = (kinds | k, longest, tuple(new), e if end is None else end)
                if state not in self.held_ids:
                    self.held_ids[state] = len(self.held)
                    self.held.append(state)
                    self.steps.append({})
                self.steps[held][shape] = self.held_ids[state]
        return self.steps[held][shape]

    def says(self, held: int, shape: int) -> tuple[list[str], list[tuple[int, int]]]:
        """ALTs of ``shape`` said of the held REF, and of the alleles that can lead those that are among them, by number, with their counts."""
        key = (held, shape)
        if key not in self.said:
            _, ref, alts, _ = self.held[held]
            if held not in self.leaders:
                self.leaders[held] = [x for x in dict.fromkeys(alts) if x[:1] not in (".",) and x not in ("<*>", "<NON_REF>")]
            said = [padded(x, self.shape_of[shape][1], ref) for x in self.shape_of[shape][2]]
            self.said[key] = said, [(i, said.count(x)) for i, x in enumerate(self.leaders[held]) if x in said]
        return self.said[key]

    def deal(self, files: list[int], shapes: list[int]) -> list[list[int]]:
        """Rounds of the records of a position, each the places of its records; ``files`` are in order."""
        n = len(files)
        after, before = [*range(1, n + 1), 0], [n, *range(n)]  # place n is both ends of the ring
        numbers: dict[tuple[int, int], int] = {}
        of = [numbers.setdefault(c, len(numbers)) for c in zip(files, shapes, strict=True)]
        kinds = list(numbers)
        places: list[list[int]] = [[] for _ in kinds]
        for i, c in enumerate(of):
            places[c].append(i)
        alive, own, out = list(range(len(kinds))), self._own(kinds), []
        while after[n] != n:
            chosen = self._next(after, n, of, kinds, places, alive, own)
            for i in chosen:
                before[after[i]], after[before[i]] = before[i], after[i]
                places[of[i]].remove(i)
                if not places[of[i]]:
                    alive.remove(of[i])
                    own = self._own([kinds[c] for c in alive])
            out.append(sorted(chosen))
        return out

    def _own(self, kinds: list[tuple[int, int]]) -> dict[int, int]:
        """Kinds of alleles that each file has left."""
        own: dict[int, int] = {}
        for file, shape in kinds:
            own[file] = own.get(file, 0) | self.shape_of[shape][0]
        return own

    def _next(self, after: list[int], n: int, of: list[int], kinds: list[tuple[int, int]], places: list[list[int]], alive: list[int], own: dict[int, int]) -> list[int]:
        """Places of the next round. ``of`` tells each place's (file, shape) in ``kinds``, whose places left are in ``places``."""
        held, i, still = 0, after[n], 0
        seen, count, first = [0] * len(kinds), [0] * len(kinds), [n] * len(kinds)
        to_of = self.steps[held]
        while i != n:
            c = of[i]
            shape = kinds[c][1]
            to = to_of[shape] if shape in to_of else self.step(held, shape)
            seen[c] += 1
            if to >= 0:
                if not count[c]:
                    first[c] = i
                count[c] += 1
            i = after[i]
            if to >= 0 and to != held:
                held, still, to_of = to, 0, self.steps[to]
                continue
            still += 1
            if still < 8:
                continue
            # some records changed nothing: on to the next that does, or to the end, all between by their shapes
            stop, fits = n, []
            for c in alive:
                if len(places[c]) > seen[c]:
                    shape = kinds[c][1]
                    to = to_of[shape] if shape in to_of else self.step(held, shape)
                    if to >= 0:
                        fits.append(c)
                        if to != held and places[c][seen[c]] < stop:
                            stop = places[c][seen[c]]
            for c in fits if stop == n else alive:
                k = len(places[c]) if stop == n else bisect_left(places[c], stop, seen[c])
                if k > seen[c]:
                    if to_of[kinds[c][1]] >= 0:
                        if not count[c]:
                            first[c] = places[c][seen[c]]
                        count[c] += k - seen[c]
                    seen[c] = k
            i, still = stop, 0
        taken = [c for c in alive if count[c]]
        # the commonest allele that is no reference leads; of equally common ones the first
        says = {shape: self.says(held, shape) for shape in {kinds[c][1] for c in taken}}
        leaders = self.leaders[held]
        totals = [0] * len(leaders)
        for c in taken:
            for x, times in says[kinds[c][1]][1]:
                totals[x] += count[c] * times
        leader = totals.index(max(totals)) if totals else -1
        lead = 0
        for shape in says:
            lead |= self._led(held, leader, shape)
        lead = lead or REF
        everything = reduce(or_, own.values())
        led: dict[int, int] = {}
        others: dict[int, int] = {}
        known = {file: self.chances.setdefault((held, leader, lead, kept, everything), {}) for file, kept in own.items()}
        for c in taken:
            file, shape = kinds[c]
            chance = known[file].get(shape)
            if chance is None:
                chance = known[file][shape] = self._chance(held, leader, lead, own[file], everything, shape)
            if chance == 2 and first[c] < led.get(file, n):
                led[file] = first[c]
            elif chance == 1 and first[c] < others.get(file, n):
                others[file] = first[c]
        return list((others | led).values()) or [after[n]]

    def _led(self, held: int, leader: int, shape: int) -> int:
        """Kinds of the alleles of ``shape`` that are the leader."""
        key = (held, leader, shape)
        if key not in self.leads:
            _, ref, alts, _ = self.shape_of[shape]
            name = self.leaders[held][leader] if leader >= 0 else None
            self.leads[key] = reduce(or_, (_kind_of(self.mode, ref, y) for x, y in zip(self.says(held, shape)[0], alts, strict=True) if x == name), 0)
        return self.leads[key]

    def _chance(self, held: int, leader: int, lead: int, own: int, everything: int, shape: int) -> int:
        """Whether a record of ``shape`` goes with the leader (2), is merged where its file has none that does (1), or waits (0)."""
        k = self.shape_of[shape][0]
        name = self.leaders[held][leader] if leader >= 0 else None
        if (not lead & own or lead & k) and (lead == REF or (not lead & own and k & REF) or name in self.says(held, shape)[0]):
            return 2
        if self.mode == "none":
            return 0
        shared = [x for x in MERGED[self.mode] if everything & x]
        return int(self.mode == "all" or any(k & x for x in shared) or bool(k & REF and (shared or everything & REF)) or bool(everything & REF and any(k & x for x in MERGED[self.mode])))


def rounds_by_id(todo: list[tuple[int, str]]) -> list[int]:
    """The round of each record (file, id), in one pass: each round takes the id of the first record left, and of it one record of each file."""
    waiting: dict[str, dict[int, deque[int]]] = {}
    for i, (file, name) in enumerate(todo):
        waiting.setdefault(name, {}).setdefault(file, deque()).append(i)
    numbers, n = [-1] * len(todo), 0
    for i, (_, name) in enumerate(todo):
        # all before this one have their round
        if numbers[i] < 0:
            for places in waiting[name].values():
                if places:
                    numbers[places.popleft()] = n
            n += 1
    return numbers


def _kind_of(mode: str, ref: str, alt: str) -> int:
    if alt[:1] in ("<", "*"):
        return OTHER
    if len(ref) == len(alt):
        return SNP if sum(a != b for a, b in zip(ref, alt, strict=True)) == 1 else MNP
    longer = INS if len(alt) > len(ref) else DEL
    nested = alt.startswith(ref) or ref.startswith(alt)
    return (longer if mode == "snp-ins-del" else INDEL | longer) if nested else OTHER


def _dealt(records: DataFrame, order: list[str], mode: str, *columns: Column | str) -> DataFrame:
    """(chrom, pos, round, r): the records of each round as structs of file, ``order`` and ``columns``, in order of files."""
    own = [c for c in order if c not in ("chrom", "pos")]
    if mode == "id":
        label, end = F.coalesce("id", F.lit(".")), F.lit(None).cast("long")
    else:
        # kinds, REF and ALTs as one text; ends count from the position, so that shapes are alike at all
        label = F.concat_ws("\t", kinds_of(mode).cast("string"), F.upper("ref"), F.array_join(F.transform("alts", F.upper), "\t"))
        symbol = F.exists("alts", lambda a: a.startswith("<") & ~a.isin("<*>", "<NON_REF>"))
        end = F.when(symbol, (F.coalesce("end_", "pos") if "end_" in records.columns else F.col("pos")).cast("long") - F.col("pos"))
    one = F.struct("file", *own, label.alias("_label"), end.alias("_end"), *columns)
    here = records.select("chrom", "pos", one.alias("one")).repartition("chrom", "pos").groupBy("chrom", "pos").agg(F.array_sort(F.collect_list("one")).alias("r"))

    @F.pandas_udf("array<array<int>>")
    def deal(files: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        dealer, shapes = Rounds(mode), {}
        for batch in files:
            found = []
            for file, labels, ends in zip(*batch, strict=True):
                if mode == "id":
                    by_round: list[list[int]] = []
                    for i, k in enumerate(rounds_by_id(list(zip(file.tolist(), labels, strict=True)))):
                        if k == len(by_round):
                            by_round.append([])
                        by_round[k].append(i)
                    found.append(by_round)
                    continue
                if len(dealer.held) + len(dealer.said) + len(dealer.leads) + len(dealer.chances) + len(shapes) > Rounds.MOST:
                    dealer.forget()
                    shapes.clear()
                numbers = []
                for label, end in zip(labels.tolist(), ends.tolist(), strict=True):
                    # missing ends are NaN where a list has others
                    known = shapes.get((label, end)) if end is None or end == end else shapes.get((label, None))
                    if known is None:
                        kinds, ref, *alts = label.split("\t")
                        to = None if end is None or end != end else int(end)
                        known = shapes[label, to] = dealer.shape(int(kinds), ref, tuple(a for a in alts if a), to)
                    numbers.append(known)
                found.append(dealer.deal(file.tolist(), numbers))
            yield pd.Series(found, dtype=object)

    told = deal(*(F.transform("r", lambda x: x[c]) for c in ("file", "_label", "_end")))  # noqa: B023
    # records are gathered by round before rounds become rows, so that no row carries the whole list
    gathered = here.select("chrom", "pos", "r", told.alias("_rounds")).select("chrom", "pos", F.transform("_rounds", lambda k: F.transform(k, lambda i: F.get("r", i))).alias("_r"))
    # no list is empty; the outer form asks for no filter, for which they would be gathered twice
    return gathered.select("chrom", "pos", F.posexplode_outer("_r").alias("round", "r"))


def rounds(records: DataFrame, order: list[str], mode: str) -> DataFrame:
    """(file, order, chrom, pos, round): the round of its position in which each record is merged, from 0. Records are told apart by file and ``order``."""
    each = _dealt(records, order, mode).select("chrom", "pos", "round", F.explode("r").alias("z"))
    own = [c for c in order if c not in ("chrom", "pos")]
    return each.select(*(F.col(f"z.{c}").alias(c) for c in ["file", *own]), "chrom", "pos", "round")


def merge_files(files: list[DataFrame], samples: list[int], order: list[str], mode: str = "both", numbers: dict[str, str] | None = None, sums: tuple[str, ...] = ("info_dp",), calls: str | None = None) -> DataFrame:
    """Records of several files as one row for each position and round: no record and no allele is left out.

    Files have chrom, pos, id, ref, alts, qual, filter, the columns of ``sums``, and ``calls``, as many as ``samples`` says, in order;
    ``order`` tells records of a file apart and puts them in order. REF is the longest one and ALTs are padded to it, in order of
    files; calls are the files' one after another, those of a file without the record missing (``./.`` and null). Alleles
    are numbered anew in ``gt`` and in the fields of ``numbers`` (``A``, ``R`` or ``G``: an element for each ALT, allele or genotype, null where
    unknown). QUAL is the highest, FILTER and ID are joined without repeats, ``sums`` are added, ``ac`` and ``an`` counted anew.

    With ``calls``, the SQL of a record's calls over the fields of the record ``x`` (the columns named, in upper case ref and alts) and ``pos``, files have
    no calls: these are made once records are brought together, so that only what they follow from is moved.
    """
    numbers = numbers or {}
    own = [c for c in order if c not in ("chrom", "pos")]
    fields = list(dict.fromkeys(["id", "ref", "alts", "qual", "filter", *sums, *([] if calls else ["calls"])]))
    rows = reduce(DataFrame.unionByName, (df.select(*dict.fromkeys(["chrom", "pos", *fields, *own])).withColumn("file", F.lit(i)) for i, df in enumerate(files)))
    upper = {"ref": F.upper("ref"), "alts": F.transform("alts", F.upper)}
    group = _dealt(rows, order, mode, *(upper.get(c, F.col(c)).alias(c) for c in fields if c not in own))
    group = group.withColumn("r", F.expr(f"transform(r, x -> struct(x.file AS file, {', '.join(f'x.{c} AS {c}' for c in fields if c != 'calls')}, {calls or 'x.calls'} AS calls))"))
    longest = F.aggregate(F.transform("r", lambda x: x["ref"]), F.lit(""), lambda s, x: F.when(F.length(x) > F.length(s), x).otherwise(s))
    group = group.withColumn("ref", longest)

    def pad(alt: Column, ref: Column) -> Column:
        fixed = alt.substr(1, 1).isin("<", "*", ".") | ~F.col("ref").startswith(ref)
        return F.when(fixed, alt).otherwise(F.concat(alt, F.substr(F.col("ref"), F.length(ref) + 1, F.greatest(F.length("ref") - F.length(ref), F.lit(0)))))

    said = F.transform("r", lambda x: x.withField("alts", F.transform(x["alts"], lambda a: pad(a, x["ref"]))))
    group = group.withColumn("r", said).withColumn("alts", F.array_distinct(F.flatten(F.transform("r", lambda x: x["alts"]))))

    def place_of(old: Column) -> Column:
        """The old number of each new allele, null for those the record doesn't know."""
        return F.concat(F.array(F.lit(0)), F.transform("alts", lambda a: F.when(F.array_contains(old, a), F.array_position(old, a).cast("int"))))

    def anew(call: Column, old: Column, place: Column, pairs: Column) -> Column:
        """A call whose alleles are numbered by the merged ALTs; ``old`` are the padded ALTs of its record, ``place`` their places, ``pairs`` those of genotypes."""
        new_of = lambda k: F.when(k.isin("0", "."), k).otherwise(F.array_position(F.col("alts"), F.get(old, k.cast("int") - 1)).cast("string"))
        parts = F.transform(F.split(F.replace(call["gt"], F.lit("|"), F.lit("/")), "/"), lambda k: F.coalesce(new_of(k), F.lit(".")))
        out = call.withField("gt", F.when(call["gt"].contains("|"), F.array_join(parts, "|")).otherwise(F.array_join(parts, "/")))
        for name, kind in numbers.items():
            values = call[name]
            kept = F.transform(F.slice(place, 2, F.size("alts")), lambda i: i - 1) if kind == "A" else pairs if kind == "G" else place
            out = out.withField(name, F.when(values.isNotNull(), V.gather(values, kept)))
        return out

    calls_type = group.schema["r"].dataType.elementType["calls"].dataType.elementType
    blank = F.struct(*(F.lit("./.").alias("gt") if f.name == "gt" else F.lit(None).cast(f.dataType).alias(f.name) for f in calls_type.fields))
    # places of alleles and genotypes are those of a record, worked out once for all its calls
    pairs_of = lambda place: V.genotypes_of(place) if "G" in numbers.values() else F.array().cast("array<int>")
    told = lambda o: V.let(place_of(o["alts"]), lambda place: V.let(pairs_of(place), lambda pairs: F.transform(o["calls"], lambda c: anew(c, o["alts"], place, pairs))))
    said_by = []
    for i, n in enumerate(samples):
        own = F.get(F.filter("r", lambda x: x["file"] == F.lit(i)), F.lit(0))
        said_by.append(V.let(own, lambda o: F.when(o.isNull(), F.array_repeat(blank, n)).otherwise(told(o))))  # noqa: B023
    group = group.withColumn("calls", F.concat(*said_by))
    joined = lambda c, none: F.array_join(F.array_distinct(F.filter(F.flatten(F.transform("r", lambda x: F.split(F.coalesce(x[c], F.lit(".")), ";"))), lambda v: ~v.isin(*none))), ";")
    or_else = lambda c, none: F.when(c == "", none).otherwise(c)
    passed = F.exists("r", lambda x: x["filter"] == "PASS")
    total = lambda c: F.aggregate(F.filter(F.transform("r", lambda x: x[c].cast("long")), lambda v: v.isNotNull()), F.lit(0).cast("long"), lambda s, v: s + v)
    return group.select(
        "chrom", "pos", "round", or_else(joined("id", ["."]), F.lit(".")).alias("id"), "ref", "alts", F.array_max(F.transform("r", lambda x: x["qual"])).alias("qual"),
        or_else(joined("filter", [".", "PASS"]), F.when(passed, "PASS").otherwise(".")).alias("filter"), *(total(c).alias(c) for c in sums),
        V.allele_counts(F.col("calls"), F.size("alts")).alias("ac"), V.allele_number(F.col("calls")).alias("an"), "calls",
    )
