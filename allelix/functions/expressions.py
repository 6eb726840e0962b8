"""The filter expression language, compiled to a pair of columns.

``compile_filter`` gives a boolean for the record and, where a per-sample field takes part, an
array of booleans with one element for each sample. Comparisons hold if any pair of elements does.
Missing values are not SQL nulls: two missing values are equal, one missing value differs from
anything, and no order or pattern holds for either. ``&`` and ``|`` work within a sample, ``&&`` and
``||`` on records.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from allelix.functions import variants as V

_TOKEN = re.compile(r"\s*(?:(?P<number>\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)|(?P<string>\"[^\"]*\"|'[^']*')|(?P<file>@[^\s&|)]+)|(?P<name>(?:(?:INFO|FORMAT|FMT)/)?[A-Za-z_][\w.]*)|(?P<op>&&|\|\||==|!=|<=|>=|!~|[-+*/%()\[\],:&|<>=~!]))")


class ExpressionError(ValueError):
    """The text is no filter expression, or names a field that isn't there."""


@dataclass
class Value:
    """Numbers or strings: an array for the record, or an array of arrays, one for each sample."""

    column: Column
    per_sample: bool
    text: bool
    #: ``!`` stood before it: it counts where the value itself is the condition, and not in comparisons.
    negated: bool = False


@dataclass
class Truth:
    site: Column
    mask: Column | None = None


@dataclass(frozen=True)
class Schema:
    """Columns that names stand for: of the record (number or string) and of a call in the array ``calls``.

    A number of a call may be an array. ``flags`` are booleans of the record, 1 or 0 in expressions.
    ``alts`` is the array of ALT alleles, from which TYPE, ILEN and N_ALT follow.
    """

    numbers: dict[str, str]
    strings: dict[str, str]
    call_numbers: dict[str, str]
    calls: str = "calls"
    flags: dict[str, str] = field(default_factory=dict)
    call_arrays: frozenset[str] = frozenset()
    alts: str = "alts"


def tokenize(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        match = _TOKEN.match(text, at)
        if not match:
            raise ExpressionError(f"unexpected {text[at:at + 10]!r}")
        out.append((match.lastgroup, match[match.lastgroup]))
        at = match.end()
    return out


def _compare_elements(op: str, x: Column, y: Column, text: bool) -> Column:
    both, either = x.isNull() & y.isNull(), x.isNull() | y.isNull()
    if op in ("=", "=="):
        return F.when(either, both).otherwise(x == y)
    if op == "!=":
        return F.when(either, ~both).otherwise(x != y)
    if op in ("~", "!~"):
        found = F.rlike(x, y)
        return F.when(either | F.lit(not text), False).otherwise(found if op == "~" else ~found)
    holds = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
    return F.when(either, False).otherwise(holds)


def _any_pair(op: str, a: Column, b: Column, text: bool) -> Column:
    """An empty list counts as one missing value."""
    some = lambda v: F.when(F.size(v) > 0, v).otherwise(F.array(F.lit(None).cast("string" if text else "double")))
    meet = lambda a, b: F.exists(some(a), lambda x: F.exists(b, lambda y: _compare_elements(op, x, y, text)))
    return V.let(b, lambda right: V.let(some(right), lambda held: V.let(a, lambda left: meet(left, held))))


_GT_TESTS = {
    "hom": lambda g: V.gt_class(g).isin("hom_ref", "hom_alt"),
    "het": lambda g: V.gt_class(g).isin("het", "het_alt"),
    "hap": lambda g: V.gt_class(g) == "hap",
    "mis": lambda g: V.gt_class(g) == "mis",
    ".": lambda g: V.gt_class(g) == "mis",
    "ref": lambda g: (V.gt_class(g) != "mis") & ~F.exists(V.gt_alleles(g), lambda a: a > 0),
    "alt": lambda g: (V.gt_class(g) != "mis") & F.exists(V.gt_alleles(g), lambda a: a > 0),
    "rr": lambda g: V.gt_class(g) == "hom_ref",
    "ra": lambda g: V.gt_class(g) == "het",
    "ar": lambda g: V.gt_class(g) == "het",
    "aa": lambda g: V.gt_class(g) == "hom_alt",
    "r": lambda g: (V.gt_class(g) == "hap") & (F.get(V.gt_alleles(g), F.lit(0)) == 0),
    "a": lambda g: (V.gt_class(g) == "hap") & (F.get(V.gt_alleles(g), F.lit(0)) > 0),
}


def genotype_test(wanted: str):
    """What a genotype must be: a class by name in any case (aA apart, which is two different ALTs) or its very text."""
    if wanted in ("aA", "Aa"):
        return lambda g: V.gt_class(g) == "het_alt"
    if wanted.lower() in _GT_TESTS:
        return _GT_TESTS[wanted.lower()]
    if not re.fullmatch(r"[0-9.]+([/|][0-9.]+)*", wanted):
        raise ExpressionError(f"no class of genotypes: {wanted!r}")
    return lambda g: g == wanted


def _reduce(name: str, a: Column) -> Column:
    """One number of a list without its missing values; missing if nothing is left."""
    return V.let(F.filter(a, lambda x: x.isNotNull()), lambda known: _reduced(name, known))


def _reduced(name: str, a: Column) -> Column:
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    n = F.size(a)
    ordered = F.array_sort(a)
    if name == "count":
        return n.cast("double")
    mean = total / n
    out = {
        "sum": lambda: total,
        "min": lambda: F.array_min(a),
        "max": lambda: F.array_max(a),
        "avg": lambda: mean,
        "mean": lambda: mean,
        "median": lambda: (F.get(ordered, ((n - 1) / 2).cast("int")) + F.get(ordered, (n / 2).cast("int"))) / 2,
        "stdev": lambda: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n),
    }[name]()
    return F.when(n > 0, out)


_REDUCERS = ("sum", "min", "max", "avg", "mean", "median", "stdev", "count")


class _Parser:
    def __init__(self, tokens: list[tuple[str, str]], schema: Schema):
        self.tokens, self.at, self.schema = tokens, 0, schema

    def peek(self, *ops: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "op" and self.tokens[self.at][1] in ops:
            return self.tokens[self.at][1]
        return None

    def take(self, *ops: str) -> str | None:
        op = self.peek(*ops)
        if op:
            self.at += 1
        return op

    def need(self, op: str) -> None:
        if not self.take(op):
            raise ExpressionError(f"{op!r} is missing")

    # logic

    def either(self) -> Truth | Value:
        left = self.both()
        while op := self.take("||", "|"):
            left = self.join(op, left, self.both())
        return left

    def both(self) -> Truth | Value:
        left = self.compared()
        while op := self.take("&&", "&"):
            left = self.join(op, left, self.compared())
        return left

    def join(self, op: str, left: Truth | Value, right: Truth | Value) -> Truth:
        a, b = self.truth(left), self.truth(right)
        n = F.size(self.schema.calls)
        spread = lambda t: t.mask if t.mask is not None else F.array_repeat(t.site, n)
        masked = a.mask is not None or b.mask is not None
        within = op in ("&", "|")
        if op[0] == "|":
            mask = F.zip_with(spread(a), spread(b), lambda x, y: x | y) if masked else None
            return Truth(a.site | b.site, mask)
        if not masked:
            return Truth(a.site & b.site)
        if within:
            mask = F.zip_with(spread(a), spread(b), lambda x, y: x & y)
            return Truth(F.exists(mask, lambda x: x), mask)
        return Truth(a.site & b.site, F.zip_with(spread(a), spread(b), lambda x, y: x | y))

    def truth(self, v: Truth | Value) -> Truth:
        if isinstance(v, Truth):
            return v
        holds = (lambda a: F.exists(a, lambda x: F.coalesce(x != "", F.lit(False)))) if v.text else (lambda a: F.exists(a, lambda x: F.coalesce(x != 0, F.lit(False))))
        if v.per_sample:
            mask = F.transform(v.column, holds)
            out = Truth(F.exists(mask, lambda x: x), mask)
        else:
            out = Truth(holds(v.column))
        return self.opposite(out) if v.negated else out

    @staticmethod
    def opposite(t: Truth) -> Truth:
        return Truth(~t.site, None if t.mask is None else F.transform(t.mask, lambda x: ~x))

    def compared(self) -> Truth | Value:
        left = self.added()
        op = self.take("==", "=", "!=", "<=", ">=", "<", ">", "!~", "~")
        if not op:
            return left
        right = self.added()
        if isinstance(left, Truth) or isinstance(right, Truth):
            raise ExpressionError("a comparison can't be compared")
        return self.compare(op, left, right)

    def compare(self, op: str, left: Value, right: Value) -> Truth:
        if left.text != right.text:
            raise ExpressionError("a number can't be compared with a string")
        text = left.text
        if text and op in ("=", "==", "!="):
            # commas make sets: equal if they share an element
            listed = lambda v: F.flatten(F.transform(v, lambda x: F.split(x, ",")))
            shared = lambda a, b: F.arrays_overlap(listed(a), listed(b))

            def test(a: Column, b: Column) -> Column:
                none_a, none_b = (~F.exists(v, lambda x: x.isNotNull()) for v in (a, b))
                same = F.when(none_a & none_b, True).when(none_a | none_b, False).otherwise(F.coalesce(shared(a, b), F.lit(False)))
                return ~same if op == "!=" else same
        else:
            test = lambda a, b: _any_pair(op, a, b, text)
        if left.per_sample and right.per_sample:
            mask = F.zip_with(left.column, right.column, test)
        elif left.per_sample:
            mask = F.transform(left.column, lambda a: test(a, right.column))
        elif right.per_sample:
            mask = F.transform(right.column, lambda b: test(left.column, b))
        else:
            return Truth(test(left.column, right.column))
        return Truth(F.exists(mask, lambda x: x), mask)

    # arithmetic

    def added(self) -> Truth | Value:
        left = self.multiplied()
        while op := self.take("+", "-"):
            left = self.calculate(op, left, self.multiplied())
        return left

    def multiplied(self) -> Truth | Value:
        left = self.signed()
        while op := self.take("*", "/", "%"):
            left = self.calculate(op, left, self.signed())
        return left

    def calculate(self, op: str, left: Truth | Value, right: Truth | Value) -> Value:
        if isinstance(left, Truth) or isinstance(right, Truth) or left.text or right.text:
            raise ExpressionError(f"{op} needs numbers")
        one = {
            "+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y,
            "/": lambda x, y: F.when(y != 0, x / y).when(x > 0, float("inf")).when(x < 0, float("-inf")),
            "%": lambda x, y: F.when(y.cast("long") != 0, x.cast("long") % y.cast("long")).cast("double"),
        }[op]

        def lists(a: Column, b: Column) -> Column:
            # a single number goes with every element of the other list
            return F.when(F.size(a) == 1, F.transform(b, lambda y: one(F.get(a, F.lit(0)), y))).when(F.size(b) == 1, F.transform(a, lambda x: one(x, F.get(b, F.lit(0))))).otherwise(F.zip_with(a, b, one))

        if left.per_sample and right.per_sample:
            return Value(F.zip_with(left.column, right.column, lists), True, False)
        if left.per_sample:
            return Value(F.transform(left.column, lambda a: lists(a, right.column)), True, False)
        if right.per_sample:
            return Value(F.transform(right.column, lambda b: lists(left.column, b)), True, False)
        return Value(lists(left.column, right.column), False, False)

    def signed(self) -> Truth | Value:
        if self.take("-"):
            v = self.signed()
            return self.calculate("*", v, Value(F.array(F.lit(-1.0)), False, False))
        if self.take("!"):
            v = self.signed()
            return replace(v, negated=not v.negated) if isinstance(v, Value) else self.opposite(v)
        return self.primary()

    def primary(self) -> Truth | Value:
        if self.take("("):
            inner = self.either()
            self.need(")")
            return inner
        if self.at >= len(self.tokens):
            raise ExpressionError("the expression ends too early")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            return Value(F.array(F.lit(float(text))), False, False)
        if kind == "string":
            return Value(F.array(F.lit(text[1:-1])), False, True)
        if kind == "file":
            with open(text[1:], encoding="utf-8") as file:
                held = [line.strip() for line in file if line.strip()]
            return Value(F.array(F.lit(",".join(held))), False, True)
        if kind != "name":
            raise ExpressionError(f"unexpected {text!r}")
        if self.peek("("):
            return self.function(text)
        if text.upper().removeprefix("FMT/").removeprefix("FORMAT/") == "GT":
            return self.genotype()
        if text.upper() == "FILTER":
            return self.filters()
        if text.upper() == "TYPE":
            return self.types()
        return self.selected(self.field(text))

    def derived(self, name: str) -> Value | None:
        """Fields that follow from others: of the alleles and of the genotypes."""
        s = self.schema
        genotypes = lambda: F.transform(F.col(s.calls), lambda c: c["gt"])
        n_calls = F.size(s.calls).cast("double")
        counts = lambda: F.transform(V.allele_counts(F.col(s.calls), F.size(s.alts)), lambda x: x.cast("double"))
        number = lambda: V.allele_number(F.col(s.calls)).cast("double")
        rest = lambda of: F.array(number() - F.aggregate(of, F.lit(0.0), lambda t, x: t + x))
        made = {
            "N_ALT": lambda: F.array(F.size(s.alts).cast("double")),
            "N_SAMPLES": lambda: F.array(n_calls),
            "ILEN": lambda: F.transform(F.col(s.alts), lambda a: V.indel_length(F.col(s.strings["REF"]), a).cast("double")),
            "N_MISSING": lambda: F.array(F.size(F.filter(genotypes(), lambda g: g.contains("."))).cast("double")),
            "F_MISSING": lambda: F.array(F.when(n_calls > 0, F.size(F.filter(genotypes(), lambda g: g.contains("."))) / n_calls)),
            "AC": counts,
            "AN": lambda: F.array(number()),
            "AF": lambda: V.let(number(), lambda n: F.transform(counts(), lambda x: F.when(n > 0, x / n))),
            "MAC": lambda: F.array(V.let(counts(), lambda of: F.array_min(F.concat(of, rest(of))))),
        }.get(name)
        return Value(made(), False, False) if made else None

    def field(self, name: str) -> Value:
        s, key = self.schema, name
        for prefix in ("FMT/", "FORMAT/"):
            if name.startswith(prefix):
                key = name[len(prefix) :]
                if key not in s.call_numbers:
                    raise ExpressionError(f"no field {name}")
                return self.of_calls(key)
        key = key.removeprefix("INFO/")
        if key not in s.numbers and key not in s.strings and key.upper() in {**s.numbers, **s.strings}:
            key = key.upper()  # fields of the record are known in any case
        if key in s.flags:
            return Value(F.array(F.coalesce(F.col(s.flags[key]), F.lit(False)).cast("double")), False, False)
        if key in s.numbers:
            return Value(F.expr(s.numbers[key]) if "(" in s.numbers[key] else F.array(F.col(s.numbers[key]).cast("double")), False, False)
        if key in s.strings:
            return Value(F.array(F.col(s.strings[key])), False, True)
        if key in s.call_numbers:
            return self.of_calls(key)
        if found := self.derived(key.upper()):
            return found
        raise ExpressionError(f"no field {name}")

    def of_calls(self, key: str) -> Value:
        inner = self.schema.call_numbers[key]
        one = (lambda c: c[inner].cast("array<double>")) if key in self.schema.call_arrays else (lambda c: F.array(c[inner].cast("double")))
        return Value(F.transform(F.col(self.schema.calls), one), True, False)

    def picked(self, *ends: str):
        """A test of an index: a list of numbers and ranges up to one of ``ends``; nothing or a star takes all."""
        if self.take("*"):
            return lambda k: F.lit(True)
        parts: list[tuple[int, int | None]] = []
        while self.at < len(self.tokens) and self.tokens[self.at][0] == "number":
            low = int(self.tokens[self.at][1])
            self.at += 1
            high: int | None = low
            if self.take("-"):
                high = None
                if self.tokens[self.at][0] == "number":
                    high = int(self.tokens[self.at][1])
                    self.at += 1
            parts.append((low, high))
            if not self.take(","):
                break
        if not self.peek(*ends):
            raise ExpressionError("a selector is a star or numbers and ranges")
        if not parts:
            return lambda k: F.lit(True)
        return lambda k: reduce(lambda x, y: x | y, [(k >= low) & (k <= high if high is not None else F.lit(True)) for low, high in parts])

    def selected(self, v: Value) -> Value:
        """``[values]`` of a record, ``[samples]``, ``[samples:values]`` of calls; what isn't selected meets no comparison."""
        if not self.take("["):
            return v
        first = self.picked("]", ":")
        second = self.picked("]") if self.take(":") else lambda k: F.lit(True)
        self.need("]")
        if v.per_sample:
            return Value(F.transform(v.column, lambda a, k: F.when(first(k), F.filter(a, lambda x, i: second(i))).otherwise(F.filter(a, lambda x: F.lit(False)))), True, v.text)
        return Value(F.filter(v.column, lambda x, i: first(i)), False, v.text)

    def genotype(self) -> Truth:
        op = self.take("==", "=", "!=", "!~", "~")
        if not op or self.tokens[self.at][0] != "string":
            raise ExpressionError("GT is compared with a string")
        wanted = self.tokens[self.at][1][1:-1]
        self.at += 1
        test = (lambda g: F.rlike(g, F.lit(wanted))) if op.endswith("~") else genotype_test(wanted)
        mask = F.transform(F.col(self.schema.calls), lambda c: ~test(c["gt"]) if op[0] == "!" else test(c["gt"]))
        return Truth(F.exists(mask, lambda x: x), mask)

    def types(self) -> Truth:
        """``=``: the record's ALTs are of these types and no others; ``~``: one is."""
        op = self.take("==", "=", "!=", "!~", "~")
        if not op or self.tokens[self.at][0] != "string":
            raise ExpressionError("TYPE is compared with a string")
        wanted = F.array(*(F.lit(x.lower()) for x in re.split("[,;|]", self.tokens[self.at][1][1:-1])))
        self.at += 1
        ref, alts = F.col(self.schema.strings["REF"]), F.col(self.schema.alts)
        held = F.when(F.size(alts) > 0, F.array_distinct(F.transform(alts, lambda a: V.allele_type(ref, a)))).otherwise(F.array(F.lit("ref")))
        found = F.arrays_overlap(held, wanted) if op.endswith("~") else (F.size(F.array_except(held, wanted)) == 0) & (F.size(F.array_except(wanted, held)) == 0)
        return Truth(~found if op[0] == "!" else found)

    def filters(self) -> Truth:
        op = self.take("==", "=", "!=", "!~", "~")
        if not op or self.tokens[self.at][0] != "string":
            raise ExpressionError("FILTER is compared with a string")
        wanted = [x for x in self.tokens[self.at][1][1:-1].split(";") if x and x != "."]
        self.at += 1
        held = F.filter(F.split(F.col(self.schema.strings["FILTER"]), ";"), lambda x: ~x.isin(".", "PASS"))
        target = F.array(*(F.lit(x) for x in wanted)).cast("array<string>")
        missing = F.size(F.array_except(target, held))
        same = (missing == 0) & (F.size(F.array_except(held, target)) == 0)
        return Truth({"=": same, "==": same, "!=": ~same, "~": missing == 0, "!~": missing > 0}[op])

    def function(self, name: str) -> Value:
        self.need("(")
        inner = self.either()
        low = name.lower()
        if low == "binom":
            return self.binomial(inner, self.either() if self.take(",") else None)
        self.need(")")
        if low in ("n_pass", "f_pass"):
            mask = self.truth(inner).mask
            if mask is None:
                raise ExpressionError(f"{name} needs a field of the samples")
            n = F.size(F.filter(mask, lambda x: x)).cast("double")
            return Value(F.array(n if low == "n_pass" else n / F.size(mask)), False, False)
        if low == "count" and isinstance(inner, Truth):
            return Value(F.array(F.size(F.filter(inner.mask, lambda x: x)).cast("double") if inner.mask is not None else inner.site.cast("double")), False, False)
        if isinstance(inner, Truth):
            raise ExpressionError(f"{name} needs values")
        for prefix in ("smpl_", "s"):
            if low.startswith(prefix) and low[len(prefix) :] in _REDUCERS and low not in _REDUCERS:
                if not inner.per_sample:
                    raise ExpressionError(f"{name} needs a field of the samples")
                return Value(F.transform(inner.column, lambda a: F.array(_reduce(low[len(prefix) :], a))), True, False)
        if low in _REDUCERS:
            return Value(F.array(_reduce(low, F.flatten(inner.column) if inner.per_sample else inner.column)), False, False)
        each = {"abs": F.abs, "phred": V.phred, "strlen": lambda x: F.length(x).cast("double")}.get(low)
        if each is None:
            raise ExpressionError(f"no function {name}")
        if inner.per_sample:
            return Value(F.transform(inner.column, lambda a: F.transform(a, each)), True, False)
        return Value(F.transform(inner.column, each), False, False)


    def binomial(self, first: Truth | Value, second: Truth | Value | None) -> Value:
        """Two-sided probability of two numbers as draws of a fair coin: two lists' first ones, or those of one list.

        Of one list of a call the numbers are those of the two alleles that its genotype names, elsewhere and where
        the genotype names none, or one that the list doesn't hold, the first two.
        """
        self.need(")")
        if isinstance(first, Truth) or isinstance(second, Truth):
            raise ExpressionError("binom needs values")
        of = lambda x, y: F.array(F.when(x.isNotNull() & y.isNotNull(), V.binomial_two_sided(x.cast("int"), (x + y).cast("int"))))
        head = lambda a, i: F.get(a, F.lit(i))
        if second is None:
            one = lambda a: of(head(a, 0), head(a, 1))
            if not first.per_sample:
                return Value(one(first.column), False, False)

            def named(a: Column, call: Column) -> Column:
                pair = lambda gt: F.struct(F.get(a, F.get(gt, F.lit(0))).alias("x"), F.get(a, F.get(gt, F.lit(1))).alias("y"))
                drawn = lambda p: F.when(p["x"].isNotNull() & p["y"].isNotNull(), of(p["x"], p["y"])).otherwise(one(a))
                return V.let(V.let(V.gt_alleles(call["gt"]), pair), drawn)

            return Value(F.zip_with(first.column, F.col(self.schema.calls), named), True, False)
        if first.per_sample != second.per_sample:
            raise ExpressionError("binom needs two fields of one kind")
        two = lambda a, b: of(head(a, 0), head(b, 0))
        return Value(F.zip_with(first.column, second.column, two) if first.per_sample else two(first.column, second.column), first.per_sample, False)


def compile_filter(text: str, schema: Schema) -> Truth:
    """The columns that say whether a record, and each of its samples, passes."""
    parser = _Parser(tokenize(text), schema)
    out = parser.truth(parser.either())
    if parser.at != len(parser.tokens):
        raise ExpressionError(f"unexpected {parser.tokens[parser.at][1]!r}")
    return out
