"""Spreadsheet formulas as Columns: a formula's text is parsed once and becomes one expression.

Names are columns.  Functions over ranges become aggregates, so a formula with them is for
``agg``, any other for ``select``.  What can't be evaluated in a row is null there.  As in
the language that it follows, unary minus binds tighter than ``^``, which is
right-associative, texts compare without case, numbers within a tolerance, and ``;`` and
``,`` both separate arguments.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .formulas import TOLERANCE, criterion, excel_round, excel_trim

#: Limits of one formula.
DEPTH, LENGTH = 64, 1 << 20
_TOKEN = re.compile(r'\s*(?:(\d+\.?\d*(?:[eE][-+]?\d+)?|\.\d+)|"((?:[^"]|"")*)"|(?:_xlfn\.)?([A-Za-z_][\w.]*)|(<=|>=|<>|[-+*/^%()=<>,;]))')


@dataclass(frozen=True)
class Value:
    """A Column with what it holds: n(umber), t(ext) or b(oolean)."""

    column: Column
    kind: str


def number(v: Value) -> Column:
    """The value as a number: truths are 1 and 0, text that isn't one is null, so are infinities."""
    if v.kind == "b":
        return v.column.cast("int").cast("double")
    x = v.column.cast("double") if v.kind == "n" else F.trim(v.column).try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)


def shown(v: Value) -> Column:
    """The value as text; whole numbers have no point, blanks are empty."""
    if v.kind == "t":
        return F.coalesce(v.column, F.lit(""))
    if v.kind == "b":
        return F.when(v.column, "TRUE").otherwise("FALSE")
    x = v.column.cast("double")
    return F.coalesce(F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("long").cast("string")).otherwise(x.cast("string")), F.lit(""))


def truth(v: Value) -> Column:
    return v.column if v.kind == "b" else number(v) != 0


def compare(op: str, a: Value, b: Value) -> Column:
    """Numbers within the tolerance where both are, else texts without case."""
    x, y = number(a), number(b)
    same = F.abs(x - y) <= TOLERANCE
    s, t = F.lower(shown(a)), F.lower(shown(b))
    numeric = {"=": same, "<>": ~same, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
    text = {"=": s == t, "<>": s != t, "<": s < t, "<=": s <= t, ">": s > t, ">=": s >= t}[op]
    if a.kind != "t" and b.kind != "t":
        return numeric
    return F.when(x.isNotNull() & y.isNotNull(), numeric).otherwise(text)


class _Parser:
    def __init__(self, text: str, names: Callable[[str], Value]):
        if len(text) > LENGTH:
            raise ValueError("formula is too long")
        self.names, self.at, self.depth = names, 0, 0
        self.tokens: list[tuple[str, str]] = []
        text = text.strip().removeprefix("=")
        at = 0
        while text[at:].strip():
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"formula at {text[at : at + 20]!r}")
            kind = next(k for k, g in zip("ntws", m.groups(), strict=True) if g is not None)
            self.tokens.append((kind, m[m.lastindex]))
            at = m.end()

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] == "s" else ""

    def take(self, *signs: str) -> str:
        if self.peek() in signs and self.peek():
            self.at += 1
            return self.tokens[self.at - 1][1]
        return ""

    def whole(self) -> Value:
        out = self.comparison()
        if self.at < len(self.tokens):
            raise ValueError(f"formula goes on with {self.tokens[self.at][1]!r}")
        return out

    def comparison(self) -> Value:
        self.depth += 1
        if self.depth > DEPTH:
            raise ValueError("formula is nested too deeply")
        left = self.sums()
        while op := self.take("=", "<>", "<", "<=", ">", ">="):
            left = Value(compare(op, left, self.sums()), "b")
        self.depth -= 1
        return left

    def sums(self) -> Value:
        left = self.products()
        while op := self.take("+", "-"):
            right = self.products()
            left = Value(number(left) + number(right) if op == "+" else number(left) - number(right), "n")
        return left

    def products(self) -> Value:
        left = self.powers()
        while op := self.take("*", "/"):
            x, y = number(left), number(self.powers())
            left = Value(x * y if op == "*" else F.when(y != 0, x / y), "n")
        return left

    def powers(self) -> Value:
        left = self.signed()
        if self.take("^"):
            return Value(F.pow(number(left), number(self.powers())), "n")
        return left

    def signed(self) -> Value:
        if op := self.take("-", "+"):
            v = self.signed()
            return Value(-number(v) if op == "-" else number(v), "n")
        v = self.primary()
        while self.take("%"):
            v = Value(number(v) / 100, "n")
        return v

    def primary(self) -> Value:
        if self.take("("):
            v = self.comparison()
            if not self.take(")"):
                raise ValueError("a bracket is open")
            return v
        if self.at >= len(self.tokens):
            raise ValueError("formula ends early")
        kind, word = self.tokens[self.at]
        self.at += 1
        if kind == "n":
            return Value(F.lit(float(word)), "n")
        if kind == "t":
            return Value(F.lit(word.replace('""', '"')), "t")
        if kind != "w":
            raise ValueError(f"formula has {word!r}")
        if self.peek() == "(":
            return self.call(word.upper())
        if word.upper() in ("TRUE", "FALSE"):
            return Value(F.lit(word.upper() == "TRUE"), "b")
        return self.names(word)

    @staticmethod
    def literal(tokens: list[tuple[str, str]]) -> str | None:
        """The text of an argument that is a text or a number with or without a sign."""
        if len(tokens) == 2 and tokens[0] in (("s", "-"), ("s", "+")) and tokens[1][0] == "n":
            return tokens[0][1].strip("+") + tokens[1][1]
        return tokens[0][1].replace('""', '"') if len(tokens) == 1 and tokens[0][0] in ("n", "t") else None

    def call(self, name: str) -> Value:
        self.at += 1
        args: list[Value] = []
        literal: list[str | None] = []
        while not self.take(")"):
            mark = self.at
            args.append(self.comparison())
            literal.append(self.literal(self.tokens[mark : self.at]))
            if self.peek() != ")" and not self.take(",", ";"):
                raise ValueError(f"arguments of {name}")
        try:
            return FUNCTIONS[name](args, literal)
        except (KeyError, IndexError):
            raise ValueError(f"{name} with {len(args)} arguments") from None


def _sum(args, _) -> Value:
    return Value(sum((F.coalesce(F.sum(number(a)), F.lit(0.0)) for a in args), F.lit(0.0)), "n")


def _count(args, _) -> Value:
    return Value(sum((F.count(number(a)) for a in args), F.lit(0)).cast("double"), "n")


def _average(args, literal) -> Value:
    return Value(_sum(args, literal).column / F.greatest(_count(args, literal).column, F.lit(1.0)), "n")


def _criteria(pairs, literals) -> Column:
    tests = [criterion(p.column, c) for p, c in zip(pairs, literals, strict=True)]
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def _conditional(kind: str, several: bool):
    """COUNTIF(S), SUMIF(S) and AVERAGEIF(S); criteria are literals, an empty match sums and averages to 0."""

    def build(args, literal) -> Value:
        if kind == "count":
            test = _criteria(args[::2], literal[1::2])
            return Value(F.count_if(test).cast("double"), "n")
        if several:
            test, of = _criteria(args[1::2], literal[2::2]), args[0]
        else:
            test, of = _criteria(args[:1], literal[1:2]), args[2] if len(args) > 2 else args[0]
        x = F.when(test, number(of))
        total = F.coalesce(F.sum(x), F.lit(0.0))
        return Value(total if kind == "sum" else total / F.greatest(F.count(x), F.lit(1)).cast("double"), "n")

    return build


def _all(args, pick) -> Value:
    """AND and OR: texts that are no numbers don't count."""
    tests = [truth(a) for a in args]
    out = F.coalesce(tests[0], F.lit(pick))
    for t in tests[1:]:
        out = out & F.coalesce(t, F.lit(pick)) if pick else out | F.coalesce(t, F.lit(pick))
    return Value(out, "b")


def _if(args, _) -> Value:
    yes, no = args[1], args[2] if len(args) > 2 else Value(F.lit(None), args[1].kind)
    if yes.kind == no.kind:
        return Value(F.when(truth(args[0]), yes.column).when(~truth(args[0]), no.column), yes.kind)
    return Value(F.when(truth(args[0]), shown(yes)).when(~truth(args[0]), shown(no)), "t")


def _square_root(args, _) -> Value:
    x = number(args[0])
    return Value(F.when(x >= 0, F.sqrt(x)), "n")


def _digits(args, literal) -> Value:
    return Value(excel_round(number(args[0]), int(float(literal[1])) if len(args) > 1 and literal[1] else 0), "n")


FUNCTIONS = {
    "SUM": _sum,
    "COUNT": _count,
    "AVERAGE": _average,
    "MIN": lambda a, _: Value(F.least(*[F.min(number(x)) for x in a]) if len(a) > 1 else F.min(number(a[0])), "n"),
    "MAX": lambda a, _: Value(F.greatest(*[F.max(number(x)) for x in a]) if len(a) > 1 else F.max(number(a[0])), "n"),
    "COUNTA": lambda a, _: Value(sum((F.count(x.column) for x in a), F.lit(0)).cast("double"), "n"),
    "COUNTIF": _conditional("count", False),
    "COUNTIFS": _conditional("count", True),
    "SUMIF": _conditional("sum", False),
    "SUMIFS": _conditional("sum", True),
    "AVERAGEIF": _conditional("average", False),
    "AVERAGEIFS": _conditional("average", True),
    "LEN": lambda a, _: Value(F.char_length(shown(a[0])).cast("double"), "n"),
    "TRIM": lambda a, _: Value(excel_trim(shown(a[0])), "t"),
    "CONCAT": lambda a, _: Value(F.concat(*map(shown, a)), "t"),
    "CONCATENATE": lambda a, _: Value(F.concat(*map(shown, a)), "t"),
    "ABS": lambda a, _: Value(F.abs(number(a[0])), "n"),
    "SQRT": _square_root,
    "ROUND": _digits,
    "AND": lambda a, _: _all(a, True),
    "OR": lambda a, _: _all(a, False),
    "NOT": lambda a, _: Value(~truth(a[0]), "b"),
    "IF": _if,
}


def formula(text: str, df: DataFrame) -> Column:
    """The formula over the columns of ``df``, which its names mean without case."""
    kinds = {k.lower(): (k, "t" if v == "string" else "b" if v == "boolean" else "n") for k, v in df.dtypes}

    def named(word: str) -> Value:
        if word.lower() not in kinds:
            raise ValueError(f"no column {word}")
        name, kind = kinds[word.lower()]
        return Value(F.col(f"`{name}`"), kind)

    return _Parser(text, named).whole().column
