"""Functions that pages define, as Columns: stack programs, samples, powers and pieces; and greedy line breaks.

A stack program is run once, over Columns instead of numbers: what it leaves on the stack
are expressions.  Numbers that it pushes stay numbers, as ``roll`` and the like need them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNARY = {
    "abs": F.abs, "neg": lambda x: -x, "ceiling": lambda x: F.ceil(x).cast("double"), "floor": lambda x: F.floor(x).cast("double"), "round": lambda x: F.floor(x + 0.5).cast("double"), "truncate": lambda x: (F.signum(x) * F.floor(F.abs(x))).cast("double"), "cvi": lambda x: (F.signum(x) * F.floor(F.abs(x))).cast("double"), "cvr": lambda x: x,
    "sqrt": F.sqrt, "sin": lambda x: F.sin(F.radians(x)), "cos": lambda x: F.cos(F.radians(x)), "ln": F.ln, "log": F.log10,
}
_BINARY = {
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: F.when(b != 0, a / b), "idiv": lambda a, b: F.when(b != 0, F.signum(a / b) * F.floor(F.abs(a / b))), "mod": lambda a, b: F.when(b != 0, a % b), "exp": F.pow,
    "atan": lambda a, b: F.pmod(F.degrees(F.atan2(a, b)), F.lit(360.0)),
}
_COMPARED = {"eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b}
_LOGIC = {"and": (lambda a, b: a & b, lambda a, b: a.cast("long").bitwiseAND(b.cast("long"))), "or": (lambda a, b: a | b, lambda a, b: a.cast("long").bitwiseOR(b.cast("long"))), "xor": (lambda a, b: a != b, lambda a, b: a.cast("long").bitwiseXOR(b.cast("long")))}


class _Truth:
    def __init__(self, column: Column):
        self.column = column


def _col(v) -> Column:
    return v.column if isinstance(v, _Truth) else v if isinstance(v, Column) else F.lit(float(v))


def _blocks(tokens: list[str], at: int) -> tuple[list, int]:
    out: list = []
    while at < len(tokens):
        t = tokens[at]
        at += 1
        if t == "{":
            inner, at = _blocks(tokens, at)
            out.append(inner)
        elif t == "}":
            return out, at
        else:
            out.append(t)
    return out, at


def _integer(v) -> int:
    if isinstance(v, (Column, _Truth)) or v != int(v):
        raise ValueError("a count must be a whole number of the program")
    return int(v)


def _run(program: list, stack: list) -> list:
    for k, t in enumerate(program):
        if isinstance(t, list):
            continue  # belongs to the word after it
        if re.fullmatch(r"[-+]?(\d+\.?\d*|\.\d+)", t):
            stack.append(float(t))
        elif t in ("true", "false"):
            stack.append(_Truth(F.lit(t == "true")))
        elif t in _UNARY:
            v = stack.pop()
            if t == "neg" and not isinstance(v, Column):
                stack.append(-v)
            else:
                stack.append(_UNARY[t](_col(v)))
        elif t in _BINARY:
            b, a = stack.pop(), stack.pop()
            stack.append(_BINARY[t](_col(a), _col(b)))
        elif t in _COMPARED:
            b, a = stack.pop(), stack.pop()
            stack.append(_Truth(_COMPARED[t](_col(a), _col(b))))
        elif t in _LOGIC:
            b, a = stack.pop(), stack.pop()
            both = isinstance(a, _Truth) and isinstance(b, _Truth)
            v = _LOGIC[t][0 if both else 1](_col(a), _col(b))
            stack.append(_Truth(v) if both else v.cast("double"))
        elif t == "not":
            v = stack.pop()
            stack.append(_Truth(~v.column) if isinstance(v, _Truth) else F.bitwise_not(_col(v).cast("long")).cast("double"))
        elif t == "bitshift":
            n, v = _integer(stack.pop()), _col(stack.pop()).cast("long")
            stack.append((F.shiftleft(v, n) if n >= 0 else F.shiftright(v, -n)).cast("double"))
        elif t == "pop":
            stack.pop()
        elif t == "exch":
            stack[-1], stack[-2] = stack[-2], stack[-1]
        elif t == "dup":
            stack.append(stack[-1])
        elif t == "copy":
            n = _integer(stack.pop())
            stack += stack[len(stack) - n :] if n else []
        elif t == "index":
            stack.append(stack[-1 - _integer(stack.pop())])
        elif t == "roll":
            j, n = _integer(stack.pop()), _integer(stack.pop())
            if n:
                part = stack[len(stack) - n :]
                j %= n
                stack[len(stack) - n :] = part[n - j :] + part[: n - j]
        elif t in ("if", "ifelse"):
            test = stack.pop()
            if not isinstance(test, _Truth):
                raise ValueError("if without a truth")
            yes = _run(program[k - 1] if t == "if" else program[k - 2], list(stack))
            no = _run(program[k - 1], list(stack)) if t == "ifelse" else list(stack)
            if len(yes) != len(no):
                raise ValueError("branches leave stacks of two depths")
            merged = []
            for a, b in zip(yes, no, strict=True):
                if a is b:
                    merged.append(a)
                elif isinstance(a, _Truth):
                    merged.append(_Truth(F.when(test.column, _col(a)).otherwise(_col(b))))
                else:
                    merged.append(F.when(test.column, _col(a)).otherwise(_col(b)))
            stack[:] = merged
        else:
            raise ValueError(f"word {t}")
    return stack


def stack_program(text: str, inputs: list[Column]) -> list[Column]:
    """What a program in braces leaves of its inputs."""
    program, _ = _blocks(re.findall(r"[{}]|[^\s{}]+", re.sub(r"%[^\n]*", "", text)), 0)
    if len(program) != 1 or not isinstance(program[0], list):
        raise ValueError("a program stands in braces")
    try:
        return [_col(v) for v in _run(program[0], [c.cast("double") for c in inputs])]
    except IndexError:
        raise ValueError("the stack is empty") from None


def power(x: Column, low: list[float], high: list[float], n: float) -> list[Column]:
    """low + x ** n * (high - low)."""
    return [F.lit(float(a)) + F.pow(x, F.lit(float(n))) * (b - a) for a, b in zip(low, high, strict=True)]


def sampled(x: Column, samples: list[float], domain: tuple[float, float] = (0.0, 1.0)) -> Column:
    """Linear between evenly spaced samples; outside the domain its ends."""
    last = len(samples) - 1
    place = (F.greatest(F.lit(float(domain[0])), F.least(F.lit(float(domain[1])), x)) - domain[0]) / (domain[1] - domain[0]) * last
    values = F.array(*[F.lit(float(s)) for s in samples])
    i = F.least(F.floor(place), F.lit(max(0, last - 1))).cast("int")
    return F.get(values, i) + (F.get(values, F.least(i + 1, F.lit(last))) - F.get(values, i)) * (place - i)


def stitched(x: Column, pieces: list, bounds: list[float], domain: tuple[float, float] = (0.0, 1.0), encode: list[tuple[float, float]] | None = None) -> Column:
    """The piece (a function of a Column) whose part of the domain holds x, its part mapped to ``encode``."""
    edges = [domain[0], *bounds, domain[1]]
    x = F.greatest(F.lit(float(domain[0])), F.least(F.lit(float(domain[1])), x))
    out = None
    for k in reversed(range(len(pieces))):
        lo, hi = edges[k], edges[k + 1]
        a, b = encode[k] if encode else (0.0, 1.0)
        value = pieces[k](a + (x - lo) * ((b - a) / (hi - lo) if hi != lo else 0.0))
        out = value if out is None else F.when(x < hi, value).otherwise(out)
    return out


def text_width(s: Column, size: float = 1.0) -> Column:
    """An estimate: wide characters take the size, blanks 0.3 of it, others 0.55."""
    wide = F.regexp_count(s, F.lit(r"[\x{1100}-\x{115F}\x{2E80}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{FF00}-\x{FF60}\x{1F300}-\x{1FAFF}]"))
    blank = F.regexp_count(s, F.lit(r"\s"))
    return (wide + blank * 0.3 + (F.char_length(s) - wide - blank) * 0.55) * size


def wrapped(s: Column, size: float, room: float) -> Column:
    """Lines filled greedily by estimated width: words between blanks, wide characters each by itself
    and without a blank; what is wider than a line stands alone."""
    tokens = F.regexp_extract_all(s, F.lit(r"([\x{2E80}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{FF00}-\x{FF60}]|[^\s\x{2E80}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{FF00}-\x{FF60}]+|\s+)"), F.lit(1))
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("line"))

    def step(a, t):
        joined = F.concat(a["line"], t)
        fits = text_width(F.rtrim(joined), size) <= room
        blank = F.trim(t) == ""
        kept = F.when(blank & (a["line"] == ""), F.lit("")).otherwise(F.when(blank, F.concat(a["line"], F.lit(" "))).otherwise(joined))
        broken = ~fits & ~blank & (F.trim(a["line"]) != "")
        return F.struct(F.when(broken, F.array_append(a["lines"], F.rtrim(a["line"]))).otherwise(a["lines"]).alias("lines"), F.when(broken, t).otherwise(kept).alias("line"))

    return F.aggregate(tokens, start, step, lambda a: F.when(F.trim(a["line"]) != "", F.array_append(a["lines"], F.rtrim(a["line"]))).otherwise(a["lines"]))

