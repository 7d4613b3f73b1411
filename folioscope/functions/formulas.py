"""Spreadsheet scalars and criteria as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: numbers this close are equal to a criterion.
TOLERANCE = 1e-12


def wildcard_regex(pattern: str) -> str:
    """``*``, ``?`` and ``~`` escapes as an anchored expression on lower-cased text."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "~" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i].lower()))
        else:
            out.append({"*": ".*", "?": "."}.get(c) or re.escape(c.lower()))
        i += 1
    return "(?s)^" + "".join(out) + r"\z"


def criterion(value: Column, rule: str) -> Column:
    """COUNTIF's predicate: an operator prefix, then a number or a text with wildcards."""
    op = next((o for o in ("<=", ">=", "<>", "=", "<", ">") if rule.startswith(o)), "")
    operand = rule[len(op) :]
    op = op or "="
    try:
        number = float(operand)
    except ValueError:
        text = F.lower(value.cast("string"))
        if op in ("=", "<>"):
            same = F.coalesce(text, F.lit("")).rlike(wildcard_regex(operand))
            return same if op == "=" else ~same
        low = F.lit(operand.lower())
        return F.coalesce({"<": text < low, "<=": text <= low, ">": text > low, ">=": text >= low}[op], F.lit(False))
    x = value.try_cast("double")
    same = F.abs(x - number) <= TOLERANCE
    test = {"=": same, "<>": ~same, "<": x < number, "<=": x <= number, ">": x > number, ">=": x >= number}[op]
    return F.coalesce(test, F.lit(op == "<>"))


def excel_round(v: Column, digits: int) -> Column:
    """Half away from zero on the binary product; digits between -12 and 12."""
    scale = 10.0 ** max(-12, min(12, digits))
    return F.signum(v) * F.floor(F.abs(v) * scale + 0.5) / scale


def excel_trim(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def column_name(n: Column) -> Column:
    """Column letters of a position from 1 up to 18,278."""
    letter = lambda k: F.char((k + 65).cast("int"))
    one, two, three = n - 1, n - 27, n - 703
    return F.when(n <= 26, letter(one)).when(n <= 702, F.concat(letter(F.floor(two / 26)), letter(two % 26))).otherwise(F.concat(letter(F.floor(three / 676)), letter(F.floor(three / 26) % 26), letter(three % 26)))


def serial_date(serial: Column) -> Column:
    """The civil date of a 1900-system serial; None for the day that never was (60)."""
    days = F.floor(serial).cast("int")
    return F.when(days == 60, F.lit(None)).when(days < 60, F.date_add(F.lit("1899-12-31"), days)).otherwise(F.date_add(F.lit("1899-12-30"), days))


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Spherical Web-Mercator metres; latitudes are clamped to the map's edge."""
    r, edge = 6378137.0, 85.05112878
    y = F.radians(F.greatest(F.least(lat, F.lit(edge)), F.lit(-edge)))
    return F.radians(lon) * r, F.log(F.tan(y / 2 + 0.7853981633974483)) * r
