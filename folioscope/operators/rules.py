"""Conditional formatting as operators: rules by priority, colour scales, data bars, range joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formulas import TOLERANCE
from ..functions.shapes import blend, hex_colour
from ..functions.sheetformula import formula
from ..plans.rollups import read


@dataclass(frozen=True)
class Rule:
    """What a rule tests, the style it gives, its priority (least first), whether it ends the list."""

    test: Column
    style: str
    priority: int = 0
    stop: bool = False


def cell_is(value: Column, op: str, a, b=None) -> Column:
    """equal, notEqual, lessThan, lessThanOrEqual, greaterThan, greaterThanOrEqual, between, notBetween;
    bounds may come in either order, equality has a tolerance, a value that is no number fits none."""
    x = value.try_cast("double")
    a = F.lit(a).cast("double") if not isinstance(a, Column) else a
    same = F.abs(x - a) <= TOLERANCE
    if op in ("between", "notBetween"):
        b = F.lit(b).cast("double") if not isinstance(b, Column) else b
        inside = x.between(F.least(a, b), F.greatest(a, b))
        return F.coalesce(inside if op == "between" else ~inside, F.lit(False))
    tests = {"equal": same, "notEqual": ~same, "lessThan": x < a, "lessThanOrEqual": x <= a, "greaterThan": x > a, "greaterThanOrEqual": x >= a}
    return F.coalesce(tests[op], F.lit(False))


def blank(value: Column) -> Column:
    return F.trim(F.coalesce(value.cast("string"), F.lit(""))) == ""


def contains_text(value: Column, text: str) -> Column:
    return F.coalesce(F.lower(value.cast("string")).contains(text.lower()), F.lit(False))


def expression(df: DataFrame, text: str) -> Column:
    """Whether a formula is true or a number other than 0."""
    return F.coalesce(formula(f"IF({text.removeprefix('=')},TRUE,FALSE)", df), F.lit(False))


def styles(rules: list[Rule]) -> Column:
    """The styles of the rules that a row fits, by priority, up to the first fitting one that stops."""
    out, stopped = F.array().cast("array<string>"), F.lit(False)
    for r in sorted(rules, key=lambda r: r.priority):
        fits = r.test & ~stopped
        out = F.when(fits, F.array_append(out, F.lit(r.style))).otherwise(out)
        stopped = stopped | (fits & F.lit(r.stop))
    return out


def ends(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """``df`` with the least and largest value of each group, joined back by whatever way Spark's sizes suggest."""
    some = df.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in by]
    return df.alias("l").join(some.alias("r"), on).select("l.*", "r.lo", "r.hi")


def share(value: Column, lo: Column, hi: Column) -> Column:
    """The value's place between the ends, a half where they are equal."""
    return F.when(hi == lo, F.lit(0.5)).otherwise((value - lo) / (hi - lo))


def colour_scale_of(df: DataFrame, by: list[str], value: str, colours: list[str], middle: float = 0.5) -> DataFrame:
    """``df`` with ``permille`` and ``colour`` on a scale of two or three colours within each group;
    ``middle`` is where the second of three lies."""
    t = share(F.col(value), F.col("lo"), F.col("hi"))
    rgb = [hex_colour(F.lit(c)) for c in colours]
    if len(rgb) == 2:
        colour = blend(rgb[0], rgb[1], t)
    else:
        colour = F.when(t <= middle, blend(rgb[0], rgb[1], t / middle)).otherwise(blend(rgb[1], rgb[2], (t - middle) / (1 - middle)))
    return ends(df, by, value).withColumn("permille", F.floor(t * 1000)).withColumn("colour", colour).drop("lo", "hi")


def data_bars(df: DataFrame, by: list[str], value: str, shortest: int = 10, longest: int = 90) -> DataFrame:
    """``df`` with ``bar_start`` and ``bar_length`` in percent of the cell.

    Of values of one sign the least has the shortest bar, the largest the longest.  Where both
    signs occur bars start at a zero line and go to either side.
    """
    v, lo, hi = F.col(value), F.col("lo"), F.col("hi")
    mixed = (lo < 0) & (hi > 0)
    zero = -lo / (hi - lo) * 100
    length = F.when(mixed, F.abs(v) / (hi - lo) * 100).otherwise(shortest + share(v, lo, hi) * (longest - shortest))
    start = F.when(mixed, F.when(v < 0, zero - F.abs(v) / (hi - lo) * 100).otherwise(zero)).otherwise(F.lit(0.0))
    return ends(df, by, value).withColumn("bar_start", start).withColumn("bar_length", length).drop("lo", "hi")


def in_ranges(cells: DataFrame, ranges: DataFrame, row: str = "row", col: str = "col") -> DataFrame:
    """Cells joined with the ranges (name, r1, r2, c1, c2; bounds included) that hold them.

    Ranges are cut into strips of 1,024 rows, on which both sides meet by equality; a range that
    spans many strips is met in each, a pair never twice.
    """
    strip = 1024
    cut = ranges.withColumn("strip", F.explode(F.sequence(F.expr(f"r1 div {strip}"), F.expr(f"r2 div {strip}"))))
    held = cells.withColumn("strip", F.expr(f"`{row}` div {strip}"))
    return held.join(cut, "strip").where(F.col(row).between(F.col("r1"), F.col("r2")) & F.col(col).between(F.col("c1"), F.col("c2"))).drop("strip")


def cell_in_range(spark, sf_dir: str) -> DataFrame:
    """Cells of a sheet counted by the ranges that hold them."""
    cells = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 100).alias("row"), F.col("p_size").cast("long").alias("col"))
    ranges = spark.createDataFrame([("head", 0, 4, 1, 50), ("left", 0, 99, 1, 5), ("box", 40, 60, 20, 30)], "range_name string, r1 long, r2 long, c1 long, c2 long")
    return in_ranges(cells, ranges).groupBy("range_name").agg(F.count("*").alias("cells"), F.sum("p_partkey").alias("keys"))


def conditional_rules(spark, sf_dir: str) -> DataFrame:
    """Balances by four rules; the first whose ``stop`` is set ends the list."""
    c, v = read(spark, sf_dir, "customer"), F.col("c_acctbal")
    rules = [Rule(cell_is(v, "lessThan", 0), "negative", 1, True), Rule(cell_is(v, "between", 100, 0), "low", 2), Rule(cell_is(v, "greaterThan", 5000), "high", 3), Rule(contains_text(F.col("c_mktsegment"), "AUTO"), "auto", 4)]
    return c.select("c_custkey", F.array_join(styles(rules), ",").alias("styles"))


def formula_rules(spark, sf_dir: str) -> DataFrame:
    """Rules by formula, blanks and text that is missing, given out of order."""
    p = read(spark, sf_dir, "part")
    rules = [Rule(~contains_text(F.col("p_type"), "steel"), "no steel", 3), Rule(expression(p, '=AND(p_size>=25,p_retailprice<1000)'), "big and cheap", 1), Rule(blank(F.col("p_name")), "blank", 0, True), Rule(~blank(F.col("p_brand")), "branded", 2), Rule(cell_is(F.col("p_size"), "notBetween", 10, 40), "odd size", 5), Rule(cell_is(F.col("p_size"), "equal", 7), "seven", 4, True)]
    return p.select("p_partkey", F.array_join(styles(rules), ",").alias("styles"))


def colour_scale(spark, sf_dir: str) -> DataFrame:
    """Two colours over each segment's balances."""
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return colour_scale_of(c, ["c_mktsegment"], "c_acctbal", ["#ff4000", "#00c080"]).select("c_custkey", "permille", "colour")


def three_colour_scale(spark, sf_dir: str) -> DataFrame:
    """Three colours over each brand's sizes, the second at two fifths."""
    p = read(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_size").cast("double").alias("size"))
    return colour_scale_of(p, ["p_brand"], "size", ["#0000ff", "#ffffff", "#ff0000"], 0.4).select("p_partkey", "permille", "colour")


def data_bar(spark, sf_dir: str) -> DataFrame:
    """Bars of balances, which have both signs, by segment, in thousandths."""
    c = data_bars(read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), ["c_mktsegment"], "c_acctbal")
    return c.select("c_custkey", F.floor(F.col("bar_start") * 10).alias("start"), F.floor(F.col("bar_length") * 10).alias("length"))


def _blended(t: str, a: tuple, b: tuple) -> str:
    part = lambda x, y: f"lpad(lower(to_hex(floor({x} + ({y} - {x}) * least(1.0, greatest(0.0, {t})) + 0.5)::BIGINT)), 2, '0')"
    return "'#' || " + " || ".join(part(x, y) for x, y in zip(a, b, strict=True))


QUERIES = {n: globals()[n] for n in ("cell_in_range", "conditional_rules", "formula_rules", "colour_scale", "three_colour_scale", "data_bar")}
_ENDS = "(SELECT {k}, CASE WHEN max({v}) OVER w = min({v}) OVER w THEN 0.5::DOUBLE ELSE ({v} - min({v}) OVER w) / (max({v}) OVER w - min({v}) OVER w) END AS t FROM {t} WINDOW w AS (PARTITION BY {by}))"
ORACLES = {
    "cell_in_range": """WITH r(range_name, r1, r2, c1, c2) AS (VALUES ('head', 0, 4, 1, 50), ('left', 0, 99, 1, 5), ('box', 40, 60, 20, 30))
SELECT range_name, count(*) AS cells, sum(p_partkey)::BIGINT AS keys FROM part JOIN r ON p_partkey % 100 BETWEEN r1 AND r2 AND p_size BETWEEN c1 AND c2 GROUP BY range_name""",
    "conditional_rules": """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'negative' ELSE array_to_string(list_filter([CASE WHEN c_acctbal BETWEEN 0 AND 100 THEN 'low' END, CASE WHEN c_acctbal > 5000 THEN 'high' END,
  CASE WHEN contains(lower(c_mktsegment), 'auto') THEN 'auto' END], lambda x: x IS NOT NULL), ',') END AS styles FROM customer""",
    "formula_rules": """SELECT p_partkey, CASE WHEN trim(coalesce(p_name, '')) = '' THEN 'blank' ELSE array_to_string(list_filter([CASE WHEN p_size >= 25 AND p_retailprice < 1000 THEN 'big and cheap' END, CASE WHEN trim(coalesce(p_brand, '')) <> '' THEN 'branded' END,
  CASE WHEN NOT contains(lower(coalesce(p_type, '')), 'steel') THEN 'no steel' END, CASE WHEN p_size = 7 THEN 'seven' END, CASE WHEN p_size <> 7 AND p_size NOT BETWEEN 10 AND 40 THEN 'odd size' END], lambda x: x IS NOT NULL), ',') END AS styles FROM part""",
    "colour_scale": f"SELECT c_custkey, floor(t * 1000)::BIGINT AS permille, {_blended('t', (255, 64, 0), (0, 192, 128))} AS colour FROM {_ENDS.format(k='c_custkey', v='c_acctbal', t='customer', by='c_mktsegment')}",
    "three_colour_scale": f"SELECT p_partkey, floor(t * 1000)::BIGINT AS permille, CASE WHEN t <= 0.4::DOUBLE THEN {_blended('t / 0.4::DOUBLE', (0, 0, 255), (255, 255, 255))} ELSE {_blended('(t - 0.4::DOUBLE) / (1 - 0.4::DOUBLE)', (255, 255, 255), (255, 0, 0))} END AS colour FROM {_ENDS.format(k='p_partkey', v='p_size::DOUBLE', t='part', by='p_brand')}",
    "data_bar": """SELECT c_custkey, floor(10 * CASE WHEN lo < 0 AND hi > 0 THEN CASE WHEN v < 0 THEN -lo / (hi - lo) * 100 - abs(v) / (hi - lo) * 100 ELSE -lo / (hi - lo) * 100 END ELSE 0.0 END)::BIGINT AS start,
  floor(10 * CASE WHEN lo < 0 AND hi > 0 THEN abs(v) / (hi - lo) * 100 WHEN hi = lo THEN 50.0 ELSE 10 + (v - lo) / (hi - lo) * 80 END)::BIGINT AS length
FROM (SELECT c_custkey, c_acctbal AS v, min(c_acctbal) OVER w AS lo, max(c_acctbal) OVER w AS hi FROM customer WINDOW w AS (PARTITION BY c_mktsegment))""",
}
