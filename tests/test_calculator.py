"""Stack programs against a plain machine, pieces and line breaks by hand."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from folioscope.functions import calculator as K
from folioscope.functions import shapes as S
from folioscope.functions.sheetformula import formula
from folioscope.operators import calculations


def test_stack_programs(spark):
    df = spark.createDataFrame([(3.0, -2.0), (10.0, 4.0), (0.5, 0.25)], "x double, y double")
    run = lambda text: [tuple(r) for r in df.select(*[c.cast("double").alias(f"c{i}") for i, c in enumerate(K.stack_program(text, [df.x, df.y]))]).collect()]
    assert run("{ add }") == [(1.0,), (14.0,), (0.75,)]
    assert run("{ exch 2 copy sub }") == [(-2.0, 3.0, -5.0), (4.0, 10.0, -6.0), (0.25, 0.5, -0.25)]
    assert run("{ 1 2 3 4 5 3 1 roll pop pop pop 2 copy pop pop pop pop }") == [(3.0, -2.0), (10.0, 4.0), (0.5, 0.25)]
    assert run("{ pop 3 idiv 7 5 xor 1 bitshift true false or { 1 } { 2 } ifelse }") == [(1.0, 4.0, 1.0), (3.0, 4.0, 1.0), (0.0, 4.0, 1.0)]
    assert run("{ 0 lt { neg } if -2.5 round }") == [(-3.0, -2.0), (10.0, -2.0), (0.5, -2.0)]
    assert [round(a, 9) for (a,) in run("{ pop pop 1 0 atan 30 sin mul 2 3 exp div 100 log add }")] == [90 * 0.5 / 8 + 2] * 3
    for bad in ("{ add add add }", "add", "{ x }", "{ true { 1 } if }", "{ 1 { 2 } if }"):
        with pytest.raises(ValueError):
            K.stack_program(bad, [df.x])


def test_pieces(spark):
    df = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 0.25, 0.5, 0.75, 1.0, 2.0)], "x double")
    got = [r[0] for r in df.select(K.sampled(df.x, [0.0, 1.0, 0.0])).collect()]
    assert got == [0.0, 0.0, 0.5, 1.0, 0.5, 0.0, 0.0]
    got = [r[0] for r in df.select(K.stitched(df.x, [lambda t: t, lambda t: 10 + t], [0.5], encode=[(0, 1), (1, 0)])).collect()]
    assert got == [0.0, 0.0, 0.5, 11.0, 10.5, 10.0, 10.0]


def test_lines(spark):
    def plain(words, room):
        lines, line = [], ""
        width = lambda t: sum(1.0 if "一" <= c <= "鿿" else 0.3 if c == " " else 0.55 for c in t)
        for w in words:
            joined = f"{line} {w}" if line else w
            if line and width(joined) > room:
                lines.append(line)
                line = w
            else:
                line = joined
        return lines + ([line] if line else [])

    r = random.Random(1)
    cases = [" ".join("x" * r.randrange(1, 9) for _ in range(r.randrange(12))) for _ in range(60)]
    got = [x[0] for x in spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, s string").orderBy("i").select(K.wrapped(F.col("s"), 1.0, 7.0)).collect()]
    assert got == [plain(c.split(), 7.0) for c in cases]
    one = lambda s, room: spark.range(1).select(K.wrapped(F.lit(s), 1.0, room)).first()[0]
    assert one("日本語テ", 2.0) == ["日本", "語テ"] and one("  a   b ", 9.0) == ["a b"] and one("", 9.0) == []


def test_formulas(spark):
    df = spark.createDataFrame([(2.0, "12", "  a  b "), (-3.5, "x", None)], "a double, s string, t string")
    one = lambda f: [r[0] for r in df.select(formula(f, df)).collect()]
    assert one("=-2^2") == [4.0, 4.0] and one("2^3^2") == [512.0, 512.0] and one("=a*10%")[0] == 0.2 and one("=1/0") == [None, None]
    assert one('=IF(a>0,LEN(t),"neg")') == ["7", "neg"] and one("=CONCAT(TRIM(t);a;TRUE)") == ["a b2TRUE", "-3.5TRUE"]
    assert one('=s<>"X"') == [True, False] and one("=SQRT(a)")[1] is None and one("=ROUND(a,-1)") == [0.0, 0.0] and one("=_xlfn.ABS(A)") == [2.0, 3.5]
    for bad in ("=SUM(", "=a b", "=nothing", "=LEN()", "=FOO(1)", "=(1", "=" + "(" * 70 + "1" + ")" * 70):
        with pytest.raises(ValueError):
            formula(bad, df)


def test_number_codes_equal_sql_on_odd_balances(spark, tmp_path):
    balances = [0.0, -0.0, None, 0.125, 2.675, 0.005, -0.004, -0.005, 999.995, -1234567.125, 2.0**50 + 0.125, 2.0**53 + 2, -(2.0**55), 7098040087340785.0]
    rows = [(2**53 + 1 if i == 4 else None if i == 5 else i * 99_999, b) for i, b in enumerate(balances)]
    spark.createDataFrame(rows, "c_custkey long, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    got = sorted(map(tuple, calculations.number_codes(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted(con.execute(calculations.ORACLES["number_codes"]).fetchall(), key=repr)


def test_decimals_of_the_exact_double(spark):
    draw = random.Random(7)
    values = [0.5, 1.5, 2.5, 0.0005, -0.0005, 0.0015, 5e-324, 2.0**52 + 0.5, 2.0**53 - 1, -(2.0**62)]
    values += [draw.choice((-1, 1)) * (draw.randint(0, 10**6) * 10 + 5) / 10 ** draw.randint(1, 9) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (0, 2, 3):
        assert all(r[1] == f"{r[0]:.{k}f}" and r[2] == f"{r[0]:,.{k}f}" for r in df.select("x", S.fixed(df.x, k), S.fixed(df.x, k, True)).collect())
