"""Queries of the formula language, number and date formats, colours and geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calculator as K
from ..functions import shapes as S
from ..functions.sheetformula import formula
from ..plans.rollups import read


def formula_aggregates(spark, sf_dir: str) -> DataFrame:
    """Every range function of the language by brand; empty ranges sum, count and average to 0, have no ends."""
    p = read(spark, sf_dir, "part").withColumn("none", F.when(F.col("p_size") > 99, F.col("p_size")))
    cents = lambda t: F.floor(formula(t, p) * 100 + 0.5).cast("long")
    whole = lambda t: formula(t, p).cast("long")
    return p.groupBy("p_brand").agg(
        cents("=SUM(p_retailprice)").alias("sum"), cents("=AVERAGE(p_size)").alias("average"), cents("=MIN(p_retailprice)").alias("least"), cents("=MAX(p_retailprice,p_size)").alias("largest"),
        whole("=COUNT(p_size,p_name)").alias("count"), whole("=COUNTA(p_name;p_type)").alias("counta"), whole('=COUNTIFS(p_size,">=25",p_type,"*e*")').alias("countifs"), whole('=COUNTIF(p_type,"<>*a*")').alias("countif"),
        cents('=SUMIF(p_size,">25",p_retailprice)').alias("sumif"), cents('=SUMIFS(p_retailprice,p_size,"<=10",p_type,"*s*")').alias("sumifs"), cents('=AVERAGEIF(p_size,">40")').alias("averageif"), cents('=AVERAGEIFS(p_retailprice,p_size,">1e9")').alias("averageifs_none"),
        cents("=SUM(none)+AVERAGE(none)").alias("empty"), whole("=MIN(none)").alias("no_least"), cents("=SUM(p_retailprice)/COUNT(p_size)*10%").alias("tenth"),
    )


def formula_scalars(spark, sf_dir: str) -> DataFrame:
    """Scalar functions and operators of the language for each part; what fails is null."""
    p = read(spark, sf_dir, "part")
    c = lambda t: formula(t, p)
    return p.select(
        "p_partkey", c("=LEN(p_name)").cast("long").alias("len"), c('=TRIM(CONCAT("  ",p_brand,"   ",p_size," "))').alias("joined"), c("=-2^2+p_size").cast("long").alias("signed"), c("=2^3^2").cast("long").alias("right"),
        F.floor(c("=ROUND(p_retailprice,-1)") + 0.5).cast("long").alias("tens"), c('=IF(p_size>25,"big",IF(p_size=25,"even","small"))').alias("size"), c("=AND(p_size>10,OR(p_size<20,NOT(p_size<40)))").alias("logic"),
        c("=p_size/0").cast("long").alias("failed"), c("=SQRT(25-p_size)").isNull().alias("no_root"), c('=p_brand="BRAND#1"').alias("same_text"), F.floor(c("=ABS(p_size-25)*50%*10") + 1e-9).cast("long").alias("half"),
    )


def number_codes(spark, sf_dir: str) -> DataFrame:
    """Balances by number format codes."""
    c, v = read(spark, sf_dir, "customer"), F.col("c_acctbal")
    return c.select("c_custkey", S.number_format(v, 2).alias("plain"), S.number_format(v, 4).alias("grouped"), S.number_format(v, 7).alias("money"), S.number_format(F.floor(v).cast("decimal(20,0)") / 100, 9).alias("percent"), S.number_format(F.col("c_custkey"), "000000").alias("padded"))


def date_codes(spark, sf_dir: str) -> DataFrame:
    """Day numbers of orders by date format codes, and of the 1904 system."""
    o = read(spark, sf_dir, "orders")
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1899-12-30")) + F.lit(0.75)
    return o.select("o_orderkey", S.date_format(day, 14).alias("short"), S.date_format(day, 15).alias("named"), S.date_format(day, 22).alias("moment"), S.date_format(day, 18).alias("half_day"), S.date_format(day, "yyyy-mm-dd hh:mm:ss").alias("iso"), S.date_format(day, 46).alias("elapsed"), S.date_format(day - 1462, "yyyy-mm-dd", True).alias("from_1904"))


def list_numbers(spark, sf_dir: str) -> DataFrame:
    """Roman and letter numbers, and references both ways."""
    s = read(spark, sf_dir, "supplier")
    from ..functions.formulas import column_name

    n = F.col("s_suppkey") % 3999 + 1
    ref = F.concat(column_name(n), F.lit("$"), n.cast("string"))
    return s.select("s_suppkey", S.roman(n).alias("roman"), S.letters(n % 78 + 1).alias("letter"), S.cell_column(ref).alias("col"), S.cell_row(ref).alias("row"))


def colour_blends(spark, sf_dir: str) -> DataFrame:
    """Colours read, and mixed by size."""
    p = read(spark, sf_dir, "part")
    a, b = S.hex_colour(F.lit("#0f8")), S.hex_colour(F.lit("#102030"))
    return p.select("p_partkey", S.blend(a, b, F.col("p_size") / 50).alias("mixed"), F.array_join(a, ",").alias("parsed"), S.hex_colour(F.col("p_brand")).isNull().alias("no_colour"))


def printed_numbers(spark, sf_dir: str) -> DataFrame:
    """Numbers as a page writes them, escaped and cut texts, masked addresses."""
    p = read(spark, sf_dir, "pages")
    return p.select("page_id", S.printed(F.col("page_id") / 8, 3).alias("number"), S.xml_escape(F.concat("url", F.lit('<"&\n')), True).alias("escaped"), S.truncated(F.col("url"), 12).alias("cut"), S.masked_uri(F.col("url")).alias("masked"), S.cell_text(F.concat(F.lit("a\r\nb\t"), "url"), 9).alias("cell"))


def map_points(spark, sf_dir: str) -> DataFrame:
    """Points moved by a composed matrix, back from map metres, and within a ring."""
    p = read(spark, sf_dir, "part")
    x, y = F.col("p_size").cast("double"), (F.col("p_partkey") % 60).cast("double")
    tx, ty = S.transformed(S.composed((2, 0, 0, 2, 10, 0), (0, 1, -1, 0, 0, 5)), x, y)
    lon, lat = S.mercator_inverse(x * 100_000, y * 100_000)
    ring = [F.array(*[F.lit(float(v)) for v in vs]) for vs in ((0, 40, 40, 20, 0, 0), (0, 0, 40, 20, 40, 0))]
    return p.select("p_partkey", tx.cast("long").alias("tx"), ty.cast("long").alias("ty"), F.floor(lon * 1000).alias("lon"), F.floor(lat * 1000).alias("lat"), S.in_ring(x + 0.5, y + 0.25, *ring).alias("inside"), S.ring_area(*ring).cast("long").alias("area"))


def page_functions(spark, sf_dir: str) -> DataFrame:
    """Stack programs, samples, powers and pieces over the sizes of parts."""
    p = read(spark, sf_dir, "part")
    x, y = F.col("p_size").cast("double"), (F.col("p_partkey") % 7).cast("double")
    first, second = K.stack_program("{ 2 copy add 3 1 roll exch sub dup 0 lt { neg } if }", [x, y])
    (chosen,) = K.stack_program("{ 1 index 25 gt 2 index 10 mod 3 eq or { pop 2 mul } { exch pop 1 add } ifelse cvi }", [x, y])
    milli = lambda c: F.floor(c * 1000 + 0.25).cast("long")
    pieces = K.stitched(x / 50, [lambda t: K.power(t, [0.0], [1.0], 2)[0], lambda t: K.sampled(t, [1.0, 0.5, 0.75])], [0.4])
    return p.select("p_partkey", first.cast("long").alias("total"), second.cast("long").alias("apart"), chosen.cast("long").alias("chosen"), milli(K.sampled(x, [0, 10, 5, 20], (0, 60))).alias("sampled"), milli(K.power(x / 50, [1.0, 0.0], [0.0, 2.0], 3)[1]).alias("power"), milli(pieces).alias("pieces"))


def wrapped_names(spark, sf_dir: str) -> DataFrame:
    """Names of parts with their brand and type in lines of limited width."""
    p = read(spark, sf_dir, "part")
    lines = K.wrapped(F.concat_ws("  ", "p_brand", "p_type"), 10.0, 60.0)
    return p.select("p_partkey", F.array_join(lines, "|").alias("lines"), F.floor(K.text_width(F.col("p_name"), 10.0) * 10 + 0.5).cast("long").alias("width"))


QUERIES = {n: globals()[n] for n in ("page_functions", "wrapped_names", "formula_aggregates", "formula_scalars", "number_codes", "date_codes", "list_numbers", "colour_blends", "printed_numbers", "map_points")}
ORACLES = {
    "page_functions": """WITH v AS (SELECT p_partkey, p_size::DOUBLE AS x, (p_partkey % 7)::DOUBLE AS y, p_size / 50.0::DOUBLE AS t FROM part)
SELECT p_partkey, (x + y)::BIGINT AS total, abs(y - x)::BIGINT AS apart, (CASE WHEN x > 25 OR x % 10 = 3 THEN 2 * x ELSE y + 1 END)::BIGINT AS chosen,
  floor(CASE WHEN x < 20 THEN x / 60 * 3 * 10 WHEN x < 40 THEN 10 - (x / 60 * 3 - 1) * 5 ELSE 5 + (x / 60 * 3 - 2) * 15 END * 1000 + 0.25)::BIGINT AS sampled, floor(pow(t, 3) * 2 * 1000 + 0.25)::BIGINT AS power,
  floor(CASE WHEN least(t, 1) < 0.4::DOUBLE THEN pow(t / 0.4::DOUBLE, 2) WHEN (least(t, 1) - 0.4::DOUBLE) / 0.6::DOUBLE < 0.5 THEN 1 - (least(t, 1) - 0.4::DOUBLE) / 0.6::DOUBLE * 2 * 0.5 ELSE 0.5 + ((least(t, 1) - 0.4::DOUBLE) / 0.6::DOUBLE * 2 - 1) * 0.25 END * 1000 + 0.25)::BIGINT AS pieces FROM v""",
    "wrapped_names": """SELECT p_partkey, CASE WHEN (length(p_brand) + length(p_type)) * 5.5 + 3 <= 60 THEN p_brand || ' ' || p_type ELSE p_brand || '|' || p_type END AS lines,
  floor((length(p_name) - len(regexp_extract_all(p_name, '\\s')) * 1) * 55.0 + len(regexp_extract_all(p_name, '\\s')) * 30.0 + 0.5)::BIGINT AS width FROM part""",
    "formula_aggregates": """SELECT p_brand, floor(sum(p_retailprice) * 100 + 0.5)::BIGINT AS sum, floor(avg(p_size) * 100 + 0.5)::BIGINT AS average, floor(min(p_retailprice) * 100 + 0.5)::BIGINT AS least, floor(greatest(max(p_retailprice), max(p_size)) * 100 + 0.5)::BIGINT AS largest,
  count(p_size) + count(TRY_CAST(p_name AS DOUBLE)) AS count, count(p_name) + count(p_type) AS counta, count(*) FILTER (WHERE p_size >= 25 AND lower(p_type) LIKE '%e%') AS countifs, count(*) FILTER (WHERE lower(coalesce(p_type, '')) NOT LIKE '%a%') AS countif,
  floor(coalesce(sum(p_retailprice) FILTER (WHERE p_size > 25), 0) * 100 + 0.5)::BIGINT AS sumif, floor(coalesce(sum(p_retailprice) FILTER (WHERE p_size <= 10 AND lower(p_type) LIKE '%s%'), 0) * 100 + 0.5)::BIGINT AS sumifs,
  floor(coalesce(avg(p_size) FILTER (WHERE p_size > 40), 0) * 100 + 0.5)::BIGINT AS averageif, 0::BIGINT AS averageifs_none, 0::BIGINT AS empty, CAST(NULL AS BIGINT) AS no_least, floor(sum(p_retailprice) / count(p_size) * 0.1::DOUBLE * 100 + 0.5)::BIGINT AS tenth FROM part GROUP BY p_brand""",
    "formula_scalars": """SELECT p_partkey, length(p_name) AS len, p_brand || ' ' || p_size AS joined, 4 + p_size::BIGINT AS signed, 512::BIGINT AS right, floor(sign(p_retailprice) * floor(abs(p_retailprice) * 0.1::DOUBLE + 0.5) / 0.1::DOUBLE + 0.5)::BIGINT AS tens,
  CASE WHEN p_size > 25 THEN 'big' WHEN p_size = 25 THEN 'even' ELSE 'small' END AS size, p_size > 10 AND (p_size < 20 OR p_size >= 40) AS logic, CAST(NULL AS BIGINT) AS failed, p_size > 25 AS no_root, lower(p_brand) = 'brand#1' AS same_text, (abs(p_size - 25) * 5)::BIGINT AS half FROM part""",
    "number_codes": """SELECT c_custkey, format('{:.2f}', c_acctbal) AS plain, format('{:,.2f}', c_acctbal) AS grouped, CASE WHEN c_acctbal < 0 THEN '($' || format('{:,.2f}', -c_acctbal) || ')' ELSE '$' || format('{:,.2f}', c_acctbal) END AS money,
  floor(c_acctbal)::BIGINT || '%' AS percent, lpad(c_custkey::VARCHAR, greatest(6, length(c_custkey::VARCHAR))::INT, '0') AS padded FROM customer""",
    "date_codes": """SELECT o_orderkey, strftime(d, '%-m/%-d/%Y') AS short, strftime(d, '%-d-%b-%y') AS named, strftime(d, '%-m/%-d/%Y') || ' 18:00' AS moment, '6:00 PM' AS half_day, strftime(d, '%Y-%m-%d') || ' 18:00:00' AS iso,
  ((date_diff('day', DATE '1899-12-30', d) * 24 + 18)::BIGINT) || ':00:00' AS elapsed, strftime(d, '%Y-%m-%d') AS from_1904 FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""",
    "list_numbers": """WITH n AS (SELECT s_suppkey, s_suppkey % 3999 + 1 AS n FROM supplier)
SELECT s_suppkey, repeat('M', (n // 1000)::INT) || ['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'][(n // 100) % 10 + 1] || ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][(n // 10) % 10 + 1] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][n % 10 + 1] AS roman,
  repeat(chr(((n % 78) % 26 + 97)::INT), ((n % 78) // 26 + 1)::INT) AS letter, n AS col, n AS row FROM n""",
    "colour_blends": """SELECT p_partkey, '#' || lpad(lower(to_hex(floor(0 + (16 - 0) * t + 0.5)::BIGINT)), 2, '0') || lpad(lower(to_hex(floor(255 + (32 - 255) * t + 0.5)::BIGINT)), 2, '0') || lpad(lower(to_hex(floor(136 + (48 - 136) * t + 0.5)::BIGINT)), 2, '0') AS mixed,
  '0,255,136' AS parsed, true AS no_colour FROM (SELECT p_partkey, least(1.0, p_size / 50) AS t FROM part)""",
    "printed_numbers": """SELECT page_id, regexp_replace(regexp_replace(format('{:.3f}', page_id / 8), '(\\.\\d*?)0+$', '\\1'), '\\.$', '') AS number,
  replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '&lt;&quot;&amp;&#10;' AS escaped, CASE WHEN length(url) > 12 THEN url[1:12] || '…' ELSE url END AS cut, CASE WHEN contains(url, '://') THEN '[uri]' ELSE url END AS masked,
  CASE WHEN length('a b ' || url) > 9 THEN ('a b ' || url)[1:9] || '…' ELSE 'a b ' || url END AS cell FROM pages""",
    "map_points": """SELECT p_partkey, (-2 * y + 10)::BIGINT AS tx, (2 * x + 10)::BIGINT AS ty, floor(degrees(x * 100000 / 6378137.0::DOUBLE) * 1000)::BIGINT AS lon, floor(degrees(2 * atan(exp(y * 100000 / 6378137.0::DOUBLE)) - 1.5707963267948966::DOUBLE) * 1000)::BIGINT AS lat,
  x + 0.5 < 40 AND y + 0.25 < CASE WHEN x + 0.5 < 20 THEN 40 - (x + 0.5) ELSE x + 0.5 END AS inside, 1200::BIGINT AS area FROM (SELECT p_partkey, p_size::DOUBLE AS x, (p_partkey % 60)::DOUBLE AS y FROM part)""",
}
