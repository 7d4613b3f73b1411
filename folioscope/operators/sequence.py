"""Row numbers without a global window, and what is built on them: pages, even samples, tiles, segments."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.rollups import read

#: Parts of the key's range that are numbered side by side.
PARTS = 256


def numbered_rows(df: DataFrame, key: str, to: str = "row_no", nulls_last: bool = False) -> DataFrame:
    """``df`` with each row's place from 0 in the order of ``key``, nulls first unless ``nulls_last``.

    The key's range is cut at approximate quantiles; the parts are counted and each is
    numbered by itself from the number of rows before it, so no task sorts the whole table.
    Rows that share a key are numbered in any order, in one part.
    """
    cuts = df.agg(F.percentile_approx(key, F.array(*[F.lit(i / PARTS) for i in range(1, PARTS)]), 10_000)).first()[0] or []
    cuts = sorted(set(cuts))  # at most PARTS values
    part = F.lit(0)
    if cuts:
        bounds = F.array(*map(F.lit, cuts))
        part = F.when(F.col(key).isNull(), len(cuts) + 2 if nulls_last else 0).otherwise(1 + F.size(F.filter(bounds, lambda b: b < F.col(key))))
    parted = df.withColumn("_part", part.cast("int"))
    sizes = dict(map(tuple, parted.groupBy("_part").count().collect()))  # at most PARTS + 1 rows
    numbers = sorted(sizes)
    before = dict(zip(numbers, accumulate([0, *(sizes[n] for n in numbers)]), strict=False))
    offset = F.lit(0).cast("long")
    if before:
        offset = F.element_at(F.map_from_arrays(F.array(*map(F.lit, before)), F.array(*[F.lit(v).cast("long") for v in before.values()])), F.col("_part"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    return parted.withColumn(to, offset + place).drop("_part")


def evenly(df: DataFrame, key: str, quota: int) -> DataFrame:
    """(i, the columns of ``df``) of the rows floor(i * total / quota), i below the quota, in the order of ``key``.

    Whether a row is one of them follows from its number, so nothing is joined.  Of a table with
    fewer rows than the quota all are taken, each once.
    """
    total = df.count()
    rows = numbered_rows(df, key)
    if total <= quota:
        return rows.select(F.col("row_no").alias("i"), *df.columns)
    i = F.expr(f"(row_no * {quota}L + {total - 1}L) div {total}L")
    return rows.withColumn("i", i).where(F.expr(f"(i * {total}L) div {quota}L = row_no and i < {quota}")).select("i", *df.columns)


def pages_of(df: DataFrame, key: str, rows: int = 100, nulls_last: bool = False) -> DataFrame:
    """``df`` with the page of each row, from 0, in the order of ``key``."""
    return numbered_rows(df, key, nulls_last=nulls_last).withColumn("page", F.expr(f"row_no div {rows}")).drop("row_no")


def column_pages(df: DataFrame, column: str = "col", columns: int = 32) -> DataFrame:
    """Cells with the page of their column (numbers from 1), and their place in it."""
    return df.withColumn("column_page", F.expr(f"({column} - 1) div {columns}")).withColumn("column_in_page", F.expr(f"({column} - 1) % {columns}"))


def tiles(df: DataFrame, by: str, order: str, width: str, room: float, most: int) -> DataFrame:
    """(by, order, tile): consecutive items of a group in tiles; a new one begins where the width or
    the number of items would be too much.

    The restart depends on all items before, so a group (the columns of one sheet) is folded in one row.
    """
    item = F.struct(F.col(order).alias("o"), F.col(width).cast("double").alias("w"))
    start = F.struct(F.lit(0.0).alias("used"), F.lit(0).alias("n"), F.lit(0).alias("tile"), F.array().cast("array<struct<o:bigint,tile:int>>").alias("out"))

    def step(s, x):
        full = (s["n"] > 0) & ((s["used"] + x["w"] > room) | (s["n"] >= most))
        tile = s["tile"] + full.cast("int")
        made = F.array_append(s["out"], F.struct(x["o"].cast("bigint").alias("o"), tile.alias("tile")))
        return F.struct(F.when(full, x["w"]).otherwise(s["used"] + x["w"]).alias("used"), F.when(full, 1).otherwise(s["n"] + 1).alias("n"), tile.alias("tile"), made.alias("out"))

    folded = df.groupBy(by).agg(F.array_sort(F.collect_list(item)).alias("items")).select(by, F.inline(F.aggregate("items", start, step)["out"]))
    return folded.select(by, F.col("o").alias(order), "tile")


def levels(df: DataFrame, by: str, order: str, level: str, deepest: int = 9) -> DataFrame:
    """(by, order, label): list numbers such as 2.1.3; a level starts anew after any shallower one."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    parts = []
    out = df.select(by, order, F.col(level).alias("level"))
    for k in range(1, deepest + 1):
        out = out.withColumn(f"reset{k}", F.sum((F.col("level") < k).cast("int")).over(w))
    for k in range(1, deepest + 1):
        inner = Window.partitionBy(by, f"reset{k}").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn(f"n{k}", F.sum((F.col("level") == k).cast("int")).over(inner))
        parts.append(F.when(F.col("level") >= k, F.greatest(F.col(f"n{k}"), F.lit(1)).cast("string")))
    return out.select(by, order, F.concat_ws(".", *parts).alias("label"))


def even_sample(spark, sf_dir: str, quota: int = 500) -> DataFrame:
    """Rows floor(i * total / quota) of the orders by key, whatever the keys are."""
    return evenly(read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", quota)


def table_pages(spark, sf_dir: str, rows: int = 100) -> DataFrame:
    """Rows in pages of a fixed number, in the order of their key."""
    e = pages_of(read(spark, sf_dir, "events").select("event_id"), "event_id", rows)
    return e.groupBy("page").agg(F.count("*").alias("rows"), F.min("event_id").alias("first_row"), F.max("event_id").alias("last_row"))


def greedy_tiles(spark, sf_dir: str) -> DataFrame:
    """Lines of an order in tiles of at most 60 units and three lines."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_quantity")
    # a line number may repeat in an order: its widths are one item's
    li = li.groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("l_quantity"))
    return tiles(li, "l_orderkey", "l_linenumber", "l_quantity", 60.0, 3).groupBy("l_orderkey", "tile").agg(F.count("*").alias("items"), F.min("l_linenumber").alias("first_line"))


def list_labels(spark, sf_dir: str) -> DataFrame:
    """Turns as list items on two levels: users' on the first, others' below it."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", 1).otherwise(2).alias("lv"))
    return levels(c.distinct(), "conv_id", "turn", "lv", 2)


def column_slices(spark, sf_dir: str) -> DataFrame:
    """Cells of a wide table by row page and column page: what each page holds.

    Rows get their page before they are cut into cells, so cells aren't joined or moved but counted where they arise.
    """
    p = pages_of(read(spark, sf_dir, "part").select("p_partkey"), "p_partkey", nulls_last=True)
    paged = column_pages(p.withColumn("col", F.explode(F.sequence(F.lit(1), F.lit(40)))))
    return paged.groupBy("page", "column_page").agg(F.count("*").alias("cells"), F.min("p_partkey").alias("first_key"), F.max("col").alias("last_col"))


QUERIES = {n: globals()[n] for n in ("even_sample", "table_pages", "greedy_tiles", "list_labels", "column_slices")}
ORACLES = {
    "even_sample": "WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS k, count(*) OVER () AS n FROM orders) SELECT i::BIGINT AS i, o_orderkey FROM range(500) r(i) JOIN o ON k = (i * n) // 500",
    "table_pages": "SELECT (k // 100)::BIGINT AS page, count(*) AS rows, min(event_id) AS first_row, max(event_id) AS last_row FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS k FROM events) GROUP BY 1",
    "greedy_tiles": """WITH RECURSIVE g AS (SELECT l_orderkey, l_linenumber::BIGINT AS line, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2),
l AS (SELECT l_orderkey, line AS l_linenumber, w, row_number() OVER (PARTITION BY l_orderkey ORDER BY line) AS rn FROM g),
f AS (SELECT l_orderkey, l_linenumber, rn, w AS used, 1 AS n, 0 AS tile FROM l WHERE rn = 1
  UNION ALL SELECT l.l_orderkey, l.l_linenumber, l.rn, CASE WHEN f.used + l.w > 60 OR f.n >= 3 THEN l.w ELSE f.used + l.w END, CASE WHEN f.used + l.w > 60 OR f.n >= 3 THEN 1 ELSE f.n + 1 END, f.tile + CASE WHEN f.used + l.w > 60 OR f.n >= 3 THEN 1 ELSE 0 END
  FROM f JOIN l ON l.l_orderkey = f.l_orderkey AND l.rn = f.rn + 1)
SELECT l_orderkey, tile::INT AS tile, count(*) AS items, min(l_linenumber) AS first_line FROM f GROUP BY 1, 2""",
    "list_labels": """WITH c AS (SELECT DISTINCT conv_id, turn, CASE WHEN role = 'user' THEN 1 ELSE 2 END AS lv FROM conversations),
a AS (SELECT *, sum(CASE WHEN lv = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS n1 FROM c),
b AS (SELECT *, sum(CASE WHEN lv = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, n1 ORDER BY turn) AS n2 FROM a)
SELECT conv_id, turn, CASE WHEN lv = 1 THEN n1::BIGINT::VARCHAR ELSE greatest(n1, 1)::BIGINT || '.' || n2::BIGINT END AS label FROM b""",
    "column_slices": """WITH k AS (SELECT p_partkey, (row_number() OVER (ORDER BY p_partkey) - 1) // 100 AS page FROM part)
SELECT page::BIGINT AS page, ((c - 1) // 32)::BIGINT AS column_page, count(*) AS cells, min(p_partkey) AS first_key, max(c)::INT AS last_col FROM k, range(1, 41) r(c) GROUP BY 1, 2""",
}
