"""Drawings from tables: runs of pixels as rectangles, layers of graphs, text lines from places, boxes, page budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.rollups import read


def vectorised(pixels: DataFrame, image: str, threshold: float) -> DataFrame:
    """(image, x, y, width, height) of the dark pixels (image, row, col, value below the threshold):
    runs along rows, equal runs of rows below each other merged."""
    dark = pixels.where(F.col("value") < threshold)
    run = F.col("col") - F.row_number().over(Window.partitionBy(image, "row").orderBy("col"))
    runs = dark.withColumn("run", run).groupBy(image, "row", "run").agg(F.min("col").alias("x"), F.count("*").alias("width"))
    stack = F.col("row") - F.row_number().over(Window.partitionBy(image, "x", "width").orderBy("row"))
    merged = runs.withColumn("stack", stack).groupBy(image, "x", "width", "stack").agg(F.min("row").alias("y"), F.count("*").alias("height"))
    return merged.select(image, "x", "y", "width", "height")


def layers(nodes: DataFrame, edges: DataFrame, most: int = 10_000) -> DataFrame:
    """(node, layer) of a graph of nodes (node) and edges (source, target): those without an edge to
    them are on layer 0 (or the least node, where all have one), others one below the first that leads to
    them; what nothing reaches comes in layers of its own below.

    Every round is a join of the new layer with the edges; rounds are as many as layers.
    """
    spark = nodes.sparkSession
    inner = edges.where("source <> target").select("source", "target").distinct().checkpoint()
    left = nodes.select("node").distinct()
    roots = left.join(inner.select(F.col("target").alias("node")), "node", "left_anti").withColumn("layer", F.lit(0))
    done, depth = roots.checkpoint(), 0
    now = done
    while depth < most:
        if now.isEmpty():
            rest = left.join(done, "node", "left_anti")
            least = rest.agg(F.min("node")).first()[0]
            if least is None:
                return done
            depth = 0 if done.isEmpty() else done.agg(F.max("layer")).first()[0] + 1
            now = spark.createDataFrame([(least, depth)], done.schema)
        else:
            depth += 1
            reached = now.join(inner, now.node == inner.source).select(F.col("target").alias("node")).distinct()
            now = reached.join(done, "node", "left_anti").withColumn("layer", F.lit(depth)).checkpoint()
        done = done.unionByName(now).checkpoint()
    raise ValueError("too many layers")


def text_rows(spans: DataFrame, page: str, near: float = 12.0) -> DataFrame:
    """(page, row_no, cells) of texts (page, x, y, text): from top to bottom, a text less than ``near`` below the
    first of its row belongs to it; cells from left to right.

    A row begins at its own first text, so the texts of one page are folded in order.
    """
    item = F.struct(F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"), "text")
    start = F.struct(F.lit(None).cast("double").alias("top"), F.lit(-1).alias("n"), F.array().cast("array<struct<n:int,x:double,text:string>>").alias("out"))

    def step(s, i):
        new = s["top"].isNull() | (i["y"] - s["top"] >= near)
        n = s["n"] + new.cast("int")
        return F.struct(F.when(new, i["y"]).otherwise(s["top"]).alias("top"), n.alias("n"), F.array_append(s["out"], F.struct(n.alias("n"), i["x"].alias("x"), i["text"].alias("text"))).alias("out"))

    folded = spans.groupBy(page).agg(F.array_sort(F.collect_list(item)).alias("items")).select(page, F.inline(F.aggregate("items", start, step)["out"]))
    cells = F.transform(F.array_sort(F.collect_list(F.struct("x", "text"))), lambda c: c["text"])
    return folded.groupBy(page, F.col("n").alias("row_no")).agg(cells.alias("cells"))


def within_budget(pages: DataFrame, document: str, order: str, size: str, budget: int) -> DataFrame:
    """The pages of each document, in order, up to the first that would exceed its budget; whether any is left out."""
    w = Window.partitionBy(document).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(document)
    summed = pages.withColumn("used", F.sum(size).over(w)).withColumn("truncated", F.sum(size).over(every) > budget)
    return summed.where(F.col("used") <= budget)


def raster_rectangles(spark, sf_dir: str) -> DataFrame:
    """Parts as pixels of pictures of 10 x 10, their sizes as grey values."""
    p = read(spark, sf_dir, "part").select(F.expr("p_partkey div 100").alias("image"), F.expr("p_partkey % 100 div 10").alias("row"), (F.col("p_partkey") % 10).alias("col"), F.col("p_size").alias("value"))
    return vectorised(p, "image", 30)


def bounding_boxes(spark, sf_dir: str) -> DataFrame:
    """Boxes and magnitudes of points by segment, finite ones only, and how many aren't."""
    c = read(spark, sf_dir, "customer").select("c_mktsegment", F.col("c_acctbal").alias("x"), F.col("c_custkey").cast("double").alias("y"))
    size = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    fine = ~F.isnan(size) & (F.abs(size) != float("inf"))
    return c.groupBy("c_mktsegment").agg(F.min("x").alias("x1"), F.max("x").alias("x2"), F.min("y").alias("y1"), F.max("y").alias("y2"), F.floor(F.max(F.when(fine, size)) * 100).alias("largest"), F.count_if(~fine).alias("without"))


def text_lines(spark, sf_dir: str) -> DataFrame:
    """Suppliers as texts at places of a page for each nation, put into rows."""
    s = read(spark, sf_dir, "supplier").select("s_nationkey", (F.col("s_suppkey") % 7).alias("x"), (F.col("s_suppkey") * 4).alias("y"), F.col("s_name").alias("text"))
    return text_rows(s, "s_nationkey").select("s_nationkey", F.col("row_no").cast("long").alias("row_no"), F.array_join("cells", "|").alias("cells"))


def page_budgets(spark, sf_dir: str) -> DataFrame:
    """Documents of a source as pages, kept up to 20,000 characters; whether any were left out."""
    d = within_budget(read(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id", "n_chars", 20_000)
    return d.groupBy("source").agg(F.count("*").alias("pages"), F.max("used").alias("used"), F.bool_or("truncated").alias("truncated"))


def document_rollup(spark, sf_dir: str) -> DataFrame:
    """Pages, texts and the largest page of each document set, with its warnings in order of first appearance."""
    d = read(spark, sf_dir, "documents").select("source", "doc_id", F.length(F.to_json(F.struct("doc_id", "lang"))).cast("long").alias("bytes"), F.when(F.col("n_chars") > 2000, "long").when(F.col("n_chars") < 50, "short").alias("warning"))
    seen = d.where("warning is not null").groupBy("source", "warning").agg(F.min("doc_id").alias("first"))
    listed = seen.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "warning"))), lambda w: w["warning"]), "; ").alias("warnings"))
    return d.groupBy("source").agg(F.count("*").alias("pages"), F.max("bytes").alias("largest")).join(listed, "source", "left").withColumn("needs_review", F.col("warnings").isNotNull())


def duplicate_keys(spark, sf_dir: str) -> DataFrame:
    """Keys that occur more than once are errors; all rows of two tables together, in the order of their bytes."""
    both = read(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("k"), F.col("n_name").alias("name")).unionByName(read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("k"), F.col("r_name").alias("name")))
    found = both.groupBy("k").agg(F.count("*").alias("rows"), F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))
    return found.select("k", "rows", "names", F.when(F.col("rows") > 1, F.concat(F.lit("duplicate key "), F.col("k").cast("string"))).alias("error"))


def depth_order(spark, sf_dir: str) -> DataFrame:
    """Faces from far to near, ties by key: the first ten of each picture."""
    p = read(spark, sf_dir, "part").select(F.expr("p_partkey div 200").alias("picture"), "p_partkey", (F.col("p_size") * 0.5 + F.col("p_retailprice") * 0.001).alias("depth"))
    place = F.row_number().over(Window.partitionBy("picture").orderBy(F.desc("depth"), "p_partkey"))
    return p.withColumn("place", place).where("place <= 10").select("picture", "place", "p_partkey")


def colour_paths(spark, sf_dir: str) -> DataFrame:
    """Shapes put together by colour: one path for each, in the order of the shapes."""
    p = read(spark, sf_dir, "part").select("p_brand", "p_partkey", F.concat(F.lit("M"), F.col("p_size").cast("string"), F.lit(" 0L0 "), (F.col("p_partkey") % 9).cast("string")).alias("d"))
    return p.groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "d"))), lambda x: x["d"]), "").alias("d"))


NAMES = ("raster_rectangles", "bounding_boxes", "text_lines", "page_budgets", "document_rollup", "duplicate_keys", "depth_order", "colour_paths")
QUERIES = {n: globals()[n] for n in NAMES}
ORACLES = {
    "raster_rectangles": """WITH p AS (SELECT p_partkey // 100 AS image, p_partkey % 100 // 10 AS r, p_partkey % 10 AS c FROM part WHERE p_size < 30),
a AS (SELECT *, c - row_number() OVER (PARTITION BY image, r ORDER BY c) AS g FROM p), b AS (SELECT image, r, min(c) AS x, count(*) AS width FROM a GROUP BY image, r, g),
d AS (SELECT *, r - row_number() OVER (PARTITION BY image, x, width ORDER BY r) AS s FROM b) SELECT image, x, min(r) AS y, width, count(*) AS height FROM d GROUP BY image, x, width, s""",
    "bounding_boxes": """SELECT c_mktsegment, min(c_acctbal) AS x1, max(c_acctbal) AS x2, min(c_custkey)::DOUBLE AS y1, max(c_custkey)::DOUBLE AS y2, floor(max(sqrt(c_acctbal * c_acctbal + c_custkey::DOUBLE * c_custkey::DOUBLE)) * 100)::BIGINT AS largest, 0::BIGINT AS without FROM customer GROUP BY 1""",
    "text_lines": """WITH RECURSIVE t AS (SELECT s_nationkey, s_suppkey % 7 AS x, s_suppkey * 4 AS y, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey * 4, s_suppkey % 7, s_name) AS rn FROM supplier),
f AS (SELECT *, y AS top, 0::BIGINT AS row_no FROM t WHERE rn = 1 UNION ALL SELECT t.*, CASE WHEN t.y - f.top >= 12 THEN t.y ELSE f.top END, f.row_no + CASE WHEN t.y - f.top >= 12 THEN 1 ELSE 0 END FROM f JOIN t ON t.s_nationkey = f.s_nationkey AND t.rn = f.rn + 1)
SELECT s_nationkey, row_no, string_agg(s_name, '|' ORDER BY x, s_name) AS cells FROM f GROUP BY 1, 2""",
    "page_budgets": """WITH r AS (SELECT source, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used, sum(n_chars) OVER (PARTITION BY source) AS total FROM documents)
SELECT source, count(*) AS pages, max(used)::BIGINT AS used, bool_or(total > 20000) AS truncated FROM r WHERE used <= 20000 GROUP BY source""",
    "document_rollup": """WITH d AS (SELECT source, doc_id, length('{"doc_id":' || doc_id || ',"lang":"' || lang || '"}') AS bytes, CASE WHEN n_chars > 2000 THEN 'long' WHEN n_chars < 50 THEN 'short' END AS warning FROM documents),
w AS (SELECT source, warning, min(doc_id) AS f FROM d WHERE warning IS NOT NULL GROUP BY 1, 2), l AS (SELECT source, string_agg(warning, '; ' ORDER BY f) AS warnings FROM w GROUP BY 1)
SELECT d.source, count(*) AS pages, max(bytes) AS largest, any_value(l.warnings) AS warnings, any_value(l.warnings) IS NOT NULL AS needs_review FROM d LEFT JOIN l ON l.source = d.source GROUP BY d.source""",
    "duplicate_keys": """WITH b AS (SELECT n_regionkey::BIGINT AS k, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region)
SELECT k, count(*) AS rows, string_agg(name, ',' ORDER BY name) AS names, CASE WHEN count(*) > 1 THEN 'duplicate key ' || k END AS error FROM b GROUP BY k""",
    "depth_order": "SELECT picture, place::INT AS place, p_partkey FROM (SELECT p_partkey // 200 AS picture, p_partkey, row_number() OVER (PARTITION BY p_partkey // 200 ORDER BY p_size * 0.5::DOUBLE + p_retailprice * 0.001::DOUBLE DESC, p_partkey) AS place FROM part) WHERE place <= 10",
    "colour_paths": "SELECT p_brand, string_agg('M' || p_size || ' 0L0 ' || (p_partkey % 9), '' ORDER BY p_partkey) AS d FROM part GROUP BY p_brand",
}
