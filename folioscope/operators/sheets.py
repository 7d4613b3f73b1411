"""Spreadsheet-style operators over tables: conditional aggregates, lookups, rules, scales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.formulas import column_name, criterion, excel_round, excel_trim, mercator, serial_date
from ..plans.rollups import read
from ..sources.files import extract


def conditional_aggregates(spark, sf_dir: str) -> DataFrame:
    """COUNTIF(S), SUMIF(S) and AVERAGEIF, which is 0 where nothing matches."""
    p = read(spark, sf_dir, "part")
    size, name = criterion(F.col("p_size"), ">=25"), criterion(F.col("p_type"), "*e*")
    none = criterion(F.col("p_size"), ">1e9")
    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    return p.groupBy("p_brand").agg(
        F.count_if(size).alias("countif"),
        F.count_if(size & name).alias("countifs"),
        F.coalesce(F.sum(F.when(size, cents)), F.lit(0)).alias("sumif_cents"),
        F.coalesce(F.avg(F.when(none, F.col("p_size"))), F.lit(0.0)).alias("averageif_none"),
        F.count_if(criterion(F.col("p_type"), "<>*a*")).alias("not_a"),
    )


def exact_lookup(spark, sf_dir: str) -> DataFrame:
    """VLOOKUP's exact mode: the first right row of a key wins, text compares without case."""
    right = read(spark, sf_dir, "customer").select(F.lower("c_mktsegment").alias("k"), "c_custkey", "c_name")
    first = right.groupBy("k").agg(F.min_by("c_name", "c_custkey").alias("found"))
    left = read(spark, sf_dir, "customer").select("c_custkey", F.upper("c_mktsegment").alias("asked"))
    return left.join(first, F.lower("asked") == F.col("k"), "left").select("c_custkey", "asked", "found")


def reference_resolution(spark, sf_dir: str) -> DataFrame:
    """Facts joined to two dimensions, with a text where a key has no row."""
    n, r, s = (read(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    out = s.join(n, s.s_nationkey == n.n_nationkey, "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return out.select("s_suppkey", F.coalesce("n_name", F.lit("[context omitted]")).alias("context"), F.coalesce("r_name", F.lit("[unit omitted]")).alias("unit"))


def known_edges(spark, sf_dir: str) -> DataFrame:
    """Distinct undirected edges with both ends known, and each end's degree as a target."""
    li = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    return _degrees(li, read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")), read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")))


def _degrees(ends: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    edges = ends.join(sources, ends.a == sources.k, "left_semi").join(targets, F.col("b") == F.col("k"), "left_semi")
    edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return edges.groupBy("b").agg(F.count("*").alias("in_degree"), F.min("a").alias("least_source"))


def scalar_functions(spark, sf_dir: str) -> DataFrame:
    """LEN, TRIM, ROUND, column letters, serial dates, Web-Mercator."""
    x, y = mercator((F.col("p_partkey") % 360 - 180).cast("double"), (F.col("p_size") - 25).cast("double"))
    return read(spark, sf_dir, "part").select(
        "p_partkey", F.char_length("p_name").cast("long").alias("len"), excel_trim(F.concat(F.lit("  "), "p_name", F.lit("  "))).alias("trimmed"),
        F.floor(excel_round(F.col("p_retailprice"), -1)).cast("long").alias("tens"), column_name(F.col("p_partkey") % 18278 + 1).alias("letters"),
        serial_date(F.col("p_size") + 40).cast("string").alias("serial"), F.floor(x).cast("long").alias("mx"), F.floor(y).cast("long").alias("my"),
    )


def sample_quotas(spark, sf_dir: str, target: int = 1000) -> DataFrame:
    """Shares of a sample: one for each group, the rest in proportion to (count - 1), leftovers in order."""
    g = read(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    every = Window.partitionBy(F.lit(1))  # one row per group
    g = g.withColumn("groups", F.count("*").over(every)).withColumn("rest", F.sum(F.col("n") - 1).over(every))
    room = F.lit(target) - F.col("groups")
    g = g.withColumn("share", F.expr(f"least(n - 1, (({target} - groups) * (n - 1)) div greatest(rest, 1))")).withColumn("left", F.least(room, F.col("rest")) - F.sum("share").over(every))
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("lang"))
    return g.select("lang", "n", (1 + F.col("share") + F.when(rank <= F.col("left"), 1).otherwise(0)).cast("long").alias("quota"))


def natural_key(name: Column) -> Column:
    """A text that sorts as names do naturally: digit runs by value, then by their length; other text without case;
    the name itself last."""
    def one(t):
        plain = F.regexp_replace(t, "^0+(?=.)", "")
        return F.when(t.rlike(r"^\d"), F.concat(F.lit("0"), F.lpad(F.length(plain).cast("string"), 6, "0"), plain, F.lpad(F.length(t).cast("string"), 6, "0"))).otherwise(F.concat(F.lit("1"), t))

    tokens = F.transform(F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), F.lit(1)), one)
    return F.concat(F.array_join(tokens, ""), F.lit(" "), name)


def natural_order(spark, sf_dir: str) -> DataFrame:
    """Natural sort keys of names."""
    name = F.concat("s_name", F.lit("-"), F.lpad(F.col("s_suppkey").cast("string"), 20, "0"))
    return read(spark, sf_dir, "supplier").select("s_suppkey", natural_key(name).alias("sort_key"))


def last_wins(spark, sf_dir: str) -> DataFrame:
    """Duplicate keys keep their first place and their last value."""
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.min("event_id").alias("place"), F.max_by("event_type", "event_id").alias("value"), F.count("*").alias("seen"))


def break_segments(spark, sf_dir: str) -> DataFrame:
    """Rows of a group numbered by the breaks before them, and segments counted."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = read(spark, sf_dir, "events").withColumn("segment", F.sum(F.when(F.col("event_type") == "signup", 1).otherwise(0)).over(w))
    return e.groupBy("user_id", "segment").agg(F.count("*").alias("rows"), F.min("event_id").alias("first_event"))


def budget_cutoff(spark, sf_dir: str, budget: int = 5000) -> DataFrame:
    """Pages of a document set kept while their running size stays in the budget."""
    w = Window.partitionBy("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)
    d = read(spark, sf_dir, "documents").withColumn("running", F.sum("n_chars").over(w))
    return d.where(F.col("running") <= budget).groupBy("source").agg(F.count("*").alias("kept"), F.max("running").alias("used"))


def json_leaves(spark, sf_dir: str) -> DataFrame:
    """Leaves of JSON values at any depth with path and kind, counted."""
    e = read(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("path"), F.col("props").alias("content"))
    leaves = extract(e, "json").where("error is null")
    return leaves.groupBy(F.col("leaf").alias("path"), "kind").agg(F.count("*").alias("n"), F.min("value").alias("least"))


def html_blocks(spark, sf_dir: str) -> DataFrame:
    """Block counts and title of each page, scripts and comments left out."""
    html = F.regexp_replace("html", r"(?is)<script\b.*?</script>|<!--.*?-->", " ")
    count = lambda tag: F.size(F.regexp_extract_all(html, F.lit(rf"(?i)<{tag}[\s>]"), F.lit(0))).cast("long")
    return read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), count("p").alias("paragraphs"), count("h1").alias("headings"), count("li").alias("items"), count("a").alias("links"))


def markdown_rows(spark, sf_dir: str) -> DataFrame:
    """Table lines (cells between bars) of each text: rows, widest row."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.contains(" | "))
    wide = F.transform(lines, lambda x: F.size(F.split(x, r" \| ")))
    return read(spark, sf_dir, "documents").select("doc_id", F.size(lines).cast("long").alias("table_rows"), F.coalesce(F.array_max(wide), F.lit(0)).cast("long").alias("width"))


def redaction(spark, sf_dir: str) -> DataFrame:
    """Texts with addresses masked: how many, and the length of what is left."""
    mail = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
    some = F.col("text").contains("@")  # most texts have none, and the pattern is slow
    found = F.when(some, F.regexp_count("text", F.lit(mail))).otherwise(F.when(F.col("text").isNotNull(), 0))
    left = F.when(some, F.regexp_replace("text", mail, "[redacted]")).otherwise(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", found.cast("long").alias("masked"), F.char_length(left).cast("long").alias("length"))


def turn_numbers(spark, sf_dir: str) -> DataFrame:
    """Numbers of list items by level, here of turns by role, in document order."""
    w = Window.partitionBy("conv_id", "role").orderBy("turn")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.row_number().over(w).alias("number"))


def numeric_columns(spark, sf_dir: str) -> DataFrame:
    """Whether every cell of a column is numeric; empty cells count as numeric."""
    number = r"^\s*\(?[$€£¥₩₹]?-?[\d,]*\.?\d+\)?\s*[%$€£¥]?\s*$"
    c = read(spark, sf_dir, "customer")
    cells = c.select(F.explode(F.create_map(*(x for n in c.columns for x in (F.lit(n), F.col(n).cast("string"))))).alias("name", "v"))
    return cells.groupBy("name").agg(F.bool_and(F.coalesce(F.col("v"), F.lit("")).rlike(number) | (F.trim(F.coalesce("v", F.lit(""))) == "")).alias("is_numeric"), F.count("*").alias("cells"))


NAMES = ("conditional_aggregates", "exact_lookup", "reference_resolution", "known_edges", "scalar_functions", "sample_quotas", "natural_order", "last_wins", "break_segments", "budget_cutoff", "json_leaves", "html_blocks", "markdown_rows", "redaction", "turn_numbers", "numeric_columns")
QUERIES = {n: globals()[n] for n in NAMES}
ORACLES = {
    "conditional_aggregates": """SELECT p_brand, count(*) FILTER (WHERE p_size >= 25) AS countif, count(*) FILTER (WHERE p_size >= 25 AND lower(p_type) LIKE '%e%') AS countifs,
  coalesce(sum(CASE WHEN p_size >= 25 THEN CAST(round(p_retailprice * 100) AS BIGINT) END), 0)::BIGINT AS sumif_cents, coalesce(avg(CASE WHEN p_size > 1e9 THEN p_size END), 0.0)::DOUBLE AS averageif_none,
  count(*) FILTER (WHERE lower(p_type) NOT LIKE '%a%') AS not_a FROM part GROUP BY p_brand""",
    "exact_lookup": "SELECT c.c_custkey, upper(c.c_mktsegment) AS asked, f.found FROM customer c LEFT JOIN (SELECT lower(c_mktsegment) AS k, arg_min(c_name, c_custkey) AS found FROM customer GROUP BY 1) f ON lower(upper(c.c_mktsegment)) = f.k",
    "reference_resolution": "SELECT s_suppkey, coalesce(n_name, '[context omitted]') AS context, coalesce(r_name, '[unit omitted]') AS unit FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey",
    "known_edges": """WITH d AS (SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem WHERE l_partkey <> l_suppkey
  AND l_partkey IN (SELECT p_partkey FROM part) AND l_suppkey IN (SELECT s_suppkey FROM supplier)) SELECT b, count(*) AS in_degree, min(a) AS least_source FROM d GROUP BY b""",
    "scalar_functions": """SELECT p_partkey, length(p_name) AS len, trim(regexp_replace('  ' || p_name || '  ', '\\s+', ' ', 'g')) AS trimmed, floor(sign(p_retailprice) * floor(abs(p_retailprice) * 0.1::DOUBLE + 0.5) / 0.1::DOUBLE)::BIGINT AS tens,
  CASE WHEN n <= 26 THEN chr((n + 64)::INT) WHEN n <= 702 THEN chr(((n - 27) // 26 + 65)::INT) || chr(((n - 27) % 26 + 65)::INT) ELSE chr(((n - 703) // 676 + 65)::INT) || chr((((n - 703) // 26) % 26 + 65)::INT) || chr(((n - 703) % 26 + 65)::INT) END AS letters,
  CASE WHEN d = 60 THEN NULL WHEN d < 60 THEN CAST(DATE '1899-12-31' + d AS VARCHAR) ELSE CAST(DATE '1899-12-30' + d AS VARCHAR) END AS serial,
  floor(radians((p_partkey % 360 - 180)::DOUBLE) * 6378137.0::DOUBLE)::BIGINT AS mx, floor(ln(tan(radians((p_size - 25)::DOUBLE) / 2 + 0.7853981633974483::DOUBLE)) * 6378137.0::DOUBLE)::BIGINT AS my
FROM (SELECT *, p_partkey % 18278 + 1 AS n, p_size + 40 AS d FROM part)""",
    "sample_quotas": """WITH g AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), s AS (SELECT *, count(*) OVER () AS groups, sum(n - 1) OVER () AS rest FROM g),
t AS (SELECT *, least(n - 1, ((1000 - groups) * (n - 1)) // greatest(rest, 1)) AS share FROM s) SELECT lang, n, (1 + share + CASE WHEN row_number() OVER (ORDER BY lang) <= least(1000 - groups, rest) - sum(share) OVER () THEN 1 ELSE 0 END)::BIGINT AS quota FROM t""",
    "natural_order": r"""WITH n AS (SELECT s_suppkey, s_name || '-' || lpad(s_suppkey::VARCHAR, 20, '0') AS name FROM supplier)
SELECT s_suppkey, array_to_string(list_transform(regexp_extract_all(lower(name), '(\d+|\D+)', 1), lambda t: CASE WHEN regexp_matches(t, '^\d') THEN '0' || lpad(length(coalesce(nullif(ltrim(t, '0'), ''), '0'))::VARCHAR, 6, '0') || coalesce(nullif(ltrim(t, '0'), ''), '0') || lpad(length(t)::VARCHAR, 6, '0') ELSE '1' || t END), '') || ' ' || name AS sort_key FROM n""",
    "last_wins": "SELECT user_id, min(event_id) AS place, arg_max(event_type, event_id) AS value, count(*) AS seen FROM events GROUP BY user_id",
    "break_segments": "SELECT user_id, segment, count(*) AS rows, min(event_id) AS first_event FROM (SELECT *, (sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS segment FROM events) GROUP BY 1, 2",
    "budget_cutoff": "SELECT source, count(*) AS kept, max(running)::BIGINT AS used FROM (SELECT source, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS running FROM documents) WHERE running <= 5000 GROUP BY source",
    "json_leaves": """WITH l AS (SELECT unnest(json_keys(props)) AS k, props FROM events), v AS (SELECT k, json_extract_string(props, '$."' || k || '"') AS v FROM l)
SELECT '$.' || k AS path, CASE WHEN v IS NULL THEN 'null' WHEN regexp_matches(v, '^-?\\d+(\\.\\d+)?([eE][+-]?\\d+)?$') THEN 'number' WHEN v IN ('true', 'false') THEN 'boolean' ELSE 'string' END AS kind, count(*) AS n, min(v) AS least FROM v GROUP BY 1, 2""",
    "html_blocks": """WITH h AS (SELECT page_id, html, regexp_replace(html, '(?is)<script\\b.*?</script>|<!--.*?-->', ' ', 'g') AS x FROM pages)
SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, len(regexp_extract_all(x, '(?i)<p[\\s>]')) AS paragraphs, len(regexp_extract_all(x, '(?i)<h1[\\s>]')) AS headings,
  len(regexp_extract_all(x, '(?i)<li[\\s>]')) AS items, len(regexp_extract_all(x, '(?i)<a[\\s>]')) AS links FROM h""",
    "markdown_rows": "WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: contains(x, ' | ')) AS rows FROM documents) SELECT doc_id, len(rows) AS table_rows, coalesce(list_max(list_transform(rows, lambda x: len(string_split(x, ' | ')))), 0) AS width FROM l",
    "redaction": "SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) AS masked, length(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '[redacted]', 'g')) AS length FROM documents",
    "turn_numbers": "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS number FROM conversations",
    "numeric_columns": """WITH c AS (SELECT unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment']) AS name, unnest([c_custkey::VARCHAR, c_name, c_nationkey::VARCHAR, c_acctbal::VARCHAR, c_mktsegment]) AS v FROM customer)
SELECT name, bool_and(regexp_matches(coalesce(v, ''), '^\\s*\\(?[$€£¥₩₹]?-?[\\d,]*\\.?\\d+\\)?\\s*[%$€£¥]?\\s*$') OR trim(coalesce(v, '')) = '') AS is_numeric, count(*) AS cells FROM c GROUP BY name""",
}
