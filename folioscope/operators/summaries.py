"""Report summaries: totals, rates, stacked domains, pages of rows, masked addresses, text measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.formulas import criterion
from ..functions.text import base_name, mask_url, masked_field, masked_parameters
from ..plans.rollups import read


def suite_totals(spark, sf_dir: str) -> DataFrame:
    """Detail rows and a grand total in one pass."""
    o = read(spark, sf_dir, "orders")
    each = [F.count_if(F.col("o_orderstatus") == k).alias(n) for k, n in (("F", "done"), ("O", "open"), ("P", "partial"))]
    out = o.rollup("o_orderpriority").agg(F.count("*").alias("orders"), *each, F.grouping("o_orderpriority").alias("g"))
    return out.select(F.when(F.col("g") == 1, "(total)").otherwise(F.col("o_orderpriority")).alias("suite"), "orders", "done", "open", "partial")


def coverage_rate(spark, sf_dir: str) -> DataFrame:
    """Hit, missed and the rate in permille by group, null where nothing was found."""
    li = read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_if(F.col("l_linestatus") == "F").alias("hit"), F.count("*").alias("found"))
    return li.select("l_returnflag", "hit", (F.col("found") - F.col("hit")).alias("missed"), F.expr("if(found > 0, (hit * 1000) div found, null)").alias("permille"))


def stacked_domain(spark, sf_dir: str) -> DataFrame:
    """The axis of a stacked chart: per series the largest part, over all the largest stack."""
    o = read(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderpriority")
    parts = o.groupBy("month", "o_orderpriority").agg(F.count("*").alias("n"))
    stacks = parts.groupBy("month").agg(F.sum("n").alias("stack"), F.max("n").alias("largest_part"), F.count("*").alias("series"))
    return stacks.agg(F.max("stack").alias("axis_max"), F.max("largest_part").alias("part_max"), F.count("*").alias("months"), F.max("series").alias("series"))


def distinct_warnings(spark, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.concat_ws(": ", "event_type", "props").alias("warning")).distinct()


def url_mask(spark, sf_dir: str) -> DataFrame:
    """Addresses with a session parameter added, masked, how often, and their last path part."""
    p = read(spark, sf_dir, "pages")
    url = F.concat("url", F.when(F.col("url").contains("?"), "&").otherwise("?"), F.lit("Session-Id=abc"))
    return p.select("page_id", mask_url(url).alias("masked_url"), masked_parameters(url).cast("long").alias("masked"), base_name(F.regexp_replace("url", "[?#].*$", "")).alias("name"))


def masked_fields(spark, sf_dir: str) -> DataFrame:
    """Form fields by path, sensitive values masked."""
    c = read(spark, sf_dir, "customer")
    path = F.element_at(F.array(*map(F.lit, ("user.Pass_Code", "user.name", "bank-account.no", "a.my_SSN"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    return c.select("c_custkey", path.alias("path"), masked_field(path, F.col("c_name")).alias("value"))


def text_width_spans(spark, sf_dir: str) -> DataFrame:
    """Wide, white and other characters of each text, and its width in half cells."""
    wide, white = F.regexp_count("text", F.lit(r"[\x{3000}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{FF00}-\x{FF60}]")), F.regexp_count("text", F.lit(r"[ \t\n\r]"))
    d = read(spark, sf_dir, "documents").select("doc_id", wide.cast("long").alias("wide"), white.cast("long").alias("white"), F.char_length("text").cast("long").alias("chars"))
    return d.select("doc_id", "wide", "white", (F.col("chars") - F.col("wide") - F.col("white")).alias("other"), (F.col("chars") + F.col("wide")).alias("cells"))


def number_formats(spark, sf_dir: str) -> DataFrame:
    """Grouped thousands, percent and padded forms of numbers, and joined texts."""
    p = read(spark, sf_dir, "part")
    return p.select("p_partkey", F.format_number("p_retailprice", 2).alias("grouped"), F.concat(F.col("p_size").cast("string"), F.lit("%")).alias("percent"), F.lpad(F.col("p_size").cast("string"), 5, "0").alias("padded"), F.concat_ws("-", "p_brand", F.lit(None).cast("string"), "p_type").alias("joined"))


def text_criteria(spark, sf_dir: str) -> DataFrame:
    """Criteria with wildcards, escapes and order on texts, counted by language."""
    t = F.col("source")
    rules = {"starts": "a*", "third": "??a*", "not_empty": "<>", "from_m": ">=m", "literal_star": "~**"}
    return read(spark, sf_dir, "documents").groupBy("lang").agg(*[F.count_if(criterion(t, r)).alias(n) for n, r in rules.items()])


NAMES = ("suite_totals", "coverage_rate", "stacked_domain", "distinct_warnings", "url_mask", "masked_fields", "text_width_spans", "number_formats", "text_criteria")
QUERIES = {n: globals()[n] for n in NAMES}
ORACLES = {
    "suite_totals": """SELECT CASE WHEN grouping(o_orderpriority) = 1 THEN '(total)' ELSE o_orderpriority END AS suite, count(*) AS orders, count(*) FILTER (WHERE o_orderstatus = 'F') AS done,
  count(*) FILTER (WHERE o_orderstatus = 'O') AS open, count(*) FILTER (WHERE o_orderstatus = 'P') AS partial FROM orders GROUP BY ROLLUP (o_orderpriority)""",
    "coverage_rate": "SELECT l_returnflag, hit, found - hit AS missed, CASE WHEN found > 0 THEN (hit * 1000) // found END AS permille FROM (SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS hit, count(*) AS found FROM lineitem GROUP BY 1)",
    "stacked_domain": """WITH p AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2), s AS (SELECT month, sum(n)::BIGINT AS stack, max(n) AS part, count(*) AS series FROM p GROUP BY 1)
SELECT max(stack) AS axis_max, max(part) AS part_max, count(*) AS months, max(series) AS series FROM s""",
    "distinct_warnings": "SELECT DISTINCT concat_ws(': ', event_type, props) AS warning FROM events",
    "url_mask": """WITH u AS (SELECT page_id, url, url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'Session-Id=abc' AS x FROM pages),
q AS (SELECT *, regexp_extract(x, '^([^?#]*\\??)', 1) AS head, string_split(regexp_extract(x, '^[^?#]*\\?([^#]*)', 1), '&') AS ps, regexp_extract(x, '(#.*)$', 1) AS tail FROM u),
k AS (SELECT *, list_transform(ps, lambda p: regexp_matches(regexp_replace(lower(split_part(p, '=', 1)), '[-_]', '', 'g'), 'token|secret|password|apikey|authorization|cookie|session|credential')) AS hits FROM q)
SELECT page_id, head || array_to_string(list_transform(ps, lambda p, i: CASE WHEN hits[i] THEN split_part(p, '=', 1) || '=***' ELSE p END), '&') || tail AS masked_url, len(list_filter(hits, lambda h: h)) AS masked,
  regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/\\\\]*)$', 1) AS name FROM k""",
    "masked_fields": """SELECT c_custkey, path, CASE WHEN path IN ('user.Pass_Code', 'bank-account.no', 'a.my_SSN') THEN '***' ELSE c_name END AS value
FROM (SELECT c_custkey, c_name, ['user.Pass_Code', 'user.name', 'bank-account.no', 'a.my_SSN'][c_custkey % 4 + 1] AS path FROM customer)""",
    "text_width_spans": """WITH c AS (SELECT doc_id, length(regexp_replace(text, '[^\\x{3000}-\\x{9FFF}\\x{AC00}-\\x{D7AF}\\x{F900}-\\x{FAFF}\\x{FF00}-\\x{FF60}]', '', 'g')) AS wide, length(regexp_replace(text, '[^ \\t\\n\\r]', '', 'g')) AS white, length(text) AS chars FROM documents)
SELECT doc_id, wide, white, chars - wide - white AS other, chars + wide AS cells FROM c""",
    "number_formats": "SELECT p_partkey, format('{:,.2f}', p_retailprice) AS grouped, p_size || '%' AS percent, lpad(p_size::VARCHAR, 5, '0') AS padded, concat_ws('-', p_brand, NULL, p_type) AS joined FROM part",
    "text_criteria": """SELECT lang, count(*) FILTER (WHERE lower(source) LIKE 'a%') AS starts, count(*) FILTER (WHERE lower(source) LIKE '__a%') AS third, count(*) FILTER (WHERE coalesce(source, '') <> '') AS not_empty,
  count(*) FILTER (WHERE lower(source) >= 'm') AS from_m, count(*) FILTER (WHERE source LIKE '*%') AS literal_star FROM documents GROUP BY lang""",
}
