"""Group counts, severity pivots, detail rows with totals, and coverage ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def severity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by user group and type with counts by severity, as in a findings report."""
    level = F.when(F.col("event_type") == "error", "error").when(F.col("value") > 75, "warning").when(F.col("value") > 50, "note").otherwise("other")
    rows = read(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("tool"), F.col("event_type").alias("rule"), level.alias("level"))
    each = [F.count_if(F.col("level") == k).alias(k) for k in ("error", "warning", "note", "other")]
    return rows.groupBy("tool", "rule").agg(*each, F.count("*").alias("total"))


QUERIES = {"severity_rollup": severity_rollup}
ORACLES = {
    "severity_rollup": """
SELECT user_id % 10 AS tool, event_type AS rule, count(*) FILTER (WHERE lvl = 'error') AS error, count(*) FILTER (WHERE lvl = 'warning') AS warning,
  count(*) FILTER (WHERE lvl = 'note') AS note, count(*) FILTER (WHERE lvl = 'other') AS other, count(*) AS total
FROM (SELECT *, CASE WHEN event_type = 'error' THEN 'error' WHEN value > 75 THEN 'warning' WHEN value > 50 THEN 'note' ELSE 'other' END AS lvl FROM events)
GROUP BY 1, 2""",
}
