"""Readers of tool reports and network logs: findings, tests, coverage, archives of requests.

A report is one document: JSON and XML files are one row each, parsed once and exploded;
trace files have a record separator and are split.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import base_name, mask_url, masked_parameters, percent


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("j"))


def read_sarif(spark: SparkSession, path: str) -> DataFrame:
    """(tool, rule, level) of each result; the rule's level, then ``warning``, where it has none."""
    rule = "struct<id: string, defaultConfiguration: struct<level: string>>"
    runs = _json(spark, path, f"runs array<struct<tool: struct<driver: struct<name: string, rules: array<{rule}>>>, results: array<struct<ruleId: string, ruleIndex: int, level: string>>>>")
    runs = runs.select(F.explode("j.runs").alias("run")).select(F.coalesce("run.tool.driver.name", F.lit("unknown")).alias("tool"), F.col("run.tool.driver.rules").alias("rules"), F.explode("run.results").alias("r"))
    index = F.when(F.col("r.ruleIndex") >= 0, F.col("r.ruleIndex"))
    named = F.coalesce(F.get("rules", index), F.get(F.filter("rules", lambda x: x["id"] == F.col("r.ruleId")), 0))
    level = F.lower(F.coalesce("r.level", named["defaultConfiguration"]["level"], F.lit("warning")))
    return runs.select("tool", F.coalesce("r.ruleId", named["id"], F.lit("unknown")).alias("rule"), level.alias("level"))


def severities(findings: DataFrame) -> DataFrame:
    """Counts by tool and rule with one column per level."""
    known = ("error", "warning", "note")
    other = F.count_if(~F.col("level").isin(*known)).alias("other")
    return findings.groupBy("tool", "rule").agg(*[F.count_if(F.col("level") == k).alias(k) for k in known], other, F.count("*").alias("total"))


def read_har(spark: SparkSession, path: str) -> DataFrame:
    """Requests of an archive, secrets in their addresses masked; bodies are never read."""
    request, response = "struct<method: string, url: string, bodySize: long>", "struct<status: int, bodySize: long, content: struct<mimeType: string, size: long>>"
    e = _json(spark, path, f"log struct<entries: array<struct<request: {request}, response: {response}, time: double>>>").select(F.posexplode("j.log.entries").alias("entry", "e"))
    url = F.col("e.request.url")
    return e.select(
        "entry", F.col("e.request.method").alias("method"), mask_url(url).alias("url"), masked_parameters(url).alias("masked"), F.col("e.response.status").alias("status"), F.col("e.response.content.mimeType").alias("mime"),
        F.col("e.request.bodySize").alias("request_bytes"), F.coalesce("e.response.content.size", "e.response.bodySize").alias("response_bytes"), F.col("e.time").alias("time_ms"),
    )


def read_lcov(spark: SparkSession, path: str) -> DataFrame:
    """Coverage of each file of a trace; counted lines and branches stand in where no sums are given."""
    rows = spark.read.option("lineSep", "end_of_record").text(path).where(F.col("value").rlike("(?m)^SF:"))
    total = lambda k: F.coalesce(F.nullif(F.regexp_extract("value", rf"(?m)^{k}:(\d+)", 1), F.lit("")).try_cast("long"), F.lit(0))
    each = lambda p: F.regexp_extract_all("value", F.lit(p), F.lit(1))
    taken = lambda a: F.size(F.filter(a, lambda x: x.rlike("[1-9]")))
    lines, branches = each(r"(?m)^DA:\d+,(\d+)"), each(r"(?m)^BRDA:[^,\n]*,[^,\n]*,[^,\n]*,(\d+|-)")
    pick = lambda found, hit, a: (F.when(found > 0, found).otherwise(F.size(a)), F.when(found > 0, hit).otherwise(taken(a)))
    lf, lh = pick(total("LF"), total("LH"), lines)
    bf, bh = pick(total("BRF"), total("BRH"), branches)
    missed = lambda found, hit: F.greatest(found - hit, F.lit(0))
    return rows.select(
        base_name(F.regexp_extract("value", r"(?m)^SF:([^\r\n]*)", 1)).alias("file"), lh.alias("lines_hit"), missed(lf, lh).alias("lines_missed"), total("FNH").alias("functions_hit"),
        missed(total("FNF"), total("FNH")).alias("functions_missed"), bh.alias("branches_hit"), missed(bf, bh).alias("branches_missed"), percent(lh, lf).alias("line_rate"),
    )


def xml_elements(spark: SparkSession, path: str) -> DataFrame:
    """(file, id, parent, depth, tag, attributes, text) of every element, ids in document order.

    Tags lose their name spaces.  A file that isn't well-formed gives one row: id -1, tag
    ``error``, the message as text.  Entities other than XML's own are refused by the parser.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plain = lambda t: t.rpartition("}")[2]
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                rows, above, nodes = [], [], []
                try:
                    for event, node in ElementTree.iterparse(io.BytesIO(content), ("start", "end")):
                        if event == "start":
                            nodes.append((above[-1] if above else None, len(above), plain(node.tag), {plain(k): v for k, v in node.attrib.items()}))
                            above.append(len(nodes) - 1)
                        else:
                            at = above.pop()
                            rows.append((file, at, *nodes[at], (node.text or "").strip()))
                            node.clear()
                except ElementTree.ParseError as e:
                    rows = [(file, -1, None, 0, "error", {}, str(e))]
                yield pd.DataFrame(rows, columns=["file", "id", "parent", "depth", "tag", "attributes", "text"]).astype({"parent": "Int64"})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, id long, parent long, depth int, tag string, attributes map<string,string>, text string")


def read_junit(spark: SparkSession, path: str) -> DataFrame:
    """Tests of each suite by outcome: a failure outranks an error, that a skip, that a pass."""
    x = xml_elements(spark, path)
    outcome = x.where(F.col("tag").isin("failure", "error", "skipped") & F.col("parent").isNotNull()).groupBy("file", F.col("parent").alias("id")).agg(*[F.bool_or(F.col("tag") == k).alias(k) for k in ("failure", "error", "skipped")])
    cases = x.where("tag = 'testcase'").join(outcome, ["file", "id"], "left")
    result = F.when(F.col("failure"), "failure").when(F.col("error"), "error").when(F.col("skipped"), "skipped").otherwise("pass")
    counts = cases.groupBy("file", F.col("parent").alias("id")).agg(F.count("*").alias("tests"), *[F.count_if(result == k).alias(n) for k, n in (("pass", "passed"), ("failure", "failures"), ("error", "errors"), ("skipped", "skips"))])
    suites = x.where("tag = 'testsuite'").join(counts, ["file", "id"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return suites.select("file", "id", F.coalesce(F.nullif(F.col("attributes")["name"], F.lit("")), F.lit("(unnamed suite)")).alias("suite"), *map(zero, ("tests", "passed", "failures", "errors", "skips")), F.coalesce(F.col("attributes")["time"].try_cast("double"), F.lit(0.0)).alias("seconds"))


def read_coverage(spark: SparkSession, path: str) -> DataFrame:
    """Covered and missed lines and branches by package: JaCoCo's own counters or Cobertura's lines."""
    x = xml_elements(spark, path)
    a = F.col("attributes")
    packages = x.where("tag = 'package'").select("file", F.col("id").alias("package_id"), a["name"].alias("package"))
    counted = x.where("tag = 'counter'").select("file", F.col("parent").alias("package_id"), F.lower(a["type"]).alias("kind"), a["covered"].try_cast("long").alias("covered"), a["missed"].try_cast("long").alias("missed"))
    # Cobertura: package / classes / class / lines / line
    up = x.select("file", "id", "parent")
    line = x.where("tag = 'line' and attributes['hits'] is not null").select("file", F.col("parent").alias("p0"), a["hits"].try_cast("long").alias("hits"), F.regexp_extract(F.coalesce(a["condition-coverage"], F.lit("")), r"\((\d+)/(\d+)\)", 1).try_cast("long").alias("bh"), F.regexp_extract(F.coalesce(a["condition-coverage"], F.lit("")), r"\((\d+)/(\d+)\)", 2).try_cast("long").alias("bf"))
    for k, _tag in enumerate(("lines", "class", "classes")):
        line = line.join(up.select("file", F.col("id").alias(f"p{k}"), F.col("parent").alias(f"p{k + 1}")), ["file", f"p{k}"])
    line = line.withColumnRenamed("p3", "package_id")
    hit = F.when(F.col("hits") > 0, 1).otherwise(0)
    lines = line.select("file", "package_id", F.lit("line").alias("kind"), hit.cast("long").alias("covered"), (1 - hit).cast("long").alias("missed"))
    branches = line.where("bf is not null").select("file", "package_id", F.lit("branch").alias("kind"), F.col("bh").alias("covered"), (F.col("bf") - F.col("bh")).alias("missed"))
    every = counted.unionByName(lines).unionByName(branches)
    sums = [F.coalesce(F.sum(F.when(F.col("kind") == k, F.col(c))), F.lit(0)).alias(f"{k}_{c}") for k in ("line", "branch", "method", "class") for c in ("covered", "missed")]
    out = packages.join(every, ["file", "package_id"], "left").groupBy("package").agg(*sums)
    return out.withColumn("line_rate", percent(F.col("line_covered"), F.col("line_covered") + F.col("line_missed")))


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (file, node) and edges (file, source, target, known): known if both ends are nodes."""
    x = xml_elements(spark, path)
    a = F.col("attributes")
    nodes = x.where("tag = 'node'").select("file", a["id"].alias("node")).distinct()
    edges = x.where("tag = 'edge'").select("file", a["source"].alias("source"), a["target"].alias("target"))
    ends = lambda c: nodes.select("file", F.col("node").alias(c), F.lit(True).alias(f"has_{c}"))
    edges = edges.join(ends("source"), ["file", "source"], "left").join(ends("target"), ["file", "target"], "left")
    return nodes, edges.select("file", "source", "target", F.coalesce(F.col("has_source") & F.col("has_target"), F.lit(False)).alias("known"))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(feature, type, part, ring, ord, lon, lat) of every vertex; collections are taken one level deep."""
    geometry = "type: string, coordinates: string"
    g = f"struct<{geometry}, geometries: array<struct<{geometry}>>>"
    j = _json(spark, path, f"type string, coordinates string, geometry {g}, geometries array<struct<{geometry}>>, features array<struct<geometry: {g}>>")
    flat = lambda x: F.coalesce(x["geometries"], F.array(F.struct(x["type"].alias("type"), x["coordinates"].alias("coordinates"))))
    own = F.struct(F.col("j.type").alias("type"), F.col("j.coordinates").alias("coordinates"), F.col("j.geometries").alias("geometries"))
    one = F.coalesce(F.col("j.geometry"), F.when(F.col("j.coordinates").isNotNull() | F.col("j.geometries").isNotNull(), own))
    every = F.coalesce(F.transform("j.features", lambda f: f["geometry"]), F.array(one))
    rows = j.select(F.posexplode(every).alias("feature", "g")).where("g is not null").select("feature", F.explode(flat(F.col("g"))).alias("g"))
    kind, c = F.col("g.type"), F.col("g.coordinates")
    depth = lambda n: F.concat(F.lit("[" * n), c, F.lit("]" * n))
    same = F.when(kind == "Point", depth(3)).when(kind.isin("MultiPoint", "LineString"), depth(2)).when(kind.isin("Polygon", "MultiLineString"), depth(1)).when(kind == "MultiPolygon", c)
    rows = rows.select("feature", kind.alias("type"), F.posexplode(F.from_json(same, "array<array<array<array<double>>>>")).alias("part", "p"))
    rows = rows.select("feature", "type", "part", F.posexplode("p").alias("ring", "r")).select("feature", "type", "part", "ring", F.posexplode("r").alias("ord", "v"))
    return rows.select("feature", "type", "part", "ring", "ord", F.get("v", 0).alias("lon"), F.get("v", 1).alias("lat"))
