"""Readers of line formats: genome intervals, features, variants, alignments, sequences, signals, datasets.

Every reader takes (spark, path) and gives a DataFrame with the columns of the format and
``error``: null, or the rule that a row breaks.  Formats whose rows stand alone, or whose
records have a separator of their own (FASTA), are read as splittable text.  WIG, ARFF and
FASTQ depend on the lines before them: each of their files is one row, then exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _rows(spark: SparkSession, path: str, skip: str, by: str = "\t") -> DataFrame:
    lines = spark.read.text(path).select(F.regexp_replace("value", r"[\r\n]+$", "").alias("line"))
    return lines.where(~F.col("line").rlike(skip) & (F.trim("line") != "")).select("line", F.split("line", by).alias("f"))


def _at(i: int, kind: str | None = None, empty: str | None = None) -> Column:
    c = F.get("f", i)
    c = F.nullif(c, F.lit(empty)) if empty else c
    return c.try_cast(kind) if kind else c


def _first_error(*rules: tuple[Column, str]) -> Column:
    return F.coalesce(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for test, name in rules])


def _bad_span(start: str, end: str) -> Column:
    return F.col(start).isNull() | F.col(end).isNull() | (F.col(start) > F.col(end)) | (F.col(start) < 0)


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """BED of 3 to 12 columns; blocks of BED12 must agree with their count and start at 0."""
    names = ("chrom", "chromStart", "chromEnd", "name", "score", "strand", "thickStart", "thickEnd", "itemRgb", "blockCount", "blockSizes", "blockStarts")
    kinds = {"chromStart": "long", "chromEnd": "long", "score": "int", "thickStart": "long", "thickEnd": "long", "blockCount": "int"}
    rows = _rows(spark, path, r"^(#|track\b|browser\b)", r"\s+").withColumn("n", F.size("f"))
    rows = rows.select("n", _at(4).alias("raw"), *[_at(i, kinds.get(c)).alias(c) for i, c in enumerate(names)])
    parts = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
    blocks = (F.size(parts("blockSizes")) != F.col("blockCount")) | (F.size(parts("blockStarts")) != F.col("blockCount")) | (F.get(parts("blockStarts"), 0) != "0")
    error = _first_error(
        (~F.col("n").between(3, 12), "columns"),
        (_bad_span("chromStart", "chromEnd"), "interval"),
        (F.col("raw").isNotNull() & ~F.coalesce(F.col("score").between(0, 1000), F.lit(False)), "score"),
        (~F.col("strand").isin("+", "-", "."), "strand"),
        ((F.col("n") == 12) & F.coalesce(blocks, F.lit(True)), "blocks"),
    )
    return rows.select(*names, error.alias("error"))


def read_bedgraph(spark: SparkSession, path: str) -> DataFrame:
    rows = _rows(spark, path, r"^(#|track\b|browser\b)", r"\s+")
    rows = rows.select(F.size("f").alias("n"), _at(0).alias("chrom"), _at(1, "long").alias("chromStart"), _at(2, "long").alias("chromEnd"), _at(3, "double").alias("dataValue"))
    value = F.col("dataValue")
    error = _first_error((F.col("n") != 4, "columns"), (_bad_span("chromStart", "chromEnd"), "interval"), (value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), "value"))
    return rows.select("chrom", "chromStart", "chromEnd", "dataValue", error.alias("error"))


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """GFF3 and GTF; lines of an embedded FASTA part have no tabs and are left out."""
    names = ("seqid", "source", "type", "start", "end", "score", "strand", "phase", "attributes")
    kinds = {"start": "long", "end": "long", "score": "double", "phase": "int"}
    rows = _rows(spark, path, r"^#|^[^\t]*$").select(F.size("f").alias("n"), *[_at(i, kinds.get(c), ".").alias(c) for i, c in enumerate(names)])
    error = _first_error((F.col("n") != 9, "columns"), (_bad_span("start", "end") | (F.col("start") < 1), "interval"), (~F.col("strand").isin("+", "-", "?"), "strand"), (~F.col("phase").between(0, 2), "phase"))
    return rows.select(*names, error.alias("error"))


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """Variants: the eight fixed columns, FORMAT and the samples' texts in file order."""
    rows = _rows(spark, path, "^#").select(
        F.size("f").alias("n"), _at(0).alias("chrom"), _at(1, "long").alias("pos"), _at(2, empty=".").alias("id"), _at(3).alias("ref"), _at(4, empty=".").alias("alt"),
        _at(5, "double", ".").alias("qual"), _at(6, empty=".").alias("filter"), _at(7, empty=".").alias("info"), _at(8).alias("format"), F.slice("f", 10, 1 << 30).alias("samples"),
    )
    error = _first_error((F.col("n") < 8, "columns"), (F.col("pos").isNull() | (F.col("pos") < 0), "position"), (~F.col("ref").rlike("^[ACGTNacgtn]+$"), "reference"))
    return rows.withColumn("error", error).drop("n")


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    names = ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")
    kinds = {"flag": "int", "pos": "long", "mapq": "int", "pnext": "long", "tlen": "long"}
    rows = _rows(spark, path, r"^@[A-Z]{2}(\t|$)").select(F.size("f").alias("n"), *[_at(i, kinds.get(c)).alias(c) for i, c in enumerate(names)], F.slice("f", 12, 1 << 30).alias("tags"))
    plain = (F.col("seq") != "*") & (F.col("qual") != "*")
    error = _first_error((F.col("n") < 11, "columns"), (~F.col("flag").between(0, 65535) | F.col("flag").isNull(), "flag"), (F.col("pos").isNull(), "position"), (plain & (F.length("seq") != F.length("qual")), "quality"))
    return rows.withColumn("error", error).drop("n")


def _sequence(rows: DataFrame, *more: Column) -> DataFrame:
    up = F.upper("sequence")
    letters, gc = F.regexp_count(up, F.lit("[A-Z]")), F.regexp_count(up, F.lit("[GC]"))
    return rows.select(
        F.regexp_extract("head", r"^(\S*)", 1).alias("id"), F.regexp_extract("head", r"^\S*\s+(.*)$", 1).alias("description"), F.length("sequence").alias("length"),
        F.when(letters > 0, F.format_string("%.2f", gc * 100.0 / letters)).otherwise("n/a").alias("gc"), F.regexp_count(up, F.lit("[^ACGTU]")).alias("ambiguous"), *more, "sequence",
    )


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Sequences; a record ends where a line begins with ``>``, so files can be split."""
    text = F.regexp_replace("value", "^>", "")
    rows = spark.read.option("lineSep", "\n>").text(path).where(F.trim("value") != "")
    rows = rows.select(F.regexp_extract(text, r"^([^\r\n]*)", 1).alias("head"), F.regexp_replace(F.regexp_replace(text, r"^[^\n]*\n?", ""), r"\s+", "").alias("sequence"))
    return _sequence(rows)


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """Four-line records; quality must be printable and as long as the sequence."""
    lines = spark.read.text(path, wholetext=True).select(F.split(F.regexp_replace("value", r"\s+$", ""), r"\r?\n").alias("x")).where(F.size("x") >= 1)
    rows = lines.select("x", F.explode(F.sequence(F.lit(0), F.floor((F.size("x") - 1) / 4).cast("int"))).alias("k"))
    line = lambda j: F.get("x", F.col("k") * 4 + j)
    rows = rows.select(F.regexp_replace(line(0), "^@", "").alias("head"), F.coalesce(line(1), F.lit("")).alias("sequence"), line(2).alias("plus"), line(3).alias("quality"), line(0).startswith("@").alias("named"))
    error = _first_error((~F.col("named") | ~F.coalesce(F.col("plus").startswith("+"), F.lit(False)), "record"), (F.coalesce(F.length("quality"), F.lit(-1)) != F.length("sequence"), "length"), (~F.col("quality").rlike("^[!-~]*$"), "quality"))
    codes = F.transform(F.filter(F.split("quality", ""), lambda c: c != ""), lambda c: F.ascii(c))
    return _sequence(rows, F.array_min(codes).alias("lowest_quality"), F.array_max(codes).alias("highest_quality"), error.alias("error"))


def read_wig(spark: SparkSession, path: str) -> DataFrame:
    """Values as closed 1-based spans, from fixedStep and variableStep blocks."""
    blocks = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"(?m)(?=^(?:fixed|variable)Step\b)")).alias("b")).where(F.col("b").rlike("^(fixed|variable)Step"))
    head = F.regexp_extract("b", r"^([^\r\n]*)", 1)
    number = lambda k, default: F.coalesce(F.nullif(F.regexp_extract(head, rf"\b{k}=(\d+)", 1), F.lit("")).try_cast("long"), F.lit(default))
    rows = blocks.select(
        F.regexp_extract(head, r"\bchrom=(\S+)", 1).alias("chrom"), head.startswith("fixed").alias("fixed"), number("start", 1).alias("first"), number("step", 1).alias("step"), number("span", 1).alias("span"),
        F.filter(F.split(F.regexp_replace("b", r"^[^\n]*\n?", ""), r"\r?\n"), lambda x: (F.trim(x) != "") & ~x.rlike("^(#|track|browser)")).alias("lines"),
    )
    rows = rows.select("chrom", "fixed", "first", "step", "span", F.posexplode("lines").alias("i", "line")).withColumn("f", F.split(F.trim("line"), r"\s+"))
    start = F.when(F.col("fixed"), F.col("first") + F.col("step") * F.col("i")).otherwise(_at(0, "long"))
    value = F.when(F.col("fixed"), _at(0, "double")).otherwise(_at(1, "double"))
    rows = rows.select("chrom", start.alias("chromStart"), (start + F.col("span") - 1).alias("chromEnd"), value.alias("dataValue"))
    return rows.withColumn("error", _first_error((F.col("chromStart").isNull(), "start"), (F.col("dataValue").isNull(), "value")))


def read_arff(spark: SparkSession, path: str) -> DataFrame:
    """Cells as (file, row, attribute, kind, value); ``?`` is null, sparse rows have 0 where they say nothing."""
    quoted = r"""^(?:'((?:[^'\\]|\\.)*)'|"((?:[^"\\]|\\.)*)")$"""
    plain = lambda c: F.when(c.rlike(quoted), F.substring(c, 2, F.length(c) - 2)).otherwise(c)
    word = r"""('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|[^\s{]+)"""
    line = rf"(?im)^\s*@attribute\s+{word}\s*(.*?)\s*$"
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.split("value", r"(?im)^\s*@data\s*$", 2).alias("part"))
    names = F.transform(F.regexp_extract_all(F.get("part", 0), F.lit(line), F.lit(1)), plain)
    kinds = F.transform(F.regexp_extract_all(F.get("part", 0), F.lit(line), F.lit(2)), lambda k: F.when(k.startswith("{"), F.lit("nominal")).otherwise(F.lower(F.substring_index(k, " ", 1))))
    keep = lambda x: (F.trim(x) != "") & ~F.trim(x).startswith("%")
    comma = r"""\s*,\s*(?=(?:[^'"]|'[^']*'|"[^"]*")*$)"""
    rows = text.select("file", names.alias("names"), kinds.alias("kinds"), F.posexplode(F.filter(F.split(F.get("part", 1), r"\r?\n"), keep)).alias("row", "line"))
    rows = rows.withColumn("sparse", F.trim("line").startswith("{")).withColumn("cells", F.split(F.regexp_replace(F.trim("line"), r"^\{\s*|\s*\}$", ""), comma))
    rows = rows.select("file", "row", "kinds", "sparse", "cells", F.posexplode("names").alias("i", "attribute"))
    named = F.get(F.filter("cells", lambda c: F.substring_index(F.trim(c), " ", 1) == F.col("i").cast("string")), 0)
    value = F.when(F.col("sparse"), F.coalesce(F.regexp_replace(F.trim(named), r"^\d+\s+", ""), F.lit("0"))).otherwise(F.get("cells", F.col("i")))
    return rows.select("file", "row", "attribute", F.get("kinds", F.col("i")).alias("kind"), F.nullif(plain(F.trim(value)), F.lit("?")).alias("value"))
