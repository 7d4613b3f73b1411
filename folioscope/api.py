"""What a user calls: convert files to rows, rows to files, preview a document, change a drawing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.drawings import within_budget
from .sinks.transform import transform_svg
from .sinks.writers import WRITERS, files_from, publish
from .sources.files import convert, extract, files_of, formats

__all__ = ["catalogue", "convert", "convert_bytes", "convert_path", "preview", "reverse", "transform_svg"]


def catalogue(search: str = "") -> list[tuple[str, tuple[str, ...], bool]]:
    """(format, its suffixes, whether it can be written) of the formats whose name or suffix holds the text."""
    text = search.lower()
    return [(k, f.suffixes, k in WRITERS) for k, f in sorted(formats().items()) if text in k or any(text in s for s in f.suffixes)]


def convert_path(spark: SparkSession, path: str, out: str, most: int = 512 << 20) -> DataFrame:
    """Converts what lies under ``path`` and writes the rows as Parquet by format to ``out``, which must be new;
    gives the report (path, format, rows, error, needs_review)."""
    rows = convert(spark, path, most)
    rows.write.mode("errorifexists").partitionBy("format").parquet(out)
    done = spark.read.schema(rows.schema).parquet(out)
    return done.groupBy("path", "format").agg(F.count_if(F.col("error").isNull()).alias("rows"), F.max("error").alias("error")).withColumn("needs_review", F.col("error").isNotNull())


def convert_bytes(spark: SparkSession, name: str, data: bytes, most: int = 512 << 20) -> DataFrame:
    """The rows of one file that is at hand; its name tells the format, or its first bytes."""
    from .sources.files import name_of

    found = name_of(name, data[:4096])
    if found is None:
        raise ValueError(f"unknown format: {name}")
    return extract(spark.createDataFrame([(name, bytearray(data))], "path string, content binary"), found, most)


def preview(spark: SparkSession, path: str, most_rows: int = 5_000, most_bytes: int = 8 << 20) -> DataFrame:
    """The first rows of each file within a budget of bytes; ``needs_review`` where something is missing or wrong."""
    rows = convert(spark, path).withColumn("bytes", F.length(F.to_json(F.struct("cells"))).cast("long"))
    some = within_budget(rows.where(F.col("ord") < most_rows), "path", "ord", "bytes", most_bytes)
    return some.withColumn("needs_review", F.col("truncated") | F.col("error").isNotNull()).drop("used", "truncated", "bytes")


def reverse(rows: DataFrame, name: str, folder: str) -> DataFrame:
    """Writes rows (file_path, ord, the format's columns) as files of a format to a new folder; gives the report."""
    suffix = next(iter(formats()[name].suffixes), f".{name}") if name in formats() else f".{name}"
    return publish(files_from(rows, name), folder, suffix)


def transform(spark: SparkSession, path: str, folder: str, **options) -> DataFrame:
    """Changes all drawings under ``path`` (see ``transform_svg``) and writes them to a new folder; gives the report."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([transform_svg(c, **options) for c in batch.column(1).to_pylist()], pa.binary())], names=["path", "content"])

    drawings = files_of(spark, path).where(F.lower("path").endswith(".svg")).select("path", "content")
    return publish(drawings.mapInArrow(run, "path string, content binary"), folder)
