"""Files of any known format as rows: detection, bounded reading, extraction.

A format is a name, the columns it gives, and a function from a file's bytes to rows.
``extract`` runs it over (path, content) rows, one file at a time inside an Arrow batch, so
files are spread over the cluster and a bad one costs one row with an ``error``.
"""

from __future__ import annotations

import importlib
import json
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import unquote
from xml.etree.ElementTree import ParseError

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one file at most; larger ones give an error row.
MOST_BYTES = 512 << 20
#: Rows that are handed on at once.
ROWS = 10_000
MODULES = ("tables", "texts", "records", "science", "jsons", "xmls", "counts", "packages", "graphs", "geo", "shapes", "headers", "legacy")


@dataclass(frozen=True)
class Format:
    """Columns and row function of one format; ``suffixes`` and ``sniff`` tell its files."""

    columns: tuple[str, ...]
    rows: Callable[[bytes], Iterator[tuple]]
    suffixes: tuple[str, ...] = ()
    sniff: Callable[[bytes], bool] | None = None


@lru_cache(maxsize=1)
def formats() -> dict[str, Format]:
    return {k: v for m in MODULES for k, v in importlib.import_module(f"{__package__}.formats.{m}").FORMATS.items()}


def text(data: bytes) -> str:
    """UTF-8, or UTF-16 by its mark, without the mark; anything else is an error."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16")
    return data.decode("utf-8-sig")


def loads(data: bytes):
    """JSON without NaN and infinities."""

    def refuse(name: str):
        raise ValueError(f"{name} isn't JSON")

    return json.loads(text(data), parse_constant=refuse)


def _plain(v) -> str | None:
    if v is None or isinstance(v, str):
        return v
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float) and v.is_integer() and abs(v) < 1e15:
        return str(int(v))
    return json.dumps(v, ensure_ascii=False) if isinstance(v, (dict, list)) else str(v)


def _extractor(name: str, most: int):
    columns = formats()[name].columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = formats()[name].rows
        kind = pa.schema([("file_path", pa.string()), ("ord", pa.int64()), *((c, pa.string()) for c in columns), ("error", pa.string())])
        none = [None] * len(columns)
        out: list[list] = []

        def flush() -> pa.RecordBatch:
            batch = pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), kind, strict=True)], schema=kind)
            out.clear()
            return batch

        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                path, n = path.as_py(), 0
                if content.as_py() is None or len(content.as_py()) > most:
                    out.append([path, 0, *none, "limit exceeded" if content.as_py() is not None else "no content"])
                    continue
                try:
                    for row in read(content.as_py()):
                        out.append([path, n, *map(_plain, row), None])
                        n += 1
                        if len(out) >= ROWS:
                            yield flush()
                except (ValueError, KeyError, IndexError, TypeError, AttributeError, struct.error, zlib.error, zipfile.BadZipFile, ParseError, RecursionError, EOFError) as e:
                    # what the file breaks; rows before it stay
                    out.append([path, n, *none, f"{type(e).__name__}: {e}"[:200]])
            if out:
                yield flush()

    return run


def extract(files: DataFrame, name: str, most: int = MOST_BYTES) -> DataFrame:
    """(file_path, ord, the format's columns as text, error) of files (path, content).

    A null content, one above ``most`` bytes and one that breaks the format give a row with
    ``error``; rows before the break stay.  A file without rows gives none.
    """
    columns = ", ".join(f"`{c}` string" for c in formats()[name].columns)
    return files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(_extractor(name, most), f"file_path string, ord long, {columns}, error string")


def files_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def name_of(path: str | None, head: bytes | None) -> str | None:
    """The format by the longest suffix of the file's name that is known, else by its first bytes."""
    found, size = None, 0
    for k, f in formats().items():
        for s in f.suffixes:
            if len(s) > size and path is not None and path.lower().endswith(s):
                found, size = k, len(s)
    return found or next((k for k, f in formats().items() if f.sniff and head and f.sniff(head)), None)


def confined(base: str, reference: str) -> str | None:
    """The path that a file's relative reference means, if it stays in the file's folder, else null:
    no scheme, no absolute path, no step up, no control character, escaped or not."""
    plain = unquote(reference.split("#")[0].split("?")[0])
    parts = plain.replace("\\", "/").split("/")
    if not plain or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", plain) or plain[0] in "/\\" or ".." in parts or any(ord(c) < 32 or ord(c) == 127 for c in plain):
        return None
    folder = base.rpartition("/")[0]
    return "/".join([*([folder] if folder else []), *(p for p in parts if p not in ("", "."))])


def references(files: DataFrame, found: DataFrame) -> DataFrame:
    """(path, reference, target, length): references (path, reference) of files joined with the files (path, content)
    that they mean; ``target`` is null where it isn't there or not confined."""
    import pandas as pd

    at = F.pandas_udf(lambda p, r: pd.Series([confined(a, b) if a is not None and b is not None else None for a, b in zip(p, r, strict=True)], dtype="object"), "string")
    asked = found.select("path", "reference", at(F.col("path"), F.col("reference")).alias("asked"))
    there = files.select(F.col("path").alias("target"), F.length("content").cast("long").alias("length"))
    return asked.join(there, F.col("asked") == F.col("target"), "left").drop("asked")


def detect(path: Column, head: Column) -> Column:
    """``name_of`` the path and the first bytes; null if neither tells."""

    def names(paths, heads):
        import pandas as pd

        return pd.Series([name_of(p, None if h is None else bytes(h)) for p, h in zip(paths, heads, strict=True)], dtype="object")

    return F.pandas_udf(names, "string")(path, head)


def convert(spark: SparkSession, path: str, most: int = MOST_BYTES) -> DataFrame:
    """(path, format, ord, cells, error) of every file under ``path``, in the format that ``detect`` names.

    ``cells`` maps the format's columns to their texts; files of no known format have an error.
    """
    files = files_of(spark, path).withColumn("format", detect(F.col("path"), F.substring("content", 1, 4096)))
    kind = "path string, format string, ord long, cells map<string,string>, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("format", pa.string()), ("ord", pa.int64()), ("cells", pa.map_(pa.string(), pa.string())), ("error", pa.string())])
        for batch in batches:
            for path, name, content in zip(*batch.columns, strict=True):
                if name.as_py() is None:
                    yield pa.record_batch([[path.as_py()], [None], [0], pa.array([None], schema.field("cells").type), ["unknown format"]], schema=schema)
                    continue
                columns = formats()[name.as_py()].columns
                one = pa.record_batch([pa.array([path.as_py()]), pa.array([content.as_py()], pa.binary())], names=["path", "content"])
                for part in _extractor(name.as_py(), most)(iter([one])):
                    rows = part.to_pylist()
                    cells = [[(c, r[c]) for c in columns if r[c] is not None] for r in rows]
                    yield pa.record_batch([part.column(0), pa.array([name.as_py()] * len(rows)), part.column(1), pa.array(cells, schema.field("cells").type), part.column(part.num_columns - 1)], schema=schema)

    return files.select("path", "format", "content").mapInArrow(run, kind)
