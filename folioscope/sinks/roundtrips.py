"""A query for each writer: rows of every supplier written and read again, with SQL for what must come back."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.rollups import read
from ..sources.files import extract, formats
from ..sources.samples import CASES, K, N, V, fill, oracle
from .writers import WRITERS, files_from

_BLOCKS = [("heading", "2", N), ("paragraph", "0", f"some words {K}"), ("item", "1", "one thing"), ("row", "2", f"k\t{K}"), ("row", "2", "v\t2")]
#: Rows that a format holds in full, where its reader's sample has others.
GIVEN = {
    "docx": _BLOCKS, "markdown": _BLOCKS, "html": _BLOCKS, "tex": _BLOCKS, "pdf": [("version", "1.4"), ("pages", "1"), ("text", f"{N} (a)"), ("text", f"k{K}")], "xlsx": [r[:5] + (None,) for r in CASES["xlsx"][1]],
    "dot": [("node", "a", N, None, None), ("node", f"b{K}", f"b{K}", None, None), ("edge", "directed", "x", "a", f"b{K}")], "svg": [("rect", "1", f"x={K} y=1 width=2 height=3", "red", None, None), ("text", "1", "x=0 y=0", None, None, N), ("path", "1", "M0 0L1 1", None, "#000", None)],
    "iges": [("1", "110", "3", f"0. 0. 0. 1. 2. {K}."), ("3", "116", None, "5. 6. 7.")], "gerber": [("1", "move", "C,0.5", "0", "0", "1", "2"), ("2", "draw", "C,0.5", "1", "2", "3", K), ("3", "flash", "R,1", "3", K, "0.25", V)],
    "gcode": [("3", "rapid", "0", "0", "0", "1", "2", "0"), ("4", "line", "1", "2", "0", "1", "2", "-1"), ("5", "line", "1", "2", "-1", K, "2", "-1")],
    "png": [("0", "0", "1", "0"), ("0", "1", "3", "0.5"), ("1", "0", None, None), ("1", "1", "5", "1")],
}
BACK = {"png": [("png", "2", "2", "1", "8")]}
TESTED = {w: (of, back) for w, (_, of, back) in WRITERS.items() if back}


def given(name: str) -> list[tuple]:
    return GIVEN.get(name) or CASES[TESTED[name][0]][1]


def query(name: str):
    of, back = TESTED[name]

    def run(spark, sf_dir: str) -> DataFrame:
        """Rows for every supplier, written as files and read again."""
        columns = formats()[of].columns
        table = read(spark, sf_dir, "supplier")

        def cell(t: str | None):
            parts = [] if t is None else [F.col(p).cast("string") if i % 2 else F.lit(p) for i, p in enumerate(_split(t))]
            return F.lit(None).cast("string") if t is None else F.concat(*parts)

        rows = [F.struct(F.lit(n).cast("long").alias("ord"), *[cell(v).alias(c) for c, v in zip(columns, r, strict=True)]) for n, r in enumerate(given(name))]
        rows = table.select(F.col("s_suppkey").cast("string").alias("file_path"), F.inline(F.array(*rows)))
        return extract(files_from(rows, name), back)

    return run


def _split(t: str) -> list[str]:
    return re.split(r"<<(\w+)>>", t)


def back_rows(name: str) -> list[tuple]:
    return BACK.get(name) or given(name)


def filled(rows: list[tuple], row: dict) -> list[tuple]:
    return [tuple(None if v is None else fill(v, row) for v in r) for r in rows]


QUERIES = {f"write_{k}": query(k) for k in TESTED}
ORACLES = {f"write_{k}": oracle(back, back_rows(k)) for k, (_, back) in TESTED.items()}
