"""Writers against their readers, files published whole, drawings changed, folders converted."""

import base64
import json
import os

import duckdb
import pytest

from folioscope import api
from folioscope.__main__ import main
from folioscope.operators import drawings, rules, sequence
from folioscope.sinks import roundtrips, writers
from folioscope.sinks.transform import clean_path, rounded, transform_svg
from folioscope.sources.files import _plain, formats



def listed(folder):
    return sorted(f for f in os.listdir(folder) if f[0] not in "._")  # without the file system's check sums and the report


ROW = {"s_suppkey": 17, "s_name": "Supplier#17", "s_nationkey": 5}


@pytest.mark.parametrize("name", sorted(roundtrips.TESTED))
def test_what_is_written_is_read(name):
    back = formats()[roundtrips.TESTED[name][1]]
    data = writers.WRITERS[name][0](roundtrips.filled(roundtrips.given(name), ROW))
    assert [tuple(map(_plain, r)) for r in back.rows(data)] == roundtrips.filled(roundtrips.back_rows(name), ROW)


def test_wrappings():
    rows = [("path", "1", "M0 0L1 1", None, "#000", None), ("rect", "1", "x=1 y=2", "red", None, None)]
    plain = writers.svg(rows)
    assert base64.b64decode(writers.data_uri(rows).partition(b",")[2]) == plain
    assert writers.path_data(rows) == b"M0 0L1 1"
    for write, mark in ((writers.jsx, b"{...props}"), (writers.tsx, b"SVGProps"), (writers.vue, b"<template>"), (writers.svelte, b"$$restProps")):
        assert mark in write(rows) and b'd="M0 0L1 1"' in write(rows)
    assert b"\\section{A \\& B}" in writers.tex([("heading", "1", "A & B")])
    assert writers.number("-0.0000000001", 5) == "0" and writers.number(2.50) == "2.5"
    assert writers.stl([("v", "0", "0", "0", "0", None), ("v", "1", "1", "0", "0", None), ("v", "2", "1", "1", "0", None), ("v", "3", "0", "1", "0", None), ("f", "0", None, None, None, "0 1 2 3")])[80:84] == b"\2\0\0\0"


def test_publish(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "1", "2", "k", "y"), ("a", 0, "1", "1", "j", "x,z"), ("b", 0, "1", "1", "j", None)], "file_path string, ord long, row string, col string, header string, value string")
    out = str(tmp_path / "out")
    report = api.reverse(rows, "csv", out)
    assert listed(out) == ["a.csv", "b.csv", "conversion.json"] and not os.path.exists(out + ".part")
    assert open(f"{out}/a.csv", newline="").read() == 'j,k\r\n"x,z",y\r\n'
    assert json.load(open(f"{out}/conversion.json"))["files"] == 2 and sorted(r.file for r in report.collect()) == ["a.csv", "b.csv"]
    with pytest.raises(FileExistsError):
        api.reverse(rows, "csv", out)
    with pytest.raises(ValueError, match="nothing"):
        api.reverse(rows.limit(0), "csv", str(tmp_path / "none"))


SVG = b"""<svg xmlns="http://www.w3.org/2000/svg" xmlns:i="http://ink" width="10.5px" height="20" i:version="1"><!-- c --><metadata>m</metadata>
  <g/><g id="k"/><g><g/></g>
  <path d="M 0 0 L 1.23456 1 l 0 0 L 2 2" fill="red" stroke="none" style="fill:blue; stroke: none"/><text x="1.999"> a  b </text><i:x/></svg>"""


def test_drawings_change():
    out = transform_svg(SVG, minify=True, monochrome="#111", responsive=True, precision=2, remove_metadata=True, clean_paths=True, strip_empty_groups=True).decode()
    assert out == '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 10.5 20"><g id="k" /><path d="M0 0 1.23 1 2 2" fill="#111" stroke="none" style="fill:#111; stroke: none" /><text x="2"> a  b </text></svg>'
    assert b"metadata" in transform_svg(SVG) and b"width" in transform_svg(SVG)
    assert clean_path("M0 0 1 1zm1 1h0v2") == "M0 0 1 1zm1 1v2" and clean_path("A1 1 0 011 1") == "A1 1 0 0 1 1 1" and clean_path("no path 3") == "no path 3"
    assert rounded("translate(1.005,-0.0001) #1.5 a1.55", 2) == "translate(1,0) #1.5 a1.55"
    for bad, error in ((b"<a/>", "root"), (SVG.replace(b"<svg", b"<!DOCTYPE x><svg", 1), "refused")):
        with pytest.raises(ValueError, match=error):
            transform_svg(bad)


def test_calls(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.svg").write_bytes(SVG)
    (tmp_path / "in/b.json").write_bytes(b'{"k": [1, 2]}')
    (tmp_path / "in/c.xyzzy").write_bytes(b"?")
    report = {r.path.rpartition("/")[2]: (r.format, r.rows, r.needs_review) for r in api.convert_path(spark, str(tmp_path / "in"), str(tmp_path / "rows")).collect()}
    assert report == {"a.svg": ("svg", 2, False), "b.json": ("json", 2, False), "c.xyzzy": (None, 0, True)}
    assert [(r.leaf, r.value) for r in api.convert_bytes(spark, "x.json", b'{"k": 1}').collect()] == [("$.k", "1")]
    with pytest.raises(ValueError, match="unknown"):
        api.convert_bytes(spark, "x", b"?")
    first = api.preview(spark, str(tmp_path / "in"), most_bytes=40).where("format = 'json'").collect()
    assert len(first) == 0 or all(r.needs_review for r in first)
    assert api.preview(spark, str(tmp_path / "in")).where("needs_review").count() == 1
    api.transform(spark, str(tmp_path / "in"), str(tmp_path / "small"), minify=True)
    assert listed(tmp_path / "small") == ["a.svg", "conversion.json"]
    assert main(["formats", "topojson"]) == 0 and ".topojson" in capsys.readouterr().out


def test_layers(spark, tmp_path):
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(str(tmp_path))
    graph = lambda n, e: (spark.createDataFrame([(x,) for x in n], "node string"), spark.createDataFrame(e, "source string, target string"))
    got = {r.node: r.layer for r in drawings.layers(*graph("abcdex", [("a", "b"), ("b", "c"), ("a", "c"), ("d", "c"), ("c", "b"), ("e", "e")])).collect()}
    assert got == {"a": 0, "d": 0, "e": 0, "x": 0, "b": 1, "c": 1}
    assert {r.node: r.layer for r in drawings.layers(*graph("ab", [("a", "b"), ("b", "a")])).collect()} == {"a": 0, "b": 1}


def test_numbering_of_any_keys(spark):
    keys = [5, 5, 5, 900, -3, 10**12, None, 7]
    frame = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i int").repartition(3)
    got = sorted((r.row_no, r.k) for r in sequence.numbered_rows(frame, "k").collect())
    assert [n for n, _ in got] == list(range(8)) and [k for _, k in got] == [None, -3, 5, 5, 5, 7, 900, 10**12]
    sparse = spark.createDataFrame([(k * k,) for k in range(100)], "k long")
    assert sorted((r.i, r.k) for r in sequence.evenly(sparse, "k", 7).collect()) == [(i, (i * 100 // 7) ** 2) for i in range(7)]
    assert sequence.evenly(sparse, "k", 500).count() == 100 and sequence.evenly(sparse.limit(0), "k", 5).count() == 0


def test_column_slices_equal_sql_without_a_join(spark, tmp_path):
    keys = [*range(1000, 1230), 1005, 1005, None, None]  # a key may repeat or be missing, its cells are counted once each
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    got = sequence.column_slices(spark, str(tmp_path))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()  # a side of a join is 40 cells a row, and may be broadcast
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(sequence.ORACLES["column_slices"]).fetchall())


def test_rules_in_order(spark):
    df = spark.createDataFrame([(1, "5"), (2, " "), (3, "x"), (4, None)], "i int, v string")
    given = [rules.Rule(rules.blank(df.v), "blank", 1, True), rules.Rule(rules.cell_is(df.v, "between", 9, 1), "in", 2), rules.Rule(~rules.contains_text(df.v, "X"), "not x", 3), rules.Rule(rules.expression(df, "=i>2"), "late", 0)]
    assert [tuple(r[0]) for r in df.orderBy("i").select(rules.styles(given)).collect()] == [("in", "not x"), ("blank",), ("late",), ("late", "blank")]
