"""Readers of whole files: every sample, binary files packed by hand, detection, bad files."""

import base64
import io
import json
import sqlite3
import struct
import zipfile
import zlib

import pytest

from folioscope.sources import files, samples
from folioscope.sources.files import formats

ROW = {"s_suppkey": 17, "s_name": "Supplier#17", "s_nationkey": 5}


def rows(name, data):
    return [tuple(map(files._plain, r)) for r in formats()[name].rows(data)]


@pytest.mark.parametrize("name", sorted(samples.CASES))
def test_sample(name):
    case, want = samples.CASES[name]
    assert rows(name, samples.content_of(case, ROW)) == [tuple(None if v is None else samples.fill(v, ROW) for v in r) for r in want]


def pack_parts(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, part in parts.items():
            z.writestr(name, part)
    return out.getvalue()


def database(*statements):
    db = sqlite3.connect(":memory:")
    for s in statements:
        db.execute(*s) if isinstance(s, tuple) else db.execute(s)
    db.commit()
    return db.serialize()


def test_databases():
    data = database("CREATE TABLE t (a INTEGER, b TEXT, c BLOB)", "INSERT INTO t VALUES (1, 'x', x'00ff'), (NULL, 'y', NULL)")
    assert rows("sqlite", data) == [("t", "1", "a", "int", "1"), ("t", "1", "b", "str", "x"), ("t", "1", "c", "bytes", "2 bytes"), ("t", "2", "a", "null", None), ("t", "2", "b", "str", "y"), ("t", "2", "c", "null", None)]
    point = b"GP\0\1" + struct.pack("<i", 4326) + struct.pack("<BI2d", 1, 1, 1.5, 2)
    data = database("CREATE TABLE gpkg_geometry_columns (table_name, column_name)", "INSERT INTO gpkg_geometry_columns VALUES ('f', 'g')", "CREATE TABLE gpkg_contents (table_name, data_type)", "CREATE TABLE f (g BLOB)", ("INSERT INTO f VALUES (?)", (point,)))
    assert rows("geopackage", data) == [("f", "1", "POINT (1.5 2)")]


def test_tables_and_shapes():
    head = struct.pack("<B3BIHH20x", 3, 20, 1, 1, 3, 32 + 64 + 1, 1 + 5 + 8)
    field = lambda n, t, size: n.encode().ljust(11, b"\0") + t.encode() + b"\0" * 4 + bytes([size]) + b"\0" * 15
    data = head + field("N", "C", 5) + field("D", "D", 8) + b"\r" + b" ab   20200131" + b"*gone 20200101" + b" x            "
    assert rows("dbf", data) == [("1", "N", "C", "ab"), ("1", "D", "D", "2020-01-31"), ("3", "N", "C", "x"), ("3", "D", "D", None)]
    ring = [(0, 0), (0, 1), (1, 1), (0, 0)]
    polygon = struct.pack("<I4dIII", 5, 0, 0, 1, 1, 1, 4, 0) + b"".join(struct.pack("<2d", *p) for p in ring)
    record = lambda n, body: struct.pack(">II", n, len(body) // 2) + body
    data = struct.pack(">I", 9994) + b"\0" * 96 + record(1, struct.pack("<I2d", 1, 1.5, 2)) + record(2, polygon) + record(3, struct.pack("<I", 0))
    assert rows("shapefile", data) == [("1", "POINT (1.5 2)"), ("2", "MULTIPOLYGON (((0 0, 0 1, 1 1, 0 0)))"), ("3", None)]
    tri = struct.pack("<12fH", 0, 0, 1, 0, 0, 0, 1, 0, 0, 0, 1, 0, 0)
    assert rows("stl", b"x" * 80 + struct.pack("<I", 1) + tri)[-1] == ("f", "0", None, None, None, "0 1 2")
    ply = b"ply\nformat binary_little_endian 1.0\nelement vertex 1\nproperty float x\nproperty float y\nproperty float z\nend_header\n" + struct.pack("<3f", 1, 2, 3)
    assert rows("ply", ply) == [("v", "0", "1", "2", "3", None)]


def test_gltf():
    blob = struct.pack("<9f", 0, 0, 0, 1, 0, 0, 0, 1, 0) + struct.pack("<3H", 0, 1, 2)
    v = {"buffers": [{"uri": "data:;base64," + base64.b64encode(blob).decode()}], "bufferViews": [{"buffer": 0}, {"buffer": 0, "byteOffset": 36}], "accessors": [{"bufferView": 0, "componentType": 5126, "count": 3, "type": "VEC3"}, {"bufferView": 1, "componentType": 5123, "count": 3, "type": "SCALAR"}], "meshes": [{"primitives": [{"attributes": {"POSITION": 0}, "indices": 1}]}]}
    want = [("v", "0", "0", "0", "0", None), ("v", "1", "1", "0", "0", None), ("v", "2", "0", "1", "0", None), ("f", "0", None, None, None, "0 1 2")]
    assert rows("gltf", json.dumps(v).encode()) == want
    v["buffers"] = [{"byteLength": len(blob)}]
    text = json.dumps(v).encode()
    text += b" " * (-len(text) % 4)
    binary = struct.pack("<4sIIII", b"glTF", 2, 0, len(text), 0x4E4F534A) + text + struct.pack("<II", len(blob), 0x4E4942) + blob
    assert rows("gltf", binary) == want


def test_binary_science():
    field = b"00\x1faTitle\x1e"
    control = b"id1\x1e"
    directory = b"001" + b"%04d%05d" % (len(control), 0) + b"245" + b"%04d%05d" % (len(field), len(control)) + b"\x1e"
    base = 24 + len(directory)
    body = directory + control + field + b"\x1d"
    leader = b"%05dnam a22%05d   4500" % (24 + len(body), base)
    assert rows("marc21", leader + body)[1:] == [("1", "001", None, "id1"), ("1", "245", "a", "Title")]
    card = lambda k, v: f"{k:<8}= {v:>20}".ljust(80)
    fits = ("".join([card("SIMPLE", "T"), card("BITPIX", "8"), card("NAXIS", "0"), card("OBJECT", "'M31'")]) + "END".ljust(80)).ljust(2880).encode()
    assert rows("fits", fits) == [("0", "SIMPLE", "T"), ("0", "BITPIX", "8"), ("0", "NAXIS", "0"), ("0", "OBJECT", "M31")]
    nii = bytearray(352)
    struct.pack_into("<i", nii, 0, 348)
    struct.pack_into("<8h", nii, 40, 3, 4, 5, 6, 1, 1, 1, 1)
    struct.pack_into("<2h", nii, 70, 16, 32)
    nii[344:348] = b"n+1\0"
    assert rows("nifti", bytes(nii))[:3] == [("dimensions", "4 5 6"), ("datatype", "16"), ("bits", "32")]
    mrc = bytearray(1024)
    struct.pack_into("<4i", mrc, 0, 2, 3, 4, 2)
    mrc[208:212] = b"MAP "
    assert rows("mrc", bytes(mrc))[:2] == [("dimensions", "2 3 4"), ("mode", "2")]
    label = lambda s: struct.pack(">i", len(s)) + s.encode().ljust(-(-len(s) // 4) * 4, b"\0")
    nc = b"CDF\1" + struct.pack(">i", 7) + struct.pack(">ii", 10, 1) + label("t") + struct.pack(">i", 0) + struct.pack(">ii", 12, 1) + label("title") + struct.pack(">i", 2) + label("abc") + struct.pack(">ii", 11, 1) + label("v") + struct.pack(">ii", 1, 0) + struct.pack(">ii", 0, 0) + struct.pack(">iii", 5, 4, 0)
    for name in ("netcdf", "exodus"):
        assert rows(name, nc) == [("dimension", "t", "unlimited", "7"), ("attribute", "title", "char", "abc"), ("variable", "v", "float", "t")]
    las = bytearray(227 + 20)
    las[:4], las[24], las[25] = b"LASF", 1, 2
    struct.pack_into("<IIBHI", las, 96, 227, 0, 0, 20, 1)
    struct.pack_into("<12d", las, 131, 0.01, 0.01, 0.01, 0, 0, 0, 2, 1, 2, 1, 2, 1)
    struct.pack_into("<3i", las, 227, 150, 100, 200)
    assert rows("las", bytes(las))[-1] == ("point", "1.500000 1.000000 2.000000") and rows("las", bytes(las))[2] == ("points", "1")


def test_pictures_and_headers():
    assert rows("raster", b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBB", 13, b"IHDR", 3, 4, 8, 6)) == [("png", "3", "4", "4", "8")]
    assert rows("raster", b"\xff\xd8\xff\xe0\0\x04xx\xff\xc0\0\x11\x08\0\x05\0\x07\x03") == [("jpeg", "7", "5", "3", "8")]
    assert rows("raster", b"GIF89a" + struct.pack("<HH", 9, 8) + b"\xf7") == [("gif", "9", "8", "1", "8")]
    assert rows("raster", b"P5\n# c\n6 7\n255\n") == [("netpbm", "6", "7", "1", "8")]
    entry = lambda tag, v: struct.pack("<HHIHH", tag, 3, 1, v, 0)
    assert rows("tiff", b"II*\0" + struct.pack("<IH", 8, 2) + entry(256, 10) + entry(257, 20) + struct.pack("<I", 0)) == [("1", "10", "20", "1", "1", "1")]
    assert rows("jpeg2000", b"\xff\x4f\xff\x51\0\x2f\0\0" + struct.pack(">8I", 12, 9, 2, 1, 0, 0, 0, 0) + struct.pack(">HB", 3, 7)) == [("10", "8", "3", "8")]
    explicit = lambda g, e, k, v: struct.pack("<HH2sH", g, e, k, len(v)) + v
    assert rows("dicom", b"\0" * 128 + b"DICM" + explicit(8, 0x60, b"CS", b"MR") + explicit(0x10, 0x10, b"PN", b"Doe") + explicit(0x28, 0x10, b"US", b"\x10\0")) == [("0008,0060", "CS", "MR"), ("0010,0010", "PN", "***"), ("0028,0010", "US", "16")]
    assert rows("hdf5", b"\x89HDF\r\n\x1a\n\2" + b"OHDR") == rows("cgns", b"\x89HDF\r\n\x1a\n\2" + b"OHDR") == [("bytes", "13"), ("superblock version", "2"), ("groups", "1"), ("heaps", "0")]
    assert rows("dwg", b"AC1027xx")[1] == ("release", "2013") and rows("jt", b"Version 9.5 JT".ljust(80) + b"\0")[1] == ("version", "Version 9.5 JT")
    assert rows("access", b"\0\1\0\0Standard Jet DB\0\1")[1:] == [("engine", "Standard Jet DB"), ("version", "Jet 4")]
    assert rows("3dm", b"3D Geometry File Format       70")[1] == ("version", "70")
    flat = zlib.compress(b"BT (packed) Tj ET")
    assert ("text", "packed") in rows("pdf", b"%PDF-1.5\n1 0 obj << /Filter /FlateDecode /Length 9 >> stream\n" + flat + b"\nendstream")
    mail = b"From: a@b\nSubject: s\n\nbody\n"
    assert rows("emlx", b"%d\n" % len(mail) + mail + b"<plist/>")[0][3:5] == ("s", "body")
    line = lambda s, k, n: f"{s:<72}{k}{n:>7}\n"
    iges = line("", "S", 1) + line(f"{110:>8}{1:>8}" + " " * 16 + f"{3:>8}", "D", 1) + line(f"{110:>8}{0:>8}{0:>8}{1:>8}", "D", 2) + line("110,0.,0.,0.,1.,2.,3.;", "P", 1)
    assert rows("iges", iges.encode()) == [("1", "110", "3", "0. 0. 0. 1. 2. 3.")]


def test_packages():
    assert rows("iwork", pack_parts({"Index/Document.iwa": "x"}))[:2] == [("Package", "1", "1 bytes"), ("Index", "1", "Index/Document.iwa")]
    assert ("Element", "submodel", "1") in rows("aasx", pack_parts({"aasx/a.aas.xml": "<e><submodel/></e>"}))
    assert ("Element", "Reference3D", "2") in rows("3dxml", pack_parts({"a.3dxml": "<M><Reference3D/><Reference3D/></M>"}))


def test_bad_files_cost_one_row(spark):
    made = [("a.csv", b'a,b\n1,"x'), ("b.csv", None), ("c.csv", b"a\n1\n"), ("d.csv", b"\xff\xfe\x00"), ("e.csv", b"")]
    got = files.extract(spark.createDataFrame(made, "path string, content binary"), "csv", most=100).collect()
    assert {(r.file_path, r.value, bool(r.error)) for r in got} == {("a.csv", None, True), ("b.csv", None, True), ("c.csv", "1", False), ("d.csv", None, True)}
    long = files.extract(spark.createDataFrame([("x", b"a" * 101)], "path string, content binary"), "json", most=100).collect()
    assert [r.error for r in long] == ["limit exceeded"]
    assert "refused" in files.extract(spark.createDataFrame([("x", b"<!DOCTYPE a [<!ENTITY b 'c'>]><a>&b;</a>")], "path string, content binary"), "xml").first().error


def test_conversion_of_a_folder(spark, tmp_path):
    """Suffixes tell first, then the first bytes; what is unknown is said."""
    given = {"a.tfplan.json": b'{"resource_changes": []}', "b.json": b'{"k": 1}', "c.bin": b'{"bomFormat": "CycloneDX", "components": [{"name": "n"}]}', "d": b"%PDF-1.4 ", "e.dat": b"\0\1", "f.xml": b"<a/>", "g.txt": b"<?xml version='1.0'?><!-- c --><gpx><wpt lat='1' lon='2'/></gpx>", "h.topojson": b"{", "sub/i.CSV": b"a\n1\n"}
    for name, data in given.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {}
    for r in files.convert(spark, str(tmp_path)).collect():
        got.setdefault(r.path.rpartition("/")[2], []).append((r.format, r.cells, bool(r.error)))
    assert {k: v[0][0] for k, v in got.items()} == {"b.json": "json", "c.bin": "cyclonedx", "d": "pdf", "e.dat": None, "f.xml": "xml", "g.txt": "gpx", "h.topojson": "topojson", "i.CSV": "csv"}
    assert got["b.json"] == [("json", {"leaf": "$.k", "kind": "number", "value": "1"}, False)] and got["h.topojson"][0][2] and got["e.dat"][0][2]
    assert got["i.CSV"] == [("csv", {"row": "1", "col": "1", "header": "a", "value": "1"}, False)]


def test_references_stay_in_their_folder(spark):
    c = files.confined
    assert c("a/b.html", "i/x.png?v#f") == "a/i/x.png" and c("b.html", "./x%20y.png") == "x y.png"
    assert not any(c("a/b.html", r) for r in ("", "../x", "%2e%2e/x", "/etc/x", "//h/x", "http://h/x", "data:x", "a\\..\\b", "x%00", "C:\\x"))
    there = spark.createDataFrame([("a/i.png", b"123"), ("x.png", b"1")], "path string, content binary")
    asked = spark.createDataFrame([("a/b.html", "i.png"), ("a/b.html", "../x.png"), ("a/b.html", "no.png"), (None, "x")], "path string, reference string")
    assert sorted(((r.reference, r.target, r.length) for r in files.references(there, asked).collect()), key=repr) == sorted([("i.png", "a/i.png", 3), ("../x.png", None, None), ("no.png", None, None), ("x", None, None)], key=repr)
