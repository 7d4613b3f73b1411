"""Maps: features with geometry as well-known text, grids, tracks."""

from __future__ import annotations

import re
import struct
import zipfile
from collections.abc import Iterator
from io import BytesIO

from ..files import Format, loads, text
from .xmltree import attr, every, kid, kids, name, own, parse, root_is, rooted, said


def number(x) -> str:
    return f"{float(x):.15g}"


def _line(points) -> str:
    return ", ".join(" ".join(number(v) for v in p[:2]) for p in points)


def shape(g) -> str:
    """A GeoJSON geometry as well-known text, in two dimensions."""
    kind, c = g["type"], g.get("coordinates")
    rings = lambda x: "(" + ", ".join(f"({_line(r)})" for r in x) + ")"
    if kind == "GeometryCollection":
        return "GEOMETRYCOLLECTION (" + ", ".join(map(shape, g["geometries"])) + ")"
    body = {"Point": lambda: f"({_line([c])})", "LineString": lambda: f"({_line(c)})", "MultiPoint": lambda: f"({_line(c)})", "Polygon": lambda: rings(c), "MultiLineString": lambda: rings(c), "MultiPolygon": lambda: "(" + ", ".join(map(rings, c)) + ")"}[kind]
    return f"{kind.upper()} {body()}"


def features(v) -> Iterator[tuple]:
    """(feature, id, property, value, geometry) for each property; one row where there is none."""
    rows = v["features"] if v.get("type") == "FeatureCollection" else [v] if v.get("type") == "Feature" else [{"geometry": v}]
    for n, f in enumerate(rows):
        g = shape(f["geometry"]) if f.get("geometry") else None
        for k, x in (f.get("properties") or {None: None}).items():
            yield n, f.get("id"), k, x, g


def geojson_lines(data: bytes) -> Iterator[tuple]:
    s = text(data)
    for n, part in enumerate(p for p in (s.split("\x1e") if "\x1e" in s else s.splitlines()) if p.strip()):
        for _, *row in features(loads(part.encode())):
            yield n, *row


def topojson(data: bytes) -> Iterator[tuple]:
    """Features of arcs: delta-coded positions, ``~i`` reversed, joined ends once."""
    v = loads(data)
    if v.get("type") != "Topology":
        raise ValueError("not a topology")
    scale, move = (v["transform"][k] for k in ("scale", "translate")) if "transform" in v else ((1, 1), (0, 0))

    def placed(p):
        return [p[0] * scale[0] + move[0], p[1] * scale[1] + move[1]]

    arcs = []
    for a in v["arcs"]:
        if "transform" in v:
            x = y = 0
            out = []
            for p in a:
                x, y = x + p[0], y + p[1]
                out.append(placed((x, y)))
            arcs.append(out)
        else:
            arcs.append(a)

    def chain(refs):
        out = []
        for r in refs:
            part = arcs[r] if r >= 0 else arcs[~r][::-1]
            if out and out[-1] != part[0]:
                raise ValueError("arcs don't meet")
            out += part[1:] if out else part
        return out

    def solid(g):
        kind = g["type"]
        if kind == "GeometryCollection":
            return {"type": kind, "geometries": [solid(x) for x in g["geometries"]]}
        if kind in ("Point", "MultiPoint"):
            c = g["coordinates"]
            return {"type": kind, "coordinates": placed(c) if kind == "Point" else [placed(x) for x in c]}
        deep = {"LineString": chain, "MultiLineString": lambda x: [chain(y) for y in x], "Polygon": lambda x: [chain(y) for y in x], "MultiPolygon": lambda x: [[chain(z) for z in y] for y in x]}[kind]
        return {"type": kind, "coordinates": deep(g["arcs"])}

    n = 0
    for layer in sorted(v["objects"]):
        o = v["objects"][layer]
        for g in o["geometries"] if o["type"] == "GeometryCollection" else [o]:
            for k, x in (g.get("properties") or {None: None}).items():
                yield n, g.get("id"), k, x, shape(solid(g))
            n += 1


def wkt(data: bytes) -> Iterator[tuple]:
    """One geometry a line, with its reference system; unbalanced or unknown ones are errors."""
    kinds = "POINT|LINESTRING|POLYGON|MULTIPOINT|MULTILINESTRING|MULTIPOLYGON|GEOMETRYCOLLECTION"
    for n, x in enumerate(x.strip() for x in re.split(r"[;\n]", re.sub(r"(?i)SRID=(\d+);", r"SRID=\1 ", text(data))) if x.strip() and not x.strip().startswith("#")):
        m = re.match(rf"(?i)(?:SRID=(\d+)\s+)?({kinds})\s*(Z|M|ZM)?\s*(EMPTY|\(.*\))$", x, re.S)
        if not m or m[4].count("(") != m[4].count(")"):
            raise ValueError(f"geometry: {x[:40]}")
        yield n, m[1], m[2].upper(), len(re.findall(r"[-+\d.eE]+(?:\s+[-+\d.eE]+)+", m[4])), " ".join(m[4].split())


def gpx(data: bytes) -> Iterator[tuple]:
    """Waypoints, and the points of routes and track segments in order."""
    root = rooted(data, "gpx")
    point = lambda p: (float(attr(p, "lat")), float(attr(p, "lon")), own(p, "ele"), own(p, "time"))
    for w in kids(root, "wpt"):
        yield "waypoint", own(w, "name"), 0, *point(w)
    for r in kids(root, "rte"):
        for p in kids(r, "rtept"):
            yield "route", own(r, "name"), 0, *point(p)
    for t in kids(root, "trk"):
        for n, s in enumerate(kids(t, "trkseg")):
            for p in kids(s, "trkpt"):
                yield "track", own(t, "name"), n, *point(p)


def kml(data: bytes) -> Iterator[tuple]:
    def points(e):
        return [[float(v) for v in p.split(",")] for p in said(kid(e, "coordinates")).split()]

    def solid(e):
        n = name(e)
        if n == "Point":
            return f"POINT ({_line(points(e))})"
        if n in ("LineString", "LinearRing"):
            return f"LINESTRING ({_line(points(e))})"
        if n == "Polygon":
            rings = [points(r) for b in kids(e, "outerBoundaryIs", "innerBoundaryIs") for r in kids(b, "LinearRing")]
            return "POLYGON (" + ", ".join(f"({_line(r)})" for r in rings) + ")"
        return "GEOMETRYCOLLECTION (" + ", ".join(map(solid, kids(e, "Point", "LineString", "LinearRing", "Polygon", "MultiGeometry"))) + ")"

    for p in every(rooted(data, "kml"), "Placemark"):
        for g in kids(p, "Point", "LineString", "LinearRing", "Polygon", "MultiGeometry"):
            yield own(p, "name"), own(p, "description"), solid(g)


def kmz(data: bytes) -> Iterator[tuple]:
    z = zipfile.ZipFile(BytesIO(data))
    for n in sorted(x for x in z.namelist() if x.lower().endswith(".kml")):
        yield from kml(z.read(n))


def gml(data: bytes) -> Iterator[tuple]:
    """Geometries of features; latitude comes first where the reference system is named as a URN."""
    for member in every(parse(data), "featureMember", "member"):
        for f in member:
            for g in every(f, "Point", "LineString", "Polygon"):
                swap = "urn:" in (attr(g, "srsName") or "")

                def points(e, swap=swap):
                    if name(e) in ("pos", "posList"):
                        v = [float(x) for x in said(e).split()]
                        pairs = list(zip(v[::2], v[1::2], strict=True))
                    else:
                        pairs = [tuple(float(x) for x in p.split(",")[:2]) for p in said(e).split()]
                    return [(b, a) for a, b in pairs] if swap else pairs

                lists = [points(x) for x in every(g, "pos", "posList", "coordinates")]
                if name(g) == "Polygon":
                    yield name(f), attr(f, "id"), "POLYGON (" + ", ".join(f"({_line(p)})" for p in lists) + ")"
                else:
                    yield name(f), attr(f, "id"), f"{name(g).upper()} ({_line([p for x in lists for p in x])})"


def georss(data: bytes) -> Iterator[tuple]:
    for e in every(parse(data), "item", "entry"):
        for g in kids(e, "point", "line", "polygon", "box"):
            v = [float(x) for x in said(g).replace(",", " ").split()]
            pairs = [(b, a) for a, b in zip(v[::2], v[1::2], strict=True)]
            if name(g) == "box":
                (x, y), (z, w) = pairs
                pairs = [(x, y), (z, y), (z, w), (x, w), (x, y)]
            body = {"point": "POINT ({})", "line": "LINESTRING ({})"}.get(name(g), "POLYGON (({}))").format(_line(pairs))
            yield own(e, "title"), name(g), body


def ascii_grid(data: bytes) -> Iterator[tuple]:
    """Cells from the upper left, with their share between the least and the largest value (0.5 if
    all are equal); those without data have no share."""
    lines = text(data).splitlines()
    head = {}
    while lines and re.match(r"\s*[A-Za-z_]", lines[0]):
        k, v = lines.pop(0).split()
        head[k.lower()] = float(v)
    values = [float(x) for line in lines for x in line.split()]
    columns, rows, none = int(head["ncols"]), int(head["nrows"]), head.get("nodata_value", -9999.0)
    if len(values) != columns * rows:
        raise ValueError(f"{len(values)} cells instead of {columns * rows}")
    real = [v for v in values if v != none]
    low, high = (min(real), max(real)) if real else (0, 0)
    for i, v in enumerate(values):
        yield i // columns, i % columns, None if v == none else v, None if v == none else 0.5 if high == low else (v - low) / (high - low)


def dbf(data: bytes) -> Iterator[tuple]:
    """Cells of the rows that aren't marked as deleted."""
    rows, head, width = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while data[at] != 0x0D:
        label = data[at : at + 11].split(b"\0")[0].decode("latin-1")
        fields.append((label, chr(data[at + 11]), data[at + 16]))
        at += 32
    for r in range(rows):
        raw = data[head + r * width : head + (r + 1) * width]
        if raw[:1] not in (b" ", b"*") or len(raw) < width:
            raise ValueError(f"row {r + 1}")
        if raw[:1] == b"*":
            continue
        at = 1
        for label, kind, size in fields:
            value = raw[at : at + size].decode("utf-8", "replace").strip()
            at += size
            if kind == "L":
                value = {"T": "true", "Y": "true", "F": "false", "N": "false"}.get(value.upper())
            elif kind == "D" and len(value) == 8:
                value = f"{value[:4]}-{value[4:6]}-{value[6:]}"
            yield r + 1, label, kind, value or None


def shapefile(data: bytes) -> Iterator[tuple]:
    if struct.unpack_from(">I", data)[0] != 9994:
        raise ValueError("not a shapefile")
    at = 100
    while at + 12 <= len(data):
        n, size = struct.unpack_from(">II", data, at)
        (kind,) = struct.unpack_from("<I", data, at + 8)
        body, flat = at + 12, kind % 10
        if kind == 0:
            yield n, None
        elif flat == 1:
            yield n, f"POINT ({_line([struct.unpack_from('<2d', data, body)])})"
        elif flat == 8:
            (m,) = struct.unpack_from("<I", data, body + 32)
            v = struct.unpack_from(f"<{2 * m}d", data, body + 36)
            yield n, f"MULTIPOINT ({_line(list(zip(v[::2], v[1::2], strict=True)))})"
        elif flat in (3, 5):
            parts, m = struct.unpack_from("<II", data, body + 32)
            starts = [*struct.unpack_from(f"<{parts}I", data, body + 40), m]
            v = struct.unpack_from(f"<{2 * m}d", data, body + 40 + 4 * parts)
            points = list(zip(v[::2], v[1::2], strict=True))
            rings = [points[a:b] for a, b in zip(starts, starts[1:], strict=False)]
            area = lambda r: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:], strict=False))
            if flat == 3:
                yield n, "MULTILINESTRING (" + ", ".join(f"({_line(r)})" for r in rings) + ")"
            else:  # outer rings run clockwise, holes follow theirs
                shells: list[list] = []
                for r in rings:
                    if area(r) <= 0 or not shells:
                        shells.append([r])
                    else:
                        shells[-1].append(r)
                yield n, "MULTIPOLYGON (" + ", ".join("(" + ", ".join(f"({_line(r)})" for r in s) + ")" for s in shells) + ")"
        else:
            raise ValueError(f"shape kind {kind}")
        at += 8 + 2 * size


def opendrive(data: bytes) -> Iterator[tuple]:
    for r in every(rooted(data, "OpenDRIVE"), "road"):
        for g in every(r, "geometry"):
            kind = next((name(x) for x in g), None)
            yield attr(r, "id"), attr(r, "name"), kind, *(attr(g, k) for k in ("s", "x", "y", "hdg", "length")), attr(next(iter(g), None), "curvature")


FEATURE = ("feature", "id", "property", "value", "geometry")
FORMATS = {
    "geojson": Format(FEATURE, lambda d: features(loads(d)), (".geojson",), lambda h: h.lstrip()[:1] == b"{" and bool(re.search(rb'"type"\s*:\s*"(Feature|FeatureCollection)"', h))),
    "geojsonseq": Format(FEATURE, geojson_lines, (".geojsons", ".geojsonl", ".geojsonseq")),
    "topojson": Format(FEATURE, topojson, (".topojson",), lambda h: bool(re.search(rb'"type"\s*:\s*"Topology"', h))),
    "wkt": Format(("feature", "srid", "kind", "points", "coordinates"), wkt, (".wkt", ".ewkt")),
    "gpx": Format(("kind", "name", "segment", "lat", "lon", "elevation", "time"), gpx, (".gpx",), root_is("gpx")),
    "kml": Format(("name", "description", "geometry"), kml, (".kml",), root_is("kml")),
    "kmz": Format(("name", "description", "geometry"), kmz, (".kmz",)),
    "gml": Format(("feature", "id", "geometry"), gml, (".gml",), root_is("FeatureCollection", having=b"opengis.net/gml")),
    "georss": Format(("title", "kind", "geometry"), georss, (".georss",)),
    "esri_ascii_grid": Format(("row", "column", "value", "share"), ascii_grid, (".asc", ".grd"), lambda h: bool(re.match(rb"(?i)\s*ncols\s", h))),
    "dbf": Format(("row", "field", "type", "value"), dbf, (".dbf",)),
    "shapefile": Format(("record", "geometry"), shapefile, (".shp",), lambda h: h.startswith(b"\x00\x00\x27\x0a")),
    "opendrive": Format(("road", "name", "kind", "s", "x", "y", "heading", "length", "curvature"), opendrive, (".xodr",), root_is("OpenDRIVE")),
}
