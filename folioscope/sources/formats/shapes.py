"""Meshes, point clouds, molecules and drawings: vertices and faces, or primitives with coordinates."""

from __future__ import annotations

import re
import struct
from collections import Counter
from collections.abc import Iterator

from ..files import Format, loads, text
from .jsons import joined
from .packages import Package
from .xmltree import attr, every, kid, kids, name, own, root_is, rooted, said

# Rows of a mesh: ("v", number from 0, x, y, z, None) and ("f", number, None, None, None, "corner numbers").


def _mesh(points, faces) -> Iterator[tuple]:
    n = 0
    for n, p in enumerate(points, 1):
        yield "v", n - 1, *(float(x) for x in (list(p) + [0, 0, 0])[:3]), None
    for i, f in enumerate(faces):
        if any(not 0 <= c < n for c in f):
            raise ValueError(f"face {i} names a vertex that isn't there")
        yield "f", i, None, None, None, " ".join(map(str, f))


def obj(data: bytes) -> Iterator[tuple]:
    points, faces = [], []
    for line in text(data).splitlines():
        f = line.split()
        if f[:1] == ["v"]:
            points.append(f[1:4])
        elif f[:1] == ["f"]:
            corners = [int(c.split("/")[0]) for c in f[1:]]
            faces.append([c - 1 if c > 0 else len(points) + c for c in corners])
    yield from _mesh(points, faces)


def off(data: bytes) -> Iterator[tuple]:
    s = re.sub(r"#[^\n]*", "", text(data)).split()
    if not re.fullmatch(r"(ST)?(C|N|CN)?4?n?OFF", s[0]):
        raise ValueError("no OFF header")
    width = 3 + 3 * ("N" in s[0]) + 4 * ("C" in s[0])
    n, m = int(s[1]), int(s[2])
    v, at = s[4 : 4 + n * width], 4 + n * width
    faces = []
    for _ in range(m):
        k = int(s[at])
        faces.append([int(x) for x in s[at + 1 : at + 1 + k]])
        at += 1 + k
    yield from _mesh([v[i * width : i * width + 3] for i in range(n)], faces)


def _welded(triangles) -> Iterator[tuple]:
    """Triangles of corners as a mesh in which equal corners are one vertex."""
    index: dict[tuple, int] = {}
    faces = [[index.setdefault(tuple(map(float, c)), len(index)) for c in t] for t in triangles]
    yield from _mesh(list(index), faces)


def stl(data: bytes) -> Iterator[tuple]:
    if len(data) >= 84 and len(data) == 84 + 50 * struct.unpack_from("<I", data, 80)[0]:
        n = struct.unpack_from("<I", data, 80)[0]
        yield from _welded([[struct.unpack_from("<3f", data, 84 + 50 * i + 12 * k) for k in (1, 2, 3)] for i in range(n)])
        return
    corners = [m.split() for m in re.findall(r"\bvertex\s+(\S+\s+\S+\s+\S+)", text(data))]
    if not data.lstrip().startswith(b"solid") or len(corners) % 3:
        raise ValueError("no facets")
    yield from _welded([corners[i : i + 3] for i in range(0, len(corners), 3)])


_PLY = {"char": "b", "int8": "b", "uchar": "B", "uint8": "B", "short": "h", "int16": "h", "ushort": "H", "uint16": "H", "int": "i", "int32": "i", "uint": "I", "uint32": "I", "float": "f", "float32": "f", "double": "d", "float64": "d"}


def ply(data: bytes) -> Iterator[tuple]:
    head, mark, body = data.partition(b"end_header")
    if not data.startswith(b"ply") or not mark:
        raise ValueError("no PLY header")
    body = body[body.index(b"\n") + 1 :]
    order, elements = "", []
    for line in head.decode("ascii", "replace").splitlines():
        f = line.split()
        if f[:1] == ["format"]:
            order = {"ascii": "", "binary_little_endian": "<", "binary_big_endian": ">"}[f[1]]
        elif f[:1] == ["element"]:
            elements.append((f[1], int(f[2]), []))
        elif f[:1] == ["property"]:
            elements[-1][2].append(f[1:])
    words, at, points, faces = iter(body.split()) if not order else None, 0, [], []

    def read(kind):
        nonlocal at
        if not order:
            x = next(words)
            return float(x) if _PLY[kind] in "fd" else int(x)
        (x,) = struct.unpack_from(order + _PLY[kind], body, at)
        at += struct.calcsize(_PLY[kind])
        return x

    for element, n, fields in elements:
        for _ in range(n):
            row = {f[-1]: [read(f[2]) for _ in range(read(f[1]))] if f[0] == "list" else read(f[0]) for f in fields}
            if element == "vertex":
                points.append([row["x"], row["y"], row.get("z", 0)])
            elif element == "face":
                faces.append(row.get("vertex_indices") or row.get("vertex_index"))
    yield from _mesh(points, faces)


def pcd(data: bytes) -> Iterator[tuple]:
    head = dict((k, v.split()) for k, _, v in (x.decode().partition(" ") for x in data[: data.index(b"DATA")].splitlines() if not x.startswith(b"#")))
    at = data.index(b"\n", data.index(b"DATA")) + 1
    mode = data[data.index(b"DATA") + 5 : at].strip()
    names, n = head["FIELDS"], int(head["POINTS"][0])
    if mode == b"ascii":
        rows = [x.split() for x in data[at:].decode().splitlines() if x.strip()]
    elif mode == b"binary":
        code = "".join({"F4": "f", "F8": "d", "U1": "B", "U2": "H", "U4": "I", "I1": "b", "I2": "h", "I4": "i"}[t + s] for t, s in zip(head["TYPE"], head["SIZE"], strict=True))
        rows = [struct.unpack_from("<" + code, data, at + i * struct.calcsize("<" + code)) for i in range(n)]
    else:
        raise ValueError("compressed points")
    if len(rows) != n:
        raise ValueError(f"{len(rows)} points instead of {n}")
    for i, r in enumerate(rows):
        v = dict(zip(names, r, strict=False))
        yield "v", i, float(v["x"]), float(v["y"]), float(v["z"]), None


def points(data: bytes) -> Iterator[tuple]:
    """Points a line, blanks or commas between; a first line that is a count or names is skipped."""
    n = 0
    for i, line in enumerate(text(data).splitlines()):
        f = [x for x in re.split(r"[\s,;]+", line.strip()) if x]
        if not f or f[0].startswith(("#", "//")) or (len(f) < 3 and f[0].isdigit()) or (i == 0 and not re.match(r"[-+.\d]", f[0])):
            continue
        if len(f) < 3:
            raise ValueError(f"line {i + 1}")
        yield "v", n, *map(float, f[:3]), " ".join(f[3:]) or None
        n += 1


def ptx(data: bytes) -> Iterator[tuple]:
    """Scans of columns x rows points, moved by the pose that comes before them."""
    lines, at, n = text(data).split("\n"), 0, 0
    while at + 10 < len(lines) and lines[at].strip():
        size = int(lines[at]) * int(lines[at + 1])
        m = [[float(x) for x in lines[at + 6 + k].split()] for k in range(4)]
        for line in lines[at + 10 : at + 10 + size]:
            v = [float(x) for x in line.split()]
            if any(v[:3]):
                p = [sum(v[k] * m[k][j] for k in range(3)) + m[3][j] for j in range(3)]
                yield "v", n, *p, " ".join(f"{x:g}" for x in v[3:]) or None
                n += 1
        at += 10 + size


def threemf(data: bytes) -> Iterator[tuple]:
    pack = Package(data)
    corners, faces = [], []
    for part in sorted(n for n in pack.names if n.endswith(".model")):
        for mesh in every(pack.tree(part), "mesh"):
            base = len(corners)
            corners += [[attr(v, k) for k in "xyz"] for v in every(mesh, "vertex")]
            faces += [[base + int(attr(t, k)) for k in ("v1", "v2", "v3")] for t in every(mesh, "triangle")]
    yield from _mesh(corners, faces)


def amf(data: bytes) -> Iterator[tuple]:
    corners, faces = [], []
    for mesh in every(rooted(data, "amf"), "mesh"):
        base = len(corners)
        corners += [[own(c, k) for k in "xyz"] for c in every(mesh, "coordinates")]
        faces += [[base + int(own(t, k)) for k in ("v1", "v2", "v3")] for t in every(mesh, "triangle")]
    yield from _mesh(corners, faces)


def x3d(data: bytes) -> Iterator[tuple]:
    corners, faces = [], []
    for e in every(rooted(data, "X3D"), "IndexedFaceSet", "IndexedTriangleSet"):
        base = len(corners)
        v = [float(x) for x in re.split(r"[\s,]+", (attr(kid(e, "Coordinate"), "point") or "").strip()) if x]
        corners += [v[i : i + 3] for i in range(0, len(v), 3)]
        index = [int(x) for x in re.split(r"[\s,]+", (attr(e, "coordIndex") or attr(e, "index") or "").strip()) if x]
        faces += _faces(index, base) if name(e) == "IndexedFaceSet" else [[base + c for c in index[i : i + 3]] for i in range(0, len(index), 3)]
    yield from _mesh(corners, faces)


def _faces(index: list[int], base: int) -> list[list[int]]:
    """Lists of corners that -1 ends."""
    out: list[list[int]] = [[]]
    for i in index:
        if i < 0:
            out.append([])
        else:
            out[-1].append(base + i)
    return [f for f in out if f]


def vrml(data: bytes) -> Iterator[tuple]:
    s = re.sub(r"#[^\n]*", "", text(data))
    corners, faces = [], []
    for m in re.finditer(r"IndexedFaceSet\s*\{(?:[^{}]|\{[^{}]*\})*\}", s):
        base = len(corners)
        v = [float(x) for x in re.split(r"[\s,]+", re.search(r"\bpoint\s*\[([^\]]*)\]", m[0])[1].strip()) if x]
        corners += [v[i : i + 3] for i in range(0, len(v), 3)]
        index = re.search(r"\bcoordIndex\s*\[([^\]]*)\]", m[0])
        faces += _faces([int(x) for x in re.split(r"[\s,]+", index[1].strip()) if x], base)
    yield from _mesh(corners, faces)


def collada(data: bytes) -> Iterator[tuple]:
    corners, faces = [], []
    for mesh in every(rooted(data, "COLLADA"), "mesh"):
        base = len(corners)
        arrays = {attr(s, "id"): [float(x) for x in (said(kid(s, "float_array")) or "").split()] for s in kids(mesh, "source")}
        where = {attr(v, "id"): attr(i, "source").lstrip("#") for v in kids(mesh, "vertices") for i in kids(v, "input") if attr(i, "semantic") == "POSITION"}
        v = arrays[next(iter(where.values()))]
        corners += [v[i : i + 3] for i in range(0, len(v), 3)]
        for t in kids(mesh, "triangles", "polylist"):
            inputs = kids(t, "input")
            stride = 1 + max(int(attr(i, "offset")) for i in inputs)
            offset = next(int(attr(i, "offset")) for i in inputs if attr(i, "semantic") == "VERTEX")
            p = [int(x) for x in said(kid(t, "p")).split()][offset::stride]
            sizes = [int(x) for x in said(kid(t, "vcount")).split()] if kid(t, "vcount") is not None else [3] * (len(p) // 3)
            at = 0
            for k in sizes:
                faces.append([base + c for c in p[at : at + k]])
                at += k
    yield from _mesh(corners, faces)


def gltf(data: bytes) -> Iterator[tuple]:
    """Meshes of a scene file with its buffers inside, text or binary."""
    import base64

    blob = b""
    if data[:4] == b"glTF":
        n = struct.unpack_from("<I", data, 12)[0]
        v, at = loads(data[20 : 20 + n].rstrip(b" \0")), 20 + n
        if at < len(data):
            blob = data[at + 8 : at + 8 + struct.unpack_from("<I", data, at)[0]]
    else:
        v = loads(data)
    buffers = [base64.b64decode(b["uri"].partition(",")[2]) if b.get("uri", "").startswith("data:") else blob for b in v.get("buffers", [])]

    def values(i):
        a = v["accessors"][i]
        view = v["bufferViews"][a["bufferView"]]
        code = {5120: "b", 5121: "B", 5122: "h", 5123: "H", 5125: "I", 5126: "f"}[a["componentType"]]
        k = {"SCALAR": 1, "VEC2": 2, "VEC3": 3, "VEC4": 4}[a["type"]]
        size = struct.calcsize("<" + code * k)
        start, step = view.get("byteOffset", 0) + a.get("byteOffset", 0), view.get("byteStride", size)
        return [struct.unpack_from("<" + code * k, buffers[view["buffer"]], start + j * step) for j in range(a["count"])]

    corners, faces = [], []
    for m in v.get("meshes", []):
        for p in m["primitives"]:
            if p.get("mode", 4) == 4:
                base = len(corners)
                corners += values(p["attributes"]["POSITION"])
                index = [x[0] for x in values(p["indices"])] if "indices" in p else range(len(corners) - base)
                faces += [[base + c for c in index[i : i + 3]] for i in range(0, len(index) - 2, 3)]
    yield from _mesh(corners, faces)


def su2(data: bytes) -> Iterator[tuple]:
    """Points and elements, then the markers' own elements by name."""
    sizes = {3: 2, 5: 3, 9: 4, 10: 4, 12: 8, 13: 6, 14: 5}  # fixed values: corners by element kind
    s = re.sub(r"%[^\n]*", "", text(data)).splitlines()
    dim, corners, faces, at, marker = 3, [], [], 0, None
    marked: list[tuple] = []
    while at < len(s):
        k, _, v = (x.strip() for x in s[at].partition("="))
        at += 1
        if k == "NDIME":
            dim = int(v)
        elif k == "MARKER_TAG":
            marker = v
        elif k in ("NPOIN", "NELEM", "MARKER_ELEMS"):
            n = int(v.split()[0])
            for line in s[at : at + n]:
                f = line.split()
                if k == "NPOIN":
                    corners.append(f[:dim])
                elif k == "NELEM":
                    faces.append([int(x) for x in f[1 : 1 + sizes[int(f[0])]]])
                else:
                    marked.append((marker, " ".join(f[1 : 1 + sizes[int(f[0])]])))
            at += n
    yield from _mesh(corners, faces)
    for i, (m, f) in enumerate(marked):
        yield f"marker {m}", i, None, None, None, f


def medit(data: bytes) -> Iterator[tuple]:
    sizes = {"Edges": 2, "Triangles": 3, "Quadrilaterals": 4, "Tetrahedra": 4, "Hexahedra": 8, "Prisms": 6, "Pyramids": 5}
    s, at, dim, corners, faces = re.sub(r"#[^\n]*", "", text(data)).split(), 0, 3, [], []
    if s[:1] != ["MeshVersionFormatted"]:
        raise ValueError("no MeshVersionFormatted")
    while at < len(s) and s[at] != "End":
        k = s[at]
        if k == "Dimension":
            dim, at = int(s[at + 1]), at + 2
        elif k == "Vertices" or k in sizes:
            width, n = (dim if k == "Vertices" else sizes[k]) + 1, int(s[at + 1])
            for i in range(n):
                row = s[at + 2 + i * width : at + 2 + (i + 1) * width - 1]
                if k == "Vertices":
                    corners.append(row)
                else:
                    faces.append([int(x) - 1 for x in row])
            at += 2 + n * width
        else:
            at += 1
    yield from _mesh(corners, faces)


def _numbered(found: dict[int, list], cells: list[list[int]]) -> Iterator[tuple]:
    """A mesh whose vertices have numbers of their own."""
    place = {k: i for i, k in enumerate(found)}
    yield from _mesh(found.values(), [[place[c] for c in f] for f in cells])


def abaqus(data: bytes) -> Iterator[tuple]:
    nodes, cells, section = {}, [], ""
    held: list[int] = []
    for line in text(data).splitlines():
        if line.startswith("**") or not line.strip():
            continue
        if line.startswith("*"):
            section, held = line[1:].split(",")[0].strip().lower(), []
        elif section == "node":
            f = [x.strip() for x in line.split(",")]
            nodes[int(f[0])] = f[1:4]
        elif section == "element":
            held += [int(x) for x in line.split(",") if x.strip()]
            if not line.rstrip().endswith(","):
                cells.append(held[1:])
                held = []
    yield from _numbered(nodes, cells)


def nastran(data: bytes) -> Iterator[tuple]:
    """GRID points and elements in free or fixed small fields; a + continues a card."""
    sizes = {"CTRIA3": 3, "CQUAD4": 4, "CTETRA": 4, "CHEXA": 8, "CPENTA": 6, "CBAR": 2, "CROD": 2}
    cards: list[list[str]] = []
    for line in text(data).splitlines():
        line = line.split("$")[0].rstrip()
        if not line:
            continue
        f = [x.strip() for x in line.split(",")] if "," in line else [line[i : i + 8].strip() for i in range(0, min(72, len(line)), 8)]
        if line[0] in "+ ":
            cards[-1] += f[1:]
        else:
            cards.append(f)
    real = lambda x: float(re.sub(r"(?<=[\d.])([-+]\d+)$", r"e\1", x)) if x else 0.0
    nodes = {int(f[1]): [real(x) for x in (f[3:6] + ["", "", ""])[:3]] for f in cards if f[0] == "GRID"}
    yield from _numbered(nodes, [[int(x) for x in f[3 : 3 + sizes[f[0]]]] for f in cards if f[0] in sizes])


def lsdyna(data: bytes) -> Iterator[tuple]:
    nodes, cells, section = {}, [], ""
    for line in text(data).splitlines():
        if line.startswith("$") or not line.strip():
            continue
        if line.startswith("*"):
            section = line.strip().upper()
        elif section.startswith("*NODE"):
            f = line.split(",") if "," in line else [line[:8], line[8:24], line[24:40], line[40:56]]
            nodes[int(f[0])] = [float(x) for x in f[1:4]]
        elif section.startswith("*ELEMENT"):
            f = [int(x) for x in (line.split(",") if "," in line else re.findall(".{1,8}", line.rstrip())) if x.strip()]
            cells.append(list(dict.fromkeys(x for x in f[2:] if x)))
    yield from _numbered(nodes, cells)


def gmsh(data: bytes) -> Iterator[tuple]:
    """Mesh files of version 2 and 4 in text, and legacy VTK grids in text."""
    s = text(data)
    if s.startswith("# vtk DataFile"):
        t = s.split("\n", 3)[3].split()
        at = t.index("POINTS")
        n = int(t[at + 1])
        v = t[at + 3 : at + 3 + 3 * n]
        key = next((k for k in ("CELLS", "POLYGONS") if k in t), None)
        faces = []
        if key:
            at = t.index(key) + 3
            for _ in range(int(t[t.index(key) + 1])):
                k = int(t[at])
                faces.append([int(x) for x in t[at + 1 : at + 1 + k]])
                at += 1 + k
        yield from _mesh([v[i : i + 3] for i in range(0, 3 * n, 3)], faces)
        return
    part = lambda k: [x.split() for x in re.search(rf"\${k}\s*\n(.*?)\n\$End{k}", s, re.S)[1].splitlines()]
    version = part("MeshFormat")[0][0]
    nodes, cells = {}, []
    if version.startswith("2"):
        nodes = {int(f[0]): f[1:4] for f in part("Nodes")[1:]}
        cells = [[int(x) for x in f[3 + int(f[2]) :]] for f in part("Elements")[1:]]
    else:
        rows, at = part("Nodes"), 1
        while at < len(rows):
            n = int(rows[at][3])
            for a, b in zip(rows[at + 1 : at + 1 + n], rows[at + 1 + n : at + 1 + 2 * n], strict=True):
                nodes[int(a[0])] = b[:3]
            at += 1 + 2 * n
        rows, at = part("Elements"), 1
        while at < len(rows):
            n = int(rows[at][3])
            cells += [[int(x) for x in f[1:]] for f in rows[at + 1 : at + 1 + n]]
            at += 1 + n
    yield from _numbered(nodes, cells)


def unv(data: bytes) -> Iterator[tuple]:
    nodes, cells = {}, []
    for part in re.split(r"(?m)^ {4}-1\s*$", text(data)):
        lines = [x for x in part.splitlines() if x.strip()]
        if lines and lines[0].strip() in ("2411", "781"):
            for a, b in zip(lines[1::2], lines[2::2], strict=False):
                nodes[int(a.split()[0])] = b.replace("D", "E").split()[:3]
        elif lines and lines[0].strip() in ("2412", "780"):
            at = 1
            while at < len(lines):
                head = [int(x) for x in lines[at].split()]
                at += 2 if head[1] in (11, 21, 22, 24) else 1
                got: list[int] = []
                while len(got) < head[-1]:
                    got += [int(x) for x in lines[at].split()]
                    at += 1
                cells.append(got)
    yield from _numbered(nodes, cells)


def tecplot(data: bytes) -> Iterator[tuple]:
    """Zones of points: finite elements with corners from 1, or ordered ones without faces."""
    s = re.sub(r"#[^\n]*", "", text(data))
    corners, faces = [], []
    for zone in re.split(r"(?im)^\s*ZONE\b", s)[1:]:
        get = lambda k, zone=zone: (m := re.search(rf"(?i)\b{k}\s*=\s*\"?([\w]+)", zone)) and m[1]
        rows = [x.split() for x in zone.splitlines() if re.match(r"\s*[-+.\d]", x)]
        n = int(get("N") or get("NODES") or int(get("I") or 1) * int(get("J") or 1) * int(get("K") or 1))
        base = len(corners)
        corners += [r[:3] for r in rows[:n]]
        e = get("E") or get("ELEMENTS")
        faces += [[base + int(x) - 1 for x in r] for r in rows[n : n + int(e)]] if e else []
    yield from _mesh(corners, faces)


def plot3d(data: bytes) -> Iterator[tuple]:
    """Formatted single or several blocks: all x, all y, all z; quads of the first layer as faces."""
    lines = text(data).split("\n")
    many = len(lines[0].split()) == 1
    v = [x for line in lines for x in line.split()]
    blocks = int(v[0]) if many else 1
    at = 1 if many else 0
    sizes = [[int(x) for x in v[at + 3 * b : at + 3 * b + 3]] for b in range(blocks)]
    at += 3 * blocks
    corners, faces = [], []
    for i, j, k in sizes:
        n, base = i * j * k, len(corners)
        xyz = [v[at + m * n : at + (m + 1) * n] for m in range(3)]
        corners += list(zip(*xyz, strict=True))
        at += 3 * n
        faces += [[base + b * i + a, base + b * i + a + 1, base + (b + 1) * i + a + 1, base + (b + 1) * i + a] for b in range(j - 1) for a in range(i - 1)]
    yield from _mesh(corners, faces)


def ifc(data: bytes) -> Iterator[tuple]:
    """Entities of a Part 21 file: number, kind, arguments, what they refer to."""
    s = re.sub(r"/\*.*?\*/", "", text(data), flags=re.S)
    if not s.lstrip().startswith("ISO-10303-21"):
        raise ValueError("no Part 21 header")
    body = re.search(r"\bDATA\s*;(.*?)\bENDSEC\s*;", s, re.S)
    for m in re.finditer(r"#(\d+)\s*=\s*([A-Z0-9_]*)\s*(\((?:[^;']|'(?:[^']|'')*')*\))\s*;", body[1]):
        plain = re.sub(r"'(?:[^']|'')*'", "", m[3])
        yield int(m[1]), m[2] or None, " ".join(m[3][1:-1].split()), " ".join(re.findall(r"#(\d+)", plain)) or None


def iges(data: bytes) -> Iterator[tuple]:
    """Entities by directory entry: kind, level, first parameters."""
    lines = text(data).splitlines()
    section = lambda k: [x for x in lines if len(x) > 72 and x[72] == k]
    entries, parameters = section("D"), section("P")
    for a, b in zip(entries[::2], entries[1::2], strict=True):
        start, count = int(a[8:16]), int(b[24:32])
        body = "".join(x[:64] for x in parameters[start - 1 : start - 1 + count]).split(";")[0]
        yield int(a[73:80]), int(a[:8]), a[32:40].strip() or None, joined((x.strip() for x in body.split(",")[1:]), " ")


def pdb(data: bytes) -> Iterator[tuple]:
    model = 1
    for x in text(data).splitlines():
        if x.startswith("MODEL"):
            model = int(x.split()[1])
        elif x.startswith(("ATOM  ", "HETATM")):
            yield model, int(x[6:11]), x[12:16].strip(), x[17:20].strip(), x[21].strip() or None, int(x[22:26]), float(x[30:38]), float(x[38:46]), float(x[46:54]), x[76:78].strip() or None


def cif(data: bytes) -> Iterator[tuple]:
    """Atoms of the loop of sites."""
    tokens = re.findall(r"(?m)^;[^\0]*?^;|'(?:[^']|'(?=\S))*'|\"(?:[^\"]|\"(?=\S))*\"|[^\s]+", re.sub(r"(?m)(^|\s)#[^\n]*", r"\1", text(data)))
    at = next((i for i, t in enumerate(tokens) if t.startswith("_atom_site.")), None)
    if at is None:
        raise ValueError("no atom sites")
    heads = []
    while tokens[at].startswith("_atom_site."):
        heads.append(tokens[at][11:])
        at += 1
    while at + len(heads) <= len(tokens) and not tokens[at].startswith(("_", "loop_", "data_")):
        v = dict(zip(heads, (t.strip("'\"") for t in tokens[at : at + len(heads)]), strict=True))
        yield int(v.get("pdbx_PDB_model_num") or 1), int(v["id"]), v.get("label_atom_id"), v.get("label_comp_id"), v.get("label_asym_id"), v.get("label_seq_id"), float(v["Cartn_x"]), float(v["Cartn_y"]), float(v["Cartn_z"]), v.get("type_symbol")
        at += len(heads)


def _molecule(lines: list[str], n: int) -> Iterator[tuple]:
    atoms, bonds = int(lines[3][:3]), int(lines[3][3:6])
    if "V2000" not in lines[3]:
        raise ValueError("not V2000")
    for i, x in enumerate(lines[4 : 4 + atoms], 1):
        yield n, lines[0].strip(), "atom", i, x[31:34].strip(), float(x[:10]), float(x[10:20]), float(x[20:30]), None
    for i, x in enumerate(lines[4 + atoms : 4 + atoms + bonds], 1):
        yield n, lines[0].strip(), "bond", i, int(x[6:9]), None, None, None, f"{int(x[:3])} {int(x[3:6])}"


def mol(data: bytes) -> Iterator[tuple]:
    for n, part in enumerate(re.split(r"(?m)^\$\$\$\$\s*\n?", text(data)), 1):
        if part.strip():
            yield from _molecule(part.splitlines(), n)


def rxn(data: bytes) -> Iterator[tuple]:
    for n, part in enumerate(re.split(r"(?m)^\$MOL\s*\n", text(data))[1:], 1):
        yield from _molecule(part.splitlines(), n)


def mol2(data: bytes) -> Iterator[tuple]:
    for n, part in enumerate(text(data).split("@<TRIPOS>MOLECULE")[1:], 1):
        label, section = part.strip().splitlines()[0].strip(), ""
        for x in part.splitlines():
            f = x.split()
            if x.startswith("@<TRIPOS>"):
                section = x[9:].strip()
            elif section == "ATOM" and len(f) >= 6:
                yield n, label, "atom", int(f[0]), f[5].split(".")[0], *map(float, f[2:5]), None
            elif section == "BOND" and len(f) >= 4:
                yield n, label, "bond", int(f[0]), f[3], None, None, None, f"{f[1]} {f[2]}"


def gcode(data: bytes) -> Iterator[tuple]:
    """Moves with their end points; G90/G91, G92 and units are followed."""
    at, relative, scale, mode = {"X": 0.0, "Y": 0.0, "Z": 0.0}, False, 1.0, None
    for n, line in enumerate(text(data).splitlines(), 1):
        line = re.sub(r"\([^)]*\)|;.*", "", line).upper()
        words = [(a, float(b)) for a, b in re.findall(r"([A-Z])\s*([-+]?\d*\.?\d+)", line)]
        for k in (v for a, v in words if a == "G"):
            relative = k == 91 if k in (90, 91) else relative
            scale = {20: 25.4, 21: 1.0}.get(k, scale)
            mode = int(k) if k in (0, 1, 2, 3, 92) else mode
        axes = {a: v * scale for a, v in words if a in "XYZ"}
        if mode == 92 and ("G", 92.0) in words:
            at |= axes
            mode = None
        elif axes and mode is not None:
            start = dict(at)
            for a, v in axes.items():
                at[a] = at[a] + v if relative else v
            yield n, "arc" if mode in (2, 3) else "rapid" if mode == 0 else "line", *start.values(), *at.values()


def excellon(data: bytes) -> Iterator[tuple]:
    """Hits by tool with diameter; numbers without a point have the format's decimals."""
    sizes, tool, x, y, units, n = {}, None, 0.0, 0.0, "inch", 0
    for line in text(data).splitlines():
        line = line.split(";")[0].strip()
        units = "mm" if line.startswith("METRIC") else "inch" if line.startswith("INCH") else units
        digits = 1000 if units == "mm" else 10000
        if m := re.match(r"T(\d+)C([\d.]+)", line):
            sizes[int(m[1])] = float(m[2])
        elif m := re.fullmatch(r"T(\d+)", line):
            tool = int(m[1])
        elif m := re.match(r"(?:X([-+\d.]+))?(?:Y([-+\d.]+))?$", line):
            if m[1] or m[2]:
                value = lambda t: float(t) if "." in t else int(t) / digits  # noqa: E731, B023
                x, y = value(m[1]) if m[1] else x, value(m[2]) if m[2] else y
                if tool not in sizes:
                    raise ValueError(f"tool {tool}")
                n += 1
                yield n, tool, sizes[tool], x, y, units


def gerber(data: bytes) -> Iterator[tuple]:
    """Draws, moves and flashes with the aperture in use."""
    s = text(data)
    form = re.search(r"%FS[LT][AI]X\d(\d)Y\d(\d)\*%", s)
    if not form:
        raise ValueError("no format statement")
    scale = 10 ** int(form[1])
    apertures = {m[1]: f"{m[2]},{m[3]}" for m in re.finditer(r"%ADD(\d+)([A-Z]\w*)(?:,([^*]*))?\*%", s)}
    x = y = 0.0
    tool, n = None, 0
    for m in re.finditer(r"(?:G0?[123])?(?:X([-+]?\d+))?(?:Y([-+]?\d+))?(?:I[-+]?\d+)?(?:J[-+]?\d+)?D0?([123])\*|(?:G54)?D(\d\d+)\*", re.sub(r"%[^%]*%|G04[^*]*\*", "", s)):
        if m[4]:
            tool = m[4]
            continue
        start = (x, y)
        x, y = int(m[1]) / scale if m[1] else x, int(m[2]) / scale if m[2] else y
        n += 1
        yield n, {"1": "draw", "2": "move", "3": "flash"}[m[3]], apertures.get(tool), *start, x, y


def hpgl(data: bytes) -> Iterator[tuple]:
    x = y = 0.0
    down, relative, pen, n = False, False, 1, 0
    for m in re.finditer(r"([A-Z]{2})([^A-Z;]*);?", data.decode("latin-1")):
        v = [float(t) for t in re.findall(r"[-+]?\d*\.?\d+", m[2])]
        down = {"PU": False, "PD": True}.get(m[1], down)
        relative = {"PA": False, "PR": True}.get(m[1], relative)
        pen = int(v[0]) if m[1] == "SP" and v else pen
        if m[1] in ("PU", "PD", "PA", "PR"):
            for a, b in zip(v[::2], v[1::2], strict=False):
                to = (x + a, y + b) if relative else (a, b)
                n += 1
                yield n, "draw" if down else "move", pen, x, y, *to
                x, y = to


def dxf(data: bytes) -> Iterator[tuple]:
    """Entities of the model: kind, layer, points in order, radius, text."""
    lines = [x.strip() for x in text(data).splitlines()]
    pairs = list(zip((int(x) for x in lines[::2]), lines[1::2], strict=False))
    at = next((i for i, p in enumerate(pairs) if p == (2, "ENTITIES")), None)
    if at is None:
        raise ValueError("no entities")
    entity: list[tuple[int, str]] = []

    def row(e):
        get = lambda *codes: [v for c, v in e if c in codes]
        points = [f"{x} {y}" for x, y in zip(get(10, 11, 12, 13), get(20, 21, 22, 23), strict=False)]
        return e[0][1], next(iter(get(8)), None), ", ".join(points) or None, next(iter(get(40)), None), next(iter(get(1)), None)

    for c, v in pairs[at + 1 :]:
        if c == 0:
            if entity:
                yield row(entity)
            if v == "ENDSEC":
                return
            entity = []
        entity.append((c, v))
    raise ValueError("the entities don't end")


def sexpr(data: bytes) -> Iterator[tuple]:
    """Board and schematic files of nested lists: items with layer or library, place and net."""
    tokens = re.findall(r'"(?:[^"\\]|\\.)*"|[()]|[^\s()"]+', text(data))
    stack: list[list] = [[]]
    for t in tokens:
        if t == "(":
            stack.append([])
        elif t == ")":
            done = stack.pop()
            stack[-1].append(done)
        else:
            stack[-1].append(t.strip('"'))
    if len(stack) != 1 or not stack[0] or not str(stack[0][0][0]).startswith("kicad_"):
        raise ValueError("not a list of KiCad")
    for item in stack[0][0][1:]:
        if isinstance(item, list) and item and item[0] in ("segment", "via", "footprint", "module", "gr_line", "gr_arc", "gr_circle", "gr_text", "zone", "wire", "bus", "junction", "label", "global_label", "hierarchical_label", "symbol", "sheet", "no_connect", "text", "net"):
            get = lambda *k, item=item: next((" ".join(str(v) for v in x[1:] if not isinstance(v, list)) for x in item if isinstance(x, list) and x and x[0] in k), None)
            words = [x for x in item[1:] if not isinstance(x, list)]
            ends = [" ".join(map(str, y[1:])) for x in item if isinstance(x, list) and x and x[0] in ("pts", "start", "end") for y in (x[1:] if x[0] == "pts" else [x])]
            yield item[0], " ".join(words) or get("lib_id"), get("layer", "layers"), get("at") or ", ".join(ends) or None, get("net")


def eagle(data: bytes) -> Iterator[tuple]:
    root = rooted(data, "eagle")
    for p in every(root, "part"):
        yield "part", attr(p, "name"), None, None, attr(p, "value")
    for i in every(root, "instance"):
        yield "instance", attr(i, "part"), None, f"{attr(i, 'x')} {attr(i, 'y')}", attr(i, "gate")
    for n in every(root, "net"):
        for w in every(n, "wire"):
            yield "wire", attr(n, "name"), attr(w, "layer"), ", ".join(f"{attr(w, 'x' + k)} {attr(w, 'y' + k)}" for k in "12"), attr(n, "name")


def eeschema(data: bytes) -> Iterator[tuple]:
    lines = text(data).splitlines()
    if not lines or not lines[0].startswith("EESchema"):
        raise ValueError("no EESchema header")
    for i, x in enumerate(lines):
        if x.startswith("Wire ") or x.startswith("Connection "):
            f = (lines[i + 1] if x.startswith("Wire ") else x).split()
            yield x.split()[0].lower(), None, None, " ".join(f[-4:] if x.startswith("Wire ") else f[-2:]), None
        elif x == "$Comp":
            block = lines[i + 1 : lines.index("$EndComp", i)]
            f = {b.split()[0]: b.split()[1:] for b in block if b.strip()}
            yield "component", f["L"][1], f["L"][0], " ".join(f.get("P", [])), next((b.split('"')[1] for b in block if b.startswith("F 1")), None)
        elif x.startswith("Text "):
            f = x.split()
            yield "text", lines[i + 1].strip(), f[1], " ".join(f[2:4]), None


def ltspice(data: bytes) -> Iterator[tuple]:
    symbol = None
    for x in [*text(data).splitlines(), ""]:
        f = x.split()
        if symbol and f[:1] != ["SYMATTR"] and f[:1] != ["WINDOW"]:
            yield tuple(symbol)
            symbol = None
        if f[:1] == ["WIRE"]:
            yield "wire", None, None, " ".join(f[1:5]), None
        elif f[:1] == ["FLAG"]:
            yield "flag", f[3], None, " ".join(f[1:3]), None
        elif f[:1] == ["SYMBOL"]:
            symbol = ["symbol", None, f[1], " ".join(f[2:4]), None]
        elif f[:1] == ["SYMATTR"] and symbol:
            if f[1] == "InstName":
                symbol[1] = " ".join(f[2:])
            elif f[1] == "Value":
                symbol[4] = " ".join(f[2:])
        elif f[:1] == ["TEXT"]:
            yield "text", x.split(maxsplit=5)[5], None, " ".join(f[1:3]), None


def foam_field(data: bytes) -> Iterator[tuple]:
    """Object, class, mode, number, least and largest magnitude, patches of a field."""
    s = re.sub(r"//[^\n]*|/\*.*?\*/", "", text(data), flags=re.S)
    get = lambda k: (m := re.search(rf"\b{k}\s+([^;]+);", s)) and m[1].strip()
    if "FoamFile" not in s or "internalField" not in s:
        raise ValueError("no field")
    m = re.search(r"internalField\s+(uniform|nonuniform)\s*(?:List<\w+>)?\s*(.*?);", s, re.S)
    groups = re.findall(r"\(([^()]*)\)", m[2])
    vectors = [[float(x) for x in g.split()] for g in groups] if get("class") != "volScalarField" else [[float(x)] for x in (groups[0].split() if groups else m[2].split())]
    sizes = [sum(v * v for v in x) ** 0.5 if len(x) > 1 else x[0] for x in vectors]
    patches = re.search(r"boundaryField\s*\{(.*)\}", s, re.S)
    yield get("object"), get("class"), m[1], len(sizes), min(sizes), max(sizes), joined(re.findall(r"(\w+)\s*\{", patches[1])) if patches else None


def eps(data: bytes) -> Iterator[tuple]:
    """Header comments, and how often each drawing operator is used."""
    s = data.decode("latin-1")
    if not s.startswith("%!PS"):
        raise ValueError("no PostScript header")
    for k, v in re.findall(r"(?m)^%%(BoundingBox|HiResBoundingBox|Title|Creator|Pages|LanguageLevel):\s*(.*)$", s):
        yield "Comment", k, v.strip()
    ops = Counter(re.findall(r"(?<![/\w])(moveto|lineto|curveto|closepath|stroke|fill|arc|show|rlineto|rmoveto|setrgbcolor|setgray|setlinewidth|gsave|grestore)\b", re.sub(r"(?m)%[^\n]*", "", s)))
    for k, n in sorted(ops.items()):
        yield "Operator", k, n


MESH = ("kind", "no", "x", "y", "z", "refs")
ATOM = ("model", "serial", "atom", "residue", "chain", "number", "x", "y", "z", "element")
MOLECULE = ("molecule", "name", "kind", "no", "element_order", "x", "y", "z", "atoms")
PLAN = ("kind", "name", "layer", "place", "net")
STEP = ("number", "kind", "arguments", "refs")
FORMATS = {
    "obj": Format(MESH, obj, (".obj",)),
    "off": Format(MESH, off, (".off", ".coff", ".noff"), lambda h: bool(re.match(rb"(ST)?(C|N|CN)?4?n?OFF\b", h))),
    "stl": Format(MESH, stl, (".stl",), lambda h: h.startswith(b"solid ")),
    "ply": Format(MESH, ply, (".ply",), lambda h: h.startswith(b"ply\n")),
    "pcd": Format(MESH, pcd, (".pcd",), lambda h: b"\nFIELDS " in h),
    "xyz": Format(MESH, points, (".xyz",)),
    "pts": Format(MESH, points, (".pts",)),
    "ptx": Format(MESH, ptx, (".ptx",)),
    "threemf": Format(MESH, threemf, (".3mf",)),
    "amf": Format(MESH, amf, (".amf",), root_is("amf")),
    "x3d": Format(MESH, x3d, (".x3d",), root_is("X3D")),
    "vrml": Format(MESH, vrml, (".wrl", ".vrml"), lambda h: h.startswith(b"#VRML V2.0")),
    "collada": Format(MESH, collada, (".dae",), root_is("COLLADA")),
    "gltf": Format(MESH, gltf, (".gltf", ".glb"), lambda h: h.startswith(b"glTF")),
    "su2": Format(MESH, su2, (".su2",), lambda h: b"NDIME=" in h),
    "medit": Format(MESH, medit, (".mesh",), lambda h: h.lstrip().startswith(b"MeshVersionFormatted")),
    "abaqus": Format(MESH, abaqus, (".inp",), lambda h: bool(re.search(rb"(?im)^\*(heading|node)\b", h))),
    "nastran": Format(MESH, nastran, (".bdf", ".nas"), lambda h: b"BEGIN BULK" in h),
    "lsdyna": Format(MESH, lsdyna, (".k", ".dyn"), lambda h: h.lstrip().startswith(b"*KEYWORD")),
    "simulation": Format(MESH, gmsh, (".msh", ".vtk"), lambda h: h.startswith((b"$MeshFormat", b"# vtk DataFile"))),
    "unv": Format(MESH, unv, (".unv", ".uff")),
    "tecplot": Format(MESH, tecplot, (".tec",), lambda h: bool(re.match(rb"\s*TITLE\s*=", h))),
    "plot3d": Format(MESH, plot3d, (".p3d", ".x")),
    "step": Format(STEP, ifc, (".step", ".stp", ".p21")),
    "ifc": Format(STEP, ifc, (".ifc",), lambda h: h.lstrip().startswith(b"ISO-10303-21")),
    "iges": Format(("entry", "kind", "level", "parameters"), iges, (".igs", ".iges")),
    "pdb": Format(ATOM, pdb, (".pdb", ".ent"), lambda h: h.startswith((b"HEADER ", b"ATOM  "))),
    "cif": Format(ATOM, cif, (".cif", ".mmcif"), lambda h: h.startswith(b"data_")),
    "mol": Format(MOLECULE, mol, (".mol",)),
    "sdf": Format(MOLECULE, mol, (".sdf", ".sd")),
    "rxn": Format(MOLECULE, rxn, (".rxn",), lambda h: h.startswith(b"$RXN")),
    "mol2": Format(MOLECULE, mol2, (".mol2",), lambda h: b"@<TRIPOS>MOLECULE" in h),
    "gcode": Format(("line", "kind", "x1", "y1", "z1", "x2", "y2", "z2"), gcode, (".gcode", ".nc", ".ngc")),
    "excellon": Format(("hit", "tool", "diameter", "x", "y", "units"), excellon, (".drl", ".xln", ".exc"), lambda h: h.startswith(b"M48")),
    "gerber": Format(("no", "kind", "aperture", "x1", "y1", "x2", "y2"), gerber, (".gbr", ".ger", ".gtl", ".gbl")),
    "hpgl": Format(("no", "kind", "pen", "x1", "y1", "x2", "y2"), hpgl, (".hpgl", ".plt")),
    "dxf": Format(("kind", "layer", "points", "radius", "text"), dxf, (".dxf",)),
    "kicad_pcb": Format(PLAN, sexpr, (".kicad_pcb",), lambda h: h.startswith(b"(kicad_pcb")),
    "kicad_sch": Format(PLAN, sexpr, (".kicad_sch",), lambda h: h.startswith(b"(kicad_sch")),
    "kicad_sch_legacy": Format(PLAN, eeschema, (), lambda h: h.startswith(b"EESchema")),
    "eagle_sch": Format(PLAN, eagle, (), root_is("eagle")),
    "ltspice_asc": Format(PLAN, ltspice, (), lambda h: h.startswith(b"Version 4\n") or b"\nSHEET 1 " in h[:200]),
    "openfoam-field": Format(("obj", "cls", "mode", "n", "min", "max", "pch"), foam_field, (), lambda h: b"FoamFile" in h and b"Field;" in h),
    "eps": Format(("kind", "name", "value"), eps, (".eps", ".ps"), lambda h: h.startswith(b"%!PS")),
}
