"""Pictures and containers of which the header is read: sizes, versions, parts."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

from ..files import Format


def raster(data: bytes) -> Iterator[tuple]:
    """Kind, width, height and channels of PNG, JPEG, GIF, BMP, WebP and Netpbm pictures."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        w, h, bits, kind = struct.unpack_from(">IIBB", data, 16)
        yield "png", w, h, {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind], bits
    elif data[:2] == b"\xff\xd8":
        at = 2
        while data[at + 1] not in (*range(0xC0, 0xC4), *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            at += 2 + struct.unpack_from(">H", data, at + 2)[0]
        bits, h, w, n = struct.unpack_from(">BHHB", data, at + 4)
        yield "jpeg", w, h, n, bits
    elif data[:6] in (b"GIF87a", b"GIF89a"):
        yield "gif", *struct.unpack_from("<HH", data, 6), 1, (data[10] & 7) + 1
    elif data[:2] == b"BM":
        w, h, _, bits = struct.unpack_from("<iiHH", data, 18)
        yield "bmp", w, abs(h), max(1, bits // 8), min(8, bits)
    elif data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        if data[12:16] == b"VP8X":
            yield "webp", 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little"), 4 if data[20] & 0x10 else 3, 8
        elif data[12:16] == b"VP8L":
            v = int.from_bytes(data[21:25], "little")
            yield "webp", 1 + (v & 0x3FFF), 1 + (v >> 14 & 0x3FFF), 4, 8
        else:
            yield "webp", *(x & 0x3FFF for x in struct.unpack_from("<HH", data, 26)), 3, 8
    elif m := re.match(rb"P([1-6])\s+(?:#[^\n]*\s+)*(\d+)\s+(?:#[^\n]*\s+)*(\d+)", data):
        yield "netpbm", int(m[2]), int(m[3]), 3 if m[1] in b"36" else 1, 1 if m[1] in b"14" else 8
    else:
        raise ValueError("no picture")


def tiff(data: bytes) -> Iterator[tuple]:
    """Pages with size, bits, samples and compression."""
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    if struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("no TIFF header")
    (at,), page = struct.unpack_from(order + "I", data, 4), 0
    seen = set()
    while at and at not in seen:
        seen.add(at)
        (n,), tags = struct.unpack_from(order + "H", data, at), {}
        for i in range(n):
            tag, kind, _ = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            if kind in (3, 4):
                tags[tag] = struct.unpack_from(order + ("H" if kind == 3 else "I"), data, at + 10 + 12 * i)[0]
        page += 1
        yield page, tags[256], tags[257], tags.get(258, 1), tags.get(277, 1), tags.get(259, 1)
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def jpeg2000(data: bytes) -> Iterator[tuple]:
    at = data.find(b"\xff\x4f\xff\x51")
    if at < 0:
        raise ValueError("no code stream")
    w, h, x, y = struct.unpack_from(">4I", data, at + 8)
    (n,) = struct.unpack_from(">H", data, at + 40)
    yield w - x, h - y, n, (data[at + 42] & 0x7F) + 1


def pdf(data: bytes) -> Iterator[tuple]:
    """Version, pages, and the text that uncompressed or deflated page contents show."""
    import zlib

    if not data.startswith(b"%PDF-"):
        raise ValueError("no PDF header")
    yield "version", data[5:8].decode("latin-1")
    yield "pages", len(re.findall(rb"/Type\s*/Page(?![a-zA-Z])", data))
    for m in re.finditer(rb"<<((?:[^<>]|<<[^<>]*>>|<[^<>]*>)*)>>\s*stream\r?\n", data):
        end = data.find(b"endstream", m.end())
        body = data[m.end() : end]
        if b"/FlateDecode" in m[1]:
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                continue
        elif b"/Filter" in m[1]:
            continue
        if not re.search(rb"\bBT\b", body):
            continue
        said = []
        for t in re.finditer(rb"\(((?:[^()\\]|\\.)*)\)\s*(?:Tj|'|\")|\[((?:[^\[\]()\\]|\((?:[^()\\]|\\.)*\))*)\]\s*TJ|(?<!\w)(T\*|Td|TD|ET)(?!\w)", body):
            if t[3]:
                said.append("\n")
            else:
                parts = [t[1]] if t[1] is not None else re.findall(rb"\(((?:[^()\\]|\\.)*)\)", t[2])
                plain = b"".join(re.sub(rb"\\([nrtbf()\\]|[0-7]{1,3})", lambda e: {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b""}.get(e[1]) if e[1] in (b"n", b"r", b"t", b"b", b"f") else bytes([int(e[1], 8) & 255]) if e[1].isdigit() else e[1], p) for p in parts)
                said.append(plain.decode("cp1252", "replace"))
        for line in "".join(said).split("\n"):
            if line.strip():
                yield "text", line.strip()


def fdf(data: bytes) -> Iterator[tuple]:
    if not data.startswith(b"%FDF-"):
        raise ValueError("no FDF header")
    plain = lambda b: re.sub(rb"\\([()\\])", rb"\1", b).decode("latin-1")
    for m in re.finditer(rb"<<((?:[^<>]|<[^<>]*>)*?/T\s*\(((?:[^()\\]|\\.)*)\)(?:[^<>]|<[^<>]*>)*)>>", data):
        v = re.search(rb"/V\s*(?:\(((?:[^()\\]|\\.)*)\)|/(\w+))", m[1])
        name = plain(m[2])
        hidden = any(h in name.lower() for h in ("password", "passcode", "secret", "token", "ssn", "socialsecurity", "bankaccount"))
        yield name, "name" if v and v[2] else "text" if v else None, "***" if v and hidden else plain(v[1]) if v and v[1] is not None else v and v[2].decode(), None


def _signed(mark: bytes, rows):
    def read(data: bytes) -> Iterator[tuple]:
        if mark not in data[:64]:
            raise ValueError("no such header")
        yield "bytes", len(data)
        yield from rows(data)

    return read


def _hdf5(data):
    yield "superblock version", data[8]
    yield "groups", data.count(b"SNOD") + data.count(b"OHDR")
    yield "heaps", data.count(b"HEAP")


def _access(data):
    yield "engine", data[4:19].split(b"\0")[0].decode("latin-1")
    yield "version", {0: "Jet 3", 1: "Jet 4", 2: "ACE 12", 3: "ACE 14", 5: "ACE 16"}.get(data[20], data[20])


def _dwg(data):
    releases = {b"AC1012": "R13", b"AC1014": "R14", b"AC1015": "2000", b"AC1018": "2004", b"AC1021": "2007", b"AC1024": "2010", b"AC1027": "2013", b"AC1032": "2018"}
    yield "release", releases.get(data[:6], data[:6].decode("latin-1"))


def _jt(data):
    yield "version", data[:80].decode("latin-1").strip()
    yield "byte order", "big" if data[80] else "little"


def _3dm(data):
    yield "version", data[24:32].decode("latin-1").strip()


def dicom(data: bytes) -> Iterator[tuple]:
    """Elements of the file's explicit little-endian data set; pixel data is named only."""
    if data[128:132] != b"DICM":
        raise ValueError("no DICM mark")
    at = 132
    while at + 8 <= len(data):
        group, element = struct.unpack_from("<HH", data, at)
        kind = data[at + 4 : at + 6].decode("latin-1")
        if not kind.isupper():
            raise ValueError("implicit value representation")
        if kind in ("OB", "OD", "OF", "OL", "OW", "SQ", "UC", "UN", "UR", "UT"):
            size, at = struct.unpack_from("<I", data, at + 8)[0], at + 12
        else:
            size, at = struct.unpack_from("<H", data, at + 6)[0], at + 8
        if (group, element) == (0x7FE0, 0x0010) or size == 0xFFFFFFFF:
            yield f"{group:04x},{element:04x}", kind, "pixel data" if group == 0x7FE0 else "sequence"
            return
        raw = data[at : at + size]
        at += size
        codes = {"US": "H", "SS": "h", "UL": "I", "SL": "i", "FL": "f", "FD": "d"}
        if kind in codes:
            n = len(raw) // struct.calcsize(codes[kind])
            value = " ".join(f"{x:g}" for x in struct.unpack_from(f"<{n}{codes[kind]}", raw))
        else:
            value = f"{size} bytes" if kind in ("OB", "OW", "SQ", "UN") else "***" if group == 0x0010 else raw.decode("latin-1").strip(" \0")
        yield f"{group:04x},{element:04x}", kind, value


METRIC = ("metric", "value")
FORMATS = {
    "raster": Format(("kind", "width", "height", "channels", "bits"), raster, (".png", ".jpg", ".jpeg", ".gif", ".bmp", ".webp", ".pbm", ".pgm", ".ppm"), lambda h: h.startswith((b"\x89PNG", b"\xff\xd8\xff", b"GIF8")) or h[8:12] == b"WEBP"),
    "tiff": Format(("page", "width", "height", "bits", "samples", "compression"), tiff, (".tif", ".tiff"), lambda h: h[:4] in (b"II*\0", b"MM\0*")),
    "jpeg2000": Format(("width", "height", "components", "bits"), jpeg2000, (".jp2", ".j2k", ".jpx", ".jpf"), lambda h: h[4:8] == b"jP  " or h.startswith(b"\xff\x4f\xff\x51")),
    "pdf": Format(METRIC, pdf, (".pdf",), lambda h: h.startswith(b"%PDF-")),
    "fdf": Format(("field", "type", "value", "detail"), fdf, (".fdf",), lambda h: h.startswith(b"%FDF-")),
    "dicom": Format(("tag", "type", "value"), dicom, (".dcm", ".dicom"), lambda h: h[128:132] == b"DICM"),
    "hdf5": Format(METRIC, _signed(b"\x89HDF\r\n\x1a\n", _hdf5), (".h5", ".hdf5"), lambda h: h.startswith(b"\x89HDF\r\n\x1a\n")),
    "cgns": Format(METRIC, _signed(b"\x89HDF\r\n\x1a\n", _hdf5), (".cgns",)),
    "access": Format(METRIC, _signed(b"Standard ", _access), (".accdb", ".mdb"), lambda h: h[4:13] == b"Standard "),
    "dwg": Format(METRIC, _signed(b"AC10", _dwg), (".dwg",), lambda h: h[:4] == b"AC10"),
    "jt": Format(METRIC, _signed(b"Version ", _jt), (".jt",)),
    "3dm": Format(METRIC, _signed(b"3D Geometry File Format", _3dm), (".3dm",), lambda h: h.startswith(b"3D Geometry File Format")),
}
