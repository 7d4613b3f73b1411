"""Binary science and library formats: headers and values."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from ..files import Format
from .jsons import uri


def marc21(data: bytes) -> Iterator[tuple]:
    at, n = 0, 0
    while at + 24 <= len(data):
        size, base = int(data[at : at + 5]), int(data[at + 12 : at + 17])
        record, n = data[at : at + size], n + 1
        if size < 25 or record[-1:] != b"\x1d":
            raise ValueError(f"record {n} doesn't end")
        yield n, "LDR", None, record[:24].decode("latin-1")
        directory = record[24 : base - 1]
        for i in range(0, len(directory), 12):
            tag, length, start = directory[i : i + 3].decode(), int(directory[i + 3 : i + 7]), int(directory[i + 7 : i + 12])
            field = record[base + start : base + start + length].rstrip(b"\x1e")
            if tag < "010":
                yield n, tag, None, field.decode("utf-8", "replace")
            else:
                for part in field.split(b"\x1f")[1:]:
                    yield n, tag, part[:1].decode(), uri(part[1:].decode("utf-8", "replace"))
        at += size
        while data[at : at + 1] in (b"\n", b"\r"):
            at += 1


def fits(data: bytes) -> Iterator[tuple]:
    """Cards of the header units; data is stepped over."""
    if not data.startswith(b"SIMPLE  ="):
        raise ValueError("no FITS header")
    at, unit = 0, 0
    while at < len(data):
        size, found = 0, {}
        end = False
        while not end:
            block = data[at : at + 2880].decode("ascii")
            if len(block) < 2880:
                raise ValueError("header is cut off")
            at += 2880
            for i in range(0, 2880, 80):
                card = block[i : i + 80]
                if card.startswith("END") and not card[3:].strip():
                    end = True
                    break
                if card[8:10] == "= ":
                    raw = card[10:]
                    value = raw[raw.index("'") + 1 : raw.rindex("'")].rstrip() if "'" in raw.split("/")[0] else raw.split("/")[0].strip()
                    found[card[:8].strip()] = value
                    yield unit, card[:8].strip(), value
        axes = int(found.get("NAXIS", 0))
        if axes:
            size = abs(int(found["BITPIX"])) // 8 * (int(found.get("PCOUNT", 0)) + 1)
            size = abs(int(found["BITPIX"])) // 8
            for k in range(1, axes + 1):
                size *= int(found[f"NAXIS{k}"])
        at += -(-size // 2880) * 2880
        unit += 1


def nifti(data: bytes) -> Iterator[tuple]:
    order = "<" if struct.unpack_from("<i", data)[0] == 348 else ">"
    if struct.unpack_from(order + "i", data)[0] != 348 or data[344:347] not in (b"n+1", b"ni1"):
        raise ValueError("no NIfTI-1 header")
    dim = struct.unpack_from(order + "8h", data, 40)
    yield "dimensions", " ".join(map(str, dim[1 : 1 + dim[0]]))
    kind, bits = struct.unpack_from(order + "2h", data, 70)
    yield "datatype", kind
    yield "bits", bits
    yield "voxel size", " ".join(f"{x:g}" for x in struct.unpack_from(order + "8f", data, 76)[1 : 1 + dim[0]])
    yield "slope", struct.unpack_from(order + "f", data, 112)[0]
    yield "description", data[148:228].split(b"\0")[0].decode("latin-1")


def mrc(data: bytes) -> Iterator[tuple]:
    if data[208:211] != b"MAP":
        raise ValueError("no MAP mark")
    order = ">" if data[212] == 0x11 else "<"
    v = struct.unpack_from(order + "10i", data)
    yield "dimensions", " ".join(map(str, v[:3]))
    yield "mode", v[3]
    yield "cell", " ".join(f"{x:g}" for x in struct.unpack_from(order + "3f", data, 40))
    for k, x in zip(("minimum", "maximum", "mean"), struct.unpack_from(order + "3f", data, 76), strict=True):
        yield k, x


def netcdf(data: bytes) -> Iterator[tuple]:
    """Dimensions, attributes and variables of the classic formats."""
    if data[:3] != b"CDF" or data[3] not in (1, 2):
        raise ValueError("not a classic file")
    at, wide = 4, data[3] == 2
    sizes = {1: ("b", 1), 2: ("c", 1), 3: ("h", 2), 4: ("i", 4), 5: ("f", 4), 6: ("d", 8)}
    names = {1: "byte", 2: "char", 3: "short", 4: "int", 5: "float", 6: "double"}

    def integer() -> int:
        nonlocal at
        at += 4
        return struct.unpack_from(">i", data, at - 4)[0]

    def label() -> str:
        nonlocal at
        n = integer()
        s = data[at : at + n].decode()
        at += -(-n // 4) * 4
        return s

    def attributes(owner):
        nonlocal at
        tag, n = integer(), integer()
        for _ in range(n if tag == 12 else 0):
            key, kind, count = label(), integer(), integer()
            code, size = sizes[kind]
            raw = data[at : at + count * size]
            at += -(-count * size // 4) * 4
            value = raw.decode("utf-8", "replace").rstrip("\0") if kind == 2 else " ".join(f"{x:g}" for x in struct.unpack(f">{count}{code}", raw))
            yield "attribute", f"{owner}:{key}" if owner else key, names[kind], value

    records = integer()
    tag, n = integer(), integer()
    dims = []
    for _ in range(n if tag == 10 else 0):
        dims.append((label(), integer()))
        yield "dimension", dims[-1][0], "unlimited" if not dims[-1][1] else "fixed", dims[-1][1] or records
    yield from attributes("")
    tag, n = integer(), integer()
    for _ in range(n if tag == 11 else 0):
        key, k = label(), integer()
        shape = [dims[integer()][0] for _ in range(k)]
        inner = list(attributes(key))
        kind, _ = integer(), integer()
        at += 8 if wide else 4
        yield "variable", key, names[kind], " ".join(shape)
        yield from inner


def las(data: bytes) -> Iterator[tuple]:
    if data[:4] != b"LASF":
        raise ValueError("no LAS header")
    yield "version", f"{data[24]}.{data[25]}"
    offset, _, form, width, count = struct.unpack_from("<IIBHI", data, 96)
    if data[25] >= 4 and len(data) >= 255:
        count = struct.unpack_from("<Q", data, 247)[0] or count
    yield "point format", form & 0x3F
    yield "points", count
    scale, shift = struct.unpack_from("<3d", data, 131), struct.unpack_from("<3d", data, 155)
    box = struct.unpack_from("<6d", data, 179)
    for k, hi, lo in zip("xyz", box[::2], box[1::2], strict=True):
        yield f"{k} range", f"{lo:g} {hi:g}"
    if not form & 0xC0:  # not compressed: even samples of at most 200,000 points
        quota = min(count, 200_000)
        for i in range(quota):
            at = offset + (i * count // quota) * width
            yield "point", " ".join(f"{v * s + t:.6f}" for v, s, t in zip(struct.unpack_from("<3i", data, at), scale, shift, strict=True))


FORMATS = {
    "marc21": Format(("record", "tag", "code", "value"), marc21, (".mrc21", ".marc", ".marc21")),
    "fits": Format(("unit", "key", "value"), fits, (".fits", ".fit", ".fts"), lambda h: h.startswith(b"SIMPLE  =")),
    "nifti": Format(("metric", "value"), nifti, (".nii",), lambda h: h[344:347] in (b"n+1", b"ni1")),
    "mrc": Format(("metric", "value"), mrc, (".mrc", ".map", ".ccp4"), lambda h: h[208:211] == b"MAP"),
    "netcdf": Format(("role", "name", "type", "value"), netcdf, (".nc3", ".cdf"), lambda h: h[:4] in (b"CDF\x01", b"CDF\x02")),
    "exodus": Format(("role", "name", "type", "value"), netcdf, (".exo", ".e", ".ex2")),
    "las": Format(("metric", "value"), las, (".las", ".laz"), lambda h: h.startswith(b"LASF")),
}
