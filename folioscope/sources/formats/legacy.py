"""Older binary documents: compound files and what lies in them, books, metafiles, structured reports."""

from __future__ import annotations

import re
import struct
import zipfile
from collections import Counter
from collections.abc import Iterator
from io import BytesIO

from ..files import Format, text
from .packages import Package
from .shapes import _numbered, ifc
from .texts import html_blocks
from .xmls import letters
from .xmltree import attr, every, name, own, parse, said

_END = 0xFFFFFFFE


class Compound:
    """The streams of a compound file by path; storages are folders."""

    def __init__(self, data: bytes):
        if data[:8] != b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
            raise ValueError("not a compound file")
        self.data = data
        shift, mini = struct.unpack_from("<HH", data, 30)
        self.size, self.mini_size = 1 << shift, 1 << mini
        first_dir, _, cutoff, first_mini, _, next_table, _ = struct.unpack_from("<7I", data, 48)
        table = [x for x in struct.unpack_from("<109I", data, 76) if x < _END]
        seen = set()
        while next_table < _END and next_table not in seen:
            seen.add(next_table)
            block = struct.unpack(f"<{self.size // 4}I", self.sector(next_table))
            table += [x for x in block[:-1] if x < _END]
            next_table = block[-1]
        self.fat = [x for s in table for x in struct.unpack(f"<{self.size // 4}I", self.sector(s))]
        directory = self.chain(first_dir)
        entries = []
        for i in range(0, len(directory), 128):
            e = directory[i : i + 128]
            n, kind = struct.unpack_from("<HB", e, 64)
            left, right, child = struct.unpack_from("<3I", e, 68)
            start, size = struct.unpack_from("<IQ", e, 116)
            entries.append((e[: max(0, n - 2)].decode("utf-16-le"), kind, left, right, child, start, size & 0xFFFFFFFF))
        self.cutoff, self.root = cutoff, self.chain(entries[0][5])
        raw = self.chain(first_mini) if first_mini < _END else b""
        self.mini = struct.unpack(f"<{len(raw) // 4}I", raw)
        self.streams: dict[str, tuple[int, int]] = {}
        todo, met = [(entries[0][4], "")], set()
        while todo:
            k, base = todo.pop()
            if k >= len(entries) or k in met:
                continue
            met.add(k)
            label, kind, left, right, child, start, size = entries[k]
            todo += [(left, base), (right, base)]
            if kind == 2:
                self.streams[base + label] = (start, size)
            elif kind == 1:
                todo.append((child, f"{base}{label}/"))

    def sector(self, n: int) -> bytes:
        return self.data[(n + 1) * self.size : (n + 2) * self.size]

    def chain(self, n: int) -> bytes:
        out, seen = [], set()
        while n < _END:
            if n in seen or n >= len(self.fat):
                raise ValueError("sector chain")
            seen.add(n)
            out.append(self.sector(n))
            n = self.fat[n]
        return b"".join(out)

    def read(self, path: str) -> bytes:
        start, size = self.streams[path]
        if size >= self.cutoff:
            return self.chain(start)[:size]
        out, seen = [], set()
        while start < _END and start not in seen:
            seen.add(start)
            out.append(self.root[start * self.mini_size : (start + 1) * self.mini_size])
            start = self.mini[start]
        return b"".join(out)[:size]


def doc(data: bytes) -> Iterator[tuple]:
    """Paragraphs by the table of text pieces; field codes are left out."""
    c = Compound(data)
    main = c.read("WordDocument")
    (flags,) = struct.unpack_from("<H", main, 10)
    at, size = struct.unpack_from("<II", main, 0x01A2)
    clx = c.read("1Table" if flags & 0x0200 else "0Table")[at : at + size]
    at = 0
    while clx[at] == 1:
        at += 3 + struct.unpack_from("<H", clx, at + 1)[0]
    (size,) = struct.unpack_from("<I", clx, at + 1)
    plc = clx[at + 5 : at + 5 + size]
    n = (size - 4) // 12
    places = struct.unpack_from(f"<{n + 1}I", plc)
    out = []
    for i in range(n):
        (fc,) = struct.unpack_from("<I", plc, 4 * (n + 1) + 8 * i + 2)
        count = places[i + 1] - places[i]
        out.append(main[(fc & 0x3FFFFFFF) // 2 :][:count].decode("cp1252", "replace") if fc & 0x40000000 else main[fc : fc + 2 * count].decode("utf-16-le", "replace"))
    whole = re.sub(r"\x13[^\x13\x14\x15]*(?:\x14|(?=\x15))|\x15", "", "".join(out))
    for p in re.split(r"[\r\x07\x0c]", whole):
        if p := re.sub(r"[\x00-\x08\x0b\x0e-\x1f]", " ", p).strip():
            yield "paragraph", 0, p


def ppt(data: bytes) -> Iterator[tuple]:
    """Texts of the presentation's records in order, under the slide they follow."""
    body, slide = Compound(data).read("PowerPoint Document"), 0

    def go(at: int, end: int):
        nonlocal slide
        while at + 8 <= end:
            head, kind, size = struct.unpack_from("<HHI", body, at)
            if kind in (1006, 1011):  # a slide, or its place in the list of texts
                slide += 1
            if head & 0xF == 0xF:
                yield from go(at + 8, min(end, at + 8 + size))
            elif kind in (4000, 4008):
                raw = body[at + 8 : at + 8 + size]
                for line in raw.decode("utf-16-le" if kind == 4000 else "latin-1", "replace").replace("\x0b", " ").split("\r"):
                    if line.strip():
                        yield slide, "paragraph", line.strip()
            at += 8 + size

    yield from go(0, len(body))


def vsd(data: bytes) -> Iterator[tuple]:
    c = Compound(data)
    for path in sorted(c.streams):
        yield "stream", path.replace("\x05", ""), f"{c.streams[path][1]} bytes"


def msg(data: bytes) -> Iterator[tuple]:
    """Sender, recipients, subject and body of a stored message, names of what is attached."""
    c = Compound(data)

    def prop(tag: str, base: str = "") -> str | None:
        for kind, code in (("001F", "utf-16-le"), ("001E", "cp1252")):
            path = f"{base}__substg1.0_{tag}{kind}"
            if path in c.streams:
                return c.read(path).decode(code, "replace").rstrip("\0")
        return None

    attached = [prop("3707", b) or prop("3704", b) for b in sorted({p.split("/")[0] + "/" for p in c.streams if p.startswith("__attach")})]
    yield prop("0C1A"), prop("0E04"), None, prop("0037"), (prop("1000") or "").strip(), "; ".join(filter(None, attached))


def _rk(v: int) -> float:
    x = float(v >> 2 if v < 0x80000000 else (v >> 2) - (1 << 30)) if v & 2 else struct.unpack("<d", struct.pack("<Q", (v & 0xFFFFFFFC) << 32))[0]
    return x / 100 if v & 1 else x


class _Strings:
    """Reads the texts of a string table whose bytes go on in the records after it."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.k, self.at = parts, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while n:
            if self.at >= len(self.parts[self.k]):
                self.k, self.at = self.k + 1, 0
            piece = self.parts[self.k][self.at : self.at + n]
            out, n, self.at = out + piece, n - len(piece), self.at + len(piece)
        return out

    def next(self) -> str:
        count, flags = struct.unpack("<HB", self.take(3))
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        more = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        out, wide = "", flags & 1
        while count:
            if self.at >= len(self.parts[self.k]):  # goes on in the next record, which says its width anew
                self.k, self.at = self.k + 1, 1
                wide = self.parts[self.k][0] & 1
            n = min(count, (len(self.parts[self.k]) - self.at) // (2 if wide else 1))
            out += self.take(n * (2 if wide else 1)).decode("utf-16-le" if wide else "latin-1")
            count -= n
        self.take(4 * runs + more)
        return out


def xls(data: bytes) -> Iterator[tuple]:
    """Cells of a binary workbook; of formulas the stored values."""
    c = Compound(data)
    body = c.read("Workbook" if "Workbook" in c.streams else "Book")
    records, at = [], 0
    while at + 4 <= len(body):
        kind, size = struct.unpack_from("<HH", body, at)
        records.append((at, kind, body[at + 4 : at + 4 + size]))
        at += 4 + size
    sheets, shared = {}, []
    for i, (_, kind, r) in enumerate(records):
        if kind == 0x85:
            n, wide = r[6], r[7] & 1
            sheets[struct.unpack_from("<I", r)[0]] = r[8 : 8 + n * (2 if wide else 1)].decode("utf-16-le" if wide else "latin-1")
        elif kind == 0xFC:
            parts = [r[8:]]
            for _, more, s in records[i + 1 :]:
                if more != 0x3C:
                    break
                parts.append(s)
            reader = _Strings(parts)
            shared = [reader.next() for _ in range(struct.unpack_from("<I", r, 4)[0])]
    sheet, waiting = None, None
    for at, kind, r in records:
        sheet = sheets.get(at, sheet) if kind == 0x809 else sheet
        if kind in (0xFD, 0x203, 0x27E, 0x06, 0x204, 0x205):
            row, column = struct.unpack_from("<HH", r)
            ref = letters(column + 1) + str(row + 1)
            if kind == 0xFD:
                yield sheet, ref, "text", shared[struct.unpack_from("<I", r, 6)[0]], None, None
            elif kind == 0x203:
                yield sheet, ref, "number", struct.unpack_from("<d", r, 6)[0], None, None
            elif kind == 0x27E:
                yield sheet, ref, "number", _rk(struct.unpack_from("<I", r, 6)[0]), None, None
            elif kind == 0x205:
                yield sheet, ref, "error" if r[7] else "boolean", f"#{r[6]}" if r[7] else "TRUE" if r[6] else "FALSE", None, None
            elif kind == 0x204:
                n, wide = struct.unpack_from("<HB", r, 6)
                yield sheet, ref, "text", r[9 : 9 + n * (2 if wide & 1 else 1)].decode("utf-16-le" if wide & 1 else "latin-1"), None, None
            elif r[12:14] == b"\xff\xff":
                if r[6] == 0:
                    waiting = ref  # its text follows
                elif r[6] == 1:
                    yield sheet, ref, "boolean", "TRUE" if r[8] else "FALSE", None, None
            else:
                yield sheet, ref, "number", struct.unpack_from("<d", r, 6)[0], None, None
        elif kind == 0x207 and waiting:
            n, wide = struct.unpack_from("<HB", r)
            yield sheet, waiting, "text", r[3 : 3 + n * (2 if wide & 1 else 1)].decode("utf-16-le" if wide & 1 else "latin-1"), None, None
            waiting = None
        elif kind == 0xBD:
            row, first = struct.unpack_from("<HH", r)
            for k in range((len(r) - 6) // 6):
                yield sheet, letters(first + k + 1) + str(row + 1), "number", _rk(struct.unpack_from("<I", r, 6 + 6 * k)[0]), None, None


def xlsb(data: bytes) -> Iterator[tuple]:
    """Cells of a package of binary records."""
    pack = Package(data)

    def records(part: str):
        raw, at = pack.read(part), 0

        def number(most: int) -> int:
            nonlocal at
            out = 0
            for k in range(most):
                b = raw[at]
                at += 1
                out |= (b & 0x7F) << 7 * k
                if not b & 0x80:
                    break
            return out

        while at < len(raw):
            kind = raw[at] if not raw[at] & 0x80 else raw[at] & 0x7F | (raw[at + 1] & 0x7F) << 7
            at += 2 if raw[at] & 0x80 else 1
            size = number(4)
            yield kind, raw[at : at + size]
            at += size

    def wide(r: bytes, at: int) -> tuple[str, int]:
        (n,) = struct.unpack_from("<I", r, at)
        return ("", at + 4) if n == 0xFFFFFFFF else (r[at + 4 : at + 4 + 2 * n].decode("utf-16-le"), at + 4 + 2 * n)

    main = pack.main("xl/workbook.bin")
    links = pack.targets(main)
    shared = [wide(r, 1)[0] for kind, t in links.values() if kind == "sharedStrings" for k, r in records(t) if k == 19]
    for kind, r in records(main):
        if kind != 156:
            continue
        rel, at = wide(r, 8)
        sheet, row = wide(r, at)[0], 0
        for k, c in records(links[rel][1]):
            if k == 0:
                (row,) = struct.unpack_from("<I", c)
            elif k in (2, 4, 5, 6, 7, 8, 9, 10):
                ref = letters(struct.unpack_from("<I", c)[0] + 1) + str(row + 1)
                if k == 7:
                    yield sheet, ref, "text", shared[struct.unpack_from("<I", c, 8)[0]], None, None
                elif k in (6, 8):
                    yield sheet, ref, "text", wide(c, 8)[0], None, None
                elif k in (4, 10):
                    yield sheet, ref, "boolean", "TRUE" if c[8] else "FALSE", None, None
                else:
                    yield sheet, ref, "number", _rk(struct.unpack_from("<I", c, 8)[0]) if k == 2 else struct.unpack_from("<d", c, 8)[0], None, None


def mobi(data: bytes) -> Iterator[tuple]:
    """Blocks of a book's text, plain or packed by back references."""
    (n,) = struct.unpack_from(">H", data, 76)
    places = [struct.unpack_from(">I", data, 78 + 8 * i)[0] for i in range(n)] + [len(data)]
    head = data[places[0] : places[1]]
    packing, size, count = struct.unpack_from(">H2xIH", head)
    if packing not in (1, 2) or len(head) > 14 and struct.unpack_from(">H", head, 12)[0]:
        raise ValueError("packed or locked in a way that isn't read")

    def plain(raw: bytes) -> bytes:
        out, i = bytearray(), 0
        while i < len(raw):
            b = raw[i]
            i += 1
            if 1 <= b <= 8:
                out += raw[i : i + b]
                i += b
            elif b < 0x80:
                out.append(b)
            elif b >= 0xC0:
                out += bytes([32, b ^ 0x80])
            else:
                pair = (b << 8 | raw[i]) & 0x3FFF
                i += 1
                for _ in range((pair & 7) + 3):
                    out.append(out[-(pair >> 3)])
        return bytes(out)

    body = b"".join(plain(data[places[i] : places[i + 1]]) if packing == 2 else data[places[i] : places[i + 1]] for i in range(1, count + 1))[:size]
    code = "utf-8" if len(head) > 32 and struct.unpack_from(">I", head, 28)[0] == 65001 else "cp1252"
    yield "title", 0, data[:32].split(b"\0")[0].decode("latin-1")
    yield from html_blocks(body.decode(code, "replace"))


def metafile(data: bytes) -> Iterator[tuple]:
    """Bounds, and how many records of each kind, of both metafile formats."""
    if data[40:44] == b" EMF":
        yield "bounds", " ".join(map(str, struct.unpack_from("<4i", data, 8)))
        at, kinds = 0, Counter()
        while at + 8 <= len(data):
            kind, size = struct.unpack_from("<II", data, at)
            if size < 8:
                raise ValueError("record size")
            kinds[kind] += 1
            at += size
    elif data[:4] == b"\xd7\xcd\xc6\x9a":
        yield "bounds", " ".join(map(str, struct.unpack_from("<4h", data, 6)))
        at, kinds = 22 + 18, Counter()
        while at + 6 <= len(data):
            size, kind = struct.unpack_from("<IH", data, at)
            if size < 3:
                raise ValueError("record size")
            kinds[kind] += 1
            at += 2 * size
    else:
        raise ValueError("no metafile")
    for kind, n in sorted(kinds.items()):
        yield f"record {kind}", n


def e57(data: bytes) -> Iterator[tuple]:
    """Scans with their numbers of points, by the file's XML part; each page ends with a check sum."""
    if data[:8] != b"ASTM-E57":
        raise ValueError("no E57 header")
    major, minor = struct.unpack_from("<II", data, 8)
    at, size, page = struct.unpack_from("<QQQ", data, 24)
    yield "version", f"{major}.{minor}"
    out = bytearray()
    while len(out) < size:
        end = (at // page + 1) * page - 4
        out += data[at:end]
        if end + 4 >= len(data) and len(out) < size:
            raise ValueError("the XML part is cut off")
        at = end + 4
    for scan in every(parse(bytes(out[:size])), "data3D"):
        for s in scan:
            points = next(every(s, "points"), None)
            yield "scan", f"{own(s, 'name') or ''} {attr(points, 'recordCount')}".strip()


def cdb(data: bytes) -> Iterator[tuple]:
    """Node and element blocks, whose columns a line in brackets tells."""
    lines, at, nodes, cells = text(data).splitlines(), 0, {}, []
    while at < len(lines):
        block = lines[at].upper().split(",")[0].strip()
        if block not in ("NBLOCK", "EBLOCK"):
            at += 1
            continue
        widths = [int(w) for n, w in re.findall(r"(\d*)[ie](\d+)", lines[at + 1]) for _ in range(int(n or 1))]
        at += 2
        while at < len(lines) and not re.match(r"\s*-1\b|N,", lines[at]):
            f, place = [], 0
            for w in widths:
                if lines[at][place : place + w].strip():
                    f.append(lines[at][place : place + w])
                place += w
            if block == "NBLOCK":
                nodes[int(f[0])] = [*f[3:6], *["0"] * (3 - len(f[3:6]))]
            else:
                count = int(f[8])
                corners = [int(x) for x in f[11 : 11 + count]]
                while len(corners) < count:
                    at += 1
                    corners += [int(x) for x in lines[at].split()]
                cells.append(list(dict.fromkeys(corners[:count])))
            at += 1
    yield from _numbered(nodes, cells)


def ensight(data: bytes) -> Iterator[tuple]:
    """Parts of a geometry in text: coordinates, then elements by kind."""
    sizes = {"point": 1, "bar2": 2, "tria3": 3, "quad4": 4, "tetra4": 4, "pyramid5": 5, "penta6": 6, "hexa8": 8}
    lines, at, nodes, cells, base = [x.strip() for x in text(data).splitlines()], 2, {}, [], 0
    while at < len(lines):
        k = lines[at]
        if k == "coordinates":
            n = int(lines[at + 1])
            rows = [x for line in lines[at + 2 : at + 2 + 3 * n] for x in line.split()]
            base = len(nodes)
            for i in range(n):
                nodes[base + i + 1] = [rows[i], rows[n + i], rows[2 * n + i]]
            at += 2 + 3 * n
        elif k in sizes:
            n = int(lines[at + 1])
            cells += [[base + int(x) for x in line.split()[-sizes[k] :]] for line in lines[at + 2 : at + 2 + n]]
            at += 2 + n
        else:
            at += 1
    yield from _numbered(nodes, cells)


def op2(data: bytes) -> Iterator[tuple]:
    """Records between their length marks."""
    for order in "<>":
        at, sizes = 0, []
        while at + 8 <= len(data):
            (n,) = struct.unpack_from(order + "i", data, at)
            if n < 0 or at + 8 + n > len(data) or struct.unpack_from(order + "i", data, at + 4 + n)[0] != n:
                break
            sizes.append(n)
            at += 8 + n
        if sizes:
            yield "byte order", "little" if order == "<" else "big"
            yield "records", len(sizes)
            yield "bytes", sum(sizes)
            yield "complete", at == len(data)
            return
    raise ValueError("no record")


def latex(data: bytes) -> Iterator[tuple]:
    """Sections, items, verbatim text, table rows and paragraphs; formulas stay as they are written."""
    s = re.sub(r"(?<!\\)%[^\n]*", "", text(data))
    m = re.search(r"\\begin\{document\}(.*?)\\end\{document\}", s, re.S)
    plain = lambda t: re.sub(r"\\([#$%&_{}])", r"\1", re.sub(r"\\textbackslash\{\}", r"\\", re.sub(r"\\(?:textbf|emph|textit|texttt|underline)\{([^{}]*)\}", r"\1", t))).strip()
    for p in re.finditer(r"\\((?:sub)*)section\*?\{((?:[^{}\\]|\\.|\{[^{}]*\})*)\}|\\begin\{verbatim\}\n?(.*?)\n?\\end\{verbatim\}|\\begin\{tabular\}\{[^}]*\}(.*?)\\end\{tabular\}|\\item\s+(.*?)(?=\\item|\\end\{)|\\(?:begin|end)\{\w+\*?\}(?:\[[^\]]*\])?|((?:(?!\n\s*\n|\\(?:sub)*section|\\begin\{(?:verbatim|tabular|itemize|enumerate)|\\item|\\end\{).)+)|\s+", m[1] if m else s, re.S):
        if p[2] is not None:
            yield "heading", 1 + len(p[1]) // 3, plain(p[2])
        elif p[3] is not None:
            yield "code", 0, p[3]
        elif p[4] is not None:
            for row in re.split(r"\\\\|\\hline", p[4]):
                if row.strip():
                    cells = [plain(c) for c in re.split(r"(?<!\\)&", row)]
                    yield "row", len(cells), "\t".join(cells)
        elif p[5] is not None:
            yield "item", 1, plain(" ".join(p[5].split()))
        elif p[6] and p[6].strip():
            yield "paragraph", 0, plain(" ".join(p[6].split()))


def ifcxml(data: bytes) -> Iterator[tuple]:
    """Elements with an id: number, kind, attributes and own texts, what they refer to."""
    for e in parse(data).iter():
        if attr(e, "id"):
            values = [f"{k.rpartition('}')[2]}={v}" for k, v in sorted(e.attrib.items()) if k.rpartition("}")[2] != "id"] + [f"{name(x)}={said(x)}" for x in e if not len(x) and (x.text or "").strip()]
            yield attr(e, "id"), name(e), "; ".join(values) or None, " ".join(attr(x, "ref") for x in e.iter() if x is not e and attr(x, "ref")) or None


def ifczip(data: bytes) -> Iterator[tuple]:
    z = zipfile.ZipFile(BytesIO(data))
    for n in sorted(z.namelist()):
        if n.lower().endswith((".ifc", ".ifcxml")):
            yield from (ifc if n.lower().endswith(".ifc") else ifcxml)(z.read(n))


def _elements(data: bytes, at: int, end: int) -> list[tuple[int, str, object]]:
    """(tag, kind, value) of explicit little-endian elements; of sequences lists of such lists."""
    out = []
    while at + 8 <= end:
        group, element = struct.unpack_from("<HH", data, at)
        tag = group << 16 | element
        if tag in (0xFFFEE00D, 0xFFFEE0DD):
            break
        kind = data[at + 4 : at + 6].decode("latin-1")
        if kind in ("OB", "OD", "OF", "OL", "OW", "SQ", "UC", "UN", "UR", "UT"):
            size, at = struct.unpack_from("<I", data, at + 8)[0], at + 12
        else:
            size, at = struct.unpack_from("<H", data, at + 6)[0], at + 8
        if kind == "SQ":
            items, stop = [], end if size == 0xFFFFFFFF else at + size
            while at + 8 <= stop:
                mark, length = struct.unpack_from("<II", data, at)
                at += 8
                if mark == 0xE0DDFFFE:
                    break
                inner = _span(data, at, stop) if length == 0xFFFFFFFF else length
                items.append(_elements(data, at, at + inner))
                at += inner + (8 if length == 0xFFFFFFFF else 0)
            out.append((tag, kind, items))
        else:
            out.append((tag, kind, data[at : at + size].decode("latin-1").strip(" \0")))
            at += size
    return out


def _span(data: bytes, at: int, end: int) -> int:
    """Bytes up to the mark that ends an item of no stated length, over the items within it."""
    depth, i = 0, at
    while i + 8 <= end:
        mark, length = struct.unpack_from("<II", data, i)
        if mark == 0xE000FFFE and length == 0xFFFFFFFF:
            depth += 1
        elif mark == 0xE00DFFFE:
            if not depth:
                return i - at
            depth -= 1
        i += 2
    raise ValueError("an item doesn't end")


def _dataset(data: bytes) -> list:
    if data[128:132] != b"DICM":
        raise ValueError("no DICM mark")
    return _elements(data, 132, len(data))


def dicom_sr(data: bytes) -> Iterator[tuple]:
    """The content tree of a structured report; texts and names of people are left out."""

    def go(item, depth):
        found = {tag: v for tag, _, v in item}
        concept = next((v for tag, _, v in (found.get(0x0040A043) or [[]])[0] if tag == 0x00080104), None)
        measured = next((v for tag, _, v in (found.get(0x0040A300) or [[]])[0] if tag == 0x0040A30A), None)
        coded = next((v for tag, _, v in (found.get(0x0040A168) or [[]])[0] if tag == 0x00080104), None)
        kind = found.get(0x0040A040)
        if kind:
            yield depth, kind, concept, measured or coded or ("[text omitted]" if kind in ("TEXT", "PNAME") else None), found.get(0x0040A010)
        for child in found.get(0x0040A730) or []:
            yield from go(child, depth + 1)

    yield from go(_dataset(data), 0)


def dicomdir(data: bytes) -> Iterator[tuple]:
    for tag, _, items in _dataset(data):
        if tag == 0x00041220:
            for i in items:
                found = {t: v for t, _, v in i}
                yield "record", {"PATIENT": 1, "STUDY": 2, "SERIES": 3}.get(found.get(0x00041430), 4), " ".join(filter(None, [found.get(0x00041430), (found.get(0x00041500) or "").replace("\\", "/")]))


BLOCK, CELL, METRIC = ("kind", "level", "text"), ("sheet", "cell", "type", "value", "formula", "format"), ("metric", "value")
MESH, STEP = ("kind", "no", "x", "y", "z", "refs"), ("number", "kind", "arguments", "refs")
FORMATS = {
    "doc": Format(BLOCK, doc, (".doc", ".dot")),
    "ppt": Format(("slide", "kind", "text"), ppt, (".ppt", ".pps")),
    "vsd": Format(("kind", "path", "detail"), vsd, (".vsd",)),
    "msg": Format(("sender", "recipients", "date", "subject", "body", "attachments"), msg, (".msg",)),
    "xls": Format(CELL, xls, (".xls", ".xlt")),
    "xlsb": Format(CELL, xlsb, (".xlsb",)),
    "mobi": Format(BLOCK, mobi, (".mobi", ".prc", ".azw"), lambda h: h[60:68] in (b"BOOKMOBI", b"TEXtREAd")),
    "emf": Format(METRIC, metafile, (".emf", ".wmf"), lambda h: h[40:44] == b" EMF" or h.startswith(b"\xd7\xcd\xc6\x9a")),
    "e57": Format(METRIC, e57, (".e57",), lambda h: h.startswith(b"ASTM-E57")),
    "cdb": Format(MESH, cdb, (".cdb",)),
    "ensight": Format(MESH, ensight, (".geo", ".case.geo")),
    "op2": Format(METRIC, op2, (".op2",)),
    "tex": Format(BLOCK, latex, (".tex", ".latex"), lambda h: b"\\documentclass" in h),
    "ifcxml": Format(STEP, ifcxml, (".ifcxml",)),
    "ifczip": Format(STEP, ifczip, (".ifczip",)),
    "dicom-sr": Format(("depth", "type", "concept", "value", "rel"), dicom_sr, (".sr.dcm",)),
    "dicomdir": Format(BLOCK, dicomdir, ("dicomdir",)),
}
