"""Formats that are ZIP packages: office documents, books, drawings, archives."""

from __future__ import annotations

import io
import json
import posixpath
import re
import sqlite3
import struct
import zipfile
from collections import Counter
from collections.abc import Iterator

from ..files import Format
from .jsons import joined, masked
from .texts import html_blocks
from .xmls import FORMATS as XMLS
from .xmls import letters
from .xmltree import attr, every, inside, kid, kids, name, own, parse, said

#: Parts of one package, and bytes of one of them unpacked, at most.
PARTS, PART_BYTES = 100_000, 128 << 20


class Package:
    """The parts of a ZIP file by name, and what their relationships point to."""

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.names = [i.filename for i in self.zip.infolist() if not i.is_dir()]
        if len(self.names) > PARTS:
            raise ValueError("too many parts")
        self.held = set(self.names)

    def read(self, part: str) -> bytes:
        if self.zip.getinfo(part).file_size > PART_BYTES:
            raise ValueError(f"part {part} is too large")
        return self.zip.read(part)

    def tree(self, part: str):
        return parse(self.read(part))

    def targets(self, part: str) -> dict[str, tuple[str, str]]:
        """Kind and target part of each relationship of a part, by id; external ones are left out."""
        folder, base = posixpath.split(part)
        rels = posixpath.join(folder, "_rels", base + ".rels")
        if rels not in self.held:
            return {}
        out = {}
        for r in kids(self.tree(rels), "Relationship"):
            if attr(r, "TargetMode") != "External":
                target = attr(r, "Target")
                path = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
                out[attr(r, "Id")] = (attr(r, "Type").rpartition("/")[2], path)
        return out

    def main(self, default: str) -> str:
        return next((t for k, t in self.targets("").values() if k == "officeDocument"), default)


def _rel(e) -> str | None:
    """The relationship that an element names, apart from an id of its own."""
    return next((v for k, v in e.attrib.items() if k.endswith("}id")), None)


def natural(path: str) -> list:
    """Digit runs by value, then by their length; other text without case; the name itself breaks ties."""
    return [(1, int(t), len(t), "") if t.isdigit() else (0, 0, 0, t.casefold()) for t in re.findall(r"\d+|\D+", path)] + [(2, 0, 0, path)]


def _runs(p) -> str:
    """Text of a paragraph; deleted text and field codes are left out."""
    out = []
    for e in p.iter():
        if name(e) == "t" and e.text:
            out.append(e.text)
        elif name(e) in ("tab", "br", "cr"):
            out.append("\t" if name(e) == "tab" else " ")
    return "".join(out).strip()


def docx(data: bytes) -> Iterator[tuple]:
    """Headings, list items, paragraphs and table rows in order, then notes, headers and footers."""
    pack = Package(data)
    main = pack.main("word/document.xml")
    links = pack.targets(main)
    part = lambda kind: [t for k, t in links.values() if k == kind and t in pack.held]
    styles, levels = {}, {}
    for p in part("styles"):
        for s in every(pack.tree(p), "style"):
            styles[attr(s, "styleId")] = (attr(kid(s, "basedOn"), "val"), attr(kid(s, "pPr/outlineLvl"), "val"), attr(kid(s, "name"), "val") or "")

    def level(style: str | None, depth: int = 0) -> int | None:
        """Outline level along the chain of parent styles."""
        if style not in styles or depth > 20:
            return None
        parent, outline, label = styles[style]
        if outline is not None and int(outline) < 9:
            return int(outline) + 1
        m = re.match(r"(?i)heading (\d)", label)
        return int(m[1]) if m else level(parent, depth + 1)

    def blocks(e):
        for x in e:
            if name(x) == "p":
                style, number = attr(kid(x, "pPr/pStyle"), "val"), kid(x, "pPr/numPr")
                if not (words := _runs(x)):
                    continue
                if style not in levels:
                    levels[style] = level(style) or (int(style[-1]) if style and re.fullmatch(r"(?i)heading\d", style) else 0)
                if levels[style]:
                    yield "heading", levels[style], words
                elif number is not None:
                    yield "item", int(attr(kid(number, "ilvl"), "val") or 0) + 1, words
                else:
                    yield "paragraph", 0, words
            elif name(x) == "tbl":
                for r in kids(x, "tr"):
                    cells = [" ".join(filter(None, (_runs(p) for p in every(c, "p")))) for c in kids(r, "tc")]
                    yield "row", len(cells), "\t".join(cells)
            elif name(x) in ("sdt", "sdtContent", "body", "ins"):
                yield from blocks(x)

    yield from blocks(pack.tree(main))
    for kind in ("footnote", "endnote"):
        for p in part(kind + "s"):
            for n in kids(pack.tree(p), kind):
                if attr(n, "type") not in ("separator", "continuationSeparator"):
                    yield kind, int(attr(n, "id") or 0), " ".join(_runs(x) for x in every(n, "p"))
    for kind in ("header", "footer"):
        for p in part(kind):
            words = " ".join(filter(None, (_runs(x) for x in every(pack.tree(p), "p"))))
            if words:
                yield kind, 0, words


def pptx(data: bytes) -> Iterator[tuple]:
    """Titles, paragraphs and table rows of each slide in order, with its notes."""
    pack = Package(data)
    main = pack.main("ppt/presentation.xml")
    links = pack.targets(main)
    for n, s in enumerate(every(pack.tree(main), "sldId"), 1):
        slide = links[_rel(s)][1]
        for shape in every(pack.tree(slide), "sp", "tbl"):
            if name(shape) == "tbl":
                for r in every(shape, "tr"):
                    cells = [" ".join(_runs(p) for p in every(c, "p")) for c in kids(r, "tc")]
                    yield n, "row", "\t".join(cells)
                continue
            kind = attr(kid(shape, "nvSpPr/nvPr/ph"), "type")
            for p in every(shape, "p"):
                if words := _runs(p):
                    yield n, "title" if kind in ("title", "ctrTitle") else "paragraph", words
        for kind, target in pack.targets(slide).values():
            if kind == "notesSlide" and target in pack.held:
                words = " ".join(filter(None, (_runs(p) for s in every(pack.tree(target), "sp") if attr(kid(s, "nvSpPr/nvPr/ph"), "type") == "body" for p in every(s, "p"))))
                if words:
                    yield n, "notes", words


def xlsx(data: bytes) -> Iterator[tuple]:
    """Cells with reference, type, stored value, formula and number format; shared strings are looked up."""
    pack = Package(data)
    main = pack.main("xl/workbook.xml")
    links = pack.targets(main)
    part = lambda kind: next((t for k, t in links.values() if k == kind and t in pack.held), None)
    shared = []
    if part("sharedStrings"):
        shared = ["".join(t.text or "" for t in every(s, "t")) for s in kids(pack.tree(part("sharedStrings")), "si")]
    formats: list[str] = []
    if part("styles"):
        styles = pack.tree(part("styles"))
        codes = {attr(f, "numFmtId"): attr(f, "formatCode") for f in every(styles, "numFmt")}
        formats = [codes.get(attr(x, "numFmtId"), attr(x, "numFmtId")) for x in inside(styles, "cellXfs")]
    for s in every(pack.tree(main), "sheet"):
        row = 0
        for r in every(pack.tree(links[_rel(s)][1]), "row"):
            row, column = int(attr(r, "r") or row + 1), 0
            for c in kids(r, "c"):
                ref = attr(c, "r")
                column = column + 1 if not ref else sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(re.match("[A-Z]+", ref)[0])))
                kind, value = attr(c, "t") or "n", own(c, "v")
                if kind == "s" and value is not None and value.isdigit() and int(value) < len(shared):
                    kind, value = "text", shared[int(value)]
                elif kind == "inlineStr":
                    kind, value = "text", "".join(t.text or "" for t in every(c, "t"))
                elif kind == "b":
                    kind, value = "boolean", "TRUE" if value == "1" else "FALSE"
                else:
                    kind = {"n": "number", "str": "text", "e": "error", "s": "text"}.get(kind, kind)
                style = int(attr(c, "s") or 0)
                if value is not None or kid(c, "f") is not None:
                    yield attr(s, "name"), letters(column) + str(row), kind, value, own(c, "f"), formats[style] if style < len(formats) else None


def _open(data: bytes):
    """The content of an OpenDocument file, packed or flat."""
    return Package(data).tree("content.xml") if data[:2] == b"PK" else parse(data)


def _odf_text(e) -> str:
    out = [e.text or ""]
    for x in e:
        n = name(x)
        out.append(" " * int(attr(x, "c") or 1) if n == "s" else "\t" if n == "tab" else " " if n == "line-break" else "" if n in ("note", "annotation") else _odf_text(x))
        out.append(x.tail or "")
    return "".join(out)


def _odf_blocks(e, depth: int = 0) -> Iterator[tuple]:
    for x in e:
        n = name(x)
        if n == "h":
            yield "heading", int(attr(x, "outline-level") or 1), _odf_text(x).strip()
        elif n == "p":
            if _odf_text(x).strip():
                yield "item" if depth else "paragraph", depth, _odf_text(x).strip()
        elif n == "list":
            for i in kids(x, "list-item", "list-header"):
                yield from _odf_blocks(i, depth + 1)
        elif n == "table":
            for r in every(x, "table-row"):
                cells = [" ".join(_odf_text(p).strip() for p in kids(c, "p")) for c in kids(r, "table-cell", "covered-table-cell") for _ in range(min(int(attr(c, "number-columns-repeated") or 1), 64))]
                if any(cells):
                    yield "row", len(cells), "\t".join(cells)
        elif n not in ("annotation", "tracked-changes", "sequence-decls"):
            yield from _odf_blocks(x, depth)


def odt(data: bytes) -> Iterator[tuple]:
    yield from _odf_blocks(next(every(_open(data), "text")))


def ods(data: bytes) -> Iterator[tuple]:
    """Cells with value and formula; repeated cells and rows count in the references."""
    for t in every(_open(data), "table"):
        row = 0
        for r in every(t, "table-row"):
            times, column = int(attr(r, "number-rows-repeated") or 1), 0
            for c in kids(r, "table-cell", "covered-table-cell"):
                again = int(attr(c, "number-columns-repeated") or 1)
                kind = attr(c, "value-type")
                if kind and again * times <= 100_000:
                    words = "\n".join(_odf_text(p) for p in kids(c, "p"))
                    for i in range(times):
                        for k in range(again):
                            yield attr(t, "name"), letters(column + k + 1) + str(row + i + 1), kind, attr(c, "value") or attr(c, "date-value") or attr(c, "boolean-value") or words, attr(c, "formula"), None
                column += again
            row += times


def odp(data: bytes) -> Iterator[tuple]:
    for n, page in enumerate(every(_open(data), "page"), 1):
        for frame in every(page, "p", "h"):
            if _odf_text(frame).strip():
                yield n, "paragraph", _odf_text(frame).strip()


def odg(data: bytes) -> Iterator[tuple]:
    for n, page in enumerate(every(_open(data), "page"), 1):
        for e in every(page, "rect", "line", "ellipse", "circle", "polygon", "polyline", "path", "custom-shape", "connector", "frame"):
            yield n, name(e), joined((attr(e, k) for k in ("x", "y", "width", "height", "x1", "y1", "x2", "y2")), " "), joined((_odf_text(p).strip() for p in every(e, "p")), " ")


def epub(data: bytes) -> Iterator[tuple]:
    """Blocks of the spine's documents, in its order."""
    pack = Package(data)
    opf = attr(next(every(pack.tree("META-INF/container.xml"), "rootfile")), "full-path")
    root = pack.tree(opf)
    items = {attr(i, "id"): posixpath.normpath(posixpath.join(posixpath.dirname(opf), attr(i, "href"))) for i in every(root, "item")}
    title = next(every(root, "title"), None)
    if title is not None:
        yield "title", 0, said(title)
    for ref in every(root, "itemref"):
        yield from html_blocks(pack.read(items[attr(ref, "idref")]).decode("utf-8-sig"))


def listing(data: bytes) -> Iterator[tuple]:
    """Pictures of a comic book in natural order."""
    pack = Package(data)
    pages = sorted((n for n in pack.names if re.search(r"\.(jpe?g|png|gif|webp|bmp|tiff?)$", n, re.I) and not n.startswith("__MACOSX")), key=natural)
    for n, p in enumerate(pages, 1):
        yield n, p, pack.zip.getinfo(p).file_size


def hwpx(data: bytes) -> Iterator[tuple]:
    pack = Package(data)
    for part in sorted((n for n in pack.names if re.search(r"section\d+\.xml$", n)), key=natural):
        for p in every(pack.tree(part), "p"):
            if words := "".join(t.text or "" for t in every(p, "t")).strip():
                yield "paragraph", 0, words


def fb2(data: bytes) -> Iterator[tuple]:
    if data[:2] == b"PK":
        pack = Package(data)
        data = pack.read(next(n for n in pack.names if n.lower().endswith(".fb2")))
    yield from XMLS["fb2"].rows(data)


def wacz(data: bytes) -> Iterator[tuple]:
    pack = Package(data)
    json.loads(pack.read("datapackage.json"))
    for line in pack.read("pages/pages.jsonl").decode().splitlines():
        p = json.loads(line) if line.strip() else {}
        if "url" in p:
            yield p.get("id"), masked(p["url"]), joined([p.get("status"), p.get("mime")], " / "), joined([p.get("title"), p.get("ts")], " / ")


def xps(data: bytes) -> Iterator[tuple]:
    pack = Package(data)
    for n, part in enumerate(sorted((x for x in pack.names if x.lower().endswith(".fpage")), key=natural), 1):
        for g in every(pack.tree(part), "Glyphs"):
            if attr(g, "UnicodeString"):
                yield n, attr(g, "OriginX"), attr(g, "OriginY"), attr(g, "FontRenderingEmSize"), attr(g, "UnicodeString").removeprefix("{}")


def xmind(data: bytes) -> Iterator[tuple]:
    pack = Package(data)

    def go(t, depth):
        yield "topic", depth, t.get("title")
        for x in ((t.get("children") or {}).get("attached")) or ():
            yield from go(x, depth + 1)

    def old(t, depth):
        yield "topic", depth, own(t, "title")
        for topics in kids(kid(t, "children"), "topics") if kid(t, "children") is not None else ():
            for x in kids(topics, "topic"):
                yield from old(x, depth + 1)

    if "content.json" in pack.held:
        for sheet in json.loads(pack.read("content.json")):
            yield "sheet", 0, sheet.get("title")
            yield from go(sheet["rootTopic"], 1)
    else:
        for sheet in kids(pack.tree("content.xml"), "sheet"):
            yield "sheet", 0, own(sheet, "title")
            yield from old(kid(sheet, "topic"), 1)


def _package(kinds: dict[str, str], texts: str = ""):
    """Counts parts by pattern, and elements of the XML parts that ``texts`` names."""

    def rows(data: bytes) -> Iterator[tuple]:
        pack = Package(data)
        yield "Package", len(pack.names), f"{sum(pack.zip.getinfo(n).file_size for n in pack.names)} bytes"
        for kind, rx in kinds.items():
            found = sorted((n for n in pack.names if re.search(rx, n, re.I)), key=natural)
            yield kind, len(found), joined(found[:8]) or None
        if texts:
            seen = Counter()
            for n in pack.names:
                if re.search(texts, n, re.I):
                    seen.update(name(e) for e in pack.tree(n).iter())
            for k, n in sorted(seen.items()):
                yield "Element", k, n

    return rows


def bcf(data: bytes) -> Iterator[tuple]:
    pack = Package(data)
    for part in sorted(n for n in pack.names if n.endswith("markup.bcf")):
        t = next(every(pack.tree(part), "Topic"))
        yield "Topic", own(t, "Title"), joined([attr(t, "TopicType"), attr(t, "TopicStatus"), own(t, "Priority")], " / ")
        yield "Comments", sum(1 for _ in every(pack.tree(part), "Comment")), part.split("/")[0]
    yield "Viewpoints", sum(n.endswith(".bcfv") for n in pack.names), None
    yield "Snapshots", sum(n.lower().endswith((".png", ".jpg")) for n in pack.names), None


def omex(data: bytes) -> Iterator[tuple]:
    pack = Package(data)
    listed = kids(pack.tree("manifest.xml"), "content")
    yield "Archive", len(pack.names), f"{len(listed)} listed"
    for c in listed:
        yield "Content", attr(c, "location"), attr(c, "format")


def idml(data: bytes) -> Iterator[tuple]:
    pack = Package(data)
    yield "Package", len(pack.names), None
    for kind, folder in (("Layout", "Spreads/"), ("Resources", "Resources/"), ("Text", "Stories/")):
        yield kind, sum(n.startswith(folder) for n in pack.names), folder.rstrip("/")
    for part in sorted(n for n in pack.names if n.startswith("Stories/")):
        yield "Story", posixpath.basename(part), "".join(c.text or "" for c in every(pack.tree(part), "Content"))


def _database(data: bytes) -> sqlite3.Connection:
    """The database in memory; nothing touches a disk."""
    db = sqlite3.connect(":memory:")
    db.deserialize(data)
    return db


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def sqlite(data: bytes) -> Iterator[tuple]:
    """Cells of the first 2,000 rows of each table of a database; its own tables are left out."""
    db = _database(data)
    try:
        names = [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]
        for t in names:
            found = db.execute(f"SELECT * FROM {_quoted(t)} LIMIT 2000")
            heads = [d[0] for d in found.description][:128]
            for n, row in enumerate(found, 1):
                for h, v in zip(heads, row, strict=False):
                    yield t, n, h, type(v).__name__.replace("NoneType", "null"), f"{len(v)} bytes" if isinstance(v, bytes) else v if v is None else str(v)[:512]
    except sqlite3.DatabaseError as e:
        raise ValueError(str(e)) from None
    finally:
        db.close()


def wkb(data: bytes, at: int = 0) -> tuple[str, int]:
    """Well-known binary, and its extension with Z, M and reference system, as text; and where it ends."""
    order = "<" if data[at] else ">"
    (kind,) = struct.unpack_from(order + "I", data, at + 1)
    at += 5
    if kind & 0x20000000:
        at += 4
    dims = 2 + bool(kind & 0x80000000) + bool(kind & 0x40000000) + (0, 1, 1, 2)[(kind & 0xFFFF) // 1000]
    kind = (kind & 0xFFFF) % 1000

    def points(n: int) -> str:
        nonlocal at
        v = struct.unpack_from(f"{order}{n * dims}d", data, at)
        at += 8 * n * dims
        return ", ".join(" ".join(f"{x:.15g}" for x in v[i : i + 2]) for i in range(0, len(v), dims))

    def count() -> int:
        nonlocal at
        (n,) = struct.unpack_from(order + "I", data, at)
        at += 4
        return n

    names = {1: "POINT", 2: "LINESTRING", 3: "POLYGON", 4: "MULTIPOINT", 5: "MULTILINESTRING", 6: "MULTIPOLYGON", 7: "GEOMETRYCOLLECTION"}
    if kind == 1:
        return f"POINT ({points(1)})", at
    if kind == 2:
        return f"LINESTRING ({points(count())})", at
    if kind == 3:
        return "POLYGON (" + ", ".join(f"({points(count())})" for _ in range(count())) + ")", at
    if kind in names:
        parts = []
        for _ in range(count()):
            one, at = wkb(data, at)
            parts.append(one if kind == 7 else one[one.index("(") :])
        return f"{names[kind]} ({', '.join(parts)})", at
    raise ValueError(f"geometry kind {kind}")


def geopackage(data: bytes) -> Iterator[tuple]:
    """Geometries of the feature layers, and how many tiles the tile layers have."""
    db = _database(data)
    try:
        for table, column in db.execute("SELECT table_name, column_name FROM gpkg_geometry_columns ORDER BY table_name").fetchall():
            for n, (blob,) in enumerate(db.execute(f"SELECT {_quoted(column)} FROM {_quoted(table)}"), 1):
                if blob is not None:
                    if blob[:2] != b"GP":
                        raise ValueError("geometry header")
                    head = 8 + (0, 32, 48, 48, 64)[blob[3] >> 1 & 7]
                    yield table, n, wkb(blob, head)[0]
        for (table,) in db.execute("SELECT table_name FROM gpkg_contents WHERE data_type = 'tiles' ORDER BY 1").fetchall():
            yield table, db.execute(f"SELECT count(*) FROM {_quoted(table)}").fetchone()[0], "tiles"
    except sqlite3.DatabaseError as e:
        raise ValueError(str(e)) from None
    finally:
        db.close()


BLOCK, SLIDE, CELL, COUNT = ("kind", "level", "text"), ("slide", "kind", "text"), ("sheet", "cell", "type", "value", "formula", "format"), ("kind", "value", "detail")
FORMATS = {
    "docx": Format(BLOCK, docx, (".docx", ".docm", ".dotx")),
    "pptx": Format(SLIDE, pptx, (".pptx", ".pptm", ".ppsx")),
    "xlsx": Format(CELL, xlsx, (".xlsx", ".xlsm", ".xltx")),
    "odt": Format(BLOCK, odt, (".odt", ".ott", ".fodt")),
    "ods": Format(CELL, ods, (".ods", ".ots", ".fods")),
    "odp": Format(SLIDE, odp, (".odp", ".otp", ".fodp")),
    "odg": Format(("page", "kind", "place", "text"), odg, (".odg", ".otg", ".fodg")),
    "epub": Format(BLOCK, epub, (".epub",)),
    "cbz": Format(("page", "name", "bytes"), listing, (".cbz",)),
    "hwpx": Format(BLOCK, hwpx, (".hwpx",)),
    "fb2": Format(BLOCK, fb2, (".fb2", ".fb2.zip", ".fbz"), XMLS["fb2"].sniff),
    "wacz": Format(("page", "url", "status_mime", "title_time"), wacz, (".wacz",)),
    "xps": Format(("page", "x", "y", "size", "text"), xps, (".xps", ".oxps")),
    "xmind": Format(BLOCK, xmind, (".xmind",)),
    "bcfzip": Format(COUNT, bcf, (".bcf", ".bcfzip")),
    "omex": Format(COUNT, omex, (".omex", ".sedx")),
    "idml": Format(COUNT, idml, (".idml",)),
    "aasx": Format(COUNT, _package({"Descriptions": r"\.aas\.xml$|aasenv", "Files": r"^aasx/files/"}, r"aas.*\.xml$"), (".aasx",)),
    "3dxml": Format(COUNT, _package({"Manifest": r"manifest\.xml$", "Representations": r"\.3drep$"}, r"\.3dxml$"), (".3dxml",)),
    "iwork": Format(COUNT, _package({"Index": r"^index", "Pictures": r"\.(png|jpe?g|pdf)$", "Data": r"^data/"}), (".pages", ".numbers", ".key")),
    "sqlite": Format(("table", "row", "column", "type", "value"), sqlite, (".sqlite", ".sqlite3", ".db"), lambda h: h.startswith(b"SQLite format 3\0")),
    "geopackage": Format(("layer", "feature", "geometry"), geopackage, (".gpkg",)),
}
