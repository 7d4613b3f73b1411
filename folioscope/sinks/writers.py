"""Rows back to files: one function for each format from the rows that its reader gives to a file's bytes.

``files_from`` makes a file of each group of rows; ``publish`` writes them, all or none,
with a report last.  What a format can't hold is left out, as LOSSES says.
"""

from __future__ import annotations

import base64
import csv
import html
import io
import json
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import formats

#: What is lost on the way into a format.
LOSSES = {"mermaid": "attributes of nodes and edges", "pdf": "all but lines of text", "datauri": "nothing but the wrapping", "xlsx": "number formats", "docx": "fonts and places", "stl": "vertex numbers"}
_XML = '<?xml version="1.0" encoding="UTF-8"?>\n'


def esc(s) -> str:
    """Text for XML, without the control characters that it can't hold."""
    return html.escape(re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", "" if s is None else str(s)), quote=True)


def number(x, digits: int = 12) -> str:
    """At most ``digits`` decimals without trailing zeros; -0 and what rounds to it are 0."""
    s = f"{float(x):.{digits}f}".rstrip("0").rstrip(".") if "." in f"{float(x):.{digits}f}" else f"{float(x):.{digits}f}"
    return "0" if s in ("-0", "") else s


def packed(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, part in parts.items():
            z.writestr(zipfile.ZipInfo(name), part if isinstance(part, bytes) else _XML + part, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def _relations(*targets: tuple[str, str]) -> str:
    space = "http://schemas.openxmlformats.org/package/2006/relationships"
    kind = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/"
    return f'<Relationships xmlns="{space}">' + "".join(f'<Relationship Id="rId{i}" Type="{kind}{k}" Target="{t}"/>' for i, (k, t) in enumerate(targets, 1)) + "</Relationships>"


def _types(*overrides: tuple[str, str]) -> str:
    kind = "application/vnd.openxmlformats-officedocument."
    return '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>' + "".join(f'<Override PartName="{p}" ContentType="{kind}{k}+xml"/>' for p, k in overrides) + "</Types>"


def docx(rows) -> bytes:
    """Blocks (kind, level, text); rows of cells in a run become a table."""
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"

    def paragraph(text: str, style: str = "", item: int = 0) -> str:
        props = (f'<w:pStyle w:val="{style}"/>' if style else "") + (f'<w:numPr><w:ilvl w:val="{item - 1}"/><w:numId w:val="1"/></w:numPr>' if item else "")
        runs = '<w:tab/>'.join(f'<w:t xml:space="preserve">{esc(t)}</w:t>' for t in text.split("\t"))
        return f"<w:p>{f'<w:pPr>{props}</w:pPr>' if props else ''}<w:r>{runs}</w:r></w:p>"

    out, table = [], False
    for kind, level, text in rows:
        if table and kind != "row":
            out.append("</w:tbl>")
        if kind == "row":
            out.append("" if table else "<w:tbl>")
            out.append("<w:tr>" + "".join(f"<w:tc>{paragraph(c)}</w:tc>" for c in text.split("\t")) + "</w:tr>")
        else:
            out.append(paragraph(text, f"Heading{level}" if kind == "heading" else "", int(level) if kind == "item" else 0))
        table = kind == "row"
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="Heading{k}"><w:name w:val="heading {k}"/><w:pPr><w:outlineLvl w:val="{k - 1}"/></w:pPr></w:style>' for k in range(1, 10))
    body = "".join(out) + ("</w:tbl>" if table else "")
    return packed({"[Content_Types].xml": _types(("/word/document.xml", "wordprocessingml.document.main"), ("/word/styles.xml", "wordprocessingml.styles")), "_rels/.rels": _relations(("officeDocument", "word/document.xml")), "word/_rels/document.xml.rels": _relations(("styles", "styles.xml")), "word/styles.xml": f'<w:styles xmlns:w="{w}">{styles}</w:styles>', "word/document.xml": f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>'})


def pptx(rows) -> bytes:
    """Lines (slide, kind, text): titles and paragraphs, a text box each."""
    p, a, r = "http://schemas.openxmlformats.org/presentationml/2006/main", "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    slides: dict[str, list[str]] = {}
    for slide, kind, text in rows:
        holder = '<p:ph type="title"/>' if kind == "title" else ""
        box = slides.setdefault(str(slide), [])
        box.append(f'<p:sp><p:nvSpPr><p:cNvPr id="{len(box) + 2}" name="t"/><p:cNvSpPr/><p:nvPr>{holder}</p:nvPr></p:nvSpPr><p:spPr/><p:txBody><a:bodyPr/><a:p><a:r><a:t>{esc(text)}</a:t></a:r></a:p></p:txBody></p:sp>')
    parts = {f"ppt/slides/slide{n}.xml": f'<p:sld xmlns:p="{p}" xmlns:a="{a}"><p:cSld><p:spTree><p:nvGrpSpPr><p:cNvPr id="1" name=""/><p:cNvGrpSpPr/><p:nvPr/></p:nvGrpSpPr><p:grpSpPr/>{"".join(b)}</p:spTree></p:cSld></p:sld>' for n, b in enumerate(slides.values(), 1)}
    listed = "".join(f'<p:sldId id="{255 + n}" r:id="rId{n}"/>' for n in range(1, len(slides) + 1))
    return packed({"[Content_Types].xml": _types(("/ppt/presentation.xml", "presentationml.presentation.main"), *((f"/{k}", "presentationml.slide") for k in parts)), "_rels/.rels": _relations(("officeDocument", "ppt/presentation.xml")), "ppt/presentation.xml": f'<p:presentation xmlns:p="{p}" xmlns:r="{r}"><p:sldIdLst>{listed}</p:sldIdLst></p:presentation>', "ppt/_rels/presentation.xml.rels": _relations(*(("slide", k.removeprefix("ppt/")) for k in parts)), **parts})


def xlsx(rows) -> bytes:
    """Cells (sheet, cell, type, value, formula, format); texts are kept inline."""
    s, r = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    sheets: dict[str, dict[int, list[str]]] = {}
    for sheet, ref, kind, value, formula, _ in rows:
        f = f"<f>{esc(formula)}</f>" if formula else ""
        if kind == "text":
            cell = f'<c r="{ref}" t="inlineStr">{f}<is><t xml:space="preserve">{esc(value)}</t></is></c>'
        elif kind == "boolean":
            cell = f'<c r="{ref}" t="b">{f}<v>{int(value == "TRUE")}</v></c>'
        else:
            cell = f'<c r="{ref}"{" t=" + chr(34) + "e" + chr(34) if kind == "error" else ""}>{f}<v>{esc(value)}</v></c>'
        sheets.setdefault(sheet, {}).setdefault(int(re.search(r"\d+", ref)[0]), []).append(cell)
    parts = {f"xl/worksheets/sheet{n}.xml": f'<worksheet xmlns="{s}"><sheetData>' + "".join(f'<row r="{k}">{"".join(c)}</row>' for k, c in sorted(found.items())) + "</sheetData></worksheet>" for n, found in enumerate(sheets.values(), 1)}
    listed = "".join(f'<sheet name="{esc(k)}" sheetId="{n}" r:id="rId{n}"/>' for n, k in enumerate(sheets, 1))
    return packed({"[Content_Types].xml": _types(("/xl/workbook.xml", "spreadsheetml.sheet.main"), *((f"/{k}", "spreadsheetml.worksheet") for k in parts)), "_rels/.rels": _relations(("officeDocument", "xl/workbook.xml")), "xl/workbook.xml": f'<workbook xmlns="{s}" xmlns:r="{r}"><sheets>{listed}</sheets></workbook>', "xl/_rels/workbook.xml.rels": _relations(*(("worksheet", k.removeprefix("xl/")) for k in parts)), **parts})


def pdf(rows) -> bytes:
    """Lines of text (metric "text") on pages of 60."""
    lines = [v for k, v in rows if k == "text"]
    pages = [lines[i : i + 60] for i in range(0, len(lines), 60)] or [[]]
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{' '.join(f'{4 + 2 * i} 0 R' for i in range(len(pages)))}] /Count {len(pages)} >>", "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]
    for i, page in enumerate(pages):
        shown = "".join("({}) Tj T*\n".format(re.sub(r"([()\\])", r"\\\1", t)) for t in page)
        body = f"BT /F1 10 Tf 12 TL 54 788 Td\n{shown}ET"
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R >> >> /Contents {5 + 2 * i} 0 R >>")
        objects.append(f"<< /Length {len(body.encode('cp1252', 'replace'))} >>\nstream\n{body}\nendstream")
    out, places = b"%PDF-1.4\n", []
    for n, o in enumerate(objects, 1):
        places.append(len(out))
        out += f"{n} 0 obj\n{o}\nendobj\n".encode("cp1252", "replace")
    table = "".join(f"{p:010d} 00000 n \n" for p in places)
    return out + f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n{table}trailer << /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{len(out)}\n%%EOF\n".encode()


def csv_text(rows) -> bytes:
    """Cells (row, col, header, value)."""
    heads: dict[int, str] = {}
    lines: dict[int, dict[int, str]] = {}
    for r, c, h, v in rows:
        heads[int(c)] = h or ""
        lines.setdefault(int(r), {})[int(c)] = "" if v is None else v
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\r\n")
    w.writerow([heads[k] for k in sorted(heads)])
    for r in sorted(lines):
        w.writerow([lines[r].get(k, "") for k in sorted(heads)])
    return out.getvalue().encode()


def markdown(rows) -> bytes:
    """Blocks; the first of a run of table rows is its header."""
    out, table = [], False
    plain = lambda t: re.sub(r"([|])", r"\\\1", t)
    for kind, level, text in rows:
        if kind == "row":
            cells = text.split("\t")
            out.append("| " + " | ".join(map(plain, cells)) + " |")
            if not table:
                out.append("|" + " --- |" * len(cells))
        else:
            out += [""] if out else []
            out.append({"heading": f"{'#' * int(level or 1)} {text}", "item": f"{'  ' * (int(level or 1) - 1)}{'' if re.match(r'[0-9]+[.] ', text or '') else '- '}{text}", "quote": f"> {text}", "code": f"```\n{text}\n```", "rule": "---"}.get(kind, text))
        table = kind == "row"
    return ("\n".join(out) + "\n").encode()


def html_page(rows) -> bytes:
    out, table = [], False
    for kind, level, text in rows:
        if table and kind != "row":
            out.append("</table>")
        if kind == "row":
            out.append(("" if table else "<table>") + "<tr>" + "".join(f"<td>{esc(c)}</td>" for c in text.split("\t")) + "</tr>")
        else:
            tag = {"heading": f"h{level}", "item": "li", "quote": "blockquote", "code": "pre"}.get(kind, "p")
            body = "<hr>" if kind == "rule" else f"<{tag}>{esc(text)}</{tag}>"
            out.append("<ul>" * int(level) + body + "</ul>" * int(level) if kind == "item" else body)
        table = kind == "row"
    return ("<!DOCTYPE html>\n<html><head><meta charset=\"utf-8\"></head><body>\n" + "\n".join(out) + ("</table>" if table else "") + "\n</body></html>\n").encode()


def tex(rows) -> bytes:
    """Blocks as a document with sections, items, verbatim code and tables."""
    plain = lambda t: re.sub(r"([#$%&_{}])", r"\\\1", re.sub(r"\\", r"\\textbackslash{}", t))
    out = []
    for kind, level, text in rows:
        if kind == "heading":
            out.append(f"\\{'sub' * (min(int(level), 3) - 1)}section{{{plain(text)}}}")
        elif kind == "item":
            out.append(f"\\begin{{itemize}}\\item {plain(text)}\\end{{itemize}}")
        elif kind == "code":
            out.append(f"\\begin{{verbatim}}\n{text}\n\\end{{verbatim}}")
        elif kind == "row":
            cells = text.split("\t")
            out.append(f"\\begin{{tabular}}{{{'l' * len(cells)}}}{' & '.join(map(plain, cells))}\\end{{tabular}}")
        else:
            out.append(plain(text) + "\n")
    return ("\\documentclass{article}\n\\begin{document}\n" + "\n".join(out) + "\n\\end{document}\n").encode()


def svg(rows) -> bytes:
    """Primitives (kind, depth, shape, fill, stroke, text); attributes in a fixed order."""
    out = []
    for kind, _, shape, fill, stroke, text in rows:
        if kind in ("path",):
            place = f' d="{esc(shape)}"'
        elif kind in ("polyline", "polygon"):
            place = f' points="{esc(shape)}"'
        else:
            place = "".join(f' {k}="{esc(v)}"' for k, _, v in (p.partition("=") for p in (shape or "").split()))
        paint = "".join(f' {k}="{esc(v)}"' for k, v in (("fill", fill), ("stroke", stroke)) if v is not None)
        out.append(f"<{kind}{place}{paint}>{esc(text)}</{kind}>" if kind == "text" else f"<{kind}{place}{paint}/>")
    return ('<svg xmlns="http://www.w3.org/2000/svg">' + "".join(out) + "</svg>").encode()


def data_uri(rows) -> bytes:
    return b"data:image/svg+xml;base64," + base64.b64encode(svg(rows))


def path_data(rows) -> bytes:
    """The drawing's paths, one a line."""
    return "\n".join(shape for kind, _, shape, *_ in rows if kind == "path").encode()


def _attributes(text: str) -> str:
    """Attribute names as a component language has them: camel case, but for data- and aria-."""
    return re.sub(r"(?<=\s)(?!data-|aria-)([a-z]+)-([a-z]+)(?==)", lambda m: m[1] + m[2].capitalize(), text)


def jsx(rows) -> bytes:
    body = _attributes(svg(rows).decode()).replace("<svg ", "<svg {...props} ", 1)
    return f"export default function Drawing(props) {{\n  return (\n    {body}\n  );\n}}\n".encode()


def tsx(rows) -> bytes:
    return (b'import type { SVGProps } from "react";\n\n' + jsx(rows)).replace(b"Drawing(props)", b"Drawing(props: SVGProps<SVGSVGElement>)")


def vue(rows) -> bytes:
    return b"<template>\n  " + svg(rows) + b"\n</template>\n"


def svelte(rows) -> bytes:
    return svg(rows).replace(b"<svg ", b"<svg {...$$restProps} ", 1) + b"\n"


def _quoted(t: str) -> str:
    return '"' + t.replace("\\", "\\\\").replace('"', '\\"') + '"'


def dot(rows) -> bytes:
    """Nodes and edges (kind, id, label, source, target)."""
    rows = list(rows)
    directed = not any(k == "edge" and i == "undirected" for k, i, *_ in rows)
    out = []
    for kind, key, label, a, b in rows:
        if kind == "node":
            out.append(f"  {_quoted(key)}" + (f" [label={_quoted(label)}]" if label != key else "") + ";")
        else:
            out.append(f"  {_quoted(a)} {'->' if directed else '--'} {_quoted(b)}" + (f" [label={_quoted(label)}]" if label else "") + ";")
    return (f"{'digraph' if directed else 'graph'} g {{\n" + "\n".join(out) + "\n}\n").encode()


def mermaid(rows) -> bytes:
    out = ["flowchart TD"]
    for kind, key, label, a, b in rows:
        if kind == "node":
            out.append(f'  {key}["{label}"]' if label != key else f"  {key}")
        else:
            out.append(f"  {a} {'---' if key == 'undirected' else '-->'}{f'|{label}|' if label else ''} {b}")
    return ("\n".join(out) + "\n").encode()


def drawio(rows) -> bytes:
    pages: dict[str, list[str]] = {}
    for page, key, kind, label, a, b, *place in rows:
        cells = pages.setdefault(str(page), ['<mxCell id="0"/>', '<mxCell id="1" parent="0"/>'])
        geometry = "".join(f' {k}="{esc(v)}"' for k, v in zip(("x", "y", "width", "height"), place, strict=True) if v is not None)
        ends = "".join(f' {k}="{esc(v)}"' for k, v in (("source", a), ("target", b)) if v is not None)
        shape = f"<mxGeometry{geometry} as=\"geometry\"/>" if geometry else ""
        cells.append(f'<mxCell id="{esc(key)}" value="{esc(esc(label))}" {"edge" if kind == "edge" else "vertex"}="1" parent="1"{ends}>{shape}</mxCell>')
    return (_XML + "<mxfile>" + "".join(f'<diagram name="Page-{k}"><mxGraphModel><root>{"".join(c)}</root></mxGraphModel></diagram>' for k, c in pages.items()) + "</mxfile>").encode()


def _mesh(rows) -> tuple[list[list[str]], list[list[int]]]:
    points, faces = [], []
    for kind, _, x, y, z, refs in rows:
        if kind == "v":
            points.append([x, y, z])
        elif kind == "f":
            faces.append([int(c) for c in refs.split()])
    return points, faces


def obj(rows) -> bytes:
    points, faces = _mesh(rows)
    return "".join([*(f"v {' '.join(p)}\n" for p in points), *(f"f {' '.join(str(c + 1) for c in f)}\n" for f in faces)]).encode()


def off(rows) -> bytes:
    points, faces = _mesh(rows)
    return (f"OFF\n{len(points)} {len(faces)} 0\n" + "".join([*(f"{' '.join(p)}\n" for p in points), *(f"{len(f)} {' '.join(map(str, f))}\n" for f in faces)])).encode()


def ply(rows) -> bytes:
    points, faces = _mesh(rows)
    head = f"ply\nformat ascii 1.0\nelement vertex {len(points)}\nproperty double x\nproperty double y\nproperty double z\nelement face {len(faces)}\nproperty list int int vertex_indices\nend_header\n"
    return (head + "".join([*(f"{' '.join(p)}\n" for p in points), *(f"{len(f)} {' '.join(map(str, f))}\n" for f in faces)])).encode()


def stl(rows) -> bytes:
    """Binary triangles; faces of more corners are fans."""
    points, faces = _mesh(rows)
    out = []
    for f in faces:
        for k in range(1, len(f) - 1):
            a, b, c = ([float(v) for v in points[i]] for i in (f[0], f[k], f[k + 1]))
            u, v = [b[i] - a[i] for i in range(3)], [c[i] - a[i] for i in range(3)]
            n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
            size = sum(x * x for x in n) ** 0.5 or 1.0
            out.append(struct.pack("<12fH", *(x / size for x in n), *a, *b, *c, 0))
    return b"folioscope".ljust(80) + struct.pack("<I", len(out)) + b"".join(out)


def threemf(rows) -> bytes:
    points, faces = _mesh(rows)
    v = "".join(f'<vertex x="{p[0]}" y="{p[1]}" z="{p[2]}"/>' for p in points)
    t = "".join(f'<triangle v1="{f[0]}" v2="{f[k]}" v3="{f[k + 1]}"/>' for f in faces for k in range(1, len(f) - 1))
    model = f'<model unit="millimeter" xmlns="http://schemas.microsoft.com/3dmanufacturing/core/2015/02"><resources><object id="1" type="model"><mesh><vertices>{v}</vertices><triangles>{t}</triangles></mesh></object></resources><build><item objectid="1"/></build></model>'
    types = '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="model" ContentType="application/vnd.ms-package.3dmanufacturing-3dmodel+xml"/></Types>'
    rels = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rel0" Type="http://schemas.microsoft.com/3dmanufacturing/2013/01/3dmodel" Target="/3D/3dmodel.model"/></Relationships>'
    return packed({"[Content_Types].xml": types, "_rels/.rels": rels, "3D/3dmodel.model": model})


def gmsh(rows) -> bytes:
    points, faces = _mesh(rows)
    kinds = {2: 1, 3: 2, 4: 3, 8: 5}  # fixed values: element kinds by corners
    nodes = "".join(f"{i} {' '.join(p)}\n" for i, p in enumerate(points, 1))
    cells = "".join(f"{i} {kinds[len(f)]} 2 0 0 {' '.join(str(c + 1) for c in f)}\n" for i, f in enumerate(faces, 1))
    return f"$MeshFormat\n2.2 0 8\n$EndMeshFormat\n$Nodes\n{len(points)}\n{nodes}$EndNodes\n$Elements\n{len(faces)}\n{cells}$EndElements\n".encode()


def vtk(rows) -> bytes:
    points, faces = _mesh(rows)
    lines = "".join(f"{len(f)} {' '.join(map(str, f))}\n" for f in faces)
    return (f"# vtk DataFile Version 3.0\nmesh\nASCII\nDATASET POLYDATA\nPOINTS {len(points)} double\n" + "".join(f"{' '.join(p)}\n" for p in points) + f"POLYGONS {len(faces)} {sum(len(f) + 1 for f in faces)}\n{lines}").encode()


def step(rows) -> bytes:
    """Entities (number, kind, arguments, refs)."""
    body = "".join(f"#{n}={kind or ''}({arguments});\n" for n, kind, arguments, _ in rows)
    return f"ISO-10303-21;\nHEADER;\nFILE_DESCRIPTION((''),'2;1');\nFILE_NAME('','',(''),(''),'','','');\nFILE_SCHEMA(('AUTOMOTIVE_DESIGN'));\nENDSEC;\nDATA;\n{body}ENDSEC;\nEND-ISO-10303-21;\n".encode()


def iges(rows) -> bytes:
    """Entities (entry, kind, level, parameters), a parameter line each for up to 64 characters."""
    line = lambda s, k, n: f"{s:<72}{k}{n:>7}\n"
    directory, parameters = [], []
    for _, kind, level, values in rows:
        body = ",".join([str(kind), *(values or "").split()]) + ";"
        parts = [body[i : i + 64] for i in range(0, len(body), 64)]
        first, entry = len(parameters) + 1, 2 * len(directory) + 1
        parameters += [f"{p:<64}{entry:>8}" for p in parts]
        directory.append((f"{kind:>8}{first:>8}{0:>8}{0:>8}{level or '':>8}" + f"{0:>8}" * 4, f"{kind:>8}{0:>8}{0:>8}{len(parts):>8}" + f"{0:>8}" * 5))
    out = line("folioscope", "S", 1) + line("1H,,1H;;", "G", 1)
    for i, (a, b) in enumerate(directory):
        out += line(a, "D", 2 * i + 1) + line(b, "D", 2 * i + 2)
    for i, p in enumerate(parameters, 1):
        out += line(p, "P", i)
    return (out + line(f"S{1:>7}G{1:>7}D{2 * len(directory):>7}P{len(parameters):>7}", "T", 1)).encode()


def dxf(rows) -> bytes:
    """Entities (kind, layer, points, radius, text)."""
    out = ["0", "SECTION", "2", "ENTITIES"]
    for kind, layer, points, radius, text in rows:
        out += ["0", kind, "8", layer or "0"]
        for i, p in enumerate((points or "").split(", ") if points else []):
            x, y = p.split()
            step = 0 if kind == "LWPOLYLINE" else i
            out += [str(10 + step), x, str(20 + step), y]
        out += ["40", radius] if radius is not None else []
        out += ["1", text] if text is not None else []
    return ("\n".join([*out, "0", "ENDSEC", "0", "EOF"]) + "\n").encode()


def gcode(rows) -> bytes:
    """Moves (line, kind, start, end); arcs are lines."""
    out = ["G21", "G90"]
    for _, kind, _, _, _, x, y, z in rows:
        out.append(f"{'G0' if kind == 'rapid' else 'G1'} X{x} Y{y} Z{z}")
    return ("\n".join([*out, "M2"]) + "\n").encode()


def hpgl(rows) -> bytes:
    out, pen = ["IN;"], None
    for _, kind, p, _, _, x, y in rows:
        if p != pen:
            out.append(f"SP{p};")
            pen = p
        out.append(f"{'PD' if kind == 'draw' else 'PU'}{x},{y};")
    return "".join(out).encode()


def gerber(rows) -> bytes:
    """Draws, moves and flashes (no, kind, aperture, start, end), apertures in a table of their own."""
    rows = list(rows)
    codes = {a: 10 + i for i, a in enumerate(dict.fromkeys(r[2] for r in rows if r[2]))}
    out = ["%FSLAX46Y46*%", "%MOIN*%", *(f"%ADD{c}{a}*%" for a, c in codes.items())]
    now = None
    for _, kind, aperture, _, _, x, y in rows:
        if aperture and codes[aperture] != now:
            now = codes[aperture]
            out.append(f"D{now}*")
        out.append(f"X{round(float(x) * 1e6)}Y{round(float(y) * 1e6)}D0{ {'draw': 1, 'move': 2, 'flash': 3}[kind]}*")
    return ("\n".join([*out, "M02*"]) + "\n").encode()


def excellon(rows) -> bytes:
    """Hits (hit, tool, diameter, x, y, units) by tool."""
    rows = list(rows)
    tools = dict.fromkeys((t, d) for _, t, d, *_ in rows)
    out = ["M48", "METRIC" if rows and rows[0][5] == "mm" else "INCH", *(f"T{t}C{d}" for t, d in tools), "%"]
    for t, _ in tools:
        out.append(f"T{t}")
        out += [f"X{float(x)}Y{float(y)}" for _, u, _, x, y, _ in rows if u == t]
    return ("\n".join([*out, "M30"]) + "\n").encode()


def png(rows) -> bytes:
    """Grey pixels (row, column, value 0 to 1): a grid as a picture of 8 bits."""
    cells = {(int(r), int(c)): v for r, c, _, v in rows}
    height, width = (max(k[i] for k in cells) + 1 for i in (0, 1)) if cells else (1, 1)
    raw = b"".join(b"\0" + bytes(round(255 * float(cells.get((r, c)) or 0)) for c in range(width)) for r in range(height))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 9)) + chunk(b"IEND", b"")


#: Writer, the format whose rows it takes, and the reader that gives them back (where one does).
WRITERS: dict[str, tuple[Callable, str, str | None]] = {
    "docx": (docx, "docx", "docx"), "pptx": (pptx, "pptx", "pptx"), "xlsx": (xlsx, "xlsx", "xlsx"), "pdf": (pdf, "pdf", "pdf"), "csv": (csv_text, "csv", "csv"), "markdown": (markdown, "docx", "markdown"), "html": (html_page, "docx", "html"), "tex": (tex, "docx", "tex"),
    "svg": (svg, "svg", "svg"), "datauri": (data_uri, "svg", None), "path": (path_data, "svg", None), "jsx": (jsx, "svg", None), "tsx": (tsx, "svg", None), "vue": (vue, "svg", None), "svelte": (svelte, "svg", None),
    "dot": (dot, "dot", "dot"), "mermaid": (mermaid, "mermaid", "mermaid"), "drawio": (drawio, "drawio", "drawio"), "obj": (obj, "obj", "obj"), "off": (off, "off", "off"), "ply": (ply, "ply", "ply"), "stl": (stl, "stl", "stl"), "3mf": (threemf, "threemf", "threemf"),
    "gmsh": (gmsh, "simulation", "simulation"), "vtk": (vtk, "simulation", "simulation"), "step": (step, "step", "step"), "iges": (iges, "iges", "iges"), "dxf": (dxf, "dxf", "dxf"), "gcode": (gcode, "gcode", "gcode"), "hpgl": (hpgl, "hpgl", "hpgl"), "gerber": (gerber, "gerber", "gerber"),
    "excellon": (excellon, "excellon", "excellon"), "png": (png, "esri_ascii_grid", "raster"),
}


def files_from(rows: DataFrame, name: str) -> DataFrame:
    """(path, content) of rows (file_path, ord, the columns of the writer's format): one file of each file_path.

    Rows of a file come together sorted by ord and are written by one task; error rows are left out.
    """
    write, of, _ = WRITERS[name]
    columns = formats()[of].columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done():
            return pa.record_batch([pa.array([now], pa.string()), pa.array([write(held)], pa.binary())], names=["path", "content"])

        for batch in batches:
            for path, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and path != now:
                    yield done()
                    held = []
                now = path
                held.append(tuple(row))
        if held:
            yield done()

    some = rows.where("error is null") if "error" in rows.columns else rows
    some = some.repartition("file_path").sortWithinPartitions("file_path", "ord")
    return some.select("file_path", *[F.col(f"`{c}`").cast("string") for c in columns]).mapInArrow(run, "path string, content binary")


def publish(files: DataFrame, folder: str, suffix: str = "") -> DataFrame:
    """Writes (path, content) as files under a new folder and gives the report (file, bytes).

    Executors write into a folder beside it, the report as a table there, too; it is renamed when
    all are there, and ``folder`` must not exist.  ``conversion.json``, the sums, is written last
    and marks the end.  Nothing that grows with the files comes to the driver.
    """
    spark: SparkSession = files.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(hadoop(folder)):
        raise FileExistsError(folder)
    stage = f"{folder.rstrip('/')}.part"
    fs.delete(hadoop(stage), True)
    where = stage if "://" in stage else "file://" + stage.removeprefix("file:")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as arrow_fs

        store, base = arrow_fs.FileSystem.from_uri(where)
        store.create_dir(base, recursive=True)
        for batch in batches:
            names, sizes = [], []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = re.sub(r"[^\w.-]", "_", path.rpartition("/")[2]) + suffix
                with store.open_output_stream(f"{base}/{file}") as f:  # a task that runs again writes the same
                    f.write(content)
                names.append(file)
                sizes.append(len(content))
            yield pa.record_batch([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], names=["file", "bytes"])

    files.mapInArrow(run, "file string, bytes long").write.parquet(f"{stage}/_report")
    n, size = spark.read.parquet(f"{stage}/_report").agg(F.count("*"), F.sum("bytes")).first()
    if not n:
        fs.delete(hadoop(stage), True)
        raise ValueError("there is nothing to write")
    fs.rename(hadoop(stage), hadoop(folder))
    out = fs.create(hadoop(f"{folder}/conversion.json"))
    out.write(bytearray(json.dumps({"files": n, "bytes": size}).encode()))
    out.close()
    return spark.read.parquet(f"{folder}/_report")
