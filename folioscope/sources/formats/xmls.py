"""XML formats with rows of their own: reports, archives, libraries, feeds, forms, books."""

from __future__ import annotations

import re
from collections.abc import Iterator

from ..files import Format
from .jsons import joined, masked, uri
from .xmltree import attr, every, inside, kid, kids, name, own, parse, root_is, rooted, said, space


def walk(e, depth: int = 0) -> Iterator[tuple]:
    yield e, depth
    for x in e:
        yield from walk(x, depth + 1)


def generic(data: bytes) -> Iterator[tuple]:
    """(element path, depth, attributes, own text) in document order, attributes by name."""

    def go(e, path, depth):
        here = f"{path}/{name(e)}"
        yield here, depth, joined((f'{k.rpartition("}")[2]}="{v}"' for k, v in sorted(e.attrib.items())), " "), " ".join((e.text or "").split())
        for x in e:
            yield from go(x, here, depth + 1)

    yield from go(parse(data), "", 0)


def junit(data: bytes) -> Iterator[tuple]:
    """A row for each suite and the total; a failure outweighs an error, that a skipped case."""
    total = [0, 0, 0, 0, 0.0]
    root = rooted(data, "testsuites", "testsuite")
    for s in [root] if name(root) == "testsuite" else list(every(root, "testsuite")):
        n = [0, 0, 0, 0]
        for c in kids(s, "testcase"):
            inner = {name(x) for x in c}
            n[next((k for k, w in ((1, "failure"), (2, "error"), (3, "skipped")) if w in inner), 0)] += 1
        time = float(attr(s, "time") or 0)
        total = [a + b for a, b in zip(total, [*n, time], strict=True)]
        yield attr(s, "name"), sum(n), n[0], n[1], f"{n[2]} / {n[3]}", time
    yield "(total)", sum(total[:4]), total[0], total[1], f"{total[2]} / {total[3]}", total[4]


def coverage(data: bytes) -> Iterator[tuple]:
    """Covered and missed by package, of JaCoCo's counters or Cobertura's lines."""
    root = rooted(data, "report", "coverage")
    for p in every(root, "package"):
        got = {}
        if name(root) == "report":
            for c in kids(p, "counter"):
                got[attr(c, "type")] = (int(attr(c, "covered")), int(attr(c, "missed")))
        else:
            lines = [x for c in every(p, "class") for x in every(kid(c, "lines"), "line")] if kid(p, "classes") is not None else []
            hit = sum(int(attr(x, "hits")) > 0 for x in lines)
            got["LINE"] = (hit, len(lines) - hit)
            branches = [tuple(map(int, m.groups())) for x in lines if (m := re.search(r"\((\d+)/(\d+)\)", attr(x, "condition-coverage") or ""))]
            got["BRANCH"] = (sum(a for a, _ in branches), sum(b - a for a, b in branches))
            methods = [any(int(attr(x, "hits")) > 0 for x in every(m, "line")) for m in every(p, "method")]
            got["METHOD"] = (sum(methods), len(methods) - sum(methods))
            classes = [any(int(attr(x, "hits")) > 0 for x in every(c, "line")) for c in every(p, "class")]
            got["CLASS"] = (sum(classes), len(classes) - sum(classes))
        pair = lambda k: "{} / {}".format(*got.get(k, (0, 0)))
        a, b = got.get("LINE", (0, 0))
        yield attr(p, "name"), sum(got.get("CLASS", (0, 0))), pair("LINE"), pair("BRANCH"), pair("METHOD"), f"{100 * a / (a + b):.1f}%" if a + b else "—"


def feed(data: bytes) -> Iterator[tuple]:
    root = rooted(data, "rss", "feed", "RDF")
    for n, i in enumerate(every(root, "item", "entry"), 1):
        signals = [k for k in ("enclosure", "category", "author", "content", "encoded") if kid(i, k) is not None]
        yield n, own(i, "title"), own(i, "pubDate") or own(i, "updated") or own(i, "published") or own(i, "date"), joined(signals)


def opml(data: bytes) -> Iterator[tuple]:
    def go(e, depth):
        for o in kids(e, "outline"):
            yield attr(o, "text") or attr(o, "title"), attr(o, "type"), depth, "feed" if attr(o, "xmlUrl") else "group" if len(o) else "item"
            yield from go(o, depth + 1)

    yield from go(kid(rooted(data, "opml"), "body"), 0)


def plist(data: bytes) -> Iterator[tuple]:
    def go(e, path):
        kind = name(e)
        if kind == "dict":
            yield path, kind, None, len(e) // 2
            keys = list(e)
            for k, v in zip(keys[::2], keys[1::2], strict=True):
                yield from go(v, f"{path}/{k.text}")
        elif kind == "array":
            yield path, kind, None, len(e)
            for i, v in enumerate(e):
                yield from go(v, f"{path}/{i}")
        else:
            yield path, kind, {"true": "true", "false": "false"}.get(kind, f"{len(said(e))} characters" if kind == "data" else said(e)), None

    yield from go(rooted(data, "plist")[0], "")


def marcxml(data: bytes) -> Iterator[tuple]:
    root = rooted(data, "collection", "record")
    for n, r in enumerate([root] if name(root) == "record" else every(root, "record"), 1):
        for f in r:
            if name(f) in ("leader", "controlfield"):
                yield n, attr(f, "tag") or "LDR", None, f.text
            else:
                for s in kids(f, "subfield"):
                    yield n, attr(f, "tag"), attr(s, "code"), uri(said(s))


def mods(data: bytes) -> Iterator[tuple]:
    root = rooted(data, "mods", "modsCollection")
    for n, m in enumerate([root] if name(root) == "mods" else kids(root, "mods"), 1):
        for e in m:
            yield n, name(e), attr(e, "type") or attr(e, "authority"), uri(said(e))


def mets(data: bytes) -> Iterator[tuple]:
    for e in every(rooted(data, "mets"), "metsHdr", "dmdSec", "amdSec", "fileGrp", "file", "structMap", "div"):
        mime = attr(e, "MIMETYPE") or attr(kid(e, "mdWrap"), "MDTYPE")
        yield name(e), attr(e, "ID") or attr(e, "USE") or attr(e, "TYPE") or attr(e, "LABEL"), mime or attr(e, "LABEL"), attr(e, "SIZE") or len(e)


def premis(data: bytes) -> Iterator[tuple]:
    for e in kids(rooted(data, "premis"), "object", "event", "agent", "rights"):
        for x in e.iter():
            if x is not e and not len(x) and said(x):
                yield name(e), attr(e, "type"), name(x), uri(said(x))


def ead(data: bytes) -> Iterator[tuple]:
    for e, depth in walk(rooted(data, "ead")):
        if name(e) == "archdesc" or re.fullmatch(r"c(0[1-9]|1[0-2])?", name(e)):
            yield name(e), attr(e, "level"), own(e, "did/unittitle"), own(e, "did/unitdate") or own(e, "did/unitid")


def eac(data: bytes) -> Iterator[tuple]:
    root = rooted(data, "eac-cpf", "eac")
    for e in every(root, "nameEntry"):
        yield "name", attr(e, "localType"), joined((said(p) for p in kids(e, "part")), " "), None
    for kind in ("entityType", "existDates", "place", "function", "occupation", "biogHist"):
        found = list(every(root, kind))
        if found:
            yield kind, None, len(found), said(found[0]) if kind in ("entityType", "existDates") else None
    for e in every(root, "cpfRelation", "resourceRelation"):
        yield name(e), attr(e, "cpfRelationType") or attr(e, "resourceRelationType"), own(e, "relationEntry"), None


def dublin(data: bytes) -> Iterator[tuple]:
    root = parse(data)
    holders = [e for e in root.iter() if any("purl.org/dc/" in space(x) for x in e)]
    for n, h in enumerate(holders, 1):
        for x in h:
            if "purl.org/dc/" in space(x):
                yield n, name(x), uri(said(x))


def alto(data: bytes) -> Iterator[tuple]:
    for n, p in enumerate(every(rooted(data, "alto"), "Page"), 1):
        yield "page", attr(p, "PHYSICAL_IMG_NR") or n, None, attr(p, "PC")
        for s in every(p, "TextLine"):
            words = list(every(s, "String"))
            sure = [float(attr(w, "WC")) for w in words if attr(w, "WC")]
            yield "line", attr(p, "PHYSICAL_IMG_NR") or n, joined((attr(w, "CONTENT") for w in words), " "), round(sum(sure) / len(sure), 4) if sure else None


def tei(data: bytes) -> Iterator[tuple]:
    for e, depth in walk(rooted(data, "TEI", "teiCorpus")):
        if name(e) in ("title", "author", "head", "p", "l", "note", "item"):
            yield name(e), depth, said(e), attr(e, "n")


def s1000d(data: bytes) -> Iterator[tuple]:
    for e, depth in walk(rooted(data, "dmodule", "pm", "ddn")):
        if name(e) in ("techName", "infoName", "title", "para", "proceduralStep", "warning", "caution", "note"):
            yield name(e), depth, said(e) if name(e) != "proceduralStep" else own(e, "para"), attr(e, "id")


def rdf(data: bytes) -> Iterator[tuple]:
    for s in rooted(data, "RDF"):
        subject = attr(s, "about") or attr(s, "ID") or attr(s, "nodeID")
        if name(s) != "Description":
            yield "type", name(s), subject
        for p in s:
            yield name(p), attr(p, "resource") or said(p), joined([subject, attr(p, "lang") or attr(p, "datatype")], " ")


def reqif(data: bytes) -> Iterator[tuple]:
    """Requirements by level with type and text, then relations between them."""
    root = rooted(data, "REQ-IF")
    types = {attr(t, "IDENTIFIER"): attr(t, "LONG-NAME") for t in root.iter() if name(t).endswith("-TYPE") and attr(t, "IDENTIFIER")}
    objects = {}
    for o in every(root, "SPEC-OBJECT"):
        values = [attr(v, "THE-VALUE") or said(kid(v, "THE-VALUE")) for v in inside(o, "VALUES")]
        objects[attr(o, "IDENTIFIER")] = (joined(values, "; ") or attr(o, "LONG-NAME"), types.get(said(kid(o, "TYPE"))))

    def go(e, level):
        for h in kids(e, "SPEC-HIERARCHY"):
            key = said(kid(h, "OBJECT"))
            yield level, key, *objects.get(key, (None, None))
            inner = kid(h, "CHILDREN")
            if inner is not None:
                yield from go(inner, level + 1)

    for s in every(root, "SPECIFICATION"):
        if kid(s, "CHILDREN") is not None:
            yield from go(kid(s, "CHILDREN"), 1)
    for r in every(root, "SPEC-RELATION"):
        yield "relation", attr(r, "IDENTIFIER"), joined([said(kid(r, "SOURCE")), said(kid(r, "TARGET"))], " -> "), types.get(said(kid(r, "TYPE")))


def spreadsheet(data: bytes) -> Iterator[tuple]:
    for sheet in every(rooted(data, "Workbook"), "Worksheet"):
        row = 0
        for r in every(sheet, "Row"):
            row = int(attr(r, "Index") or row + 1)
            column = 0
            for c in kids(r, "Cell"):
                column = int(attr(c, "Index") or column + 1)
                d = kid(c, "Data")
                yield attr(sheet, "Name"), letters(column) + str(row), attr(d, "Type"), said(d), attr(c, "Formula")
                column += int(attr(c, "MergeAcross") or 0)


def letters(n: int) -> str:
    out = ""
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def wsdl(data: bytes) -> Iterator[tuple]:
    for e in rooted(data, "definitions", "description"):
        if name(e) in ("message", "portType", "interface", "binding", "service", "types"):
            inner = [x for x in e if name(x) in ("part", "operation", "port", "endpoint", "schema")]
            yield name(e), attr(e, "name"), len(inner), joined(attr(x, "name") for x in inner)


def xbrl(data: bytes) -> Iterator[tuple]:
    """Facts with their context's period and unit; what is referred to and missing is said."""
    root = rooted(data, "xbrl")
    when, units = {}, {}
    for c in kids(root, "context"):
        p = kid(c, "period")
        when[attr(c, "id")] = joined([own(p, "startDate"), own(p, "endDate")], "..") or own(p, "instant") or "forever"
    for u in kids(root, "unit"):
        units[attr(u, "id")] = said(next(every(u, "measure"), None))
    for f in root:
        if ref := attr(f, "contextRef"):
            unit = attr(f, "unitRef")
            yield name(f), said(f), f"{when.get(ref, '[context omitted]')} / {units.get(unit, '[unit omitted]') if unit else '-'}"


def xfdf(data: bytes) -> Iterator[tuple]:
    """Fields by their path; values of sensitive names are masked."""
    hidden = ("password", "passcode", "secret", "token", "ssn", "socialsecurity", "bankaccount")  # fixed values

    def go(e, path):
        for f in kids(e, "field"):
            here = joined([path, attr(f, "name")], ".")
            mask = any(h in here.lower().replace("_", "").replace("-", "") for h in hidden)
            for v in kids(f, "value"):
                yield here, "field", "***" if mask else said(v), None
            yield from go(f, here)

    root = rooted(data, "xfdf")
    if kid(root, "fields") is not None:
        yield from go(kid(root, "fields"), "")
    for a in inside(root, "annots"):
        yield attr(a, "name"), "annotation", own(a, "contents"), joined([name(a), attr(a, "page")], " page ")


def xmi(data: bytes) -> Iterator[tuple]:
    for e, depth in walk(rooted(data, "XMI", "Model", "Package")):
        if attr(e, "id") or attr(e, "name"):
            yield depth, attr(e, "id"), attr(e, "type") or name(e), attr(e, "name")


def xliff(data: bytes) -> Iterator[tuple]:
    root = rooted(data, "xliff")
    for f in kids(root, "file"):
        for u in every(f, "trans-unit", "segment"):
            yield attr(f, "original") or attr(f, "id"), attr(u, "id"), own(u, "source"), own(u, "target"), attr(kid(u, "target"), "state") or attr(u, "state")


def ttml(data: bytes) -> Iterator[tuple]:
    def seconds(t):
        if not t:
            return None
        if m := re.fullmatch(r"([\d.]+)(h|m|s|ms)", t):
            return float(m[1]) * {"h": 3600, "m": 60, "s": 1, "ms": 0.001}[m[2]]
        return sum(float(x) * 60**k for k, x in enumerate(reversed(t.split(":")[:3])))

    for p in every(rooted(data, "tt"), "p"):
        begin, end = seconds(attr(p, "begin")), seconds(attr(p, "end"))
        if end is None and attr(p, "dur") and begin is not None:
            end = begin + seconds(attr(p, "dur"))
        yield begin, end, said(p)


def _book(heads: dict[str, int | None], paragraphs: tuple[str, ...], items: tuple[str, ...] = (), rows: tuple[str, ...] = ("row", "tr"), codes: tuple[str, ...] = ("programlisting", "codeblock", "code", "screen"), sections: tuple[str, ...] = (), skip: tuple[str, ...] = ()):
    """Blocks of a document: headings by element or by how many sections they are in, paragraphs, items, table rows, code."""

    def rows_of(data: bytes) -> Iterator[tuple]:
        def go(e, depth):
            n = name(e)
            if n in skip:
                return
            if n in heads:
                yield "heading", heads[n] or max(1, depth), said(e)
            elif n in codes:
                yield "code", 0, "".join(e.itertext()).strip("\n")
            elif n in rows:
                cells = [said(c) for c in e]
                yield "row", len(cells), "\t".join(c or "" for c in cells)
            elif n in items:
                yield "item", 1, said(e)
            elif n in paragraphs:
                if said(e):
                    yield "paragraph", 0, said(e)
            else:
                for x in e:
                    yield from go(x, depth + (n in sections))

        yield from go(parse(data), 0)

    return rows_of


def dmn(data: bytes) -> Iterator[tuple]:
    for e in every(rooted(data, "definitions"), "decision", "inputData", "businessKnowledgeModel", "knowledgeSource"):
        yield name(e), 1, attr(e, "name")
        for t in every(e, "decisionTable"):
            head = [own(i, "inputExpression/text") or attr(i, "label") for i in kids(t, "input")] + [attr(o, "name") or attr(o, "label") for o in kids(t, "output")]
            yield "row", len(head), "\t".join(h or "" for h in head)
            for r in kids(t, "rule"):
                cells = [own(c, "text") or "" for c in kids(r, "inputEntry", "outputEntry")]
                yield "row", len(cells), "\t".join(cells)
        for x in every(e, "literalExpression"):
            yield "expression", 1, own(x, "text")


def cyclonedx_xml(data: bytes) -> Iterator[tuple]:
    for c in every(rooted(data, "bom"), "component"):
        yield attr(c, "type"), joined([own(c, "group"), own(c, "name")], "/"), own(c, "version"), own(c, "scope")


def msproject(data: bytes) -> Iterator[tuple]:
    """Tasks with dates, share done, flags and links, 25 a page."""
    for n, t in enumerate(every(rooted(data, "Project"), "Task")):
        links = [own(x, "PredecessorUID") for x in kids(t, "PredecessorLink")]
        yield n // 25, own(t, "UID"), own(t, "Name"), own(t, "Start"), own(t, "Finish"), own(t, "PercentComplete"), own(t, "Summary") == "1", own(t, "Milestone") == "1", joined(links)


def bpmn(data: bytes) -> Iterator[tuple]:
    """Model elements that have a shape or an edge in the diagram, with its place."""
    root = parse(data)
    placed = {}
    for s in root.iter():
        key = attr(s, "bpmnElement") or attr(s, "cmmnElementRef")
        if key and name(s) in ("BPMNShape", "CMMNShape"):
            b = kid(s, "Bounds")
            placed[key] = tuple(attr(b, k) for k in ("x", "y", "width", "height"))
        elif key and name(s) in ("BPMNEdge", "CMMNEdge"):
            p = kids(s, "waypoint")
            placed[key] = (attr(p[0], "x"), attr(p[0], "y"), attr(p[-1], "x"), attr(p[-1], "y")) if p else (None,) * 4
    if not placed:
        raise ValueError("no diagram")
    for e in root.iter():
        if attr(e, "id") in placed and "/DI" not in space(e):
            yield attr(e, "id"), name(e), attr(e, "name"), attr(e, "sourceRef"), attr(e, "targetRef"), *placed[attr(e, "id")]


def flat_opc(data: bytes) -> Iterator[tuple]:
    for p in kids(rooted(data, "package"), "part"):
        body = kid(p, "xmlData")
        texts = [x.text for x in body.iter() if name(x) == "t" and x.text] if body is not None else []
        yield attr(p, "name"), attr(p, "contentType"), joined(texts, " ") or None


def visio(data: bytes) -> Iterator[tuple]:
    for n, p in enumerate(every(rooted(data, "VisioDocument"), "Page"), 1):
        for s in every(p, "Shape"):
            yield attr(p, "Name") or n, attr(s, "ID"), attr(s, "NameU") or attr(s, "Name"), own(s, "Text"), own(s, "XForm/PinX"), own(s, "XForm/PinY")


def drawio(data: bytes) -> Iterator[tuple]:
    """Cells of each page; a compressed page is inflated."""
    import base64
    import urllib.parse
    import zlib

    root = rooted(data, "mxfile", "mxGraphModel")
    pages = [root] if name(root) == "mxGraphModel" else kids(root, "diagram")
    for n, d in enumerate(pages, 1):
        if not len(d) and said(d):
            d = parse(urllib.parse.unquote(zlib.decompress(base64.b64decode(said(d)), -15).decode()).encode())
        for c in every(d, "mxCell"):
            g = kid(c, "mxGeometry")
            if attr(c, "vertex") == "1" or attr(c, "edge") == "1":
                label = " ".join(re.sub(r"<[^>]*>", " ", attr(c, "value") or "").split())
                yield n, attr(c, "id"), "edge" if attr(c, "edge") == "1" else "node", label, attr(c, "source"), attr(c, "target"), *(attr(g, k) for k in ("x", "y", "width", "height"))


def svg(data: bytes) -> Iterator[tuple]:
    for e, depth in walk(rooted(data, "svg")):
        if name(e) in ("path", "rect", "circle", "ellipse", "line", "polyline", "polygon", "text", "image", "use"):
            shape = attr(e, "d") or attr(e, "points") or joined((f"{k}={attr(e, k)}" for k in ("x", "y", "width", "height", "cx", "cy", "r", "rx", "ry", "x1", "y1", "x2", "y2") if attr(e, k)), " ")
            yield name(e), depth, shape, attr(e, "fill"), attr(e, "stroke"), said(e) if name(e) == "text" else None


def openscenario(data: bytes) -> Iterator[tuple]:
    root = rooted(data, "OpenSCENARIO")
    h = kid(root, "FileHeader")
    yield "FileHeader", joined([attr(h, "revMajor"), attr(h, "revMinor")], "."), 1, attr(h, "description")
    for k in ("ScenarioObject", "Story", "Act", "ManeuverGroup", "Maneuver", "Event", "Action", "Condition"):
        found = list(every(root, k))
        if found:
            yield k, joined(attr(x, "name") for x in found), len(found), None


BLOCK = ("kind", "level", "text")
SHAPE = ("id", "kind", "name", "source", "target", "x", "y", "width", "height")
FORMATS = {
    "xml": Format(("element", "depth", "attributes", "text"), generic, (".xml",)),
    "junit": Format(("suite", "tests", "pass", "fail", "error_skip", "time"), junit, (".junit.xml",), root_is("testsuites", "testsuite")),
    "coverage": Format(("package", "cls", "line_c_m", "br_c_m", "meth_c_m", "line_share"), coverage, (".cobertura.xml", ".jacoco.xml"), root_is("coverage", "report", having=b"package")),
    "feed": Format(("no", "title", "date", "signals"), feed, (".rss", ".atom"), root_is("rss", "feed")),
    "opml": Format(("outline", "type", "depth", "kind"), opml, (".opml",), root_is("opml")),
    "plist": Format(("path", "type", "value", "n"), plist, (".plist",), root_is("plist")),
    "marcxml": Format(("record", "tag", "code", "value"), marcxml, (".marcxml", ".marc.xml"), root_is("collection", "record", having=b"MARC21")),
    "mods": Format(("no", "kind", "type", "value"), mods, (".mods", ".mods.xml"), root_is("mods", "modsCollection")),
    "mets": Format(("kind", "name_type", "detail", "value"), mets, (".mets", ".mets.xml"), root_is("mets")),
    "premis": Format(("entity", "type", "detail", "value"), premis, (".premis", ".premis.xml"), root_is("premis")),
    "ead": Format(("kind", "level", "title", "detail"), ead, (".ead", ".ead.xml"), root_is("ead")),
    "eac-cpf": Format(("kind", "type", "name_count", "detail"), eac, (".eac", ".eac.xml"), root_is("eac-cpf", "eac")),
    "dublin-core": Format(("record", "element", "value"), dublin, (".dc", ".dc.xml"), lambda h: b"purl.org/dc/elements" in h and b"<oai" not in h and b"<rdf" not in h.lower()),
    "alto": Format(("kind", "page", "text", "confidence"), alto, (".alto", ".alto.xml"), root_is("alto")),
    "tei": Format(("kind", "depth", "text", "n"), tei, (".tei", ".tei.xml"), root_is("TEI", "teiCorpus")),
    "s1000d": Format(("kind", "depth", "text", "detail"), s1000d, (".s1000d.xml",), root_is("dmodule")),
    "rdf-xml": Format(("predicate", "value", "detail"), rdf, (".rdf",), root_is("RDF")),
    "reqif": Format(("lv", "identifier", "requirement", "type"), reqif, (".reqif",), root_is("REQ-IF")),
    "spreadsheetml": Format(("sheet", "cell", "type", "value", "formula"), spreadsheet, (".spreadsheetml",), root_is("Workbook", having=b"office:spreadsheet")),
    "wsdl": Format(("kind", "name", "n", "detail"), wsdl, (".wsdl",), root_is("definitions", "description", having=b"wsdl")),
    "xbrl": Format(("fact", "value", "context_unit"), xbrl, (".xbrl", ".xbrl.xml"), root_is("xbrl")),
    "xfdf": Format(("field", "kind", "value", "detail"), xfdf, (".xfdf",), root_is("xfdf")),
    "xmi": Format(("depth", "identifier", "type", "name"), xmi, (".xmi", ".uml"), root_is("XMI")),
    "xliff": Format(("file", "unit", "source", "target", "state"), xliff, (".xlf", ".xliff"), root_is("xliff")),
    "ttml": Format(("begin", "end", "text"), ttml, (".ttml", ".dfxp"), root_is("tt")),
    "docbook": Format(BLOCK, _book({"title": None}, ("para", "simpara", "abstract"), ("listitem",), sections=("article", "book", "chapter", "section", "sect1", "sect2", "sect3")), (".dbk", ".docbook"), root_is("article", "book", "chapter", having=b"docbook.org")),
    "dita": Format(BLOCK, _book({"title": None}, ("p", "shortdesc"), ("li",), ("row", "strow"), sections=("topic", "concept", "task", "reference", "section", "map")), (".dita", ".ditamap"), root_is("topic", "concept", "task", "reference", "map")),
    "jats": Format(BLOCK, _book({"title": None, "article-title": 1}, ("p", "abstract"), ("list-item", "ref"), sections=("body", "sec"), skip=("journal-meta",)), (".jats", ".nxml"), root_is("article", having=b"journal")),
    "fb2": Format(BLOCK, _book({"title": None, "book-title": 1}, ("p", "v", "subtitle", "text-author"), sections=("body", "section"), skip=("binary",)), (".fb2",), root_is("FictionBook")),
    "dmn": Format(BLOCK, dmn, (".dmn",), root_is("definitions", having=b"/DMN/")),
    "cyclonedx-xml": Format(("type", "name", "version", "scope"), cyclonedx_xml, (".cdx.xml", ".bom.xml"), root_is("bom", having=b"cyclonedx.org")),
    "projectxml": Format(("page", "uid", "task", "start", "finish", "done", "summary", "milestone", "after"), msproject, (".mspdi",), root_is("Project", having=b"schemas.microsoft.com/project")),
    "bpmn": Format(SHAPE, bpmn, (".bpmn",), root_is("definitions", having=b"BPMN")),
    "cmmn": Format(SHAPE, bpmn, (".cmmn",), root_is("definitions", having=b"CMMN")),
    "flat-opc": Format(("part", "type", "text"), flat_opc, (".flatopc",), root_is("package", having=b"xmlPackage")),
    "visio": Format(("page", "id", "name", "text", "x", "y"), visio, (".vdx",), root_is("VisioDocument")),
    "drawio": Format(("page", "id", "kind", "label", "source", "target", "x", "y", "width", "height"), drawio, (".drawio", ".dio"), root_is("mxfile", "mxGraphModel")),
    "svg": Format(("kind", "depth", "shape", "fill", "stroke", "text"), svg, (".svg",), root_is("svg")),
    "openscenario": Format(("kind", "name_revision", "n", "detail"), openscenario, (".xosc",), root_is("OpenSCENARIO")),
}
