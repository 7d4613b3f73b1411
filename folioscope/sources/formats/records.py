"""Record formats in plain text: alignments, sequence entries, bibliographies, archives, schemas."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

from ..files import Format, text
from .jsons import joined, masked, uri


def _aligned(lines: Iterator[str], start: str, comment: tuple[str, ...]) -> dict[str, str]:
    """Sequences by name, their fragments joined in order; all must get one length."""
    found: dict[str, str] = {}
    for line in lines:
        m = re.match(r"(\S+)\s+([A-Za-z.\-*~?]+)(?:\s+\d+)?\s*$", line)
        if m and not line.startswith(comment):
            found[m[1]] = found.get(m[1], "") + m[2]
    if len({len(s) for s in found.values()}) > 1:
        raise ValueError("aligned lengths differ")
    if not found:
        raise ValueError(f"no sequence in {start}")
    return found


def clustal(data: bytes) -> Iterator[tuple]:
    lines = text(data).splitlines()
    if not lines or not lines[0].upper().startswith("CLUSTAL"):
        raise ValueError("no CLUSTAL header")
    for k, s in _aligned(iter(lines[1:]), "CLUSTAL", (" ", "*")).items():
        yield k, len(s), s[:512]


def stockholm(data: bytes) -> Iterator[tuple]:
    parts = re.split(r"(?m)^# STOCKHOLM 1\.\d\s*$", text(data))
    if len(parts) < 2:
        raise ValueError("no Stockholm header")
    for n, part in enumerate(parts[1:], 1):
        body, end, _ = part.partition("\n//")
        if not end:
            raise ValueError("an alignment doesn't end")
        for k, s in _aligned(iter(body.splitlines()), "Stockholm", ("#",)).items():
            yield n, k, len(s), s[:512]


def maf(data: bytes) -> Iterator[tuple]:
    block, score = 0, None
    for line in text(data).splitlines():
        f = line.split()
        if f[:1] == ["a"]:
            block, score = block + 1, next((x[6:] for x in f if x.startswith("score=")), None)
        elif f[:1] == ["s"]:
            if len(f) != 7 or f[4] not in "+-" or len(f[6].replace("-", "")) != int(f[3]):
                raise ValueError(f"sequence line of block {block}")
            yield block, f[1], int(f[2]), int(f[3]), f[4], int(f[5]), score, f[6]


def _entries(data: bytes) -> list[list[str]]:
    out = [p.splitlines() for p in re.split(r"(?m)^//\s*$", text(data))]
    if out and any(x.strip() for x in out[-1]):
        raise ValueError("an entry doesn't end with //")
    return [[x for x in p if x.strip()] for p in out[:-1]]


def genbank(data: bytes) -> Iterator[tuple]:
    for n, lines in enumerate(_entries(data), 1):
        top: dict[str, str] = {}
        key, sequence, features = "", [], 0
        for line in lines:
            if m := re.match(r"([A-Z]+)\s*(.*)", line):
                key = m[1]
                top.setdefault(key, m[2].strip())
            elif key == "ORIGIN":
                sequence.append(re.sub(r"[\s\d]", "", line))
            elif key == "FEATURES":
                features += bool(re.match(r" {5}\S", line))
            elif line.startswith(" " * 12):
                top[key] += " " + line.strip()
        m = re.match(r"(\S+)\s+(\d+) (?:bp|aa)\s*(\S+)?\s*(linear|circular)?", top.get("LOCUS", ""))
        if not m:
            raise ValueError("LOCUS line")
        whole = "".join(sequence)
        yield n, m[1], int(m[2]), m[3], m[4], top.get("ACCESSION", "").split(" ")[0], top.get("DEFINITION"), features, len(whole), whole[:60]


def _coded(lines: list[str]) -> tuple[dict[str, list[str]], str]:
    """Lines by their two letters, and the sequence after SQ."""
    top: dict[str, list[str]] = {}
    sequence = []
    for line in lines:
        if line.startswith("  ") and "SQ" in top:
            sequence.append(re.sub(r"[\s\d]", "", line))
        else:
            top.setdefault(line[:2], []).append(line[5:])
    return top, "".join(sequence)


def embl(data: bytes) -> Iterator[tuple]:
    for n, lines in enumerate(_entries(data), 1):
        top, whole = _coded(lines)
        f = [x.strip() for x in top["ID"][0].rstrip(".").split(";")]
        length = re.search(r"(\d+) BP", top["ID"][0])
        features = sum(bool(re.match(r"\S", x)) for x in top.get("FT", []))
        yield n, f[0], int(length[1]) if length else None, f[3] if len(f) > 3 else None, f[2] if len(f) > 2 else None, " ".join(top.get("AC", [])).split(";")[0].strip(), " ".join(top.get("DE", [])), features, len(whole), whole[:60]


def uniprot(data: bytes) -> Iterator[tuple]:
    for n, lines in enumerate(_entries(data), 1):
        top, whole = _coded(lines)
        m = re.match(r"(\S+)\s+(Reviewed|Unreviewed);\s*(\d+) AA", top["ID"][0])
        if not m:
            raise ValueError("ID line")
        full = re.search(r"(?:RecName|SubName): Full=([^;{]+)", " ".join(top.get("DE", [])))
        gene = re.search(r"Name=([^;{]+)", " ".join(top.get("GN", [])))
        features = sum(bool(re.match(r"[A-Z]", x)) for x in top.get("FT", []))
        yield n, m[1], m[2], " ".join(top.get("AC", [])).split(";")[0], full and full[1].strip(), gene and gene[1].strip(), " ".join(top.get("OS", [])).rstrip("."), int(m[3]), features, len(whole), whole[:60]


def ris(data: bytes) -> Iterator[tuple]:
    n, tags = 0, {}
    for line in text(data).splitlines():
        m = re.match(r"([A-Z][A-Z0-9])  -\s?(.*)", line)
        if not m:
            continue
        if m[1] == "ER":
            n += 1
            get = lambda *k: joined((x for t in k for x in tags.get(t, [])[:1]), "")
            pages = joined([get("SP"), get("EP")], "-")
            yield n, get("TY"), get("TI") or get("T1"), "; ".join(tags.get("AU", []) + tags.get("A1", [])), (get("PY") or get("Y1"))[:4], get("JO") or get("T2"), pages, get("DO"), uri(get("UR")), "; ".join(tags.get("KW", [])), get("AB") or get("N2")
            tags = {}
        else:
            tags.setdefault(m[1], []).append(m[2].strip())
    if tags:
        raise ValueError("a record doesn't end")


def bibtex(data: bytes) -> Iterator[tuple]:
    s, at = text(data), 0
    while m := re.compile(r"@(\w+)\s*[{(]\s*").search(s, at):
        depth, end = 1, m.end()
        while depth and end < len(s):
            depth += (s[end] in "{(") - (s[end] in "})")
            end += 1
        if depth:
            raise ValueError("an entry doesn't end")
        at, body, kind = end, s[m.end() : end - 1], m[1].lower()
        if kind in ("comment", "preamble", "string"):
            continue
        key, _, rest = body.partition(",")
        fields = {}
        for f in re.finditer(r"(\w[\w-]*)\s*=\s*(?:\{((?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*)\}|\"([^\"]*)\"|([^,\s]+))", rest):
            fields[f[1].lower()] = " ".join(re.sub(r"[{}]", "", f[2] or f[3] or f[4] or "").split())
        yield kind, key.strip(), fields.get("title"), fields.get("author") or fields.get("editor"), fields.get("year") or fields.get("date"), fields.get("journal") or fields.get("booktitle") or fields.get("publisher")


def warc(data: bytes) -> Iterator[tuple]:
    at = 0
    while at < len(data):
        if data[at : at + 5] != b"WARC/":
            if not data[at:].strip():
                return
            raise ValueError(f"no record at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        head = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]))
        size = int(head["content-length"])
        body = data[end + 4 : end + 4 + size]
        if len(body) < size:
            raise ValueError("a record is cut off")
        status = re.match(rb"HTTP/\d(?:\.\d)? (\d{3})", body)
        mime = re.search(rb"(?im)^content-type:\s*([^;\r\n]+)", body.split(b"\r\n\r\n")[0]) if status else None
        yield head.get("warc-type"), masked(head["warc-target-uri"]) if "warc-target-uri" in head else None, status and status[1].decode(), (mime[1].decode().strip() if mime else head.get("content-type")), head.get("warc-date"), size
        at = end + 4 + size
        while data[at : at + 2] == b"\r\n":
            at += 2


def turtle(data: bytes) -> Iterator[tuple]:
    """Statements of Turtle, N-Triples and N-Quads; prefixes stay as they are written."""
    token = re.compile(r"""\s+|\#[^\n]*|(<[^>\s]*>)|("{3}(?:[^"\\]|\\.|"(?!""))*"{3}|"(?:[^"\\\n]|\\.)*")((?:@[\w-]+|\^\^(?:<[^>]*>|[\w.-]*:[\w.-]*))?)|(@prefix|@base|(?i:prefix|base)(?=\s))|([\[\]();,.])(?=[\s\]);,.#]|$)|([^\s"<>\[\]();,]*[^\s"<>\[\]();,.])|([\[\](){};,.])""")
    s, at, tokens = text(data), 0, []
    while at < len(s):
        m = token.match(s, at)
        if not m or m.end() == at:
            raise ValueError(f"character {s[at]!r}")
        at = m.end()
        if m[1]:
            tokens.append(m[1])
        elif m[2]:
            body = m[2][3:-3] if m[2].startswith('"""') else m[2][1:-1]
            tokens.append('"' + body + '"' + (m[3] or ""))
        elif m[4] or m[5] or m[6] or m[7]:
            tokens.append(m[4] or m[5] or m[6] or m[7])
    i, blank = 0, 0

    def node() -> tuple[str, list[tuple]]:
        nonlocal i, blank
        t = tokens[i]
        i += 1
        if t == "[":
            blank, me = blank + 1, f"_:b{blank + 1}"
            inner = predicates(me) if tokens[i] != "]" else []
            i += 1
            return me, inner
        if t == "(":
            items, inner = [], []
            while tokens[i] != ")":
                x, more = node()
                items.append(x)
                inner += more
            i += 1
            return "(" + " ".join(items) + ")", inner
        return t, []

    def predicates(subject: str) -> list[tuple]:
        nonlocal i
        out = []
        while tokens[i] not in (".", "]"):
            verb, i = "rdf:type" if tokens[i] == "a" else tokens[i], i + 1
            while True:
                value, more = node()
                out += [(subject, verb, value), *more]
                if tokens[i] != ",":
                    break
                i += 1
            if tokens[i] not in (";", ".", "]"):
                i += 1  # the graph of a quad
            while tokens[i] == ";":
                i += 1
        return out

    while i < len(tokens):
        if tokens[i].lower() in ("@prefix", "@base", "prefix", "base"):
            i += 3 if "prefix" in tokens[i].lower() else 2
            i += i < len(tokens) and tokens[i] == "."
            continue
        subject, inner = node()
        yield from inner
        yield from predicates(subject)
        i += 1


def protobuf(data: bytes) -> Iterator[tuple]:
    s = re.sub(r"//[^\n]*|/\*.*?\*/", "", text(data), flags=re.S)
    stack: list[str] = []
    for m in re.finditer(r"\b(package|import|syntax)\s*=?\s*(?:public |weak )?([^;]+);|\b(message|enum|service|oneof|extend)\s+([\w.]+)\s*\{|\brpc\s+(\w+)\s*\(([^)]*)\)\s*returns\s*\(([^)]*)\)\s*(?:;|\{[^}]*\})|((?:optional|required|repeated)\s+)?(map\s*<[^>]*>|[\w.]+)\s+(\w+)\s*=\s*(\d+)\s*(\[[^\]]*\])?\s*;|(\w+)\s*=\s*(-?\d+)\s*(\[[^\]]*\])?\s*;|(\})", s):
        here = ".".join(stack) or None
        if m[1]:
            yield None, m[1], m[2].strip().strip('"'), None, None
        elif m[3]:
            yield here, m[3], m[4], None, None
            stack.append(m[4])
        elif m[5]:
            yield here, "rpc", m[5], f"{m[6].strip()} -> {m[7].strip()}", None
        elif m[10]:
            yield here, "field", m[10], (m[8] or "") + re.sub(r"\s", "", m[9]), joined([m[11], m[12]], " ")
        elif m[13] and stack:
            yield here, "value", m[13], None, joined([m[14], m[15]], " ")
        elif m[16] and stack:
            stack.pop()


def graphql(data: bytes) -> Iterator[tuple]:
    s = re.sub(r'"""(?:[^"]|"(?!""))*"""|"(?:[^"\\\n]|\\.)*"|#[^\n]*', "", text(data))
    for m in re.finditer(r"\b(?:extend\s+)?(type|interface|input|enum|union|scalar|directive)\s+@?(\w+)([^{}=]*?)(?:\{([^}]*)\}|=\s*([^\n]*(?:\n\s*\|[^\n]*)*)|(?=\n|$))", s):
        kind, name, body = m[1], m[2], m[4]
        if kind == "union":
            yield name, kind, None, " | ".join(re.findall(r"\w+", m[5] or ""))
        elif kind == "enum":
            for v in re.findall(r"\w+", re.sub(r"@\w+(\([^)]*\))?", "", body or "")):
                yield name, kind, v, None
        elif body is None:
            yield name, kind, None, " ".join((m[3] or "").split()) or None
        else:
            for f in re.finditer(r"(\w+)\s*(\([^)]*\))?\s*:\s*([\[\]!\w]+)", body):
                yield name, kind, f[1], " ".join(((f[2] or "") + ": " + f[3]).split()).removeprefix(": ")


def spice(data: bytes) -> Iterator[tuple]:
    """Elements of a netlist; the first line is its title, + continues a line."""
    kinds = {"R": "resistor", "C": "capacitor", "L": "inductor", "D": "diode", "Q": "bipolar transistor", "M": "MOSFET", "J": "JFET", "V": "voltage source", "I": "current source", "X": "subcircuit", "E": "VCVS", "F": "CCCS", "G": "VCCS", "H": "CCVS", "K": "coupling", "S": "switch", "T": "line", "B": "behavioural source"}
    nodes = {"Q": 3, "M": 4, "J": 3, "E": 4, "G": 4, "S": 4, "T": 4}
    lines: list[tuple[int, str]] = []
    for n, line in enumerate(text(data).splitlines(), 1):
        line = re.split(r"[;$]", line)[0].rstrip()
        if line.startswith("+") and lines:
            lines[-1] = (lines[-1][0], lines[-1][1] + " " + line[1:].strip())
        elif n > 1 and line.strip() and not line.startswith("*"):
            lines.append((n, line.strip()))
    for n, line in lines:
        f = line.split()
        kind = f[0][0].upper()
        if line.startswith("."):
            yield f[0], "directive", None, " ".join(f[1:]), n
        elif kind in kinds:
            k = len(f) - 2 if kind == "X" else nodes.get(kind, 2)
            yield f[0], kinds[kind], " ".join(f[1 : 1 + k]), " ".join(f[1 + k :]), n
        else:
            raise ValueError(f"element {f[0]} of line {n}")


def idf(data: bytes) -> Iterator[tuple]:
    s = re.sub(r"![^\n]*", "", text(data))
    objects = [[f.strip() for f in o.split(",")] for o in s.split(";") if o.strip()]
    for kind, n in sorted(Counter(o[0] for o in objects).items()):
        yield kind, n, f"{max(len(o) - 1 for o in objects if o[0] == kind)} fields at most"


def epw(data: bytes) -> Iterator[tuple]:
    lines = text(data).splitlines()
    head = lines[0].split(",")
    if head[0] != "LOCATION":
        raise ValueError("no LOCATION")
    yield "Location", joined(head[1:4]), f"latitude {head[6]}, longitude {head[7]}, elevation {head[9]}"
    years = Counter(x.split(",")[0] for x in lines[8:] if x.strip())
    yield "Records", sum(years.values()), f"{len(years)} years"
    for y, n in sorted(years.items()):
        yield "Year", y, n


def fds(data: bytes) -> Iterator[tuple]:
    found: dict[str, list[str]] = {}
    for m in re.finditer(r"&([A-Z]{4})\b((?:[^/'\"]|'[^']*'|\"[^\"]*\")*)/", text(data)):
        found.setdefault(m[1], []).append(m[2])
    for kind in sorted(found):
        ids = [m[1] for b in found[kind] if (m := re.search(r"\bID\s*=\s*'([^']*)'", b))]
        yield kind, len(found[kind]), joined(ids)


def rinex(data: bytes) -> Iterator[tuple]:
    lines = text(data).splitlines()
    if "RINEX VERSION" not in lines[0]:
        raise ValueError("no RINEX header")
    end = next(i for i, x in enumerate(lines) if "END OF HEADER" in x)
    yield "Version", lines[0][:9].strip(), lines[0][20:40].strip()
    for label, kind in (("MARKER NAME", "Marker"), ("REC # / TYPE", "Receiver"), ("ANT # / TYPE", "Antenna"), ("INTERVAL", "Interval"), ("TIME OF FIRST OBS", "First observation")):
        for x in lines[:end]:
            if x[60:].strip().startswith(label):
                yield kind, " ".join(x[:60].split()), None
    yield "Epochs", sum(bool(re.match(r">|\s\d\d [ \d]\d [ \d]\d [ \d]\d [ \d]\d", x)) for x in lines[end + 1 :]), None


def openscad(data: bytes) -> Iterator[tuple]:
    s = re.sub(r"//[^\n]*|/\*.*?\*/", "", text(data), flags=re.S)
    for m in re.finditer(r"\b(module|function)\s+(\w+)\s*\(([^)]*)\)", s):
        yield m[1], m[2], m[3].strip() or None
    for m in re.finditer(r"\b(use|include)\s*<([^>]*)>", s):
        yield m[1], m[2], None
    for k, n in sorted(Counter(re.findall(r"\b(cube|sphere|cylinder|polyhedron|square|circle|polygon|text|linear_extrude|rotate_extrude|union|difference|intersection|hull|minkowski|translate|rotate|scale|mirror|for|if)\s*\(", s)).items()):
        yield "call", k, n


def opencrg(data: bytes) -> Iterator[tuple]:
    section, found = None, {}
    for line in text(data).splitlines():
        if line.startswith("$$$$"):
            break
        if line.startswith("$") and len(line.strip()) > 1:
            section = line.strip("$ ").split("!")[0].strip()
            found[section] = []
        elif line.strip() == "$":
            section = None
        elif section and line.strip() and not line.startswith("*"):
            found[section].append(line.split("!")[0].strip())
    if not found:
        raise ValueError("no section")
    for k, v in found.items():
        yield k, len(v), joined(v, "; ")


def lcov(data: bytes) -> Iterator[tuple]:
    """Files with lines, functions, branches covered and missed; stated sums outrank single lines."""
    total = [0] * 6

    def row(name, n):
        pair = lambda a, b: f"{a} / {b - a}"
        return name, pair(n[0], n[1]), pair(n[2], n[3]), pair(n[4], n[5]), f"{100 * n[0] / n[1]:.1f}%" if n[1] else "—"

    name, stated, lines = None, {}, {}
    for line in text(data).splitlines():
        key, _, v = line.strip().partition(":")
        if key == "SF":
            name, stated, lines = re.split(r"[/\\]", v)[-1], {}, {}
        elif key in ("LH", "LF", "FNH", "FNF", "BRH", "BRF"):
            stated[key] = int(v)
        elif key == "DA":
            at, hits = v.split(",")[:2]
            lines[at] = lines.get(at, 0) + int(hits)
        elif key == "end_of_record":
            if name is None:
                raise ValueError("a record without SF")
            hit, found = (stated.get("LH", 0), stated["LF"]) if "LF" in stated else (sum(h > 0 for h in lines.values()), len(lines))
            n = [hit, found, *(stated.get(k, 0) for k in ("FNH", "FNF", "BRH", "BRF"))]
            total = [a + b for a, b in zip(total, n, strict=True)]
            yield row(name, n)
            name = None
    yield row("(total)", total)


def sat(data: bytes) -> Iterator[tuple]:
    s = text(data)
    body = s.split("\n", 3)[-1]
    names = Counter(m[1] for m in re.finditer(r"(?m)^(?:-\d+\s+)?([a-z][\w-]*)\s+[^#]*#", body))
    if not names:
        raise ValueError("no entity")
    for k, n in sorted(names.items()):
        yield k, n, None


SEQUENCE = ("record", "id", "declared_length", "molecule", "topology", "accession", "description", "features", "sequence_length", "sq_preview")
COUNT = ("kind", "value", "detail")
FORMATS = {
    "clustal": Format(("sequence", "aligned_length", "preview"), clustal, (".aln", ".clustal"), lambda h: h.startswith(b"CLUSTAL")),
    "stockholm": Format(("alignment", "sequence", "aligned_length", "preview"), stockholm, (".sto", ".stk", ".stockholm"), lambda h: h.startswith(b"# STOCKHOLM")),
    "maf": Format(("block", "source", "start", "size", "strand", "source_size", "score", "sequence"), maf, (".maf",), lambda h: h.startswith(b"##maf")),
    "genbank": Format(("record", "locus", "length", "molecule", "topology", "accession", "definition", "features", "sequence_length", "origin_preview"), genbank, (".gb", ".gbk", ".genbank"), lambda h: h.startswith(b"LOCUS ")),
    "embl": Format(SEQUENCE, embl, (".embl",)),
    "uniprot": Format(("record", "entry", "review", "accession", "protein_name", "gene", "organism", "declared_length", "features", "sequence_length", "sq_preview"), uniprot, (".uniprot", ".swiss"), lambda h: bool(re.match(rb"ID   \S+\s+(Reviewed|Unreviewed);", h))),
    "ris": Format(("record", "type", "title", "authors", "year", "journal", "pages", "doi", "url", "keywords", "abstract"), ris, (".ris",), lambda h: h.startswith(b"TY  - ")),
    "bib": Format(("type", "key", "title", "author", "year", "published_in"), bibtex, (".bib", ".bibtex")),
    "warc": Format(("type", "target_uri", "http_status", "mime", "date", "length"), warc, (".warc",), lambda h: h.startswith(b"WARC/")),
    "turtle": Format(("subject", "predicate", "object"), turtle, (".ttl", ".nt", ".nq")),
    "protobuf": Format(("container", "kind", "name", "type_rpc", "number_options"), protobuf, (".proto",)),
    "graphql": Format(("type", "kind", "field", "signature"), graphql, (".graphql", ".graphqls", ".gql")),
    "spice": Format(("element", "type", "nodes", "value_model", "source_line"), spice, (".cir", ".spice", ".sp", ".net")),
    "energyplus-idf": Format(("object", "count", "detail"), idf, (".idf",)),
    "energyplus-epw": Format(COUNT, epw, (".epw",), lambda h: h.startswith(b"LOCATION,")),
    "fds": Format(("block", "count", "detail"), fds, (".fds",)),
    "rinex": Format(COUNT, rinex, (".rnx", ".obs"), lambda h: b"RINEX VERSION" in h[:81]),
    "openscad": Format(COUNT, openscad, (".scad",)),
    "opencrg": Format(("section", "lines", "content"), opencrg, (".crg",), lambda h: h.startswith(b"$CT")),
    "lcov": Format(("file", "lines_c_m", "funcs_c_m", "br_c_m", "line_share"), lcov, (".info", ".lcov"), lambda h: h.startswith((b"TN:", b"SF:"))),
    "sat": Format(("entity", "count", "detail"), sat, (".sat",)),
}
