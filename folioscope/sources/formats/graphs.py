"""Graphs and diagrams in text and XML: nodes and edges, trees with lengths."""

from __future__ import annotations

import re
from collections.abc import Iterator

from ..files import Format, text
from .xmltree import attr, every, kids, name, own, root_is, rooted, said


class Graph:
    """Nodes by id in order, edges in order; nodes that edges name are there too."""

    def __init__(self):
        self.nodes: dict[str, str | None] = {}
        self.edges: list[tuple] = []

    def node(self, key: str, label: str | None = None) -> str:
        if label is not None or key not in self.nodes:
            self.nodes[key] = label
        return key

    def edge(self, a: str, b: str, label: str | None = None, kind: str = "directed") -> None:
        self.node(a)
        self.node(b)
        self.edges.append((a, b, label, kind))

    def rows(self) -> Iterator[tuple]:
        for k, v in self.nodes.items():
            yield "node", k, k if v is None else v, None, None
        for a, b, label, kind in self.edges:
            yield "edge", kind, label, a, b


def dot(data: bytes) -> Iterator[tuple]:
    s = re.sub(r"//[^\n]*|/\*.*?\*/|(?m:^\s*#[^\n]*)", "", text(data), flags=re.S)
    m = re.search(r"\b(strict\s+)?(di)?graph\b[^{]*\{(.*)\}", s, re.S | re.I)
    if not m:
        raise ValueError("no graph")
    g, word = Graph(), r'"(?:[^"\\]|\\.)*"|[\w.\x80-\U0010ffff]+|-?\d+(?:\.\d+)?'
    plain = lambda t: re.sub(r"\\(.)", lambda e: " " if e[1] in "nlr" else e[1], t[1:-1]) if t.startswith('"') else t
    body = re.sub(r"\bsubgraph\b\s*(?:\"[^\"]*\"|\w+)?", "", m[3])
    for part in re.finditer(rf"({word})((?::\w+)*\s*(?:->|--)\s*(?:{word}))*[^\[\];{{}}\n]*(\[(?:[^\]\"]|\"(?:[^\"\\]|\\.)*\")*\])?", body):
        whole, attributes = part[0], part[3] or ""
        chain = re.findall(rf"({word})(?::\w+)*", whole[: len(whole) - len(attributes)])
        if chain[0] in ("graph", "node", "edge") or re.match(rf"\s*(?:{word})\s*=", whole):
            continue
        label = re.search(r'\blabel\s*=\s*("(?:[^"\\]|\\.)*"|[\w.]+)', attributes)
        label = plain(label[1]) if label else None
        ids = [plain(t) for t in chain]
        if len(ids) == 1:
            g.node(ids[0], label)
        for a, b in zip(ids, ids[1:], strict=False):
            g.edge(a, b, label, "directed" if m[2] else "undirected")
    yield from g.rows()


def mermaid(data: bytes) -> Iterator[tuple]:
    """Flow charts, and messages of sequence diagrams."""
    lines = [re.sub(r"%%.*", "", x).strip() for x in text(data).splitlines()]
    lines = [x for x in lines if x]
    g = Graph()
    if lines and lines[0].startswith("sequenceDiagram"):
        for x in lines[1:]:
            if m := re.match(r"(?:participant|actor)\s+(\S+)(?:\s+as\s+(.*))?", x):
                g.node(m[1], m[2])
            elif m := re.match(r"(\S+?)\s*(-{1,2}>>?|-{1,2}x|-{1,2}\))\s*[+-]?(\S+?)\s*:\s*(.*)", x):
                g.edge(m[1], m[3], m[4], "dashed" if m[2].startswith("--") else "directed")
        yield from g.rows()
        return
    if not lines or not re.match(r"(graph|flowchart)\b", lines[0]):
        raise ValueError("no flow chart or sequence diagram")
    shape = re.compile(r"\s*([\w-]*\w)\s*(?:(\(\(|\[\[|\[\(|\(\[|\{\{|\[/|\(|\[|\{|>)\s*\"?(.*?)\"?\s*(\)\)|\]\]|\)\]|\]\)|\}\}|/\]|\)|\]|\}))?(?::::\w+)?\s*")
    arrow = re.compile(r"\s*(?:(--|-\.|==)\s*([^->|=][^|]*?)\s*(-->|---|\.->|==>)|(<?-{2,3}>?|-\.->|-\.-|={2,3}>?|--[xo])(?:\|([^|]*)\|)?)")
    for x in (p for line in lines[1:] for p in line.split(";")):
        if re.match(r"(subgraph|end\b|classDef|class\b|style|click|direction|linkStyle)", x):
            continue
        at, left, label, kind = 0, None, None, None
        while m := shape.match(x, at):
            here = [g.node(m[1], m[3])]
            at = m.end()
            while x[at : at + 1] == "&" and (n := shape.match(x, at + 1)):
                here.append(g.node(n[1], n[3]))
                at = n.end()
            for a in left or ():
                for b in here:
                    g.edge(a, b, label, kind)
            n = arrow.match(x, at)
            if not n:
                break
            sign = n[3] or n[4]
            label, kind, left, at = (n[2] or n[5] or "").strip().strip('"') or None, "directed" if ">" in sign else "undirected", here, n.end()
    yield from g.rows()


def d2(data: bytes) -> Iterator[tuple]:
    g = Graph()
    for x in text(data).splitlines():
        x = re.sub(r"(?<!\S)#.*", "", x).strip().rstrip("{").strip()
        parts = re.split(r"\s*(<->|->|<-|--)\s*", x.split(":")[0])
        label = x.partition(":")[2].strip().strip('"') or None
        if len(parts) > 1:
            for a, sign, b in zip(parts[::2], parts[1::2], parts[2::2], strict=False):
                a, b = (b, a) if sign == "<-" else (a, b)
                g.edge(a.strip('" '), b.strip('" '), label, "undirected" if sign == "--" else "both" if sign == "<->" else "directed")
        elif x and x != "}" and not re.match(r"(shape|style|direction|label|icon|near|width|height|tooltip|link|vars|classes|class)\b", x):
            g.node(parts[0].strip('" '), label)
    yield from g.rows()


def plantuml(data: bytes) -> Iterator[tuple]:
    s = text(data)
    if "@startuml" not in s:
        raise ValueError("no @startuml")
    g, word = Graph(), r'("[^"]+"|\[[^\]]+\]|\([^)]+\)|:[^:]+:|[\w.]+)'
    for x in s[s.index("@startuml") :].splitlines()[1:]:
        x = x.strip()
        if m := re.match(rf"(?:abstract\s+class|participant|actor|class|interface|enum|component|database|node|entity|state|usecase|object|boundary|control|queue)\s+{word}(?:\s+as\s+{word})?", x):
            key = (m[2] or m[1]).strip('"[]():')
            g.node(key, m[1].strip('"[]():'))
        elif m := re.match(rf'{word}\s*(?:"[^"]*"\s*)?([<*o|x+#^]*[-.]+(?:\[[^\]]*\])?(?:left|right|up|down|[lrud])?[-.]*[>*o|x+#^]*)\s*(?:"[^"]*"\s*)?{word}\s*(?::\s*(.*))?$', x):
            a, b = (m[i].strip('"[]():') for i in (1, 3))
            back = m[2].startswith("<") and not m[2].endswith(">")
            g.edge(*((b, a) if back else (a, b)), m[4], "dashed" if "." in m[2] else "directed")
    yield from g.rows()


def graphml(data: bytes) -> Iterator[tuple]:
    root = rooted(data, "graphml")
    names = {attr(k, "id"): attr(k, "attr.name") for k in kids(root, "key")}
    g = Graph()
    for n in every(root, "node"):
        values = {names.get(attr(d, "key"), attr(d, "key")): said(d) for d in kids(n, "data")}
        g.node(attr(n, "id"), values.get("label") or values.get("name"))
    directed = {attr(x, "edgedefault") for x in every(root, "graph")}
    for e in every(root, "edge"):
        kind = {"true": "directed", "false": "undirected"}.get(attr(e, "directed"), next(iter(directed)) or "directed")
        g.edge(attr(e, "source"), attr(e, "target"), next((said(d) for d in kids(e, "data") if names.get(attr(d, "key")) in ("label", "name", "weight")), None), kind)
    yield from g.rows()


def gexf(data: bytes) -> Iterator[tuple]:
    root, g = rooted(data, "gexf"), Graph()
    default = next((attr(x, "defaultedgetype") for x in every(root, "graph")), None) or "undirected"
    for n in every(root, "node"):
        g.node(attr(n, "id"), attr(n, "label"))
    for e in every(root, "edge"):
        g.edge(attr(e, "source"), attr(e, "target"), attr(e, "label"), attr(e, "type") or default)
    yield from g.rows()


def xgmml(data: bytes) -> Iterator[tuple]:
    root, g = rooted(data, "graph"), Graph()
    for n in every(root, "node"):
        g.node(attr(n, "id"), attr(n, "label"))
    for e in every(root, "edge"):
        g.edge(attr(e, "source"), attr(e, "target"), attr(e, "label"), "directed" if attr(root, "directed") == "1" else "undirected")
    yield from g.rows()


def gml_graph(data: bytes) -> Iterator[tuple]:
    """Lists of keys and values in brackets."""
    tokens = re.findall(r'"[^"]*"|[\[\]]|[^\s\[\]"]+', re.sub(r"(?m)^\s*#[^\n]*", "", text(data)))

    def block(i):
        out = []
        while i < len(tokens) and tokens[i] != "]":
            if tokens[i + 1] == "[":
                value, i2 = block(i + 2)
            else:
                value, i2 = tokens[i + 1].strip('"'), i + 2
            out.append((tokens[i].lower(), value))
            i = i2
        return out, i + 1

    top = dict(block(0)[0])
    if not isinstance(top.get("graph"), list):
        raise ValueError("no graph")
    g, kind = Graph(), "directed" if ("directed", "1") in top["graph"] else "undirected"
    for k, v in top["graph"]:
        if k == "node":
            g.node(dict(v)["id"], dict(v).get("label"))
    for k, v in top["graph"]:
        if k == "edge":
            g.edge(dict(v)["source"], dict(v)["target"], dict(v).get("label"), kind)
    yield from g.rows()


def _tree(s: str) -> Iterator[tuple]:
    """(node, parent, name, length, depth) of a tree in brackets, in the order in which it is written."""
    s = re.sub(r"\[[^\]]*\]", "", s).strip()
    rows: list[list] = []
    stack: list[int] = []
    last = None
    for m in re.finditer(r"[(),;]|:\s*([-+\d.eE]+)|'((?:[^']|'')*)'|([^\s(),:;']+)", s):
        t = m[0]
        if t == "(":
            rows.append([len(rows), stack[-1] if stack else None, None, None, len(stack)])
            stack.append(len(rows) - 1)
            last = None
        elif t in ",);":
            if t == ")":
                if not stack:
                    raise ValueError("bracket")
                last = stack.pop()
            else:
                last = None
        elif m[1] is not None:
            if last is None:
                raise ValueError("length without a node")
            rows[last][3] = float(m[1])
        else:
            label = m[2].replace("''", "'") if m[2] is not None else m[3].replace("_", " ")
            if last is None:
                rows.append([len(rows), stack[-1] if stack else None, None, None, len(stack)])
                last = len(rows) - 1
            rows[last][2] = label
    if stack:
        raise ValueError("bracket")
    yield from map(tuple, rows)


def newick(data: bytes) -> Iterator[tuple]:
    for n, s in enumerate((x for x in text(data).split(";") if x.strip()), 1):
        for r in _tree(s + ";"):
            yield n, *r


def nexus(data: bytes) -> Iterator[tuple]:
    s = text(data)
    if not s.lstrip().upper().startswith("#NEXUS"):
        raise ValueError("no NEXUS header")
    names = {}
    if m := re.search(r"\btranslate\b(.*?);", s, re.S | re.I):
        names = dict(x.split(None, 1) for x in re.split(r"\s*,\s*", m[1].strip()) if x.strip())
    for n, m in enumerate(re.finditer(r"(?im)^\s*u?tree\s+\*?\s*([^=\s]+)\s*=\s*([^;]*);", s), 1):
        for r in _tree(m[2] + ";"):
            yield n, *r[:2], names.get(r[2], r[2]), *r[3:]


GRAPH, TREE = ("kind", "id", "label", "source", "target"), ("tree", "node", "parent", "name", "length", "depth")
FORMATS = {
    "dot": Format(GRAPH, dot, (".dot", ".gv")),
    "mermaid": Format(GRAPH, mermaid, (".mmd", ".mermaid")),
    "d2": Format(GRAPH, d2, (".d2",)),
    "plantuml": Format(GRAPH, plantuml, (".puml", ".plantuml"), lambda h: h.lstrip().startswith(b"@startuml")),
    "graphml": Format(GRAPH, graphml, (".graphml",), root_is("graphml")),
    "gexf": Format(GRAPH, gexf, (".gexf",), root_is("gexf")),
    "xgmml": Format(GRAPH, xgmml, (".xgmml",), root_is("graph", having=b"XGMML")),
    "graphgml": Format(GRAPH, gml_graph, (".graph.gml",), lambda h: bool(re.match(rb"\s*(?:#[^\n]*\n|\w+ [^\[\n]*\n)*graph\s*\[", h))),
    "newick": Format(TREE, newick, (".nwk", ".newick", ".tree")),
    "nexus": Format(TREE, nexus, (".nex", ".nexus"), lambda h: h.lstrip().upper().startswith(b"#NEXUS")),
}
