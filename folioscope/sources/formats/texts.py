"""Documents, messages and configuration in plain text, as blocks or entries."""

from __future__ import annotations

import email
import email.policy
import html as entities
import re
import tomllib
from collections.abc import Iterator
from html.parser import HTMLParser

from ..files import Format, loads, text
from .jsons import leaves
from .tables import pipe_tables

#: Elements of HTML whose text isn't shown, those that begin a block, and those without an end.
HIDDEN = ("head", "style", "script", "noscript", "template", "svg")
BLOCKS = ("p", "blockquote", "div", "section", "article", "main", "header", "footer", "aside", "nav", "figure", "figcaption", "address", "form", "body", "html", "ul", "ol", "dl", "table", "tr")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


class _Blocks(HTMLParser):
    """Collects (kind, level, text) blocks: headings (h4 to h6 as level 4), paragraphs, list items by
    nesting, definition terms, preformatted text, table cells joined by tabs, rules, images' texts."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[tuple] = []
        self.words: list[str] = []
        self.kind, self.level = "paragraph", 0
        self.hidden = self.pre = 0
        self.lists: list[list] = []
        self.row: list[str] | None = None
        self.open, self.span = False, 1
        self.title: str | None = None
        self.in_title = False

    def flush(self) -> None:
        whole = "".join(self.words)
        self.words = []
        said = whole.strip("\n") if self.pre else " ".join(whole.split())
        if said.strip():
            self.out.append((self.kind, self.level, said))
        self.kind, self.level = "paragraph", 0

    def handle_starttag(self, tag, attrs):
        if tag == "title":
            self.in_title = True
        if tag in HIDDEN:
            self.hidden += tag not in VOID
            return
        if self.hidden:
            return
        if m := re.fullmatch("h([1-6])", tag):
            self.flush()
            self.kind, self.level = "heading", min(int(m[1]), 4)
        elif tag in ("ul", "ol"):
            self.flush()
            start = dict(attrs).get("start") or "1"
            self.lists.append([int(start) if tag == "ol" and re.fullmatch(r"-?\d+", start) else 1 if tag == "ol" else None])
        elif tag == "li":
            self.flush()
            self.kind, self.level = "item", len(self.lists)
            if self.lists and self.lists[-1][0] is not None:
                self.words.append(f"{self.lists[-1][0]}. ")
                self.lists[-1][0] += 1
        elif tag in ("dt", "dd"):
            self.flush()
            self.kind = "term" if tag == "dt" else "definition"
        elif tag == "pre":
            self.flush()
            self.pre += 1
            self.kind = "code"
        elif tag == "tr":
            if self.row is not None:
                self.end_row()
            self.flush()
            self.row = []
        elif tag in ("td", "th"):
            self.cell()
            if self.row is not None:
                self.words, self.open = [], True
                span = dict(attrs).get("colspan") or "1"
                self.row.append("")
                self.span = int(span) if span.isdigit() and 0 < int(span) < 256 else 1
        elif tag == "br":
            self.words.append("\n" if self.pre else " ")
        elif tag == "hr":
            self.flush()
            self.out.append(("rule", 0, ""))
        elif tag == "img":
            self.words.append(dict(attrs).get("alt") or "")
        elif tag in BLOCKS and self.row is None:
            self.flush()
            if tag == "blockquote":
                self.kind = "quote"

    def end_row(self) -> None:
        self.cell()
        if any(self.row):
            self.out.append(("row", len(self.row), "\t".join(self.row)))
        self.row, self.words = None, []

    def cell(self) -> None:
        """Ends the open cell of a row, if it isn't ended."""
        if self.row and self.open:
            self.open = False
            self.row[-1] = " ".join("".join(self.words).split())
            self.row += [""] * (self.span - 1)
            self.words = []

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
            return
        if self.hidden:
            return
        if tag in ("td", "th"):
            self.cell()
        elif tag in ("tr", "table") and self.row is not None:
            self.end_row()
        elif tag == "pre":
            self.kind = "code"
            self.flush()
            self.pre = max(0, self.pre - 1)
        elif tag in ("ul", "ol"):
            self.flush()
            self.lists = self.lists[:-1]
        elif re.fullmatch("h[1-6]|li|dt|dd", tag) or tag in BLOCKS and self.row is None:
            self.flush()

    def handle_data(self, data):
        if self.in_title:
            self.title = (self.title or "") + data
        if not self.hidden:
            self.words.append(data)


def html_blocks(s: str) -> list[tuple]:
    """(kind, level, text) of the shown parts; an unterminated comment is an error."""
    if s.count("<!--") > len(re.findall(r"<!--.*?-->", s, re.S)):
        raise ValueError("unterminated comment")
    parser = _Blocks()
    parser.feed(s)
    parser.close()
    parser.flush()
    return parser.out


def html(data: bytes) -> Iterator[tuple]:
    yield from html_blocks(text(data))


def inline(s: str) -> str:
    """Markdown inline marks taken out: code, images' texts, links' texts, emphasis."""
    s = re.sub(r"!\[([^\]]*)\]\([^)]*\)|!\[([^\]]*)\]\[[^\]]*\]", lambda m: m[1] or m[2] or "", s)
    s = re.sub(r"\[([^\]]*)\]\([^)]*\)|\[([^\]]+)\]\[[^\]]*\]", lambda m: m[1] or m[2] or "", s)
    s = re.sub(r"(`+)(.+?)\1", r"\2", s)
    s = re.sub(r"(\*\*|__|~~)(?=\S)(.+?)(?<=\S)\1", r"\2", s)
    return re.sub(r"(?<![\w*])([*_])(?=\S)(.+?)(?<=\S)\1(?![\w*])", r"\2", s)


def markdown_blocks(s: str) -> Iterator[tuple]:
    lines = s.splitlines()
    tables = {i: (head, rows) for i, head, _, rows in pipe_tables(lines)}
    words: list[str] = []

    def paragraph() -> Iterator[tuple]:
        if words:
            yield "paragraph", 0, inline(" ".join(words))
            words.clear()

    i = 0
    while i < len(lines):
        line = lines[i]
        if m := re.match(r" {0,3}(```+|~~~+)(.*)", line):
            yield from paragraph()
            k = next((k for k in range(i + 1, len(lines)) if re.match(rf" {{0,3}}{re.escape(m[1])}+\s*$", lines[k])), len(lines))
            yield "code", 0, "\n".join(lines[i + 1 : k])
            i = k + 1
            continue
        if i in tables:
            yield from paragraph()
            head, rows = tables[i]
            for r in [head, *rows]:
                yield "row", len(r), "\t".join(map(inline, r))
            i += 2 + len(rows)
            continue
        if m := re.match(r" {0,3}(#{1,6})(?:\s+(.*?))?(?:\s+#+)?\s*$", line):
            yield from paragraph()
            yield "heading", len(m[1]), inline(m[2] or "")
        elif words and re.match(r" {0,3}(=+|-+)\s*$", line):
            yield "heading", 1 if "=" in line else 2, inline(" ".join(words))
            words.clear()
        elif re.match(r" {0,3}([-*_])(\s*\1){2,}\s*$", line):
            yield from paragraph()
            yield "rule", 0, ""
        elif m := re.match(r"(\s*)(?:[-*+]|(\d+)[.)])\s+(.*)", line):
            yield from paragraph()
            yield "item", 1 + len(m[1].expandtabs(4)) // 2, (f"{m[2]}. " if m[2] else "") + inline(m[3])
        elif m := re.match(r" {0,3}>\s?(.*)", line):
            yield from paragraph()
            yield "quote", 0, inline(m[1])
        elif re.match(r" {0,3}\[[^\]]+\]:\s*\S+", line):
            yield from paragraph()
        elif line.strip():
            words.append(line.strip())
        else:
            yield from paragraph()
        i += 1
    yield from paragraph()


def front_matter(s: str) -> tuple[str, str]:
    m = re.match(r"---\r?\n(.*?)\r?\n(?:---|\.\.\.)[ \t]*(?:\r?\n|$)", s, re.S)
    return (m[1], s[m.end() :]) if m else ("", s)


def quarto(data: bytes) -> Iterator[tuple]:
    """Front matter lines, then blocks; code chunks stay source."""
    head, rest = front_matter(text(data))
    for line in head.splitlines():
        yield "meta", 0, line
    yield from markdown_blocks(rest)


def _marked(data: bytes, heading: str, item: str, literal: str) -> Iterator[tuple]:
    """Blocks of line markup: headings and items by pattern, literal blocks between two marks, blank lines between paragraphs."""
    words: list[str] = []
    lines, i = text(data).splitlines(), 0
    while i <= len(lines):
        line = lines[i] if i < len(lines) else ""
        head, one, start = re.match(heading, line), re.match(item, line), re.match(literal, line)
        if (head or one or start or not line.strip()) and words:
            yield "paragraph", 0, " ".join(words)
            words = []
        if start:
            close = start[0].replace("begin", "end").replace("BEGIN", "END").split()[0].rstrip()
            k = next((k for k in range(i + 1, len(lines)) if lines[k].strip().lower().startswith(close.lower())), len(lines))
            yield "code", 0, "\n".join(lines[i + 1 : k])
            i = k
        elif head:
            yield "heading", len(head[1]), head[2].strip()
        elif one:
            yield "item", 1 + len(one[1]) // 2, one[2].strip()
        elif line.strip().startswith("|"):
            cells = [c.strip() for c in line.strip().strip("|").split("|")]
            if not re.fullmatch(r"[-+= |]*", line.strip()):
                yield "row", len(cells), "\t".join(cells)
        elif line.strip():
            words.append(line.strip())
        i += 1


def org(data: bytes) -> Iterator[tuple]:
    yield from _marked(data, r"(\*+)\s+(.*)", r"(\s*)(?:[-+]|\d+[.)])\s+(.*)", r"\s*#\+(?:BEGIN|begin)_\w+")


def asciidoc(data: bytes) -> Iterator[tuple]:
    yield from _marked(data, r"(={1,6})\s+(.*)", r"(\s*)(?:[*.-]+)\s+(.*)", r"(?:-{4,}|\.{4,})\s*$")


def rst(data: bytes) -> Iterator[tuple]:
    """Sections by underline characters in order of appearance; literal blocks by indentation."""
    lines, marks, words, i = text(data).splitlines(), [], [], 0
    while i <= len(lines):
        line = lines[i] if i < len(lines) else ""
        under = lines[i + 1] if i + 1 < len(lines) else ""
        if line.strip() and not words and re.fullmatch(r"([=\-~^\"'`#*+.:_])\1{2,}\s*", under) and len(under.rstrip()) >= len(line.rstrip()):
            if under[0] not in marks:
                marks.append(under[0])
            yield "heading", marks.index(under[0]) + 1, line.strip()
            i += 2
            continue
        if not line.strip() or (one := re.match(r"(\s*)(?:[-*+•]|\d+[.)]|#\.)\s+(.*)", line)):
            if words:
                said, words = " ".join(words), []
                yield "paragraph", 0, said.removesuffix("::") + (":" if said.endswith("::") and said != "::" else "")
                if said.endswith("::"):
                    k = i
                    while k < len(lines) and (not lines[k].strip() or lines[k][0] in " \t"):
                        k += 1
                    if k > i + 1:
                        yield "code", 0, "\n".join(x.strip() for x in lines[i + 1 : k]).strip()
                        i = k
                        continue
            if line.strip():
                yield "item", 1 + len(one[1]) // 2, one[2]
        elif not line.startswith("..") and not re.fullmatch(r"([=\-~^\"'`#*+.:_])\1{2,}\s*", line):
            words.append(line.strip())
        i += 1


def rtf(data: bytes) -> Iterator[tuple]:
    """Paragraphs of the text; destinations that aren't shown are skipped."""
    s = data.decode("latin-1")
    if not s.startswith("{\\rtf"):
        raise ValueError("not RTF")
    skipped = ("fonttbl", "colortbl", "stylesheet", "info", "pict", "object", "header", "footer", "generator", "listtable", "listoverridetable")
    out: list[str] = []
    stack: list[bool] = []
    hide = False
    for m in re.finditer(r"\\'([0-9a-fA-F]{2})|\\([a-zA-Z]+)(-?\d+)? ?|\\(.)|([{}])|([^\\{}\r\n]+)", s, re.S):
        code, word, number, sign, brace, plain = m.groups()
        if brace == "{":
            stack.append(hide)
        elif brace == "}":
            hide = stack.pop() if stack else False
        elif word in skipped or sign == "*":
            hide = True
        elif hide:
            continue
        elif code:
            out.append(bytes([int(code, 16)]).decode("cp1252", "replace"))
        elif word in ("par", "sect", "page", "row"):
            out.append("\n")
        elif word in ("tab", "cell"):
            out.append("\t")
        elif word == "line":
            out.append(" ")
        elif word == "u" and number:
            out.append(chr(int(number) % 65536))
        elif sign in ("{", "}", "\\"):
            out.append(sign)
        elif plain:
            out.append(plain[1:] if out and out[-1] and m.start() > 2 and re.search(r"\\u-?\d+ ?$", s[: m.start()][-9:]) and plain[:1] == "?" else plain)
    for line in "".join(out).split("\n"):
        if line.strip():
            yield "paragraph", 0, line.strip()


def subtitles(data: bytes) -> Iterator[tuple]:
    """Cues of SubRip and WebVTT: begin and end in seconds, text without marks."""
    seconds = lambda t: sum(float(x) * 60**k for k, x in enumerate(reversed(t.replace(",", ".").split(":"))))
    for part in re.split(r"\r?\n\s*\r?\n", text(data).strip()):
        m = re.search(r"(?m)^\s*((?:\d+:)?\d+:\d+[.,]\d+)\s*-->\s*((?:\d+:)?\d+:\d+[.,]\d+)[^\n]*\n?(.*)", part, re.S)
        if m:
            if seconds(m[2]) < seconds(m[1]):
                raise ValueError("a cue ends before it begins")
            yield round(seconds(m[1]), 3), round(seconds(m[2]), 3), entities.unescape(re.sub(r"<[^>]*>|\{\\[^}]*\}", "", m[3])).strip()


def _unfolded(data: bytes) -> Iterator[tuple[str, dict[str, str], str]]:
    """Name, parameters and value of content lines; continued ones are joined."""
    for line in re.sub(r"\r?\n[ \t]", "", text(data)).splitlines():
        m = re.match(r'((?:[^":;]|"[^"]*")+)((?:;(?:[^":;]|"[^"]*")+)*):(.*)', line)
        if m:
            name = m[1].split(".")[-1].upper()
            yield name, {k.upper(): v.strip('"') for k, _, v in (p.partition("=") for p in m[2].split(";")[1:])}, re.sub(r"\\([nN,;\\])", lambda e: "\n" if e[1] in "nN" else e[1], m[3])


def calendar(data: bytes) -> Iterator[tuple]:
    """Components with their main properties; a recurrence is flagged and never expanded."""
    stack: list[tuple[str, dict]] = []
    for name, _, value in _unfolded(data):
        if name == "BEGIN":
            stack.append((value.upper(), {}))
        elif name == "END":
            if not stack or stack[-1][0] != value.upper():
                raise ValueError(f"END:{value} without its BEGIN")
            kind, p = stack.pop()
            if kind in ("VEVENT", "VTODO", "VJOURNAL", "VFREEBUSY"):
                yield kind, p.get("UID"), p.get("SUMMARY"), p.get("DTSTART"), p.get("DTEND") or p.get("DUE"), p.get("LOCATION"), "RRULE" in p
        elif stack:
            stack[-1][1].setdefault(name, value)
    if stack:
        raise ValueError(f"{stack[-1][0]} doesn't end")


def vcard(data: bytes) -> Iterator[tuple]:
    card: dict[str, list[str]] | None = None
    for name, _, value in _unfolded(data):
        if name == "BEGIN" and value.upper() == "VCARD":
            card = {}
        elif name == "END" and card is not None:
            yield tuple("; ".join(card.get(k, [])) or None for k in ("FN", "N", "ORG", "TITLE", "EMAIL", "TEL", "ADR"))
            card = None
        elif card is not None:
            card.setdefault(name, []).append(" ".join(x for x in value.split(";") if x) if name in ("N", "ADR", "ORG") else value)


def gettext(data: bytes) -> Iterator[tuple]:
    for part in re.split(r"\r?\n\s*\r?\n", text(data).strip()):
        found: dict[str, str] = {}
        key = None
        flags = ",".join(x.strip() for line in part.splitlines() if line.startswith("#,") for x in line[2:].split(","))
        for line in part.splitlines():
            if m := re.match(r'(msgctxt|msgid_plural|msgid|msgstr(?:\[\d+\])?)\s+"(.*)"\s*$', line):
                key = m[1]
                found[key] = m[2]
            elif key and (m := re.match(r'"(.*)"\s*$', line)):
                found[key] += m[1]
        if "msgid" in found:
            plain = lambda s: s and re.sub(r"\\(.)", lambda e: {"n": "\n", "t": "\t"}.get(e[1], e[1]), s)
            yield plain(found.get("msgctxt")), plain(found["msgid"]), plain(found.get("msgstr", found.get("msgstr[0]", ""))), flags


def _message(m) -> tuple:
    body = m.get_body(preferencelist=("plain", "html"))
    said = body.get_content() if body is not None else ""
    if body is not None and body.get_content_subtype() == "html":
        said = "\n".join(t for _, _, t in html_blocks(said))
    attached = [a.get_filename() or a.get_content_type() for a in m.iter_attachments()]
    return m["From"], m["To"], m["Date"] and str(m["Date"]), m["Subject"], said.strip(), "; ".join(attached)


def eml(data: bytes) -> Iterator[tuple]:
    m = email.message_from_bytes(data, policy=email.policy.default)
    if not m.keys():
        raise ValueError("no header")
    yield _message(m)


def emlx(data: bytes) -> Iterator[tuple]:
    size, _, rest = data.partition(b"\n")
    yield from eml(rest[: int(size)])


def mbox(data: bytes) -> Iterator[tuple]:
    for part in re.split(rb"(?m)^From [^\n]*\n", data)[1:]:
        yield from eml(re.sub(rb"(?m)^>(>*From )", rb"\1", part))


def mhtml(data: bytes) -> Iterator[tuple]:
    """Blocks of the root HTML part."""
    m = email.message_from_bytes(data, policy=email.policy.default)
    part = next((p for p in m.walk() if p.get_content_type() == "text/html"), None)
    if part is None:
        raise ValueError("no HTML part")
    yield from html_blocks(part.get_content())


def toml(data: bytes) -> Iterator[tuple]:
    yield from leaves(tomllib.loads(text(data)))


# YAML without tags, anchors or complex keys: aliases and tags stay text.
_SCALAR = {"": None, "~": None, "null": None, "true": True, "false": False}


def _scalar(s: str):
    s = s.strip()
    if s[:1] in "[{" and s[:1]:
        return _flow(s)
    if s[:1] == '"':
        return loads(s.encode())
    if s[:1] == "'":
        return s[1:-1].replace("''", "'")
    if s.lower() in _SCALAR:
        return _SCALAR[s.lower()]
    if re.fullmatch(r"[-+]?\d+", s):
        return int(s)
    return float(s) if re.fullmatch(r"[-+]?(\d+\.\d*|\.\d+|\d+)([eE][-+]?\d+)?", s) else s


def _flow(s: str):
    """Flow lists and maps, by splitting at commas outside brackets and quotes."""
    inner, parts, depth, quote, cell = s.strip()[1:-1], [], 0, "", ""
    for c in inner:
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        depth += (c in "[{") - (c in "]}") if not quote else 0
        if c == "," and not depth and not quote:
            parts.append(cell)
            cell = ""
        else:
            cell += c
    parts += [cell] if cell.strip() else []
    if s[0] == "[":
        return [_scalar(p) for p in parts]
    return {str(_scalar(k)): _scalar(v) for k, _, v in (p.partition(":") for p in parts)}


def yaml_values(s: str) -> list:
    """The documents of a stream."""
    out = []
    for part in re.split(r"(?m)^---(?:[ \t].*)?$", s):
        lines = []
        for raw in part.splitlines():
            bare = re.sub(r"""(^|\s)#(?=(?:[^"']|"[^"]*"|'[^']*')*$).*$""", r"\1", raw).rstrip()
            lines.append((len(raw) - len(raw.lstrip(" ")), bare.strip(), raw))
        if any(b and not b.startswith("%") for _, b, _ in lines):
            out.append(_yaml(lines, 0, len(lines), -1)[0])
    return out


def _yaml(lines, i: int, end: int, above: int):
    """The value whose lines are indented more than ``above``, and the line after it."""
    while i < end and not lines[i][1]:
        i += 1
    if i >= end or lines[i][0] <= above:
        return None, i
    indent, first = lines[i][0], lines[i][1]
    if re.match(r"-(\s|$)", first):
        got = []
        while i < end and (not lines[i][1] or lines[i][0] == indent and re.match(r"-(\s|$)", lines[i][1])):
            if not lines[i][1]:
                i += 1
                continue
            rest = lines[i][1][1:].strip()
            if not rest:
                value, i = _yaml(lines, i + 1, end, indent)
            elif re.match(r"""("[^"]*"|'[^']*'|[^\s"'\[{][^:]*):(\s|$)""", rest):
                shift = lines[i][2].index("-") + 1
                inner = indent + 1 + len(lines[i][2][shift:]) - len(lines[i][2][shift:].lstrip())
                lines[i] = (inner, rest, " " * inner + rest)
                value, i = _yaml(lines, i, end, indent)
            else:
                value, i = _value(lines, i, end, indent, rest)
            got.append(value)
        return got, i
    got = {}
    while i < end and (not lines[i][1] or lines[i][0] == indent):
        if not lines[i][1]:
            i += 1
            continue
        m = re.match(r"""("[^"]*"|'[^']*'|[^\s"'][^:]*?|[^:]*?\S)\s*:(?:\s+(.*)|$)""", lines[i][1])
        if not m:
            if not got:
                return _scalar(lines[i][1]), i + 1
            raise ValueError(f"line without a key: {lines[i][1][:40]}")
        key, rest = m[1].strip("\"'"), (m[2] or "").strip()
        if key in got:
            raise ValueError(f"duplicate key {key}")
        if rest:
            got[key], i = _value(lines, i, end, indent, rest)
        else:
            k = i + 1
            while k < end and not lines[k][1]:
                k += 1
            level = indent - 1 if k < end and re.match(r"-(\s|$)", lines[k][1]) and lines[k][0] == indent else indent
            got[key], i = _yaml(lines, i + 1, end, level)
    if i < end and lines[i][0] > indent:
        raise ValueError(f"indentation of: {lines[i][1][:40]}")
    return got, i


def _value(lines, i: int, end: int, indent: int, rest: str):
    if m := re.fullmatch(r"([|>])([-+]?)\d*", rest):
        k = i + 1
        while k < end and (not lines[k][2].strip() or lines[k][0] > indent):
            k += 1
        raw = [x[2] for x in lines[i + 1 : k]]
        least = min((len(x) - len(x.lstrip()) for x in raw if x.strip()), default=0)
        raw = [x[least:] for x in raw]
        said = "\n".join(raw).rstrip("\n") if m[1] == "|" else " ".join(x.strip() for x in raw).strip()
        return said + ("" if m[2] == "-" else "\n"), k
    k = i + 1
    while k < end and lines[k][1] and lines[k][0] > indent and rest[:1] not in "\"'[{":  # a plain scalar goes on
        rest, k = f"{rest} {lines[k][1]}", k + 1
    while rest[:1] in ("[", "{") and rest.count(rest[0]) > rest.count({"[": "]", "{": "}"}[rest[0]]) and k < end:
        rest, k = f"{rest} {lines[k][1]}", k + 1
    return _scalar(re.sub(r"^[&!]\S+\s*", "", rest)), k


def yaml(data: bytes) -> Iterator[tuple]:
    docs = yaml_values(text(data))
    for n, d in enumerate(docs):
        for path, kind, value in leaves(d):
            yield (f"[{n}]" if len(docs) > 1 else "") + path, kind, value


BLOCK, LEAF = ("kind", "level", "text"), ("leaf", "kind", "value")
MAIL = ("sender", "recipients", "date", "subject", "body", "attachments")
FORMATS = {
    "html": Format(BLOCK, html, (".html", ".htm", ".xhtml"), lambda h: bool(re.match(rb"\s*(<!doctype html|<html)", h, re.I))),
    "markdown": Format(BLOCK, lambda d: markdown_blocks(text(d)), (".md", ".markdown")),
    "quarto": Format(BLOCK, quarto, (".qmd", ".rmd")),
    "org": Format(BLOCK, org, (".org",)),
    "asciidoc": Format(BLOCK, asciidoc, (".adoc", ".asciidoc")),
    "rst": Format(BLOCK, rst, (".rst", ".rest")),
    "rtf": Format(BLOCK, rtf, (".rtf",), lambda h: h.startswith(b"{\\rtf")),
    "srt": Format(("begin", "end", "text"), subtitles, (".srt",)),
    "vtt": Format(("begin", "end", "text"), subtitles, (".vtt",), lambda h: h.startswith(b"WEBVTT")),
    "ical": Format(("component", "uid", "summary", "begin", "end", "location", "recurs"), calendar, (".ics", ".ifb"), lambda h: b"BEGIN:VCALENDAR" in h and b"VERSION:1.0" not in h),
    "vcalendar": Format(("component", "uid", "summary", "begin", "end", "location", "recurs"), calendar, (".vcs",), lambda h: b"BEGIN:VCALENDAR" in h),
    "vcard": Format(("name", "parts", "organisation", "title", "email", "phone", "address"), vcard, (".vcf", ".vcard"), lambda h: h.lstrip().upper().startswith(b"BEGIN:VCARD")),
    "po": Format(("context", "message", "translation", "flags"), gettext, (".po", ".pot")),
    "eml": Format(MAIL, eml, (".eml",)),
    "emlx": Format(MAIL, emlx, (".emlx",)),
    "mbox": Format(MAIL, mbox, (".mbox",), lambda h: bool(re.match(rb"From \S+", h))),
    "mhtml": Format(BLOCK, mhtml, (".mht", ".mhtml")),
    "toml": Format(LEAF, toml, (".toml",)),
    "yaml": Format(LEAF, yaml, (".yaml", ".yml")),
}
