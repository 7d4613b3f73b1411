"""Delimited and spreadsheet-like text tables."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

from ..files import Format, text

#: Limits of delimited text.
RECORDS, COLUMNS, FIELD = 50_000, 256, 64 << 10


def delimited(data: bytes, sep: str = ",") -> Iterator[list[str]]:
    """Strict records: quotes open only at a field's beginning and double inside; blank records are skipped."""
    s, at, n = text(data), 0, 0
    record: list[str] = []
    while at < len(s):
        if s[at] == '"':
            part, at = [], at + 1
            while True:
                end = s.find('"', at)
                if end < 0:
                    raise ValueError("unterminated quote")
                part.append(s[at:end])
                at = end + 1
                if s[at : at + 1] != '"':
                    break
                part.append('"')
                at += 1
            field = "".join(part)
            if at < len(s) and s[at] not in sep + "\r\n":
                raise ValueError("text after a closing quote")
        else:
            end = min((i for i in (s.find(c, at) for c in sep + "\r\n") if i >= 0), default=len(s))
            field, at = s[at:end], end
            if '"' in field:
                raise ValueError("quote inside a field")
        if len(field) > FIELD or re.search(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", field):
            raise ValueError("field too long or with control characters")
        record.append(field)
        if at < len(s) and s[at] == sep:
            at += 1
            if at == len(s):
                record.append("")
            continue
        if s[at : at + 2] == "\r\n":
            at += 1
        at += 1
        if record != [""]:
            n += 1
            if n > RECORDS or len(record) > COLUMNS:
                raise ValueError("too many records or columns")
            yield record
        record = []
    if record and record != [""]:
        yield record


def _cells(records: list[list[str]]) -> Iterator[tuple]:
    """(row, column, header, value) of every cell below the header; short rows are padded, long ones widen it."""
    if not records:
        return
    width = max(map(len, records))
    head = records[0] + [""] * (width - len(records[0]))
    for i, r in enumerate(records[1:], 1):
        for k in range(width):
            yield i, k + 1, head[k], r[k] if k < len(r) else ""


def csv(data: bytes) -> Iterator[tuple]:
    head = data[:4096].split(b"\n")[0]
    sep = max(",\t;|", key=lambda c: head.count(c.encode()))
    yield from _cells(list(delimited(data, sep)))


def pipe_cells(line: str) -> list[str]:
    """Cells of a Markdown table line; escaped bars and those in code belong to a cell."""
    line = line.strip()
    line = line[1:] if line.startswith("|") else line
    out, cell, code, i = [], "", "", 0
    while i < len(line):
        c = line[i]
        if c == "\\" and line[i + 1 : i + 2] == "|":
            cell, i = cell + "|", i + 2
            continue
        if c == "`":
            run = re.match("`+", line[i:]).group()
            if not code and run in line[i + len(run) :]:
                code = run
            elif run == code:
                code = ""
            cell, i = cell + run, i + len(run)
            continue
        if c == "|" and not code:
            out.append(cell.strip())
            cell = ""
        else:
            cell += c
        i += 1
    return out + ([cell.strip()] if cell.strip() or not line.rstrip().endswith("|") else [])


def is_rule(line: str) -> bool:
    cells = pipe_cells(line)
    return "-" in line and bool(cells) and all(re.fullmatch(r":?-+:?", c) for c in cells)


def alignment(rule: str) -> str:
    return {(True, True): "center", (False, True): "right"}.get((rule.startswith(":"), rule.endswith(":")), "left")


def pipe_tables(lines: list[str]) -> Iterator[tuple[int, list[str], list[str], list[list[str]]]]:
    """(line, header, alignments, rows) of the pipe tables among lines."""
    i = 0
    while i + 1 < len(lines):
        if "|" in lines[i] and is_rule(lines[i + 1]) and len(pipe_cells(lines[i])) == len(pipe_cells(lines[i + 1])):
            head, rule, rows, k = pipe_cells(lines[i]), pipe_cells(lines[i + 1]), [], i + 2
            while k < len(lines) and lines[k].strip() and "|" in lines[k]:
                cells = pipe_cells(lines[k])
                rows.append((cells + [""] * len(head))[: len(head)])
                k += 1
            yield i, head, [alignment(r) for r in rule], rows
            i = k
        else:
            i += 1


def dif(data: bytes) -> Iterator[tuple]:
    lines = text(data).splitlines()
    at = lines.index("DATA") + 3
    row = column = 0
    while at + 1 < len(lines):
        kind, _, value = lines[at].partition(",")
        label, at = lines[at + 1], at + 2
        if kind.strip() == "-1":
            if label == "EOD":
                return
            row, column = row + 1, 0
        else:
            column += 1
            yield row, column, "number" if kind.strip() == "0" else "text", value if kind.strip() == "0" else label.strip('"')


def sylk(data: bytes) -> Iterator[tuple]:
    row = column = 1
    for line in text(data).splitlines():
        kind, *parts = line.replace(";;", "\0").split(";")
        if kind != "C":
            if kind == "E":
                return
            continue
        value = formula = None
        for p in parts:
            if p[:1] in "XC" and p[1:].isdigit():
                column = int(p[1:])
            elif p[:1] in "YR" and p[1:].isdigit():
                row = int(p[1:])
            elif p[:1] == "K":
                value = p[1:].strip('"').replace("\0", ";")
            elif p[:1] == "E":
                formula = p[1:].replace("\0", ";")
        yield row, column, value, formula


def properties(data: bytes) -> Iterator[tuple]:
    """Keys in their first place with their last value."""
    found: dict[str, str] = {}
    lines, whole = io.StringIO(text(data)), ""
    for line in lines:
        line = whole + line.strip("\r\n").lstrip(" \t\f")
        if not whole and line[:1] in ("#", "!", ""):
            continue
        if re.search(r"(?<!\\)(\\\\)*\\$", line):
            whole = line[:-1]
            continue
        whole = ""
        m = re.match(r"((?:\\.|[^\\:= \t\f])*)[ \t\f]*[:=]?[ \t\f]*(.*)", line, re.S)
        plain = lambda s: re.sub(r"\\(u[0-9a-fA-F]{4}|.)", lambda e: chr(int(e[1][1:], 16)) if len(e[1]) == 5 else {"n": "\n", "t": "\t", "r": "\r", "f": "\f"}.get(e[1], e[1]), s)
        found[plain(m[1])] = plain(m[2])
    yield from found.items()


CELL = ("row", "col", "header", "value")
FORMATS = {
    "csv": Format(CELL, csv, (".csv", ".tsv", ".tab")),
    "dif": Format(("row", "col", "kind", "value"), dif, (".dif",), lambda h: h.startswith(b"TABLE\n0,1")),
    "sylk": Format(("row", "col", "value", "formula"), sylk, (".slk", ".sylk"), lambda h: h.startswith(b"ID;")),
    "properties": Format(("key", "value"), properties, (".properties",)),
}
