"""Bounded XML: no document type, no external anything; local names."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree as ET

#: Elements of one file at most, and depth.
NODES, DEPTH = 5_000_000, 256


def parse(data: bytes) -> ET.Element:
    """The root; a document type declaration is an error, as it could define entities."""
    if re.search(rb"<!DOCTYPE|<!ENTITY", data[: 1 << 16].replace(b"\0", b"")):
        raise ValueError("document type declarations are refused")
    parser, depth, nodes, root = ET.XMLPullParser(["start", "end"]), 0, 0, None
    for i in range(0, len(data), 1 << 16):
        parser.feed(data[i : i + (1 << 16)])
        for event, e in parser.read_events():
            if event == "start":
                root = e if root is None else root
                depth, nodes = depth + 1, nodes + 1
                if depth > DEPTH or nodes > NODES:
                    raise ValueError("too many or too deep elements")
            else:
                depth -= 1
    parser.close()
    if root is None:
        raise ValueError("no element")
    return root


def name(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def space(e: ET.Element) -> str:
    return e.tag[1:].partition("}")[0] if e.tag.startswith("{") else ""


def every(e: ET.Element, *names: str) -> Iterator[ET.Element]:
    """Descendants by local name, in document order."""
    return (x for x in e.iter() if x is not e and name(x) in names)


def kids(e: ET.Element, *names: str) -> list[ET.Element]:
    return [x for x in e if not names or name(x) in names]


def kid(e: ET.Element | None, path: str) -> ET.Element | None:
    for n in path.split("/"):
        e = next((x for x in e if name(x) == n), None) if e is not None else None
    return e


def inside(e: ET.Element | None, path: str) -> list[ET.Element]:
    """The elements within a child, none where it isn't there."""
    found = kid(e, path)
    return [] if found is None else list(found)


def said(e: ET.Element | None) -> str | None:
    """All text inside, single blanks."""
    return None if e is None else " ".join("".join(e.itertext()).split())


def own(e: ET.Element | None, path: str) -> str | None:
    return said(kid(e, path))


def attr(e: ET.Element | None, key: str) -> str | None:
    """An attribute by local name."""
    return None if e is None else next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == key), None)


def rooted(data: bytes, *names: str) -> ET.Element:
    root = parse(data)
    if name(root) not in names:
        raise ValueError(f"root is <{name(root)}>")
    return root


def root_is(*names: str, having: bytes = b""):
    """A sniffer for the first element's local name and bytes that the beginning holds."""
    rx = re.compile(rb"<(?:[\w.-]+:)?(" + "|".join(names).encode() + rb")[\s/>]")
    first = re.compile(rb"(?s)^(?:\xef\xbb\xbf)?\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*|<!DOCTYPE[^>]*>\s*)*")
    return lambda h: having in h and bool(rx.match(h, first.match(h).end()))
