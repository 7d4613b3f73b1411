"""Changes of vector drawings as text: smaller, one colour, scaling with the page, rounded, without what isn't drawn."""

from __future__ import annotations

import re
from xml.etree import ElementTree as ET

from ..sources.formats.xmltree import attr, name, parse
from .writers import number

_SPACE = "http://www.w3.org/2000/svg"
_NUMERIC = ("x", "y", "x1", "y1", "x2", "y2", "cx", "cy", "r", "rx", "ry", "width", "height", "d", "points", "transform", "viewBox", "stroke-width", "opacity", "offset", "font-size", "dx", "dy")
_PAINT = ("fill", "stroke", "stop-color", "color", "flood-color")
_ARGUMENTS = {"m": 2, "l": 2, "h": 1, "v": 1, "c": 6, "s": 4, "q": 4, "t": 2, "a": 7, "z": 0}


def rounded(value: str, digits: int) -> str:
    """Every number of an attribute with at most so many decimals; colours and ids stay."""
    return re.sub(r"(?<![#\w.])[-+]?(?:\d+\.\d*|\.\d+|\d+)(?:[eE][-+]?\d+)?(?![\w#])", lambda m: number(m[0], digits), value)


def clean_path(d: str) -> str:
    """Path data with one letter for a run of commands and without lines that go nowhere.

    Flags of arcs may touch the number after them; what isn't path data stays as it is.
    """
    parts, at = [], 0
    for m in re.finditer(r"([MmLlHhVvCcSsQqTtAaZz])([^MmLlHhVvCcSsQqTtAaZz]*)", d):
        if d[at : m.start()].strip():
            return d
        at = m.end()
        n, raw = _ARGUMENTS[m[1].lower()], m[2]
        numbers: list[str] = []
        place = 0
        while place < len(raw):
            flag = m[1] in "Aa" and len(numbers) % 7 in (3, 4)
            t = re.compile(r"[\s,]*([01])" if flag else r"[\s,]*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)").match(raw, place)
            if not t:
                break
            numbers.append(t[1])
            place = t.end()
        if raw[place:].strip(" ,\t\r\n") or (len(numbers) % n if n else numbers):
            return d
        for k in range(0, max(1, len(numbers)), max(1, n)):
            group = numbers[k : k + n]
            letter = {"M": "L", "m": "l"}.get(m[1], m[1]) if k and m[1] in "Mm" else m[1]
            if letter in "lhvt" and group and all(float(v) == 0 for v in group):
                continue
            parts.append((letter, group))
    if d[at:].strip() and at:
        return d
    out, last = [], ""
    for letter, group in parts:
        follows = letter == last and letter not in "MmZz" or (last == "M" and letter == "L") or (last == "m" and letter == "l")
        out.append((" " if follows else letter) + " ".join(group))
        last = letter
    return "".join(out)


def transform_svg(data: bytes, minify: bool = False, monochrome: str | None = None, responsive: bool = False, precision: int | None = None, remove_metadata: bool = False, clean_paths: bool = False, strip_empty_groups: bool = False) -> bytes:
    """The drawing with the changes asked for; a file that isn't one is an error."""
    root = parse(data)
    if name(root) != "svg":
        raise ValueError(f"root is <{name(root)}>")
    if precision is not None and not 0 <= precision <= 12:
        raise ValueError("precision is 0 to 12")
    if responsive:
        if attr(root, "viewBox") is None:
            size = [re.match(r"[\d.]+", attr(root, k) or "") for k in ("width", "height")]
            if all(size):
                root.set("viewBox", f"0 0 {size[0][0]} {size[1][0]}")
        root.attrib.pop("width", None)
        root.attrib.pop("height", None)

    def go(e: ET.Element, keep: bool) -> None:
        keep = {"preserve": True, "default": False}.get(e.get("{http://www.w3.org/XML/1998/namespace}space", ""), keep)
        for k in list(e.attrib):
            v = e.attrib[k]
            if monochrome and k in _PAINT and v not in ("none", "transparent") and not v.startswith("url("):
                v = monochrome
            if monochrome and k == "style":
                v = re.sub(rf"(?<![\w-])({'|'.join(_PAINT)})\s*:(?!\s*(?:none|transparent|url))[^;]+", rf"\1:{monochrome}", v)
            if clean_paths and k == "d":
                v = clean_path(v)
            if precision is not None and k in _NUMERIC:
                v = rounded(v, precision)
            if remove_metadata and k.startswith("{") and not k.startswith(("{http://www.w3.org/1999/xlink}", "{http://www.w3.org/XML")):
                del e.attrib[k]
                continue
            e.attrib[k] = v
        for x in list(e):
            if not isinstance(x.tag, str) or remove_metadata and (name(x) == "metadata" or not x.tag.startswith(f"{{{_SPACE}}}") and "}" in x.tag):
                _drop(e, x)
                continue
            go(x, keep or name(x) in ("text", "tspan", "style", "script"))
            if strip_empty_groups and name(x) == "g" and not len(x) and not (x.text or "").strip() and "id" not in x.attrib:
                _drop(e, x)
        if minify and not keep and name(e) not in ("text", "tspan", "style", "script"):
            e.text = e.text if (e.text or "").strip() else None
            for x in e:
                x.tail = x.tail if (x.tail or "").strip() else None

    def _drop(parent: ET.Element, x: ET.Element) -> None:
        """Without the element, but with the text that follows it."""
        i = list(parent).index(x)
        if x.tail and x.tail.strip():
            if i:
                parent[i - 1].tail = (parent[i - 1].tail or "") + x.tail
            else:
                parent.text = (parent.text or "") + x.tail
        parent.remove(x)

    go(root, False)
    ET.register_namespace("", _SPACE)
    ET.register_namespace("xlink", "http://www.w3.org/1999/xlink")
    return ET.tostring(root, encoding="unicode").encode()
