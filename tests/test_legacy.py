"""Older binary formats on files packed by hand."""

import struct
import zlib

import pytest

from folioscope.sources.files import _plain, formats
from folioscope.sources.formats.legacy import Compound
from tests.test_formats import pack_parts


def rows(name, data):
    return [tuple(map(_plain, r)) for r in formats()[name].rows(data)]


def compound(streams, cutoff=0, storage=None):
    """A compound file of sectors of 512 bytes; streams in a storage where one is named."""
    names = list(streams)
    sectors, fat, starts = [], [], []

    def add(data):
        first = len(sectors)
        blocks = [data[i : i + 512].ljust(512, b"\0") for i in range(0, max(1, len(data)), 512)]
        sectors.extend(blocks)
        fat.extend([*range(first + 1, first + len(blocks)), 0xFFFFFFFE])
        return first

    mini, mini_fat = b"", []
    for n in names:
        data = streams[n]
        if len(data) < cutoff:
            starts.append(len(mini) // 64)
            k = max(1, -(-len(data) // 64))
            mini_fat += [*range(len(mini) // 64 + 1, len(mini) // 64 + k), 0xFFFFFFFE]
            mini += data.ljust(64 * k, b"\0")
        else:
            starts.append(add(data))
    root_start = add(mini) if mini else 0xFFFFFFFE
    mini_start = add(struct.pack(f"<{len(mini_fat)}I", *mini_fat).ljust(512, b"\xff")) if mini else 0xFFFFFFFE
    none = 0xFFFFFFFF

    def entry(label, kind, left, right, child, start, size):
        raw = label.encode("utf-16-le") + b"\0\0"
        return raw.ljust(64, b"\0") + struct.pack("<HBB3I", len(raw), kind, 1, left, right, child) + b"\0" * 36 + struct.pack("<IQ", start, size)

    offset = 2 if storage else 1
    items = [entry("Root Entry", 5, none, none, 1 if names else none, root_start, len(mini))]
    if storage:
        items.append(entry(storage, 1, none, none, 2, 0, 0))
    for i, n in enumerate(names):
        items.append(entry(n, 2, none, offset + i + 1 if i + 1 < len(names) else none, none, starts[i], len(streams[n])))
    directory = add(b"".join(items).ljust(-(-128 * len(items) // 512) * 512, b"\0"))
    fat_at = len(sectors)
    fat.append(0xFFFFFFFD)
    sectors.append(struct.pack(f"<{len(fat)}I", *fat).ljust(512, b"\xff"))
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 16 + struct.pack("<HHHHH6xII", 0x3E, 3, 0xFFFE, 9, 6, 0, 1) + struct.pack("<IIIIIII", directory, 0, cutoff, mini_start, int(bool(mini)), 0xFFFFFFFE, 0)
    return head + struct.pack("<109I", fat_at, *[none] * 108) + b"".join(sectors)


def test_compound():
    streams = {"a": b"x" * 700, "b": b"small"}
    for cutoff in (0, 64):
        c = Compound(compound(streams, cutoff))
        assert {k: c.read(k) for k in c.streams} == streams
    assert sorted(Compound(compound(streams, 64, "folder")).streams) == ["folder/a", "folder/b"]
    assert rows("vsd", compound({"VisioDocument": b"abc"})) == [("stream", "VisioDocument", "3 bytes")]
    with pytest.raises(ValueError):
        Compound(b"no")


def test_documents_and_mail():
    first, second = "One \x13 HYPERLINK x\x14link\x15.\r".encode("cp1252"), "Zwei é\r".encode("utf-16-le")
    main = bytearray(1024)
    main[512 : 512 + len(first)] = first
    main[700 : 700 + len(second)] = second
    n1, n2 = len(first), len(second) // 2
    plc = struct.pack("<3I", 0, n1, n1 + n2) + struct.pack("<HIH", 0, 512 * 2 | 0x40000000, 0) + struct.pack("<HIH", 0, 700, 0)
    clx = b"\2" + struct.pack("<I", len(plc)) + plc
    struct.pack_into("<H", main, 10, 0x0200)
    struct.pack_into("<II", main, 0x01A2, 4, len(clx))
    assert rows("doc", compound({"WordDocument": bytes(main), "1Table": b"\0" * 4 + clx})) == [("paragraph", "0", "One link."), ("paragraph", "0", "Zwei é")]
    mail = {"__substg1.0_0037001F": "Subj é".encode("utf-16-le"), "__substg1.0_1000001E": b"body", "__substg1.0_0C1A001E": b"Ann", "__substg1.0_0E04001F": "Bob".encode("utf-16-le")}
    assert rows("msg", compound(mail)) == [("Ann", "Bob", None, "Subj é", "body", "")]
    atom = lambda kind, body, head=0: struct.pack("<HHI", head, kind, len(body)) + body
    deck = atom(1006, atom(4000, "Tit\rle".encode("utf-16-le")) + atom(4008, b"two"), 0xF) + atom(1006, atom(9, b"zz"), 0xF)
    assert rows("ppt", compound({"PowerPoint Document": deck})) == [("1", "paragraph", "Tit"), ("1", "paragraph", "le"), ("1", "paragraph", "two")]


def test_workbooks():
    record = lambda kind, body: struct.pack("<HH", kind, len(body)) + body
    head = record(0x809, b"\0" * 16)
    text = lambda s: struct.pack("<HB", len(s), 0) + s.encode("latin-1")
    table = struct.pack("<II", 2, 2) + text("first") + struct.pack("<HB", 6, 0) + b"sec"
    strings = record(0xFC, table) + record(0x3C, b"\1" + "ond".encode("utf-16-le"))
    sheet = record(0x85, struct.pack("<IHBB", 0, 0, 1, 0) + b"S")
    at = len(head + sheet + strings)
    sheet = record(0x85, struct.pack("<IHBB", at, 0, 1, 0) + b"S")
    cells = record(0xFD, struct.pack("<HHHI", 0, 0, 0, 0)) + record(0xFD, struct.pack("<HHHI", 0, 1, 0, 1)) + record(0x203, struct.pack("<HHHd", 1, 0, 0, 1.5)) + record(0x27E, struct.pack("<HHHI", 1, 1, 0, 250 << 2 | 3))
    cells += record(0xBD, struct.pack("<HHHIHIH", 2, 0, 0, 7 << 2 | 2, 0, 8 << 2 | 2, 1)) + record(0x205, struct.pack("<HHHBB", 3, 0, 0, 1, 0)) + record(0x06, struct.pack("<HHH8s", 4, 0, 0, struct.pack("<d", 9.0))) + record(0x06, struct.pack("<HHH8s", 5, 0, 0, b"\0" * 6 + b"\xff\xff")) + record(0x207, text("said"))
    got = rows("xls", compound({"Workbook": head + sheet + strings + head + cells}))
    want = [("A1", "text", "first"), ("B1", "text", "second"), ("A2", "number", "1.5"), ("B2", "number", "2.5"), ("A3", "number", "7"), ("B3", "number", "8"), ("A4", "boolean", "TRUE"), ("A5", "number", "9"), ("A6", "text", "said")]
    assert got == [("S", *w, None, None) for w in want]

    def part(kind, body):
        code = bytes([kind]) if kind < 128 else bytes([kind & 0x7F | 0x80, kind >> 7])
        return code + bytes([len(body)]) + body

    wide = lambda s: struct.pack("<I", len(s)) + s.encode("utf-16-le")
    book = part(156, struct.pack("<II", 0, 1) + wide("r1") + wide("T"))
    shared = part(19, b"\0" + wide("txt"))
    body = part(0, struct.pack("<I", 2)) + part(7, struct.pack("<III", 1, 0, 0)) + part(5, struct.pack("<IId", 2, 0, 4.5)) + part(2, struct.pack("<III", 3, 0, 6 << 2 | 2)) + part(4, struct.pack("<IIB", 4, 0, 1))
    rels = '<Relationships><Relationship Id="{}" Type="x/{}" Target="{}"/>{}</Relationships>'
    data = pack_parts({"_rels/.rels": rels.format("a", "officeDocument", "xl/workbook.bin", ""), "xl/workbook.bin": book, "xl/_rels/workbook.bin.rels": rels.format("r1", "worksheet", "s.bin", '<Relationship Id="r2" Type="x/sharedStrings" Target="ss.bin"/>'), "xl/s.bin": body, "xl/ss.bin": shared})
    assert rows("xlsb", data) == [("T", "B3", "text", "txt", None, None), ("T", "C3", "number", "4.5", None, None), ("T", "D3", "number", "6", None, None), ("T", "E3", "boolean", "TRUE", None, None)]


def test_books_metafiles_and_scans():
    packed = b"<p>abcab" + struct.pack(">H", 0x8000 | 5 << 3 | 2) + b"\xe1</p>"  # five bytes back, five long; a blank and an a
    head = struct.pack(">HHIH", 2, 0, 16 + 6, 1).ljust(36, b"\0")
    places = [78 + 16, 78 + 16 + len(head)]
    book = b"Book".ljust(60, b"\0") + b"BOOKMOBI" + b"\0" * 8 + struct.pack(">H", 2) + b"".join(struct.pack(">II", p, 0) for p in places) + head + packed
    assert rows("mobi", book)[0] == ("title", "0", "Book") and rows("mobi", book)[1][2].startswith("abcababcab a")
    emf = struct.pack("<II4i", 1, 88, 0, 0, 10, 20).ljust(40, b"\0") + b" EMF" + b"\0" * 44 + struct.pack("<II", 14, 8)
    assert rows("emf", emf) == [("bounds", "0 0 10 20"), ("record 1", "1"), ("record 14", "1")]
    wmf = b"\xd7\xcd\xc6\x9a\0\0" + struct.pack("<4h", 1, 2, 3, 4) + b"\0" * 8 + b"\0" * 18 + struct.pack("<IH", 3, 0)
    assert rows("emf", wmf) == [("bounds", "1 2 3 4"), ("record 0", "1")]
    xml = b"<e57Root><data3D><vectorChild><name>s</name><points recordCount='42'/></vectorChild></data3D></e57Root>".ljust(1200)
    pages = [(b"ASTM-E57" + struct.pack("<IIQQQ", 1, 0, 3072, 48, len(xml)) + struct.pack("<Q", 1024)[:0])]
    head = b"ASTM-E57" + struct.pack("<II", 1, 0) + struct.pack("<Q", 3072) + struct.pack("<QQQ", 48, len(xml), 1024)
    logical = (head + xml).ljust(3 * 1020)
    assert len(head) == 48 and pages
    assert rows("e57", b"".join(logical[i : i + 1020] + struct.pack("<I", zlib.crc32(logical[i : i + 1020])) for i in range(0, 3060, 1020))) == [("version", "1.0"), ("scan", "s 42")]
    mark = struct.pack("<i", 4)
    assert rows("op2", mark + b"abcd" + mark + mark + b"efgh" + mark) == [("byte order", "little"), ("records", "2"), ("bytes", "8"), ("complete", "true")]


def test_structured_reports():
    explicit = lambda tag, k, v: struct.pack("<HH2sH", tag >> 16, tag & 0xFFFF, k, len(v)) + v
    item = lambda body: struct.pack("<II", 0xE000FFFE, len(body)) + body
    sequence = lambda tag, *items: struct.pack("<HH2sHI", tag >> 16, tag & 0xFFFF, b"SQ", 0, sum(map(len, items))) + b"".join(items)
    concept = lambda s: sequence(0x0040A043, item(explicit(0x00080104, b"LO", s)))
    number = explicit(0x0040A010, b"CS", b"CONTAINS") + explicit(0x0040A040, b"CS", b"NUM ") + concept(b"Size") + sequence(0x0040A300, item(explicit(0x0040A30A, b"DS", b"12")))
    free = explicit(0x0040A010, b"CS", b"CONTAINS") + explicit(0x0040A040, b"CS", b"TEXT") + explicit(0x0040A160, b"UT"[:2], b"")
    root = explicit(0x0040A040, b"CS", b"CONTAINER ") + concept(b"Report") + sequence(0x0040A730, item(number), item(free[: -len(explicit(0x0040A160, b"UT", b""))]))
    assert rows("dicom-sr", b"\0" * 128 + b"DICM" + root) == [("0", "CONTAINER", "Report", None, None), ("1", "NUM", "Size", "12", "CONTAINS"), ("1", "TEXT", None, "[text omitted]", "CONTAINS")]
    open_item = struct.pack("<II", 0xE000FFFE, 0xFFFFFFFF) + explicit(0x00041430, b"CS", b"IMAGE ") + explicit(0x00041500, b"CS", b"A\\B ") + struct.pack("<II", 0xE00DFFFE, 0)
    records = sequence(0x00041220, item(explicit(0x00041430, b"CS", b"PATIENT ")), open_item)
    assert rows("dicomdir", b"\0" * 128 + b"DICM" + records) == [("record", "1", "PATIENT"), ("record", "4", "IMAGE A/B")]
