"""Writing PDF files: objects to bytes, and text to pages in one font."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

from paperloom.functions.cos import Name, Ref, Stream

# Letter-size pages, type of 10 points, lines at 1.05 of its height, margins of 40 points.
PAGE_WIDTH, PAGE_HEIGHT, FONT_SIZE, LINE_FACTOR, MARGIN = 612.0, 792.0, 10.0, 1.05, 40.0
#: All characters are as wide, in thousandths of the size.
CHARACTER_WIDTH = 600


@lru_cache(1 << 14)
def _name(value: str) -> bytes:
    out = bytearray(b"/")
    for b in value.encode("utf-8"):
        out += bytes([b]) if 0x21 <= b <= 0x7E and b not in b"#()<>[]{}/%" else b"#%02X" % b
    return bytes(out)


def write_value(value: Any) -> bytes:
    """An object as it stands in a file."""
    kind = type(value)  # the usual kinds first
    if kind is Ref:
        return b"%d %d R" % value
    if kind is Name:
        return _name(value)
    if kind is int:
        return b"%d" % value
    if kind is dict:
        return b"<<" + b"".join([_name(k) + b" " + write_value(v) + b" " for k, v in value.items()]) + b">>"
    if value is None:
        return b"null"
    if isinstance(value, bool):
        return b"true" if value else b"false"
    if isinstance(value, Ref):
        return b"%d %d R" % value
    if isinstance(value, Name):
        return _name(value)
    if isinstance(value, int):
        return b"%d" % value
    if isinstance(value, float):
        return f"{value:.5f}".rstrip("0").rstrip(".").encode() or b"0"
    if isinstance(value, str):
        raw = value.encode("latin-1") if all(ord(c) < 128 for c in value) else b"\xfe\xff" + value.encode("utf-16-be")
        return write_value(raw)
    if isinstance(value, bytes):
        return b"(" + value.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r") + b")"
    if isinstance(value, list):
        return b"[" + b" ".join(map(write_value, value)) + b"]"
    if isinstance(value, dict):
        return b"<<" + b"".join(_name(k) + b" " + write_value(v) + b" " for k, v in value.items()) + b">>"
    if isinstance(value, Stream):
        return write_value(value.dictionary | {"Length": len(value.raw)}) + b"\nstream\n" + value.raw + b"\nendstream"
    raise TypeError(type(value).__name__)


def write_file(objects: dict[int, Any], root: int, info: int | None = None, packed: bool = False) -> bytes:
    """A file of numbered objects, with a table, or with objects packed in a stream and a table stream."""
    out = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n")
    places: dict[int, tuple[int, int, int]] = {}
    loose = dict(objects)
    size = max(objects) + 1
    if packed:
        inner = {n: v for n, v in objects.items() if not isinstance(v, Stream)}
        loose = {n: v for n, v in objects.items() if isinstance(v, Stream)}
        heads, body = [], bytearray()
        for i, (n, v) in enumerate(inner.items()):
            heads.append(b"%d %d" % (n, len(body)))
            body += write_value(v) + b" "
            places[n] = (2, size, i)
        head = b" ".join(heads) + b" "
        loose[size] = Stream({"Type": Name("ObjStm"), "N": len(inner), "First": len(head), "Filter": Name("FlateDecode")}, zlib.compress(head + bytes(body)))
        size += 1
    for n, v in loose.items():
        places[n] = (1, len(out), 0)
        out += b"%d 0 obj\n" % n + write_value(v) + b"\nendobj\n"
    trailer: dict[str, Any] = {"Size": size, "Root": Ref(root, 0)} | ({"Info": Ref(info, 0)} if info else {})
    start = len(out)
    if packed:
        places[size] = (1, start, 0)
        rows = b"".join(bytes([places.get(n, (0, 0, 0))[0]]) + places.get(n, (0, 0, 0))[1].to_bytes(4, "big") + places.get(n, (0, 0, 0))[2].to_bytes(2, "big") for n in range(size + 1))
        table = Stream(trailer | {"Type": Name("XRef"), "Size": size + 1, "W": [1, 4, 2], "Filter": Name("FlateDecode")}, zlib.compress(rows))
        out += b"%d 0 obj\n" % size + write_value(table) + b"\nendobj\n"
    else:
        out += b"xref\n0 %d\n0000000000 65535 f \n" % size
        for n in range(1, size):
            out += b"%010d %05d n \n" % (places[n][1], 0) if n in places else b"0000000000 00000 f \n"
        out += b"trailer\n" + write_value(trailer) + b"\n"
    return bytes(out) + b"startxref\n%d\n%%%%EOF\n" % start


def lines_of(text: str) -> list[str]:
    """A text's lines, broken between words where they are wider than the page."""
    room = int((PAGE_WIDTH - 2 * MARGIN) / (CHARACTER_WIDTH / 1000 * FONT_SIZE))
    out = []
    for line in text.replace("\r\n", "\n").replace("\r", "\n").replace("\t", " ").split("\n"):
        row = ""
        for word in line.split(" "):
            while len(word) > room:
                if row:
                    out.append(row)
                    row = ""
                out.append(word[:room])
                word = word[room:]
            longer = f"{row} {word}" if row else word
            if len(longer) > room:
                out.append(row)
                longer = word
            row = longer
        out.append(row)
    return out


def text_to_pdf(text: str, info: dict[str, str] | None = None, packed: bool = False) -> bytes:
    """A file with a text's lines on as many pages as they take.

    ASCII is shown in one font; all other characters get codes in further
    fonts, up to 200 in each, whose maps to Unicode name them, so that every
    text comes back.
    """
    codes: dict[str, tuple[int, int]] = {}
    for c in dict.fromkeys(text):
        if c not in "\n\r\t" and not (" " <= c <= "~"):
            codes[c] = (1 + len(codes) // 200, 33 + len(codes) % 200)
    n_fonts = 1 + max((f for f, _ in codes.values()), default=0)
    per_page = int((PAGE_HEIGHT - 2 * MARGIN) / (FONT_SIZE * LINE_FACTOR))
    rows = lines_of(text)
    pages = [rows[i : i + per_page] for i in range(0, len(rows), per_page)] or [[]]
    objects: dict[int, Any] = {1: {"Type": Name("Catalog"), "Pages": Ref(2, 0)}}
    fonts = {}
    for f in range(n_fonts):
        number = 3 + 2 * f
        fonts[f"F{f}"] = Ref(number, 0)
        mapped = [(k, c) for c, (g, k) in codes.items() if g == f]
        body = b"".join(b"<%02X> <%s>\n" % (code, c.encode("utf-16-be", "surrogatepass").hex().encode()) for code, c in mapped)
        plain = b"<20> <7E> <0020>\n" if f == 0 else b""
        cmap = b"/CIDInit /ProcSet findresource begin begincmap 1 begincodespacerange <00> <FF> endcodespacerange\n"
        if mapped:
            cmap += b"%d beginbfchar\n" % len(mapped) + body + b"endbfchar\n"
        if plain:
            cmap += b"1 beginbfrange\n" + plain + b"endbfrange\n"
        objects[number] = {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Courier"), "Encoding": Name("WinAnsiEncoding"), "FirstChar": 32, "Widths": [CHARACTER_WIDTH] * 224, "ToUnicode": Ref(number + 1, 0)}
        objects[number + 1] = Stream({"Filter": Name("FlateDecode")}, zlib.compress(cmap + b"endcmap"))
    first = 3 + 2 * n_fonts
    kids = []
    for k, page in enumerate(pages):
        number = first + 2 * k
        kids.append(Ref(number, 0))
        objects[number] = {"Type": Name("Page"), "Parent": Ref(2, 0), "Contents": Ref(number + 1, 0)}
        objects[number + 1] = Stream({"Filter": Name("FlateDecode")}, zlib.compress(_content(page, codes)))
    objects[2] = {"Type": Name("Pages"), "Kids": kids, "Count": len(kids), "MediaBox": [0, 0, int(PAGE_WIDTH), int(PAGE_HEIGHT)], "Resources": {"Font": fonts}}
    about = None
    if info:
        about = first + 2 * len(pages)
        objects[about] = dict(info)
    return write_file(objects, 1, about, packed)


def _content(rows: list[str], codes: dict[str, tuple[int, int]]) -> bytes:
    out = bytearray(b"BT\n%g TL\n1 0 0 1 %g %g Tm\n" % (FONT_SIZE * LINE_FACTOR, MARGIN, PAGE_HEIGHT - MARGIN - FONT_SIZE))
    current = None
    for row in rows:
        run = bytearray()
        for c in row:
            font, k = codes.get(c, (0, None))
            if font != current:
                if run:
                    out += write_value(bytes(run)) + b" Tj\n"
                    run = bytearray()
                out += b"/F%d %g Tf\n" % (font, FONT_SIZE)
                current = font
            run.append(ord(c) if k is None else k)
        if run:
            out += write_value(bytes(run)) + b" Tj\n"
        out += b"T*\n"
    return bytes(out) + b"ET\n"


def texts_to_pdf(texts: DataFrame, key: str, text: str, packed: bool = False) -> DataFrame:
    """``path, content`` with a file for each row; null texts give a file with one empty page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = [text_to_pdf(t or "", packed=packed) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.binary())], names=["path", "content"])

    return texts.selectExpr(f"cast(`{key}` as string) path", f"`{text}` text").mapInArrow(run, "path string, content binary")
