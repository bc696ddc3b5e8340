"""PDF files as tables: documents, objects, pages, operations, glyphs, text and side tables.

Each reader parses a file in the task that holds its bytes and gives only what
its table needs; file contents are never shuffled. A file that cannot be read
is a row with status 'error' in the documents table and gives no rows in the
others, and a page that cannot be read gives none.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from operator import itemgetter
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.pandas.types import to_arrow_schema

from paperloom.functions.content import box_of, operations, page_content, page_glyphs, target_page, text_string, tree_entries
from paperloom.functions.cos import Damaged, Document, Name, Ref, Stream, open_document, version_of
from paperloom.functions.encryption import PERMISSIONS
from paperloom.functions.fonts import use_resources
from paperloom.functions.graphics import Painter, visible_layers
from paperloom.functions.layout import Config, assemble
from paperloom.functions.layout_full import Marks, read_page
from paperloom.functions.scalars import page_labels, parse_date

BATCH_ROWS = 5_000

_BOX = "struct<x0:float,y0:float,x1:float,y1:float>"
DOCUMENTS = (
    "path string, status string, error_class string, error_message string, version float, page_count int, encrypted boolean, recovered boolean, "
    "permissions map<string,boolean>, title string, author string, subject string, keywords string, creator string, producer string, created_at string, "
    "modified_at string, trapped string, custom map<string,string>, language string, page_mode string, page_layout string"
)
OBJECTS = "path string, obj_num int, gen int, type string, subtype string, value string, filters array<string>, raw_len bigint, decoded_len bigint"
PAGES = f"path string, page_no int, obj_num int, media_box {_BOX}, crop_box {_BOX}, bleed_box {_BOX}, trim_box {_BOX}, art_box {_BOX}, rotation int, user_unit float, label string, n_annotations int"
OPS = "path string, page_no int, seq bigint, op string, operands string"
GLYPHS = (
    "path string, page_no int, seq bigint, unicode string, a float, b float, tx float, ty float, height float, width float, space_width float, "
    "font_size float, font_name string, page_width float, page_height float, mc_tag string, mcid int, char_code int"
)
PAGE_TEXT = "path string, page_no int, text string"
FONTS = "path string, font_name string, subtype string, encoding string, embedded boolean, has_unicode_map boolean, flags int"
OUTLINE = "path string, item_no int, level int, title string, page_no int, count int, uri string"
ANNOTATIONS = f"path string, page_no int, annotation_no int, subtype string, rect {_BOX}, contents string, name string, flags int, action string, uri string, dest_page int"
FIELDS = "path string, full_name string, kind string, value string, flags int"
IMAGES = "path string, obj_num int, width int, height int, bits int, color_space string, suffix string, filters array<string>, content binary"
ATTACHMENTS = "path string, name string, description string, subtype string, content binary"
METADATA = "path string, packet string"
STRUCTURE = "path string, node_no int, parent_no int, level int, type string, title string, alt string, page_no int"
LAYERS = "path string, layer_no int, name string, visible boolean"
#: What the texts of the dictionaries have that a reader is after.
_FONT, _FONT_DESCRIPTOR, _ACTION, _FIELD = (re.compile(rb"/(?:%s)(?![^\0\t\n\f\r ()<>\[\]{}/%%])" % names) for names in (b"Font", b"FontDescriptor", b"A|OpenAction|Action", b"FT"))
ACTIONS = "path string, trigger string, type string, target string"


def read_files(spark: SparkSession, paths: str | list[str], pattern: str = "*.pdf") -> DataFrame:
    """``path, length, modified_at, content`` of the files at some paths."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(paths).selectExpr("path", "length", "modificationTime modified_at", "content")


def read_file_list(spark: SparkSession, path: str) -> DataFrame:
    """Files named in a text file, one path a line; blank lines do not count, missing files give no row.

    The list stays distributed: each task opens the files of its own lines.
    """
    schema = "path string, length bigint, modified_at timestamp, content binary"
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                local = name.removeprefix("file:") if "://" not in name else None
                system, place = fs.FileSystem.from_uri(name) if local is None else (fs.LocalFileSystem(), local)
                info = system.get_file_info(place)
                if info.type == fs.FileType.File:
                    with system.open_input_file(place) as source:
                        row = (name, info.size, info.mtime, source.read())
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, target)], names=target.names)

    listed = spark.read.text(path).select(F.trim("value").alias("path")).where("path <> ''").distinct()
    return listed.mapInArrow(run, schema)


def made(parts: DataFrame, make: Callable[..., list[tuple[str, bytes]]]) -> DataFrame:
    """``path, content``: files made of the columns of each row, given with their paths.

    The readers here make such files in the task that reads them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_contents(batch, make))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([c for _, c in found], pa.binary())], names=["path", "content"])

    files = parts.mapInArrow(run, "path string, content binary")
    files.made_of = parts, make
    return files


def _contents(batch: pa.RecordBatch, make: Callable[..., list[tuple[str, bytes]]] | None) -> Iterator[tuple[str, bytes]]:
    """Paths and contents of files, or of those that ``make`` makes of a batch's rows."""
    rows = zip(*(c.to_pylist() for c in batch.columns))
    return rows if make is None else (file for row in rows for file in make(*row))


def _handed(files: DataFrame) -> tuple[DataFrame, Callable[..., list[tuple[str, bytes]]] | None]:
    """What tasks get of files, and what makes the files of it."""
    return getattr(files, "made_of", None) or (files.select("path", "content"), None)


class _Asked:
    """Stands for files and notes what a reader would do with them."""

    def __init__(self) -> None:
        self.readers: list[tuple[StructType, Callable[[Document, str], Iterator[tuple]]]] = []


def together(files: DataFrame, password: str = "", **readers: tuple[Callable[..., Any], list[str]]) -> DataFrame:
    """``path, kind`` and a structure of the columns of each reader: the rows of several readers, of which each file is parsed once.

    A reader is given as its function and its columns besides ``path``; in a
    row of ``kind`` only the structure of that name is there.
    """
    asked, kinds = _Asked(), list(readers)
    for read, _ in readers.values():
        read(asked, password)
    schema = StructType.fromDDL("path string, kind string")
    picked = []
    for kind, (every, _), (_, columns) in zip(kinds, asked.readers, readers.values()):
        schema = schema.add(kind, StructType([every[c] for c in columns]))
        picked.append([(c, every.names.index(c)) for c in columns])
    target = to_arrow_schema(schema)
    handed, make = _handed(files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple] = []

        def out() -> pa.RecordBatch:
            arrays = [pa.array(list(c), f.type) for c, f in zip(zip(*block), target)] if block else [pa.array([], f.type) for f in target]
            block.clear()
            return pa.RecordBatch.from_arrays(arrays, names=target.names)

        for batch in batches:
            for path, content in _contents(batch, make):
                try:
                    document = open_document(content or b"", password)
                except (Damaged, RecursionError):
                    continue
                for k, (_, rows) in enumerate(asked.readers):
                    for row in rows(document, path):
                        found = {c: row[i] for c, i in picked[k]}
                        block.append((path, kinds[k], *(found if k == j else None for j in range(len(kinds)))))
                        if len(block) >= BATCH_ROWS:
                            yield out()
        yield out()

    return handed.mapInArrow(run, schema)


def _table(files: DataFrame, schema: str, rows: Callable[[Document, str], Iterator[tuple]], password: str = "", columns: list[str] | None = None) -> DataFrame:
    """Rows of each file; of ``columns``, if given, only these leave the reader."""
    every = StructType.fromDDL(schema)
    if isinstance(files, _Asked):
        return files.readers.append((every, rows))
    kept = StructType([every[c] for c in columns]) if columns is not None else every
    target = to_arrow_schema(kept)
    handed, make = _handed(files)
    picked = itemgetter(*(every.names.index(c) for c in columns)) if columns is not None and len(columns) > 1 else (lambda row, i=every.names.index(columns[0]): (row[i],)) if columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = [pa.array(list(c), f.type) for c, f in zip(zip(*block), target)] if block else [pa.array([], f.type) for f in target]
            block.clear()
            return pa.RecordBatch.from_arrays(columns, names=target.names)

        for batch in batches:
            for path, content in _contents(batch, make):
                try:
                    document = open_document(content or b"", password)
                except (Damaged, RecursionError):
                    continue
                for row in rows(document, path):
                    block.append(row if picked is None else picked(row))
                    if len(block) >= BATCH_ROWS:
                        yield out()
        yield out()

    return handed.mapInArrow(run, kept)


def _text(document: Document, value: Any) -> str | None:
    value = document.get(value)
    text = text_string(value) if isinstance(value, bytes) else str(value) if isinstance(value, (Name, int, float)) and not isinstance(value, bool) else None
    return None if text is None else text.encode("utf-8", "replace").decode("utf-8")


def _box(document: Document, holder: dict, key: str) -> dict | None:
    values = document.get(holder.get(key))
    numbers = [document.get(v) for v in values[:4]] if isinstance(values, list) else []
    if len(numbers) < 4 or not all(isinstance(v, (int, float)) for v in numbers):
        return None
    x0, y0, x1, y1 = map(float, numbers)
    return {"x0": min(x0, x1), "y0": min(y0, y1), "x1": max(x0, x1), "y1": max(y0, y1)}


def documents(files: DataFrame, password: str = "") -> DataFrame:
    """One row for each file, readable or not (`DOCUMENTS`)."""
    target = to_arrow_schema(StructType.fromDDL(DOCUMENTS))
    info_names = {"Title", "Author", "Subject", "Keywords", "Creator", "Producer", "CreationDate", "ModDate", "Trapped"}

    def row(path: str, content: bytes | None) -> tuple:
        try:
            d = open_document(content or b"", password)
            pages = d.pages()
        except (Damaged, RecursionError) as problem:
            return (path, "error", type(problem).__name__, str(problem)[:500], version_of(content or b""), *[None] * 17)
        info = d.get(d.trailer.get("Info"))
        info = info if isinstance(info, dict) else {}
        custom = {k: t for k, v in info.items() if k not in info_names and (t := _text(d, v)) is not None}
        bits = d.of(d.trailer.get("Encrypt"), "P") if d.encrypted else None
        allowed = {name: bits is None or bool(int(bits) >> (bit - 1) & 1) for name, bit in PERMISSIONS.items()}
        dates = [parse_date(t) if (t := _text(d, info.get(k))) else None for k in ("CreationDate", "ModDate")]
        one = lambda k: _text(d, info.get(k))
        c = d.catalog
        return (
            path, "ok", None, None, version_of(d.data), len(pages), d.encrypted, d.recovered, allowed, one("Title"), one("Author"), one("Subject"), one("Keywords"),
            one("Creator"), one("Producer"), dates[0], dates[1], one("Trapped"), custom, _text(d, c.get("Lang")), _text(d, c.get("PageMode")), _text(d, c.get("PageLayout")),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row(p, c) for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            columns = list(zip(*rows)) or [[]] * len(target)
            arrays = [pa.array([list(v.items()) if isinstance(v, dict) else v for v in c] if pa.types.is_map(f.type) else list(c), f.type) for c, f in zip(columns, target)]
            yield pa.RecordBatch.from_arrays(arrays, names=target.names)

    return files.select("path", "content").mapInArrow(run, DOCUMENTS)


def _plain(value: Any) -> Any:
    """An object as JSON can hold it: names with a slash, references as ``n g R``, bytes as their text."""
    if isinstance(value, Name):
        return "/" + value
    if isinstance(value, Ref):
        return f"{value.number} {value.generation} R"
    if isinstance(value, bytes):
        return text_string(value).encode("utf-8", "replace").decode("utf-8")
    if isinstance(value, list):
        return [_plain(v) for v in value]
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return _plain(value.dictionary) if isinstance(value, Stream) else value


def objects(files: DataFrame, password: str = "", columns: list[str] | None = None) -> DataFrame:
    """All numbered objects (`OBJECTS`, or only some ``columns``); ``value`` is JSON."""
    shown = columns is None or "value" in columns

    def rows(d: Document, path: str) -> Iterator[tuple]:
        for number in sorted(d.places):
            value = d.object(number)
            names = [n for n, _ in d.filters(value)] if isinstance(value, Stream) else None
            sizes = (len(value.raw), len(d.decoded(value))) if isinstance(value, Stream) else (None, None)
            kind, sub = (_text(d, d.of(value, k)) if isinstance(value, (dict, Stream)) else None for k in ("Type", "Subtype"))
            yield path, number, d.places[number][2] if d.places[number][0] == 1 else 0, kind, sub, json.dumps(_plain(value), ensure_ascii=False) if shown else None, names, *sizes

    return _table(files, OBJECTS, rows, password, columns)


def _page_numbers(d: Document) -> dict[int, int]:
    return {ref.number: i for i, (ref, _) in enumerate(d.pages(), 1) if ref is not None}


def pages(files: DataFrame, password: str = "") -> DataFrame:
    """Pages in document order with what they inherit (`PAGES`)."""

    def rows(d: Document, path: str) -> Iterator[tuple]:
        found = d.pages()
        labels = page_labels(_label_ranges(d), len(found))
        for i, (ref, page) in enumerate(found, 1):
            media = dict(zip(("x0", "y0", "x1", "y1"), box_of(d, page)))
            crop = _box(d, page, "CropBox") or media
            boxes = [_box(d, page, k) or crop for k in ("BleedBox", "TrimBox", "ArtBox")]
            turn, unit = d.get(page.get("Rotate")), d.get(page.get("UserUnit"))
            annotations = d.get(page.get("Annots"))
            yield (
                path, i, ref.number if ref else None, media, crop, *boxes, int(turn) % 360 if isinstance(turn, (int, float)) else 0,
                float(unit) if isinstance(unit, (int, float)) else 1.0, labels[i - 1], len(annotations) if isinstance(annotations, list) else 0,
            )

    return _table(files, PAGES, rows, password)


def _label_ranges(d: Document) -> list[tuple[int, str | None, str, int]]:
    """``(first page from 0, style, prefix, first number)`` of each range of labels."""
    out = []
    for first, entry in tree_entries(d, d.catalog.get("PageLabels")):
        if isinstance(first, int):
            start = d.of(entry, "St")
            out.append((first, str(s) if (s := d.of(entry, "S")) else None, _text(d, d.of(entry, "P")) or "", start if isinstance(start, int) else 1))
    return sorted(out)


def ops(files: DataFrame, password: str = "") -> DataFrame:
    """Operators of page contents with their operands as JSON (`OPS`)."""

    def rows(d: Document, path: str) -> Iterator[tuple]:
        for i, (_, page) in enumerate(d.pages(), 1):
            for seq, (op, operands) in enumerate(operations(page_content(d, page))):
                yield path, i, seq, op, json.dumps(_plain(operands), ensure_ascii=False)

    return _table(files, OPS, rows, password)


GRAPHICS = (
    "path string, page_no int, seq bigint, kind string, name string, rule string, stroked boolean, x0 double, y0 double, x1 double, y1 double, subpaths int, segments int, line_width double, "
    "line_cap int, line_join int, miter_limit double, dash array<double>, dash_phase double, flatness double, intent string, fill_space string, fill array<double>, fill_pattern string, "
    "stroke_space string, stroke array<double>, stroke_pattern string, fill_alpha double, stroke_alpha double, clip_x0 double, clip_y0 double, clip_x1 double, clip_y1 double"
)


def graphics(files: DataFrame, password: str = "") -> DataFrame:
    """Painted paths, shadings and images with their bounds, graphics state and clip (`GRAPHICS`)."""

    def rows(d: Document, path: str) -> Iterator[tuple]:
        for i, (_, page) in enumerate(d.pages(), 1):
            resources = d.get(page.get("Resources"))
            for seq, found in enumerate(Painter(d).run(page_content(d, page), resources if isinstance(resources, dict) else {})):
                yield path, i, seq, *found[:-1], *found.clip

    return _table(files, GRAPHICS, rows, password)


def _page_rows(d: Document, visible_only: bool = False) -> Iterator[tuple[int, list, tuple[float, float]]]:
    fonts: dict = {}
    hidden = frozenset(n for n, shows in visible_layers(d).items() if not shows) if visible_only else frozenset()
    for i, (_, page) in enumerate(d.pages(), 1):
        try:
            box = box_of(d, page)
            yield i, page_glyphs(d, page, fonts, hidden), (box[2], box[3])
        except (Damaged, RecursionError, ValueError, TypeError):
            continue


def glyphs(files: DataFrame, password: str = "", visible_only: bool = False, columns: list[str] | None = None, resources: str = "") -> DataFrame:
    """Glyphs of all pages in emission order (`GLYPHS`, or only some ``columns``); with ``visible_only`` without those of layers that do not show.

    ``resources`` is a folder of public CMap files and glyph names that all executors see (`fonts.use_resources`).
    """

    def rows(d: Document, path: str) -> Iterator[tuple]:
        use_resources(resources)
        for i, found, (width, height) in _page_rows(d, visible_only):
            for seq, g in enumerate(found):
                yield path, i, seq, g.unicode.encode("utf-8", "replace").decode(), g.a, g.b, g.tx, g.ty, g.height, g.width, g.space_width, g.font_size, g.font_name, width, height, g.mc_tag, g.mcid, g.char_code

    return _table(files, GLYPHS, rows, password, columns)


def page_text(files: DataFrame, config: Config | None = None, password: str = "", resources: str = "") -> DataFrame:
    """Text of each page that has any (`PAGE_TEXT`)."""

    def rows(d: Document, path: str) -> Iterator[tuple]:
        use_resources(resources)
        for i, found, (width, height) in _page_rows(d):
            text = assemble([(g.unicode, g.a, g.b, g.tx, g.ty, g.height, g.width, g.space_width, width, height) for g in found], config)
            if text:
                yield path, i, text.encode("utf-8", "replace").decode()

    return _table(files, PAGE_TEXT, rows, password)


def _text_of(d: Document, c: Config) -> str:
    parts = [assemble([(g.unicode, g.a, g.b, g.tx, g.ty, g.height, g.width, g.space_width, w, h) for g in found], c) for _, found, (w, h) in _page_rows(d)]
    return c.page_separator.join(p for p in parts if p).encode("utf-8", "replace").decode()


def document_text(files: DataFrame, config: Config | None = None, password: str = "", resources: str = "") -> DataFrame:
    """``path, status, n_pages, text`` of each file: the texts of its pages in order; an unreadable one has status 'error' and no text."""
    c = config or Config()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_resources(resources)
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    d = open_document(content or b"", password)
                    rows.append((path, "ok", len(d.pages()), _text_of(d, c)))
                except (Damaged, RecursionError):
                    rows.append((path, "error", None, None))
            columns = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.string()))], names=["path", "status", "n_pages", "text"])

    return files.select("path", "content").mapInArrow(run, "path string, status string, n_pages int, text string")


def fonts(files: DataFrame, password: str = "") -> DataFrame:
    """Font dictionaries of each file (`FONTS`)."""

    def rows(d: Document, path: str) -> Iterator[tuple]:
        for number in d.numbers_with(_FONT):
            value = d.object(number)
            if not isinstance(value, dict) or value.get("Type") != "Font" or str(value.get("Subtype")).startswith("CIDFont"):
                continue
            inner = value
            if isinstance(kids := d.of(value, "DescendantFonts"), list) and kids:
                inner = d.get(kids[0]) or value
            descriptor = d.of(inner, "FontDescriptor")
            encoding = d.of(value, "Encoding")
            name = str(encoding) if isinstance(encoding, Name) else _text(d, d.of(encoding, "BaseEncoding")) if isinstance(encoding, dict) else None
            embedded = any(d.of(descriptor, k) is not None for k in ("FontFile", "FontFile2", "FontFile3"))
            yield path, _text(d, value.get("BaseFont") or value.get("Name")), _text(d, value.get("Subtype")), name, embedded, d.of(value, "ToUnicode") is not None, d.of(descriptor, "Flags")

    return _table(files, FONTS, rows, password)


def _target_page(d: Document, dest: Any, numbers: dict[int, int]) -> int | None:
    """The page of a destination; remote ones give its number."""
    if (found := target_page(d, dest)) is not None:
        return numbers.get(found)
    value = d.get(dest)
    value = d.of(value, "D") if isinstance(value, dict) else value
    return value[0] + 1 if isinstance(value, list) and value and isinstance(value[0], int) else None


def outline(files: DataFrame, password: str = "") -> DataFrame:
    """Bookmarks in reading order with their depth and page (`OUTLINE`)."""

    def rows(d: Document, path: str) -> Iterator[tuple]:
        numbers, seen, n = _page_numbers(d), set(), 0
        stack = [(d.of(d.catalog.get("Outlines"), "First"), 1)]
        while stack:
            item, level = stack.pop()
            if not isinstance(item, dict) or id(item) in seen:
                continue
            seen.add(id(item))
            n += 1
            action = d.of(item, "A")
            dest = item.get("Dest") if item.get("Dest") is not None else d.of(action, "D")
            count = d.of(item, "Count")
            yield path, n, level, _text(d, item.get("Title")), _target_page(d, dest, numbers), count if isinstance(count, int) else 0, _text(d, d.of(action, "URI"))
            stack.append((d.of(item, "Next"), level))
            stack.append((d.of(item, "First"), level + 1))

    return _table(files, OUTLINE, rows, password)


def annotations(files: DataFrame, password: str = "") -> DataFrame:
    """Annotations of all pages with the action or page they lead to (`ANNOTATIONS`)."""

    def rows(d: Document, path: str) -> Iterator[tuple]:
        numbers = _page_numbers(d)
        for i, (_, page) in enumerate(d.pages(), 1):
            listed = d.get(page.get("Annots"))
            for k, entry in enumerate(listed if isinstance(listed, list) else []):
                a = d.get(entry)
                if not isinstance(a, dict):
                    continue
                action = d.of(a, "A")
                dest = a.get("Dest") if a.get("Dest") is not None else d.of(action, "D")
                flags = d.of(a, "F")
                yield path, i, k, _text(d, a.get("Subtype")), _box(d, a, "Rect"), _text(d, a.get("Contents")), _text(d, a.get("NM")), flags if isinstance(flags, int) else 0, _text(d, d.of(action, "S")), _text(d, d.of(action, "URI")), _target_page(d, dest, numbers)

    return _table(files, ANNOTATIONS, rows, password)


_FIELD_KINDS = {"Btn": "button", "Tx": "text", "Ch": "choice", "Sig": "signature"}


def _field_kind(kind: str | None, flags: int) -> str | None:
    if kind == "Btn":
        return "push" if flags >> 16 & 1 else "radio" if flags >> 15 & 1 else "checkbox"
    if kind == "Ch":
        return "combo" if flags >> 17 & 1 else "list"
    return _FIELD_KINDS.get(kind or "", "non-terminal" if kind is None else kind)


def fields(files: DataFrame, password: str = "") -> DataFrame:
    """Form fields that carry values, with full names and what they inherit (`FIELDS`)."""

    def rows(d: Document, path: str) -> Iterator[tuple]:
        seen: set[int] = set()
        top = d.of(d.catalog.get("AcroForm"), "Fields")
        stack = [(f, "", {}) for f in reversed(top if isinstance(top, list) else [])]
        while stack:
            entry, prefix, above = stack.pop()
            node = d.get(entry)
            if not isinstance(node, dict) or id(node) in seen:
                continue
            seen.add(id(node))
            have = above | {k: node[k] for k in ("FT", "Ff", "V") if k in node}
            own = _text(d, node.get("T"))
            name = f"{prefix}.{own}" if prefix and own else own or prefix
            kids = d.get(node.get("Kids"))
            named = [k for k in kids if isinstance(d.get(k), dict) and "T" in d.get(k)] if isinstance(kids, list) else []
            if named:
                stack.extend((k, name, have) for k in reversed(named))
                continue
            value = d.get(have.get("V"))
            flags = d.get(have.get("Ff"))
            flags = flags if isinstance(flags, int) else 0
            shown = json.dumps(_plain(value), ensure_ascii=False) if isinstance(value, (list, dict, Stream)) else _text(d, value)
            yield path, name, _field_kind(_text(d, have.get("FT")), flags), shown, flags

    return _table(files, FIELDS, rows, password)


def images(files: DataFrame, password: str = "") -> DataFrame:
    """Image objects, each once, with their data behind all filters but those of images (`IMAGES`)."""

    def rows(d: Document, path: str) -> Iterator[tuple]:
        for number in d.numbers_with():
            value = d.object(number)
            if not isinstance(value, Stream) or d.of(value, "Subtype") != "Image":
                continue
            names = [n for n, _ in d.filters(value)]
            suffix = {"DCTDecode": "jpg", "JPXDecode": "jp2"}.get(names[-1] if names else "", "png")
            space = d.of(value, "ColorSpace")
            shown = str(space) if isinstance(space, Name) else str(d.get(space[0])) if isinstance(space, list) and space else None
            sizes = [d.of(value, k) for k in ("Width", "Height", "BitsPerComponent")]
            yield path, number, *[s if isinstance(s, int) else None for s in sizes], shown, "png" if d.of(value, "Mask") is not None or d.of(value, "SMask") is not None else suffix, names, d.decoded(value)

    return _table(files, IMAGES, rows, password)


def attachments(files: DataFrame, password: str = "") -> DataFrame:
    """Embedded files (`ATTACHMENTS`); read them again with these readers for PDFs in PDFs."""

    def rows(d: Document, path: str) -> Iterator[tuple]:
        for key, value in tree_entries(d, d.of(d.catalog.get("Names"), "EmbeddedFiles")):
            spec = d.get(value)
            stream = d.of(d.of(spec, "EF"), "UF", "F")
            if isinstance(stream, Stream):
                name = _text(d, d.of(spec, "UF", "F")) or (text_string(key) if isinstance(key, bytes) else None)
                yield path, name, _text(d, d.of(spec, "Desc")), _text(d, stream.dictionary.get("Subtype")), d.decoded(stream)

    return _table(files, ATTACHMENTS, rows, password)


def _attached() -> Callable[[Document, str], Iterator[tuple]]:
    """What `attachments` does with a file."""
    asked = _Asked()
    attachments(asked)
    return asked.readers[0][1]


def _and_embedded(path: str | None, content: bytes | None, inner: Callable[[Document, str], Iterator[tuple]], password: str, depth: int) -> Iterator[tuple[str | None, int, bytes | None, Document | None]]:
    """A file and the PDF files in it, level by level: path, level, bytes, and what was read of them."""
    level = [(path, content)]
    for n in range(depth + 1):
        deeper = []
        for place, data in level:
            try:
                document = open_document(data or b"", password)
            except (Damaged, RecursionError):
                document = None
            yield place, n, data, document
            if document is not None and place is not None and n < depth:
                deeper += [("!".join(x for x in (place, name) if x is not None), found) for _, name, _, _, found in inner(document, place) if found.startswith(b"%PDF")]
        level = deeper


def with_embedded(files: DataFrame, password: str = "", depth: int = 3) -> DataFrame:
    """``path, origin, level, place, content``: files and the PDF files embedded in them, down to a depth.

    ``origin`` is the outermost file's path, ``path`` names the way through the
    names of embedded files, ``place`` puts them in order behind it. All is
    taken out in the task that holds the outermost file.
    """

    inner = _attached()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for origin, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [(path, origin, n, path, data) for path, n, data, _ in _and_embedded(origin, content, inner, password, depth)]
                kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["path", "origin", "level", "place", "content"])

    return files.select("path", "content").mapInArrow(run, "path string, origin string, level int, place string, content binary")


def text_with_embedded(files: DataFrame, config: Config | None = None, password: str = "", depth: int = 3) -> DataFrame:
    """``path, text`` of each file, the texts of embedded files behind its own. Only texts leave the task that holds the file."""
    c, inner = config or Config(), _attached()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for origin, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for place, _, _, document in _and_embedded(origin, content, inner, password, depth):
                    try:
                        if document is not None and place is not None:
                            rows.append((origin, place, _text_of(document, c)))
                    except (Damaged, RecursionError):
                        continue
            columns = list(zip(*rows)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in columns], names=["path", "place", "text"])

    parts = files.select("path", "content").mapInArrow(run, "path string, place string, text string")
    ordered = F.array_sort(F.collect_list(F.struct("place", "text")))
    return parts.groupBy("path").agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "\n").alias("text"))


def metadata(files: DataFrame, password: str = "") -> DataFrame:
    """XMP packets of files as text (`METADATA`)."""

    def rows(d: Document, path: str) -> Iterator[tuple]:
        stream = d.get(d.catalog.get("Metadata"))
        if isinstance(stream, Stream):
            yield path, d.decoded(stream).decode("utf-8", "replace")

    return _table(files, METADATA, rows, password)


def structure(files: DataFrame, password: str = "") -> DataFrame:
    """The structure tree's elements in order with their parents (`STRUCTURE`)."""

    def rows(d: Document, path: str) -> Iterator[tuple]:
        numbers, seen, n = _page_numbers(d), set(), 0
        stack: list[tuple[Any, int | None, int]] = [(d.of(d.catalog.get("StructTreeRoot"), "K"), None, 0)]
        while stack:
            value, parent, level = stack.pop()
            value = d.get(value)
            if isinstance(value, list):
                stack.extend((v, parent, level) for v in reversed(value))
            elif isinstance(value, dict) and value.get("S") is not None and id(value) not in seen:
                seen.add(id(value))
                n += 1
                page = value.get("Pg")
                yield path, n, parent, level, _text(d, value.get("S")), _text(d, value.get("T")), _text(d, value.get("Alt")), numbers.get(page.number) if isinstance(page, Ref) else None
                stack.append((value.get("K"), n, level + 1))

    return _table(files, STRUCTURE, rows, password)


def layers(files: DataFrame, password: str = "") -> DataFrame:
    """Optional content groups and whether they show at first (`LAYERS`)."""

    def rows(d: Document, path: str) -> Iterator[tuple]:
        properties = d.catalog.get("OCProperties")
        config = d.of(properties, "D")
        base = d.of(config, "BaseState") != "OFF"
        on, off = (set(x for x in d.of(config, k) or [] if isinstance(x, Ref)) for k in ("ON", "OFF"))
        groups = d.of(properties, "OCGs")
        for i, group in enumerate(groups if isinstance(groups, list) else []):
            yield path, i, _text(d, d.of(group, "Name")), group in on or base and group not in off

    return _table(files, LAYERS, rows, password)


def actions(files: DataFrame, password: str = "") -> DataFrame:
    """Actions that objects name, with their target (`ACTIONS`)."""

    def rows(d: Document, path: str) -> Iterator[tuple]:
        for number in d.numbers_with(_ACTION):
            value = d.object(number)
            holders = [(f"{number}.{k}", d.get(value[k])) for k in ("A", "OpenAction") if isinstance(value, dict) and k in value]
            if isinstance(value, dict) and value.get("Type") == "Action":
                holders.append((str(number), value))
            for trigger, action in holders:
                chain, seen = [action], set()
                while chain:
                    one = d.get(chain.pop(0))
                    if not isinstance(one, dict) or one.get("S") is None or id(one) in seen:
                        continue
                    seen.add(id(one))
                    target = d.of(one, "URI", "JS", "F", "N", "D")
                    shown = d.decoded(target).decode("latin-1") if isinstance(target, Stream) else _text(d, target) if not isinstance(target, (list, dict)) else json.dumps(_plain(target))
                    yield path, trigger, _text(d, one.get("S")), shown
                    more = d.of(one, "Next")
                    chain += more if isinstance(more, list) else [more]

    return _table(files, ACTIONS, rows, password)


SIGNATURES = "path string, field string, filter string, sub_filter string, signer string, reason string, location string, signed_at string, byte_range array<bigint>, covers_file boolean"
BEADS = f"path string, thread_no int, bead_no int, title string, page_no int, rect {_BOX}"
DESTINATIONS = "path string, name string, page_no int, kind string, arguments array<double>"
VIEWER = "path string, preferences map<string,string>"
FDF_FIELDS = "path string, full_name string, value string"


def signatures(files: DataFrame, password: str = "") -> DataFrame:
    """Signature fields with what they tell of themselves; nothing is verified (`SIGNATURES`)."""

    def rows(d: Document, path: str) -> Iterator[tuple]:
        for number in d.numbers_with(_FIELD):
            field = d.object(number)
            if not isinstance(field, dict) or d.of(field, "FT") != "Sig" or not isinstance(value := d.of(field, "V"), dict):
                continue
            span = d.of(value, "ByteRange")
            span = [d.get(v) for v in span] if isinstance(span, list) else []
            span = span if all(isinstance(v, int) for v in span) else []
            when = _text(d, value.get("M"))
            whole = len(span) == 4 and span[0] == 0 and span[2] + span[3] == len(d.data)
            yield path, _text(d, field.get("T")), *(_text(d, value.get(k)) for k in ("Filter", "SubFilter", "Name", "Reason", "Location")), parse_date(when) if when else None, span, whole

    return _table(files, SIGNATURES, rows, password)


def beads(files: DataFrame, password: str = "") -> DataFrame:
    """Beads of article threads in order (`BEADS`)."""

    def rows(d: Document, path: str) -> Iterator[tuple]:
        numbers = _page_numbers(d)
        threads = d.get(d.catalog.get("Threads"))
        for t, entry in enumerate(threads if isinstance(threads, list) else []):
            title = _text(d, d.of(d.of(entry, "I"), "Title"))
            bead, seen, n = d.of(entry, "F"), set(), 0
            while isinstance(bead, dict) and id(bead) not in seen:
                seen.add(id(bead))
                page = bead.get("P")
                yield path, t, n, title, numbers.get(page.number) if isinstance(page, Ref) else None, _box(d, bead, "R")
                bead, n = d.of(bead, "N"), n + 1

    return _table(files, BEADS, rows, password)


def destinations(files: DataFrame, password: str = "") -> DataFrame:
    """Named destinations with their kind and arguments (`DESTINATIONS`)."""

    def rows(d: Document, path: str) -> Iterator[tuple]:
        numbers = _page_numbers(d)
        old = d.get(d.catalog.get("Dests"))
        named = list(old.items()) if isinstance(old, dict) else []
        named += [(text_string(k), v) for k, v in tree_entries(d, d.of(d.catalog.get("Names"), "Dests")) if isinstance(k, bytes)]
        for name, value in named:
            value = d.get(value)
            value = d.of(value, "D") if isinstance(value, dict) else value
            if isinstance(value, list) and value:
                arguments = [d.get(v) for v in value[2:]]
                yield path, str(name), _target_page(d, value, numbers), _text(d, value[1]) if len(value) > 1 else None, [float(v) if isinstance(v, (int, float)) else None for v in arguments]

    return _table(files, DESTINATIONS, rows, password)


def viewer_preferences(files: DataFrame, password: str = "") -> DataFrame:
    """What files ask of viewers (`VIEWER`)."""

    def rows(d: Document, path: str) -> Iterator[tuple]:
        found = d.get(d.catalog.get("ViewerPreferences"))
        if isinstance(found, dict):
            yield path, [(k, json.dumps(_plain(d.get(v)))) for k, v in found.items()]

    return _table(files, VIEWER, rows, password)


def fdf_fields(files: DataFrame) -> DataFrame:
    """Fields of form data files (`FDF_FIELDS`), those with values or without kids."""

    def rows(d: Document, path: str) -> Iterator[tuple]:
        top = d.of(d.catalog.get("FDF"), "Fields")
        stack = [(f, "") for f in reversed(top if isinstance(top, list) else [])]
        seen: set[int] = set()
        while stack:
            entry, prefix = stack.pop()
            node = d.get(entry)
            if not isinstance(node, dict) or id(node) in seen:
                continue
            seen.add(id(node))
            name = ".".join(filter(None, (prefix, _text(d, node.get("T")))))
            kids, value = d.get(node.get("Kids")), d.get(node.get("V"))
            if value is not None or not isinstance(kids, list):
                yield path, name, json.dumps(_plain(value), ensure_ascii=False) if isinstance(value, (list, dict, Stream)) else _text(d, value)
            stack.extend((k, name) for k in reversed(kids if isinstance(kids, list) else []))

    return _table(files, FDF_FIELDS, rows)


def readable(documents_table: DataFrame) -> DataFrame:
    """Documents that were read and allow their text to be taken out."""
    return documents_table.where((F.col("status") == "ok") & F.coalesce(F.col("permissions")["extract"], F.lit(True)))


def between_bookmarks(texts: DataFrame, bookmarks: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Pages from the bookmark titled ``start`` to that titled ``end``; a title that is missing in a file sets no bound, one that leads to no page gives no text."""
    page = lambda title: F.min(F.when(F.col("title") == title, F.coalesce("page_no", F.lit(-1)))) if title is not None else F.lit(None).cast("int")
    bounds = bookmarks.groupBy("path").agg(page(start).alias("_from"), page(end).alias("_to"))
    rows = texts.join(bounds, "path", "left").where("coalesce(_from, 0) >= 0 and coalesce(_to, 0) >= 0")
    return rows.where((F.col("page_no") >= F.coalesce("_from", F.lit(1))) & (F.col("page_no") <= F.coalesce("_to", F.lit(2**31 - 1)))).drop("_from", "_to")


def marked_text(glyph_table: DataFrame) -> DataFrame:
    """``path, page_no, mc_tag, mcid, text``: text of marked content in emission order."""
    run = F.array_sort(F.collect_list(F.struct("seq", "unicode")))
    return glyph_table.where("mcid is not null").groupBy("path", "page_no", "mc_tag", "mcid").agg(F.array_join(F.transform(run, lambda g: g["unicode"]), "").alias("text"))


def of_kinds(annotation_table: DataFrame, *subtypes: str) -> DataFrame:
    """Annotations of some kinds."""
    return annotation_table.where(F.col("subtype").isin(*subtypes))


def link_texts(annotation_table: DataFrame, glyph_table: DataFrame) -> DataFrame:
    """``path, page_no, uri, text``: what stands under each link that leads to an address.

    Links and glyphs meet by page; the rectangle is then a filter, so a page's
    links times its glyphs is the most that one page gives.
    """
    links = annotation_table.where("subtype = 'Link' and uri is not null").select("path", "page_no", "annotation_no", "uri", "rect")
    inside = (F.col("tx") >= F.col("rect.x0")) & (F.col("tx") < F.col("rect.x1")) & (F.col("ty") >= F.col("rect.y0")) & (F.col("ty") < F.col("rect.y1"))
    run = F.array_sort(F.collect_list(F.struct("seq", "unicode")))
    found = links.join(glyph_table.select("path", "page_no", "seq", "unicode", "tx", "ty"), ["path", "page_no"]).where(inside)
    return found.groupBy("path", "page_no", "annotation_no", "uri").agg(F.array_join(F.transform(run, lambda g: g["unicode"]), "").alias("text")).drop("annotation_no")


def page_text_full(files: DataFrame, marks: Marks | None = None, password: str = "") -> DataFrame:
    """Text of every page by the second way of reading (`layout_full`), with its beads as articles (`PAGE_TEXT`)."""

    def rows(d: Document, path: str) -> Iterator[tuple]:
        listed = dict(enumerate((page for _, page in d.pages()), 1))
        for i, found, (width, height) in _page_rows(d):
            chain = d.get(listed[i].get("B"))
            boxes = [_box(d, b, "R") if isinstance(b := d.get(ref), dict) else None for ref in (chain if isinstance(chain, list) else [])]
            rectangles = [None if b is None else (b["x0"], height - b["y1"], b["x1"], height - b["y0"]) for b in boxes]
            glyph_rows = [(g.unicode, g.a, g.b, g.tx, g.ty, g.height, g.width, g.space_width, width, height, g.font_name, g.font_size) for g in found]
            yield path, i, read_page(glyph_rows, rectangles, marks).encode("utf-8", "replace").decode()

    return _table(files, PAGE_TEXT, rows, password)


CATALOGS = "path string, version string, language string, page_mode string, page_layout string, base_uri string, marked boolean, output_intents array<string>, entries array<string>"
FONT_FILES = "path string, font_name string, kind string, content binary"
SHOWN = "path string, page_no int, seq bigint, text string"


def catalogs(files: DataFrame, password: str = "") -> DataFrame:
    """What catalogues tell, and which entries they have (`CATALOGS`)."""

    def rows(d: Document, path: str) -> Iterator[tuple]:
        c = d.catalog
        intents = d.get(c.get("OutputIntents"))
        kinds = [t for i in intents if (t := _text(d, d.of(i, "OutputConditionIdentifier", "S")))] if isinstance(intents, list) else []
        yield path, *(_text(d, c.get(k)) for k in ("Version", "Lang", "PageMode", "PageLayout")), _text(d, d.of(c.get("URI"), "Base")), d.of(c.get("MarkInfo"), "Marked") is True, kinds, sorted(c)

    return _table(files, CATALOGS, rows, password)


def font_files(files: DataFrame, password: str = "") -> DataFrame:
    """Embedded font programs, each descriptor's once (`FONT_FILES`)."""

    def rows(d: Document, path: str) -> Iterator[tuple]:
        for number in d.numbers_with(_FONT_DESCRIPTOR):
            descriptor = d.object(number)
            if isinstance(descriptor, dict) and descriptor.get("Type") == "FontDescriptor":
                for key, kind in (("FontFile", "type1"), ("FontFile2", "truetype"), ("FontFile3", "cff")):
                    if isinstance(stream := d.of(descriptor, key), Stream):
                        yield path, _text(d, descriptor.get("FontName")), kind, d.decoded(stream)

    return _table(files, FONT_FILES, rows, password)


def shown_operands(files: DataFrame, password: str = "") -> DataFrame:
    """Operands of the operators that show text, one byte a character, without fonts (`SHOWN`)."""

    def rows(d: Document, path: str) -> Iterator[tuple]:
        for i, (_, page) in enumerate(d.pages(), 1):
            for seq, (op, operands) in enumerate(operations(page_content(d, page))):
                if op in ("Tj", "TJ", "'", '"'):
                    parts = operands[0] if op == "TJ" and operands and isinstance(operands[0], list) else operands
                    text = "".join(text_string(p) for p in parts if isinstance(p, bytes))
                    yield path, i, seq, text.encode("utf-8", "replace").decode()

    return _table(files, SHOWN, rows, password)
