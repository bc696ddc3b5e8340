"""New PDF files from the pages of others: extracting, splitting, merging, rewriting, encrypting, images to pages."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.content import after_image, target_page
from paperloom.functions.cos import Damaged, Document, Keyword, Lexer, Name, Ref, Stream, open_document
from paperloom.functions.encryption import _PADDING, PERMISSIONS, rc4
from paperloom.sources.pdf_writer import write_file, write_value

_ATOMS = {Name, bytes, int, float, bool, str, type(None)}
#: Members of a page that lead to other pages or to the whole file.
_LEADING = {"Parent", "B", "StructParents"}


class Builder:
    """Collects objects of several files under new numbers; an object used twice is copied once."""

    def __init__(self) -> None:
        self.objects: dict[int, Any] = {1: None, 2: None}
        self.kids: list[Ref] = []
        self.fields: list[Ref] = []
        self.bookmarks: list[tuple[int, Any, Ref | None, Any]] = []  # level, title, page, action
        self._last = 2

    def number(self) -> int:
        self._last += 1
        self.objects[self._last] = None
        return self._last

    def add_pages(self, document: Document, numbers: Iterable[int] | None = None, decode: bool = False) -> None:
        """Append a file's pages, all or those numbered from 1; unknown numbers are left out."""
        pages = document.pages()
        chosen = range(1, len(pages) + 1) if numbers is None else [n for n in numbers if 1 <= n <= len(pages)]
        copied: dict[int, int] = {}
        # pages that others of the file lead to become the new pages, or null if they are left out
        places = {ref.number: self.number() for n, (ref, _) in enumerate(pages, 1) if ref is not None and n in set(chosen)}
        left_out = {ref.number for ref, _ in pages if ref is not None} - set(places)
        queue: list[tuple[int, Any]] = []

        def copy(value: Any) -> Any:
            if type(value) in _ATOMS:
                return value
            if isinstance(value, Ref):
                if value.number in places:
                    return Ref(places[value.number], 0)
                if value.number in left_out:
                    return None
                if value.number not in copied:
                    copied[value.number] = self.number()
                    queue.append((copied[value.number], document.object(value.number)))
                return Ref(copied[value.number], 0)
            if isinstance(value, list):
                return [copy(v) for v in value]
            if isinstance(value, dict):
                return {k: copy(v) for k, v in value.items() if k != "Parent" or "T" in value}
            if isinstance(value, Stream):
                members = {k: v for k, v in value.dictionary.items() if k != "Length"}
                raw = value.raw
                if decode and (plain := document.decoded(value)) is not value.raw:
                    members = {k: v for k, v in members.items() if k not in ("Filter", "DecodeParms", "F", "DP")}
                    raw = plain
                return Stream(copy(members), raw)
            return value

        for n in chosen:
            ref, page = pages[n - 1]
            place = places[ref.number] if ref is not None else self.number()
            self.objects[place] = {k: copy(v) for k, v in page.items() if k not in _LEADING} | {"Type": Name("Page"), "Parent": Ref(2, 0)}
            self.kids.append(Ref(place, 0))
        form = document.of(document.catalog, "AcroForm")
        for field in document.of(form, "Fields") or []:
            if isinstance(field, Ref):
                self.fields.append(copy(field))
        for level, item in _bookmarks(document):
            action = document.of(item, "A")
            target = target_page(document, item.get("Dest") if item.get("Dest") is not None else document.of(action, "D"))
            place = places.get(target) if target is not None else None
            if target is None or place is not None:  # one that leads to a page that is left out goes as well
                self.bookmarks.append((level, copy(item.get("Title")), Ref(place, 0) if place is not None else None, copy(action) if target is None and isinstance(action, dict) else None))
        while queue:
            place, value = queue.pop()
            self.objects[place] = copy(value)

    def _outline(self) -> Ref | None:
        """Objects of all bookmarks; one whose parent is gone moves up."""
        if not self.bookmarks:
            return None
        root = self.number()
        kids: dict[int, list[int]] = {root: []}
        above = [(0, root)]
        for level, title, page, action in self.bookmarks:
            while above[-1][0] >= level:
                above.pop()
            place, parent = self.number(), above[-1][1]
            self.objects[place] = {"Title": title, "Parent": Ref(parent, 0)} | ({"Dest": [page, Name("Fit")]} if page else {}) | ({"A": action} if action else {})
            kids[parent].append(place)
            kids[place] = []
            above.append((level, place))
        for parent, own in kids.items():
            holder = self.objects[parent] if parent != root else {"Type": Name("Outlines")}
            if own:
                holder |= {"First": Ref(own[0], 0), "Last": Ref(own[-1], 0), "Count": len(own)}
            for a, b in zip(own, own[1:]):
                self.objects[a]["Next"], self.objects[b]["Prev"] = Ref(b, 0), Ref(a, 0)
            self.objects[parent] = holder
        return Ref(root, 0)

    def bytes(self, packed: bool = False, info: dict[str, str] | None = None) -> bytes:
        outline = self._outline()
        self.objects[1] = {"Type": Name("Catalog"), "Pages": Ref(2, 0)} | ({"AcroForm": {"Fields": self.fields}} if self.fields else {}) | ({"Outlines": outline} if outline else {})
        self.objects[2] = {"Type": Name("Pages"), "Kids": self.kids, "Count": len(self.kids)}
        about = None
        if info:
            about = self.number()
            self.objects[about] = dict(info)
        return write_file(self.objects, 1, about, packed)


def _bookmarks(document: Document) -> Iterator[tuple[int, dict]]:
    """A file's bookmarks in order with their level from 1."""
    stack, seen = [(document.of(document.catalog.get("Outlines"), "First"), 1)], set()
    while stack:
        item, level = stack.pop()
        if isinstance(item, dict) and id(item) not in seen:
            seen.add(id(item))
            yield level, item
            stack.append((document.of(item, "Next"), level))
            stack.append((document.of(item, "First"), level + 1))


def without_pages(data: bytes, numbers: Iterable[int], password: str = "") -> bytes:
    """A file without some of its pages."""
    document, gone = open_document(data, password), set(numbers)
    builder = Builder()
    builder.add_pages(document, [n for n in range(1, len(document.pages()) + 1) if n not in gone])
    return builder.bytes()


def with_urls(data: bytes, replaced: dict[str, str], password: str = "") -> bytes:
    """A file whose links to some addresses lead to others."""
    builder = Builder()
    builder.add_pages(open_document(data, password))

    def change(value: Any) -> None:
        if isinstance(value, dict):
            address = value.get("URI")
            if value.get("S") == "URI" and isinstance(address, bytes) and (new := replaced.get(address.decode("latin-1"))) is not None:
                value["URI"] = new.encode("latin-1")
            for inner in value.values():
                change(inner)
        elif isinstance(value, list):
            for inner in value:
                change(inner)
        elif isinstance(value, Stream):
            change(value.dictionary)

    for value in builder.objects.values():
        change(value)
    for _, _, _, action in builder.bookmarks:
        change(action)
    return builder.bytes()


def content_without_text(content: bytes) -> bytes:
    """A content stream without what shows text; all else stands as it is."""
    out, lexer, start = [], Lexer(content, 0, references=False), 0
    while True:
        try:
            value = lexer.read()
        except EOFError:
            break
        except ValueError:
            lexer.at += 1
            continue
        if isinstance(value, Keyword) and value not in (b"]", b">>", b"}", b"{", b")", b">"):
            if value == b"BI":
                lexer.at = after_image(content, lexer.at)
            if value not in (b"Tj", b"TJ", b"'", b'"'):
                out.append(content[start : lexer.at])
            start = lexer.at
    return b" ".join(out)


def without_text(data: bytes, password: str = "") -> bytes:
    """A file whose pages and forms show no text."""
    document = open_document(data, password)
    builder = Builder()
    builder.add_pages(document, decode=True)
    holders = [v for v in builder.objects.values() if isinstance(v, Stream) and v.dictionary.get("Subtype") == "Form"]
    for page in (v for v in builder.objects.values() if isinstance(v, dict) and v.get("Type") == "Page"):
        parts = page.get("Contents")
        holders += [builder.objects.get(r.number) for r in (parts if isinstance(parts, list) else [parts]) if isinstance(r, Ref)]
    for stream in {id(h): h for h in holders if isinstance(h, Stream)}.values():
        stream.raw = content_without_text(stream.raw)
    return builder.bytes()


def extract_pages(data: bytes, numbers: Iterable[int], password: str = "") -> bytes:
    """A file of some pages of another, in the order given."""
    builder = Builder()
    builder.add_pages(open_document(data, password), list(numbers))
    return builder.bytes()


def merge_files(files: Iterable[bytes], packed: bool = False) -> bytes:
    """One file of all pages of others, in order, with their form fields and bookmarks."""
    builder = Builder()
    for data in files:
        builder.add_pages(open_document(data))
    return builder.bytes(packed)


def split_file(data: bytes, every: int, start: int = 1, end: int | None = None) -> list[bytes]:
    """Files of ``every`` pages each, of pages ``start..end``."""
    document = open_document(data)
    last = min(len(document.pages()), end or 1 << 30)
    out = []
    for first in range(max(1, start), last + 1, every):
        builder = Builder()
        builder.add_pages(document, range(first, min(first + every, last + 1)))
        out.append(builder.bytes())
    return out


def rewrite(data: bytes, decode: bool = False, packed: bool = False, password: str = "") -> bytes:
    """The file written anew: repaired and decrypted, on demand with decoded streams or with packed objects."""
    builder = Builder()
    builder.add_pages(open_document(data, password), decode=decode)
    return builder.bytes(packed)


def encrypt(data: bytes, user: str = "", owner: str = "", allowed: set[str] | None = None) -> bytes:
    """The file with strings and streams sealed by RC4 with keys of 128 bits; ``allowed`` names what users may do, all if None."""
    builder = Builder()
    builder.add_pages(open_document(data))
    plain = builder.bytes()
    document = open_document(plain)
    first = hashlib.md5(plain).digest()
    bits = -1
    if allowed is not None:
        for name, bit in PERMISSIONS.items():
            if name not in allowed:
                bits &= ~(1 << (bit - 1))
    bits &= ~3
    padded = lambda word: (word.encode("latin-1", "replace") + _PADDING)[:32]
    key = hashlib.md5(padded(owner or user)).digest()
    for _ in range(50):
        key = hashlib.md5(key).digest()
    sealed_owner = padded(user)
    for i in range(20):
        sealed_owner = rc4(bytes(b ^ i for b in key), sealed_owner)
    key = hashlib.md5(padded(user) + sealed_owner + (bits & 0xFFFFFFFF).to_bytes(4, "little") + first).digest()
    for _ in range(50):
        key = hashlib.md5(key).digest()
    check = hashlib.md5(_PADDING + first).digest()
    for i in range(20):
        check = rc4(bytes(b ^ i for b in key), check)

    def seal(value: Any, number: int) -> Any:
        secret = hashlib.md5(key + number.to_bytes(3, "little") + b"\0\0").digest()
        if isinstance(value, bytes):
            return rc4(secret, value)
        if isinstance(value, list):
            return [seal(v, number) for v in value]
        if isinstance(value, dict):
            return {k: seal(v, number) for k, v in value.items()}
        if isinstance(value, Stream):
            return Stream(seal(value.dictionary, number), rc4(secret, value.raw))
        return value

    objects = {n: seal(document.object(n), n) for n in document.places}
    out = write_file(objects, document.trailer["Root"].number)
    lock = {"Filter": Name("Standard"), "V": 2, "R": 3, "Length": 128, "P": bits, "O": sealed_owner, "U": check + bytes(16)}
    return out.replace(b"trailer\n<<", b"trailer\n<</Encrypt " + write_value(lock) + b"/ID " + write_value([first, first]), 1)


def _jpeg_size(data: bytes) -> tuple[int, int, int]:
    """Width, height and number of colours."""
    at = 2
    while at + 9 < len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        kind = data[at + 1]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big"), data[at + 9]
        at += 2 + (0 if kind == 0xFF else int.from_bytes(data[at + 2 : at + 4], "big"))
    raise Damaged("no JPEG")


def images_to_pdf(images: Iterable[bytes]) -> bytes:
    """A page for each JPEG image, of the image's size; the images' data are taken as they are."""
    builder = Builder()
    for data in images:
        width, height, colors = _jpeg_size(data)
        picture, content, page = builder.number(), builder.number(), builder.number()
        space = Name({1: "DeviceGray", 3: "DeviceRGB", 4: "DeviceCMYK"}.get(colors, "DeviceRGB"))
        builder.objects[picture] = Stream({"Type": Name("XObject"), "Subtype": Name("Image"), "Width": width, "Height": height, "BitsPerComponent": 8, "ColorSpace": space, "Filter": Name("DCTDecode")}, data)
        builder.objects[content] = Stream({}, b"q %d 0 0 %d 0 0 cm /I Do Q" % (width, height))
        builder.objects[page] = {"Type": Name("Page"), "Parent": Ref(2, 0), "MediaBox": [0, 0, width, height], "Contents": Ref(content, 0), "Resources": {"XObject": {"I": Ref(picture, 0)}}}
        builder.kids.append(Ref(page, 0))
    return builder.bytes()


def overlay(data: bytes, stamps: dict[int, bytes], background: bool = False) -> bytes:
    """The file with the first page of another file laid over (or under) the pages numbered in ``stamps``."""
    builder = Builder()
    document = open_document(data)
    builder.add_pages(document)
    for number, stamp in stamps.items():
        if not 1 <= number <= len(builder.kids):
            continue
        page = builder.objects[builder.kids[number - 1].number]
        other = open_document(stamp)
        before = len(builder.kids)
        builder.add_pages(other, [1])
        source = builder.objects[builder.kids.pop().number] if len(builder.kids) > before else {}
        from paperloom.functions.content import box_of, page_content

        body = page_content(other, other.pages()[0][1])
        form, save, show = builder.number(), builder.number(), builder.number()
        builder.objects[form] = Stream({"Type": Name("XObject"), "Subtype": Name("Form"), "BBox": list(box_of(other, other.pages()[0][1])), "Resources": source.get("Resources") or {}}, body)
        builder.objects[save] = Stream({}, b"q")
        name = f"Overlay{number}"
        builder.objects[show] = Stream({}, (b"q /%s Do Q q" if background else b"Q q /%s Do Q") % name.encode())
        contents = page.get("Contents")
        own = contents if isinstance(contents, list) else [contents] if contents is not None else []
        closing = builder.number()
        builder.objects[closing] = Stream({}, b"Q")
        page["Contents"] = [Ref(show, 0), *own, Ref(closing, 0)] if background else [Ref(save, 0), *own, Ref(show, 0)]
        resources = page.get("Resources")
        resources = builder.objects.get(resources.number) if isinstance(resources, Ref) else resources
        resources = dict(resources or {})
        forms = resources.get("XObject")
        forms = builder.objects.get(forms.number) if isinstance(forms, Ref) else forms
        resources["XObject"] = dict(forms or {}) | {name: Ref(form, 0)}
        page["Resources"] = resources
    return builder.bytes()


def split_files(files: DataFrame, every: int) -> DataFrame:
    """``path, part_no, content``: files in parts of ``every`` pages. Unreadable files give no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    parts = split_file(content or b"", every)
                except Damaged:
                    continue
                for n, part in enumerate(parts):
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int32()), pa.array([part], pa.binary())], names=["path", "part_no", "content"])

    return files.select("path", "content").mapInArrow(run, "path string, part_no int, content binary")


def merge_by(files: DataFrame, group: str, order: str = "path", fan: int = 16) -> DataFrame:
    """``group, content``: one file of each group's files in order; unreadable parts are left out.

    Files are merged ``fan`` at a time, and these again, so that no task ever
    holds all files of a large group; only the last merge of a group holds its
    one result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                key, n, parts = (batch.column(k)[i].as_py() for k in range(3))
                builder = Builder()
                for part in parts:
                    try:
                        builder.add_pages(open_document(part["content"] or b""))
                    except Damaged:
                        continue
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([n], pa.int64()), pa.array([builder.bytes()], pa.binary())], names=["key", "n", "content"])

    place = F.row_number().over(Window.partitionBy("key").orderBy("o")).cast("bigint")
    level = files.select(F.col(group).cast("string").alias("key"), F.col(order).alias("o"), "content").withColumn("n", place).drop("o")
    left = files.groupBy(group).count().agg(F.max("count")).first()[0] or 0
    while True:
        bundles = level.groupBy("key", F.floor((F.col("n") - 1) / fan).cast("bigint").alias("n")).agg(F.array_sort(F.collect_list(F.struct(F.col("n").alias("o"), "content"))).alias("parts"))
        level = bundles.mapInArrow(run, "key string, n bigint, content binary").withColumn("n", F.col("n") + 1)
        left = -(-left // fan)
        if left <= 1:
            return level.drop("n").withColumnRenamed("key", group)
