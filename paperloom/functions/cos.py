"""Objects of PDF files: values, a lexer for them, and a file with its cross references.

Names are `Name`, strings are bytes, references are `Ref`, streams are
`Stream`; arrays, dictionaries, numbers, booleans and null are Python's own.
Parsing is lenient: it goes from the file's own tables over a search of the
whole file to an error for the file as a whole, which callers turn into a row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any, NamedTuple

from paperloom.functions import stream_filters
from paperloom.functions.encryption import Decryptor, decryptor_of

_SPACE = b"\0\t\n\f\r "
_DELIMITERS = b"()<>[]{}/%"
_REGULAR = re.compile(rb"[^\0\t\n\f\r ()<>\[\]{}/%]+")
_SKIP = re.compile(rb"(?:[\0\t\n\f\r ]+|%[^\r\n]*)*")
_NUMBER = re.compile(rb"[+-]*(?:\d+\.?\d*|\.\d+)(?:-\d+)?")
#: White space and what begins a comment.
_SKIPPED = b"\0\t\n\f\r %"
#: A number as nearly all are written, with what ends it; and an array of such.
_USUAL = re.compile(rb"-?\d+(\.\d*)?(?=[\t\n\f\r \[\](<>/)])")
_NUMBERS = re.compile(rb"([\t\n\f\r 0-9.-]*)\]")
_REFERENCE = re.compile(rb"(\d{1,10})[\0\t\n\f\r ]+(\d{1,5})[\0\t\n\f\r ]+R(?![^\0\t\n\f\r ()<>\[\]{}/%])")
_OBJECT = re.compile(rb"(?<![0-9])(\d{1,10})[\0\t\n\f\r ]+(\d{1,5})[\0\t\n\f\r ]+obj\b")
#: The next object as nearly all are written, with the white space before it; what else there is, `Lexer.read` takes apart.
#: Groups: name, reference's number and generation, whole number, real, string, what opens and closes dictionaries and arrays, word.
_TOKEN = (
    rb"[\0\t\n\f\r ]*(?:/([^\0\t\n\f\r ()<>\[\]{}/%%#\x80-\xff]+)(?=[\0\t\n\f\r ()<>\[\]{}/%%]|\Z)|%s|(-?\d+)(?=[\t\n\f\r \[\](<>/)])|(-?\d+\.\d*)(?=[\t\n\f\r \[\](<>/)])"
    rb"|\(([^()\\\r]*)\)|(<<)|(>>)|(\[)|(\])|([^\0\t\n\f\r ()<>\[\]{}/%%0-9+.-][^\0\t\n\f\r ()<>\[\]{}/%%]*))"
)
_WITH_REFERENCES = re.compile(_TOKEN % rb"(\d{1,10})[\0\t\n\f\r ]+(\d{1,5})[\0\t\n\f\r ]+R(?![^\0\t\n\f\r ()<>\[\]{}/%])")
_WITHOUT_REFERENCES = re.compile(_TOKEN % rb"(?!)()()")
NAME, REFERENCE, WHOLE, REAL, STRING, OPENS, CLOSES, BEGINS, ENDS, WORD = 1, 3, 4, 5, 6, 7, 8, 9, 10, 11
#: Entries of a table as the format has them, 20 bytes each.
_ENTRIES = re.compile(rb"(?:\d{10} \d{5} [nf](?: \r| \n|\r\n))*")
_ESCAPES = {0x6E: 10, 0x72: 13, 0x74: 9, 0x62: 8, 0x66: 12}
MAX_DEPTH = 200
#: An object's text before its end mark, from which it is sure that reading the object goes no further: a dictionary without comments, escapes in names and brackets in brackets.
_PLAIN = re.compile(rb"[0-9]{1,10}[\0\t\n\f\r ]+[0-9]{1,5}[\0\t\n\f\r ]+obj[\0\t\n\f\r ]*<<[^()%#\\]*(?:\([^()\\]*(?:\\.[^()\\]*)*\)[^()%#\\]*)*>>[\0\t\n\f\r ]*", re.S)
#: Texts of objects, of streams up to their bytes, up to this length are kept with what they say, so many at most: files of one maker have many in common.
KEPT_LENGTH, KEPT_TEXTS = 2048, 1 << 14
_kept: dict[bytes, tuple[Any, bool]] = {}


class Name(str):
    """A name object."""

    __slots__ = ()


@lru_cache(1 << 14)
def plain_name(raw: bytes) -> Name:
    """The name that ASCII bytes without escapes give."""
    return Name(raw.decode("ascii"))


@lru_cache(1 << 14)
def _key(raw: bytes) -> str:
    return raw.decode("ascii")


class Ref(NamedTuple):
    number: int
    generation: int


@dataclass
class Stream:
    dictionary: dict[str, Any]
    raw: bytes


class Keyword(bytes):
    """A word that is no object: an operator or a mark of the file's structure."""

    __slots__ = ()


WORDS: dict[bytes, Any] = {b"true": True, b"false": False, b"null": None}


class Damaged(ValueError):
    """The file cannot be read as asked."""


def _fresh(value: Any) -> Any:
    """The same value in containers of its own."""
    if type(value) is dict:
        return {k: _fresh(v) if type(v) is dict or type(v) is list else v for k, v in value.items()}
    return [_fresh(v) if type(v) is dict or type(v) is list else v for v in value]


class Lexer:
    """Reads objects from bytes, from ``at`` on."""

    def __init__(self, data: bytes, at: int = 0, references: bool = True):
        self.data, self.at, self.references = data, at, references
        self.token = (_WITH_REFERENCES if references else _WITHOUT_REFERENCES).match

    def skip(self) -> None:
        self.at = _SKIP.match(self.data, self.at).end()

    def read(self, depth: int = 0) -> Any:
        """The next object or `Keyword`; EOFError at the end."""
        data, at = self.data, self.at
        if (m := self.token(data, at)) is not None:
            kind = m.lastindex
            self.at = m.end()
            if kind == WORD:
                word = m[WORD]
                return WORDS[word] if word in WORDS else Keyword(word)
            if kind == NAME:
                return plain_name(m[NAME])
            if kind == REFERENCE:
                return Ref(int(m[2]), int(m[3]))
            if kind == WHOLE:
                return int(m[WHOLE])
            if kind == REAL:
                return float(m[REAL])
            if kind == STRING:
                return m[STRING]
            if kind == OPENS:
                self.at -= 2
                return self._dictionary(depth)
            if kind == BEGINS:
                self.at -= 1
                return self._array(depth)
            return Keyword(m[kind])
        c = data[at] if at < len(data) else 0x20
        if c == 0x20 and at + 1 < len(data):  # most often one space
            self.at = at + 1
            c = data[at + 1]
        if c in _SKIPPED:
            self.skip()
            if self.at >= len(data):
                raise EOFError
            c = data[self.at]
        if c == 0x2F:  # /
            return self._name()
        if 0x30 <= c <= 0x39 or c in b"+-.":
            return self._number()
        if c == 0x28:  # (
            return self._string()
        if c == 0x3C:  # <
            if data[self.at + 1 : self.at + 2] == b"<":
                return self._dictionary(depth)
            return self._hex()
        if c == 0x5B:  # [
            return self._array(depth)
        if c in _DELIMITERS:
            if data[self.at : self.at + 2] == b">>":
                self.at += 2
                return Keyword(b">>")
            self.at += 1
            return Keyword(bytes([c]))
        m = _REGULAR.match(data, self.at)
        self.at = m.end()
        word = m[0]
        return True if word == b"true" else False if word == b"false" else None if word == b"null" else Keyword(word)

    def _name(self) -> Name:
        m = _REGULAR.match(self.data, self.at + 1)
        raw = m[0] if m else b""
        self.at = m.end() if m else self.at + 1
        if b"#" in raw:
            raw = re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), raw)
        try:
            return Name(raw.decode("utf-8"))
        except UnicodeDecodeError:
            return Name(raw.decode("latin-1"))

    def _number(self) -> Any:
        if (not self.references or self.data[self.at] in b"+-.") and (m := _USUAL.match(self.data, self.at)):
            self.at = m.end()
            return int(m[0]) if m[1] is None else float(m[0])
        if self.references and (m := _REFERENCE.match(self.data, self.at)):
            self.at = m.end()
            return Ref(int(m[1]), int(m[2]))
        m = _NUMBER.match(self.data, self.at)
        if not m:  # a sign or a point on its own counts as 0
            word = _REGULAR.match(self.data, self.at)
            self.at = word.end()
            return 0 if word[0] in (b"-", b"+", b".", b"-.", b"+.") else Keyword(word[0])
        self.at = m.end()
        text = m[0]
        digits = text.lstrip(b"+-")
        negative = text[: len(text) - len(digits)].endswith(b"-")
        digits = digits.split(b"-")[0]
        value = float(digits) if b"." in digits else int(digits)
        return -value if negative else value

    def _string(self) -> bytes:
        end = self.data.find(b")", self.at)
        plain = self.data[self.at + 1 : end] if end >= 0 else b"\\"
        if b"\\" not in plain and b"(" not in plain and b"\r" not in plain:
            self.at = end + 1
            return plain
        data, i, out, depth = self.data, self.at + 1, bytearray(), 1
        while i < len(data):
            c = data[i]
            if c == 0x5C:
                i += 1
                if i >= len(data):
                    break
                c = data[i]
                if c in _ESCAPES:
                    out.append(_ESCAPES[c])
                elif 0x30 <= c <= 0x37:
                    m = re.compile(rb"[0-7]{1,3}").match(data, i)
                    out.append(int(m[0], 8) & 0xFF)
                    i = m.end() - 1
                elif c == 13:
                    i += data[i + 1 : i + 2] == b"\n"
                elif c != 10:
                    out.append(c)
            elif c == 0x28:
                depth += 1
                out.append(c)
            elif c == 0x29:
                depth -= 1
                if not depth:
                    i += 1
                    break
                out.append(c)
            elif c == 13:
                i += data[i + 1 : i + 2] == b"\n"
                out.append(10)
            else:
                out.append(c)
            i += 1
        self.at = i
        return bytes(out)

    def _hex(self) -> bytes:
        end = self.data.find(b">", self.at)
        end = len(self.data) if end < 0 else end
        body = self.data[self.at + 1 : end]
        self.at = end + 1
        return stream_filters.ascii_hex_decode(body)

    def _array(self, depth: int) -> list:
        if depth > MAX_DEPTH:
            raise Damaged("objects are nested too deep")
        self.at += 1
        if (m := _NUMBERS.match(self.data, self.at)) is not None:  # numbers alone
            try:
                found = [float(v) if b"." in v else int(v) for v in m[1].split()]
            except ValueError:  # odd ones are read one by one
                pass
            else:
                self.at = m.end()
                return found
        out: list = []
        data, token = self.data, self.token
        while True:
            m = token(data, self.at)
            kind = m.lastindex if m is not None else 0
            if kind == REFERENCE:
                self.at = m.end()
                out.append(Ref(int(m[2]), int(m[3])))
                continue
            if kind == ENDS:
                self.at = m.end()
                return out
            try:
                value = self.read(depth + 1)
            except EOFError:
                return out
            if isinstance(value, Keyword):
                if value == b"]":
                    return out
                if value in (b">>", b"endobj", b"endstream"):
                    self.at -= len(value)
                    return out
                continue
            out.append(value)

    def _dictionary(self, depth: int) -> dict:
        if depth > MAX_DEPTH:
            raise Damaged("objects are nested too deep")
        self.at += 2
        out: dict[str, Any] = {}
        data, token, at = self.data, self.token, self.at
        while True:
            # members as nearly all are written are taken here, all else below
            m = token(data, at)
            while m is not None and m.lastindex == NAME:
                value = token(data, m.end())
                kind = value.lastindex if value is not None else 0
                if kind == NAME:
                    out[_key(m[NAME])] = plain_name(value[NAME])
                elif kind == REFERENCE:
                    out[_key(m[NAME])] = Ref(int(value[2]), int(value[3]))
                elif kind == WHOLE:
                    out[_key(m[NAME])] = int(value[WHOLE])
                elif kind == STRING:
                    out[_key(m[NAME])] = value[STRING]
                else:
                    break
                at = value.end()
                m = token(data, at)
            self.at = at
            if m is not None and m.lastindex == CLOSES:
                self.at = m.end()
                return out
            try:
                key = self.read(depth + 1)
                at = self.at
                if isinstance(key, Keyword):
                    if key == b">>":
                        return out
                    if key in (b"endobj", b"stream", b"endstream"):
                        self.at -= len(key)
                        return out
                    continue
                if not isinstance(key, Name):
                    continue
                value = self.read(depth + 1)
            except EOFError:
                return out
            at = self.at
            if isinstance(value, Keyword):
                if value == b">>":
                    return out
                continue
            out[str(key)] = value


@dataclass
class Document:
    """A file's objects, read when they are asked for."""

    data: bytes
    places: dict[int, tuple[int, int, int]] = field(default_factory=dict)  # number -> (kind 1: offset, generation; 2: object stream, index)
    trailer: dict[str, Any] = field(default_factory=dict)
    cache: dict[int, Any] = field(default_factory=dict)
    packed: dict[int, list] = field(default_factory=dict)
    decryptor: Decryptor | None = None
    encrypted: bool = False
    recovered: bool = False
    listed: list | None = None

    # values ------------------------------------------------------------------

    def get(self, value: Any) -> Any:
        """The object itself where ``value`` is a reference; None if there is none."""
        if type(value) is not Ref:
            return value
        for _ in range(32):
            if not isinstance(value, Ref):
                return value
            value = self.object(value.number)
        return None

    def of(self, dictionary: Any, key: str, *others: str) -> Any:
        """A member of a dictionary or of a stream's, followed to its object."""
        dictionary = self.get(dictionary)
        if isinstance(dictionary, Stream):
            dictionary = dictionary.dictionary
        if not isinstance(dictionary, dict):
            return None
        for k in (key, *others):
            if (value := self.get(dictionary.get(k))) is not None:
                return value
        return None

    def object(self, number: int) -> Any:
        if number in self.cache:
            return self.cache[number]
        self.cache[number] = None  # an object that needs itself gets null
        place = self.places.get(number)
        value = None
        if place is not None:
            try:
                value = self._packed_object(number, place[1]) if place[0] == 2 else self._object_at(number, place[1])
            except (EOFError, Damaged, IndexError, RecursionError):
                value = None
        self.cache[number] = value
        return value

    def _object_at(self, number: int, offset: int) -> Any:
        m = _OBJECT.match(self.data, offset) or _OBJECT.match(self.data, _SKIP.match(self.data, offset).end())
        if not m or int(m[1]) != number:
            raise Damaged("no object where one should be")
        value = self.read_at(m.end())
        if self.decryptor is not None and not (isinstance(value, Stream) and value.dictionary.get("Type") in ("XRef",)):
            value = self.decryptor.clear(value, number, int(m[2]))
        return value

    def read_at(self, offset: int) -> Any:
        end = self.data.find(b"endobj", offset, offset + KEPT_LENGTH)
        begin = self.data.find(b"stream", offset, offset + KEPT_LENGTH if end < 0 else end)
        text = self.data[offset : begin + 6] if begin >= 0 else self.data[offset : end + 6] if end >= 0 else b""
        if (known := _kept.get(text)) is not None:
            value = known[0].copy() if known[1] else _fresh(known[0])
            return value if begin < 0 else Stream(value, self._stream_bytes(value, begin + 6))
        lexer = Lexer(self.data, offset)
        value = lexer.read()
        if isinstance(value, Keyword):
            return None
        streamed = False
        if isinstance(value, dict):
            lexer.skip()
            streamed = self.data.startswith(b"stream", lexer.at)
        # nothing behind the text was looked at
        if isinstance(value, (dict, list)) and (streamed and lexer.at == begin or not streamed and begin < 0 and lexer.at <= end):
            if len(_kept) >= KEPT_TEXTS:
                _kept.clear()
            flat = not any(isinstance(v, (dict, list)) for v in (value.values() if isinstance(value, dict) else value))
            _kept[text] = value.copy() if flat else _fresh(value), flat
        return Stream(value, self._stream_bytes(value, lexer.at + 6)) if streamed else value

    def numbers_with(self, sought: re.Pattern[bytes] | None = None) -> Iterator[int]:
        """Numbers, in order, of all objects but those that surely are no dictionaries with ``sought`` in their text; without ``sought``, of all that may be streams.

        Sure are only plain texts: packed objects and texts with comments or
        escaped names are always among them. They are cheaper to pass over than to read.
        """
        data, find, places, plain = self.data, self.data.find, self.places, _PLAIN.fullmatch
        for number in sorted(places):
            kind, offset, _ = places[number]
            if kind == 1 and (end := find(b"endobj", offset)) >= 0:
                text = data[offset:end]
                if (at := text.find(b"stream")) >= 0 and sought is not None:
                    text = text[:at]
                    at = -1 if text.count(b"<") == 2 * text.count(b"<<") else at  # a broken hexadecimal string could hide the word
                if at < 0 and (sought is None or sought.search(text) is None) and plain(text):
                    continue
            yield number

    def _stream_bytes(self, dictionary: dict, at: int) -> bytes:
        """The stream's bytes: by its length if that fits, else up to its end mark."""
        data = self.data
        if data.startswith(b"\r\n", at):
            at += 2
        elif data[at : at + 1] in (b"\n", b"\r"):
            at += 1
        length = self.get(dictionary.get("Length"))
        if isinstance(length, int) and length >= 0:
            end = at + length
            if data[end : end + 12].lstrip(_SPACE).startswith(b"endstream"):
                return data[at:end]
        ends = [e for mark in (b"endstream", b"endobj") if (e := data.find(mark, at)) >= 0]
        end = min(ends) if ends else len(data)
        body = data[at:end]
        return body[:-2] if body.endswith(b"\r\n") else body[:-1] if body.endswith((b"\n", b"\r")) else body

    def _packed_object(self, number: int, holder: int) -> Any:
        if holder not in self.packed:
            stream = self.object(holder)
            pairs: list = []
            if isinstance(stream, Stream):
                plain = self.decoded(stream)
                lexer = Lexer(plain, 0, references=False)
                count, first = self.of(stream, "N"), self.of(stream, "First")
                head = [lexer.read() for _ in range(2 * int(count or 0))]
                for n, offset in zip(head[::2], head[1::2]):
                    value = Lexer(plain, int(first or 0) + offset).read()
                    pairs.append((n, None if isinstance(value, Keyword) else value))
            self.packed[holder] = pairs
        return next((value for n, value in self.packed[holder] if n == number), None)

    def filters(self, stream: Stream) -> list[tuple[str, dict]]:
        """A stream's filters with their parameters, in order."""
        names = self.of(stream, "Filter", "F")
        names = [names] if isinstance(names, Name) else [self.get(n) for n in names or []] if isinstance(names, list) else []
        given = self.of(stream, "DecodeParms", "DP")
        given = given if isinstance(given, list) else [given]
        out = []
        for i, name in enumerate(names):
            one = self.get(given[i]) if i < len(given) else None
            one = {k: self.get(v) for k, v in one.items()} if isinstance(one, dict) else {}
            out.append((stream_filters.ABBREVIATIONS.get(str(name), str(name)), one))
        return out

    def decoded(self, stream: Stream) -> bytes:
        """A stream's data behind its filters; the raw bytes if that fails."""
        data = stream.raw
        try:
            for name, parameters in self.filters(stream):
                data = stream_filters.decode(data, name, parameters)
        except (ValueError, IndexError, TypeError):
            return stream.raw
        return data

    # structure -----------------------------------------------------------------

    @property
    def catalog(self) -> dict:
        root = self.get(self.trailer.get("Root"))
        return root if isinstance(root, dict) else {}

    def pages(self) -> list[tuple[Ref | None, dict]]:
        """The pages in order, with the attributes they inherit; cycles are cut, broken branches left out. They are sought once."""
        if self.listed is not None:
            return self.listed
        out: list[tuple[Ref | None, dict]] = []
        inherited = ("Resources", "MediaBox", "CropBox", "Rotate")
        stack: list[tuple[Any, dict]] = [(self.catalog.get("Pages"), {})]
        seen: set = set()
        while stack:
            value, above = stack.pop()
            if isinstance(value, Ref):
                if value in seen:
                    continue
                seen.add(value)
            node = self.get(value)
            if not isinstance(node, dict):
                continue
            have = above | {k: node[k] for k in inherited if k in node}
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list) and node.get("Type") != "Page":
                stack.extend((k, have) for k in reversed(kids))
            elif node.get("Type") in ("Page", None) or "Contents" in node:
                out.append((value if isinstance(value, Ref) else None, have | node))
        self.listed = out
        return out


def _xref_table(document: Document, at: int) -> tuple[dict, dict]:
    """Entries and trailer of a table at ``at``, behind the word xref."""
    lexer = Lexer(document.data, at, references=False)
    places: dict[int, tuple[int, int, int]] = {}
    while True:
        first = lexer.read()
        if isinstance(first, Keyword):
            if first != b"trailer":
                raise Damaged("a table without a trailer")
            break
        count = lexer.read()
        if not isinstance(first, int) or not isinstance(count, int):
            raise Damaged("a section of a table is broken")
        begin = _SKIP.match(document.data, lexer.at).end()
        block = document.data[begin : begin + 20 * count]
        if count > 0 and len(block) == 20 * count and _ENTRIES.fullmatch(block):
            words = block.split()
            rows = [(1, offset, generation) if offset and kind == b"n" else (0, 0, 0) for offset, generation, kind in zip(map(int, words[::3]), map(int, words[1::3]), words[2::3])]
            # a number that comes again keeps its place unless it gets another
            places |= {n: row for n, row in enumerate(rows, first) if row[0] or n not in places} if places else dict(enumerate(rows, first))
            lexer.at = begin + len(block)
            continue
        for number in range(first, first + count):
            offset, generation, kind = lexer.read(), lexer.read(), lexer.read()
            if kind == b"n" and offset:
                places[number] = (1, offset, generation)
            elif kind not in (b"n", b"f"):
                raise Damaged("an entry of a table is broken")
            else:
                places.setdefault(number, (0, 0, 0))
    trailer = Lexer(document.data, lexer.at).read()
    if not isinstance(trailer, dict):
        raise Damaged("no trailer")
    return places, trailer


def _xref_stream(document: Document, at: int) -> tuple[dict, dict]:
    m = _OBJECT.match(document.data, _SKIP.match(document.data, at).end())
    stream = document.read_at(m.end()) if m else None
    if not isinstance(stream, Stream):
        raise Damaged("no table")
    data, widths = document.decoded(stream), stream.dictionary.get("W")
    size = document.get(stream.dictionary.get("Size")) or 0
    index = document.get(stream.dictionary.get("Index")) or [0, size]
    if not isinstance(widths, list) or len(widths) < 3:
        raise Damaged("a table stream without widths")
    places: dict[int, tuple[int, int, int]] = {}
    at, step = 0, sum(widths[:3])
    for first, count in zip(index[::2], index[1::2]):
        for number in range(first, first + count):
            row = data[at : at + step]
            at += step
            if len(row) < step:
                break
            a, b = widths[0], widths[0] + widths[1]
            kind = int.from_bytes(row[:a], "big") if a else 1
            places[number] = (kind if kind in (1, 2) else 0, int.from_bytes(row[a:b], "big"), int.from_bytes(row[b:], "big"))
    return places, stream.dictionary


def _by_tables(document: Document, tail: int) -> None:
    data = document.data
    start = data.rfind(b"startxref", max(0, len(data) - tail))
    if start < 0:
        raise Damaged("no startxref")
    at = Lexer(data, start + 9, references=False).read()
    queue, seen = [at], set()
    while queue:
        at = queue.pop(0)
        if not isinstance(at, int) or at in seen or not 0 <= at < len(data):
            if not seen:
                raise Damaged("startxref points nowhere")
            continue
        seen.add(at)
        begin = _SKIP.match(data, at).end()
        places, trailer = _xref_table(document, begin + 4) if data.startswith(b"xref", begin) else _xref_stream(document, begin)
        for number, place in places.items():  # the newest section comes first
            document.places.setdefault(number, place)
        document.trailer = trailer | document.trailer if document.trailer else dict(trailer)
        if isinstance(hybrid := trailer.get("XRefStm"), int):
            queue.insert(0, hybrid)
        if trailer.get("Prev") is not None:
            queue.append(document.get(trailer.get("Prev")))
    document.places = {n: p for n, p in document.places.items() if p[0]}


def _by_search(document: Document) -> None:
    """Find objects, object streams and a trailer in the whole file; of an object found twice the last counts."""
    document.places, document.cache, document.packed, document.trailer, document.listed = {}, {}, {}, {}, None
    document.recovered = True
    data = document.data
    for m in _OBJECT.finditer(data):
        document.places[int(m[1])] = (1, m.start(), int(m[2]))
    for m in re.finditer(rb"trailer", data):
        try:
            found = Lexer(data, m.end()).read()
        except (EOFError, Damaged):
            continue
        if isinstance(found, dict):
            document.trailer |= found
    for number in list(document.places):
        value = document.object(number)
        kind = document.of(value, "Type") if isinstance(value, (dict, Stream)) else None
        if kind == "ObjStm" and isinstance(value, Stream):
            try:
                document._packed_object(-1, number)
            except (EOFError, Damaged, TypeError):
                continue
            for inner, _ in document.packed.get(number, []):
                document.places.setdefault(inner, (2, number, 0))
        elif kind == "XRef" and isinstance(value, Stream):
            document.trailer = {k: v for k, v in value.dictionary.items() if k in ("Root", "Info", "Encrypt", "ID")} | document.trailer
    if not isinstance(document.get(document.trailer.get("Root")), dict):
        for number in document.places:
            document.cache.pop(number, None)
            if document.of(document.object(number), "Type") == "Catalog":
                document.trailer["Root"] = Ref(number, 0)


def _empty(document: Document) -> bool:
    """Whether a file says that it has no pages and a search would find nothing but what its tables name."""
    top = document.get(document.catalog.get("Pages"))
    if not isinstance(top, dict) or top.get("Kids") != [] or document.data.count(b"trailer") != 1:
        return False
    found = [(int(m[1]), (1, m.start(), int(m[2]))) for m in _OBJECT.finditer(document.data)]
    return len(found) == len(document.places) and dict(found) == document.places


def open_document(data: bytes, password: str = "", tail: int = 2048) -> Document:
    """Read a file's structure. `Damaged` if it is no PDF or holds no pages that can be found."""
    begin = data.find(b"%PDF-", 0, 1 << 16)
    if begin < 0:
        begin = data.find(b"%FDF-", 0, 1 << 16)
    if begin < 0 and not _OBJECT.search(data):
        raise Damaged("no PDF header")
    if begin > 0:
        data = data[begin:]
    document = Document(data)
    for attempt in range(3):
        if attempt == 1 and data.rfind(b"startxref", max(0, len(data) - tail)) >= 0:  # the same again
            continue
        try:
            if attempt < 2:
                _by_tables(document, tail if attempt == 0 else len(data))
            else:
                _by_search(document)
            if not isinstance(document.get(document.trailer.get("Root")), dict):
                raise Damaged("no catalog")
            if not document.encrypted and document.trailer.get("Encrypt") is not None:
                document.encrypted = True
                document.decryptor = decryptor_of(document, password)
                document.cache.clear()
                document.packed.clear()
                document.listed = None
            if attempt < 2 and not document.pages() and document.catalog.get("Pages") is not None and not _empty(document):
                raise Damaged("no pages")
            return document
        except (Damaged, EOFError, ValueError, TypeError, IndexError, AttributeError) as problem:
            if attempt == 2:
                raise Damaged(str(problem)) from None
            document = Document(data)
    raise Damaged("unreadable")


def version_of(data: bytes) -> float | None:
    m = re.search(rb"%[PF]DF-(\d\.\d)", data[: 1 << 16])
    return float(m[1]) if m else None
