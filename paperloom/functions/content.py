"""Content streams: operators with operands, and the glyphs that showing text gives."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from typing import Any, NamedTuple

from paperloom.functions.cos import NAME, REAL, STRING, WHOLE, WORD, WORDS, Document, Keyword, Lexer, Name, Ref, Stream, plain_name
from paperloom.functions.fonts import Font

MAX_FORMS = 50
Matrix = tuple[float, float, float, float, float, float]
IDENTITY: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def multiply(m: Matrix, n: Matrix) -> Matrix:
    """First ``m``, then ``n``."""
    return (
        m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3],
        m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5],
    )


def operations(data: bytes) -> Iterator[tuple[str, list]]:
    """Operators with their operands, in order. Inline images are stepped over as ``BI``."""
    lexer, operands, at = Lexer(data, 0, references=False), [], 0
    token = lexer.token
    while True:
        # what nearly all is made of is taken here, all else below
        m = token(data, at)
        kind = m.lastindex if m is not None else 0
        if kind == WORD:
            at = m.end()
            if (word := m[WORD]) in WORDS:
                operands.append(WORDS[word])
                continue
        elif kind == WHOLE and m.end() - at < 1000:  # longer ones may not be read
            operands.append(int(m[WHOLE]))
            at = m.end()
            continue
        elif kind == REAL:
            operands.append(float(m[REAL]))
            at = m.end()
            continue
        elif kind == NAME:
            operands.append(plain_name(m[NAME]))
            at = m.end()
            continue
        elif kind == STRING:
            operands.append(m[STRING])
            at = m.end()
            continue
        else:
            lexer.at = at
            try:
                word = lexer.read()
            except EOFError:
                return
            except ValueError:
                at = lexer.at + 1
                continue
            at = lexer.at
            if not isinstance(word, Keyword):
                operands.append(word)
                continue
            if word in (b"]", b">>", b"}", b"{", b")", b">"):
                continue
        word = word.decode("latin-1")
        if word == "BI":
            at = after_image(data, at)
        yield word, operands
        operands = []


def after_image(data: bytes, at: int) -> int:
    """The place behind an inline image whose ``BI`` ends at a place."""
    start = data.find(b"ID", at)
    at = start + 3 if start >= 0 else at
    while True:
        end = data.find(b"EI", at)
        if end < 0:
            return len(data)
        before, after = data[end - 1 : end], data[end + 2 : end + 3]
        if before in (b"\n", b"\r", b" ", b"\t") and (not after or after in b"\0\t\n\f\r "):
            return end + 2
        at = end + 2


class Glyph(NamedTuple):
    unicode: str
    a: float
    b: float
    tx: float
    ty: float
    height: float
    width: float
    space_width: float
    font_size: float
    font_name: str
    char_code: int
    mcid: int | None
    mc_tag: str | None


@dataclass
class _Text:
    char_space: float = 0.0
    word_space: float = 0.0
    scale: float = 1.0
    leading: float = 0.0
    rise: float = 0.0
    size: float = 0.0
    mode: int = 0
    font: Font | None = None
    font_name: str = ""


@dataclass
class _Mark:
    tag: str
    mcid: int | None
    actual: str | None
    glyphs_before: int
    hidden: bool = False


@dataclass
class Interpreter:
    """Runs a page's operators for its text. Errors of one operator leave the others alone."""

    document: Document
    fonts: dict[int, Font] = field(default_factory=dict)
    glyphs: list[Glyph] = field(default_factory=list)
    #: Numbers of optional content groups that do not show; their glyphs are left out.
    hidden: frozenset[int] = frozenset()

    def run(self, data: bytes, resources: dict | None, ctm: Matrix = IDENTITY) -> list[Glyph]:
        self._stream(data, resources or {}, ctm, _Text(), [], 0)
        return self.glyphs

    def _font(self, resources: dict, name: str) -> Font | None:
        fonts = self.document.of(resources, "Font")
        if not isinstance(fonts, dict) or name not in fonts:
            return None
        dictionary = self.document.get(fonts[name])
        if not isinstance(dictionary, dict):
            return None
        if id(dictionary) not in self.fonts:
            self.fonts[id(dictionary)] = Font(self.document, dictionary)
        return self.fonts[id(dictionary)]

    def _stream(self, data: bytes, resources: dict, ctm: Matrix, text: _Text, marks: list[_Mark], depth: int) -> None:
        saved: list[tuple[Matrix, _Text]] = []
        matrix = line = IDENTITY
        inside = False
        own_marks = len(marks)

        def number(values: list, i: int) -> float:
            v = values[i]
            if not isinstance(v, (int, float)) or isinstance(v, bool):
                raise TypeError
            return float(v)

        for op, args in operations(data):
            try:
                if op == "q":
                    saved.append((ctm, replace(text)))
                elif op == "Q":
                    if saved:
                        ctm, text = saved.pop()
                elif op == "cm":
                    ctm = multiply(tuple(number(args, i) for i in range(6)), ctm)
                elif op == "BT":
                    inside, matrix, line = True, IDENTITY, IDENTITY
                elif op == "ET":
                    inside = False
                elif op == "Tc":
                    text.char_space = number(args, -1)
                elif op == "Tw":
                    text.word_space = number(args, 0)
                elif op == "Tz":
                    text.scale = number(args, 0) / 100
                elif op == "TL":
                    text.leading = number(args, 0)
                elif op == "Ts":
                    text.rise = number(args, 0)
                elif op == "Tr":
                    text.mode = int(number(args, 0)) if 0 <= number(args, 0) <= 7 else 0
                elif op == "Tf":
                    text.size = number(args, 1)
                    text.font = self._font(resources, str(args[0]))
                    text.font_name = (text.font.name if text.font else "") or str(args[0])
                elif op in ("Td", "TD"):
                    if op == "TD":
                        text.leading = -number(args, 1)
                    line = multiply((1.0, 0.0, 0.0, 1.0, number(args, 0), number(args, 1)), line)
                    matrix = line
                elif op == "Tm":
                    line = matrix = tuple(number(args, i) for i in range(6))
                elif op in ("T*", "'", '"'):
                    if op == '"':
                        text.word_space, text.char_space = number(args, 0), number(args, 1)
                    line = multiply((1.0, 0.0, 0.0, 1.0, 0.0, -text.leading), line)
                    matrix = line
                    if op != "T*" and inside and isinstance(args[-1], bytes):
                        matrix = self._show(args[-1], text, matrix, ctm, marks)
                elif op == "Tj":
                    if inside and isinstance(args[0], bytes):
                        matrix = self._show(args[0], text, matrix, ctm, marks)
                elif op == "TJ":
                    for part in args[0] if inside else []:
                        if isinstance(part, bytes):
                            matrix = self._show(part, text, matrix, ctm, marks)
                        elif isinstance(part, (int, float)):
                            matrix = multiply((1.0, 0.0, 0.0, 1.0, -part / 1000 * text.size * text.scale, 0.0), matrix)
                elif op in ("BMC", "BDC"):
                    marks.append(self._mark(args, resources))
                elif op == "EMC":
                    if len(marks) > own_marks:
                        self._unmark(marks.pop())
                elif op == "Do":
                    self._form(str(args[0]), resources, ctm, text, marks, depth)
            except (TypeError, ValueError, IndexError, AttributeError):
                continue
        while len(marks) > own_marks:
            marks.pop()

    def _form(self, name: str, resources: dict, ctm: Matrix, text: _Text, marks: list[_Mark], depth: int) -> None:
        form = self.document.of(self.document.of(resources, "XObject"), name)
        if not isinstance(form, Stream) or self.document.of(form, "Subtype") != "Form" or depth >= MAX_FORMS or self._is_hidden(form.dictionary.get("OC")):
            return
        matrix = self.document.of(form, "Matrix")
        if isinstance(matrix, list) and len(matrix) >= 6:
            ctm = multiply(tuple(float(self.document.get(v)) for v in matrix[:6]), ctm)
        own = self.document.of(form, "Resources")
        self._stream(self.document.decoded(form), own if isinstance(own, dict) else resources, ctm, replace(text), marks, depth + 1)

    def _mark(self, args: list, resources: dict) -> _Mark:
        properties = args[1] if len(args) > 1 else None
        hidden = False
        if isinstance(properties, Name):
            named = self.document.of(resources, "Properties")
            group = named.get(str(properties)) if isinstance(named, dict) else None
            hidden = bool(args) and args[0] == "OC" and self._is_hidden(group)
            properties = self.document.get(group)
        actual = self.document.of(properties, "ActualText") if isinstance(properties, dict) else None
        mcid = self.document.of(properties, "MCID") if isinstance(properties, dict) else None
        text = text_string(actual).replace("\xad", "") if isinstance(actual, bytes) else None
        return _Mark(str(args[0]) if args else "", mcid if isinstance(mcid, int) else None, text, len(self.glyphs), hidden)

    def _is_hidden(self, group: Any) -> bool:
        """Whether a group does not show, or a membership none of whose groups does."""
        if isinstance(group, Ref) and group.number in self.hidden:
            return True
        members = self.document.of(group, "OCGs")
        members = members if isinstance(members, list) else [members]
        return any(members) and all(isinstance(m, Ref) and m.number in self.hidden for m in members)

    def _unmark(self, mark: _Mark) -> None:
        """Text given for a span takes the place of its first glyph, and the others go; so do all of a hidden one."""
        if mark.hidden:
            del self.glyphs[mark.glyphs_before :]
        if mark.actual is None or len(self.glyphs) == mark.glyphs_before:
            return
        first = self.glyphs[mark.glyphs_before]._replace(unicode=mark.actual)
        self.glyphs[mark.glyphs_before :] = [first] if mark.actual else []

    def _show(self, raw: bytes, text: _Text, matrix: Matrix, ctm: Matrix, marks: list[_Mark]) -> Matrix:
        font, size, scale = text.font, text.size, text.scale
        space = font.space if font else 0.25
        mark = marks[-1] if marks else None
        mcid, tag = (mark.mcid, mark.tag) if mark else (None, None)
        start = multiply(multiply((size * scale, 0.0, 0.0, size, 0.0, text.rise), matrix), ctm)
        # along the run only the place changes, by so much for each unit of advance
        step_x, step_y = matrix[0] * ctm[0] + matrix[1] * ctm[2], matrix[0] * ctm[1] + matrix[1] * ctm[3]
        a, b, x, y = start[0], start[1], start[4], start[5]
        space *= (a * a + b * b) ** 0.5
        height = (start[2] ** 2 + start[3] ** 2) ** 0.5
        upright = abs(a) >= abs(b)
        if font is not None and font.vertical:
            return self._show_down(raw, text, matrix, ctm, start, space, mcid, tag)
        per_width, extra, word = size * scale / 1000, text.char_space * scale, text.word_space * scale
        total, name, out = 0.0, text.font_name, self.glyphs
        for code, length, shown, width in font.shown(raw) if font else [(c, 1, chr(c), 0.0) for c in raw]:
            wide = width * per_width
            if shown:
                out.append(Glyph(shown, a, b, x + total * step_x, y + total * step_y, height, wide * (step_x if upright else step_y), space, size, name, code, mcid, tag))
            total += wide + extra + (word if code == 32 and length == 1 else 0.0)
        return (*matrix[:4], matrix[4] + total * matrix[0], matrix[5] + total * matrix[1])


    def _show_down(self, raw: bytes, text: _Text, matrix: Matrix, ctm: Matrix, start: Matrix, space: float, mcid: int | None, tag: str | None) -> Matrix:
        """Glyphs from top to bottom: each hangs from its upper origin, and the next one is below it."""
        font, size = text.font, text.size
        linear = multiply((*matrix[:4], 0.0, 0.0), (*ctm[:4], 0.0, 0.0))
        height = (start[2] ** 2 + start[3] ** 2) ** 0.5
        down = 0.0
        for code, length, shown, width in font.shown(raw):
            advance, origin_x, origin_y = font.downward(code, length)
            left, low = -origin_x / 1000 * size * text.scale, down - origin_y / 1000 * size
            if shown:
                x, y = start[4] + left * linear[0] + low * linear[2], start[5] + left * linear[1] + low * linear[3]
                self.glyphs.append(Glyph(shown, start[0], start[1], x, y, height, width / 1000 * size * text.scale * linear[0], space, size, text.font_name, code, mcid, tag))
            down += advance / 1000 * size - text.char_space - (text.word_space if length == 1 and code == 32 else 0.0)
        return (*matrix[:4], matrix[4] + down * matrix[2], matrix[5] + down * matrix[3])


def text_string(raw: bytes) -> str:
    """The text of a string object: UTF-16 or UTF-8 by its mark, else one byte a character."""
    if raw.startswith(b"\xfe\xff"):
        return raw[2:].decode("utf-16-be", "replace")
    if raw.startswith(b"\xff\xfe"):
        return raw[2:].decode("utf-16-le", "replace")
    if raw.startswith(b"\xef\xbb\xbf"):
        return raw[3:].decode("utf-8", "replace")
    return raw.decode("latin-1")


def tree_entries(document: Document, tree: Any) -> list[tuple[Any, Any]]:
    """Entries of a name or number tree in order."""
    out, stack, seen = [], [tree], set()
    while stack:
        node = stack.pop()
        if isinstance(node, Ref):
            if node in seen:
                continue
            seen.add(node)
        for key in ("Nums", "Names"):
            entries = document.of(node, key)
            if isinstance(entries, list):
                out += [(document.get(k), v) for k, v in zip(entries[::2], entries[1::2])]
        kids = document.of(node, "Kids")
        stack.extend(reversed(kids if isinstance(kids, list) else []))
    return out


def target_page(document: Document, dest: Any) -> int | None:
    """The object number of the page that a destination leads to: given as an array, by name, or in a dictionary."""
    dest = document.get(dest)
    if isinstance(dest, (Name, bytes)):
        name = str(dest) if isinstance(dest, Name) else text_string(dest)
        old = document.of(document.of(document.catalog, "Dests"), name)
        dest = old if old is not None else next((document.get(v) for k, v in tree_entries(document, document.of(document.catalog.get("Names"), "Dests")) if isinstance(k, bytes) and text_string(k) == name), None)
    if isinstance(dest, dict):
        dest = document.of(dest, "D")
    return dest[0].number if isinstance(dest, list) and dest and isinstance(dest[0], Ref) else None


def page_content(document: Document, page: dict) -> bytes:
    """A page's content: the parts of an array with line ends between; bad parts are left out."""
    contents = document.get(page.get("Contents"))
    parts = [document.get(c) for c in contents] if isinstance(contents, list) else [contents]
    return b"\n".join(document.decoded(p) for p in parts if isinstance(p, Stream))


def box_of(document: Document, page: dict, key: str = "MediaBox") -> tuple[float, float, float, float]:
    values: Any = document.get(page.get(key))
    if isinstance(values, list) and len(values) >= 4:
        numbers = [document.get(v) for v in values[:4]]
        if all(isinstance(v, (int, float)) for v in numbers):
            x0, y0, x1, y1 = map(float, numbers)
            return min(x0, x1), min(y0, y1), max(x0, x1), max(y0, y1)
    return (0.0, 0.0, 612.0, 792.0) if key == "MediaBox" else box_of(document, page)


def page_glyphs(document: Document, page: dict, fonts: dict[int, Font] | None = None, hidden: frozenset[int] = frozenset()) -> list[Glyph]:
    resources = document.get(page.get("Resources"))
    return Interpreter(document, fonts if fonts is not None else {}, hidden=hidden).run(page_content(document, page), resources if isinstance(resources, dict) else {})
