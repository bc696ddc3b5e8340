"""Fonts of PDF files as decoders: bytes shown to codes, codes to text and widths.

Encodings come from rules where there is one: Latin ones from Python's codecs,
glyph names from the names of characters.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from bisect import bisect_right
from dataclasses import dataclass, field, replace
from typing import Any

from paperloom.functions.cos import Document, Keyword, Lexer, Name, Stream

# Glyph names of characters whose name gives none by rule.
_NAMED = dict(
    space=" ", exclam="!", quotedbl='"', numbersign="#", dollar="$", percent="%", ampersand="&", quotesingle="'", parenleft="(", parenright=")", asterisk="*", plus="+",
    comma=",", hyphen="-", period=".", slash="/", colon=":", semicolon=";", less="<", equal="=", greater=">", question="?", at="@", bracketleft="[", backslash="\\",
    bracketright="]", asciicircum="^", underscore="_", grave="`", braceleft="{", bar="|", braceright="}", asciitilde="~", exclamdown="¡", cent="¢", sterling="£",
    currency="¤", yen="¥", brokenbar="¦", section="§", dieresis="¨", copyright="©", ordfeminine="ª", guillemotleft="«", logicalnot="¬", registered="®", macron="¯",
    degree="°", plusminus="±", twosuperior="²", threesuperior="³", acute="´", mu="µ", paragraph="¶", periodcentered="·", cedilla="¸", onesuperior="¹",
    ordmasculine="º", guillemotright="»", onequarter="¼", onehalf="½", threequarters="¾", questiondown="¿", multiply="×", divide="÷", germandbls="ß", ae="æ", AE="Æ",
    oe="œ", OE="Œ", eth="ð", Eth="Ð", thorn="þ", Thorn="Þ", oslash="ø", Oslash="Ø", dotlessi="ı", lslash="ł", Lslash="Ł", florin="ƒ", quoteleft="‘", quoteright="’",
    quotedblleft="“", quotedblright="”", quotesinglbase="‚", quotedblbase="„", guilsinglleft="‹", guilsinglright="›", endash="–", emdash="—", dagger="†",
    daggerdbl="‡", bullet="•", ellipsis="…", perthousand="‰", trademark="™", fraction="⁄", minus="−", Euro="€", fi="ﬁ", fl="ﬂ", ff="ﬀ", ffi="ﬃ", ffl="ﬄ",
    circumflex="ˆ", tilde="˜", breve="˘", dotaccent="˙", ring="˚", hungarumlaut="˝", ogonek="˛", caron="ˇ", infinity="∞", notequal="≠", lessequal="≤",
    greaterequal="≥", partialdiff="∂", summation="∑", product="∏", radical="√", integral="∫", approxequal="≈", lozenge="◊", nbspace="\xa0", softhyphen="\xad",
)
_DIGITS = "zero one two three four five six seven eight nine".split()
# The upper half of the standard encoding, from 0xA1 on; a dot stands for no character.
_STANDARD = "¡¢£⁄¥ƒ§¤'“«‹›ﬁﬂ.–†‡·.¶•‚„”»…‰.¿.`´ˆ˜¯˘˙¨.˚¸.˝˛ˇ—................Æ.ª....ŁØŒº.....æ...ı..łøœß...."
_SYMBOL_UPPER, _SYMBOL_LOWER = "ΑΒΧΔΕΦΓΗΙϑΚΛΜΝΟΠΘΡΣΤΥςΩΞΨΖ", "αβχδεφγηιϕκλμνοπθρστυϖωξψζ"
_DINGBATS = {0x25: 0x260E, 0x2A: 0x261B, 0x2B: 0x261E, 0x48: 0x2605, 0x6C: 0x25CF, 0x6E: 0x25A0, 0x73: 0x25B2, 0x74: 0x25BC, 0x75: 0x25C6, 0x77: 0x25D7, 0xA8: 0x2663, 0xA9: 0x2666, 0xAA: 0x2665, 0xAB: 0x2660, 0xD5: 0x2192, 0xD6: 0x2194, 0xD7: 0x2195}


def _glyph_names() -> dict[str, str]:
    """Names of glyphs: letters as they are, accented ones by letter and accent, Greek ones by their own name."""
    out = dict(_NAMED)
    out |= {d: str(i) for i, d in enumerate(_DIGITS)}
    accents = {"GRAVE": "grave", "ACUTE": "acute", "CIRCUMFLEX": "circumflex", "TILDE": "tilde", "DIAERESIS": "dieresis", "RING ABOVE": "ring", "CEDILLA": "cedilla", "CARON": "caron", "BREVE": "breve", "MACRON": "macron", "OGONEK": "ogonek", "DOT ABOVE": "dotaccent", "DOUBLE ACUTE": "hungarumlaut"}
    for o in [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x180)]:
        name = unicodedata.name(chr(o), "")
        if m := re.fullmatch(r"LATIN (CAPITAL|SMALL) LETTER ([A-Z])(?: WITH ([A-Z ]+))?", name):
            letter = m[2] if m[1] == "CAPITAL" else m[2].lower()
            if not m[3] or m[3] in accents:
                out.setdefault(letter + accents.get(m[3] or "", ""), chr(o))
    for o in range(0x391, 0x3CA):
        if m := re.fullmatch(r"GREEK (CAPITAL|SMALL) LETTER (\w+)", unicodedata.name(chr(o), "")):
            out.setdefault(m[2].capitalize() if m[1] == "CAPITAL" else m[2].lower(), chr(o))
    return out


GLYPHS = _glyph_names()


def glyph_text(name: str) -> str | None:
    """The text of a glyph name: listed, ``uniXXXX``, ``uXXXXX``, or that of the name before its first point."""
    if name == ".notdef":
        return None
    if name in GLYPHS:
        return GLYPHS[name]
    if _folder and name in listed_names():
        return listed_names()[name]
    if (m := re.fullmatch(r"uni((?:[0-9A-Fa-f]{4})+)", name)) or (m := re.fullmatch(r"u([0-9A-Fa-f]{4,6})", name)):
        parts = [m[1][i : i + 4] for i in range(0, len(m[1]), 4)] if name.startswith("uni") else [m[1]]
        try:
            return "".join(chr(int(p, 16)) for p in parts if not 0xD800 <= int(p, 16) < 0xE000) or None
        except ValueError:
            return None
    if "." in name[1:]:
        return glyph_text(name.split(".")[0])
    return glyph_text(name.split("_")[0]) if "_" in name[1:] else None


def _codec(name: str) -> dict[int, str]:
    out = {}
    for code in range(32, 256):
        try:
            out[code] = bytes([code]).decode(name)
        except UnicodeDecodeError:
            pass
    out.pop(127, None)
    return out


def _standard() -> dict[int, str]:
    out = {c: chr(c) for c in range(32, 127)} | {0x27: "’", 0x60: "‘"}
    return out | {0xA1 + i: c for i, c in enumerate(_STANDARD) if c != "."}


def _symbol() -> dict[int, str]:
    out = {c: chr(c) for c in b" !#%&()+,./0123456789:;<=>?[]_{|}"}
    out |= {0x41 + i: c for i, c in enumerate(_SYMBOL_UPPER)} | {0x61 + i: c for i, c in enumerate(_SYMBOL_LOWER)}
    return out | {0x22: "∀", 0x24: "∃", 0x2D: "−", 0x2A: "∗", 0x40: "≅", 0x5C: "∴", 0x5E: "⊥", 0x7E: "∼", 0xB7: "•", 0xB1: "±", 0xB4: "×", 0xA3: "≤", 0xB3: "≥", 0xB9: "≠"}


def _dingbats() -> dict[int, str]:
    out = {c: chr(0x2701 + c - 0x21) for c in range(0x21, 0x7F)} | {c: chr(0x2761 + c - 0xA1) for c in range(0xA1, 0xA8)}
    out |= {0xAC + i: chr(0x2460 + i) for i in range(10)} | {0xB6 + i: chr(0x2776 + i) for i in range(30)} | {0xD4: "➔"}
    out |= {c: chr(0x2798 + c - 0xD8) for c in range(0xD8, 0xFF)}
    return out | {c: chr(o) for c, o in _DINGBATS.items()} | {0x20: " "}


ENCODINGS = {
    "WinAnsiEncoding": _codec("cp1252") | {c: "•" for c in (0x7F, 0x81, 0x8D, 0x8F, 0x90, 0x9D)},
    "MacRomanEncoding": _codec("mac_roman"),
    "StandardEncoding": _standard(),
    "PDFDocEncoding": _codec("latin-1"),
    "Symbol": _symbol(),
    "ZapfDingbats": _dingbats(),
}
# CMaps whose codes are those of a character set.
_CHARACTER_SETS = [
    (r"Uni(?:KS|GB|CNS|JIS)\w*-(?:UCS2|UTF16)", "utf-16-be"), (r"UniKS-UTF8|Uni\w+-UTF8", "utf-8"), (r"KSCms-UHC|KSC-EUC|KSCpc-EUC", "cp949"), (r"GBK2?K?-EUC|GB-EUC|GBK", "gbk"),
    (r"90ms-RKSJ|90pv-RKSJ|83pv-RKSJ", "cp932"), (r"EUC-[HV]", "euc_jp"), (r"ETen-B5|B5pc|HKscs-B5", "big5hkscs"),
]


@dataclass
class CMap:
    """A mapping of codes to text or to glyph numbers; codes of different lengths are kept apart."""

    spaces: list[tuple[int, int, int]] = field(default_factory=list)  # length, low, high
    text: dict[tuple[int, int], str] = field(default_factory=dict)
    text_ranges: list[tuple[int, int, int, str]] = field(default_factory=list)
    cids: dict[tuple[int, int], int] = field(default_factory=dict)
    cid_ranges: list[tuple[int, int, int, int]] = field(default_factory=list)
    name: str = ""
    vertical: bool = False
    codec: str | None = None

    def unicode(self, code: int, length: int) -> str | None:
        if (found := self.text.get((length, code))) is not None:
            return found
        for size, low, high, first in self.text_ranges:
            if size == length and low <= code <= high:
                return first[:-1] + chr(ord(first[-1]) + code - low) if first else None
        if self.codec:
            try:
                return code.to_bytes(length, "big").decode(self.codec)
            except (UnicodeDecodeError, OverflowError):
                return None
        return None

    def cid(self, code: int, length: int) -> int | None:
        if (found := self.cids.get((length, code))) is not None:
            return found
        for size, low, high, first in self.cid_ranges:
            if size == length and low <= code <= high:
                return first + code - low
        return None

    def read(self, data: bytes, at: int) -> tuple[int, int]:
        """The next code and its length: the shortest that lies in a code space; one byte if none does."""
        for length in range(1, 5):
            part = data[at : at + length]
            if len(part) < length:
                break
            value = int.from_bytes(part, "big")
            for size, low, high in self.spaces:
                if size == length and all(a <= b <= c for a, b, c in zip(low.to_bytes(size, "big"), part, high.to_bytes(size, "big"))):
                    return value, length
        if self.codec and at + 1 < len(data) and (self.codec == "utf-16-be" or data[at] >= 0x81):
            return int.from_bytes(data[at : at + 2], "big"), 2
        return data[at], 1

    def rows(self) -> list[tuple[int, int, int, int | None, str | None]]:
        """``(length, low, high, first glyph number, first text)`` of all mappings."""
        out = [(n, c, c, None, t) for (n, c), t in self.text.items()] + [(n, a, b, None, t) for n, a, b, t in self.text_ranges]
        return out + [(n, c, c, g, None) for (n, c), g in self.cids.items()] + [(n, a, b, g, None) for n, a, b, g in self.cid_ranges]


def _utf16(raw: bytes) -> str:
    return raw.decode("utf-16-be", "replace") if len(raw) % 2 == 0 else raw.decode("latin-1")


def parse_cmap(data: bytes) -> CMap:
    """Read a CMap's text. Broken sections end where they break."""
    cmap, lexer = CMap(), Lexer(data, 0, references=False)
    stack: list[Any] = []
    while True:
        try:
            token = lexer.read()
        except (EOFError, ValueError):
            return cmap
        if not isinstance(token, Keyword):
            stack.append(token)
            continue
        if token == b"endcmap":
            return cmap
        if token == b"usecmap" and stack and isinstance(stack[-1], Name):
            base = predefined(str(stack[-1]))
            cmap.codec, cmap.spaces = base.codec, base.spaces + cmap.spaces
            cmap.text, cmap.cids = base.text | cmap.text, base.cids | cmap.cids
            cmap.text_ranges, cmap.cid_ranges = cmap.text_ranges + base.text_ranges, cmap.cid_ranges + base.cid_ranges
        elif token == b"def" and len(stack) >= 2:
            if stack[-2] == "CMapName":
                cmap.name = str(stack[-1])
            elif stack[-2] == "WMode":
                cmap.vertical = stack[-1] == 1
        elif token.startswith(b"end"):
            _section(cmap, token, stack)
        if token not in (b"[", b"]"):
            stack = []


def _section(cmap: CMap, end: bytes, rows: list) -> None:
    raw = [r for r in rows]
    number = lambda b: int.from_bytes(b, "big")
    if end == b"endcodespacerange":
        for low, high in zip(raw[::2], raw[1::2]):
            if isinstance(low, bytes) and isinstance(high, bytes) and 0 < len(low) == len(high) <= 4:
                cmap.spaces.append((len(low), number(low), number(high)))
    elif end == b"endbfchar":
        for code, text in zip(raw[::2], raw[1::2]):
            if isinstance(code, bytes) and code:
                value = _utf16(text) if isinstance(text, bytes) else glyph_text(str(text)) if isinstance(text, Name) else None
                if value:
                    cmap.text[len(code), number(code)] = value
    elif end == b"endbfrange":
        for low, high, text in zip(raw[::3], raw[1::3], raw[2::3]):
            if not isinstance(low, bytes) or not isinstance(high, bytes) or not low:
                continue
            a, b = number(low), number(high)
            if isinstance(text, list):
                for i, t in enumerate(text[: b - a + 1]):
                    if isinstance(t, bytes) and t:
                        cmap.text[len(low), a + i] = _utf16(t)
            elif isinstance(text, bytes) and text and b >= a and (first := _utf16(text)) and ord(first[-1]) + b - a < 0x110000:
                cmap.text_ranges.append((len(low), a, b, first))
    elif end == b"endcidchar":
        for code, cid in zip(raw[::2], raw[1::2]):
            if isinstance(code, bytes) and isinstance(cid, int):
                cmap.cids[len(code), number(code)] = cid
    elif end == b"endcidrange":
        for low, high, cid in zip(raw[::3], raw[1::3], raw[2::3]):
            if isinstance(low, bytes) and isinstance(high, bytes) and isinstance(cid, int) and number(high) >= number(low):
                cmap.cid_ranges.append((len(low), number(low), number(high), cid))


_folder = ""
_FILE_NAME = re.compile(r"[A-Za-z0-9-]+")


def use_resources(folder: str) -> None:
    """Read CMaps by name, maps from glyph numbers to characters (``Adobe-Korea1-UCS2`` and the like) and the list of glyph names (``glyphlist.txt``) from a folder of the public files.

    They are not part of the package. Without a folder, or without a file, what is known by rule holds.
    """
    global _folder
    if folder != _folder:
        _folder = folder
        stored.cache_clear()
        listed_names.cache_clear()


@functools.cache
def stored(name: str) -> CMap | None:
    """The CMap of a file in the folder of resources."""
    if not _folder or not _FILE_NAME.fullmatch(name):
        return None
    try:
        with open(f"{_folder}/{name}", "rb") as source:
            return parse_cmap(source.read())
    except OSError:
        return None


@functools.cache
def listed_names() -> dict[str, str]:
    """Glyph names with their text, from lines of a name and code points."""
    out: dict[str, str] = {}
    try:
        with open(f"{_folder}/glyphlist.txt", encoding="utf-8") as source:
            for row in source if _folder else ():
                name, _, codes = row.strip().partition(";")
                if name and codes and not name.startswith("#"):
                    out[name] = "".join(chr(int(c, 16)) for c in codes.replace(",", " ").split())
    except (OSError, ValueError):
        pass
    return out


def predefined(name: str) -> CMap:
    """A CMap known by name: of a file in the folder of resources, identity, or one whose codes are those of a character set."""
    if (found := stored(name)) is not None:
        codec = next((c for pattern, c in _CHARACTER_SETS if re.match(pattern, name)), None)
        return replace(found, name=name, vertical=name.endswith("V"), codec=codec)
    cmap = CMap(name=name, vertical=name.endswith("V"))
    if name.startswith("Identity"):
        cmap.spaces, cmap.cid_ranges = [(2, 0, 0xFFFF)], [(2, 0, 0xFFFF, 0)]
        return cmap
    for pattern, codec in _CHARACTER_SETS:
        if re.match(pattern, name):
            cmap.codec = codec
            break
    if cmap.codec == "utf-16-be":
        cmap.spaces = [(2, 0, 0xFFFF)]
    return cmap


class Font:
    """A font as the interpreter needs it."""

    def __init__(self, document: Document, dictionary: dict):
        get = lambda key, *more: document.of(dictionary, key, *more)
        self.subtype = str(get("Subtype") or "Type1")
        self.name = str(get("BaseFont") or get("Name") or "")
        self.to_unicode = parse_cmap(document.decoded(s)) if isinstance(s := get("ToUnicode"), Stream) else None
        self.composite = self.subtype == "Type0"
        self.scale = 0.001
        self.widths: dict[int, float] = {}
        self.ranges: list[tuple[int, int, float]] = []
        self.default = 0.0
        if self.composite:
            self._composite(document, dictionary)
        else:
            self._simple(document, dictionary)
        self.starts = [r[0] for r in self.ranges]
        self._known: dict = {}

    def _simple(self, document: Document, dictionary: dict) -> None:
        get = lambda key: document.of(dictionary, key)
        descriptor = get("FontDescriptor")
        flags = document.of(descriptor, "Flags") or 0
        symbolic = bool(flags & 4)
        first = get("FirstChar") or 0
        for i, width in enumerate(get("Widths") or []):
            width = width if type(width) in (int, float) else document.get(width)
            if isinstance(width, (int, float)):
                self.widths[first + i] = float(width)
        self.default = float(document.of(descriptor, "MissingWidth") or 0)
        if self.subtype == "Type3" and isinstance(matrix := get("FontMatrix"), list) and matrix:
            self.scale = float(matrix[0])
        encoding = get("Encoding")
        base = "ZapfDingbats" if "Dingbats" in self.name else "Symbol" if self.name.endswith("Symbol") else None
        if isinstance(encoding, dict):
            named = document.of(encoding, "BaseEncoding")
            table = dict(ENCODINGS.get(str(named), {}) if named else ENCODINGS[base] if base else {} if symbolic and self.subtype != "Type3" else ENCODINGS["StandardEncoding"])
            code = 0
            for entry in document.of(encoding, "Differences") or []:
                entry = document.get(entry)
                if isinstance(entry, Name):
                    text = glyph_text(str(entry))
                    if text is None:
                        table.pop(code, None)
                    else:
                        table[code] = text
                    code += 1
                elif isinstance(entry, (int, float)):
                    code = int(entry)
        else:
            table = dict(ENCODINGS.get(str(encoding)) or ENCODINGS[base or "StandardEncoding"])
        self.table = table

    def _composite(self, document: Document, dictionary: dict) -> None:
        encoding = document.of(dictionary, "Encoding")
        self.cmap = parse_cmap(document.decoded(encoding)) if isinstance(encoding, Stream) else predefined(str(encoding or "Identity-H"))
        descendants = document.of(dictionary, "DescendantFonts") or [None]
        inner = document.get(descendants[0])
        collection = document.of(inner, "CIDSystemInfo")
        names = [document.of(collection, k) for k in ("Registry", "Ordering")]
        self.characters = stored("-".join([*(n.decode("latin-1") for n in names), "UCS2"])) if all(isinstance(n, bytes) for n in names) and names[1] != b"Identity" else None
        self.default = float(document.of(inner, "DW") if document.of(inner, "DW") is not None else 1000)
        entries = [w if type(w) is int else document.get(w) for w in document.of(inner, "W") or []]
        i = 0
        while i + 1 < len(entries):
            if isinstance(entries[i + 1], list):
                for k, width in enumerate(entries[i + 1]):
                    self.widths[entries[i] + k] = float(width if type(width) in (int, float) else document.get(width) or 0)
                i += 2
            elif i + 2 < len(entries):
                self.ranges.append((int(entries[i]), int(entries[i + 1]), float(entries[i + 2] or 0)))
                i += 3
            else:
                break
        self.ranges.sort()
        default = [document.get(v) for v in document.of(inner, "DW2") or [880, -1000]]
        self.origin_y, self.down = (float(v) for v in default[:2])
        self.vertical_of: dict[int, tuple[float, float, float]] = {}  # advance down, and the place of the upper origin
        entries, i = [document.get(w) for w in document.of(inner, "W2") or []], 0
        while i + 1 < len(entries):
            if isinstance(entries[i + 1], list):
                triples = [float(document.get(v) or 0) for v in entries[i + 1]]
                for k in range(len(triples) // 3):
                    self.vertical_of[entries[i] + k] = tuple(triples[3 * k : 3 * k + 3])
                i += 2
            elif i + 4 < len(entries):
                for cid in range(int(entries[i]), min(int(entries[i + 1]), int(entries[i]) + 0xFFFF) + 1):
                    self.vertical_of[cid] = tuple(float(v) for v in entries[i + 2 : i + 5])
                i += 5
            else:
                break

    def codes(self, raw: bytes) -> list[tuple[int, int]]:
        """Codes of shown bytes with their lengths."""
        if not self.composite:
            return [(b, 1) for b in raw]
        out, at = [], 0
        while at < len(raw):
            code, length = self.cmap.read(raw, at)
            out.append((code, length))
            at += length
        return out

    @property
    def vertical(self) -> bool:
        """Whether the font is written from top to bottom."""
        return self.composite and self.cmap.vertical

    def downward(self, code: int, length: int) -> tuple[float, float, float]:
        """The advance down and the upper origin of a code, in thousandths of the size."""
        cid = self.cmap.cid(code, length)
        found = self.vertical_of.get(code if cid is None else cid)
        return found or (self.down, self.width(code, length) / 2, self.origin_y)

    def shown(self, raw: bytes) -> list[tuple[int, int, str | None, float]]:
        """Codes of shown bytes with length, text and width; each is worked out once."""
        known, out = self._known, []
        for key in raw if not self.composite else self.codes(raw):
            if (found := known.get(key)) is None:
                code, length = (key, 1) if not self.composite else key
                found = known[key] = (code, length, self.text(code, length), self.width(code, length))
            out.append(found)
        return out

    def text(self, code: int, length: int) -> str | None:
        """The text of a code; None for an unmapped one."""
        if self.to_unicode is not None:
            order = (length, 2, 1, 3, 4) if self.composite else (1, 2)
            for size in dict.fromkeys(order):
                if (found := self.to_unicode.unicode(code, size)) is not None:
                    return found
        if self.composite:
            if (found := self.cmap.unicode(code, length)) is not None:
                return found
            cid = self.cmap.cid(code, length)
            if self.characters is not None and cid is not None and (found := self.characters.unicode(cid, 2)) is not None:
                return found
            value = code if self.cmap.cid_ranges == [(2, 0, 0xFFFF, 0)] or cid is None else cid
            return chr(value) if 0 < value < 0xD800 or 0xDFFF < value < 0x110000 else None
        if (found := self.table.get(code)) is not None:
            return found
        return chr(code) if self.subtype == "Type3" and 32 <= code < 127 else None

    @functools.cached_property
    def space(self) -> float:
        """The width of a space, or what stands for it, in units of the size."""
        if (width := self.width(32, 1)) > 0:
            return width / 1000
        return 0.8 * self.width(65, 1) / 1000 if self.width(65, 1) > 0 else 0.25

    def width(self, code: int, length: int) -> float:
        """The advance in thousandths of the size."""
        if not self.composite:
            return self.widths.get(code, self.default) * (self.scale * 1000 if self.subtype == "Type3" else 1)
        cid = self.cmap.cid(code, length)
        cid = code if cid is None else cid
        if cid in self.widths:
            return self.widths[cid]
        i = bisect_right(self.starts, cid) - 1
        return self.ranges[i][2] if i >= 0 and cid <= self.ranges[i][1] else self.default
