"""The second way of reading a page: by articles, with rules for forms, bidirectional text and hanging indents.

Against `layout` it keeps emission order unless asked to sort, drops
overprints as glyphs come, puts glyphs to articles by beads, looks at fonts for
spacing, and writes lines, paragraphs and articles with marks around them.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left, bisect_right, insort
from dataclasses import dataclass, field
from functools import cmp_to_key

from paperloom.functions.layout import LIST_STARTS, adjusted, direction, overlap

_LISTS = [re.compile(p) for p in LIST_STARTS]
# Marks that turn round in text from right to left.
_MIRRORED = dict(zip("()[]{}<>«»‹›≤≥", ")(][}{><»«›‹≥≤"))


@dataclass
class Marks:
    """What stands around the parts of a text, and how lines are told apart."""

    sort: bool = False
    word: str = " "
    line: str = "\n"
    paragraph_start: str = ""
    paragraph_end: str = ""
    page_start: str = ""
    page_end: str = "\n"
    article_start: str = ""
    article_end: str = ""
    suppress_duplicates: bool = True
    spacing_tolerance: float = 0.5
    average_tolerance: float = 0.3
    drop_threshold: float = 2.5
    indent_threshold: float = 2.0


@dataclass(slots=True)
class Piece:
    """A glyph as this way of reading sees it."""

    text: str
    x: float
    y: float
    width: float
    height: float
    space: float
    angle: int
    font: str = ""
    size: float = 0.0
    actual: bool = False


@dataclass
class Line:
    pieces: list[Piece] = field(default_factory=list)
    words: list[str] = field(default_factory=list)
    paragraph: bool = False
    hanging: bool = False

    @property
    def start(self) -> Piece:
        return self.pieces[0]

    @property
    def text(self) -> str:
        return "".join(self.words)


def article_of(x: float, y: float, beads: list[tuple[float, float, float, float] | None]) -> int:
    """The article of a place, y downwards: odd ones are in a bead, even ones before it, the last one behind all."""
    left_or_above = left = above = None
    for i, bead in enumerate(beads):
        if bead is None:
            return 0
        x0, y0, x1, y1 = bead
        if x0 <= x < x1 and y0 <= y < y1:
            return 2 * i + 1
        if (x < x0 or y < y0) and left_or_above is None and x < x0 and y < y0:
            left_or_above = i
        elif x < x0 and left is None:
            left = i
        elif y < y0 and above is None:
            above = i
    for found in (left_or_above, left, above):
        if found is not None:
            return 2 * found
    return 2 * len(beads)


def compare(a: Piece, b: Piece) -> int:
    """By direction, then by x where the glyphs overlap in height, else by y."""
    if a.angle != b.angle:
        return -1 if a.angle < b.angle else 1
    top_a, top_b = a.y - a.height, b.y - b.height
    if abs(a.y - b.y) < 0.1 or top_a <= b.y <= a.y or top_b <= a.y <= b.y:
        return (a.x > b.x) - (a.x < b.x)
    return -1 if a.y < b.y else 1


def in_order(pieces: list[Piece]) -> list[Piece]:
    """Pieces sorted by `compare`, which is no order of all of them; merging keeps the result defined."""
    return sorted(pieces, key=cmp_to_key(compare))


@dataclass(slots=True)
class Kept:
    """Places of pieces with one text, by y and by x, so that only near ones are compared."""

    rows: list[float] = field(default_factory=list)
    places: dict[float, list[float]] = field(default_factory=dict)
    odd: list[tuple[float, float]] = field(default_factory=list)  # no numbers to sort by

    def add(self, piece: Piece) -> None:
        if not (math.isfinite(piece.x) and math.isfinite(piece.y)):
            self.odd.append((piece.x, piece.y))
            return
        if piece.y not in self.places:
            insort(self.rows, piece.y)
            self.places[piece.y] = []
        insort(self.places[piece.y], piece.x)

    def hides(self, piece: Piece) -> bool:
        """Whether one of them lies within a third of a letter's width."""
        reach = piece.width / max(len(piece.text), 1) / 3
        within = lambda x, y: -reach <= x - piece.x < reach and -reach <= y - piece.y < reach
        if not (math.isfinite(piece.x) and math.isfinite(piece.y) and math.isfinite(reach)):
            return any(within(x, y) for y, xs in self.places.items() for x in xs) or any(within(*o) for o in self.odd)
        # a little farther than the reach, as sums are rounded; the rule itself decides
        far_x, far_y = (reach + 1e-9 * (abs(v) + reach) for v in (piece.x, piece.y))
        for y in self.rows[bisect_left(self.rows, piece.y - far_y) : bisect_right(self.rows, piece.y + far_y)]:
            xs = self.places[y]
            if any(within(x, y) for x in xs[bisect_left(xs, piece.x - far_x) : bisect_right(xs, piece.x + far_x)]):
                return True
        return any(within(*o) for o in self.odd)


def _is_diacritic(text: str) -> bool:
    return len(text) == 1 and text != "ー" and unicodedata.category(text) in ("Mn", "Sk", "Lm")


def _contains(a: Piece, b: Piece) -> bool:
    """Whether two pieces overlap in height and by more than 15 % in width."""
    if not overlap(a.y, a.height, b.y, b.height):
        return False
    shared = min(a.x + a.width, b.x + b.width) - max(a.x, b.x)
    return shared > 0.15 * min(a.width, b.width) if min(a.width, b.width) > 0 else shared >= 0


_COMBINING = {"´": "́", "`": "̀", "ˆ": "̂", "^": "̂", "¨": "̈", "˜": "̃", "~": "̃", "¯": "̄", "˘": "̆", "˙": "̇", "˚": "̊", "¸": "̧", "˛": "̨", "ˇ": "̌", "˝": "̋"}


def _merge(base: Piece, mark: Piece) -> None:
    base.text = unicodedata.normalize("NFC", base.text + _COMBINING.get(mark.text, mark.text))


def articles(pieces: list[Piece], beads: list, marks: Marks) -> list[list[Piece]]:
    """Pieces by article in emission order, without overprints, accents put to their letters."""
    out: list[list[Piece]] = [[] for _ in range(2 * len(beads) + 1)]
    by_text: dict[str, Kept] = {}
    for p in pieces:
        if marks.suppress_duplicates and not p.actual:
            same = by_text.setdefault(p.text, Kept())
            if same.hides(p):
                continue
            same.add(p)
        article = out[article_of(p.x, p.y, beads) if beads else 0]
        if article and _is_diacritic(p.text) and _contains(article[-1], p):
            _merge(article[-1], p)
        elif article and _is_diacritic(article[-1].text) and _contains(p, article[-1]):
            _merge(p, article[-1])
            article[-1] = p
        else:
            article.append(p)
    return out


def _without_contained_spaces(pieces: list[Piece]) -> list[Piece]:
    out: list[Piece] = []
    for p in pieces:
        if p.text == " " and out and out[-1].x <= p.x and p.x + p.width <= out[-1].x + out[-1].width and out[-1].y - out[-1].height <= p.y - p.height and p.y <= out[-1].y:
            continue
        out.append(p)
    return out


def lines_of(pieces: list[Piece], marks: Marks) -> list[Line]:
    """Lines with their words."""
    out: list[Line] = []
    last: Piece | None = None
    average = last_space = -1.0
    bottom = height = 0.0
    for p in pieces:
        if last is not None and (p.font != last.font or p.size != last.size):
            average = -1.0
        spread = math.inf if not p.space > 0 else p.space * marks.spacing_tolerance if last_space < 0 else (p.space + last_space) / 2 * marks.spacing_tolerance
        each = p.width / max(len(p.text), 1)
        average = each if average < 0 else (average + each) / 2
        if last is None or not overlap(p.y, p.height, bottom, height):
            out.append(Line([p], [p.text]))
            average, bottom, height = -1.0, p.y, p.height
        else:
            line = out[-1]
            if last.x + last.width + min(spread, average * marks.average_tolerance) < p.x and not line.words[-1].endswith(marks.word):
                line.words.append(marks.word)
            line.pieces.append(p)
            line.words.append(p.text)
            if abs(p.x - last.x) > p.space + spread:
                bottom, height = p.y, p.height
            else:
                bottom, height = max(bottom, p.y), max(height, p.height)
        last, last_space = p, p.space
    return out


def _list_pattern(line: Line) -> int | None:
    words = line.text.split()
    return next((i for i, r in enumerate(_LISTS) if words and r.fullmatch(words[0])), None)


def mark_paragraphs(lines: list[Line], marks: Marks) -> None:
    """Tell which lines begin a paragraph: by gap, by indent to either side, with hanging indents, and by alike list items."""
    before: Line | None = None
    for line in lines:
        if before is None:
            line.paragraph = True
        else:
            p, q = line.start, before.start
            tall = max((g.height for g in before.pieces + line.pieces), default=0.0)
            gap = round(abs(p.y - q.y), 3)
            unit = p.space if p.space > 0 else 1.0
            shift = round(p.x - q.x, 3)
            if gap > round(marks.drop_threshold * tall, 3):
                line.paragraph = True
            elif shift > round(marks.indent_threshold * unit, 3):
                if not before.paragraph:
                    line.paragraph = True
                else:
                    line.hanging = True
            elif shift < -round(unit, 3):
                line.paragraph = not before.paragraph or before.hanging or True
            elif abs(shift) < 0.25 * max(p.width, 1e-6):
                if before.hanging:
                    line.hanging = True
                elif before.paragraph and (pattern := _list_pattern(before)) is not None and pattern == _list_pattern(line):
                    line.paragraph = True
        before = line


def normalise(word: str) -> str:
    """Presentation forms of letters as letters; those of Arabic and Hebrew are turned into reading order."""
    out, at = [], 0
    for i, c in enumerate(word):
        if "ﬀ" <= c <= "﷿" or "ﹰ" <= c <= "﻿":
            out.append(word[at:i])
            if c == "ﷲ" and i > 0 and word[i - 1] in "اﺍ":
                out.append("لله")
            else:
                plain = unicodedata.normalize("NFKC", c).strip()
                out.append(plain[::-1] if "יִ" <= c and len(plain) > 1 else plain)
            at = i + 1
    return "".join([*out, word[at:]])


def reordered(text: str) -> str:
    """Visual to reading order: runs from right to left are turned round, their brackets mirrored, numbers kept."""
    kinds = [unicodedata.bidirectional(c) for c in text]
    if not any(k in ("R", "AL") for k in kinds):
        return text
    strong = next((k for k in kinds if k in ("L", "R", "AL")), "L")
    base = strong in ("R", "AL")
    levels: list[int] = []
    last = base
    for k in kinds:
        if k in ("R", "AL"):
            last = True
        elif k == "L":
            last = False
        levels.append(1 if last and k not in ("EN", "AN") else 2 if last else 0)
    runs: list[tuple[bool, str]] = []
    for c, level in zip(text, levels):
        turned = level == 1
        if level == 2 and runs:  # numbers stay as they are within the run
            runs.append((False, c)) if not (runs[-1][0] is False and runs[-1][1].isdigit()) else runs.__setitem__(-1, (False, runs[-1][1] + c))
        elif runs and runs[-1][0] == turned:
            runs[-1] = (turned, runs[-1][1] + c)
        else:
            runs.append((turned, c))
    parts = ["".join(_MIRRORED.get(c, c) for c in reversed(part)) if turned else part for turned, part in runs]
    return "".join(reversed(parts) if base else parts)


def read_page(glyphs: list[tuple], beads: list | None = None, marks: Marks | None = None) -> str:
    """Text of one page.

    ``glyphs`` are ``(unicode, a, b, tx, ty, height, width, space_width,
    page_width, page_height)`` with optional font name and size, in emission
    order; ``beads`` are rectangles with y downwards.
    """
    m = marks or Marks()
    pieces = []
    for g in glyphs:
        text, a, b, tx, ty, height, width, space, page_width, page_height, *rest = g
        if text:
            angle = direction(a, b)
            x, y = adjusted(angle, tx, ty, page_width, page_height) if m.sort else (tx, page_height - ty)
            pieces.append(Piece(text, x, y, abs(width), height, space, angle, *rest[:2]))
    out = [m.page_start]
    for article in articles(pieces, beads or [], m):
        if m.sort:
            article = _without_contained_spaces(in_order(article))
        lines = lines_of(article, m)
        if not lines:
            continue
        mark_paragraphs(lines, m)
        out.append(m.article_start)
        for i, line in enumerate(lines):
            if line.paragraph:
                if i:
                    out.append(m.paragraph_end)
                out.append(m.paragraph_start)
            out.append(reordered("".join(map(normalise, line.words))))
            if i < len(lines) - 1:
                out.append(m.line)
        out += [m.paragraph_end, m.article_end]
    return "".join([*out, m.page_end])
