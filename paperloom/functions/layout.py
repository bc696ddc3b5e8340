"""Text of a page from its glyphs by position: sorting, duplicates, spaces, marks, lines, words and paragraphs.

`assemble` is the exact fold over one page. The parts of it that are relational
are in `paperloom.operators.glyph_geometry` as window functions.
"""

from __future__ import annotations

import itertools
import math
import re
import unicodedata
from collections import defaultdict
from dataclasses import dataclass

import numpy as np

# Signs that stand for two or three letters; ranges of combining marks; starts of list items.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
MARK_RANGES = [(0x300, 0x36F), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x20D0, 0x20FF), (0xFE20, 0xFE2F)]
LIST_STARTS = [r"\.", r"\d+\.", r"\[\d+\]", r"\d+\)", r"[A-Z]\.", r"[a-z]\.", r"[A-Z]\)", r"[a-z]\)", r"[IVXL]+\.", r"[ivxl]+\."]
_LIST = re.compile("|".join(f"(?:{p})" for p in LIST_STARTS))


@dataclass
class Config:
    """How a page is read."""

    sort: bool = True
    suppress_duplicates: bool = True
    word_separator: str = " "
    line_separator: str = "\n"
    paragraph_separator: str = "\n"
    page_separator: str = "\n"
    spacing_tolerance: float = 0.5
    average_tolerance: float = 0.3
    drop_threshold: float = 2.5
    indent_threshold: float = 2.0


def direction(a: float, b: float) -> int:
    """0, 90, 180 or 270, by the larger part of the writing direction."""
    if abs(a) > abs(b):
        return 0 if a > 0 else 180
    return 90 if b > 0 else 270


def adjusted(angle: int, tx: float, ty: float, width: float, height: float) -> tuple[float, float]:
    """Position on the page as seen in the writing direction, downwards."""
    if angle == 0:
        return tx, height - ty
    if angle == 90:
        return ty, tx
    return (width - tx, ty) if angle == 180 else (height - ty, width - tx)


def overlap(y1: float, h1: float, y2: float, h2: float) -> bool:
    """Whether two glyphs are on one line: nearly one height, or the base of one within the other."""
    return abs(y1 - y2) < 0.1 or y1 - h1 <= y2 <= y1 or y2 - h2 <= y1 <= y2


def is_mark(c: str) -> bool:
    return any(low <= ord(c) <= high for low, high in MARK_RANGES)


def is_list_item(text: str) -> bool:
    words = text.split()
    return bool(words) and _LIST.fullmatch(words[0]) is not None


def normalise(text: str) -> str:
    """Ligatures as letters, everything composed."""
    for sign, letters in LIGATURES.items():
        if sign in text:
            text = text.replace(sign, letters)
    return unicodedata.normalize("NFC", text)


@dataclass(slots=True)
class _Placed:
    text: str
    x: float
    y: float
    width: float
    height: float
    space: float
    angle: int


_CELL = 16.0


def _without_duplicates(glyphs: list[_Placed]) -> list[_Placed]:
    """Glyphs without those near a kept one of the same text. Kept ones are looked up by strips of the page."""
    kept: list[_Placed] = []
    strips: dict[tuple[str, int], list[_Placed]] = defaultdict(list)
    for g in glyphs:
        reach = abs(g.width) / max(len(g.text), 1) / 3
        if reach > 0:
            hidden = False
            for strip in range(int((g.y - reach) // _CELL), int((g.y + reach) // _CELL) + 1):
                for o in reversed(strips.get((g.text, strip), ())):
                    if -reach < o.x - g.x < reach and -reach < o.y - g.y < reach:
                        hidden = True
                        break
                if hidden:
                    break
            if hidden:
                continue
        strips[g.text, int(g.y // _CELL)].append(g)
        kept.append(g)
    return kept


def _without_contained_spaces(glyphs: list[_Placed]) -> list[_Placed]:
    out = []
    for i, g in enumerate(glyphs):
        if g.text == " ":
            left, right = g.x, g.x + g.width
            for o in glyphs[max(0, i - 5) : i + 6]:
                if o.x <= left and right <= o.x + o.width and o.text != " " and o.angle == g.angle and overlap(g.y, g.height, o.y, o.height):
                    break
            else:
                out.append(g)
        else:
            out.append(g)
    return out


def _with_marks(glyphs: list[_Placed]) -> list[_Placed]:
    out: list[_Placed] = []
    for g in glyphs:
        if out and g.text[:1] >= "\u0300" and all(map(is_mark, g.text)):
            out[-1].text = unicodedata.normalize("NFC", out[-1].text + g.text)
        elif g.text:
            out.append(g)
    return out


def _assemble_plain(glyphs: list[tuple], c: Config) -> str | None:
    """`assemble` by arrays, for the usual page: all upright and of one height, no overprints, no marks on their own; else None.

    On such a page the glyph before decides about a line, so that only the
    running average of widths is left to be folded.
    """
    rows = [g for g in glyphs if g[0]]
    if len(rows) < 2:
        return None
    texts = [g[0] for g in rows]
    a, b, tx, ty, height, width, space, _, page_height = np.array([g[1:10] for g in rows], float).T
    tall = height[0]
    if not (np.abs(a) > np.abs(b)).all() or not (a > 0).all() or not (height == tall).all() or not (space > 0).all() or not np.isfinite(tx + ty + width).all():
        return None
    kinds: dict[str, int] = {}
    code = np.fromiter((kinds.setdefault(t, len(kinds)) for t in texts), np.int64, len(texts))
    if any(t >= "\u0300" and all(map(is_mark, t)) for t in kinds):
        return None
    x, y, width = tx.astype("f4").astype(float), (page_height - ty).astype("f4").astype(float), np.abs(width)
    size = np.array([len(t) for t in kinds])[code]
    if c.suppress_duplicates:
        reach = width / size / 3
        most = reach.max()
        if most > 0:
            for shift in (0.0, most):  # glyphs that could hide each other share a strip of one of the two divisions
                strip = np.floor((y + shift) / (2 * most))
                near = np.lexsort((x, strip, code))
                p, q = near[:-1], near[1:]
                if ((code[p] == code[q]) & (strip[p] == strip[q]) & (x[q] - x[p] < np.maximum(reach[p], reach[q]))).any():
                    return None
    order = np.lexsort((x, y))
    x, y, width, space, code, size = x[order], y[order], width[order], space[order], code[order], size[order]
    blank = code == kinds.get(" ", -1)
    if blank.any():
        inside = np.zeros(len(x), bool)
        for k in range(1, 6):
            for first, second in ((slice(None, -k), slice(k, None)), (slice(k, None), slice(None, -k))):
                near = blank[first] & ~blank[second] & (x[second] <= x[first]) & (x[first] + width[first] <= x[second] + width[second])
                gap = np.abs(y[first] - y[second])
                inside[first] |= near & ((gap < 0.1) | (gap <= tall))
        if inside.any():
            x, y, width, space, code, size = (v[~inside] for v in (x, y, width, space, code, size))
    if not len(x):
        return ""
    drop = np.diff(y)
    starts = np.concatenate(([0], np.flatnonzero(~((drop < 0.1) | (drop <= tall))) + 1))
    ends = np.append(starts[1:], len(x))
    each = width / size
    if (each == each[0]).all():
        average = each
    else:
        folded: list[float] = []
        values = each.tolist()
        for s, e in zip(starts.tolist(), ends.tolist()):
            folded.append(0.0)
            folded.extend(itertools.accumulate(values[s + 1 : e], lambda m, w: (m + w) / 2))
        average = np.array(folded)
    spread = space * c.spacing_tolerance
    spread[1:] = (space[1:] + space[:-1]) / 2 * c.spacing_tolerance
    wide = np.zeros(len(x), bool)
    wide[1:] = x[:-1] + width[:-1] + np.minimum(spread[1:], average[1:] * c.average_tolerance) < x[1:]
    wide[starts] = False
    names = list(kinds)
    out = [names[k] for k in code.tolist()]
    shown = out[:]
    for i in np.flatnonzero(wide).tolist():
        if not shown[i - 1].endswith(c.word_separator):
            out[i] = c.word_separator + out[i]
    before, paragraph = starts[0], True
    for s in starts[1:].tolist():
        unit = max(space[s], 1.0)
        new = abs(y[s] - y[before]) > c.drop_threshold * tall or not paragraph and (x[s] - x[before] > c.indent_threshold * unit or x[before] - x[s] > unit)
        out[s] = (c.paragraph_separator if new else c.line_separator) + out[s]
        before, paragraph = s, new
    return normalise("".join(out))


def assemble(glyphs: list[tuple], config: Config | None = None) -> str:
    """Text of one page.

    ``glyphs`` are ``(unicode, a, b, tx, ty, height, width, space_width,
    page_width, page_height)`` in emission order; null texts are left out.
    """
    c = config or Config()
    if c.sort and (text := _assemble_plain(glyphs, c)) is not None:
        return text
    placed = []
    for text, a, b, tx, ty, height, width, space, page_width, page_height in glyphs:
        if text:
            angle = direction(a, b)
            x, y = adjusted(angle, tx, ty, page_width, page_height)
            placed.append(_Placed(text, x, y, abs(width), height, space, angle))
    # places are kept in single precision, so that tiny differences do not reorder glyphs
    for axis in ("x", "y"):
        for g, v in zip(placed, np.array([getattr(g, axis) for g in placed], np.float32).tolist()):
            setattr(g, axis, v)
    if c.sort:
        placed.sort(key=lambda g: (g.angle, g.y, g.x))
    if c.suppress_duplicates:
        placed = _without_duplicates(placed)
    placed = _with_marks(_without_contained_spaces(placed))
    if not placed:
        return ""
    out: list[str] = []
    last: _Placed | None = None
    start: _Placed | None = None  # of the line before
    started_paragraph = False
    average = last_space = -1.0
    top_y = top_height = 0.0
    for g in placed:
        new_line = last is None or g.angle != last.angle or not overlap(g.y, g.height, top_y, top_height)
        spread = math.inf if not g.space > 0 else g.space * c.spacing_tolerance if last_space < 0 else (g.space + last_space) / 2 * c.spacing_tolerance
        if new_line:
            if last is not None:
                paragraph = _is_paragraph(g, start, started_paragraph, max(top_height, g.height), c)
                out.append(c.paragraph_separator if paragraph else c.line_separator)
            else:
                paragraph = True
            start, started_paragraph = g, paragraph
            average, top_y, top_height = -1.0, g.y, g.height
        else:
            each = g.width / max(len(g.text), 1)
            average = each if average < 0 else (average + each) / 2
            if last.x + last.width + min(spread, average * c.average_tolerance) < g.x and not out[-1].endswith(c.word_separator):
                out.append(c.word_separator)
            if abs(g.x - last.x) > g.space + spread:
                top_y, top_height = g.y, g.height
            else:
                top_y, top_height = max(top_y, g.y), max(top_height, g.height)
        out.append(g.text)
        last, last_space = g, g.space
    return normalise("".join(out))


def _is_paragraph(g: _Placed, start: _Placed | None, started_paragraph: bool, height: float, c: Config) -> bool:
    if start is None:
        return True
    if abs(g.y - start.y) > c.drop_threshold * height:
        return True
    unit = max(g.space, 1.0)
    if started_paragraph:
        return False
    return g.x - start.x > c.indent_threshold * unit or start.x - g.x > unit
