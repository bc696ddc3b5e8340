"""The graphics of content streams: what is painted where, with which colours, lines and clip.

The interpreter keeps the whole graphics state of a page and gives a row for
each painted path, shading and image: its bounds on the page (curves by their
true extent), the rule it is filled by, the state it is painted with, and the
bounds of the clip at that moment.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from typing import Any, NamedTuple

from paperloom.functions.content import IDENTITY, MAX_FORMS, Matrix, multiply, operations
from paperloom.functions.cos import Document, Name, Stream

Bounds = tuple[float, float, float, float]
_EVERYTHING: Bounds = (float("-inf"), float("-inf"), float("inf"), float("inf"))
# Components of the device colour spaces, and their first colour.
_FIRST = {"DeviceGray": (0.0,), "DeviceRGB": (0.0, 0.0, 0.0), "DeviceCMYK": (0.0, 0.0, 0.0, 1.0), "CalGray": (0.0,), "CalRGB": (0.0, 0.0, 0.0), "Lab": (0.0, 0.0, 0.0), "Indexed": (0.0,), "Separation": (1.0,)}
# Painting operators: whether the path is closed first, filled (with its rule), stroked.
_PAINT = {
    "S": (False, "", True), "s": (True, "", True), "f": (False, "nonzero", False), "F": (False, "nonzero", False), "f*": (False, "evenodd", False),
    "B": (False, "nonzero", True), "B*": (False, "evenodd", True), "b": (True, "nonzero", True), "b*": (True, "evenodd", True), "n": (False, "", False),
}
# Operators that set a device space and its colour.
_DEVICE = {"g": "DeviceGray", "G": "DeviceGray", "rg": "DeviceRGB", "RG": "DeviceRGB", "k": "DeviceCMYK", "K": "DeviceCMYK"}


class Painted(NamedTuple):
    """``kind`` is path, shading, image or inline; ``rule`` of a fill is nonzero or evenodd, '' if there is none."""

    kind: str
    name: str | None
    rule: str
    stroked: bool
    x0: float
    y0: float
    x1: float
    y1: float
    subpaths: int
    segments: int
    line_width: float
    line_cap: int
    line_join: int
    miter_limit: float
    dash: list[float]
    dash_phase: float
    flatness: float
    intent: str
    fill_space: str
    fill: list[float]
    fill_pattern: str | None
    stroke_space: str
    stroke: list[float]
    stroke_pattern: str | None
    fill_alpha: float
    stroke_alpha: float
    clip: Bounds


@dataclass
class _Color:
    space: str = "DeviceGray"
    parts: tuple[float, ...] = (0.0,)
    pattern: str | None = None


@dataclass
class _State:
    ctm: Matrix = IDENTITY
    width: float = 1.0
    cap: int = 0
    join: int = 0
    miter: float = 10.0
    dash: tuple[float, ...] = ()
    phase: float = 0.0
    flatness: float = 1.0
    intent: str = "RelativeColorimetric"
    fill: _Color = field(default_factory=_Color)
    stroke: _Color = field(default_factory=_Color)
    fill_alpha: float = 1.0
    stroke_alpha: float = 1.0
    clip: Bounds = _EVERYTHING

    def copied(self) -> _State:
        """The state as it is now; of its members only colours are changed in place."""
        return replace(self, fill=replace(self.fill), stroke=replace(self.stroke))


def transformed(m: Matrix, x: float, y: float) -> tuple[float, float]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def within(a: Bounds, b: Bounds) -> Bounds:
    """What two bounds have in common; empty ones have no extent."""
    x0, y0, x1, y1 = max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3])
    return x0, y0, max(x0, x1), max(y0, y1)


def curve_extent(a: float, b: float, c: float, d: float) -> tuple[float, float]:
    """Least and largest value of a cubic curve's coordinate."""
    values = [a, d]
    p, q, r = -a + 3 * b - 3 * c + d, 2 * (a - 2 * b + c), b - a
    roots = []
    if abs(p) > 1e-12:
        inner = q * q - 4 * p * r
        if inner >= 0:
            roots = [(-q + s * inner**0.5) / (2 * p) for s in (1, -1)]
    elif abs(q) > 1e-12:
        roots = [-r / q]
    for t in roots:
        if 0 < t < 1:
            values.append((1 - t) ** 3 * a + 3 * (1 - t) ** 2 * t * b + 3 * (1 - t) * t * t * c + t**3 * d)
    return min(values), max(values)


class _Path:
    """A path in the page's space."""

    def __init__(self) -> None:
        self.bounds: list[float] = []
        self.subpaths = self.segments = 0
        self.start: tuple[float, float] | None = None
        self.at: tuple[float, float] | None = None  # in the space of the stream

    def _reach(self, x0: float, y0: float, x1: float, y1: float) -> None:
        b = self.bounds
        self.bounds = [min(b[0], x0), min(b[1], y0), max(b[2], x1), max(b[3], y1)] if b else [x0, y0, x1, y1]

    def move(self, m: Matrix, x: float, y: float) -> None:
        self.start = self.at = (x, y)
        self.subpaths += 1
        p = transformed(m, x, y)
        self._reach(*p, *p)

    def line(self, m: Matrix, x: float, y: float) -> None:
        if self.at is None:
            return self.move(m, x, y)
        self.at = (x, y)
        self.segments += 1
        p = transformed(m, x, y)
        self._reach(*p, *p)

    def curve(self, m: Matrix, first: tuple[float, float] | None, second: tuple[float, float], end: tuple[float, float]) -> None:
        if self.at is None:
            return self.move(m, *end)
        points = [transformed(m, *p) for p in (self.at, first or self.at, second, end)]
        (x0, x1), (y0, y1) = (curve_extent(*(p[k] for p in points)) for k in (0, 1))
        self._reach(x0, y0, x1, y1)
        self.at = end
        self.segments += 1

    def close(self) -> None:
        if self.start is not None and self.at is not None:
            if self.at != self.start:
                self.segments += 1
            self.at = self.start


class Painter:
    """Runs a page's operators for its graphics. Errors of one operator leave the others alone."""

    def __init__(self, document: Document):
        self.document = document

    def run(self, data: bytes, resources: dict | None) -> Iterator[Painted]:
        yield from self._stream(data, resources or {}, _State(), 0)

    def _row(self, s: _State, kind: str, bounds: Bounds, name: str | None = None, rule: str = "", stroked: bool = False, path: _Path | None = None) -> Painted:
        return Painted(
            kind, name, rule, stroked, *bounds, path.subpaths if path else 0, path.segments if path else 0, s.width, s.cap, s.join, s.miter, list(s.dash), s.phase, s.flatness, s.intent,
            s.fill.space, list(s.fill.parts), s.fill.pattern, s.stroke.space, list(s.stroke.parts), s.stroke.pattern, s.fill_alpha, s.stroke_alpha, s.clip,
        )

    def _space(self, resources: dict, name: str) -> _Color:
        value = self.document.of(self.document.of(resources, "ColorSpace"), name)
        kind = str(self.document.get(value[0])) if isinstance(value, list) and value else str(value) if isinstance(value, Name) else name
        parts = _FIRST.get(kind)
        if parts is None and kind == "ICCBased":
            n = self.document.of(self.document.get(value[1]), "N")
            parts = (0.0,) * (n if isinstance(n, int) else 1)
        if parts is None and kind == "DeviceN":
            names = self.document.get(value[1])
            parts = (1.0,) * (len(names) if isinstance(names, list) else 1)
        return _Color(kind, parts or ())

    def _settings(self, s: _State, resources: dict, name: str) -> None:
        """What a dictionary of graphics state parameters sets."""
        found = self.document.of(self.document.of(resources, "ExtGState"), name)
        for key, value in (found or {}).items():
            value = self.document.get(value)
            if key in ("LW", "ML", "FL", "CA", "ca") and isinstance(value, (int, float)):
                setattr(s, {"LW": "width", "ML": "miter", "FL": "flatness", "CA": "stroke_alpha", "ca": "fill_alpha"}[key], float(value))
            elif key in ("LC", "LJ") and isinstance(value, int):
                setattr(s, {"LC": "cap", "LJ": "join"}[key], value)
            elif key == "D" and isinstance(value, list) and len(value) == 2:
                s.dash, s.phase = tuple(float(v) for v in self.document.get(value[0])), float(value[1])
            elif key == "RI":
                s.intent = str(value)

    def _stream(self, data: bytes, resources: dict, state: _State, depth: int) -> Iterator[Painted]:
        s, saved, path = state, [], _Path()
        clip_rule: str | None = None

        def numbers(args: list, n: int) -> tuple[float, ...]:
            values = args[-n:]
            if len(values) < n or any(isinstance(v, bool) or not isinstance(v, (int, float)) for v in values):
                raise TypeError
            return tuple(map(float, values))

        for op, args in operations(data):
            try:
                if op == "q":
                    saved.append(s.copied())
                elif op == "Q":
                    s = saved.pop() if saved else s
                elif op == "cm":
                    s.ctm = multiply(numbers(args, 6), s.ctm)
                elif op == "w":
                    (s.width,) = numbers(args, 1)
                elif op == "J":
                    s.cap = int(numbers(args, 1)[0])
                elif op == "j":
                    s.join = int(numbers(args, 1)[0])
                elif op == "M":
                    (s.miter,) = numbers(args, 1)
                elif op == "d":
                    s.dash, s.phase = numbers(args[0], len(args[0])) if args[0] else (), numbers(args, 1)[0]
                elif op == "i":
                    (s.flatness,) = numbers(args, 1)
                elif op == "ri":
                    s.intent = str(args[0])
                elif op == "gs":
                    self._settings(s, resources, str(args[0]))
                elif op == "m":
                    path.move(s.ctm, *numbers(args, 2))
                elif op == "l":
                    path.line(s.ctm, *numbers(args, 2))
                elif op in ("c", "v", "y"):
                    v = numbers(args, 6 if op == "c" else 4)
                    first, second, end = {"c": (v[0:2], v[2:4], v[4:6]), "v": (None, v[0:2], v[2:4]), "y": (v[0:2], v[2:4], v[2:4])}[op]
                    path.curve(s.ctm, first, second, end)
                elif op == "h":
                    path.close()
                elif op == "re":
                    x, y, w, h = numbers(args, 4)
                    path.move(s.ctm, x, y)
                    for p in ((x + w, y), (x + w, y + h), (x, y + h)):
                        path.line(s.ctm, *p)
                    path.close()
                elif op in ("W", "W*"):
                    clip_rule = op
                elif op in _PAINT:
                    close, rule, stroked = _PAINT[op]
                    if close:
                        path.close()
                    bounds = tuple(path.bounds)
                    if bounds and (rule or stroked):
                        yield self._row(s, "path", bounds, None, rule, stroked, path)
                    if bounds and clip_rule:
                        s.clip = within(s.clip, bounds)
                    path, clip_rule = _Path(), None
                elif op in _DEVICE:
                    color = _Color(_DEVICE[op], numbers(args, len(_FIRST[_DEVICE[op]])))
                    setattr(s, "fill" if op.islower() else "stroke", color)
                elif op in ("cs", "CS"):
                    setattr(s, "fill" if op == "cs" else "stroke", self._space(resources, str(args[0])))
                elif op in ("sc", "scn", "SC", "SCN"):
                    color = s.fill if op.islower() else s.stroke
                    color.pattern = str(args[-1]) if args and isinstance(args[-1], Name) else None
                    parts = args[:-1] if color.pattern is not None else args
                    color.parts = numbers(parts, len(parts)) if parts else ()
                elif op == "sh":
                    yield self._row(s, "shading", s.clip, str(args[0]))
                elif op == "BI":
                    yield self._row(s, "inline", self._square(s.ctm))
                elif op == "Do":
                    yield from self._object(str(args[0]), resources, s, depth)
            except (TypeError, ValueError, IndexError, AttributeError, KeyError):
                continue

    @staticmethod
    def _square(m: Matrix, x0: float = 0.0, y0: float = 0.0, x1: float = 1.0, y1: float = 1.0) -> Bounds:
        corners = [transformed(m, x, y) for x in (x0, x1) for y in (y0, y1)]
        return min(x for x, _ in corners), min(y for _, y in corners), max(x for x, _ in corners), max(y for _, y in corners)

    def _object(self, name: str, resources: dict, s: _State, depth: int) -> Iterator[Painted]:
        found = self.document.of(self.document.of(resources, "XObject"), name)
        kind = self.document.of(found, "Subtype") if isinstance(found, Stream) else None
        if kind == "Image":
            yield self._row(s, "image", self._square(s.ctm), name)
        elif kind == "Form" and depth < MAX_FORMS:
            inner = s.copied()
            matrix, box = (self.document.of(found, k) for k in ("Matrix", "BBox"))
            if isinstance(matrix, list) and len(matrix) >= 6:
                inner.ctm = multiply(tuple(float(self.document.get(v)) for v in matrix[:6]), inner.ctm)
            if isinstance(box, list) and len(box) >= 4:
                inner.clip = within(inner.clip, self._square(inner.ctm, *(float(self.document.get(v)) for v in box[:4])))
            own = self.document.of(found, "Resources")
            yield from self._stream(self.document.decoded(found), own if isinstance(own, dict) else resources, inner, depth + 1)


def visible_layers(document: Document) -> dict[int, bool]:
    """Of each optional content group, by object number, whether it shows at first."""
    properties: Any = document.catalog.get("OCProperties")
    config = document.of(properties, "D")
    base = document.of(config, "BaseState") != "OFF"
    lists = {k: {getattr(r, "number", None) for r in document.of(config, k) or []} for k in ("ON", "OFF")}
    groups = document.of(properties, "OCGs")
    return {g.number: g.number in lists["ON"] or base and g.number not in lists["OFF"] for g in groups if hasattr(g, "number")} if isinstance(groups, list) else {}
