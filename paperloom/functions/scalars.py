"""Scalar functions: strings, dates, page labels, colours and blend modes, as Python and as column functions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# strings ---------------------------------------------------------------------


def decoded_text(raw: Column) -> Column:
    """The text of a string object's bytes: UTF-16 or UTF-8 by its mark, else one byte a character."""
    start = F.hex(F.substring(raw, 1, 3))
    rest = lambda n: F.substring(raw, n, 2_000_000_000)
    return (
        F.when(start.startswith("FEFF"), F.decode(rest(3), "UTF-16BE"))
        .when(start.startswith("FFFE"), F.decode(rest(3), "UTF-16LE"))
        .when(start == "EFBBBF", F.decode(rest(4), "UTF-8"))
        .otherwise(F.decode(raw, "ISO-8859-1"))
    )


def ligatures_expanded(text: Column) -> Column:
    """Ligature signs as letters."""
    from paperloom.functions.layout import LIGATURES

    return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), LIGATURES.items(), text)


def html_escaped(text: Column) -> Column:
    """Text for HTML: the marks of markup, and every character outside 32..126 by number."""
    marks = reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")], text)
    numbered = F.transform(F.split(marks, ""), lambda c: F.when(c.rlike(r"^[ -~]?\z"), c).otherwise(F.concat(F.lit("&#"), _code_point(c), F.lit(";"))))
    return F.array_join(numbered, "")


def _code_point(c: Column) -> Column:
    return F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("bigint")


def markdown_escaped(text: Column) -> Column:
    """Text for Markdown: special characters behind a backslash, raised digits as tags."""
    plain = F.regexp_replace(text, r"([\\`*_{}\[\]()#+\-.!|<>~])", r"\\$1")
    return F.replace(F.replace(plain, F.lit("²"), F.lit("<sup>2</sup>")), F.lit("³"), F.lit("<sup>3</sup>"))


def hit_offsets(text: Column, needle: str, case: bool = True) -> Column:
    """Where a word occurs in a text, from 0; occurrences do not overlap."""
    # not by lower case, which may be longer or shorter than the text
    parts = F.split(text, ("" if case else "(?iu)") + "\\Q" + needle + "\\E", -1)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("hits"))

    def step(have: Column, part: Column) -> Column:
        end = have["at"] + F.length(part)
        return F.struct((end + len(needle)).alias("at"), F.array_append(have["hits"], end).alias("hits"))

    return F.aggregate(F.slice(parts, 1, F.size(parts) - 1), start, step, lambda have: have["hits"])


def hits(text: Column, word: str, case_sensitive: bool = True) -> Column:
    """How often a word occurs, without overlaps."""
    t, w = (text, word) if case_sensitive else (F.lower(text), word.lower())
    if not w:
        return F.lit(0)
    return ((F.length(t) - F.length(F.replace(t, F.lit(w), F.lit("")))) / F.lit(len(w))).cast("bigint")


# dates -----------------------------------------------------------------------

_DATE = re.compile(r"^\s*(?:D:)?(\d{4})(?:(\d\d)(?:(\d\d)(?:(\d\d)(?:(\d\d)(?:(\d\d))?)?)?)?)?\s*(?:([-+Z])(?:(\d\d)'?(?:(\d\d)'?)?)?)?")
_ISO = re.compile(r"^\s*(\d{4})-(\d\d)-(\d\d)(?:[T ](\d\d):(\d\d)(?::(\d\d))?)?(?:\.\d+)?\s*(?:([-+Z])(?:(\d\d):?(\d\d)?)?)?\s*$")


def parse_date(text: str) -> str | None:
    """A PDF or ISO date as ``YYYY-MM-DDTHH:MM:SS`` with its offset; what is missing is its least value. None for what is no date."""
    m = _ISO.match(text) or _DATE.match(text)
    if not m:
        return None
    year, month, day, hour, minute, second = (int(v) if v else d for v, d in zip(m.groups()[:6], (0, 1, 1, 0, 0, 0)))
    lengths = [31, 29 if year % 4 == 0 and (year % 100 or year % 400 == 0) else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
    if not (1 <= month <= 12 and 1 <= day <= lengths[month - 1] and hour < 24 and minute < 60 and second < 60):
        return None
    sign, hours, minutes = m.group(7), int(m.group(8) or 0), int(m.group(9) or 0)
    offset = "" if sign is None else "Z" if sign == "Z" or not hours and not minutes else f"{sign}{hours:02d}:{minutes:02d}"
    return f"{year:04d}-{month:02d}-{day:02d}T{hour:02d}:{minute:02d}:{second:02d}{offset}"


def pdf_date(time: Column) -> Column:
    """A timestamp in UTC as a PDF date."""
    return F.concat(F.lit("D:"), F.date_format(time, "yyyyMMddHHmmss"), F.lit("Z"))


def parsed_date(text: Column) -> Column:
    """The timestamp in UTC of a PDF date; null for what is none."""
    digits = F.regexp_extract(text, r"^\s*(?:D:)?(\d{4,14})", 1)
    full = F.concat(digits, F.substring(F.lit("00000101000000"), F.length(digits) + 1, F.lit(14)))
    sign, hours, minutes = (F.regexp_extract(text, r"^\s*(?:D:)?\d{4,14}([-+])(\d\d)'?(\d\d)?", g) for g in (1, 2, 3))
    shift = F.when(sign == "", 0).otherwise(F.when(sign == "-", 1).otherwise(-1) * (F.try_to_number(hours, F.lit("99")) * 60 + F.coalesce(F.try_to_number(minutes, F.lit("99")), F.lit(0))))
    return F.when((F.length(digits) >= 4) & (F.length(digits) % 2 == 0), F.try_to_timestamp(full, F.lit("yyyyMMddHHmmss")) + F.make_dt_interval(mins=shift.cast("int")))


# page labels -------------------------------------------------------------------

_ROMAN = [(900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")]


def roman(n: int) -> str:
    out = "m" * (n // 1000)
    n %= 1000
    for value, sign in _ROMAN:
        out += sign * (n // value)
        n %= value
    return out


def letters(n: int) -> str:
    """a to z, then aa to zz and so on, one letter repeated."""
    return chr(ord("a") + (n - 1) % 26) * ((n - 1) // 26 + 1)


def page_labels(ranges: list[tuple[int, str | None, str, int]], count: int) -> list[str]:
    """Labels of ``count`` pages from ranges ``(first page from 0, style, prefix, first number)``; without ranges, plain numbers."""
    if not ranges or ranges[0][0] > 0:
        ranges = [(0, "D", "", 1), *ranges]
    out = []
    for i in range(count):
        first, style, prefix, start = [r for r in ranges if r[0] <= i][-1]
        n = i - first + start
        shown = {None: "", "D": str(n), "r": roman(n), "R": roman(n).upper(), "a": letters(n) if n > 0 else "", "A": letters(n).upper() if n > 0 else ""}.get(style, str(n))
        out.append(prefix + shown)
    return out


def roman_label(n: Column) -> Column:
    """Small roman numerals of a positive number; thousands are repeated."""
    place = lambda unit, one, five, ten: F.element_at(F.array(*[F.lit(x) for x in ("", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten)]), (F.floor(n / unit) % 10 + 1).cast("int"))
    return F.concat(F.repeat(F.lit("m"), F.floor(n / 1000).cast("int")), place(100, "c", "d", "m"), place(10, "x", "l", "c"), place(1, "i", "v", "x"))


def letter_label(n: Column) -> Column:
    """Small letters of a positive number, one letter repeated."""
    return F.repeat(F.chr((n - 1) % 26 + 97), (F.floor((n - 1) / 26) + 1).cast("int"))


# colours -----------------------------------------------------------------------


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> tuple[Column, Column, Column]:
    return tuple((1 - x) * (1 - k) for x in (c, m, y))


def rgb_to_gray(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def lab_to_xyz(lightness: Column, a: Column, b: Column, white: tuple[float, float, float] = (0.9505, 1.0, 1.089)) -> tuple[Column, Column, Column]:
    level = (lightness + 16) / 116
    cube = lambda v: F.when(v >= 6 / 29, v * v * v).otherwise(108 / 841 * (v - 4 / 29))
    return white[0] * cube(level + a / 500), white[1] * cube(level), white[2] * cube(level - b / 200)


def _soft_light(b: Column, s: Column) -> Column:
    d = F.when(b <= 0.25, ((16 * b - 12) * b + 4) * b).otherwise(F.sqrt(b))
    return F.when(s <= 0.5, b - (1 - 2 * s) * b * (1 - b)).otherwise(b + (2 * s - 1) * (d - b))


#: Separable blend modes: result of backdrop and source, each from 0 to 1.
BLEND_MODES = {
    "Normal": lambda b, s: s,
    "Multiply": lambda b, s: b * s,
    "Screen": lambda b, s: b + s - b * s,
    "Overlay": lambda b, s: F.when(b <= 0.5, 2 * b * s).otherwise(1 - 2 * (1 - b) * (1 - s)),
    "Darken": lambda b, s: F.least(b, s),
    "Lighten": lambda b, s: F.greatest(b, s),
    "ColorDodge": lambda b, s: F.when(b == 0, 0.0).when(b >= 1 - s, 1.0).otherwise(F.try_divide(b, 1 - s)),
    "ColorBurn": lambda b, s: F.when(b == 1, 1.0).when(1 - b >= s, 0.0).otherwise(1 - F.try_divide(1 - b, s)),
    "HardLight": lambda b, s: F.when(s <= 0.5, 2 * b * s).otherwise(1 - 2 * (1 - b) * (1 - s)),
    "SoftLight": _soft_light,
    "Difference": lambda b, s: F.abs(b - s),
    "Exclusion": lambda b, s: b + s - 2 * b * s,
}


def _luminosity(c: tuple) -> Column:
    return 0.3 * c[0] + 0.59 * c[1] + 0.11 * c[2]


def _clipped(c: tuple) -> tuple:
    level, low, high = _luminosity(c), F.least(*c), F.greatest(*c)
    up = tuple(F.when(low < 0, level + F.try_divide((x - level) * level, level - low)).otherwise(x) for x in c)
    return tuple(F.when(high > 1, level + F.try_divide((x - level) * (1 - level), high - level)).otherwise(x) for x in up)


def _with_luminosity(c: tuple, level: Column) -> tuple:
    shift = level - _luminosity(c)
    return _clipped(tuple(x + shift for x in c))


def _with_saturation(c: tuple, saturation: Column) -> tuple:
    low, high = F.least(*c), F.greatest(*c)
    return tuple(F.coalesce(F.try_divide((x - low) * saturation, high - low), F.lit(0.0)) for x in c)


def _saturation(c: tuple) -> Column:
    return F.greatest(*c) - F.least(*c)


#: Modes that blend the three parts of a colour together.
COLOR_BLEND_MODES = {
    "Hue": lambda b, s: _with_luminosity(_with_saturation(s, _saturation(b)), _luminosity(b)),
    "Saturation": lambda b, s: _with_luminosity(_with_saturation(b, _saturation(s)), _luminosity(b)),
    "Color": lambda b, s: _with_luminosity(s, _luminosity(b)),
    "Luminosity": lambda b, s: _with_luminosity(b, _luminosity(s)),
}
