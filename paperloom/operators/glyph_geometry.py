"""Relational parts of page layout over a glyph table, as built-in column functions and windows.

They take glyph rows (``doc_id, page_no, seq, unicode, a, b, tx, ty, height,
width, space_width, page_width, page_height``). All windows are by page, so
one shuffle by page serves a chain of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = ("doc_id", "page_no")
_CELL = 16.0
COLUMNS = (*PAGE, "seq", "unicode", "a", "b", "tx", "ty", "height", "width", "space_width", "page_width", "page_height")


def page_rows(glyphs: DataFrame) -> DataFrame:
    """The columns that layout needs, by page, without repeats: one shuffle that all windows by page then share."""
    return glyphs.select(*COLUMNS).repartition(*PAGE).distinct()


def _double(name: str) -> Column:
    return F.col(name).cast("double")


def direction() -> Column:
    """0, 90, 180 or 270, by the larger part of the writing direction."""
    a, b = _double("a"), _double("b")
    return F.when(F.abs(a) > F.abs(b), F.when(a > 0, 0).otherwise(180)).otherwise(F.when(b > 0, 90).otherwise(270))


def with_position(glyphs: DataFrame) -> DataFrame:
    """Adds ``dir, x, y, w, h``: place and size as seen in the writing direction, y downwards."""
    x, y, width, height = (_double(n) for n in ("tx", "ty", "page_width", "page_height"))
    d = F.col("dir")
    return glyphs.withColumn("dir", direction()).withColumns(
        {
            "x": F.when(d == 0, x).when(d == 90, y).when(d == 180, width - x).otherwise(height - y),
            "y": F.when(d == 0, height - y).when(d == 90, x).when(d == 180, y).otherwise(width - x),
            "w": F.abs(_double("width")),
            "h": _double("height"),
        }
    )


def in_reading_order() -> Window:
    return Window.partitionBy(*PAGE).orderBy("dir", "y", "x", "seq")


def glyph_rank(glyphs: DataFrame) -> DataFrame:
    """Adds ``position``: the glyph's number in reading order on its page."""
    return with_position(glyphs).withColumn("position", F.row_number().over(in_reading_order()))


def _not_hidden(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of pages given whole, in order: each glyph is kept unless a kept one of the same text lies near."""
    for batch in batches:
        keep = []
        columns = [batch.column(n).to_pylist() for n in ("doc_id", "page_no", "dir", "unicode", "x", "y", "w")]
        page, kept = None, {}
        for doc, number, turn, text, x, y, w in zip(*columns):
            if (doc, number) != page:
                page, kept = (doc, number), {}
            reach = w / max(len(text), 1) / 3
            near = False
            if reach > 0:
                cells = [(turn, text, i, k) for i in range(int((x - reach) // _CELL), int((x + reach) // _CELL) + 1) for k in range(int((y - reach) // _CELL), int((y + reach) // _CELL) + 1)]
                near = any(abs(x - a) < reach and abs(y - b) < reach for cell in cells for a, b in kept.get(cell, ()))
            if not near:
                kept.setdefault((turn, text, int(x // _CELL), int(y // _CELL)), []).append((x, y))
            keep.append(not near)
        yield pa.RecordBatch.from_arrays([batch.column(n) for n in ("doc_id", "page_no", "seq", "unicode")] + [pa.array(keep, pa.bool_())], names=["doc_id", "page_no", "seq", "unicode", "kept"])


def without_overprints(glyphs: DataFrame) -> DataFrame:
    """``doc_id, page_no, seq, unicode`` of the mapped glyphs without exact repeats and without those near a kept one of the same text.

    Near is less than a third of a character's width; glyphs are taken in
    emission order, and one that is dropped hides no other. A page's glyphs
    meet in one task and come packed as one row, so that pages are whole.
    """
    rows = with_position(page_rows(glyphs.where("unicode is not null")))
    one = F.struct("seq", "unicode", "dir", "x", "y", "w")
    pages = rows.groupBy(*PAGE).agg(F.array_sort(F.collect_list(one)).alias("g"))
    flat = "doc_id bigint, page_no bigint, seq bigint, unicode string, kept boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.slice(i, 1)
                inner = part.column("g").flatten()
                n = len(inner)
                keys = [pa.array([part.column(c)[0].as_py()] * n, pa.int64()) for c in PAGE]
                yield from _not_hidden(iter([pa.RecordBatch.from_arrays([*keys, *inner.flatten()], names=[*PAGE, *(f.name for f in inner.type)])]))

    columns = pages.select(*(F.col(c).cast("bigint").alias(c) for c in PAGE), "g")
    return columns.mapInArrow(run, flat).where("kept").drop("kept")


def overlapping(y1: Column, h1: Column, y2: Column, h2: Column) -> Column:
    return (F.abs(y1 - y2) < 0.1) | y2.between(y1 - h1, y1) | y1.between(y2 - h2, y2)


def contained_spaces(glyphs: DataFrame) -> DataFrame:
    """Adds ``contained``: whether a space lies within another glyph at most five places away on its line."""
    rows = with_position(glyphs)
    order = in_reading_order()

    def around(k: int) -> Column:
        other = (lambda c: F.lag(c, k).over(order)) if k > 0 else (lambda c: F.lead(c, -k).over(order))
        same = (other("dir") == F.col("dir")) & overlapping(F.col("y"), F.col("h"), other("y"), other("h"))
        return F.coalesce(same & (other("unicode") != " ") & (other("x") <= F.col("x")) & (F.col("x") + F.col("w") <= other("x") + other("w")), F.lit(False))

    inside = reduce(lambda x, y: x | y, (around(k) for k in (*range(-5, 0), *range(1, 6))))
    return rows.withColumn("contained", (F.col("unicode") == " ") & inside)


def with_lines(glyphs: DataFrame) -> DataFrame:
    """Adds ``line_no``, from 1: a line begins where a glyph overlaps its predecessor in reading order no more."""
    order = in_reading_order()
    before = lambda c: F.lag(c).over(order)
    starts = F.coalesce(~((before("dir") == F.col("dir")) & overlapping(F.col("y"), F.col("h"), before("y"), before("h"))), F.lit(True))
    return with_position(glyphs).withColumn("_starts", starts.cast("int")).withColumn("line_no", F.sum("_starts").over(order)).drop("_starts")


def words(glyphs: DataFrame) -> DataFrame:
    """``doc_id, page_no, line_no, word_no, text``: words by gaps, without the glyphs of spaces.

    A word begins where the gap to the glyph before is wider than the lesser of
    half a space and three tenths of that glyph's width.
    """
    rows = with_lines(glyphs.where("replace(unicode, ' ', '') <> ''"))
    line = Window.partitionBy(*PAGE, "line_no").orderBy("x", "seq")
    end = F.lag(F.col("x") + F.col("w")).over(line)
    least = F.least(_double("space_width") * 0.5, F.lag("w").over(line) * 0.3)
    starts = F.coalesce(end + least < F.col("x"), F.lit(True)).cast("int")
    numbered = rows.withColumn("_starts", starts).withColumn("word_no", F.sum("_starts").over(line))
    letters = F.array_sort(F.collect_list(F.struct("x", "seq", "unicode")))
    return numbered.groupBy(*PAGE, "line_no", "word_no").agg(F.array_join(F.transform(letters, lambda g: g["unicode"]), "").alias("text"))


def in_regions(glyphs: DataFrame, regions: list[tuple[str, float, float, float, float]]) -> DataFrame:
    """Glyphs with the regions their origin lies in; a glyph may lie in several.

    ``regions`` are ``(name, x0, y0, x1, y1)``, given by the caller, so that
    the list is of known size: it becomes part of the expression and nothing is
    joined.
    """
    x, y = _double("tx"), _double("ty")
    inside = [F.when((x >= x0) & (x < x1) & (y >= y0) & (y < y1), F.lit(name)) for name, x0, y0, x1, y1 in regions]
    return glyphs.withColumn("region", F.explode(F.array_compact(F.array(*inside)))) if regions else glyphs.withColumn("region", F.lit(None).cast("string")).where("false")


def page_angles(glyphs: DataFrame) -> DataFrame:
    """``doc_id, page_no, angles``: the distinct whole angles of a page's glyphs, in order."""
    angle = F.pmod(F.round(F.degrees(F.atan2(_double("b"), _double("a")))), F.lit(360)).cast("int")
    return glyphs.withColumn("angle", angle).groupBy(*PAGE).agg(F.sort_array(F.collect_set("angle")).alias("angles"))
