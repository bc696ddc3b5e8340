"""Operators on pages and on several documents: boxes, labels, splitting, merging, overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.scalars import letter_label, roman_label
from paperloom.session import durable

#: A page without any box is of letter size.
DEFAULT_BOX = (0.0, 0.0, 612.0, 792.0)


def inherited_boxes(pages: DataFrame) -> DataFrame:
    """Pages with the last box given up to them, else letter size: an as-of look-up in a table that holds no page tree."""
    before = Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, 0)
    default = F.struct(*(F.lit(v).cast("float").alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), DEFAULT_BOX)))
    return pages.withColumn("box", F.coalesce(F.last_value("media_box", F.lit(True)).over(before), default))


def labelled(style: Column, n: Column) -> Column:
    """The label of number ``n`` in a style: D, R, r, A, a or none."""
    r, a = roman_label(n), letter_label(n)
    return F.when(style == "D", n.cast("string")).when(style == "r", r).when(style == "R", F.upper(r)).when(style == "a", a).when(style == "A", F.upper(a)).otherwise(F.lit(""))


def split_parts(pages: DataFrame, every: int, start: int = 1, end: int | None = None) -> DataFrame:
    """Pages of ``start..end`` with the number of the part they go to and their place in it; a part has ``every`` pages."""
    first = max(1, start)
    chosen = pages.where((F.col("page_no") >= first) & (F.col("page_no") <= end if end is not None else F.lit(True)))
    offset = (F.col("page_no") - first).cast("bigint")
    return chosen.withColumn("part_no", F.floor(offset / every)).withColumn("part_page", offset % every + 1)


def merged(pages: DataFrame, order: list[str]) -> DataFrame:
    """Pages of all documents as one: ``merged_no`` counts on over the documents in an order.

    Documents are split to ranges of that order, one to each task; what stands
    before a range comes from the sums of the ranges, of which there are as
    many as tasks, and within a range from its own documents.
    """
    sizes = durable(pages.groupBy(*order).agg(F.count("*").alias("_size")).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    ranges = sizes.groupBy("_range").agg(F.sum("_size").alias("_all"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("_range", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.join(offsets, "_range").withColumn("_start", F.col("_offset") + F.coalesce(F.sum("_size").over(within), F.lit(0))).drop("_size", "_range", "_offset")
    return pages.join(starts, order).withColumn("merged_no", F.col("_start") + F.row_number().over(Window.partitionBy(*order).orderBy("page_no"))).drop("_start")


def overlay_rule(page_no: Column, n_pages: Column, specific: dict[int, str], first: str | None, last: str | None, odd: str | None, even: str | None, default: str | None, cycle: list[str]) -> Column:
    """Which overlay a page gets: that of its number, else of the first or last page, of odd or even ones, the default, or the pages of one file in turn."""
    rule = F.lit(None).cast("string")
    if cycle:
        rule = F.element_at(F.array(*map(F.lit, cycle)), ((page_no - 1) % len(cycle) + 1).cast("int"))
    if default is not None:
        rule = F.lit(default)
    for name, applies in ((even, page_no % 2 == 0), (odd, page_no % 2 == 1), (last, page_no == n_pages), (first, page_no == 1)):
        if name is not None:
            rule = F.when(applies, F.lit(name)).otherwise(rule)
    for number, name in specific.items():
        rule = F.when(page_no == number, F.lit(name)).otherwise(rule)
    return rule


def booklet_place(page_no: Column, n_pages: Column) -> list[Column]:
    """``sheet, side, half`` of a page where sheets of four pages are put into each other and folded; missing pages are blank."""
    total = (F.ceil(n_pages / 4) * 4).cast("int")
    outer = F.least(page_no, total + 1 - page_no)
    return [
        F.floor((outer + 1) / 2).cast("int").alias("sheet"),
        F.when(outer % 2 == 1, F.lit("front")).otherwise(F.lit("back")).alias("side"),
        F.when(page_no % 2 == 1, F.lit("right")).otherwise(F.lit("left")).alias("half"),
    ]
