"""Whole documents as HTML and Markdown from the texts of their pages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.scalars import html_escaped, markdown_escaped

_BLANK = r"\n[ \t]*\n"


def _paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, _BLANK), lambda p: p.rlike(r"\S"))


def html_documents(pages: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """``path, html``: a document of a division for each page and a paragraph for each paragraph.

    ``pages`` are ``path, page_no, text``; the title is that of ``path, title``
    rows, else the first line of the first page, at most 64 characters.
    """
    body = F.concat(F.lit('<div style="page-break-before:always; page-break-after:always"><div>'), F.array_join(F.transform(_paragraphs(F.col("text")), lambda p: F.concat(F.lit("<p>"), html_escaped(p), F.lit("</p>\n"))), ""), F.lit("</div></div>\n"))
    parts = F.array_sort(F.collect_list(F.struct("page_no", body.alias("html"), F.substring_index(F.trim("text"), "\n", 1).alias("first"))))
    rows = pages.groupBy("path").agg(parts.alias("parts"))
    if titles is not None:
        rows = rows.join(titles.select("path", "title").dropDuplicates(["path"]), "path", "left")
    else:
        rows = rows.withColumn("title", F.lit(None).cast("string"))
    title = F.substring(F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.col("parts")[0]["first"], F.lit("")), 1, 64)
    head = F.concat(F.lit('<!DOCTYPE html>\n<html><head><meta charset="UTF-8"><title>'), html_escaped(title), F.lit("</title></head>\n<body>\n"))
    return rows.select("path", F.concat(head, F.array_join(F.transform("parts", lambda p: p["html"]), ""), F.lit("</body></html>")).alias("html"))


def markdown_documents(pages: DataFrame) -> DataFrame:
    """``path, markdown``: paragraphs parted by blank lines, pages by rules."""
    body = F.array_join(F.transform(_paragraphs(F.col("text")), markdown_escaped), "\n\n")
    parts = F.array_sort(F.collect_list(F.struct("page_no", body.alias("text"))))
    return pages.groupBy("path").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n---\n\n").alias("markdown"))


def titled(text: str, limit: int = 64) -> str:
    """A title from a text's first line."""
    return re.split(r"[\r\n]", text.strip(), maxsplit=1)[0][:limit]
