"""Queries over PDF files. The tables hold none, so files are made of their texts and read again."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.documents_markup import html_documents
from paperloom.functions.layout import LIGATURES
from paperloom.functions.markup import xfdf_files
from paperloom.operators.nested import form_field_values
from paperloom.session import spread, table
from paperloom.sources import pdf_tables as T
from paperloom.sources.pdf_edit import encrypt, split_files
from paperloom.sources.pdf_writer import texts_to_pdf


# White space, and what is none but does not show: controls and joiners.
_BLANK = r"[\s\x{00}-\x{20}\x{7f}-\x{a0}\x{ad}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{2064}\x{3000}\x{feff}]+"


def _files(spark: SparkSession, folder: str, packed: bool = False) -> DataFrame:
    rows = table(spark, folder, "documents").where("text is not null").select("doc_id", "text")
    return texts_to_pdf(spread(rows), "doc_id", "text", packed)


def _key(rows: DataFrame) -> DataFrame:
    return rows.withColumn("doc_id", F.col("path").cast("bigint")).drop("path")


def pdf_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's text, written to a file and read from its pages, all scripts; only white space is left out, as lines are wrapped."""
    read = _key(T.document_text(_files(spark, folder)))
    return read.select("doc_id", "status", F.regexp_replace("text", _BLANK, "").alias("text"))


def pdf_packed(spark: SparkSession, folder: str) -> DataFrame:
    """Files with object streams and table streams: pages of each."""
    rows = _key(T.documents(_files(spark, folder, packed=True)))
    return rows.select("doc_id", "status", "version", "encrypted", "recovered", (F.col("page_count") > 0).alias("has_pages"))


def pdf_damaged(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-14: files whose table of objects is cut off are found again by search."""
    files = _files(spark, folder)
    cut = files.withColumn("content", F.concat(F.unhex(F.lit("0A0A")), F.expr("substring(content, 1, cast(octet_length(content) - 40 as int))")))
    return _key(T.document_text(cut)).select("doc_id", "status", F.regexp_replace("text", _BLANK, "").alias("text"))


def pdf_encrypted(spark: SparkSession, folder: str) -> DataFrame:
    """EXT-13: files sealed with an empty user password are opened and read."""

    @F.pandas_udf("binary")
    def sealed(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: encrypt(bytes(c), owner="owner", allowed={"print"}))

    rows = _files(spark, folder).withColumn("content", sealed("content"))
    return _key(T.document_text(rows)).select("doc_id", "status", F.regexp_replace("text", _BLANK, "").alias("text"))


def pdf_full_text(spark: SparkSession, folder: str) -> DataFrame:
    """The second way of reading, in emission order."""
    pages = T.page_text_full(_files(spark, folder)).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "")
    return _key(pages).select("doc_id", F.regexp_replace(text, _BLANK, "").alias("text"))


def pdf_split_parts(spark: SparkSession, folder: str) -> DataFrame:
    """MPD-02: files of single pages: as many parts as pages, each of one page."""
    parts = split_files(_files(spark, folder), 1)
    read = T.documents(parts.select(F.concat("path", F.lit("/"), "part_no").alias("path"), "content"))
    return read.groupBy(F.substring_index("path", "/", 1).cast("bigint").alias("doc_id")).agg(F.count("*").alias("parts"), F.max("page_count").alias("most"))


def html_pages(spark: SparkSession, folder: str) -> DataFrame:
    """TXT-24: results as HTML documents."""
    pages = table(spark, folder, "batch_results").where("result is not null").select(F.col("result_id").cast("string").alias("path"), F.lit(1).alias("page_no"), F.col("result").alias("text")).distinct()
    return html_documents(pages)


def xfdf_export(spark: SparkSession, folder: str) -> DataFrame:
    """EXT-07: form values as XFDF."""
    return xfdf_files(form_field_values(table(spark, folder, "fdf_documents")))


def pdf_pages_read(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with inherited boxes, by size."""
    rows = T.pages(_files(spark, folder))
    return rows.groupBy("page_no").agg(F.count("*").alias("pages"), F.max("media_box.x1").cast("double").alias("width"), F.max("media_box.y1").cast("double").alias("height"))


def pdf_op_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How often each operator occurs."""
    return T.ops(_files(spark, folder)).groupBy("op").agg(F.count("*").alias("uses"))


def pdf_glyph_counts(spark: SparkSession, folder: str) -> DataFrame:
    """ASCII glyphs besides spaces in each document."""
    rows = T.glyphs(_files(spark, folder), columns=["path", "unicode"]).where(F.col("unicode").rlike("^[!-~]$"))
    return _key(rows.groupBy("path").agg(F.count("*").alias("glyphs")))


def pdf_object_types(spark: SparkSession, folder: str) -> DataFrame:
    """Numbered objects by type, with the bytes of their streams."""
    rows = T.objects(_files(spark, folder)).groupBy("type").agg(F.count("*").alias("objects"), F.count("raw_len").alias("streams"))
    return rows


_ASCII = "regexp_replace(text, '[^!-~]+', '', 'g')"
_NORMAL = "regexp_replace(nfc_normalize(" + "replace(" * len(LIGATURES) + "text" + "".join(f", '{a}', '{b}')" for a, b in LIGATURES.items()) + "), '" + _BLANK + "', '', 'g')"
SQL: dict[str, str] = {
    "pdf_roundtrip": f"select doc_id, 'ok' as status, {_NORMAL} as text from documents where text is not null",
    "pdf_packed": "select doc_id, 'ok' as status, 1.7::float as version, false as encrypted, false as recovered, true as has_pages from documents where text is not null",
    "pdf_damaged": f"select doc_id, 'ok' as status, {_NORMAL} as text from documents where text is not null",
    "pdf_encrypted": f"select doc_id, 'ok' as status, {_NORMAL} as text from documents where text is not null",
    "pdf_glyph_counts": f"select * from (select doc_id, length({_ASCII}) as glyphs from documents where text is not null) where glyphs > 0",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (pdf_roundtrip, pdf_packed, pdf_damaged, pdf_encrypted, pdf_full_text, pdf_split_parts, html_pages, xfdf_export, pdf_pages_read, pdf_op_counts, pdf_glyph_counts, pdf_object_types)
}
