"""Commands on PDF files: ``python -m paperloom text|html|pages|fields|xmp|images|split|merge|decrypt|encrypt|decode|version ...``.

Each reads files by path patterns, runs as a Spark job, and writes below a
folder that all executors share; the exit code is 1 if a file could not be read.
"""

from __future__ import annotations

import argparse
import sys

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.documents_markup import html_documents
from paperloom.session import ship
from paperloom.sources import pdf_edit, sinks
from paperloom.sources import pdf_tables as T

TABLES = {"pages": T.pages, "fields": T.fields, "xmp": T.metadata, "images": T.images, "outline": T.outline, "annotations": T.annotations, "attachments": T.attachments, "fonts": T.fonts}


def _changed(files: DataFrame, change) -> DataFrame:
    """Files with their content changed, null where that failed."""

    @F.pandas_udf("binary")
    def apply(contents: pd.Series) -> pd.Series:
        def one(content: bytes) -> bytes | None:
            try:
                return change(bytes(content))
            except ValueError:
                return None

        return contents.map(one)

    return files.select("path", apply("content").alias("content"))


def run(spark: SparkSession, arguments: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="paperloom", description=__doc__)
    parser.add_argument("command", choices=["text", "html", "split", "merge", "decrypt", "encrypt", "decode", "version", *TABLES])
    parser.add_argument("files", nargs="*")
    parser.add_argument("--out")
    parser.add_argument("--password", default="")
    parser.add_argument("--every", type=int, default=1)
    given = parser.parse_args(arguments)
    if given.command == "version":
        print("paperloom")
        return 0
    if not given.files or not given.out:
        parser.error("files and --out are needed")
    ship(spark)
    files = T.read_files(spark, given.files, "")
    if given.command == "text":
        texts = T.document_text(files, password=given.password)
        sinks.export_files(texts, given.out).count()
        return sinks.summary(texts).first()["exit_code"]
    if given.command == "html":
        sinks.export_files(html_documents(T.page_text(files, password=given.password)).withColumnRenamed("html", "text"), given.out, ".html").count()
    elif given.command in TABLES:
        TABLES[given.command](files, given.password).write.mode("overwrite").parquet(given.out)
    else:
        if given.command == "split":
            made = pdf_edit.split_files(files, given.every).select(F.concat("path", F.lit("-"), "part_no").alias("path"), "content")
        elif given.command == "merge":
            made = pdf_edit.merge_by(files.withColumn("path_group", F.lit("merged")), "path_group").select(F.col("path_group").alias("path"), "content")
        elif given.command == "encrypt":
            made = _changed(files, lambda data: pdf_edit.encrypt(data, given.password, given.password))
        else:
            made = _changed(files, lambda data: pdf_edit.rewrite(data, decode=given.command == "decode", password=given.password))
        sinks.export_bytes(made, given.out).count()
    broken = T.documents(files, given.password).where("status <> 'ok'").limit(1).count()
    return int(broken > 0)


if __name__ == "__main__":
    sys.exit(run(SparkSession.builder.getOrCreate(), sys.argv[1:]))
