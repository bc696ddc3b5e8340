"""Where results go: tables, single texts, one file a document, and the summary of a run."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_texts(texts: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """``path, text`` rows as Parquet, the form for whole corpora."""
    texts.select("path", "text").write.mode(mode).parquet(folder)


def headed(texts: DataFrame) -> DataFrame:
    """``value``: each text behind a line that names its path."""
    return texts.where("text is not null").select(F.concat(F.lit("=== "), "path", F.lit(" ===\n"), "text").alias("value"))


def _named(rows: DataFrame, content: str, suffix: str) -> DataFrame:
    """``path, file`` and the content. Base names of different paths collide, so a file's name also holds a hash of its whole path."""
    name = F.regexp_replace(F.regexp_extract("path", "([^/]*?)(?:\\.[^./]*)?$", 1), "[^\\w.-]", "_")
    return rows.where(F.col(content).isNotNull()).select("path", F.concat(name, F.lit("-"), F.substring(F.sha2("path", 256), 1, 12), F.lit(suffix)).alias("file"), content)


def _exported(named: DataFrame, folder: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        system.create_dir(base, recursive=True)
        for batch in batches:
            for file, content in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                with system.open_output_stream(f"{base}/{file}.part") as out:
                    out.write(content.encode("utf-8", "replace") if isinstance(content, str) else content)
                system.move(f"{base}/{file}.part", f"{base}/{file}")  # a task that runs again writes the same
            yield batch.select([0, 1])

    return named.mapInArrow(run, "path string, file string")


def export_files(texts: DataFrame, folder: str, suffix: str = ".txt") -> DataFrame:
    """Write one file a row below ``folder``, a path or URI that all executors share; gives ``path, file``.

    Null texts give no file. The result must be consumed.
    """
    return _exported(_named(texts, "text", suffix), folder)


def export_bytes(files: DataFrame, folder: str, suffix: str = ".pdf") -> DataFrame:
    """The same of ``path, content`` rows."""
    return _exported(_named(files, "content", suffix), folder)


def summary(documents: DataFrame) -> DataFrame:
    """``files, ok, failed, exit_code`` of ``status`` rows; the code is 1 if any failed."""
    failed = F.count_if(F.col("status") != "ok")
    return documents.agg(F.count("*").alias("files"), F.count_if(F.col("status") == "ok").alias("ok"), failed.alias("failed"), (failed > 0).cast("int").alias("exit_code"))
