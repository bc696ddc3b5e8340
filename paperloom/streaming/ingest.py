"""Files as they arrive: a directory watched by Structured Streaming, each file read once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from paperloom.sources import pdf_tables

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def arriving_files(spark: SparkSession, folder: str, pattern: str = "*.pdf", per_batch: int = 1000) -> DataFrame:
    """``path, length, modified_at, content`` of files as they come into a folder."""
    reader = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    return reader.option("maxFilesPerTrigger", per_batch).load(folder).selectExpr("path", "length", "modificationTime modified_at", "content")


def ingest_texts(spark: SparkSession, folder: str, out: str, checkpoint: str, pattern: str = "*.pdf") -> StreamingQuery:
    """Append the text of each new file to a Parquet table; what is there is worked off, then the query ends.

    The checkpoint knows the files that were read, so each is in the table
    once, whatever is lost on the way.
    """
    texts = pdf_tables.document_text(arriving_files(spark, folder, pattern))
    return texts.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def newest_files(files: DataFrame, delay: str = "1 day") -> DataFrame:
    """Deliveries without those repeated within ``delay``: a file is told by its path and length."""
    return files.withWatermark("modified_at", delay).dropDuplicatesWithinWatermark(["path", "length"])
