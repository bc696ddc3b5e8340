"""Queries on the encoding of the corpus with a public tokenizer (p7)."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.byte_bpe import DEFAULT_FOLDER, Transducer, read_ranks
from paperloom.session import spread, table

VOCABULARY = "byte_bpe_50k.tiktoken"


def _transducer_of(spark: SparkSession, path: str | None) -> Callable[[], Transducer]:
    """A task's transducer. The vocabulary file, of fixed size, is read once on the driver."""
    folder = spark.conf.get("paperloom.tokenizers", DEFAULT_FOLDER)
    shared = spark.sparkContext.broadcast(read_ranks(path or f"{folder}/{VOCABULARY}"))
    made: list[Transducer] = []

    def get() -> Transducer:
        if not made:
            made.append(Transducer(shared.value))
        return made[0]

    return get


def token_ids(documents: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, ids`` of every row; null and empty texts give an empty array.

    Rows are neither merged nor dropped: a repeated row gives a repeated
    result. Special tokens' strings are encoded as ordinary text. ``path`` is
    the vocabulary file; else it is looked for in the folder that the setting
    ``paperloom.tokenizers`` names.
    """
    transducer = _transducer_of(documents.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = transducer().encode
        for batch in batches:
            ids = [encode(t) if t else [] for t in batch.column("text").to_pylist()]
            offsets = pa.array(itertools.accumulate(map(len, ids), initial=0), pa.int32())
            flat = pa.array(itertools.chain.from_iterable(ids), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(offsets, flat)], names=["doc_id", "ids"])

    return spread(documents.selectExpr("cast(doc_id as bigint) doc_id", "text")).mapInArrow(run, "doc_id bigint, ids array<int>")


def decoded(ids: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, text`` of ``doc_id, ids``, by streaming UTF-8 decoding; a null array gives null."""
    transducer = _transducer_of(ids.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = transducer().decode
        for batch in batches:
            texts = [None if x is None else decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The ids of each document."""
    return token_ids(table(spark, folder, "documents"))


def p7_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's text, encoded and decoded again: the text itself, '' for null."""
    return decoded(token_ids(table(spark, folder, "documents")))


def p7_by_source(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and tokens of each source."""
    documents = table(spark, folder, "documents")
    sizes = token_ids(documents).select("doc_id", F.size("ids").cast("bigint").alias("n"))
    return documents.select("doc_id", "source").join(sizes, "doc_id").groupBy("source").agg(F.count("*").alias("documents"), F.sum("n").alias("tokens"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p7_ids": p7_ids, "p7_round_trip": p7_round_trip, "p7_by_source": p7_by_source}
SQL: dict[str, str] = {"p7_round_trip": "select doc_id, coalesce(text, '') as text from documents"}
