"""Queries on evaluation texts in the corpus (p8)."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.leakage import INDEX_TABLE, Index, Items, merged, prepare, shards
from paperloom.session import durable, spread, table

_LEAKS = "doc_id bigint, item_id bigint, first bigint, end bigint"
#: Characters of all distinct items that are sent to every task at most; more are refused.
ITEM_CHARS = 1 << 28


def _items(items: DataFrame) -> Items:
    """The held-out items, a fixed table. They go to every task, so their size is checked first."""
    rows = items.selectExpr("cast(item_id as bigint) item_id", "text").distinct()
    size = rows.agg(F.sum(F.char_length("text"))).first()[0] or 0
    if size > ITEM_CHARS:
        raise ValueError(f"{size} characters of items are more than {ITEM_CHARS}; search them in parts, over one `shard_indexes` table")
    return prepare([(r[0], r[1]) for r in rows.orderBy("item_id", "text").collect()])


def _leak_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "first", "end"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str | None]]:
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())


def _documents(documents: DataFrame) -> DataFrame:
    return spread(documents.selectExpr("cast(doc_id as bigint) doc_id", "text"))


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id, first, end``: characters ``first`` up to ``end`` of a document hold that item.

    An item counts if 12 of its words follow each other there, or 24 with about
    one in eight changed. Only an item's text counts; items with less than 12
    words cannot leak. Null and empty documents hold nothing; equal documents
    are reported each. Each task indexes and searches its own documents, so
    nothing but the leaks is shuffled.
    """
    shared = documents.sparkSession.sparkContext.broadcast(_items(items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for index in shards(_texts(batches)):
            yield _leak_batch(index.leaks(shared.value))

    return _documents(documents).mapInArrow(run, _LEAKS)


def shard_indexes(documents: DataFrame) -> DataFrame:
    """A table of FM-indexes, one row for each shard of documents, to be kept: later items are searched in it by `indexed_leaks`."""
    kinds = [pa.list_(pa.int64()), *[pa.binary()] * 3, pa.list_(pa.string()), *[pa.binary()] * 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for index in shards(_texts(batches)):
            row = index.pack()
            yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row.values(), kinds)], names=list(row))

    return _documents(documents).mapInArrow(run, INDEX_TABLE)


def indexed_leaks(indexes: DataFrame, items: DataFrame) -> DataFrame:
    """The same rows as `leaks`, from a table of `shard_indexes` alone."""
    shared = indexes.sparkSession.sparkContext.broadcast(_items(items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield _leak_batch(Index.unpack(batch.slice(i, 1).to_pylist()[0]).leaks(shared.value))

    return indexes.mapInArrow(run, _LEAKS)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and the items that they leak."""
    return leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items")).select("doc_id", "item_id").distinct()


def p8_spans(spark: SparkSession, folder: str) -> DataFrame:
    """The parts to be removed from each document, those of several items merged where they overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = defaultdict(list)
            for key, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for a, b in merged([(s["first"], s["end"]) for s in spans]):
                    rows["doc_id"].append(key)
                    rows["first"].append(a)
                    rows["end"].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(rows[n], pa.int64()) for n in ("doc_id", "first", "end")], names=["doc_id", "first", "end"])

    found = leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))
    spans = found.groupBy("doc_id").agg(F.collect_set(F.struct("first", "end")).alias("spans"))
    return spans.mapInArrow(run, "doc_id bigint, first bigint, end bigint")


def p8_indexed(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of `p8_found` from an index that was written first and is read without the documents."""
    indexes = durable(shard_indexes(table(spark, folder, "documents")))
    return indexed_leaks(indexes, table(spark, folder, "eval_items")).select("doc_id", "item_id").distinct()


def p8_items(spark: SparkSession, folder: str) -> DataFrame:
    """How many documents leak each item."""
    return p8_found(spark, folder).groupBy("item_id").agg(F.count("*").alias("documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p8_found": p8_found, "p8_spans": p8_spans, "p8_items": p8_items, "p8_indexed": p8_indexed}
SQL: dict[str, str] = {}
