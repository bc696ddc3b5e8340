"""The two kinds of text records: whole results and single pages of glyphs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.encoding_repair import clean_vocabulary
from paperloom.llm.language_id import named_column
from paperloom.llm.vocabulary import Vocabulary, frequent_words, word_counts
from paperloom.operators.glyph_runs import page_texts
from paperloom.session import durable, spread, table

RECORD = "field string, result_id bigint, page_no bigint"


def result_records(results: DataFrame) -> DataFrame:
    """``field, result_id, page_no, text`` of the results that have text."""
    return results.where("result is not null").selectExpr("'result' field", "cast(result_id as bigint) result_id", "cast(0 as bigint) page_no", "result text")


def page_records(glyphs: DataFrame) -> DataFrame:
    """The same of every page in the glyph table."""
    return page_texts(glyphs).selectExpr("'unicode' field", "doc_id result_id", "page_no", "text")


def all_records(spark: SparkSession, folder: str) -> DataFrame:
    return spread(result_records(table(spark, folder, "batch_results"))).unionByName(page_records(table(spark, folder, "pdf_glyphs")))


def result_words(spark: SparkSession, folder: str) -> DataFrame:
    """`word_counts` of all results by the language they are labelled with, repeated deliveries included."""
    return word_counts(table(spark, folder, "batch_results"), "result", named_column("declared_lang"))


def vocabulary_of(spark: SparkSession, folder: str) -> Vocabulary:
    """The vocabulary of all results, without damaged words."""
    return clean_vocabulary(*frequent_words(durable(result_words(spark, folder))))


def judge(records: DataFrame, schema: str, build: Callable[[], Callable[[str], Iterator[tuple]]]) -> DataFrame:
    """Rows that a judgement gives of each record's text, behind the record's key.

    ``build`` runs once in each task and gives the judgement, which may keep
    what it works out; ``schema`` names what it adds to the key.
    """
    names = [c.split()[0] for c in schema.split(", ")] if schema else []
    types = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "int": pa.int32()}
    kinds = [types[c.split()[1]] for c in schema.split(", ")] if schema else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judgement = build()
        for batch in batches:
            keys, rows = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for row in judgement(text or ""):
                    keys.append(i)
                    rows.append(row)
            picked = pa.array(keys, pa.int64())
            columns = [batch.column(n).take(picked) for n in ("field", "result_id", "page_no")]
            columns += [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["field", "result_id", "page_no", *names])

    return records.select("field", "result_id", "page_no", "text").mapInArrow(run, f"{RECORD}, {schema}" if schema else RECORD)


def distinct(df: DataFrame) -> DataFrame:
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n")).drop("_n")
