"""Queries on the languages of results (p4)."""

from __future__ import annotations

import functools
import zlib
from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm.character_forms import Forms
from paperloom.llm.language_id import COSINE_UNIT, HELD_OUT, LANGUAGES, REJECT_QUANTILE, ROUNDS, SAMPLE_ROWS, SIZE, Centroids, bounds, even_idf, fit, frequencies, held_pieces, identify_all, moved, named_column, sums
from paperloom.llm.records import vocabulary_of
from paperloom.llm.stats_queries import common_words
from paperloom.llm.text_stats import PROSE, classify
from paperloom.llm.vocabulary import Vocabulary
from paperloom.session import durable, table

_FOUND = "h bigint, g int, seg_no bigint, lang string, confidence double"
#: What a text is known by.
_KEY = ("xxhash64(result) h", "hash(result) g")
#: Sums leave a task in blocks of so many numbers.
_BLOCK = 1024


def labelled_sample(results: DataFrame) -> list[tuple[str, str]]:
    """At most SAMPLE_ROWS different texts of each language that a label names, those with the least hashes.

    Hashes are even, so that a bound on them leaves about that many of each
    language before anything is ranked.
    """
    rows = results.where(F.length(F.trim("result")) > 0).select("result", named_column("declared_lang").alias("lang")).where("lang is not null").withColumn("_h", F.xxhash64("result", "lang"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    bound = F.lit(0.0)
    for lang, n in counts.items():
        bound = F.when(F.col("lang") == lang, F.lit(1.5 * SAMPLE_ROWS / n)).otherwise(bound)
    near = rows.where(F.pmod("_h", F.lit(1 << 30)) / (1 << 30) < bound).distinct()
    order = Window.partitionBy("lang").orderBy("_h", "result")
    taken = near.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= SAMPLE_ROWS).orderBy("lang", "_k")
    return [(r["result"], r["lang"]) for r in taken.collect()]


def _prose(spark: SparkSession, folder: str, vocabulary: Vocabulary, common: set[str]) -> DataFrame:
    """Each different prose result once, repaired: hashes of what it was, its labels' languages as bits, and the text, packed."""
    lang = named_column("declared_lang")
    bit = functools.reduce(lambda found, code: F.when(lang == code, F.lit(1 << LANGUAGES.index(code))).otherwise(found), LANGUAGES, F.lit(0))
    results = table(spark, folder, "batch_results").where("result is not null and trim(result) <> ''").select("result", bit.alias("langs"))
    texts = results.groupBy("result").agg(F.bit_or("langs").alias("langs")).selectExpr(*_KEY, "langs", "result text")
    model = spark.sparkContext.broadcast((vocabulary, common))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, common = model.value
        forms = words.shared(Forms)
        for batch in batches:
            kinds = classify(batch.column("text"), common)
            prose = batch.take(pa.array([i for i, kind in enumerate(kinds) if kind == PROSE], pa.int64()))
            packed = [zlib.compress(forms.consistent(text)[0].encode("utf-8", "surrogatepass"), 1) for text in prose.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(prose.column(c) for c in ("h", "g", "langs")), pa.array(packed, pa.binary())], names=["h", "g", "langs", "text"])

    return durable(texts.mapInArrow(run, "h bigint, g int, langs int, text binary"))


def _unpacked(batch: pa.RecordBatch) -> list[str]:
    return [zlib.decompress(text).decode("utf-8", "surrogatepass") for text in batch.column("text").to_pylist()]


def _labelled(prose: DataFrame) -> DataFrame:
    """``result, declared_lang`` of prose, with a row for each language that labels name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(text, lang) for text, langs in zip(_unpacked(batch), batch.column("langs").to_pylist()) for k, lang in enumerate(LANGUAGES) if langs >> k & 1]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], names=["result", "declared_lang"])

    return prose.select("langs", "text").mapInArrow(run, "result string, declared_lang string")


def _summed(prose: DataFrame, rows: int, work: Callable[[list[str], np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of what ``work`` gives of all texts and their labels, ``rows`` times SIZE whole numbers, added up in the executors."""
    schema = "block int, numbers binary"

    def blocks(found: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([n.tobytes() for n in found.values()], pa.binary())], names=["block", "numbers"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rows, SIZE), np.int64)
        for batch in batches:
            total += work(_unpacked(batch), batch.column("langs").to_numpy())
        yield blocks({k: n for k, n in enumerate(total.reshape(-1, _BLOCK)) if n.any()})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, numbers in zip(batch.column("block").to_pylist(), batch.column("numbers")):
                found[k] = found.get(k, 0) + np.frombuffer(numbers.as_buffer(), np.int64)
        yield blocks(found)

    out = np.zeros((rows * SIZE // _BLOCK, _BLOCK), np.int64)
    for row in prose.select("langs", "text").mapInArrow(run, schema).repartition("block").mapInArrow(add, schema).collect():
        out[row["block"]] = np.frombuffer(row["numbers"], np.int64)
    return out.reshape(rows, SIZE)


def _least_cosines(held: DataFrame, model: Centroids) -> np.ndarray:
    """`bounds` by all pieces of held-out texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.stack(held_pieces(model, _unpacked(batch), batch.column("langs").to_numpy()), axis=1)
            found, counts = np.unique(rows, axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([*(pa.array(found[:, k], pa.int32()) for k in range(3)), pa.array(counts, pa.int64())], names=["k", "b", "c", "n"])

    pieces = held.select("langs", "text").mapInArrow(run, "k int, b int, c int, n bigint").groupBy("k", "b", "c").agg(F.sum("n").alias("n"))
    quantile = F.percentile("c", F.lit(REJECT_QUANTILE), F.col("n")).alias("c")
    own = {(r["k"], r["b"]): (r["n"], r["c"] * COSINE_UNIT) for r in pieces.groupBy("k", "b").agg(quantile, F.sum("n").alias("n")).collect()}
    every = {r["b"]: r["c"] * COSINE_UNIT for r in pieces.groupBy("b").agg(quantile).collect()}
    return bounds(own, every, len(model.languages))


def fitted(prose: DataFrame) -> Centroids:
    """Centroids of all labelled texts; where their clusters begin is told by a sample.

    One text in HELD_OUT, by its hash, tells the least cosines, the others the means;
    of a language with few texts all do both.
    """
    labelled = prose.where("langs > 0")
    model = fit(labelled_sample(_labelled(labelled)))
    if not len(model.languages):
        return model
    counts = labelled.select(*(F.count(F.when(F.col("langs").bitwiseAND(1 << k) > 0, 1)) for k in range(len(LANGUAGES)))).first()
    few = F.col("langs").bitwiseAND(sum(1 << k for k, n in enumerate(counts) if n < 2 * HELD_OUT)) > 0
    out = F.pmod("h", F.lit(HELD_OUT)) == 0
    model = replace(model, idf=even_idf(_summed(labelled, len(LANGUAGES), frequencies), np.array(counts)).astype("f4"))
    for _ in range(ROUNDS):
        model = moved(model, _summed(labelled.where(few | ~out), len(model.languages), functools.partial(sums, model)))
    return replace(model, least=_least_cosines(labelled.where(few | out), model))


def language_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Of each prose result a row numbered 0 with the language of most of it, and of mixed ones a row per paragraph.

    Damaged and deviating characters are repaired first. Null and blank results
    and those that are no prose give no rows, repeated deliveries repeated
    ones. A text like no known language has a null language. Of languages that
    are equally near the first in the order of `LANGUAGES` counts. Without any
    labelled text nothing is near and all languages are null.
    """
    prose = _prose(spark, folder, vocabulary_of(spark, folder), common_words(spark, folder))
    model = spark.sparkContext.broadcast(fitted(prose))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for h, g, (lang, sure, segments) in zip(batch.column("h").to_pylist(), batch.column("g").to_pylist(), identify_all(model.value, _unpacked(batch))):
                rows.append((h, g, 0, lang, sure))
                if len({s for s, _ in segments}) > 1:
                    rows += [(h, g, i, s, c) for i, (s, c) in enumerate(segments, 1)]
            columns = list(zip(*rows)) or [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[c.split()[0] for c in _FOUND.split(", ")])

    # the language of a text is found once and joined to all its results by two hashes of it
    found = prose.select("h", "g", "text").mapInArrow(run, _FOUND)
    results = table(spark, folder, "batch_results").where("result is not null").selectExpr("cast(result_id as bigint) result_id", "declared_lang declared", *_KEY)
    return results.join(found, ["h", "g"]).select("result_id", "seg_no", "lang", "confidence", "declared")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Results with a missing or wrong label, and the paragraphs of mixed ones."""
    rows = language_rows(spark, folder).where("lang is not null")
    right = named_column("declared")
    return rows.where((F.col("seg_no") > 0) | right.isNull() | (right != F.col("lang"))).select("result_id", "seg_no", "lang").distinct()


def p4_languages(spark: SparkSession, folder: str) -> DataFrame:
    """All language rows with their confidence."""
    return language_rows(spark, folder).select("result_id", "seg_no", "lang", F.round("confidence", 4).alias("confidence")).distinct()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p4_found": p4_found, "p4_languages": p4_languages}
SQL: dict[str, str] = {}
