"""Queries on wrongly decoded text (p1) and deviating characters (p5)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm.character_forms import Forms
from paperloom.llm.encoding_repair import Repairer
from paperloom.llm.records import all_records, distinct, judge, vocabulary_of


def _repairs(spark: SparkSession, folder: str, with_text: bool) -> DataFrame:
    shared = spark.sparkContext.broadcast(vocabulary_of(spark, folder))

    def build() -> Callable[[str], Iterator[tuple]]:
        repairer = shared.value.shared(Repairer)

        def judgement(text: str) -> Iterator[tuple]:
            if damage := repairer.damage(text):
                yield (repairer.restore(text, damage),) if with_text else ()

        return judgement

    return distinct(judge(all_records(spark, folder), "text string" if with_text else "", build))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records that hold a product of wrong decoding.

    Null and empty results and pages without mapped glyphs give no row; a
    record delivered several times gives one; a null key is kept as null; other
    columns are ignored; empty tables give no rows. Texts are judged whole,
    whatever their length.
    """
    return _repairs(spark, folder, False)


def p1_restored(spark: SparkSession, folder: str) -> DataFrame:
    """The same records with their text as far as it can be recovered."""
    return _repairs(spark, folder, True)


def _forms(spark: SparkSession, folder: str, found_only: bool) -> DataFrame:
    shared = spark.sparkContext.broadcast(vocabulary_of(spark, folder))

    def build() -> Callable[[str], Iterator[tuple]]:
        forms = shared.value.shared(Forms)

        def judgement(text: str) -> Iterator[tuple]:
            plain, deviates = forms.consistent(text)
            if found_only:
                if deviates:
                    yield ()
            else:
                yield plain, int(deviates)

        return judgement

    return distinct(judge(all_records(spark, folder), "" if found_only else "text string, deviates int", build))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records that deviate from the consistent form. Nulls, repeats and empty tables as in `p1_found`."""
    return _forms(spark, folder, True)


def p5_text(spark: SparkSession, folder: str) -> DataFrame:
    """The consistent form of every record's text: of those that deviate and of those that do not; repeats once, null results not at all."""
    return _forms(spark, folder, False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p1_restored": p1_restored, "p5_found": p5_found, "p5_text": p5_text}
SQL: dict[str, str] = {}
