"""Queries on text statistics (p2), with the SQL that gives the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.text_stats import PROSE, rows_of
from paperloom.session import spread, table

_ENDED = r"""[.!?…。．:;,][”"’»)\]]*\s*$"""


#: Common words that go to every task, at most; more are refused.
MAX_COMMON = 100_000


def common_words(spark: SparkSession, folder: str) -> set[str]:
    """The frequent words of the languages, in lower case: a fixed table, whose size is checked as it goes to every task."""
    words = [r[0] for r in table(spark, folder, "common_words").where("word is not null").select(F.lower("word")).distinct().limit(MAX_COMMON + 1).collect()]
    if len(words) > MAX_COMMON:
        raise ValueError(f"more than {MAX_COMMON} common words")
    return set(words)


def text_classes(results: DataFrame, common: set[str]) -> DataFrame:
    """``path, result_id, text_class, failed`` of each non-blank result: its class and the names of the rules it fails.

    Null, empty and blank results give no row, a repeated delivery a repeated
    row, a null key a null; other columns are ignored, an empty table gives
    none. Of kinds with equally many characters the first of prose, list,
    table and junk counts.
    """
    texts = results.where("result is not null").selectExpr("path", "cast(result_id as bigint) result_id", "result text")
    return spread(texts).mapInArrow(partial(rows_of, common=common), "path string, result_id bigint, text_class string, failed array<string>")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Results of which most text is no prose, as the rules they fail tell."""
    classes = text_classes(table(spark, folder, "batch_results"), common_words(spark, folder))
    return classes.where(F.col("text_class") != PROSE).select("result_id", "text_class").distinct()


def text_statistics(results: DataFrame, common: list[str]) -> DataFrame:
    """Statistics of each non-blank result, by built-in functions only.

    ``word_count`` counts what white space separates; ``mean_word_length`` is
    its mean length; ``symbol_ratio`` is the share of characters besides white
    space that are neither letters, marks nor digits; ``ended_lines`` the share
    of non-blank lines that end in punctuation; ``common_share`` the share of
    letter runs that are ``common`` words. Null and blank results give no row;
    repeated deliveries give one.
    """
    listed = sorted({w.lower() for w in common})
    text = F.col("result")
    words = F.regexp_count(text, F.lit(r"[^ \t\n\r\f]+"))
    solid = F.length(F.regexp_replace(text, r"[ \t\n\r\f]+", ""))
    symbols = F.length(F.regexp_replace(text, r"[\p{L}\p{M}\p{N} \t\n\r\f]+", ""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t\n\r\f]"))
    runs = F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}]+"), lambda x: x != "")
    known = F.filter(runs, lambda x: x.isin(listed))
    return (
        results.where(text.rlike(r"[^ \t\n\r\f]"))
        .select("path", F.col("result_id").cast("bigint").alias("result_id"), "result")
        .select(
            "path",
            "result_id",
            words.cast("bigint").alias("word_count"),
            (solid / words).alias("mean_word_length"),
            (symbols / solid).alias("symbol_ratio"),
            (F.size(F.filter(lines, lambda x: x.rlike(_ENDED))) / F.size(lines)).alias("ended_lines"),
            F.coalesce(F.try_divide(F.size(known), F.size(runs)), F.lit(0.0)).alias("common_share"),
        )
        .distinct()
    )


def p2_stats(spark: SparkSession, folder: str) -> DataFrame:
    return text_statistics(table(spark, folder, "batch_results"), sorted(common_words(spark, folder)))


def p2_quality(spark: SparkSession, folder: str) -> DataFrame:
    """The class of each non-blank result and the rules it fails, joined by commas."""
    classes = text_classes(table(spark, folder, "batch_results"), common_words(spark, folder))
    return classes.withColumn("failed", F.array_join("failed", ",")).distinct()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p2_found": p2_found, "p2_stats": p2_stats, "p2_quality": p2_quality}
SQL: dict[str, str] = {
    "p2_stats": r"""
with t as (
  select distinct path, result_id, result, lower(result) as low,
    length(regexp_replace(result, '[ \t\n\r\f]+', '', 'g')) as solid,
    len(list_filter(regexp_split_to_array(result, '[ \t\n\r\f]+'), lambda x: x <> '')) as words,
    list_filter(string_split(result, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\r\f]')) as lines,
    list_filter(regexp_split_to_array(lower(result), '[^\p{L}\p{M}]+'), lambda x: x <> '') as runs
  from batch_results where regexp_matches(result, '[^ \t\n\r\f]')
), c as (select list(distinct lower(word)) as common from common_words where word is not null)
select distinct path, result_id, cast(words as bigint) as word_count, solid / words as mean_word_length,
  length(regexp_replace(result, '[\p{L}\p{M}\p{N} \t\n\r\f]+', '', 'g')) / solid as symbol_ratio,
  len(list_filter(lines, lambda x: regexp_matches(x, '[.!?…。．:;,][”"’»)\]]*\s*$'))) / len(lines) as ended_lines,
  case when len(runs) = 0 then 0.0 else len(list_filter(runs, lambda x: list_contains(common, x))) / len(runs) end as common_share
from t, c""",
}
