"""Queries on noise in text from scanned pages (p3)."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.character_forms import Forms
from paperloom.llm.encoding_repair import clean_vocabulary
from paperloom.llm.language_id import named_column
from paperloom.llm.records import RECORD, all_records, distinct, result_words
from paperloom.llm.scan_noise import COMPOUND_SHARE, LEARNED_SHARE, LEARNED_WORDS, LINE_SHARE, MIN_COUNT, SAMPLE_RECORDS, Cleaner, Confusions, Corrector, Furniture, Index, Joiner, LineStatistics, count_lines, differences, without_misread
from paperloom.llm.stats_queries import common_words
from paperloom.llm.text_stats import PROSE, classify
from paperloom.llm.vocabulary import WORD, Vocabulary, frequent_words
from paperloom.session import durable, table

_FLUSH = 400_000


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(counts: dict[str | None, tuple[Counter, Counter]]) -> pa.RecordBatch:
        languages, kinds, keys, numbers = [], [], [], []
        for lang, pair in counts.items():
            for kind, counter in zip(("line", "compound"), pair):
                languages += [lang] * (len(counter) + 1)
                kinds += [kind] * (len(counter) + 1)
                keys += [*counter, ""]
                numbers += [*counter.values(), sum(counter.values())]
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in (languages, kinds, keys)), pa.array(numbers, pa.int64())], names=["lang", "kind", "key", "n"])

    counts: dict[str | None, tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text:
                count_lines(text, *counts[lang])
        if sum(len(c) for pair in counts.values() for c in pair) > _FLUSH:
            yield out(counts)
            counts.clear()
    yield out(counts)


def line_statistics(results: DataFrame) -> LineStatistics:
    """Frequent heading-like lines and compounds of all results.

    As with words, an entry must have a share of those of one language, by the
    results' labels, so that no language has more than 1 / share of them.
    """
    rows = results.select("result", named_column("declared_lang").alias("_lang"))
    counts = durable(rows.mapInArrow(_count, "lang string, kind string, key string, n bigint").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")))
    total = F.lit(None).cast("bigint")
    for r in counts.where("key = '' and n > 0").collect():
        total = F.when(F.col("lang").eqNullSafe(r["lang"]) & (F.col("kind") == r["kind"]), F.lit(r["n"])).otherwise(total)
    least = F.when(F.col("kind") == "line", F.lit(LINE_SHARE)).otherwise(F.lit(COMPOUND_SHARE))
    shares = counts.where("key <> ''").withColumn("share", F.col("n") / total).groupBy("kind", "key").agg(F.sum("n").alias("n"), F.max("share").alias("share"))
    kept = shares.where((F.col("n") >= MIN_COUNT) & (F.col("share") >= least)).select("kind", "key", "n").collect()
    of = {kind: {r["key"]: r["n"] for r in kept if r["kind"] == kind} for kind in ("line", "compound")}
    return LineStatistics(of["line"], of["compound"])


def learned_confusions(counts: DataFrame, vocabulary: Vocabulary) -> Confusions:
    """What is read as what, from all words of the corpus (`word_counts`) and the vocabulary near them.

    Each task compares its own words; only counts of differences are shuffled,
    and those kept have a share of all, so that there are at most 1 / LEARNED_SHARE.
    """
    shared = counts.sparkSession.sparkContext.broadcast(Index(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            seen.update(differences(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), shared.value))
        pairs = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.string()), pa.array([b for _, b in pairs], pa.string()), pa.array([seen[p] for p in pairs], pa.int64())], names=["written", "meant", "n"])

    words = counts.where("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))
    found = durable(words.mapInArrow(run, "written string, meant string, n bigint").groupBy("written", "meant").agg(F.sum("n").alias("n")))
    total = found.agg(F.sum("n")).first()[0] or 0
    return Confusions({(r["written"], r["meant"]): r["n"] for r in found.where(F.col("n") >= max(LEARNED_WORDS, LEARNED_SHARE * total)).collect()})


def _sample(results: DataFrame) -> list[str]:
    """At most SAMPLE_RECORDS results with text, spread by a hash of their number."""
    rows = results.where(F.length(F.trim("result")) > 0).withColumn("_h", F.xxhash64("result_id"))
    hashes = [r[0] for r in rows.select("_h").distinct().orderBy("_h").limit(SAMPLE_RECORDS).collect()]
    return [r[0] for r in rows.where(F.col("_h") <= max(hashes)).select("result").distinct().limit(SAMPLE_RECORDS).collect()] if hashes else []


def fitted(spark: SparkSession, folder: str) -> tuple[Vocabulary, Cleaner]:
    """The vocabulary and the classifiers, fitted to samples of fixed size."""
    results = table(spark, folder, "batch_results")
    counts = durable(result_words(spark, folder))
    vocabulary = clean_vocabulary(*frequent_words(counts))
    statistics = line_statistics(results)
    forms = Forms(vocabulary)
    confusions = learned_confusions(counts, vocabulary)
    sound = without_misread(vocabulary, confusions)
    corrector = Corrector(sound, confusions).fit()
    texts = [forms.consistent(t)[0] for t in _sample(results)]
    texts = [t for t, kind in zip(texts, classify(pa.array(texts, pa.string()), common_words(spark, folder))) if kind == PROSE] if texts else []
    return vocabulary, Cleaner(corrector, Furniture(statistics, corrector).fit(texts), Joiner(sound, statistics).fit())


def cleaned_records(spark: SparkSession, folder: str) -> DataFrame:
    """``field, result_id, page_no, noise, text`` of every record with noise: its kinds and the repaired text.

    Wrong decoding and deviating characters are repaired first and are no
    noise, and neither is anything in lists, tables and junk. Null, blank and
    clean texts give no rows; an empty table gives none.
    """
    shared = spark.sparkContext.broadcast((*fitted(spark, folder), common_words(spark, folder)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, cleaner, common = shared.value
        forms = vocabulary.shared(Forms)
        for batch in batches:
            at, plain, noise, repaired = [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                if not text:
                    continue
                damage = forms.repairer.damage(text)
                skip = {w.lower() for token in damage.values() for w in WORD.findall(token)}
                whole = forms.consistent(text, damage)[0]
                repair = cleaner.clean(whole, skip)
                if repair.noise:
                    at.append(i)
                    plain.append(whole)
                    noise.append(sorted(repair.noise))
                    repaired.append(repair.text)
            kinds = classify(pa.array(plain, pa.string()), common) if plain else []
            keep = [k for k, kind in enumerate(kinds) if kind == PROSE]
            picked = pa.array([at[k] for k in keep], pa.int64())
            columns = [batch.column(n).take(picked) for n in ("field", "result_id", "page_no")]
            columns += [pa.array([noise[k] for k in keep], pa.list_(pa.string())), pa.array([repaired[k] for k in keep], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["field", "result_id", "page_no", "noise", "text"])

    records = all_records(spark, folder).select("field", "result_id", "page_no", "text")
    return records.mapInArrow(run, f"{RECORD}, noise array<string>, text string")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each kind of noise in a record."""
    return distinct(cleaned_records(spark, folder).select("field", "result_id", "page_no", F.explode("noise").alias("noise")))


def p3_text(spark: SparkSession, folder: str) -> DataFrame:
    """The continuous paragraphs of each record with noise."""
    return distinct(cleaned_records(spark, folder).select("field", "result_id", "page_no", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p3_found": p3_found, "p3_text": p3_text}
SQL: dict[str, str] = {}
