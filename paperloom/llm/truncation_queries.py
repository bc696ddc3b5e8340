"""Queries on cut texts (p9)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm.truncation import LEAST_LIMIT, LIMIT_COUNT, LIMIT_SHARE, MIN_COUNT, CLOSING_SHARE, MIN_TERMINATED, PRIOR_TEXTS, Ending, Facts, count_lines, decide, examine
from paperloom.session import durable, spread, table

_FLUSH = 400_000
_KINDS = ("word", "ending", "pair", "line", "closing")
#: Texts whose end has to be looked up, with what is looked up.
_ENDINGS = "doc_id bigint, source string, blank boolean, cut boolean, running int, n_chars bigint, chars bigint, bytes bigint, kind string, marked boolean, address boolean, short boolean, spaced boolean, ends_in string, word_last boolean, word string, before string, above array<string>"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(counters: list[Counter]) -> pa.RecordBatch:
        kinds, keys, numbers = [], [], []
        for kind, counter in zip(_KINDS, counters):
            kinds += [kind] * len(counter)
            keys += counter
            numbers += counter.values()
        return pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(keys, pa.string()), pa.array(numbers, pa.int64())], names=["kind", "key", "n"])

    counters: list[Counter] = [Counter() for _ in _KINDS]
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                count_lines(text, *counters)
        if sum(map(len, counters)) > _FLUSH:
            yield out(counters)
            counters = [Counter() for _ in _KINDS]
    yield out(counters)


def line_counts(documents: DataFrame) -> DataFrame:
    """``kind, key, n``: how often words, line-ending words and pairs, short lines and such lines near the end occur in all documents.

    Each task counts its own texts first; nothing is left out, however rare.
    """
    return spread(documents.select("text")).mapInArrow(_count, "kind string, key string, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def source_limits(documents: DataFrame) -> DataFrame:
    """``source, unit, size``: lengths at which a source's texts pile up.

    Lengths are counted before anything else, so that a source's window holds
    each length once, however many texts it has.
    """
    text = F.col("text")
    units = F.array(
        F.struct(F.lit("chars").alias("unit"), F.char_length(text).alias("size")),
        F.struct(F.lit("bytes").alias("unit"), F.octet_length(text).alias("size")),
    )
    sizes = (
        documents.where((F.char_length(text) >= LEAST_LIMIT) & F.col("source").isNotNull())
        .select("source", F.explode(units).alias("s"))
        .groupBy("source", "s.unit", "s.size")
        .agg(F.count("*").alias("n"))
    )
    own = Window.partitionBy("source", "unit")
    by_size = own.orderBy("size")
    around = F.greatest(*(F.coalesce(F.max("n").over(by_size.rangeBetween(a, b)), F.lit(0)) for a, b in ((-9, -4), (4, 9))))
    return (
        sizes.withColumns({"around": around, "longer": F.sum("n").over(own), "beyond": F.sum("n").over(by_size.rangeBetween(0, Window.unboundedFollowing))})
        .where((F.col("n") >= LIMIT_COUNT) & (F.col("n") >= LIMIT_SHARE * F.col("longer")) & (F.col("n") >= 4 * (F.col("around") + 1)) & (F.col("n") >= 0.25 * F.col("beyond")))
        .select("source", "unit", "size", "longer")
    )


def _endings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _ENDINGS.split(", ")]
    own = names[names.index("kind") :]
    for batch in batches:
        texts = batch.column("text").to_pylist()
        ends = [examine(t) for t in texts]
        columns = {
            "doc_id": batch.column("doc_id"), "source": batch.column("source"), "n_chars": batch.column("n_chars"),
            "blank": pa.array([not t or not t.strip() for t in texts], pa.bool_()), "cut": pa.array([e.cut for e in ends], pa.bool_()), "running": pa.array([e.running for e in ends], pa.int32()),
            "chars": pa.array([len(t or "") for t in texts], pa.int64()), "bytes": pa.array([len((t or "").encode("utf-8", "replace")) for t in texts], pa.int64()),
        }
        types = {"ends_in": pa.string(), "kind": pa.string(), "word": pa.string(), "before": pa.string(), "above": pa.list_(pa.string())}
        for name in own:
            columns[name] = pa.array([getattr(e, name) if name != "above" else list(e.above) for e in ends], types.get(name, pa.bool_()))
        yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = ("kind", "marked", "address", "short", "spaced", "ends_in", "word_last", "word", "before")
    for batch in batches:
        cut = []
        for r in batch.to_pylist():
            n = dict(r["found"] or ())
            sign_off = any(n.get(f"line{k}", 0) >= MIN_COUNT and n.get(f"closing{k}", 0) >= CLOSING_SHARE * n[f"line{k}"] for k in range(len(r["above"] or ())))
            facts = Facts(r["limited"], n.get("word0", 0), n.get("ending0", 0), n.get("prefix0", 0), n.get("word1", 0), n.get("pair0", 0), sign_off, r["stops"])
            cut.append(decide(Ending(**{name: r[name] for name in own}), facts))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(cut, pa.bool_())], names=["doc_id", "source", "cut"])


def _limited(endings: DataFrame, documents: DataFrame) -> DataFrame:
    """Adds ``limited``: whether a text's length is a limit of its source, or less than was counted before it was stored."""
    limits = source_limits(documents)
    chars = limits.where("unit = 'chars'").select("source", F.col("size").cast("bigint").alias("chars"), F.lit(True).alias("_chars"))
    # a limit in bytes may fall within a character
    sizes = F.explode(F.sequence(F.col("size").cast("bigint") - 3, F.col("size").cast("bigint")))
    octets = limits.where("unit = 'bytes'").select("source", sizes.alias("bytes")).distinct().withColumn("_bytes", F.lit(True))
    joined = endings.join(chars, ["source", "chars"], "left").join(octets, ["source", "bytes"], "left")
    limited = F.coalesce("_chars", F.lit(False)) | F.coalesce("_bytes", F.lit(False)) | F.coalesce(F.col("n_chars") > F.col("bytes"), F.lit(False))
    return joined.withColumn("limited", limited).drop("_chars", "_bytes")


def _stopped(endings: DataFrame, undecided: DataFrame) -> DataFrame:
    """Adds to the undecided ``stops``: whether running texts of their source end with stops, the rate of all sources weighing in.

    Texts at a limit say nothing about that, as most of them are cut.
    """
    counts = endings.where("running > 0 and not limited").groupBy("source").agg(F.count_if(F.col("running") == 1).alias("ended"), F.count("*").alias("texts"))
    total = counts.agg(F.sum("ended"), F.sum("texts")).first()
    rate = (total[0] or 0) / (total[1] or 1)
    rare = counts.where(F.col("source").isNotNull() & ((F.col("ended") + PRIOR_TEXTS * rate) / (F.col("texts") + PRIOR_TEXTS) < MIN_TERMINATED)).select("source", F.lit(False).alias("stops"))
    return undecided.join(rare, "source", "left").withColumn("stops", F.coalesce("stops", F.lit(True)))


def _looked_up(undecided: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds ``found``: the counts of what each ending names, by kind and place."""
    prefixes = counts.where((F.col("kind") == "word") & (F.col("n") >= MIN_COUNT) & (F.length("key") > 1))
    prefixes = prefixes.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("key") - 1), lambda k: F.substring("key", F.lit(1), k))).alias("key"), "n")
    prefixes = prefixes.groupBy("key").agg(F.max("n").alias("n")).select(F.lit("prefix").alias("kind"), "key", "n")
    word, before = F.lower("word"), F.lower("before")
    named = lambda kind, key, place=0: F.struct(F.lit(kind).alias("kind"), key.alias("key"), F.lit(place).alias("place"))
    keys = F.array(named("word", word), named("ending", word), named("prefix", word), named("word", before, 1), named("pair", F.when(before.isNull(), word).otherwise(F.concat_ws(" ", before, word))))
    above = F.flatten(F.transform("above", lambda line, k: F.array(F.struct(F.lit("line").alias("kind"), line.alias("key"), k.alias("place")), F.struct(F.lit("closing").alias("kind"), line.alias("key"), k.alias("place")))))
    asked = undecided.select("_row", F.explode(F.concat(keys, above)).alias("k")).select("_row", "k.*").where("key is not null")
    found = asked.join(counts.unionByName(prefixes), ["kind", "key"]).groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct(F.concat("kind", F.col("place").cast("string")), "n"))).alias("found"))
    return undecided.join(found, "_row", "left")


def cut_flags(documents: DataFrame) -> DataFrame:
    """``doc_id, source, blank, cut`` of every document.

    Null, empty and blank texts are not cut; a null source has no limits, a
    null ``n_chars`` tells nothing; repeated rows are judged each; other
    columns are ignored; an empty table gives no rows. The texts are read once
    to count and once to judge; those whose end has to be looked up go on as
    one short row each, which the counts are joined to.
    """
    rows = documents.selectExpr("cast(doc_id as bigint) doc_id", "source", "text", "cast(n_chars as bigint) n_chars")
    endings = durable(_limited(spread(rows).mapInArrow(_endings, _ENDINGS), rows))
    undecided = _stopped(endings, endings.where("cut is null").withColumn("_row", F.monotonically_increasing_id()))
    counts = durable(line_counts(documents))
    judged = _looked_up(undecided, counts).mapInArrow(_decided, "doc_id bigint, source string, cut boolean")
    return endings.where("cut is not null").select("doc_id", "source", "blank", "cut").unionByName(judged.select("doc_id", "source", F.lit(False).alias("blank"), "cut"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose rest was cut off."""
    return cut_flags(table(spark, folder, "documents")).where("cut").select("doc_id").distinct()


def p9_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Of each source: texts, cut texts and their share."""
    texts = cut_flags(table(spark, folder, "documents")).where("not blank")
    counts = texts.groupBy("source").agg(F.count("*").alias("texts"), F.count_if("cut").alias("cut_texts"))
    return counts.withColumn("cut_share", F.round(F.col("cut_texts") / F.col("texts"), 6))


def p9_limits(spark: SparkSession, folder: str) -> DataFrame:
    """The lengths that look like limits of a source's field."""
    return source_limits(table(spark, folder, "documents")).select("source", "unit", F.col("size").cast("bigint").alias("size"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p9_found": p9_found, "p9_sources": p9_sources, "p9_limits": p9_limits}
SQL: dict[str, str] = {
    "p9_limits": f"""
with s as (
  select source, unit, size, count(*) as n from (
    select source, 'chars' as unit, length(text) as size from documents where source is not null and length(text) >= {LEAST_LIMIT}
    union all select source, 'bytes', strlen(text) from documents where source is not null and length(text) >= {LEAST_LIMIT}) group by all
), w as (
  select *, greatest(
      coalesce(max(n) over (partition by source, unit order by size range between 9 preceding and 4 preceding), 0),
      coalesce(max(n) over (partition by source, unit order by size range between 4 following and 9 following), 0)) as around,
    sum(n) over (partition by source, unit) as longer,
    sum(n) over (partition by source, unit order by size range between current row and unbounded following) as beyond
  from s
)
select source, unit, size from w
where n >= {LIMIT_COUNT} and n >= {LIMIT_SHARE} * longer and n >= 4 * (around + 1) and n >= 0.25 * beyond""",
}
