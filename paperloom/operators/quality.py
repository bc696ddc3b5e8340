"""How alike texts of the same file are: characters, lines, length; and summaries of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_TEXTLESS = r"[ \t\r\n]+"


def newest(deliveries: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key; of rows alike in ``order`` any one, so ``order`` should end with what tells them apart.

    Each task keeps its own newest rows before anything is shuffled, so a key
    with very many rows is no burden to one task.
    """
    rank = F.struct(*order)
    columns = [c for c in deliveries.columns]
    best = deliveries.groupBy(*key).agg(F.max_by(F.struct(*columns), rank).alias("_row"))
    return best.select("_row.*")


def successive(results: DataFrame) -> DataFrame:
    """``path, candidate_id, reference_id``: each extraction of a path with the one before it."""
    order = Window.partitionBy("path").orderBy("result_id")
    ids = results.where("path is not null").select("path", "result_id").distinct()
    return ids.withColumn("reference_id", F.lag("result_id").over(order)).where("reference_id is not null").withColumnRenamed("result_id", "candidate_id")


def similarity(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs with ``cosine`` of character frequencies, ``jaccard`` of line sets and ``length_ratio``.

    Only texts that occur in a pair are taken apart. Characters are counted in
    each text where it lies; only the counts meet.
    """
    side = lambda n: pairs.select(F.col(f"{n}_id").alias("result_id"))
    used = texts.join(side("candidate").union(side("reference")).distinct(), "result_id", "left_semi").dropDuplicates(["result_id"])
    solid = F.regexp_replace("result", _TEXTLESS, "")
    profile = used.select(
        "result_id",
        F.length("result").alias("length"),
        F.array_distinct(F.filter(F.transform(F.split("result", "\n"), lambda x: F.trim(x)), lambda x: x != "")).alias("lines"),
        solid.alias("solid"),
    )
    letters = profile.where("solid <> ''").select("result_id", F.explode(F.split("solid", "")).alias("c")).groupBy("result_id", "c").agg(F.count("*").cast("double").alias("n"))
    norms = letters.groupBy("result_id").agg(F.sum(F.col("n") * F.col("n")).alias("norm"))
    left, right = letters.toDF("candidate_id", "c", "n1"), letters.toDF("reference_id", "c", "n2")
    dots = pairs.join(left, "candidate_id").join(right, ["reference_id", "c"]).groupBy("candidate_id", "reference_id").agg(F.sum(F.col("n1") * F.col("n2")).alias("dot"))
    size = profile.select("result_id", "length", "lines").join(norms, "result_id", "left")
    a = size.toDF("candidate_id", "length1", "lines1", "norm1")
    b = size.toDF("reference_id", "length2", "lines2", "norm2")
    joined = pairs.join(a, "candidate_id").join(b, "reference_id").join(dots, ["candidate_id", "reference_id"], "left")
    common, either = F.size(F.array_intersect("lines1", "lines2")), F.size(F.array_union("lines1", "lines2"))
    return joined.select(
        "path", "candidate_id", "reference_id",
        F.round(F.coalesce(F.try_divide(F.col("dot"), F.sqrt(F.col("norm1")) * F.sqrt(F.col("norm2"))), F.lit(0.0)), 6).alias("cosine"),
        F.round(F.coalesce(F.try_divide(common, either), F.lit(1.0)), 6).alias("jaccard"),
        F.round(F.coalesce(F.try_divide(F.least("length1", "length2"), F.greatest("length1", "length2")), F.lit(1.0)), 6).alias("length_ratio"),
    )


def bucket(cosine: Column) -> Column:
    return F.when(cosine >= 0.99, ">=99").when(cosine >= 0.95, ">=95").when(cosine >= 0.9, ">=90").when(cosine >= 0.8, ">=80").when(cosine < 0.7, "<70").otherwise("70-80")
