"""Queries on scalar functions: filters, strings, dates, calculators, colours; and on trees and ranges."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.calculator import calculator_columns, exponential_column, sampled_column, stitched_column
from paperloom.functions.scalars import BLEND_MODES, COLOR_BLEND_MODES, cmyk_to_rgb, decoded_text, lab_to_xyz, parsed_date, pdf_date, rgb_to_gray
from paperloom.functions.stream_filters import decoded, encoded
from paperloom.operators.joins import range_join
from paperloom.session import table

# What files of each kind begin with, in hexadecimal.
MAGIC = [
    ("PDF", "25504446"), ("JPEG", "FFD8"), ("TIFF", "49492A00"), ("TIFF", "4D4D002A"), ("PSD", "38425053"), ("PNG", "89504E470D0A1A0A"), ("BMP", "424D"), ("GIF", "47494638"),
    ("ICO", "00000100"), ("PCX", "0A00"), ("PCX", "0A02"), ("PCX", "0A03"), ("PCX", "0A05"), ("RIFF", "52494646"), ("CRW", "49491A00000048454150434344520200"),
    ("CR2", "49492A001000000043520200"), ("NEF", "4D4D002A00000080003200"), ("ORF", "49494F52"), ("ORF", "4949524F"), ("RAF", "46554A4946494C4D4343442D524157"), ("RW2", "49495500"),
]


def file_type(content):
    """SRC-21: the kind of a file by its first bytes, the longest match first."""
    start = F.hex(F.substring(content, 1, 16))
    kind = F.lit("UNKNOWN")
    for name, magic in sorted(MAGIC, key=lambda m: len(m[1])):
        kind = F.when(start.startswith(magic), F.lit(name)).otherwise(kind)
    return kind


def magic_sniff(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-21: kinds of contents made of each document's text behind the start of some kind of file."""
    starts = F.array(*(F.lit(m) for _, m in MAGIC), F.lit("00"))
    content = F.concat(F.unhex(F.element_at(starts, (F.col("doc_id") % (len(MAGIC) + 1) + 1).cast("int"))), F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    return table(spark, folder, "documents").select("doc_id", file_type(content).alias("kind"))


def _round_trip(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        rows = table(spark, folder, "documents").where("text is not null").select("doc_id", F.encode("text", "UTF-8").alias("data"))
        back = rows.withColumn("packed", encoded(F.col("data"), name)).select("doc_id", F.decode(decoded(F.col("packed"), name), "UTF-8").alias("text"))
        return back

    query.__name__ = f"filter_{name.lower()}"
    query.__doc__ = f"FLT: texts through {name} and back."
    return query


FILTERS = [_round_trip(n) for n in ("FlateDecode", "LZWDecode", "ASCIIHexDecode", "ASCII85Decode", "RunLengthDecode")]


def text_strings(spark: SparkSession, folder: str) -> DataFrame:
    """STR-01: texts as string objects in turn in UTF-16, UTF-8 and Latin-1, read again."""
    rows = table(spark, folder, "documents").where("text is not null")
    text, way = F.regexp_replace("text", r"[^\x00-\x{FF}]", "?"), F.col("doc_id") % 3
    raw = F.when(way == 0, F.concat(F.unhex(F.lit("FEFF")), F.encode(text, "UTF-16BE"))).when(way == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(text, "UTF-8"))).otherwise(F.encode(text, "ISO-8859-1"))
    return rows.select("doc_id", decoded_text(raw).alias("text"))


def hex_strings(spark: SparkSession, folder: str) -> DataFrame:
    """STR-03: texts in hexadecimal."""
    return table(spark, folder, "documents").where("text is not null").select("doc_id", F.hex(F.encode("text", "UTF-8")).alias("hex"))


def nfc(spark: SparkSession, folder: str) -> DataFrame:
    """TXT-20: texts composed."""
    import unicodedata

    @F.pandas_udf("string")
    def composed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else t if t.isascii() else unicodedata.normalize("NFC", t))

    return table(spark, folder, "batch_results").where("result is not null").select("result_id", composed("result").alias("text")).distinct()


def pdf_dates(spark: SparkSession, folder: str) -> DataFrame:
    """DAT-01: times as PDF dates, with an offset for every other one, read again."""
    text = F.when(F.col("event_id") % 2 == 0, pdf_date(F.col("ts"))).otherwise(F.concat(F.substring(pdf_date(F.col("ts")), 1, 16), F.lit("+02'30'")))
    return table(spark, folder, "events").select("event_id", text.alias("pdf_date"), parsed_date(text).alias("time"))


_PROGRAM = "{ dup 10 gt { 10 sub 2 mul } { neg 3 exp abs sqrt } ifelse 2 copy add 3 1 roll exch sub 360 mod }"


def calc_program(spark: SparkSession, folder: str) -> DataFrame:
    """FN-4: a calculator program over quantities and discounts."""
    total, rest = calculator_columns(_PROGRAM, [-1e9, 1e9, -1e9, 1e9], [-1e9, 1e9, -1e9, 1e9], F.col("l_discount"), F.col("l_quantity"))
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.round(total, 4).alias("total"), F.round(rest, 4).alias("rest"))


def calc_exponential(spark: SparkSession, folder: str) -> DataFrame:
    """FN-2."""
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.round(exponential_column(F.col("l_discount") * 10, 0.25, 0.75, 1.5), 6).alias("value"))


def calc_stitching(spark: SparkSession, folder: str) -> DataFrame:
    """FN-3: powers stitched at 0.03 and 0.07."""
    parts = [lambda x: exponential_column(x, 0.0, 1.0, 1.0), lambda x: exponential_column(x, 1.0, 0.5, 2.0), lambda x: exponential_column(x, 0.5, 0.0, 1.0)]
    value = stitched_column(F.col("l_discount"), parts, [0.03, 0.07], [0, 1, 0, 1, 1, 0], [0.0, 0.1])
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.round(value, 4).alias("value"))


def calc_sampled(spark: SparkSession, folder: str) -> DataFrame:
    """FN-0: four samples over 0 to 50, straight lines between."""
    value = sampled_column(F.col("l_quantity"), [0, 255, 51, 102], [0.0, 50.0], [0.0, 1.0])
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.round(value, 4).alias("value"))


def colors(spark: SparkSession, folder: str) -> DataFrame:
    """CLR-01: conversions between device colours and from Lab."""
    c, m, k = F.col("l_discount") * 10, F.col("l_tax") * 10, (F.col("l_linenumber") % 5) / 10
    r, g, b = cmyk_to_rgb(c, m, F.lit(0.5), k)
    x, y, z = lab_to_xyz(F.col("l_quantity") * 2, F.col("l_discount") * 100, F.col("l_tax") * -100)
    values = {"r": r, "g": g, "b": b, "gray": rgb_to_gray(r, g, b), "x": x, "y": y, "z": z}
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", *(F.round(v, 6).alias(n) for n, v in values.items()))


def blend_modes(spark: SparkSession, folder: str) -> DataFrame:
    """BLD-01: all modes that blend each part of a colour by itself."""
    b, s = F.col("l_discount") * 10, F.col("l_tax") * 12.5
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", *(F.round(f(b, s), 4).alias(n.lower()) for n, f in BLEND_MODES.items()))


def blend_colors(spark: SparkSession, folder: str) -> DataFrame:
    """BLD-01: modes that blend the parts of a colour together."""
    b = (F.col("l_discount") * 10, F.col("l_tax") * 12.5, F.lit(0.25))
    s = (F.lit(0.6), F.col("l_tax") * 5, F.col("l_discount") * 4)
    out = [F.round(v, 4).alias(f"{n.lower()}_{p}") for n, f in COLOR_BLEND_MODES.items() for p, v in zip("rgb", f(b, s))]
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", *out)




def code_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """CMP-02: codes by the ranges of a table that they lie in, with their place in each: a range join."""
    low = F.col("s_suppkey") * 17
    ranges = table(spark, folder, "supplier").select("s_suppkey", low.alias("low"), (low + F.col("s_nationkey")).alias("high"))
    found = range_join(table(spark, folder, "part").select("p_partkey"), "p_partkey", ranges, "low", "high", 16)
    return found.select("p_partkey", "s_suppkey", (F.col("p_partkey") - F.col("low")).alias("place"))


def outline_tree(spark: SparkSession, folder: str) -> DataFrame:
    """A recursive join: a tree of three levels walked from its roots, with depth, path and parent of each node. (Bookmarks of files: `file_bookmarks`.)"""
    for name in ("region", "nation", "customer"):
        table(spark, folder, name).createOrReplaceTempView(f"paperloom_{name}")
    return spark.sql(_TREE.format(prefix="paperloom_", text="string"))


_TREE = """
with recursive edges as (
  select concat('r', r_regionkey) as node, cast(null as {text}) as parent, r_name as title from {prefix}region
  union all select concat('n', n_nationkey), concat('r', n_regionkey), n_name from {prefix}nation
  union all select concat('c', c_custkey), concat('n', c_nationkey), c_name from {prefix}customer
), tree as (
  select node, parent, 1 as level, cast(title as {text}) as path from edges where parent is null
  union all select e.node, e.parent, t.level + 1, concat(t.path, '/', e.title) from edges e join tree t on e.parent = t.node
)
select node, parent, level, path from tree
"""

_TEXT = "select doc_id, text from documents where text is not null"
_E = "greatest(0.0, least(1.0, {x}))"
_S = "l_tax * 12.5"
_B = "l_discount * 10"
_CUBE = "case when {v} >= 6.0::double / 29 then {v} * {v} * {v} else 108.0::double / 841 * ({v} - 4.0::double / 29) end"
_LEVEL = "((l_quantity * 2 + 16) / 116)"
SQL: dict[str, str] = {
    "magic_sniff": "select doc_id, [" + ", ".join(f"'{n}'" for n, _ in MAGIC) + f", 'UNKNOWN'][doc_id % {len(MAGIC) + 1} + 1] as kind from documents",
    **{f.__name__: _TEXT for f in FILTERS},
    "text_strings": r"select doc_id, regexp_replace(text, '[^\x{00}-\x{FF}]', '?', 'g') as text from documents where text is not null",
    "hex_strings": "select doc_id, hex(encode(text)) as hex from documents where text is not null",
    "nfc": "select distinct result_id, nfc_normalize(result) as text from batch_results where result is not null",
    "pdf_dates": """select event_id, 'D:' || strftime(ts, '%Y%m%d%H%M%S') || case when event_id % 2 = 0 then 'Z' else '+02''30''' end as pdf_date,
  date_trunc('second', ts) - case when event_id % 2 = 0 then interval 0 minute else interval 150 minute end as time from events""",
    "calc_program": """select l_orderkey, l_linenumber, round(l_discount + v, 4) as total, round(fmod(v - l_discount, 360), 4) as rest from (
  select *, case when l_quantity > 10 then (l_quantity - 10) * 2 else sqrt(abs(power(-l_quantity, 3))) end as v from lineitem)""",
    "calc_exponential": "select l_orderkey, l_linenumber, round(0.25::double + power(" + _E.format(x="l_discount * 10") + ", 1.5) * 0.5::double, 6) as value from lineitem",
    "calc_stitching": """select l_orderkey, l_linenumber, round(case when l_discount < 0.03::double then l_discount / 0.03::double
  when l_discount < 0.07::double then 1 - power((l_discount - 0.03::double) / (0.07::double - 0.03::double), 2) * 0.5
  else 0.5 - (1 - (least(l_discount, 0.1::double) - 0.07::double) / (0.1::double - 0.07::double)) * 0.5 end, 4) as value from lineitem""",
    "calc_sampled": """select l_orderkey, l_linenumber, round((s[i + 1] + (p - i) * (s[i + 2] - s[i + 1])) / 255.0::double, 4) as value from (
  select *, least(cast(floor(p) as integer), 2) as i, [0.0::double, 255, 51, 102] as s from (select *, least(greatest(l_quantity, 0), 50) / 50.0::double * 3 as p from lineitem))""",
    "colors": f"""select l_orderkey, l_linenumber, round(r, 6) as r, round(g, 6) as g, round(b, 6) as b, round(0.299::double * r + 0.587::double * g + 0.114::double * b, 6) as gray,
  round(0.9505::double * ({_CUBE.format(v="(lv + l_discount * 100 / 500)")}), 6) as x, round(1.0::double * ({_CUBE.format(v="lv")}), 6) as y, round(1.089::double * ({_CUBE.format(v="(lv - l_tax * -100 / 200)")}), 6) as z
from (select *, (1 - l_discount * 10) * (1 - (l_linenumber % 5) / 10) as r, (1 - l_tax * 10) * (1 - (l_linenumber % 5) / 10) as g, (1 - 0.5::double) * (1 - (l_linenumber % 5) / 10) as b, {_LEVEL} as lv from lineitem)""",
    "blend_modes": """select l_orderkey, l_linenumber, round(s, 4) as normal, round(b * s, 4) as multiply, round(b + s - b * s, 4) as screen,
  round(case when b <= 0.5 then 2 * b * s else 1 - 2 * (1 - b) * (1 - s) end, 4) as overlay, round(least(b, s), 4) as darken, round(greatest(b, s), 4) as lighten,
  round(case when b = 0 then 0.0 when b >= 1 - s then 1.0 else b / (1 - s) end, 4) as colordodge, round(case when b = 1 then 1.0 when 1 - b >= s then 0.0 else 1 - (1 - b) / s end, 4) as colorburn,
  round(case when s <= 0.5 then 2 * b * s else 1 - 2 * (1 - b) * (1 - s) end, 4) as hardlight,
  round(case when s <= 0.5 then b - (1 - 2 * s) * b * (1 - b) else b + (2 * s - 1) * (case when b <= 0.25 then ((16 * b - 12) * b + 4) * b else sqrt(b) end - b) end, 4) as softlight,
  round(abs(b - s), 4) as difference, round(b + s - 2 * b * s, 4) as exclusion from (select *, l_discount * 10 as b, l_tax * 12.5::double as s from lineitem)""",
    "code_ranges": """select p_partkey, s_suppkey, cast(p_partkey - low as bigint) as place from part join (select s_suppkey, s_suppkey * 17 as low, s_suppkey * 17 + s_nationkey as high from supplier)
on p_partkey between low and high""",
    "outline_tree": _TREE.format(prefix="", text="varchar"),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (magic_sniff, *FILTERS, text_strings, hex_strings, nfc, pdf_dates, calc_program, calc_exponential, calc_stitching, calc_sampled, colors, blend_modes, blend_colors, code_ranges, outline_tree)
}
