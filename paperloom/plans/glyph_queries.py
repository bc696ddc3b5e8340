"""Queries over the glyph table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import glyph_geometry as G
from paperloom.operators.glyph_runs import page_texts
from paperloom.session import table

REGIONS = [("head", 0.0, 700.0, 1000.0, 2000.0), ("body", 0.0, 100.0, 1000.0, 700.0), ("left", 0.0, 0.0, 250.0, 2000.0)]


def _glyphs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pdf_glyphs")


def glyph_direction(spark: SparkSession, folder: str) -> DataFrame:
    """GLY-09, GLY-10: direction and adjusted place of each glyph."""
    rows = G.with_position(_glyphs(spark, folder))
    return rows.select("doc_id", "page_no", "seq", "dir", *(F.round(c, 4).alias(c) for c in ("x", "y", "w", "h")))


def glyph_sort(spark: SparkSession, folder: str) -> DataFrame:
    """TXT-01: glyphs in reading order."""
    return G.glyph_rank(_glyphs(spark, folder)).select("doc_id", "page_no", "seq", "position")


def dup_suppressed(spark: SparkSession, folder: str) -> DataFrame:
    """TXT-03: what is left of each page without repeats and overprints."""
    kept = G.without_overprints(_glyphs(spark, folder))
    return kept.groupBy("doc_id", "page_no").agg(F.count("*").alias("glyphs"))


def contained_space(spark: SparkSession, folder: str) -> DataFrame:
    """TXT-05: spaces of each page that lie within another glyph."""
    rows = G.contained_spaces(G.page_rows(_glyphs(spark, folder).where("unicode is not null")))
    return rows.groupBy("doc_id", "page_no").agg(F.count_if("contained").alias("contained"), F.count("*").alias("glyphs"))


def line_group(spark: SparkSession, folder: str) -> DataFrame:
    """TXT-09: lines of each page."""
    rows = G.with_lines(G.page_rows(_glyphs(spark, folder).where("unicode is not null")))
    return rows.groupBy("doc_id", "page_no", "line_no").agg(F.count("*").alias("glyphs"), F.round(F.min("x"), 4).alias("x0"), F.round(F.max(F.col("x") + F.col("w")), 4).alias("x1"), F.round(F.min("y"), 4).alias("y"))


def word_gap(spark: SparkSession, folder: str) -> DataFrame:
    """TXT-11: words by gaps."""
    return G.words(G.page_rows(_glyphs(spark, folder)))


def page_run(spark: SparkSession, folder: str) -> DataFrame:
    """Text of each page in emission order."""
    return page_texts(_glyphs(spark, folder))


def region_text(spark: SparkSession, folder: str) -> DataFrame:
    """FIL-05: glyphs and text of named regions."""
    rows = G.in_regions(_glyphs(spark, folder).where("unicode is not null").select("doc_id", "page_no", "seq", "unicode", "tx", "ty").repartition("doc_id", "page_no").distinct(), REGIONS)
    run = F.array_sort(F.collect_list(F.struct("seq", "unicode")))
    return rows.groupBy("region", "doc_id", "page_no").agg(F.count("*").alias("glyphs"), F.array_join(F.transform(run, lambda g: g["unicode"]), "").alias("text"))


def angles(spark: SparkSession, folder: str) -> DataFrame:
    """FIL-07, GLY-13: angles of each page."""
    return G.page_angles(_glyphs(spark, folder)).withColumn("angles", F.array_join(F.col("angles").cast("array<string>"), ","))


def upright_glyphs(spark: SparkSession, folder: str) -> DataFrame:
    """FIL-06: glyphs at angle 0 of each page."""
    return _glyphs(spark, folder).where((F.col("b") == 0) & (F.col("a") > 0)).groupBy("doc_id", "page_no").agg(F.count("*").alias("glyphs"))


def no_space_glyphs(spark: SparkSession, folder: str) -> DataFrame:
    """FIL-04: glyphs of each page besides explicit spaces."""
    return _glyphs(spark, folder).where("unicode <> ' '").groupBy("doc_id", "page_no").agg(F.count("*").alias("glyphs"))


def first_pages(spark: SparkSession, folder: str) -> DataFrame:
    """FIL-01: glyphs of pages 1 to 2."""
    return _glyphs(spark, folder).where(F.col("page_no").between(1, 2)).groupBy("doc_id", "page_no").agg(F.count("*").alias("glyphs"), F.count("unicode").alias("mapped"))


def font_usage(spark: SparkSession, folder: str) -> DataFrame:
    """Glyphs by font with what its dictionary says. Counts are taken before the join, so that one font's many glyphs meet in no task."""
    counts = _glyphs(spark, folder).groupBy("font_name").agg(F.count("*").alias("glyphs"), F.count("unicode").alias("mapped"))
    fonts = table(spark, folder, "pdf_fonts")
    return counts.join(fonts, "font_name", "left").select("font_name", "glyphs", "mapped", "base_font", F.coalesce("encoding_name", F.lit("built-in")).alias("encoding_name"), "is_embedded")


def marked_text(spark: SparkSession, folder: str) -> DataFrame:
    """TXT-07: combining marks put to the glyph before, by running counts of other glyphs."""
    from pyspark.sql import Window

    rows = _glyphs(spark, folder).where("unicode is not null").select("doc_id", "page_no", "seq", "unicode").repartition("doc_id", "page_no").distinct()
    order = Window.partitionBy("doc_id", "page_no").orderBy("seq", "unicode")
    marks = r"^[̀-ͯ᪰-᫿᷀-᷿⃐-⃿︠-︯]+$"
    rows = rows.withColumn("_mark", F.col("unicode").rlike(marks)).withColumn("base", F.sum((~F.col("_mark")).cast("int")).over(order))
    return rows.groupBy("doc_id", "page_no").agg(F.count("*").alias("glyphs"), F.count_if("_mark").alias("marks"), F.max("base").alias("bases"))


_POSITION = """
with p as (
  select *, case when abs(a::double) > abs(b::double) then case when a > 0 then 0 else 180 end else case when b > 0 then 90 else 270 end end as dir from {source}
), g as (
  select *, case dir when 0 then tx::double when 90 then ty::double when 180 then page_width::double - tx::double else page_height::double - ty::double end as x,
    case dir when 0 then page_height::double - ty::double when 90 then tx::double when 180 then ty::double else page_width::double - tx::double end as y,
    abs(width::double) as w, height::double as h from p
)
"""
_COLUMNS = ", ".join(G.COLUMNS)
_ALL = _POSITION.format(source="pdf_glyphs")
_MAPPED = _POSITION.format(source=f"(select distinct {_COLUMNS} from pdf_glyphs where unicode is not null)")
_INKED = _POSITION.format(source=f"(select distinct {_COLUMNS} from pdf_glyphs where replace(unicode, ' ', '') <> '')")
_OVERLAP = "(abs({a}y - {b}y) < 0.1 or {b}y between {a}y - {a}h and {a}y or {a}y between {b}y - {b}h and {b}y)"
_LINES = """, s as (
  select *, case when lag(dir) over o = dir and (abs(y - lag(y) over o) < 0.1 or lag(y) over o between y - h and y or y between lag(y) over o - lag(h) over o and lag(y) over o) then 0 else 1 end as starts
  from g window o as (partition by doc_id, page_no order by dir, y, x, seq)
), l as (select *, cast(sum(starts) over (partition by doc_id, page_no order by dir, y, x, seq) as bigint) as line_no from s)
"""

SQL: dict[str, str] = {
    "glyph_direction": _ALL + "select doc_id, page_no, seq, dir, round(x, 4) as x, round(y, 4) as y, round(w, 4) as w, round(h, 4) as h from g",
    "glyph_sort": _ALL + "select doc_id, page_no, seq, cast(row_number() over (partition by doc_id, page_no order by dir, y, x, seq) as integer) as position from g",
    # the same text of a page in emission order, one glyph a step; what is kept goes on as a list
    "dup_suppressed": "with recursive " + _MAPPED.strip().removeprefix("with ")
    + """, o as (select *, w / greatest(length(unicode), 1) / 3 as reach, row_number() over (partition by doc_id, page_no, dir, unicode order by seq, x, y, w) as k from g),
f as (
  select doc_id, page_no, dir, unicode, k, [{'x': x, 'y': y}] as kept, 1 as keep from o where k = 1
  union all
  select o.doc_id, o.page_no, o.dir, o.unicode, o.k, case when n.near then f.kept else list_append(f.kept, {'x': o.x, 'y': o.y}) end, case when n.near then 0 else 1 end
  from f join o on o.doc_id = f.doc_id and o.page_no = f.page_no and o.dir = f.dir and o.unicode = f.unicode and o.k = f.k + 1,
    lateral (select len(list_filter(f.kept, lambda p: abs(p.x - o.x) < o.reach and abs(p.y - o.y) < o.reach)) > 0 as near) n
)
select doc_id::bigint as doc_id, page_no::bigint as page_no, count(*) as glyphs from f where keep = 1 group by all""",
    "contained_space": _MAPPED
    + """, n as (select *, row_number() over (partition by doc_id, page_no order by dir, y, x, seq) as k from g)
, c as (select distinct n.doc_id, n.page_no, n.k from n join n o on o.doc_id = n.doc_id and o.page_no = n.page_no and o.k between n.k - 5 and n.k + 5 and o.k <> n.k and o.dir = n.dir
  where n.unicode = ' ' and o.unicode <> ' ' and o.x <= n.x and n.x + n.w <= o.x + o.w and """
    + _OVERLAP.format(a="n.", b="o.")
    + """)
select n.doc_id, n.page_no, count(c.k) as contained, count(*) as glyphs from n left join c on n.doc_id = c.doc_id and n.page_no = c.page_no and n.k = c.k group by all""",
    "line_group": _MAPPED + _LINES + "select doc_id, page_no, line_no, count(*) as glyphs, round(min(x), 4) as x0, round(max(x + w), 4) as x1, round(min(y), 4) as y from l group by all",
    "word_gap": _INKED
    + _LINES
    + """, w as (
  select *, case when lag(x + w) over o + least(space_width::double * 0.5, lag(w) over o * 0.3) < x or lag(x) over o is null then 1 else 0 end as begins
  from l window o as (partition by doc_id, page_no, line_no order by x, seq)
), v as (select *, cast(sum(begins) over (partition by doc_id, page_no, line_no order by x, seq) as bigint) as word_no from w)
select doc_id, page_no, line_no, word_no, string_agg(unicode, '' order by x, seq) as text from v group by all""",
    "page_run": """
with d as (
  select distinct doc_id, page_no, seq, unicode, height::double as h, width::double as w,
    case when abs(a) >= abs(b) then tx::double else ty::double end as x, case when abs(a) >= abs(b) then ty::double else tx::double end as y from pdf_glyphs
), k as (
  select * from d where unicode is not null and not exists (
    select 1 from d o where o.doc_id = d.doc_id and o.page_no = d.page_no and o.unicode = d.unicode and o.seq < d.seq and abs(o.x - d.x) < d.w / 3 and abs(o.y - d.y) <= d.w / 3)
), b as (
  select *, case when abs(y - lag(y) over o) > 0.5 * greatest(h, lag(h) over o) then 1 else 0 end as breaks from k window o as (partition by doc_id, page_no order by seq, x)
), l as (select *, sum(breaks) over (partition by doc_id, page_no order by seq, x) as line_no from b),
i as (select doc_id, page_no, line_no, string_agg(unicode, '' order by seq, x) as line from l group by all),
t as (select *, max(line_no) over (partition by doc_id, page_no) as last from i),
u as (select doc_id, page_no, string_agg(case when last = 0 then line else trim(line, ' ') end, chr(10) order by line_no) as text from t group by all)
select p.doc_id, cast(p.page_no as bigint) as page_no, coalesce(u.text, '') as text from (select distinct doc_id, page_no from pdf_glyphs) p left join u using (doc_id, page_no)""",
    "region_text": """
with r(region, x0, y0, x1, y1) as (values """
    + ", ".join(f"('{n}', {a}, {b}, {c}, {d})" for n, a, b, c, d in REGIONS)
    + """), g as (select distinct doc_id, page_no, seq, unicode, tx, ty from pdf_glyphs where unicode is not null)
select region, doc_id, page_no, count(*) as glyphs, string_agg(unicode, '' order by seq, unicode) as text from g join r on tx >= x0 and tx < x1 and ty >= y0 and ty < y1 group by all""",
    "angles": """select doc_id, page_no, string_agg(distinct angle, ',' order by angle) as angles from (
  select doc_id, page_no, cast(((round(degrees(atan2(b::double, a::double))) + 360) % 360) as integer) as angle from pdf_glyphs) group by all""",
    "upright_glyphs": "select doc_id, page_no, count(*) as glyphs from pdf_glyphs where b = 0 and a > 0 group by all",
    "no_space_glyphs": "select doc_id, page_no, count(*) as glyphs from pdf_glyphs where unicode <> ' ' group by all",
    "first_pages": "select doc_id, page_no, count(*) as glyphs, count(unicode) as mapped from pdf_glyphs where page_no between 1 and 2 group by all",
    "font_usage": """select g.font_name, g.glyphs, g.mapped, f.base_font, coalesce(f.encoding_name, 'built-in') as encoding_name, f.is_embedded
from (select font_name, count(*) as glyphs, count(unicode) as mapped from pdf_glyphs group by font_name) g left join pdf_fonts f using (font_name)""",
    "marked_text": r"""
with g as (select distinct doc_id, page_no, seq, unicode from pdf_glyphs where unicode is not null),
m as (select *, regexp_matches(unicode, '^[\x{0300}-\x{036f}\x{1ab0}-\x{1aff}\x{1dc0}-\x{1dff}\x{20d0}-\x{20ff}\x{fe20}-\x{fe2f}]+$') as mark from g)
select doc_id, page_no, count(*) as glyphs, count(*) filter (mark) as marks, cast(count(*) filter (not mark) as bigint) as bases from m group by all""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (glyph_direction, glyph_sort, dup_suppressed, contained_space, line_group, word_gap, page_run, region_text, angles, upright_glyphs, no_space_glyphs, first_pages, font_usage, marked_text)
}
