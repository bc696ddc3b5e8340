"""Queries over pages, results and runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions.layout import LIGATURES, LIST_STARTS
from paperloom.functions.scalars import hit_offsets, hits, html_escaped, ligatures_expanded, markdown_escaped
from paperloom.operators import pages as P
from paperloom.operators import quality as Q
from paperloom.operators.joins import checked_broadcast_join
from paperloom.session import table


def page_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with the last box given up to them. (What pages inherit from their tree: `file_pages`.)"""
    rows = P.inherited_boxes(table(spark, folder, "pdf_pages").distinct())
    return rows.select("doc_id", "page_no", "rotation", (F.col("box.x1").cast("double") - F.col("box.x0").cast("double")).alias("width"), (F.col("box.y1").cast("double") - F.col("box.y0").cast("double")).alias("height"))


def page_labels(spark: SparkSession, folder: str) -> DataFrame:
    """LBL-01: page numbers in all styles."""
    n = F.col("page_no").cast("bigint")
    return table(spark, folder, "pdf_pages").select("doc_id", "page_no", *(P.labelled(F.lit(s), n).alias(f"label_{i}") for i, s in enumerate("DrRaA")))


def label_asof(spark: SparkSession, folder: str) -> DataFrame:
    """The last label given up to each page."""
    order = Window.partitionBy("doc_id").orderBy("page_no", "obj_num").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, folder, "pdf_pages").distinct().select("doc_id", "page_no", F.last_value("page_label", F.lit(True)).over(order).alias("label"))


def split_parts(spark: SparkSession, folder: str) -> DataFrame:
    """MPD-02: pages from the second on in parts of three."""
    return P.split_parts(table(spark, folder, "pdf_pages"), 3, start=2).select("doc_id", "page_no", "part_no", F.col("part_page").cast("bigint").alias("part_page"))


def extract_pages(spark: SparkSession, folder: str) -> DataFrame:
    """MPD-03: pages 2 to 4 of each document, counted anew."""
    chosen = table(spark, folder, "pdf_pages").where("page_no between 2 and 4")
    return chosen.select("doc_id", "page_no", (F.col("page_no") - 1).cast("bigint").alias("new_page"))


def merge_renumber(spark: SparkSession, folder: str) -> DataFrame:
    """MPD-01: pages of all documents as one."""
    return P.merged(table(spark, folder, "pdf_pages").select("doc_id", "page_no"), ["doc_id"]).select("doc_id", "page_no", F.col("merged_no").cast("bigint").alias("merged_no"))


def overlay_rule(spark: SparkSession, folder: str) -> DataFrame:
    """MPD-04: the overlay of each page."""
    pages = table(spark, folder, "pdf_pages")
    last = F.max("page_no").over(Window.partitionBy("doc_id"))
    rule = P.overlay_rule(F.col("page_no"), last, {3: "third"}, "first", "last", None, "even", None, ["one", "two", "three"])
    return pages.select("doc_id", "page_no", rule.alias("overlay"))


def page_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Results whose pages in the table are more or fewer than they tell."""
    counted = table(spark, folder, "pdf_pages").groupBy("doc_id").agg(F.count("*").alias("found"))
    told = table(spark, folder, "batch_results").select(F.col("result_id").alias("doc_id"), "n_pages").distinct()
    return told.join(counted, "doc_id", "left").where(F.coalesce("found", F.lit(0)) != F.coalesce("n_pages", F.lit(0))).select("doc_id", "n_pages", F.coalesce("found", F.lit(0)).alias("found"))


def unseen_results(spark: SparkSession, folder: str) -> DataFrame:
    """Results with text that have no glyphs: an anti join."""
    glyphs = table(spark, folder, "pdf_glyphs").select(F.col("doc_id").alias("result_id")).distinct()
    return table(spark, folder, "batch_results").where("trim(result) <> ''").select("result_id").distinct().join(glyphs, "result_id", "left_anti")


def newest_delivery(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-12: of each result the row delivered last."""
    rows = Q.newest(table(spark, folder, "batch_results"), ["result_id"], ["loaded_at", "finished_at"])
    return rows.select("result_id", "path", "status", "loaded_at")


def run_summary(spark: SparkSession, folder: str) -> DataFrame:
    """SNK-04: of each run how many files went well and failed, and the share of empty ones."""
    rows = table(spark, folder, "batch_results")
    return rows.groupBy("run_id").agg(
        F.count("*").alias("files"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "error").alias("failed"),
        F.count_if((F.col("status") == "ok") & (F.coalesce(F.trim("result"), F.lit("")) == "")).alias("empty"),
        F.coalesce(F.sum("n_pages"), F.lit(0)).cast("bigint").alias("pages"), (F.count_if(F.col("status") == "error") > 0).cast("int").alias("exit_code"),
    )


def error_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Failures by class with their share of all."""
    rows = table(spark, folder, "batch_results").where("status = 'error'").groupBy("error_class").agg(F.count("*").alias("files"))
    return rows.withColumn("share", F.round(F.col("files") / F.sum("files").over(Window.partitionBy()), 6))


def name_collisions(spark: SparkSession, folder: str) -> DataFrame:
    """SNK-02: base names that several paths share."""
    rows = table(spark, folder, "batch_results").where("path is not null").select("path").distinct()
    return rows.groupBy(F.regexp_extract("path", "([^/]*)$", 1).alias("name")).agg(F.count("*").alias("paths")).where("paths > 1")


def headed_output(spark: SparkSession, folder: str) -> DataFrame:
    """SNK-03: texts of several files with a head line each."""
    rows = table(spark, folder, "batch_results").where("status = 'ok' and result is not null")
    return rows.select("result_id", F.concat(F.lit("=== "), "path", F.lit(" ===\n"), "result").alias("output")).distinct()


def search_uid(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-24: what a search index holds of a document."""
    rows = table(spark, folder, "batch_results").where("result is not null")
    stamp = F.date_format("finished_at", "yyyyMMddHHmmss")
    return rows.select("path", F.concat(F.translate("path", "/", "\u0001"), F.lit("\u0001"), stamp).alias("uid"), F.substring("result", 1, 500).alias("summary"), F.length("result").cast("bigint").alias("length")).distinct()


def list_items(spark: SparkSession, folder: str) -> DataFrame:
    """TXT-15: lines of each result that begin as list items do."""
    lines = table(spark, folder, "batch_results").where("result is not null").select("result_id", F.explode(F.split("result", "\n")).alias("line"))
    word = F.regexp_extract("line", r"^[ \t]*([^ \t]+)", 1)
    return lines.groupBy("result_id").agg(F.count_if(word.rlike("^(?:" + "|".join(LIST_STARTS) + ")$")).alias("items"), F.count("*").alias("lines"))


def search_hits(spark: SparkSession, folder: str) -> DataFrame:
    """FIL-10: occurrences of words in texts, with and without regard to case."""
    rows = table(spark, folder, "batch_results").where("result is not null").select("result_id", "result").distinct()
    return rows.select("result_id", hits(F.col("result"), "the ").alias("exact"), hits(F.col("result"), "the ", False).alias("folded")).where("folded > 0")


def search_offsets(spark: SparkSession, folder: str) -> DataFrame:
    """FIL-10, TXT-29: where a word stands in each text, whatever its case, and the words around for a highlight."""
    rows = table(spark, folder, "documents").where("text is not null").select("doc_id", "text")
    found = rows.select("doc_id", "text", F.explode(hit_offsets(F.col("text"), "page", False)).alias("at"))
    return found.select("doc_id", F.col("at").alias("place"), F.expr("substring(text, cast(greatest(at - 9, 1) as int), cast(at + 5 + 10 - greatest(at - 9, 1) as int))").alias("around"))


def booklet(spark: SparkSession, folder: str) -> DataFrame:
    """MPD-07: the sheet and side that each page goes to in a booklet."""
    pages = table(spark, folder, "pdf_pages").select("doc_id", "page_no").distinct()
    count = F.max("page_no").over(Window.partitionBy("doc_id"))
    return pages.select("doc_id", "page_no", *P.booklet_place(F.col("page_no"), count))


def font_encodings(spark: SparkSession, folder: str) -> DataFrame:
    """Left outer joins with fallbacks: a font's encoding by its name, else that usual for its base font, else the standard one."""
    fonts = table(spark, folder, "pdf_fonts")
    usual = fonts.where("encoding_name is not null").groupBy("base_font").agg(F.min("encoding_name").alias("usual"))
    named = fonts.select("font_name", "base_font", F.col("encoding_name").alias("own"))
    used = table(spark, folder, "pdf_glyphs").groupBy("font_name").agg(F.avg(F.col("width").cast("double")).alias("w"))
    joined = used.join(named, "font_name", "left").join(usual, "base_font", "left")
    return joined.select("font_name", F.coalesce("own", "usual", F.lit("StandardEncoding")).alias("encoding"), F.round("w", 3).alias("mean_width"))


def all_texts(spark: SparkSession, folder: str) -> DataFrame:
    """A union of texts of different origin with their mean length by language and kind; the languages come by a broadcast whose size is checked."""
    results = table(spark, folder, "batch_results").where("result is not null").select(F.lit("result").alias("origin"), F.col("result").alias("text"), F.col("declared_lang").alias("lang"))
    documents = table(spark, folder, "documents").where("text is not null").select(F.lit("document").alias("origin"), "text", "lang")
    languages = table(spark, folder, "common_words").groupBy("lang").agg(F.count("*").alias("words"))
    joined = checked_broadcast_join(results.unionByName(documents), languages, ["lang"], 10_000)
    return joined.groupBy("origin", "lang", "words").agg(F.count("*").alias("texts"), F.round(F.avg(F.length("text")), 4).alias("mean_length"))


def ligatures(spark: SparkSession, folder: str) -> DataFrame:
    """TXT-20: texts with ligature signs put in and taken out again."""
    text = F.replace(F.replace("text", F.lit("ffi"), F.lit("ﬃ")), F.lit("fi"), F.lit("ﬁ"))
    return table(spark, folder, "documents").where("text is not null").select("doc_id", ligatures_expanded(text).alias("text"))


def html_text(spark: SparkSession, folder: str) -> DataFrame:
    """TXT-24: results as HTML."""
    return table(spark, folder, "batch_results").where("result is not null").select("result_id", html_escaped(F.col("result")).alias("html")).distinct()


def markdown_text(spark: SparkSession, folder: str) -> DataFrame:
    """TXT-25: results as Markdown."""
    return table(spark, folder, "batch_results").where("result is not null").select("result_id", markdown_escaped(F.col("result")).alias("markdown")).distinct()


def paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs of each result: what blank lines part."""
    parts = F.filter(F.split("result", r"\n[ \t]*\n"), lambda p: p.rlike(r"[^ \t\n\r]"))
    rows = table(spark, folder, "batch_results").where("result is not null").select("result_id", "result").distinct()
    return rows.select("result_id", F.posexplode(parts).alias("no", "text")).select("result_id", (F.col("no") + 1).alias("paragraph_no"), F.trim("text").alias("text"))


def text_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """Each extraction of a path against the one before."""
    rows = table(spark, folder, "batch_results").where("result is not null")
    return Q.similarity(Q.successive(rows), rows)


def quality_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """How many pairs are how alike."""
    return text_similarity(spark, folder).groupBy(Q.bucket(F.col("cosine")).alias("bucket")).agg(F.count("*").alias("pairs"))


_SIMILARITY = r"""
with r as (select distinct path, result_id, result from batch_results where result is not null), d as (select distinct path, result_id from r where path is not null),
p as (select path, result_id as candidate_id, lag(result_id) over (partition by path order by result_id) as reference_id from d),
q as (select * from p where reference_id is not null),
u as (select distinct result_id, result from r where result_id in (select candidate_id from q union select reference_id from q)),
l as (select result_id, unnest(string_split(regexp_replace(result, '[ \t\r\n]+', '', 'g'), '')) as c from u), n as (select result_id, c, count(*)::double as n from l where c <> '' group by all),
m as (select result_id, sum(n * n) as norm from n group by all),
t as (select a.candidate_id, a.reference_id, sum(x.n * y.n) as dot from q a join n x on x.result_id = a.candidate_id join n y on y.result_id = a.reference_id and y.c = x.c group by all),
s as (select result_id, length(result) as len, list_distinct(list_filter(list_transform(string_split(result, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')) as lines from u)
, f as (select q.path, q.candidate_id, q.reference_id,
  round(coalesce(t.dot / nullif(sqrt(m1.norm) * sqrt(m2.norm), 0), 0.0), 6) as cosine,
  round(coalesce(len(list_intersect(a.lines, b.lines)) / nullif(len(list_distinct(list_concat(a.lines, b.lines))), 0), 1.0), 6) as jaccard,
  round(coalesce(least(a.len, b.len) / nullif(greatest(a.len, b.len), 0), 1.0), 6) as length_ratio
from q join s a on a.result_id = candidate_id join s b on b.result_id = reference_id left join m m1 on m1.result_id = candidate_id left join m m2 on m2.result_id = reference_id
  left join t on t.candidate_id = q.candidate_id and t.reference_id = q.reference_id)
"""
_ROMAN = "concat(repeat('m', cast(page_no // 1000 as integer)), " + ", ".join(
    f"['', {', '.join(repr(x) for x in (a, a * 2, a * 3, a + b, b, b + a, b + a * 2, b + a * 3, a + c))}][page_no // {u} % 10 + 1]" for u, a, b, c in ((100, "c", "d", "m"), (10, "x", "l", "c"), (1, "i", "v", "x"))
) + ")"
_LETTER = "repeat(chr(cast((page_no - 1) % 26 + 97 as integer)), cast((page_no - 1) // 26 + 1 as integer))"

SQL: dict[str, str] = {
    "page_boxes": """select doc_id, page_no, rotation, box.x1::double - box.x0::double as width, box.y1::double - box.y0::double as height from (
  select *, coalesce(last_value(media_box ignore nulls) over (partition by doc_id order by page_no rows between unbounded preceding and current row),
    {'x0': 0::float, 'y0': 0::float, 'x1': 612::float, 'y1': 792::float}) as box from (select distinct * from pdf_pages))""",
    "page_labels": f"select doc_id, page_no, cast(page_no as varchar) as label_0, {_ROMAN} as label_1, upper({_ROMAN}) as label_2, {_LETTER} as label_3, upper({_LETTER}) as label_4 from pdf_pages",
    "label_asof": """select doc_id, page_no, last_value(page_label ignore nulls) over (partition by doc_id order by page_no, obj_num rows between unbounded preceding and current row) as label
from (select distinct * from pdf_pages)""",
    "split_parts": "select doc_id, page_no, cast((page_no - 2) // 3 as bigint) as part_no, cast((page_no - 2) % 3 + 1 as bigint) as part_page from pdf_pages where page_no >= 2",
    "extract_pages": "select doc_id, page_no, cast(page_no - 1 as bigint) as new_page from pdf_pages where page_no between 2 and 4",
    "merge_renumber": "select doc_id, page_no, row_number() over (order by doc_id, page_no) as merged_no from pdf_pages",
    "overlay_rule": """select doc_id, page_no, case when page_no = 3 then 'third' when page_no = 1 then 'first' when page_no = max(page_no) over (partition by doc_id) then 'last'
  when page_no % 2 = 0 then 'even' else ['one', 'two', 'three'][(page_no - 1) % 3 + 1] end as overlay from pdf_pages""",
    "page_counts": """select t.doc_id, t.n_pages, coalesce(c.found, 0) as found from (select distinct result_id as doc_id, n_pages from batch_results) t
left join (select doc_id, count(*) as found from pdf_pages group by all) c using (doc_id) where coalesce(c.found, 0) <> coalesce(t.n_pages, 0)""",
    "unseen_results": "select distinct result_id from batch_results b where trim(result, ' ') <> '' and not exists (select 1 from pdf_glyphs g where g.doc_id = b.result_id)",
    "newest_delivery": "select result_id, path, status, loaded_at from (select *, row_number() over (partition by result_id order by loaded_at desc, finished_at desc) as k from batch_results) where k = 1",
    "run_summary": """select run_id, count(*) as files, count(*) filter (status = 'ok') as ok, count(*) filter (status = 'error') as failed,
  count(*) filter (status = 'ok' and coalesce(trim(result, ' '), '') = '') as empty, cast(coalesce(sum(n_pages), 0) as bigint) as pages,
  cast(count(*) filter (status = 'error') > 0 as integer) as exit_code from batch_results group by run_id""",
    "error_classes": "select error_class, count(*) as files, round(count(*) / sum(count(*)) over (), 6) as share from batch_results where status = 'error' group by error_class",
    "name_collisions": "select regexp_extract(path, '([^/]*)$', 1) as name, count(*) as paths from (select distinct path from batch_results where path is not null) group by 1 having count(*) > 1",
    "headed_output": "select distinct result_id, '=== ' || path || ' ===' || chr(10) || result as output from batch_results where status = 'ok' and result is not null",
    "search_uid": "select distinct path, replace(path, '/', chr(1)) || chr(1) || strftime(finished_at, '%Y%m%d%H%M%S') as uid, substr(result, 1, 500) as summary, length(result) as length from batch_results where result is not null",
    "list_items": r"""select result_id, count(*) filter (regexp_matches(regexp_extract(line, '^[ \t]*([^ \t]+)', 1), '^(?:"""
    + "|".join(LIST_STARTS)
    + r""")$')) as items, count(*) as lines from (select result_id, unnest(string_split(result, chr(10))) as line from batch_results where result is not null) group by result_id""",
    "search_hits": """select * from (select result_id, cast((length(result) - length(replace(result, 'the ', ''))) / 4 as bigint) as exact,
  cast((length(lower(result)) - length(replace(lower(result), 'the ', ''))) / 4 as bigint) as folded from (select distinct result_id, result from batch_results where result is not null)) where folded > 0""",
    "search_offsets": """
with recursive h as (
  select doc_id, text, lower(text) as low, cast(strpos(lower(text), 'page') - 1 as bigint) as place from documents where text is not null
  union all select doc_id, text, low, case when strpos(substr(low, place + 5), 'page') > 0 then cast(place + 4 + strpos(substr(low, place + 5), 'page') - 1 as bigint) else -1 end from h where place >= 0
) select doc_id, place, substr(text, greatest(place - 9, 1), place + 15 - greatest(place - 9, 1)) as around from h where place >= 0""",
    "booklet": """with p as (select distinct doc_id, page_no, cast(ceil(max(page_no) over (partition by doc_id) / 4.0) * 4 as integer) as n from pdf_pages)
select doc_id, page_no, cast((least(page_no, n + 1 - page_no) + 1) // 2 as integer) as sheet, case when least(page_no, n + 1 - page_no) % 2 = 1 then 'front' else 'back' end as side,
  case when page_no % 2 = 1 then 'right' else 'left' end as half from p""",
    "font_encodings": """with u as (select base_font, min(encoding_name) as usual from pdf_fonts where encoding_name is not null group by 1)
select g.font_name, coalesce(f.encoding_name, u.usual, 'StandardEncoding') as encoding, round(w, 3) as mean_width
from (select font_name, avg(width::double) as w from pdf_glyphs group by 1) g left join pdf_fonts f on f.font_name = g.font_name left join u on u.base_font = f.base_font""",
    "all_texts": """select origin, t.lang, words, count(*) as texts, round(avg(length(text)), 4) as mean_length from (
  select 'result' as origin, result as text, declared_lang as lang from batch_results where result is not null union all select 'document', text, lang from documents where text is not null) t
join (select lang, count(*) as words from common_words group by 1) c on c.lang = t.lang group by all""",
    "ligatures": "select doc_id, " + "replace(" * 7 + "text" + "".join(f", '{a}', '{b}')" for a, b in LIGATURES.items()) + " as text from documents where text is not null",
    "html_text": """select distinct result_id, list_aggregate(list_transform(string_split(replace(replace(replace(replace(result, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), ''),
  lambda c: case when c = '' or regexp_matches(c, '^[ -~]$') then c else '&#' || cast(unicode(c) as varchar) || ';' end), 'string_agg', '') as html from batch_results where result is not null""",
    "markdown_text": r"""select distinct result_id, replace(replace(regexp_replace(result, '([\\`*_{}\[\]()#+\-.!|<>~])', '\\\1', 'g'), '²', '<sup>2</sup>'), '³', '<sup>3</sup>') as markdown
from batch_results where result is not null""",
    "paragraphs": r"""select result_id, cast(k as integer) as paragraph_no, trim(text, ' ') as text from (
  select result_id, unnest(parts) as text, unnest(range(1, len(parts) + 1)) as k from (
    select result_id, list_filter(regexp_split_to_array(result, '\n[ \t]*\n'), lambda p: regexp_matches(p, '[^ \t\n\r]')) as parts from (select distinct result_id, result from batch_results where result is not null)))""",
    "text_similarity": _SIMILARITY + "select * from f",
    "quality_buckets": _SIMILARITY
    + "select case when cosine >= 0.99 then '>=99' when cosine >= 0.95 then '>=95' when cosine >= 0.9 then '>=90' when cosine >= 0.8 then '>=80' when cosine < 0.7 then '<70' else '70-80' end as bucket, count(*) as pairs from f group by 1",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (page_boxes, page_labels, label_asof, split_parts, extract_pages, merge_renumber, overlay_rule, page_counts, unseen_results, newest_delivery, run_summary, error_classes, name_collisions,
              headed_output, search_uid, list_items, search_hits, search_offsets, booklet, font_encodings, all_texts, ligatures, html_text, markdown_text, paragraphs, text_similarity, quality_buckets)
}
