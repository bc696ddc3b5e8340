"""Operators on pages, runs and streams, and all core queries against their SQL on the smallest tables."""

import os
import pathlib

import duckdb
import pytest
from pyspark.sql import functions as F

from paperloom.operators import glyph_geometry as G
from paperloom.operators import pages as P
from paperloom.operators import quality as Q
from paperloom.plans import registry
from paperloom.sources import pdf_tables, sinks
from paperloom.sources.pdf_writer import text_to_pdf
from paperloom.streaming.ingest import ingest_texts

DATA = "/root/testdata/sf0.001"


def test_split_and_merge(spark):
    pages = spark.createDataFrame([(d, p) for d in (1, 2) for p in range(1, 6)], "doc_id int, page_no int")
    parts = P.split_parts(pages, 2, start=2, end=4).where("doc_id = 1").orderBy("page_no").select("page_no", "part_no", "part_page").collect()
    assert [tuple(r) for r in parts] == [(2, 0, 1), (3, 0, 2), (4, 1, 1)]
    assert [r.merged_no for r in P.merged(pages, ["doc_id"]).orderBy("doc_id", "page_no").collect()] == list(range(1, 11))


def test_overlays(spark):
    pages = spark.range(1, 7).select(F.col("id").alias("p"))
    rule = P.overlay_rule(F.col("p"), F.lit(6), {2: "two"}, "first", None, "odd", None, None, ["x", "y"])
    assert [r[0] for r in pages.orderBy("p").select(rule).collect()] == ["first", "two", "odd", "y", "odd", "y"]


def test_newest_and_similarity(spark):
    rows = spark.createDataFrame([(1, "p", "abc\nd", 1), (1, "p", "abc\nd", 2), (2, "p", "abc\nx", 3), (3, "q", "", 1), (4, "q", "zz", 1)], "result_id int, path string, result string, at int")
    assert sorted((r.result_id, r["at"]) for r in Q.newest(rows, ["result_id"], ["at"]).collect()) == [(1, 2), (2, 3), (3, 1), (4, 1)]
    got = {(r.candidate_id, r.reference_id): r for r in Q.similarity(Q.successive(rows), rows).collect()}
    assert got[2, 1].cosine == 0.75 and got[2, 1].jaccard == pytest.approx(1 / 3, abs=1e-6) and got[2, 1].length_ratio == 1
    assert got[4, 3].cosine == 0 and got[4, 3].length_ratio == 0


def test_regions_and_empty_tables(spark):
    schema = "doc_id int, page_no int, seq bigint, unicode string, a float, b float, tx float, ty float, height float, width float, space_width float, page_width float, page_height float"
    one = spark.createDataFrame([(1, 1, 0, "x", 1.0, 0.0, 5.0, 5.0, 1.0, 1.0, 1.0, 10.0, 10.0), (None,) * 13], schema)
    assert sorted(r.region for r in G.in_regions(one, [("a", 0, 0, 10, 10), ("b", 5, 5, 6, 6), ("c", 6, 6, 9, 9)]).collect()) == ["a", "b"]
    for rows in (one, one.limit(0)):
        for operator in (G.glyph_rank, G.without_overprints, G.contained_spaces, G.with_lines, G.words, G.page_angles):
            operator(rows).collect()


def test_sinks(spark, tmp_path):
    texts = spark.createDataFrame([("/a/x.pdf", "one"), ("/b/x.pdf", "two"), ("/c", None)], "path string, text string")
    files = [r.file for r in sinks.export_files(texts, str(tmp_path / "out")).collect()]
    assert len(set(files)) == 2 and sorted(pathlib.Path(tmp_path / "out" / f).read_text() for f in files) == ["one", "two"]
    assert sorted(r.value for r in sinks.headed(texts).collect()) == ["=== /a/x.pdf ===\none", "=== /b/x.pdf ===\ntwo"]
    status = spark.createDataFrame([("ok",), ("error",)], "status string")
    assert tuple(sinks.summary(status).first()) == (2, 1, 1, 1)
    assert tuple(sinks.summary(status.limit(0)).first()) == (0, 0, 0, 0)


def test_streaming_reads_each_file_once(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    os.mkdir(source)
    for n, text in enumerate(("alpha", "beta")):
        (tmp_path / "in" / f"{n}.pdf").write_bytes(text_to_pdf(text))
        ingest_texts(spark, source, out, state).awaitTermination()
        (tmp_path / "in" / "note.txt").write_text("no pdf")
    assert sorted(r.text for r in spark.read.parquet(out).collect()) == ["alpha", "beta"]
    listing = tmp_path / "list.txt"
    listing.write_text(f"{source}/0.pdf\n\n  {source}/1.pdf \n")
    assert pdf_tables.document_text(pdf_tables.read_file_list(spark, str(listing))).count() == 2
    assert pdf_tables.read_files(spark, source).count() == 2


def test_commands(spark, tmp_path, capsys):
    from paperloom.__main__ import run

    source = tmp_path / "in"
    source.mkdir()
    for n, text in enumerate(("alpha", "beta")):
        (source / f"{n}.pdf").write_bytes(text_to_pdf(text))
    assert run(spark, ["text", str(source), "--out", str(tmp_path / "texts")]) == 0
    assert sorted(p.read_text() for p in (tmp_path / "texts").glob("*.txt")) == ["alpha", "beta"]
    assert run(spark, ["pages", str(source), "--out", str(tmp_path / "pages")]) == 0 and spark.read.parquet(str(tmp_path / "pages")).count() == 2
    for command in ("split", "merge", "decode", "html"):
        assert run(spark, [command, str(source), "--out", str(tmp_path / command)]) == 0
    merged = [p.read_bytes() for p in (tmp_path / "merge").glob("*.pdf")]
    files = spark.createDataFrame([("m", merged[0])], "path string, content binary")
    assert len(merged) == 1 and pdf_tables.documents(files).first().page_count == 2
    assert run(spark, ["encrypt", str(source), "--out", str(tmp_path / "sealed"), "--password", "p"]) == 0
    assert run(spark, ["decrypt", str(tmp_path / "sealed"), "--out", str(tmp_path / "open"), "--password", "p"]) == 0 and len(list((tmp_path / "open").glob("*.pdf"))) == 2
    (source / "bad.pdf").write_text("no file of this kind")
    assert run(spark, ["text", str(source), "--out", str(tmp_path / "texts")]) == 1 and run(spark, ["version"]) == 0


def test_joins(spark):
    from paperloom.operators.joins import checked_broadcast_join, range_join

    rows = spark.createDataFrame([(0,), (5,), (9,), (40,), (None,), (-3,)], "v int")
    ranges = spark.createDataFrame([("a", 0, 5), ("b", 5, 39), ("c", 9, 8), ("d", -10, -3), ("e", None, 7)], "name string, low int, high int")
    found = sorted((r.v, r.name) for r in range_join(rows, "v", ranges, "low", "high", 8).collect())
    assert found == [(-3, "d"), (0, "a"), (5, "a"), (5, "b"), (9, "b")]
    small = spark.createDataFrame([(5, "x")], "v int, t string")
    for most in (0, 10):
        assert [(r.v, r.t) for r in checked_broadcast_join(rows, small, ["v"], most).collect()] == [(5, "x")]


def test_graphics_state_is_saved_and_clipped(spark):
    from paperloom.functions.cos import Document
    from paperloom.functions.graphics import Painter, curve_extent

    rows = list(Painter(Document(b"")).run(b"q 1 0 0 rg 0 0 10 10 re W n 5 5 20 20 re f Q 1 w 0 0 m 9 9 l S Q Q 3 m (x) l f", {}))
    assert [(r.kind, r.rule, r.fill_space, r.fill, r.clip[2]) for r in rows] == [("path", "nonzero", "DeviceRGB", [1.0, 0.0, 0.0], 10.0), ("path", "", "DeviceGray", [0.0], float("inf"))]
    assert curve_extent(0, 10, 10, 0) == (0, 7.5) and curve_extent(0, 0, 0, 3) == (0, 3)


def _plain(value):
    if isinstance(value, float):
        return round(value, 4)
    return tuple(map(_plain, value)) if isinstance(value, (list, tuple)) else value


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, name):
    found = registry.queries()[name](spark, DATA)
    columns = sorted(found.columns)
    rows = sorted(repr(tuple(_plain(r[c]) for c in columns)) for r in found.collect())
    if (sql := registry.oracle_sql().get(name)) is None:
        return
    with duckdb.connect() as db:
        db.execute("set timezone = 'UTC'")
        for file in pathlib.Path(DATA).glob("*.parquet"):
            db.execute(f"create view {file.stem} as select * from read_parquet('{file}')")
        result = db.execute(sql)
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        assert rows == sorted(repr(tuple(_plain(r[names.index(c)]) for c in columns)) for r in result.fetchall())
