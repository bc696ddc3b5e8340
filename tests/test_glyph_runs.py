from paperloom.operators.glyph_runs import page_texts

SCHEMA = "doc_id bigint, page_no int, seq bigint, unicode string, a float, b float, tx float, ty float, height float, width float, font_name string"


def glyphs(text, doc=1, page=1, seq=0, x=10.0, y=700.0, turned=False):
    out = []
    for row in text.split("\n"):
        at = x
        for c in row:
            out.append((doc, page, seq, c, 0.0 if turned else 10.0, 10.0 if turned else 0.0, *((y, at) if turned else (at, y)), 10.0, 6.0, "F"))
            seq, at = seq + 1, at + 6.0
        y -= 12
    return out


def texts(spark, rows):
    found = page_texts(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    return {(r.doc_id, r.page_no): r.text for r in found}


def test_lines_and_turned_pages(spark):
    assert texts(spark, glyphs("ab c\nde") + glyphs("ab\nc", doc=2, turned=True)) == {(1, 1): "ab c\nde", (2, 1): "ab\nc"}


def test_repeats_overprints_and_unmapped(spark):
    rows = glyphs("aab")
    over = [(*r[:2], r[2] + 100, r[3], r[4], r[5], r[6] + 0.1, *r[7:]) for r in rows]
    hole = [(1, 1, 50, None, 10.0, 0.0, 30.0, 700.0, 10.0, 6.0, None)]
    assert texts(spark, rows + rows + over + hole) == {(1, 1): "aab"}


def test_several_characters_nulls_and_empty_tables(spark):
    rows = glyphs("ab") + [(1, 1, 2, "ﬁn", None, None, 22.0, 700.0, None, None, None), (None, 1, 0, "x", 1.0, 0.0, 0.0, 0.0, 1.0, 1.0, "F"), (1, 1, None, "y", 1.0, 0.0, 0.0, 0.0, 1.0, 1.0, "F")]
    assert texts(spark, rows) == {(1, 1): "abﬁn"}
    assert texts(spark, [(3, 1, 0, None, 1.0, 0.0, 0.0, 0.0, 1.0, 1.0, "F")]) == {(3, 1): ""}
    assert page_texts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_overprints_on_two_sides_of_an_edge(spark):
    rows = glyphs("aaaa", y=100.4)
    over = [(*r[:2], r[2] + 100, r[3], r[4], r[5], r[6] + 0.1, 100.6, *r[8:]) for r in rows]
    several = [(*r[:2], r[2] + 200 + 10 * k, r[3], r[4], r[5], r[6] + 0.2 * k, 100.5, *r[8:]) for k in range(1, 6) for r in rows]
    assert texts(spark, rows + over + several) == {(1, 1): "aaaa"}


def test_a_glyph_that_holds_the_separator(spark):
    rows = [(1, 1, k, c, 10.0, 0.0, 10.0 + 6 * k, 700.0, 10.0, 6.0, "F") for k, c in enumerate(["a", "\x1f", "b\x1f", "c"])]
    assert texts(spark, rows) == {(1, 1): "abc"}


def test_dropped_glyphs_hide_no_others(spark):
    from paperloom.operators.glyph_geometry import without_overprints

    schema = "doc_id bigint, page_no int, seq bigint, unicode string, a float, b float, tx float, ty float, height float, width float, space_width float, page_width float, page_height float"
    row = lambda seq, c, x: (1, 1, seq, c, 10.0, 0.0, x, 100.0, 10.0, 9.0, 3.0, 600.0, 800.0)
    rows = [row(0, "a", 10.0), row(1, "a", 12.0), row(2, "a", 14.0), row(2, "a", 14.0), row(3, "b", 10.0), row(4, None, 10.0)]
    assert sorted(r.seq for r in without_overprints(spark.createDataFrame(rows, schema)).collect()) == [0, 2, 3]
    assert without_overprints(spark.createDataFrame([], schema)).count() == 0
