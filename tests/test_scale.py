"""Work of queries on larger tables: files are read in all slots, and what is in them at once."""

import os

import pytest

from paperloom.functions import cos
from paperloom.plans import registry
from paperloom.plans.catalogue_queries import assembled, part_file
from paperloom.sources import pdf_tables as T

DATA = "/root/testdata/sf0.001"
#: Queries that make a file of each part, by finding.
SPREAD = [
    "file_fields",  # F2
    "file_fonts",  # F3
    "file_images",  # F4
    "file_signatures",  # F5
    "file_filters",  # F8
    "file_actions",  # F11
    "file_font_programs",  # F14
    "file_text_state",  # F16
    "file_object_types",  # F9
    "file_encodings",  # F13
    "file_graphics",  # F15
    "file_edits",  # F1
    "file_edited_bookmarks",  # F12
    "file_embedded_text",  # F7
]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", SPREAD)
def test_files_are_read_in_all_slots(spark, name):
    plan = registry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning" in plan


def test_members_and_tables_are_read_at_once(monkeypatch):
    reads = []
    plain = cos.Lexer.read
    monkeypatch.setattr(cos.Lexer, "read", lambda self, depth=0: reads.append(1) or plain(self, depth))
    document = cos.open_document(part_file(1, "name (a)", "brand", 7))
    assert document.object(61)["NM"] == b"n1" and len(document.pages()) == 3
    assert len(reads) < 120  # 467 when each number of the table and each member of a dictionary was


def _two_of_a_name() -> bytes:
    """A file that holds two files under one name."""
    from paperloom.plans.content_queries import articles_file

    inner = [articles_file(k, "") for k in (1, 2)]
    return assembled({
        1: "<< /Type /Catalog /Pages 2 0 R /Names << /EmbeddedFiles << /Names [(a) 4 0 R (b) 6 0 R] >> >> >>", 2: "<< /Type /Pages /Kids [3 0 R] /Count 1 >>", 3: "<< /Type /Page /Parent 2 0 R >>",
        4: "<< /F (in.pdf) /EF << /F 5 0 R >> >>", 5: ("", inner[0]), 6: "<< /F (in.pdf) /EF << /F 7 0 R >> >>", 7: ("", inner[1]),
    })


def test_embedded_files_of_one_name_are_read_once_each(spark):
    files = spark.createDataFrame([("x", bytearray(_two_of_a_name())), ("y", bytearray(b"no file"))], "path string, content binary")
    (row,) = T.text_with_embedded(files).collect()
    assert row.path == "x" and row.text.count("left0 1") == row.text.count("left0 2") == 1
    found = sorted((r.path, r.origin, r.level) for r in T.with_embedded(files).collect())
    assert found == [("x", "x", 0), ("x!in.pdf", "x", 1), ("x!in.pdf", "x", 1), ("y", "y", 0)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize(("name", "most"), [("file_edits", 1), ("file_between_bookmarks", 0)])
def test_files_are_read_once_for_several_tables(spark, name, most):
    plan = registry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == most


def test_overprints_are_sought_among_near_glyphs_only():
    from paperloom.functions.layout_full import Marks, Piece, articles

    compared = []

    class Counted(float):
        def __sub__(self, other):
            compared.append(1)
            return float(self) - float(other)

    places = [(7.0 * i, 12.0 * j) for j in range(20) for i in range(60)]
    pieces = [Piece("e", Counted(x), Counted(y), 5.0, 10.0, 3.0, 0) for x, y in [*places, (7.5, 12.5)]]
    (kept,) = articles(pieces, [], Marks())
    assert len(kept) == len(places) and len(compared) < 10 * len(places)  # 730,864 when each was compared with all before


#: Readers, and how many of the 46 objects of a file of a part they read at most, by finding.
PASSED_OVER = [
    (T.fonts, 4),  # F3
    (T.font_files, 4),  # F14
    (T.actions, 12),  # F11
    (T.signatures, 8),  # F5
    (T.images, 9),  # F4
]


def _rows_of(reader):
    asked = T._Asked()
    reader(asked)
    return asked.readers[0][1]


@pytest.mark.parametrize(("reader", "most"), PASSED_OVER)
def test_objects_that_a_reader_is_not_after_are_passed_over(spark, monkeypatch, reader, most):
    rows, document, read = _rows_of(reader), cos.open_document(part_file(1, "name (a)", "brand", 7)), []
    document.cache.clear()
    plain = cos.Document._object_at
    monkeypatch.setattr(cos.Document, "_object_at", lambda self, number, offset: read.append(number) or plain(self, number, offset))
    assert list(rows(document, "x")) and len(read) <= most


def test_objects_whose_text_is_not_plain_are_never_passed_over(spark):
    font = lambda n, text: {n: f"<< {text} /Subtype /Type1 /BaseFont /F{n} >>"}
    data = assembled({1: "<< /Type /Catalog /Pages 2 0 R >>", 2: "<< /Type /Pages /Kids [3 0 R] /Count 1 >>", 3: "<< /Type /Page /Parent 2 0 R >>", 9: ("/Type /Font", b"no font")}
                     | font(4, "/Type /Font") | font(5, "/Type /F#6fnt") | font(6, "/A (endobj) /Type /Font") | font(7, "/A (endobj /Type /Font) /Type/Font") | font(8, "/A (a\\) endobj) % endobj\n/Type /Font") | font(10, "/A (/Font)"))
    document = cos.open_document(data)
    assert [row[1] for row in _rows_of(T.fonts)(document, "x")] == ["F4", "F5", "F6", "F7", "F8"]


def test_texts_of_objects_that_come_again_are_read_once(monkeypatch):
    files = [part_file(k, f"name {k}", "brand", 7) for k in (1, 2)]
    cos.open_document(files[0])
    reads = []
    plain = cos.Lexer.read
    monkeypatch.setattr(cos.Lexer, "read", lambda self, depth=0: reads.append(1) or plain(self, depth))
    document = cos.open_document(files[1])
    assert len(document.pages()) == 3 and len(reads) < 10  # the table and the trailer
    document.catalog["Names"]["Dests"] = None  # what one file's readers change is not in another's
    assert cos.open_document(files[1]).catalog["Names"]["Dests"] == (20, 0)
    streams = [assembled({1: "<< /Type /Catalog /Pages 2 0 R >>", 2: "<< >>", 3: ("/A 1", content)}) for content in (b"one", b"two")]
    assert [cos.open_document(s).object(3).raw for s in streams] == [b"one", b"two"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_files_are_read_in_the_task_that_makes_them(spark):
    for name in ("file_fonts", "file_edited_bookmarks"):  # F3, F12
        plan = registry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1
    files = T.made(spark.range(3).selectExpr("id", "string(id) name"), lambda key, name: [(str(key), assembled({1: "<< /Type /Catalog >>", 2: f"<< /Type /Font /BaseFont /{name} >>"}))])
    both = [{(r.path, r.font_name) for r in T.fonts(given).collect()} for given in (files, files.select("path", "content"))]
    assert both[0] == both[1] == {("0", "0"), ("1", "1"), ("2", "2")}


def test_files_without_pages_are_not_searched(spark):
    from paperloom.plans.content_queries import filters_file

    data = filters_file(1, "name")
    whole, moved = cos.open_document(data), cos.open_document(data.replace(b"%PDF-1.6\n", b"%PDF-1.6\n\n"))
    assert not whole.recovered and moved.recovered  # F8: all of them were searched
    found = [[row[1:] for row in _rows_of(T.attachments)(d, "x")] for d in (whole, moved)]
    assert found[0] == found[1] and len(found[0]) == 11
    hidden = data + b"50 0 obj << /Type /Filespec >> endobj"
    assert cos.open_document(hidden).recovered and 50 in cos.open_document(hidden).places


def test_usual_operands_are_read_without_a_call_each(spark, monkeypatch):
    from paperloom.functions.content import operations
    from paperloom.plans.content_queries import _TEXT

    reads, plain = [], cos.Lexer.read
    monkeypatch.setattr(cos.Lexer, "read", lambda self, depth=0: reads.append(1) or plain(self, depth))
    found = list(operations(_TEXT.format(s=7).encode() + b" true 1.5 /N (a\\)) <41> [1] - .5 x 1" + b"2" * 5000 + b" y BI /W 1 ID x\nEI 2 z ] w"))
    assert len(found) == 63 and len(reads) < 30  # F16: 149 when each was read by a call
    assert found[-5:] == [("x", [True, 1.5, "N", b"a)", b"A", [1], 0, 0.5]), ("y", []), ("BI", []), ("z", [2]), ("w", [])]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_only_wanted_columns_of_glyphs_leave_the_reader(spark):
    plan = registry.queries()["file_text_state"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "page_height" not in plan  # F16


def test_edits_read_equal_texts_once(monkeypatch):
    from paperloom.plans.content_queries import _edited

    _edited(1, "name", "brand", 7)
    reads, plain = [], cos.Lexer.read
    monkeypatch.setattr(cos.Lexer, "read", lambda self, depth=0: reads.append(1) or plain(self, depth))
    assert len(_edited(2, "name", "brand", 7)) == 4 and len(reads) < 150  # 664 when each file was read anew
