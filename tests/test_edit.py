import pytest

from paperloom.functions.content import page_glyphs
from paperloom.functions.cos import Damaged, open_document
from paperloom.sources import pdf_edit as E
from paperloom.sources.pdf_writer import text_to_pdf


def texts(data, password=""):
    d = open_document(data, password)
    return ["".join(g.unicode for g in page_glyphs(d, p)) for _, p in d.pages()]


LONG = text_to_pdf("\n".join(f"line{i}" for i in range(200)), {"Title": "T"})


def test_extract_split_merge():
    pages = texts(LONG)
    assert len(pages) == 3
    assert texts(E.extract_pages(LONG, [3, 1, 9])) == [pages[2], pages[0]]
    assert [texts(p) for p in E.split_file(LONG, 2)] == [pages[:2], pages[2:]]
    assert [len(texts(p)) for p in E.split_file(LONG, 1, start=2, end=3)] == [1, 1]
    assert texts(E.merge_files([LONG, text_to_pdf("é한")], packed=True)) == [*pages, "é한"]
    assert texts(E.merge_files([])) == []


def test_rewrite():
    for packed in (False, True):
        assert texts(E.rewrite(LONG[:-60], packed=packed)) == texts(LONG)
    plain = E.rewrite(LONG, decode=True)
    assert b"line42" in plain and texts(plain) == texts(LONG)


def test_encrypt():
    sealed = E.encrypt(LONG, user="", owner="boss", allowed={"print"})
    d = open_document(sealed)
    assert d.encrypted and texts(sealed) == texts(LONG) and b"line42" not in sealed
    locked = E.encrypt(LONG, user="secret", owner="boss")
    assert texts(locked, "secret") == texts(LONG) and texts(locked, "boss") == texts(LONG) and texts(locked) != texts(LONG)


def test_overlay():
    stamped = E.overlay(LONG, {2: text_to_pdf("STAMP"), 99: text_to_pdf("no")})
    assert ["STAMP" in t for t in texts(stamped)] == [False, True, False]
    assert texts(E.overlay(LONG, {1: text_to_pdf("UNDER")}, background=True))[0].startswith("UNDER")


def test_images():
    jpeg = b"\xff\xd8\xff\xe0\0\4ab\xff\xc0\0\x0b\x08\0\x07\0\x09\x03rest\xff\xd9"
    d = open_document(E.images_to_pdf([jpeg, jpeg]))
    assert [p["MediaBox"] for _, p in d.pages()] == [[0, 0, 9, 7]] * 2
    with pytest.raises(Damaged):
        E.images_to_pdf([b"no image at all"])


def test_tables(spark):
    files = spark.createDataFrame([("a", LONG, 1), ("b", b"broken", 1), ("c", text_to_pdf("x"), 2), ("d", None, 2)], "path string, content binary, g int")
    assert sorted((r.path, r.part_no) for r in E.split_files(files, 2).collect()) == [("a", 0), ("a", 1), ("c", 0)]
    assert {r.g: len(texts(bytes(r.content))) for r in E.merge_by(files, "g").collect()} == {"1": 3, "2": 1}


def test_contents_without_text():
    from paperloom.sources.pdf_edit import content_without_text

    kept = content_without_text(b"q 1 0 0 rg (a) Tj [(b) 3 (c)] TJ BI /W 1 ID (x) Tj EI 0 0 5 5 re f T* (d) ' 1 2 (e) \" Q")
    assert kept.split() == b"q 1 0 0 rg BI /W 1 ID (x) Tj EI 0 0 5 5 re f T* Q".split()
    assert content_without_text(b"") == b""


def test_bookmarks_of_pages_that_are_left_out():
    from paperloom.functions.cos import open_document
    from paperloom.plans.catalogue_queries import part_file
    from paperloom.sources.pdf_edit import _bookmarks, extract_pages, merge_files, without_pages

    data = part_file(1, "name", "brand", 7)
    titles = lambda d: [(level, item["Title"]) for level, item in _bookmarks(open_document(d))]
    assert [level for level, _ in titles(merge_files([data, data]))] == [1, 2, 1, 1, 2, 1]
    # the second bookmark's page stays though its parent's goes: it moves up
    assert [level for level, _ in titles(without_pages(data, [1]))] == [1, 1] and len(titles(extract_pages(data, [3]))) == 1


def test_large_groups_are_merged_in_steps(spark):
    from paperloom.sources import pdf_tables as T
    from paperloom.sources.pdf_edit import merge_by
    from paperloom.sources.pdf_writer import text_to_pdf

    rows = [("a", f"{i:02d}", bytearray(text_to_pdf(f"w{i}"))) for i in range(11)] + [("b", "00", bytearray(text_to_pdf("only"))), ("b", "01", bytearray(b"broken")), (None, "00", None)]
    files = spark.createDataFrame(rows, "g string, path string, content binary")
    merged = merge_by(files, "g", fan=3)
    texts = {r.path: r.text for r in T.document_text(merged.selectExpr("coalesce(g, '-') path", "content")).collect()}
    assert texts["a"].split() == [f"w{i}" for i in range(11)] and texts["b"] == "only" and texts["-"] == ""
    assert merge_by(files.limit(0), "g").count() == 0
