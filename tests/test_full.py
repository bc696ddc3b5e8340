import pytest

from paperloom.functions.documents_markup import html_documents, markdown_documents
from paperloom.functions.layout_full import Marks, Piece, article_of, compare, normalise, read_page, reordered


def row(text, x=100.0, y=700.0, w=7.0, font="F", space=4.0):
    return [(c, 12.0, 0.0, x + i * w, y, 12.0, w, space, 612.0, 792.0, font, 12.0) for i, c in enumerate(text)]


def test_emission_order_and_sorting():
    glyphs = row("late", y=600) + row("early", y=700)
    assert read_page(glyphs) == "late\nearly\n"
    assert read_page(glyphs, marks=Marks(sort=True)) == "early\nlate\n"
    assert read_page([]) == "\n"


def test_overprints_and_accents():
    assert read_page(row("ab") + row("ab", x=100.1)) == "ab\n"
    assert read_page(row("e") + [("´", 12.0, 0.0, 101.0, 700.0, 12.0, 5.0, 4.0, 612.0, 792.0, "F", 12.0)]) == "é\n"


def test_marks_around_paragraphs():
    marks = Marks(paragraph_start="<p>", paragraph_end="</p>", page_start="[", page_end="]", article_start="{", article_end="}")
    assert read_page(row("one") + row("two", y=685) + row("far", y=600), marks=marks) == "[{<p>one\ntwo\n</p><p>far</p>}]"


def test_list_items_begin_paragraphs():
    marks = Marks(paragraph_start="#")
    assert read_page(row("1. a") + row("2. b", y=685) + row("3. c", y=670), marks=marks) == "#1. a\n#2. b\n#3. c\n"


def test_articles_by_beads():
    beads = [(300.0, 0.0, 612.0, 792.0), (0.0, 0.0, 300.0, 792.0)]
    assert read_page(row("left", x=50) + row("right", x=400), beads) == "rightleft\n"
    assert article_of(10, 10, [(0, 0, 20, 20)]) == 1 and article_of(30, 30, [(0, 0, 20, 20)]) == 2 and article_of(1, 1, [(5, 5, 9, 9)]) == 0 and article_of(1, 1, [None]) == 0


def test_fonts_reset_spacing():
    assert read_page(row("ab") + row("c", x=116, font="G")) in ("abc\n", "ab c\n")


def test_comparison():
    a, b = Piece("a", 10, 100, 5, 12, 4, 0), Piece("b", 5, 95, 5, 12, 4, 0)
    assert compare(a, b) == 1 and compare(b, a) == -1 and compare(a, Piece("c", 0, 200, 5, 12, 4, 0)) == -1 and compare(a, Piece("c", 0, 0, 5, 12, 4, 90)) == -1


@pytest.mark.parametrize(("text", "want"), [("ﬁn", "fin"), ("abc", "abc"), ("ﭏ", "לא"), ("", "")])
def test_forms(text, want):
    assert normalise(text) == want


@pytest.mark.parametrize(("text", "want"), [("abc", "abc"), ("םולש", "שלום"), ("(םולש)", "(שלום)"), ("a םולש b", "a שלום b"), ("12", "12")])
def test_bidirectional(text, want):
    assert reordered(text).replace(" ", "") == want.replace(" ", "")


def test_documents(spark):
    pages = spark.createDataFrame([("a", 2, "x < y"), ("a", 1, "Title\n\nbody*"), ("b", 1, ""), ("c", 1, None)], "path string, page_no int, text string")
    html = {r.path: r.html for r in html_documents(pages).collect()}
    assert "<title>Title</title>" in html["a"] and html["a"].index("body*") < html["a"].index("x &lt; y") and "<p>" not in html["b"]
    titles = spark.createDataFrame([("a", "Given")], "path string, title string")
    assert "<title>Given</title>" in {r.path: r.html for r in html_documents(pages, titles).collect()}["a"]
    assert {r.path: r.markdown for r in markdown_documents(pages).collect()}["a"] == "Title\n\nbody\\*\n\n---\n\nx \\< y"
