import pytest

from paperloom.functions.layout import Config, adjusted, assemble, direction, is_list_item, normalise, overlap


def row(text, x=100.0, y=700.0, w=7.0, gap=0.0, space=4.0, h=12.0):
    out = []
    for c in text:
        out.append((c, h, 0.0, x, y, h, w, space, 612.0, 792.0))
        x += w + gap
    return out


@pytest.mark.parametrize(("a", "b", "same"), [((10, 12), (10, 12), True), ((10, 12), (10.05, 12), True), ((10, 12), (5, 12), True), ((10, 12), (30, 12), False)])
def test_overlap(a, b, same):
    assert overlap(*a, *b) is same


def test_words_and_gaps():
    assert assemble(row("tight")) == "tight"
    assert assemble(row("ab") + row("cd", x=120)) == "ab cd"
    assert assemble(row("안녕하세요", w=12)) == "안녕하세요"
    assert assemble(row("ab", space=float("nan")) + row("c", x=114.5)) == "abc"


def test_lines_and_paragraphs():
    c = Config(paragraph_separator="\n\n")
    assert assemble(row("one") + row("two", y=680)) == "one\ntwo"
    assert assemble(row("one") + row("two", y=685) + row("far", y=600), c) == "one\ntwo\n\nfar"
    assert assemble(row("one") + row("two", y=685) + row("in", x=120, y=670), c) == "one\ntwo\n\nin"


def test_few_glyphs():
    assert assemble([]) == "" and assemble(row("x")) == "x" and assemble([(None, 1, 0, 0, 0, 1, 1, 1, 9, 9), ("", 1, 0, 0, 0, 1, 1, 1, 9, 9)]) == ""


def test_duplicates():
    assert assemble(row("ab") + row("ab", x=100.1)) == "ab"
    assert sorted(assemble(row("a") + row("b"))) == ["a", "b"]
    assert assemble(row("aaa", w=0.0, gap=3.0)).replace(" ", "") == "aaa"


def test_contained_space_and_order():
    wide = [("M", 12.0, 0.0, 100.0, 700.0, 12.0, 14.0, 4.0, 612.0, 792.0)]
    space = [(" ", 12.0, 0.0, 104.0, 700.0, 12.0, 3.0, 4.0, 612.0, 792.0)]
    assert assemble(wide + space + row("x", x=114)) == "Mx"
    assert assemble(list(reversed(row("abc")))) == "abc"
    assert assemble(list(reversed(row("abc"))), Config(sort=False)).replace(" ", "") == "cba"


def test_marks_and_ligatures():
    assert assemble(row("e") + [("́", 12.0, 0.0, 101.0, 700.0, 12.0, 0.0, 4.0, 612.0, 792.0)]) == "é"
    assert normalise("ﬁne aﬄuent") == "fine affluent"


@pytest.mark.parametrize("text", ["1.", "23.", "[1]", "1)", "A.", "a)", "IV.", "ii.", ".", "1. x"])
def test_list_items(text):
    assert is_list_item(text)


@pytest.mark.parametrize("text", ["abc.", "[ab]", "..", "", "x"])
def test_no_list_items(text):
    assert not is_list_item(text)


def test_directions():
    assert [direction(*d) for d in ((1, 0), (0, 1), (-1, 0), (0, -1))] == [0, 90, 180, 270]
    assert [adjusted(a, 10, 20, 100, 200) for a in (0, 90, 180, 270)] == [(10, 180), (20, 10), (90, 20), (180, 90)]


def test_arrays_and_fold_agree(monkeypatch):
    import random

    from paperloom.functions import layout

    rng = random.Random(4)
    plain = layout._assemble_plain
    taken = 0
    for case in range(400):
        widths = rng.choice([[7.0], [3.0, 5.0, 8.0]])
        glyphs = []
        for line in range(rng.randint(1, 6)):
            x = rng.choice([100.0, 100.0, 130.0])
            for _ in range(rng.randint(1, 12)):
                w = rng.choice(widths)
                glyphs.append((rng.choice("abc é한"), 12.0, 0.0, x, 700.0 - 13 * line - rng.choice([0, 0, 40]), 12.0, w, rng.choice([4.0, 4.0, 6.0]) if case % 3 else 4.0, 612.0, 792.0))
                x += w + rng.choice([0, 0, 0, 1, 5, -1])
        rng.shuffle(glyphs) if case % 5 == 0 else None
        config = Config(paragraph_separator="\n\n", suppress_duplicates=case % 2 == 0)
        fast = plain(glyphs, config)
        monkeypatch.setattr(layout, "_assemble_plain", lambda *_: None)
        slow = assemble(glyphs, config)
        monkeypatch.setattr(layout, "_assemble_plain", plain)
        if fast is not None:
            taken += 1
            assert fast == slow
    assert taken > 150
