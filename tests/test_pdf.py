import hashlib
import zlib

import pytest

from paperloom.functions.content import IDENTITY, Interpreter, multiply, operations, page_glyphs
from paperloom.functions.cos import Damaged, Document, Keyword, Lexer, Name, Ref, Stream, open_document
from paperloom.functions.encryption import _PADDING, Aes, rc4
from paperloom.functions.fonts import ENCODINGS, Font, glyph_text, parse_cmap, predefined
from paperloom.sources import pdf_tables as T
from paperloom.sources.pdf_writer import text_to_pdf, write_file


def font(**more):
    return {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Test"), "FirstChar": 32, "Widths": [500 + i for i in range(224)], "Encoding": Name("WinAnsiEncoding"), **more}


def page_file(content, extra=None, page=None, fonts=None, catalog=None, packed=False):
    objects = {
        1: {"Type": Name("Catalog"), "Pages": Ref(2, 0), **(catalog or {})},
        2: {"Type": Name("Pages"), "Kids": [Ref(3, 0)], "Count": 1, "MediaBox": [0, 0, 612, 792], "Resources": {"Font": fonts or {"F1": Ref(5, 0)}}},
        3: {"Type": Name("Page"), "Parent": Ref(2, 0), "Contents": Ref(4, 0), **(page or {})},
        4: Stream({}, content),
        5: font(),
        **(extra or {}),
    }
    return write_file(objects, 1, packed=packed)


def glyphs(content, **more):
    d = open_document(page_file(content, **more))
    return page_glyphs(d, d.pages()[0][1])


def read(data):
    return Lexer(data).read()


@pytest.mark.parametrize(
    ("data", "value"),
    [(b"12", 12), (b"-3.5", -3.5), (b"+.5", 0.5), (b"--2", -2), (b"-", 0), (b"/A#20b", "A b"), (b"(a(b)c\\)\\101\\\r\nd)", b"a(b)c)Ad"), (b"<4a4B4>", b"JK@"), (b"[1 /x (y)]", [1, "x", b"y"]),
     (b"<</A 1/B[2 0 R]>>", {"A": 1, "B": [Ref(2, 0)]}), (b"true", True), (b"null", None), (b"% c\n7", 7), (b"(a\r\nb)", b"a\nb"), (b"[1 2", [1, 2])],
)
def test_lexer(data, value):
    assert read(data) == value


def test_lexer_words_and_depth():
    assert isinstance(read(b"Tj"), Keyword)
    with pytest.raises(Damaged):
        read(b"[" * 5000)


def test_positions_and_kerning():
    a, b = glyphs(b"BT /F1 12 Tf 1 0 0 1 100 700 Tm (AB) Tj ET")
    assert (a.unicode, b.unicode) == ("A", "B")
    assert (a.tx, a.ty, a.height) == (100, 700, 12)
    assert b.tx == pytest.approx(100 + 0.533 * 12)
    first, second = glyphs(b"BT /F1 10 Tf [(A) -1000 (B)] TJ ET")
    assert second.tx - first.tx == pytest.approx(5.33 + 10)


def test_operators_around_text():
    assert [g.unicode for g in glyphs(b"BT /F1 10 Tf 12 TL (a) Tj T* (b) Tj (c) ' 1 2 (d) \" ET (not shown) Tj")] == list("abcd")
    down = glyphs(b"BT /F1 10 Tf 0 -20 TD (a) Tj T* (b) Tj ET")
    assert [g.ty for g in down] == [-20, -40]
    scaled = glyphs(b"q 2 0 0 2 0 0 cm BT /F1 10 Tf (a) Tj ET Q BT /F1 10 Tf (b) Tj ET")
    assert [g.height for g in scaled] == [20, 10]
    turned = glyphs(b"BT /F1 10 Tf 0 1 -1 0 50 60 Tm (ab) Tj ET")
    assert turned[0].b == pytest.approx(10) and turned[1].ty > turned[0].ty and turned[0].width > 0
    assert [g.unicode for g in glyphs(b"BT /F1 10 Tf bad Tm (x) Tj (y) Tj ET BI /W 1 ID \x00EI\xff EI BT /F1 9 Tf (z) Tj ET")] == list("xyz")


def test_spacing_moves_what_follows():
    a, space, b = glyphs(b"BT /F1 10 Tf 1 Tc 2 Tw (A B) Tj ET")
    assert space.tx - a.tx == pytest.approx(5.33 + 1) and b.tx - space.tx == pytest.approx(5.0 + 1 + 2)


def test_actual_text_and_marks():
    shown = glyphs(b"/Span <</ActualText (o\xadk)/MCID 3>> BDC BT /F1 10 Tf (xyz) Tj ET EMC EMC BT /F1 10 Tf (q) Tj ET")
    assert [(g.unicode, g.mcid) for g in shown] == [("ok", 3), ("q", None)]


def test_forms_and_their_cycle():
    form = Stream({"Subtype": Name("Form"), "Matrix": [1, 0, 0, 1, 5, 0], "Resources": {"Font": {"F1": Ref(5, 0)}, "XObject": {"X": Ref(6, 0)}}}, b"BT /F1 10 Tf (f) Tj ET /X Do")
    shown = glyphs(b"/X Do", extra={6: form}, page={"Resources": {"XObject": {"X": Ref(6, 0)}}})
    assert len(shown) == 50 and shown[1].tx == 10


def test_matrices():
    m = (1.0, 2.0, 3.0, 4.0, 5.0, 6.0)
    assert multiply(m, IDENTITY) == m and multiply((1, 0, 0, 1, 2, 3), m) == (1, 2, 3, 4, 16, 22)


def test_operations_end_quietly():
    assert [op for op, _ in operations(b"1 0 0 rg (a Tj")] == ["rg"]
    assert list(operations(b"")) == []


def test_encodings_and_names():
    assert (glyph_text("eacute"), glyph_text("uni00410042"), glyph_text("u1F600"), glyph_text("A.small"), glyph_text(".notdef"), glyph_text("nothing")) == ("é", "AB", "😀", "A", None, None)
    assert ENCODINGS["WinAnsiEncoding"][0x80] == "€" and ENCODINGS["StandardEncoding"][0xAE] == "ﬁ" and ENCODINGS["StandardEncoding"][0xFB] == "ß" and ENCODINGS["MacRomanEncoding"][0x8E] == "é"
    f = Font(Document(b""), font(Encoding={"Differences": [65, Name("alpha"), Name("Lslash"), Name(".notdef")]}))
    assert [f.text(c, 1) for c in (65, 66, 67, 68)] == ["α", "Ł", None, "D"]
    assert f.width(33, 1) == 501 and f.width(10, 1) == 0


def test_cmaps():
    c = parse_cmap(b"1 begincodespacerange <00> <80> <8140> <9ffc> endcodespacerange 2 beginbfchar <01> <00410042> <02> /eacute endbfchar 2 beginbfrange <10> <12> <0061> <8140> <8141> [<0078> <0079>] endbfrange "
                   b"1 begincidrange <20> <2f> 100 endcidrange 1 begincidchar <30> 7 endcidchar /WMode 1 def endcmap 1 beginbfchar <05> <0041> endbfchar")  # fmt: skip
    assert [c.unicode(1, 1), c.unicode(2, 1), c.unicode(0x12, 1), c.unicode(0x8141, 2), c.unicode(5, 1)] == ["AB", "é", "c", "y", None]
    assert (c.cid(0x21, 1), c.cid(0x30, 1), c.cid(0x31, 1), c.vertical) == (101, 7, None, True)
    assert c.read(b"\x81\x40\x01", 0) == (0x8140, 2) and c.read(b"\x01", 0) == (1, 1) and c.read(b"\xff", 0) == (0xFF, 1)
    assert predefined("UniKS-UTF16-H").unicode(0xAC00, 2) == "가" and predefined("KSCms-UHC-H").unicode(0xB0A1, 2) == "가" and predefined("Identity-H").cid(5, 2) == 5
    assert len(c.rows()) == 7


def test_composite_fonts():
    f = Font(Document(b""), {"Subtype": Name("Type0"), "Encoding": Name("Identity-H"), "DescendantFonts": [{"DW": 900, "W": [1, [500, 600], 10, 20, 700]}]})
    assert [f.width(c, 2) for c in (1, 2, 3, 15)] == [500, 600, 900, 700] and f.codes(b"\0\1\0\2") == [(1, 2), (2, 2)] and f.text(0x41, 2) == "A"


@pytest.mark.parametrize("packed", [False, True])
def test_structure_and_recovery(packed):
    data = text_to_pdf("one\ntwo", {"Title": "é T"}, packed=packed)
    d = open_document(data)
    assert not d.recovered and len(d.pages()) == 1
    for broken in (b"junk\n" + data, data[:-30], data.replace(b"startxref", b"startxxxx"), data.replace(b"/Length ", b"/Lengthy ")):
        again = open_document(broken)
        assert "".join(g.unicode for g in page_glyphs(again, again.pages()[0][1])) == "onetwo"


@pytest.mark.parametrize("data", [b"", b"not a pdf", b"%PDF-1.4\n", b"%PDF-1.4\n1 0 obj <</Type /Page>> endobj", b"\0" * 5000])
def test_unreadable(data):
    with pytest.raises(Damaged):
        open_document(data)


def test_newest_section_wins():
    data = text_to_pdf("x")
    at = int(data.rsplit(b"startxref\n", 1)[1].split()[0])
    extra = b"1 0 obj\n<</Type /Catalog /Pages 2 0 R /Lang (de)>>\nendobj\n"
    start = len(data) + len(extra)
    data += extra + b"xref\n1 1\n%010d 00000 n \ntrailer\n<</Root 1 0 R /Size 9 /Prev %d>>\nstartxref\n%d\n%%%%EOF" % (len(data), at, start)
    d = open_document(data)
    assert d.catalog["Lang"] == b"de" and len(d.pages()) == 1


def test_page_tree_inherits_and_stops_at_cycles():
    objects = {1: {"Type": Name("Catalog"), "Pages": Ref(2, 0)}, 2: {"Type": Name("Pages"), "Kids": [Ref(3, 0), Ref(2, 0), Ref(9, 0)], "Rotate": 90}, 3: {"Type": Name("Pages"), "Kids": [Ref(4, 0)], "MediaBox": [0, 0, 5, 5]}, 4: {"Type": Name("Page")}}
    pages = open_document(write_file(objects, 1)).pages()
    assert len(pages) == 1 and pages[0][1]["Rotate"] == 90 and pages[0][1]["MediaBox"] == [0, 0, 5, 5]


def test_ciphers():
    assert rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    key, plain = bytes.fromhex("000102030405060708090a0b0c0d0e0f"), bytes.fromhex("00112233445566778899aabbccddeeff")
    assert Aes(key).encrypt(plain, bytes(16)).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    assert Aes(bytes(range(32))).decrypt(Aes(bytes(range(32))).encrypt(plain * 2, plain), plain) == plain * 2


def test_encrypted_with_empty_password():
    first, owner, permissions = b"0123456789abcdef", b"o" * 32, -44
    key = hashlib.md5(_PADDING + owner + (permissions & 0xFFFFFFFF).to_bytes(4, "little") + first).digest()[:5]
    seal = lambda n, data: rc4(hashlib.md5(key + n.to_bytes(3, "little") + b"\0\0").digest()[:10], data)
    content = seal(4, zlib.compress(b"BT /F1 10 Tf (hid) Tj ET"))
    # strings of content streams are not sealed by themselves, those of objects are
    data = page_file(content, extra={4: Stream({"Filter": Name("FlateDecode")}, content), 6: {"Title": seal(6, b"secret")}})
    trailer = b"/Info 6 0 R /ID [<%s> <%s>] /Encrypt <</Filter /Standard /V 1 /R 2 /P %d /O <%s> /U <%s>>>" % (first.hex().encode(), first.hex().encode(), permissions, owner.hex().encode(), rc4(key, _PADDING).hex().encode())
    d = open_document(data.replace(b"/Root 1 0 R", b"/Root 1 0 R " + trailer))
    assert d.encrypted and "".join(g.unicode for g in page_glyphs(d, d.pages()[0][1])) == "hid" and d.of(d.trailer["Info"], "Title") == b"secret"


def test_tables(spark):
    annotation = {"Type": Name("Annot"), "Subtype": Name("Link"), "Rect": [1, 2, 30, 40], "A": {"S": Name("URI"), "URI": "https://x.invalid/a"}}
    extra = {
        6: annotation, 7: {"Title": "Chapter", "Dest": [Ref(3, 0), Name("Fit")], "First": Ref(8, 0)}, 8: {"Title": "Part", "Dest": "named"},
        9: {"T": "form", "FT": Name("Tx"), "Kids": [Ref(10, 0), Ref(11, 0)]}, 10: {"T": "a", "V": "1"}, 11: {"T": "b", "FT": Name("Btn"), "Ff": 1 << 15, "V": Name("On")},
        12: Stream({"Subtype": Name("Image"), "Width": 2, "Height": 1, "BitsPerComponent": 8, "ColorSpace": Name("DeviceGray")}, b"\1\2"),
        13: Stream({}, b"<x:xmpmeta xmlns:x='adobe:ns:meta/'/>"), 14: {"UF": "in.txt", "EF": {"F": Ref(15, 0)}}, 15: Stream({"Subtype": Name("text/plain")}, b"hello"),
        16: {"Type": Name("OCG"), "Name": "Layer"}, 17: {"S": Name("P"), "Pg": Ref(3, 0), "Alt": "alt"},
    }
    catalog = {
        "Outlines": {"First": Ref(7, 0)}, "AcroForm": {"Fields": [Ref(9, 0)]}, "Metadata": Ref(13, 0), "Names": {"EmbeddedFiles": {"Names": ["k", Ref(14, 0)]}, "Dests": {"Names": ["named", [Ref(3, 0)]]}},
        "OCProperties": {"OCGs": [Ref(16, 0)], "D": {"OFF": [Ref(16, 0)]}}, "StructTreeRoot": {"K": [Ref(17, 0)]}, "PageLabels": {"Nums": [0, {"S": Name("r"), "St": 4}]}, "OpenAction": {"S": Name("JavaScript"), "JS": "go()"},
    }
    data = page_file(b"BT /F1 10 Tf (Hi) Tj ET", extra=extra, page={"Annots": [Ref(6, 0)]}, catalog=catalog)
    files = spark.createDataFrame([("good", data), ("bad", b"x"), ("none", None)], "path string, content binary")
    assert sorted((r.path, r.status, r.page_count) for r in T.documents(files).collect()) == [("bad", "error", None), ("good", "ok", 1), ("none", "error", None)]
    assert [(r.level, r.title, r.page_no) for r in T.outline(files).orderBy("item_no").collect()] == [(1, "Chapter", 1), (2, "Part", 1)]
    assert [(r.subtype, r.uri, r.rect.x1) for r in T.annotations(files).collect()] == [("Link", "https://x.invalid/a", 30.0)]
    assert sorted((r.full_name, r.kind, r.value) for r in T.fields(files).collect()) == [("form.a", "text", "1"), ("form.b", "radio", "On")]
    assert [(r.width, bytes(r.content), r.suffix) for r in T.images(files).collect()] == [(2, b"\1\2", "png")]
    assert [(r.name, r.subtype, bytes(r.content)) for r in T.attachments(files).collect()] == [("in.txt", "text/plain", b"hello")]
    assert [r.visible for r in T.layers(files).collect()] == [False]
    assert [(r.type, r.page_no, r.alt) for r in T.structure(files).collect()] == [("P", 1, "alt")]
    assert [(r.label, r.media_box.x1) for r in T.pages(files).collect()] == [("iv", 612.0)]
    assert {(r.type, r.target) for r in T.actions(files).collect()} == {("JavaScript", "go()"), ("URI", "https://x.invalid/a")}
    assert [r.text for r in T.page_text(files).collect()] == ["Hi"]
    assert T.fonts(files).count() == 1 and T.metadata(files).count() == 1 and T.objects(files).where("path = 'good'").count() == 17
    assert T.glyphs(files).count() == 2 and T.ops(files).count() == 4
    assert sorted((r.path, r.text) for r in T.document_text(files).collect()) == [("bad", None), ("good", "Hi"), ("none", None)]


def test_interpreter_without_font():
    assert [g.unicode for g in Interpreter(Document(b"")).run(b"BT (ab) Tj ET", {})] == ["a", "b"]


def test_more_tables(spark):
    extra = {
        6: {"FT": Name("Sig"), "T": "s", "V": {"Filter": Name("Adobe.PPKLite"), "Name": "Ann", "M": "D:2020", "ByteRange": [0, 1, 2, 3]}},
        7: {"F": Ref(8, 0), "I": {"Title": "story"}}, 8: {"P": Ref(3, 0), "R": [0, 0, 5, 5], "N": Ref(9, 0)}, 9: {"P": Ref(3, 0), "R": [5, 5, 9, 9], "N": Ref(8, 0)},
        10: {"Subtype": Name("Link"), "Rect": [0, 0, 20, 20], "A": {"S": Name("URI"), "URI": "https://x.invalid"}}, 11: {"Title": "One", "Dest": [Ref(3, 0)]},
    }
    catalog = {"Threads": [Ref(7, 0)], "ViewerPreferences": {"HideToolbar": True}, "Dests": {"d": [Ref(3, 0), Name("XYZ"), 1, None, 2.5]}, "Outlines": {"First": Ref(11, 0)}}
    data = page_file(b"/P <</MCID 4>> BDC BT /F1 10 Tf 5 5 Td (Hi) Tj ET EMC BT /F1 10 Tf 500 5 Td (far) Tj ET", extra=extra, page={"Annots": [Ref(10, 0)]}, catalog=catalog)
    files = spark.createDataFrame([("f", data)], "path string, content binary")
    assert [(r.field, r.signer, r.signed_at, r.covers_file) for r in T.signatures(files).collect()] == [("s", "Ann", "2020-01-01T00:00:00", False)]
    assert [(r.bead_no, r.title, r.rect.x1) for r in T.beads(files).orderBy("bead_no").collect()] == [(0, "story", 5.0), (1, "story", 9.0)]
    assert [(r.name, r.page_no, r.kind, r.arguments) for r in T.destinations(files).collect()] == [("d", 1, "XYZ", [1.0, None, 2.5])]
    assert T.viewer_preferences(files).first().preferences == {"HideToolbar": "true"}
    assert [(r.uri, r.text) for r in T.link_texts(T.annotations(files), T.glyphs(files)).collect()] == [("https://x.invalid", "Hi")]
    assert [(r.mcid, r.text) for r in T.marked_text(T.glyphs(files)).collect()] == [(4, "Hi")]
    assert T.readable(T.documents(files)).count() == 1 and T.of_kinds(T.annotations(files), "Link").count() == 1
    texts = T.page_text(files)
    assert T.between_bookmarks(texts, T.outline(files), "One", "One").count() == 1 and T.between_bookmarks(texts, T.outline(files), "None").count() == 1


def test_form_data_files(spark):
    body = {1: {"FDF": {"Fields": [{"T": "a", "Kids": [{"T": "b", "V": "x"}, {"T": "c"}]}, {"T": "d", "V": [1, 2]}]}}}
    data = write_file(body, 1).replace(b"%PDF-1.7", b"%FDF-1.2")
    files = spark.createDataFrame([("f", data), ("g", b"?")], "path string, content binary")
    assert sorted((r.full_name, r.value) for r in T.fdf_fields(files).collect()) == [("a.b", "x"), ("a.c", None), ("d", "[1, 2]")]


def test_writing_downwards():
    down = {"Type": Name("Font"), "Subtype": Name("Type0"), "BaseFont": Name("V"), "Encoding": Name("UniKS-UTF16-V"), "DescendantFonts": [{"Subtype": Name("CIDFontType0"), "DW": 1000, "W2": [0xB098, [-500, 400, 800]]}]}
    first, second, third = glyphs(b"BT /F1 10 Tf 100 700 Td <AC00B098AC00> Tj ET", extra={5: down})
    assert [first.unicode, second.unicode] == ["가", "나"]
    assert (first.tx, first.ty) == pytest.approx((95, 691.2)) and (second.tx, second.ty) == pytest.approx((96, 682)) and third.ty == pytest.approx(700 - 15 - 8.8)


def test_catalogs_fonts_and_operands(spark):
    extra = {6: {"Type": Name("FontDescriptor"), "FontName": Name("T"), "FontFile2": Ref(7, 0)}, 7: Stream({}, b"program")}
    data = page_file(b"BT /F1 10 Tf (Hi) Tj [(a) 3 (b)] TJ ET", extra=extra, catalog={"Lang": "ko", "MarkInfo": {"Marked": True}, "URI": {"Base": "https://x.invalid"}})
    files = spark.createDataFrame([("f", data)], "path string, content binary")
    found = T.catalogs(files).first()
    assert (found.language, found.marked, found.base_uri) == ("ko", True, "https://x.invalid") and "Pages" in found.entries
    assert [(r.font_name, r.kind, bytes(r.content)) for r in T.font_files(files).collect()] == [("T", "truetype", b"program")]
    assert [r.text for r in T.shown_operands(files).orderBy("seq").collect()] == ["Hi", "ab"]


def test_resources_of_public_files(spark, tmp_path):
    from paperloom.functions import fonts
    from paperloom.plans.catalogue_queries import assembled

    (tmp_path / "KSCms-UHC-H").write_bytes(b"/CMapName /KSCms-UHC-H def 2 begincodespacerange <00> <80> <8140> <FEFE> endcodespacerange 1 begincidrange <B0A1> <B0A3> 1086 endcidrange endcmap")
    (tmp_path / "Adobe-Korea1-UCS2").write_bytes(b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0001> <0002> <AC00> endbfrange 1 beginbfchar <043E> <AC01> endbfchar endcmap")
    (tmp_path / "Child-V").write_bytes(b"/KSCms-UHC-H usecmap 1 begincidchar <B0A9> 7 endcidchar endcmap")
    (tmp_path / "glyphlist.txt").write_text("# names\nzed;007A\ntwosome;0032 20AC\n")
    fonts.use_resources(str(tmp_path))
    try:
        child = fonts.predefined("Child-V")
        assert child.vertical and child.cid(0xB0A9, 2) == 7 and child.cid(0xB0A2, 2) == 1087 and fonts.glyph_text("twosome") == "2€" and fonts.stored("../x") is None and fonts.stored("None") is None
    finally:
        fonts.use_resources("")
    assert fonts.glyph_text("zed") is None and fonts.predefined("KSCms-UHC-H").cid_ranges == []
    kind = "<< /Type /Font /Subtype /CIDFontType2 /CIDSystemInfo << /Registry (Adobe) /Ordering (Korea1) /Supplement 2 >> /DW 1000 >>"
    data = assembled({
        1: "<< /Type /Catalog /Pages 2 0 R >>", 2: "<< /Type /Pages /Kids [3 0 R] /Count 1 >>", 3: "<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F 5 0 R /G 6 0 R >> >> >>",
        4: ("", b"BT /F 10 Tf 10 500 Td <00010002> Tj /G 10 Tf <01> Tj ET"), 5: f"<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /DescendantFonts [{kind}] >>",
        6: "<< /Type /Font /Subtype /Type1 /Encoding << /Differences [1 /zed] >> >>",
    })
    files = spark.createDataFrame([("a", bytearray(data))], "path string, content binary")
    assert "".join(r.unicode for r in T.glyphs(files, resources=str(tmp_path), columns=["seq", "unicode"]).orderBy("seq").collect()) == "가각z"
    assert T.document_text(files, resources=str(tmp_path)).first().text.replace(" ", "") == "가각z" and T.page_text(files).first().text != "가각z"
