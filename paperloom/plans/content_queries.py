"""Queries over content streams: graphics, text state and fonts, calculator operators.

Streams are made of the numbers of a table's rows, with every operator of the
format in them; the SQL works out by itself where things have to come out.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.calculator import calculator_columns
from paperloom.plans.catalogue_queries import _made, assembled, part_file
from paperloom.session import durable, ensure_checkpoint_dir, spread, table
from paperloom.sources import pdf_edit, sinks
from paperloom.sources import pdf_tables as T


def _page(content: str, resources: str, more: dict[int, str | tuple[str, bytes]]) -> bytes:
    return assembled({
        1: "<< /Type /Catalog /Pages 2 0 R >>", 2: "<< /Type /Pages /Kids [3 0 R] /Count 1 >>", 3: f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Contents 4 0 R /Resources << {resources} >> >>",
        4: ("", content.encode("latin-1")), **more,
    })


# graphics -------------------------------------------------------------------

_GRAPHICS = """q 2 0 0 2 10 20 cm 3 w 1 J 2 j 4 M [1 2] 0.5 d 0.5 i /Perceptual ri 0.1 0.2 0.3 rg 0.4 G
0 0 {s} 5 re f
1 1 m 4 1 l 4 5 l h S
0 0 m 1 2 3 4 5 6 c 7 8 9 10 v 11 12 13 14 y s
/DeviceCMYK cs 0 0 0.5 1 sc 0 0 1 1 re F
/DeviceRGB CS 1 0 0.25 SC 0 0 1 1 re f*
/Spot cs 0.5 scn 0 0 1 1 re B
/Pattern CS /P1 SCN 0 0 1 1 re B*
0.2 g 0.1 0.2 0.3 0.4 K 0 0 m 2 0 l 2 3 l b
0.1 0.2 0.3 0.4 k 0.5 0.6 0.7 RG 0 0 m 2 0 l 2 3 l b*
/G1 gs 0 0 1 1 re S
q 0 0 {s} {s} re W n 0 0 2 2 re W* n 0 0 50 50 re f /Sh1 sh Q
/Im1 Do /Fm1 Do
BI /W 1 /H 1 /BPC 8 /CS /G ID x
EI
Q 1 0 0 1 0 0 cm 0 0 m 0 30 30 30 30 0 c S"""


def graphics_file(key: int, size: int) -> bytes:
    resources = (
        "/ColorSpace << /Spot [/Separation /Gold /DeviceCMYK 9 0 R] >> /ExtGState << /G1 << /LW 7 /LC 0 /LJ 1 /ML 2 /D [[3] 1] /RI /Saturation /FL 2 /CA 0.5 /ca 0.25 >> >> "
        "/XObject << /Im1 6 0 R /Fm1 7 0 R >>"
    )
    image, form = ("/Type /XObject /Subtype /Image /Width 1 /Height 1 /BitsPerComponent 8 /ColorSpace /DeviceGray", b"x"), ("/Type /XObject /Subtype /Form /BBox [0 0 4 4] /Matrix [1 0 0 1 3 3]", b"1 w 0 0 10 1 re S")
    return _page(_GRAPHICS.format(s=size), resources, {6: image, 7: form})


def file_graphics(spark: SparkSession, folder: str) -> DataFrame:
    """All operators of paths, painting, clips, colours and the graphics state: what is painted where and how."""
    number = lambda c: F.regexp_replace(F.format_string("%.2f", c), "-0.00", "0.00")
    comps = lambda c: F.array_join(F.transform(c, lambda v: F.format_string("%.2f", v)), " ")
    state = F.concat_ws(" ", number(F.col("line_width")), "line_cap", "line_join", number(F.col("miter_limit")), comps("dash"), number(F.col("dash_phase")), number(F.col("flatness")), "intent", number(F.col("fill_alpha")), number(F.col("stroke_alpha")))
    rows = T.graphics(_made(spark, folder, graphics_file, "p_partkey", "p_size"))
    return rows.select(
        F.col("path").cast("bigint").alias("p_partkey"), "seq", "kind", F.coalesce("name", F.lit("")).alias("name"), "rule", "stroked", "x0", "y0", "x1", "y1", "subpaths", "segments", state.alias("state"),
        F.concat_ws(" ", "fill_space", comps("fill"), "fill_pattern").alias("fill"), F.concat_ws(" ", "stroke_space", comps("stroke"), "stroke_pattern").alias("stroke"), F.least("clip_x1", F.lit(1e6)).alias("clip_x1"),
    )


_SET = "3.00 1 2 4.00 1.00 2.00 0.50 0.50 Perceptual 1.00 1.00"
_G1 = "7.00 0 1 2.00 3.00 1.00 2.00 Saturation 0.25 0.50"
_RGB, _GRAY = "'DeviceRGB 0.10 0.20 0.30'", "'DeviceGray 0.40'"
_CMYK, _RED, _SPOT, _PATTERN = "'DeviceCMYK 0.00 0.00 0.50 1.00'", "'DeviceRGB 1.00 0.00 0.25'", "'Separation 0.50'", "'Pattern  P1'"
_K, _RG = "'DeviceCMYK 0.10 0.20 0.30 0.40'", "'DeviceRGB 0.50 0.60 0.70'"
_PAINTED = [
    ("path", "", "nonzero", "false", "10", "20", "10 + 2 * p_size", "30", 1, 4, _SET, _RGB, _GRAY, "1e6"),
    ("path", "", "", "true", "12", "22", "18", "30", 1, 3, _SET, _RGB, _GRAY, "1e6"),
    ("path", "", "", "true", "10", "20", "36", "48", 1, 4, _SET, _RGB, _GRAY, "1e6"),
    ("path", "", "nonzero", "false", "10", "20", "12", "22", 1, 4, _SET, _CMYK, _GRAY, "1e6"),
    ("path", "", "evenodd", "false", "10", "20", "12", "22", 1, 4, _SET, _CMYK, _RED, "1e6"),
    ("path", "", "nonzero", "true", "10", "20", "12", "22", 1, 4, _SET, _SPOT, _RED, "1e6"),
    ("path", "", "evenodd", "true", "10", "20", "12", "22", 1, 4, _SET, _SPOT, _PATTERN, "1e6"),
    ("path", "", "nonzero", "true", "10", "20", "14", "26", 1, 3, _SET, "'DeviceGray 0.20'", _K, "1e6"),
    ("path", "", "evenodd", "true", "10", "20", "14", "26", 1, 3, _SET, _K, _RG, "1e6"),
    ("path", "", "", "true", "10", "20", "12", "22", 1, 4, _G1, _K, _RG, "1e6"),
    ("path", "", "nonzero", "false", "10", "20", "110", "120", 1, 4, _G1, _K, _RG, "10 + 2 * least(p_size, 2)"),
    ("shading", "Sh1", "", "false", "10", "20", "10 + 2 * least(p_size, 2)", "20 + 2 * least(p_size, 2)", 0, 0, _G1, _K, _RG, "10 + 2 * least(p_size, 2)"),
    ("image", "Im1", "", "false", "10", "20", "12", "22", 0, 0, _G1, _K, _RG, "1e6"),
    ("path", "", "", "true", "16", "26", "36", "28", 1, 4, "1.00" + _G1[4:], _K, _RG, "24"),
    ("inline", "", "", "false", "10", "20", "12", "22", 0, 0, _G1, _K, _RG, "1e6"),
    ("path", "", "", "true", "0", "0", "30", "22.5", 1, 1, "1.00 0 0 10.00  0.00 1.00 RelativeColorimetric 1.00 1.00", "'DeviceGray 0.00'", "'DeviceGray 0.00'", "1e6"),
]


def _painted_sql() -> str:
    cases = [
        f"select p_partkey, {n}::bigint as seq, '{kind}' as kind, '{name}' as name, '{rule}' as rule, {stroked} as stroked, ({x0})::double as x0, ({y0})::double as y0, ({x1})::double as x1, ({y1})::double as y1, "
        f"{subpaths} as subpaths, {segments} as segments, '{state}' as state, {fill} as fill, {stroke} as stroke, ({clip})::double as clip_x1 from part"
        for n, (kind, name, rule, stroked, x0, y0, x1, y1, subpaths, segments, state, fill, stroke, clip) in enumerate(_PAINTED)
    ]
    return " union all ".join(cases)


# text -----------------------------------------------------------------------

_TEXT = """q 2 0 0 2 5 7 cm BT /F1 10 Tf 3 Tr 100 {s} Td (AB) Tj 1 Tc 2 Tw (A B) Tj 0 Tc 0 Tw
50 Tz (A) Tj (B) Tj 100 Tz 5 Ts (A) Tj 0 Ts 12 TL T* (B) Tj (A) ' 3 4 (A B) " 0 Tc 0 Tw
[(A) -500 (B) 250 (C)] TJ 10 -20 TD (C) Tj T* (A) Tj 0 1 -1 0 30 40 Tm (AB) Tj
/Span << /ActualText (xyz) /MCID 3 >> BDC (AB) Tj EMC /P BMC (C) Tj EMC /A MP /B /P1 DP ET Q
BT /F2 10 Tf 1 0 0 1 0 0 Tm (ab) Tj /F3 8 Tf <00010002> Tj ET /Fm1 Do BT /F1 10 Tf (A) Tj ET BT (B) Tj ET"""


def text_file(key: int, size: int) -> bytes:
    """A page that shows text in a font of widths 500, 600 and 700, one with differences, one of two-byte codes."""
    resources = "/Font << /F1 6 0 R /F2 7 0 R /F3 8 0 R >> /XObject << /Fm1 12 0 R >>"
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0001> <D55C> endbfchar 1 beginbfrange <0002> <0003> <0410> endbfrange"
    return _page(_TEXT.format(s=size), resources, {
        6: "<< /Type /Font /Subtype /Type1 /BaseFont /Made /FirstChar 65 /LastChar 67 /Widths [500 600 700] /Encoding /WinAnsiEncoding /FontDescriptor << /Type /FontDescriptor /FontName /Made /Flags 32 /MissingWidth 250 >> >>",
        7: f"<< /Type /Font /Subtype /TrueType /BaseFont /Other /FirstChar 97 /LastChar 98 /Widths [{100 + size} 400] /Encoding << /Type /Encoding /BaseEncoding /MacRomanEncoding /Differences [97 /eacute /uni0416] >> >>",
        8: "<< /Type /Font /Subtype /Type0 /BaseFont /Wide /Encoding /Identity-H /DescendantFonts [9 0 R] /ToUnicode 10 0 R >>",
        9: "<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Wide /CIDSystemInfo << /Registry (Adobe) /Ordering (Identity) /Supplement 0 >> /DW 900 /W [2 [450] 5 7 100] >>",
        10: ("", cmap), 12: ("/Type /XObject /Subtype /Form /BBox [0 0 9 9] /Matrix [1 0 0 1 50 60] /Resources << /Font << /F1 6 0 R >> >>", b"BT /F1 10 Tf (C) Tj ET"),
    })


def file_text_state(spark: SparkSession, folder: str) -> DataFrame:
    """All operators of text: where each glyph stands, how wide it is, and what it says."""
    rows = T.glyphs(_made(spark, folder, text_file, "p_partkey", "p_size"), columns=["path", "seq", "unicode", "tx", "ty", "width", "height", "font_name", "mcid", "mc_tag"])
    value = lambda c: F.round(F.col(c).cast("double"), 3).alias(c)
    return rows.select(F.col("path").cast("bigint").alias("p_partkey"), "seq", "unicode", value("tx"), value("ty"), value("width"), value("height"), F.col("font_name"), "mcid", "mc_tag")


# place along the line and above the page's foot in text space, width, of each glyph of the first part: (x, y, width) before the matrix of 2 0 0 2 5 7
_ALONG = [
    ("A", "100", "s", 5), ("B", "105", "s", 6), ("A", "111", "s", 5), (" ", "117", "s", 2.5), ("B", "122.5", "s", 6), ("A", "129.5", "s", 2.5), ("B", "132", "s", 3), ("A", "135", "s + 5", 5),
    ("B", "100", "s - 12", 6), ("A", "100", "s - 24", 5), ("A", "100", "s - 36", 5), (" ", "109", "s - 36", 2.5), ("B", "118.5", "s - 36", 6),
    ("A", "128.5", "s - 36", 5), ("B", "138.5", "s - 36", 6), ("C", "142", "s - 36", 7), ("C", "110", "s - 56", 7), ("A", "110", "s - 76", 5),
]


def _text_sql() -> str:
    cases, n = [], 0

    def add(text: str, x: str, y: str, width: str, height: str, font: str, mcid: str = "null", tag: str = "null") -> None:
        nonlocal n
        cases.append(f"select p_partkey, {n}::bigint as seq, '{text}' as unicode, round(({x})::double, 3) as tx, round(({y})::double, 3) as ty, round(({width})::double, 3) as width, {height}::double as height, '{font}' as font_name, {mcid}::integer as mcid, {tag}::varchar as mc_tag from t")
        n += 1

    for text, x, y, width in _ALONG:
        add(text, f"2 * ({x}) + 5", f"2 * ({y}) + 7", str(2 * width), "20", "Made")
    # turned upwards: places go along y, and so do widths
    for text, along, width in (("A", 0, 5), ("B", 5, 6)):
        add(text, "65", f"2 * (40 + {along}) + 7", str(2 * width), "20", "Made")
    add("xyz", "65", "2 * 51 + 7", "10", "20", "Made", "3", "'Span'")
    add("C", "65", "2 * 62 + 7", "14", "20", "Made", "null", "'P'")
    add("é", "0", "0", "(100 + s) / 100.0", "10", "Other")
    add("Ж", "(100 + s) / 100.0", "0", "4", "10", "Other")
    add("한", "(100 + s) / 100.0 + 4", "0", "7.2", "8", "Wide")
    add("А", "(100 + s) / 100.0 + 11.2", "0", "3.6", "8", "Wide")
    add("C", "50", "60", "7", "10", "Made")
    add("A", "0", "0", "5", "10", "Made")
    add("B", "0", "0", "6", "10", "Made")
    return "with t as (select p_partkey, p_size as s from part) " + " union all ".join(cases)


# encodings, filters, articles, paths ------------------------------------------

#: Fonts by name: their dictionary, the bytes they show, and what these say.
_FONTS: list[tuple[str, bytes, str]] = [
    ("/Subtype /Type1 /Encoding /WinAnsiEncoding", b"\xe9\x80\x95", "é€•"), ("/Subtype /Type1 /Encoding /MacRomanEncoding", b"\x8e\xa5", "é•"), ("/Subtype /Type1", b"\xe9\xae'", "Øﬁ’"),
    ("/Subtype /Type1 /BaseFont /Symbol", b"ab", "αβ"), ("/Subtype /Type1 /BaseFont /ZapfDingbats", b"!4", "✁✔"), ("/Subtype /TrueType /Encoding << /Differences [1 /Euro /alpha /uni0416 /u1F600 /f_i /a.alt] >>", b"\x01\x02\x03\x04\x06", "€αЖ😀a"),
    ("/Subtype /Type3 /FontMatrix [0.01 0 0 0.01 0 0] /CharProcs << >> /Encoding << /Differences [5 /eacute] >>", b"\x05", "é"),
    *((f"/Subtype /Type0 /Encoding /{name} /DescendantFonts [<< /Type /Font /Subtype /CIDFontType0 >>]", text.encode(codec), text) for name, codec, text in (
        ("KSCms-UHC-H", "cp949", "한글a"), ("KSC-EUC-H", "cp949", "글"), ("UniKS-UCS2-H", "utf-16-be", "한A"), ("UniGB-UTF16-H", "utf-16-be", "中"), ("90ms-RKSJ-H", "cp932", "あア"), ("GBK-EUC-H", "gbk", "中文"), ("ETen-B5-H", "big5", "中文"),
    )),
]


def encodings_file(key: int, name: str) -> bytes:
    """One page for each font."""
    objects: dict[int, str | tuple[str, bytes]] = {1: "<< /Type /Catalog /Pages 2 0 R >>", 2: f"<< /Type /Pages /Kids [{' '.join(f'{10 + 3 * i} 0 R' for i in range(len(_FONTS)))}] /Count {len(_FONTS)} /MediaBox [0 0 612 792] >>"}
    for i, (font, shown, _) in enumerate(_FONTS):
        n = 10 + 3 * i
        base = "" if "BaseFont" in font else "/BaseFont /Made"
        objects |= {n: f"<< /Type /Page /Parent 2 0 R /Contents {n + 1} 0 R /Resources << /Font << /F {n + 2} 0 R >> >> >>", n + 1: ("", f"BT /F 10 Tf 50 500 Td <{shown.hex()}> Tj ET".encode()), n + 2: f"<< /Type /Font {base} {font} >>"}
    return assembled(objects)


def file_encodings(spark: SparkSession, folder: str) -> DataFrame:
    """FNT-02, FNT-05, CMP-01, ENC-01 to ENC-04: what the codes of fonts of all kinds and encodings say."""
    run = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "unicode"))), lambda g: g["unicode"]), "").alias("text")
    return T.glyphs(_made(spark, folder, encodings_file, "p_partkey", "p_name"), columns=["path", "page_no", "seq", "unicode"]).groupBy(F.col("path").cast("bigint").alias("p_partkey"), "page_no").agg(run)


def _png(rows: list[bytes], kind: int) -> bytes:
    """Rows of bytes with a PNG predictor, as the PNG rules have it."""
    out, above = b"", bytes(len(rows[0]))
    for row in rows:
        left, upper = bytes([0]) + row[:-1], bytes([0]) + above[:-1]
        if kind == 4:
            guess = bytes(min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2] for a, b, c in zip(left, above, upper))
        else:
            guess = bytes((a + b) // 2 for a, b in zip(left, above)) if kind == 3 else (bytes(len(row)), left, above)[kind]
        out += bytes([kind]) + bytes((v - g) % 256 for v, g in zip(row, guess))
        above = row
    return out


def filters_file(key: int, name: str) -> bytes:
    """Embedded files behind filters, encoded by the standard library or byte by byte."""
    data = name.encode()
    padded = data.ljust(24, b".")[:24]
    rows = [padded[i : i + 8] for i in (0, 8, 16)]
    pairs = b"".join(bytes([len(chunk) - 1]) + chunk for chunk in (data[i : i + 100] for i in range(0, len(data), 100))) + bytes([253]) + b"z" + b"\x80"
    tiff = zlib.compress(b"".join(bytes((row[i] - (row[i - 1] if i else 0)) % 256 for i in range(8)) for row in rows))
    streams = {
        "flate": ("/Filter /FlateDecode", zlib.compress(data)), "hex": ("/Filter /ASCIIHexDecode", data.hex(" ").encode() + b">"), "a85": ("/Filter /ASCII85Decode", base64.a85encode(data) + b"~>"),
        "chain": ("/Filter [/AHx /Fl]", zlib.compress(data).hex().encode() + b">"), "runs": ("/Filter /RunLengthDecode", pairs), "tiff": ("/Filter /FlateDecode /DecodeParms << /Predictor 2 /Columns 8 >>", tiff),
        **{f"png{k}": (f"/Filter /FlateDecode /DecodeParms << /Predictor {10 + k} /Columns 8 >>", zlib.compress(_png(rows, k))) for k in range(5)},
    }
    names, objects = "", {1: "", 2: "<< /Type /Pages /Kids [] /Count 0 >>"}
    for i, (kind, (entries, raw)) in enumerate(sorted(streams.items())):
        names += f"({kind}) << /F ({kind}) /EF << /F {10 + i} 0 R >> >> "
        objects[10 + i] = (entries, raw)
    return assembled(objects | {1: f"<< /Type /Catalog /Pages 2 0 R /Names << /EmbeddedFiles << /Names [{names}] >> >> >>"})


def file_filters(spark: SparkSession, folder: str) -> DataFrame:
    """FLT-01 to FLT-05, FLT-11: streams behind filters and predictors that others encoded."""
    rows = T.attachments(_made(spark, folder, filters_file, "p_partkey", "p_name"))
    return rows.select(F.col("path").cast("bigint").alias("p_partkey"), "name", F.decode("content", "utf-8").alias("content"))


def articles_file(key: int, name: str) -> bytes:
    """Two columns whose lines are shown across, and beads that read the right one first."""
    lines = "".join(f"BT /F1 10 Tf 1 0 0 1 50 {700 - 12 * k} Tm (left{k} {key}) Tj 1 0 0 1 300 {700 - 12 * k} Tm (right{k}) Tj ET " for k in range(3))
    return assembled({
        1: "<< /Type /Catalog /Pages 2 0 R >>", 2: "<< /Type /Pages /Kids [3 0 R] /Count 1 >>", 4: ("", lines.encode()),
        3: "<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Contents 4 0 R /Resources << /Font << /F1 6 0 R >> >> /B [7 0 R 8 0 R] >>",
        6: f"<< /Type /Font /Subtype /Type1 /BaseFont /Made /FirstChar 32 /LastChar 126 /Widths [{' 500' * 95}] /Encoding /WinAnsiEncoding >>",
        7: "<< /R [290 600 500 720] /N 8 0 R /P 3 0 R >>", 8: "<< /R [40 600 280 720] /N 7 0 R /P 3 0 R >>",
    })


def file_articles(spark: SparkSession, folder: str) -> DataFrame:
    """TXT-02, TXT-19: pages read article by article, between which nothing is written; and line by line in the batch way."""
    files = _made(spark, folder, articles_file, "p_partkey", "p_name")
    flat = lambda rows, way: rows.select(F.col("path").cast("bigint").alias("p_partkey"), F.lit(way).alias("way"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"))
    return flat(T.page_text_full(files), "articles").unionByName(flat(T.page_text(files), "lines"))


def file_paths(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-01, SRC-03, SRC-04, SNK-02: files written one by one, found again by folder and by a list of paths."""
    ensure_checkpoint_dir(spark)
    target = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/files-{uuid.uuid4().hex}"
    plain = target.removeprefix("file://").removeprefix("file:") if target.startswith("file:") else target
    named = sinks.export_bytes(_made(spark, folder, articles_file, "p_partkey", "p_name"), f"{plain}/made")
    durable(named).select(F.concat(F.lit(f"{plain}/made/"), "file")).write.text(f"{plain}/list")
    found = T.documents(T.read_files(spark, f"{plain}/made")).select("path", F.lit("folder").alias("way"), "status", "page_count")
    listed = T.documents(T.read_file_list(spark, f"{plain}/list")).select("path", F.lit("list").alias("way"), "status", "page_count")
    return found.unionByName(listed).select(F.regexp_extract("path", r"/(\d+)-[0-9a-f]+\.pdf$", 1).cast("bigint").alias("p_partkey"), "way", "status", "page_count")


# layers, and files within files ----------------------------------------------


def layered_file(key: int, name: str) -> bytes:
    """Text in a layer that shows, in one that does not, in a group of such, and in a form of one."""
    content = f"BT /F1 10 Tf /OC /L1 BDC ({name[:1]}) Tj EMC /OC /L2 BDC (x) Tj /P BMC (y) Tj EMC EMC /OC /M1 BDC (z) Tj EMC (k) Tj ET /Fm1 Do"
    layers = "/OCProperties << /OCGs [20 0 R 21 0 R] /D << /OFF [21 0 R] >> >>"
    return _page(content, "/Font << /F1 6 0 R >> /Properties << /L1 20 0 R /L2 21 0 R /M1 22 0 R >> /XObject << /Fm1 12 0 R >>", {
        1: f"<< /Type /Catalog /Pages 2 0 R {layers} >>", 6: "<< /Type /Font /Subtype /Type1 /BaseFont /Made /Encoding /WinAnsiEncoding >>",
        12: ("/Type /XObject /Subtype /Form /BBox [0 0 9 9] /OC 21 0 R", b"BT /F1 10 Tf (w) Tj ET"), 20: "<< /Type /OCG /Name (a) >>", 21: "<< /Type /OCG /Name (b) >>", 22: "<< /Type /OCMD /OCGs [21 0 R] >>",
    })


def file_visible_text(spark: SparkSession, folder: str) -> DataFrame:
    """FIL-11: glyphs with and without those of layers that do not show."""
    files = _made(spark, folder, layered_file, "p_partkey", "p_name")
    run = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "unicode"))), lambda g: g["unicode"]), "").alias("text")
    every = T.glyphs(files).groupBy("path").agg(run).withColumn("shown", F.lit(False))
    shown = T.glyphs(files, visible_only=True).groupBy("path").agg(run).withColumn("shown", F.lit(True))
    return every.unionByName(shown).select(F.col("path").cast("bigint").alias("p_partkey"), "shown", "text")


def outer_file(key: int, name: str) -> bytes:
    """A file that holds another, which holds a third; and one that is no PDF."""

    def one(text: str, inner: bytes | None) -> bytes:
        objects = {
            1: "<< /Type /Catalog /Pages 2 0 R >>", 2: "<< /Type /Pages /Kids [3 0 R] /Count 1 >>", 3: "<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Contents 4 0 R /Resources << /Font << /F1 6 0 R >> >> >>",
            4: ("", f"BT /F1 10 Tf 50 700 Td ({text}) Tj ET".encode()), 6: f"<< /Type /Font /Subtype /Type1 /BaseFont /Made /FirstChar 32 /LastChar 126 /Widths [{' 500' * 95}] /Encoding /WinAnsiEncoding >>",
        }
        if inner is not None:
            objects |= {1: "<< /Type /Catalog /Pages 2 0 R /Names << /EmbeddedFiles << /Names [(in) 7 0 R (note) 9 0 R] >> >> >>", 7: "<< /F (in.pdf) /EF << /F 8 0 R >> >>", 8: ("/Type /EmbeddedFile", inner),
                        9: "<< /F (note.txt) /EF << /F 10 0 R >> >>", 10: ("/Type /EmbeddedFile", b"no file of this kind")}
        return assembled(objects)

    return one(f"outer{key}", one("middle", one(f"inner{key}", None)))


def file_embedded_text(spark: SparkSession, folder: str) -> DataFrame:
    """EXT-09: texts of files with those of the files embedded in them."""
    rows = T.text_with_embedded(_made(spark, folder, outer_file, "p_partkey", "p_name"))
    return rows.select(F.col("path").cast("bigint").alias("p_partkey"), F.regexp_replace("text", r"\s+", " ").alias("text"))


def _edited(key: int, name: str, brand: str, size: int) -> list[bytes]:
    """A file merged with itself, without its second page, with another address, and without text."""
    data = part_file(key, name, brand, size)
    return [pdf_edit.merge_files([data, data]), pdf_edit.without_pages(data, [2]), pdf_edit.with_urls(data, {f"http://l.invalid/{key}": "http://new.invalid/", f"http://x.invalid/{key}": "http://n.invalid/"}), pdf_edit.without_text(articles_file(key, name))]


def _edits(spark: SparkSession, folder: str) -> DataFrame:
    def edits(key: int, *row) -> list[tuple[str, bytes]]:
        return [(f"{key}/{way}", data) for way, data in zip(("merged", "shorter", "urls", "textless"), _edited(key, *row))]

    return T.made(spread(table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_size")), edits)


def _by_way() -> list[Column]:
    return [F.substring_index("path", "/", 1).cast("bigint").alias("p_partkey"), F.substring_index("path", "/", -1).alias("way")]


def file_edits(spark: SparkSession, folder: str) -> DataFrame:
    """MPD-01, MPD-07: pages, glyphs and links of files that were merged, shortened, given other addresses, and rid of text."""
    rows = T.together(_edits(spark, folder), page=(T.pages, ["page_no"]), glyph=(T.glyphs, ["seq"]), link=(T.annotations, ["uri"]))
    of = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    found = rows.groupBy("path").agg(of("page").alias("pages"), of("glyph").alias("glyphs"), F.max("link.uri").alias("uri"), F.count("link.uri").alias("links"))
    return found.where("pages > 0").select(*_by_way(), "pages", "glyphs", "uri", "links")


def file_edited_bookmarks(spark: SparkSession, folder: str) -> DataFrame:
    """MPD-01: bookmarks of merged and shortened files."""
    return T.outline(_edits(spark, folder)).select(*_by_way(), "item_no", "level", "title", "page_no", "uri")


def file_operators(spark: SparkSession, folder: str) -> DataFrame:
    """How often each operator of graphics stands in the files."""
    return T.ops(_made(spark, folder, graphics_file, "p_partkey", "p_size")).groupBy("op").agg(F.count("*").alias("uses"))


_USES = {
    "q": 2, "Q": 2, "cm": 2, "w": 1, "J": 1, "j": 1, "M": 1, "d": 1, "i": 1, "ri": 1, "rg": 1, "G": 1, "re": 9, "f": 2, "m": 5, "l": 6, "h": 1, "S": 3, "c": 2, "v": 1, "y": 1, "s": 1, "cs": 2, "sc": 1, "F": 1,
    "CS": 2, "SC": 1, "f*": 1, "scn": 1, "B": 1, "SCN": 1, "B*": 1, "g": 1, "K": 1, "b": 1, "k": 1, "RG": 1, "b*": 1, "gs": 1, "W": 1, "W*": 1, "n": 2, "sh": 1, "Do": 2, "BI": 1,
}

# calculator -----------------------------------------------------------------

#: Programs over x and y, and the same in SQL; each tells its operators by itself.
PROGRAMS: dict[str, tuple[str, str]] = {
    "arithmetic": ("{ abs exch neg add 2 div 0.5 sub 3 mul sqrt }", "sqrt((abs(y) - x) / 2 * 3 - 1.5)"),
    "parts": ("{ pop dup ceiling exch dup floor exch dup round exch truncate add add add }", "ceil(x) + floor(x) + floor(x + 0.5) + trunc(x)"),
    "whole": ("{ cvi exch cvi 7 add dup 3 idiv exch 5 mod add exch -2 bitshift add }", "((cast(trunc(x) as bigint) + 7) // 3) + ((cast(trunc(x) as bigint) + 7) % 5) + (cast(trunc(y) as bigint) >> 2)"),
    "angles": ("{ 1 add exch 1 add exch 2 copy atan 3 1 roll sin exch cos add add }", "degrees(atan2(x + 1, y + 1)) + sin(radians(y + 1)) + cos(radians(x + 1))"),
    "powers": ("{ exch 1 add dup ln exch log add exch 1 add 0.5 exp add cvr }", "ln(x + 1) + log10(x + 1) + power(y + 1, 0.5)"),
    "choices": (
        "{ 2 copy gt { exch } if dup 10 ge { 1 } { 2 } ifelse exch pop exch 1 index sub add }",
        "case when greatest(x, y) >= 10 then 1 else 2 end + (least(x, y) - case when greatest(x, y) >= 10 then 1 else 2 end)",
    ),
    "truths": (
        "{ cvi 7 mod exch cvi exch 2 copy eq 3 1 roll 2 copy ne 3 1 roll 2 copy lt 3 1 roll le and or not true false xor and { 5 } { 6 } ifelse exch { 10 add } if }",
        "case when x = trunc(y) % 7 then 15 else 6 end",
    ),
}


def calc_operators(spark: SparkSession, folder: str) -> DataFrame:
    """FN-4: all operators of calculator functions, over quantities and line numbers."""
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").cast("double").alias("x"), (F.col("l_quantity") + 20).alias("y"))

    def value(program: str) -> Column:
        return F.round(calculator_columns(program, [-1e9, 1e9, -1e9, 1e9], [-1e9, 1e9], F.col("x"), F.col("y"))[0], 4)

    return rows.select("l_orderkey", "l_linenumber", *(value(program).alias(name) for name, (program, _) in PROGRAMS.items()))


SQL: dict[str, str] = {
    "file_encodings": "select p_partkey, n as page_no, said as text from part, (values " + ", ".join(f"({i}, '{said}')" for i, (_, _, said) in enumerate(_FONTS, 1)) + ") t(n, said)",
    "file_filters": "select p_partkey, name, case when name = 'runs' then p_name || 'zzzz' when name like 'png%' or name = 'tiff' then substr(rpad(p_name, 24, '.'), 1, 24) else p_name end as content "
    "from part, (values ('a85'), ('chain'), ('flate'), ('hex'), ('png0'), ('png1'), ('png2'), ('png3'), ('png4'), ('runs'), ('tiff')) t(name)",
    "file_articles": """select p_partkey, way, case way when 'articles' then 'right0 right1 right2left0 ' || p_partkey || ' left1 ' || p_partkey || ' left2 ' || p_partkey
  else 'left0 ' || p_partkey || ' right0 left1 ' || p_partkey || ' right1 left2 ' || p_partkey || ' right2' end as text from part, (values ('articles'), ('lines')) t(way)""",
    "file_paths": "select p_partkey, way, 'ok' as status, 1 as page_count from part, (values ('folder'), ('list')) t(way)",
    "file_edits": """select p_partkey, way, cast(case way when 'merged' then 6 when 'shorter' then 2 when 'urls' then 3 else 1 end as bigint) as pages, cast(0 as bigint) as glyphs,
  case when way = 'urls' then 'http://new.invalid/' when way <> 'textless' then 'http://l.invalid/' || p_partkey end as uri, cast(case way when 'merged' then 2 when 'textless' then 0 else 1 end as bigint) as links
from part, (values ('merged'), ('shorter'), ('urls'), ('textless')) t(way)""",
    "file_edited_bookmarks": """select p_partkey, way, n as item_no, level, case k when 1 then p_name when 2 then 'in ' || p_brand else 'web' end as title, page as page_no,
  case when k = 3 then case when way = 'urls' then 'http://n.invalid/' else 'http://x.invalid/' || p_partkey end end as uri
from part, (values ('merged', 1, 1, 1, 1), ('merged', 2, 2, 2, 2), ('merged', 3, 1, 3, null), ('merged', 4, 1, 1, 4), ('merged', 5, 2, 2, 5), ('merged', 6, 1, 3, null),
  ('shorter', 1, 1, 1, 1), ('shorter', 2, 1, 3, null), ('urls', 1, 1, 1, 1), ('urls', 2, 2, 2, 2), ('urls', 3, 1, 3, null)) t(way, n, level, k, page)""",
    "file_visible_text": "select p_partkey, false as shown, substr(p_name, 1, 1) || 'xyzkw' as text from part union all select p_partkey, true, substr(p_name, 1, 1) || 'k' from part",
    "file_embedded_text": "select p_partkey, 'outer' || p_partkey || ' middle inner' || p_partkey as text from part",
    "file_operators": "select op, cast(n * (select count(*) from part) as bigint) as uses from (values " + ", ".join(f"('{op}', {n})" for op, n in _USES.items()) + ") t(op, n)",
    "file_graphics": _painted_sql(),
    "file_text_state": _text_sql(),
    "calc_operators": "select l_orderkey, l_linenumber, "
    + ", ".join(f"round(cast({sql} as double), 4) as {name}" for name, (_, sql) in PROGRAMS.items())
    + " from (select *, l_linenumber::double as x, l_quantity + 20 as y from lineitem)",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (file_graphics, file_text_state, file_encodings, file_filters, file_articles, file_paths, file_visible_text, file_embedded_text, file_edits, file_edited_bookmarks, file_operators, calc_operators)}
