"""Queries over what PDF files hold besides text: bookmarks, annotations, forms, attachments and the like.

The tables hold no such files, so one is put together for each part, object by
object as the format's rules have it and not by the package's writer, and read
again; the SQL tells what was put in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.markup import xmp_table
from paperloom.session import durable, spread, table
from paperloom.sources import pdf_tables as T


def assembled(objects: dict[int, str | tuple[str, bytes]], trailer: str = "") -> bytes:
    """A file with a classic table of objects. An object is its text, or the entries of a stream's dictionary and its bytes."""
    out, places = b"%PDF-1.6\n%\xe2\xe3\xcf\xd3\n", {}
    for number, value in objects.items():
        places[number] = len(out)
        if isinstance(value, str):
            body = value.encode("latin-1")
        else:
            body = f"<< {value[0]} /Length {len(value[1])} >>\nstream\r\n".encode("latin-1") + value[1] + b"\nendstream"
        out += f"{number} 0 obj\n".encode() + body + b"\nendobj\n"
    at, size = len(out), max(places) + 1
    rows = "".join(f"{places[n]:010d} 00000 n \n" if n in places else "0000000000 65535 f \n" for n in range(size))
    return out + f"xref\n0 {size}\n{rows}trailer\n<< /Size {size} /Root 1 0 R {trailer} >>\nstartxref\n{at}\n%%EOF\n".encode("latin-1")


def literal(text: str) -> str:
    return "(" + text.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)") + ")"


def wide(text: str) -> str:
    """A string object in UTF-16."""
    return "<FEFF" + text.encode("utf-16-be").hex().upper() + ">"


def part_file(key: int, name: str, brand: str, size: int) -> bytes:
    """A file of three pages with one of everything."""
    packet = f'<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description rdf:about="" xmlns:xmp="http://ns.adobe.com/xap/1.0/" xmp:Label="{key}"><xmp:CreatorTool>{brand}</xmp:CreatorTool></rdf:Description></rdf:RDF></x:xmpmeta>'
    objects: dict[int, str | tuple[str, bytes]] = {
        1: "<< /Type /Catalog /Pages 2 0 R /Outlines 10 0 R /Names << /Dests 20 0 R /EmbeddedFiles << /Names [(a.txt) 22 0 R] >> >> /Dests << /old [4 0 R /XYZ 1 2.5 null] >> "
        "/PageLabels << /Nums [0 << /S /r >> 2 << /S /D /P (p-) /St 5 >>] >> /AcroForm << /Fields [30 0 R 33 0 R 34 0 R 35 0 R] >> /ViewerPreferences << /HideToolbar true /Direction /R2L >> "
        "/OpenAction 40 0 R /Metadata 41 0 R /OCProperties << /OCGs [42 0 R 43 0 R] /D << /OFF [43 0 R] >> >> /StructTreeRoot 50 0 R /Threads [55 0 R] /Lang (en-GB) /PageMode /UseOutlines "
        "/PageLayout /SinglePage /MarkInfo << /Marked true >> /OutputIntents [<< /S /GTS_PDFA1 /OutputConditionIdentifier (sRGB) >>] /URI << /Base (http://b.invalid/) >> >>",
        2: f"<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 3 /MediaBox [0 0 {600 + size} 792] /Rotate 90 >>",
        3: "<< /Type /Pages /Parent 2 0 R /Kids [5 0 R 6 0 R] /Count 2 /MediaBox [0 0 300 400] >>",
        4: "<< /Type /Page /Parent 2 0 R /CropBox [10 10 200 300] /UserUnit 2 >>",
        5: "<< /Type /Page /Parent 3 0 R /Annots [60 0 R 61 0 R 62 0 R] /B [56 0 R] >>",
        6: f"<< /Type /Page /Parent 3 0 R /MediaBox [{105 + size} 205 5 5] /Rotate 0 /B [57 0 R] >>",
        10: "<< /Type /Outlines /First 11 0 R /Last 13 0 R /Count 2 >>",
        11: f"<< /Title {literal(name)} /Parent 10 0 R /Next 13 0 R /First 12 0 R /Last 12 0 R /Count -1 /Dest [5 0 R /Fit] >>",
        12: f"<< /Title {wide('in ' + brand)} /Parent 11 0 R /A << /S /GoTo /D (second) >> >>",
        13: f"<< /Title (web) /Parent 10 0 R /Prev 11 0 R /A << /S /URI /URI (http://x.invalid/{key}) >> >>",
        20: "<< /Kids [21 0 R] >>",
        21: f"<< /Limits [(second) (third)] /Names [(second) << /D [6 0 R /FitH {size}] >> (third) [4 0 R /Fit]] >>",
        22: f"<< /Type /Filespec /F (a.txt) /UF {wide('ä.txt')} /Desc {literal(brand)} /EF << /F 23 0 R >> >>",
        23: ("/Type /EmbeddedFile /Subtype /text#2Fplain", name.encode()),
        30: f"<< /T (person) /Kids [31 0 R 32 0 R] /FT /Tx /Ff 2 >>",
        31: f"<< /T (name) /Parent 30 0 R /V {literal(name)} >>",
        32: f"<< /T (note) /Parent 30 0 R /V {wide('é ' + brand)} /Ff 4096 >>",
        33: f"<< /T (agree) /FT /Btn /V /{'Yes' if size % 2 else 'Off'} >>",
        34: f"<< /T (choice) /FT /Ch /Ff 131072 /V (o{size}) /Opt [(o1) (o2)] >>",
        35: "<< /T (signed) /FT /Sig /V 36 0 R >>",
        36: f"<< /Type /Sig /Filter /Adobe.PPKLite /SubFilter /adbe.pkcs7.detached /Name {literal(brand)} /Reason (checked) /Location (here) /ByteRange [0 10 20 {size}] /Contents <00> >>",
        40: "<< /Type /Action /S /JavaScript /JS (app.beep) /Next << /S /Named /N /NextPage >> >>",
        41: ("/Type /Metadata /Subtype /XML", packet.encode()),
        42: f"<< /Type /OCG /Name {literal(brand)} >>",
        43: "<< /Type /OCG /Name (hidden) >>",
        50: "<< /Type /StructTreeRoot /K [51 0 R] >>",
        51: f"<< /S /Document /P 50 0 R /T {literal(name)} /K [52 0 R 53 0 R] >>",
        52: "<< /S /P /P 51 0 R /Pg 5 0 R /K 0 >>",
        53: f"<< /S /Figure /P 51 0 R /Pg 6 0 R /Alt {literal(brand)} >>",
        55: f"<< /F 56 0 R /I << /Title {literal(brand)} >> >>",
        56: f"<< /T 55 0 R /P 5 0 R /R [1 2 {10 + size} 20] /N 57 0 R /V 57 0 R >>",
        57: "<< /P 6 0 R /R [3 4 30 40] /N 56 0 R /V 56 0 R >>",
        60: f"<< /Type /Annot /Subtype /Link /Rect [{size} 20 10 10] /A << /S /URI /URI (http://l.invalid/{key}) >> >>",
        61: f"<< /Type /Annot /Subtype /Text /Rect [0 0 5 5] /Contents {wide('ж ' + name)} /NM (n{key}) /F 4 >>",
        62: "<< /Type /Annot /Subtype /Link /Rect [1 1 2 2] /Dest /old >>",
        70: ("/Type /XObject /Subtype /Image /Width 2 /Height 1 /BitsPerComponent 8 /ColorSpace [/ICCBased 71 0 R]", bytes([size, 255 - size])),
        71: ("/N 1", b"icc"),
        80: f"<< /Title {literal(name)} /Author {wide('ü ' + brand)} /CreationDate (D:20240203040506+01'00') /Trapped /False /Part ({key}) >>",
        81: "<< /Type /FontDescriptor /FontName /Made /Flags 4 /FontFile2 82 0 R >>",
        82: ("/Length1 4", b"true"),
        83: "<< /Type /Font /Subtype /TrueType /BaseFont /Made /Encoding /WinAnsiEncoding /FontDescriptor 81 0 R >>",
    }
    return assembled(objects, "/Info 80 0 R")


def form_file(key: int, name: str) -> bytes:
    """A form data file with nested fields."""
    return assembled({1: "<< /FDF << /Fields [2 0 R << /T (last) /V /On >>] >> >>", 2: f"<< /T (a) /Kids [<< /T (b) /V {wide(name)} >> << /T (c) /Kids [<< /T (d) /V {key} >>] >> << /T (e) >>] >>"}).replace(b"%PDF-1.6", b"%FDF-1.2")


def _made(spark: SparkSession, folder: str, make: Callable[..., bytes], *columns: str) -> DataFrame:
    return T.made(spread(table(spark, folder, "part").select(*columns)), lambda *row: [(str(row[0]), make(*row))])


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return _made(spark, folder, part_file, "p_partkey", "p_name", "p_brand", "p_size")


def _keyed(rows: DataFrame, *columns) -> DataFrame:
    return rows.select(F.col("path").cast("bigint").alias("p_partkey"), *columns)


def _corners(box: str) -> list:
    return [F.col(f"{box}.{c}").cast("double").alias(f"{box}_{c}") for c in ("x0", "y0", "x1", "y1")]


def file_bookmarks(spark: SparkSession, folder: str) -> DataFrame:
    """EXT-01: bookmarks with depth, page and address."""
    return _keyed(T.outline(_files(spark, folder)), "item_no", "level", "title", "page_no", "count", "uri")


def file_destinations(spark: SparkSession, folder: str) -> DataFrame:
    """EXT-02: named destinations of both kinds."""
    return _keyed(T.destinations(_files(spark, folder)), "name", "page_no", "kind", F.array_join(F.transform("arguments", lambda v: F.coalesce(v.cast("decimal(9,1)").cast("string"), F.lit("-"))), " ").alias("arguments"))


def file_annotations(spark: SparkSession, folder: str) -> DataFrame:
    """EXT-03: annotations with rectangle, text and target."""
    return _keyed(T.annotations(_files(spark, folder)), "page_no", "annotation_no", "subtype", *_corners("rect"), "contents", "name", "flags", "action", "uri", "dest_page")


def file_actions(spark: SparkSession, folder: str) -> DataFrame:
    """EXT-05: actions with those that follow them."""
    return _keyed(T.actions(_files(spark, folder)).where("trigger = '40' or trigger like '1.%' or trigger like '1_.%' or trigger like '6_.%'"), "trigger", "type", "target").distinct()


def file_fields(spark: SparkSession, folder: str) -> DataFrame:
    """EXT-06: form fields with what they inherit."""
    return _keyed(T.fields(_files(spark, folder)).where("full_name <> 'signed'"), "full_name", "kind", "value", "flags")


def file_images(spark: SparkSession, folder: str) -> DataFrame:
    """EXT-08: image objects."""
    return _keyed(T.images(_files(spark, folder)), "obj_num", "width", "height", "bits", "color_space", "suffix", F.hex("content").alias("content"))


def file_attachments(spark: SparkSession, folder: str) -> DataFrame:
    """EXT-09: embedded files."""
    return _keyed(T.attachments(_files(spark, folder)), "name", "description", "subtype", F.decode("content", "utf-8").alias("content"))


def file_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """EXT-10, EXT-11: properties of metadata packets."""
    rows = xmp_table(T.metadata(_files(spark, folder)))
    return _keyed(rows, "namespace", F.col("name").alias("property"), "value").where("property in ('Label', 'CreatorTool')")


def file_structure(spark: SparkSession, folder: str) -> DataFrame:
    """EXT-14: the structure tree."""
    return _keyed(T.structure(_files(spark, folder)), "node_no", "parent_no", "level", "type", "title", "alt", "page_no")


def file_layers(spark: SparkSession, folder: str) -> DataFrame:
    """EXT-15: layers and whether they show."""
    return _keyed(T.layers(_files(spark, folder)), "layer_no", "name", "visible")


def file_signatures(spark: SparkSession, folder: str) -> DataFrame:
    """EXT-12: what signatures tell."""
    return _keyed(T.signatures(_files(spark, folder)), "field", "filter", "sub_filter", "signer", "reason", "location", F.array_join(F.col("byte_range").cast("array<string>"), " ").alias("byte_range"), "covers_file")


def file_beads(spark: SparkSession, folder: str) -> DataFrame:
    """Beads of article threads."""
    return _keyed(T.beads(_files(spark, folder)), "thread_no", "bead_no", "title", "page_no", *_corners("rect"))


def file_preferences(spark: SparkSession, folder: str) -> DataFrame:
    """EXT-17: what files ask of viewers."""
    return _keyed(T.viewer_preferences(_files(spark, folder)), F.col("preferences")["HideToolbar"].alias("hide_toolbar"), F.col("preferences")["Direction"].alias("direction"))


def file_catalogs(spark: SparkSession, folder: str) -> DataFrame:
    """PRJ-04: what catalogues tell."""
    return _keyed(T.catalogs(_files(spark, folder)), "language", "page_mode", "page_layout", "base_uri", "marked", F.array_join("output_intents", ",").alias("output_intents"))


def file_info(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-24, PRJ-01: info entries of documents."""
    return _keyed(T.documents(_files(spark, folder)), "status", "page_count", "title", "author", "created_at", "trapped", F.col("custom")["Part"].alias("part"))


def file_pages(spark: SparkSession, folder: str) -> DataFrame:
    """PRJ-03, SRC-17: boxes and rotation inherited through the page tree, and labels."""
    return _keyed(T.pages(_files(spark, folder)), "page_no", "obj_num", *_corners("media_box"), *_corners("crop_box"), "rotation", F.col("user_unit").cast("double").alias("user_unit"), "label", "n_annotations")


def file_fonts(spark: SparkSession, folder: str) -> DataFrame:
    """PRJ-02: font dictionaries."""
    return _keyed(T.fonts(_files(spark, folder)), "font_name", "subtype", "encoding", "embedded", "has_unicode_map")


def file_font_programs(spark: SparkSession, folder: str) -> DataFrame:
    """EXT-10: embedded font programs."""
    return _keyed(T.font_files(_files(spark, folder)), "font_name", "kind", F.decode("content", "utf-8").alias("content"))


def file_form_data(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-06: fields of form data files."""
    return _keyed(T.fdf_fields(_made(spark, folder, form_file, "p_partkey", "p_name")), "full_name", "value")


def file_object_types(spark: SparkSession, folder: str) -> DataFrame:
    """Numbered objects by type, with the bytes of their streams."""
    rows = T.objects(_files(spark, folder), columns=["type", "raw_len", "decoded_len"]).groupBy("type").agg(F.count("*").alias("objects"), F.count("raw_len").alias("streams"), F.sum("decoded_len").alias("size"))
    return rows.where("type in ('Page', 'Pages', 'OCG', 'EmbeddedFile', 'Annot')")


def file_between_bookmarks(spark: SparkSession, folder: str) -> DataFrame:
    """FIL-02: pages from one bookmark to another."""
    rows = T.together(_files(spark, folder), page=(T.pages, ["page_no"]), mark=(T.outline, ["level", "title", "page_no"]))
    rows = durable(rows.select("path", "kind", "mark.level", "mark.title", F.coalesce("page.page_no", "mark.page_no").alias("page_no")))
    pages, marks = (rows.where(F.col("kind") == kind).drop("kind") for kind in ("page", "mark"))
    second = marks.withColumn("title", F.when(F.col("level") == 2, F.lit("second")).otherwise(F.col("title")))
    return _keyed(T.between_bookmarks(pages.select("path", "page_no"), marks, None, "web"), "page_no").unionByName(_keyed(T.between_bookmarks(pages.select("path", "page_no"), second, "second"), "page_no"))


def _rows(*cases: str) -> str:
    return " union all ".join(f"select p_partkey, {c} from part" for c in cases)


_N, _S, _D = "null::varchar", "null::integer", "::double"
SQL: dict[str, str] = {
    "file_bookmarks": _rows(
        f"1 as item_no, 1 as level, p_name as title, 1 as page_no, -1 as count, {_N} as uri",
        f"2, 2, 'in ' || p_brand, 2, 0, {_N}",
        f"3, 1, 'web', {_S}, 0, 'http://x.invalid/' || p_partkey",
    ),
    "file_destinations": _rows("'old' as name, 3 as page_no, 'XYZ' as kind, '1.0 2.5 -' as arguments", "'second', 2, 'FitH', p_size || '.0'", "'third', 3, 'Fit', ''"),
    "file_annotations": _rows(
        f"1 as page_no, 0 as annotation_no, 'Link' as subtype, least(p_size, 10){_D} as rect_x0, 10{_D} as rect_y0, greatest(p_size, 10){_D} as rect_x1, 20{_D} as rect_y1, {_N} as contents, {_N} as name, 0 as flags, 'URI' as action, 'http://l.invalid/' || p_partkey as uri, {_S} as dest_page",
        f"1, 1, 'Text', 0{_D}, 0{_D}, 5{_D}, 5{_D}, 'ж ' || p_name, 'n' || p_partkey, 4, {_N}, {_N}, {_S}",
        f"1, 2, 'Link', 1{_D}, 1{_D}, 2{_D}, 2{_D}, {_N}, {_N}, 0, {_N}, {_N}, 3",
    ),
    "file_actions": _rows(
        "'1.OpenAction' as trigger, 'JavaScript' as type, 'app.beep' as target", "'1.OpenAction', 'Named', 'NextPage'", "'40', 'JavaScript', 'app.beep'", "'40', 'Named', 'NextPage'",
        "'12.A', 'GoTo', 'second'", "'13.A', 'URI', 'http://x.invalid/' || p_partkey", "'60.A', 'URI', 'http://l.invalid/' || p_partkey",
    ),
    "file_fields": _rows(
        "'person.name' as full_name, 'text' as kind, p_name as value, 2 as flags", "'person.note', 'text', 'é ' || p_brand, 4096",
        "'agree', 'checkbox', case when p_size % 2 = 1 then 'Yes' else 'Off' end, 0", "'choice', 'combo', 'o' || p_size, 131072",
    ),
    "file_images": _rows("70 as obj_num, 2 as width, 1 as height, 8 as bits, 'ICCBased' as color_space, 'png' as suffix, printf('%02X%02X', p_size, 255 - p_size) as content"),
    "file_attachments": _rows("'ä.txt' as name, p_brand as description, 'text/plain' as subtype, p_name as content"),
    "file_metadata": _rows("'http://ns.adobe.com/xap/1.0/' as namespace, 'Label' as property, p_partkey::varchar as value", "'http://ns.adobe.com/xap/1.0/', 'CreatorTool', p_brand"),
    "file_structure": _rows(
        f"1 as node_no, {_S} as parent_no, 0 as level, 'Document' as type, p_name as title, {_N} as alt, {_S} as page_no", f"2, 1, 1, 'P', {_N}, {_N}, 1", f"3, 1, 1, 'Figure', {_N}, p_brand, 2",
    ),
    "file_layers": _rows("0 as layer_no, p_brand as name, true as visible", "1, 'hidden', false"),
    "file_signatures": _rows("'signed' as field, 'Adobe.PPKLite' as filter, 'adbe.pkcs7.detached' as sub_filter, p_brand as signer, 'checked' as reason, 'here' as location, '0 10 20 ' || p_size as byte_range, false as covers_file"),
    "file_beads": _rows(
        f"0 as thread_no, 0 as bead_no, p_brand as title, 1 as page_no, 1{_D} as rect_x0, 2{_D} as rect_y0, (10 + p_size){_D} as rect_x1, 20{_D} as rect_y1", f"0, 1, p_brand, 2, 3{_D}, 4{_D}, 30{_D}, 40{_D}",
    ),
    "file_preferences": _rows("'true' as hide_toolbar, '\"/R2L\"' as direction"),
    "file_catalogs": _rows("'en-GB' as language, 'UseOutlines' as page_mode, 'SinglePage' as page_layout, 'http://b.invalid/' as base_uri, true as marked, 'sRGB' as output_intents"),
    "file_info": _rows("'ok' as status, 3 as page_count, p_name as title, 'ü ' || p_brand as author, '2024-02-03T04:05:06+01:00' as created_at, 'False' as trapped, p_partkey::varchar as part"),
    "file_pages": _rows(
        f"1 as page_no, 5 as obj_num, 0{_D} as media_box_x0, 0{_D} as media_box_y0, 300{_D} as media_box_x1, 400{_D} as media_box_y1, 0{_D} as crop_box_x0, 0{_D} as crop_box_y0, 300{_D} as crop_box_x1, 400{_D} as crop_box_y1, 90 as rotation, 1{_D} as user_unit, 'i' as label, 3 as n_annotations",
        f"2, 6, 5{_D}, 5{_D}, (105 + p_size){_D}, 205{_D}, 5{_D}, 5{_D}, (105 + p_size){_D}, 205{_D}, 0, 1{_D}, 'ii', 0",
        f"3, 4, 0{_D}, 0{_D}, (600 + p_size){_D}, 792{_D}, 10{_D}, 10{_D}, 200{_D}, 300{_D}, 90, 2{_D}, 'p-5', 0",
    ),
    "file_fonts": _rows("'Made' as font_name, 'TrueType' as subtype, 'WinAnsiEncoding' as encoding, true as embedded, false as has_unicode_map"),
    "file_font_programs": _rows("'Made' as font_name, 'truetype' as kind, 'true' as content"),
    "file_form_data": _rows("'a.b' as full_name, p_name as value", "'a.c.d', p_partkey::varchar", f"'a.e', {_N}", "'last', 'On'"),
    "file_object_types": """select type, cast(count(*) * n as bigint) as objects, cast(case when type = 'EmbeddedFile' then count(*) else 0 end as bigint) as streams, cast(case when type = 'EmbeddedFile' then sum(strlen(p_name)) end as bigint) as size
from part, (values ('Page', 3), ('Pages', 2), ('OCG', 2), ('EmbeddedFile', 1), ('Annot', 3)) t(type, n) group by type, n""",
    "file_between_bookmarks": _rows("2 as page_no", "3"),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        file_bookmarks, file_destinations, file_annotations, file_actions, file_fields, file_images, file_attachments, file_metadata, file_structure, file_layers, file_signatures, file_beads,
        file_preferences, file_catalogs, file_info, file_pages, file_fonts, file_font_programs, file_form_data, file_object_types, file_between_bookmarks,
    )
}
