import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.functions import stream_filters as S
from paperloom.functions.calculator import ProgramError, applied, calculator, exponential, parse_program, run_program, sampled, stitching
from paperloom.functions.markup import fields_to_xfdf, xfdf_to_fields, xmp_properties
from paperloom.functions.scalars import html_escaped, letter_label, letters, markdown_escaped, page_labels, parse_date, parsed_date, roman, roman_label

CASES = [b"", b"a", b"\0" * 3000, b"abc" * 999, bytes(range(256)) * 40, bytes(random.Random(1).randbytes(20_000)), b"<z~!"]


@pytest.mark.parametrize("name", ["Fl", "LZW", "AHx", "A85", "RL"])
@pytest.mark.parametrize("data", CASES)
def test_filters_round_trip(name, data):
    assert S.decode(S.encode(data, name), name) == data


def test_tolerant_decoding():
    packed = S.flate_encode(b"hello " * 500)
    assert S.flate_decode(packed[:-6]).startswith(b"hello hello")
    assert S.flate_decode(packed[2:]) == b"hello " * 500
    assert S.ascii_hex_decode(b"4 8x6>zz") == b"H`" and S.ascii85_decode(b" <~87cURDZ~>") == b"Hello"
    assert S.run_length_decode(b"\x02abc\xfe") == b"abc"
    with pytest.raises(ValueError):
        S.decode(b"", "Nothing")


def test_predictors():
    rows = np.array([[1, 2, 3], [4, 6, 8]], np.uint8)
    assert S.undo_predictor(np.diff(rows, axis=1, prepend=0).astype(np.uint8).tobytes(), 2, columns=3) == rows.tobytes()
    assert S.undo_predictor(b"\0\1\2\3\2\3\4\5", 12, columns=3) == bytes([1, 2, 3, 4, 6, 8])
    assert S.undo_predictor(b"\1\1\1\1", 11, columns=3) == bytes([1, 2, 3])
    assert S.undo_predictor(b"\3\2\2\2\4\1\1\1", 15, columns=3) == bytes([2, 3, 3, 3, 4, 5])
    assert S.undo_predictor(b"\x50", 2, bits=4, columns=2) == b"\x55"
    assert S.undo_predictor(b"\0\1\0\2", 2, bits=16, columns=2) == b"\0\1\0\3"


@pytest.mark.parametrize(
    ("program", "stack", "want"),
    [("add", [2, 3], [5]), ("sub", [5.0, 3], [2.0]), ("idiv", [-7, 2], [-3]), ("mod", [-5, 3], [-2]), ("atan", [0, -1], [180.0]), ("round", [6.5], [7.0]), ("round", [-6.5], [-6.0]), ("truncate", [-3.7], [-3.0]),
     ("3 1 roll", ["a", "b", "c"], ["c", "a", "b"]), ("2 copy", [1, 2], [1, 2, 1, 2]), ("1 index", [7, 8], [7, 8, 7]), ("dup gt", [1], [False]), ("true { 1 } { 2 } ifelse", [], [1]), ("false { 1 } if", [], []),
     ("-2 bitshift", [8], [2]), ("xor", [True, False], [True]), ("and", [6, 3], [2]), ("not", [5], [-6]), ("% c\n neg", [1], [-1]), ("cvi", [-47.8], [-47]), ("exch pop", [1, 2], [2]), ("0 copy", [1], [1])],
)
def test_calculator(program, stack, want):
    assert run_program(parse_program(program), list(stack)) == want


@pytest.mark.parametrize("program", ["add", "1 0 idiv", "{", "}", "nothing", "-1 sqrt", "5 index"])
def test_broken_programs(program):
    with pytest.raises(ProgramError):
        run_program(parse_program(program), [])


def test_functions():
    assert exponential([0.0, 1.0], [1.0, 0.0], 2)(0.5) == [0.25, 0.75]
    f = stitching([lambda x: [x], lambda x: [10 + x]], [0.5], [0, 1, 1, 0], [0, 1])
    assert [f(x)[0] for x in (0, 0.25, 0.5, 1, 2)] == [0, 0.5, 11, 10, 10]
    g = sampled(np.arange(4.0).reshape(2, 2, 1), [0, 1, 0, 1], [0, 255])
    assert g(0, 0) == [0] and g(1, 1) == [3] and g(0.5, 0.5) == [1.5] and g(9, -9) == [2]
    assert calculator("{ 2 mul exch }", [0, 1, 0, 1], [0, 5, 0, 5])(0.5, 3) == [2.0, 0.5]


def test_applied_to_columns(spark):
    rows = spark.createDataFrame([(4.0,), (-1.0,), (None,)], "x double")
    got = [r[0] for r in rows.select(applied(calculator("{ sqrt }", [-9, 9], [0, 9]), F.col("x"))).collect()]
    assert got == [[2.0], None, None]


@pytest.mark.parametrize(
    ("text", "want"),
    [("D:20240229123456+02'30'", "2024-02-29T12:34:56+02:30"), ("D:2023", "2023-01-01T00:00:00"), ("20230405Z", "2023-04-05T00:00:00Z"), ("2001-02-03T04:05:06-07:00", "2001-02-03T04:05:06-07:00"), ("D:20230229", None), ("soon", None), ("", None)],
)
def test_dates(text, want):
    assert parse_date(text) == want


def test_date_column(spark):
    rows = spark.createDataFrame([("D:20240229123456+02'30'",), ("D:2023",), ("x",), (None,), ("D:20231301",)], "t string")
    got = [r[0] for r in rows.select(parsed_date(F.col("t"))).collect()]
    assert got == [datetime.datetime(2024, 2, 29, 10, 4, 56), datetime.datetime(2023, 1, 1), None, None, None]


def test_labels(spark):
    assert [roman(n) for n in (1, 4, 9, 14, 40, 90, 400, 900, 1999, 4000)] == "i iv ix xiv xl xc cd cm mcmxcix mmmm".split()
    assert [letters(n) for n in (1, 26, 27, 53)] == ["a", "z", "aa", "aaa"]
    numbers = list(range(1, 1200, 7))
    rows = spark.createDataFrame([(n,) for n in numbers], "n bigint").select(roman_label(F.col("n")), letter_label(F.col("n"))).collect()
    assert [tuple(r) for r in rows] == [(roman(n), letters(n)) for n in numbers]
    assert page_labels([(0, "r", "", 1), (2, "D", "A-", 5), (4, None, "end", 1)], 5) == ["i", "ii", "A-5", "A-6", "end"]
    assert page_labels([], 2) == ["1", "2"] and page_labels([(1, "A", "", 1)], 2) == ["1", "A"]


def test_escapes(spark):
    row = spark.createDataFrame([("<é&\n😀", "a_b² #1")], "h string, m string").select(html_escaped(F.col("h")), markdown_escaped(F.col("m"))).first()
    assert tuple(row) == ("&lt;&#233;&amp;&#10;&#128512;", "a\\_b<sup>2</sup> \\#1")


def test_xfdf_round_trip():
    fields = [("a.b", "1 < 2"), ("a.c", None), ("d", "x"), ("d", "y"), ("e", "")]
    assert xfdf_to_fields(fields_to_xfdf(fields, 'f".pdf')) == fields
    assert xfdf_to_fields("<x") == [] and xfdf_to_fields(None) == []


def test_xmp():
    packet = """<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description rdf:about="" xmlns:dc="urn:dc" dc:format="pdf">
      <dc:title><rdf:Alt><rdf:li xml:lang="x-default">T</rdf:li></rdf:Alt></dc:title><dc:date>2020</dc:date></rdf:Description></rdf:RDF></x:xmpmeta>"""
    assert xmp_properties(packet) == [("urn:dc", "format", "pdf", 0), ("urn:dc", "title", "T", 1), ("urn:dc", "date", "2020", 0)]
    assert xmp_properties("") == [] and xmp_properties(None) == []


def test_import_of_form_values(spark):
    from paperloom.functions.markup import with_imported, xfdf_values

    texts = spark.createDataFrame([("f", fields_to_xfdf([("a.b", "new"), ("x", "unknown"), ("c", None)])), ("g", "<broken"), ("h", None)], "path string, text string")
    values = xfdf_values(texts)
    assert {(r.path, r.full_name, r.value) for r in values.collect()} == {("f", "a.b", "new"), ("f", "c", None), ("f", "x", "unknown")}
    fields = spark.createDataFrame([("f", "a.b", "old"), ("f", "c", "kept"), ("g", "a.b", None)], "path string, full_name string, value string")
    assert sorted((r.path, r.full_name, r.value) for r in with_imported(fields, values).collect() if r.value) == [("f", "a.b", "new"), ("f", "c", "kept")]


@pytest.mark.parametrize(
    "program",
    ["{ add }", "{ 2 copy lt { exch } if sub }", "{ cvi exch cvi exch idiv }", "{ cvi exch cvi exch mod 3 1 bitshift xor }", "{ dup 0 eq { pop 1 } if div 0.5 exp }", "{ 2 1 roll sub abs ln }", "{ gt not { 1 } { 2.5 } ifelse }", "{ atan }", "{ exch pop sqrt }"],
)
def test_compiled_programs_equal_run_ones(spark, program):
    from paperloom.functions.calculator import applied, calculator_columns

    rows = spark.createDataFrame([(x, y) for x in (-3.5, -1.0, 0.0, 2.0, 7.25, None) for y in (-2.0, 0.0, 1.5, 3.0)], "x double, y double")
    box = [-10.0, 10.0]
    found = rows.select(calculator_columns(program, box * 2, box, F.col("x"), F.col("y"))[0].alias("a"), applied(calculator(program, box * 2, box), F.col("x"), F.col("y"))[0].alias("b")).collect()
    same = lambda a, b: a is None or a != a if b is None or b != b else a is not None and abs(a - b) < 1e-9
    assert all(same(r.a, r.b) or r.b is None for r in found) and any(r.a is not None for r in found)


def test_programs_that_cannot_be_compiled(spark):
    from paperloom.functions.calculator import ProgramError, calculator_columns

    for program in ("{ cvi copy }", "{ 0 gt { 1 } if }", "{ unknown }", "{ pop pop pop }", "{ pop pop }"):
        with pytest.raises(ProgramError):
            calculator_columns(program, [0, 1, 0, 1], [0, 1], F.col("x"), F.col("y"))
