import json

import pytest

from paperloom.operators.nested import Invalid, _decode_deep, field_values, form_field_values, label_nodes, nested_nodes, parse

SCHEMA = "fdf_id bigint, payload string"


def rows(spark, payloads):
    found = form_field_values(spark.createDataFrame(list(enumerate(payloads)), SCHEMA))
    return sorted((r.fdf_id, r.field_path, r.full_name, r.value_no, r.value) for r in found.collect())


def test_values_names_and_paths(spark):
    payload = {"fields": [{"name": "a", "value": ["x", None, 3], "kids": [{"value": False}, {"name": "", "kids": [{"name": "b.c", "value": ""}]}]}, {"name": None, "value": []}]}
    assert rows(spark, [json.dumps(payload)]) == [
        (0, "0", "a", 1, "x"), (0, "0", "a", 3, "3"), (0, "0/0", "a", 1, "false"), (0, "0/1", "a", 0, None), (0, "0/1/0", "a.b.c", 1, ""), (0, "1", "", 0, None),
    ]


@pytest.mark.parametrize("payload", [None, "", " ", "{", '{"fields": [NaN]}', "[1,]", '{"fields": [{"name": "a"}]'])
def test_invalid_payloads_give_nothing(spark, payload):
    assert rows(spark, [payload]) == []


def test_odd_but_valid_payloads(spark):
    assert rows(spark, ["3", "[]", '{"fields": {"name": "x"}}', '{"fields": null}', '{"fields": [null, 1, {"name": 7}]}']) == [(4, "2", "7", 0, None)]


def test_repeated_rows_and_empty_tables(spark):
    one = (1, '{"fields": [{"name": "a"}]}')
    assert form_field_values(spark.createDataFrame([one, one], SCHEMA)).count() == 1
    assert form_field_values(spark.createDataFrame([], SCHEMA)).count() == 0
    extra = spark.createDataFrame([(*one, "x", 1)], SCHEMA + ", value string, pre int")
    assert nested_nodes(extra).count() == 4


def test_depth_beyond_recursion():
    text = '{"fields": [' + '{"name": "n", "kids": [' * 20_000 + "]}" * 20_000 + "]}"
    found = list(field_values(label_nodes(_decode_deep(text))))
    assert len(found) == 20_000 and found[-1][3].count("/") == 19_999


@pytest.mark.parametrize("text", ['{"a": [1, -2.5e3, "x\\u00e9", true, false, null, {}, []]}', "[[], {}]", '"x"', " 1 ", "{}", "[{}, [1]]"])
def test_own_decoder_agrees(text):
    assert _decode_deep(text) == parse(text)


@pytest.mark.parametrize("text", ["{,}", "[1 2]", '{"a" 1}', '{"a": }', "]", "[}", "[1],", "{1: 2}", ""])
def test_own_decoder_rejects(text):
    with pytest.raises(ValueError):
        _decode_deep(text)
    assert parse(text) is Invalid


def test_containment_is_nesting():
    nodes = label_nodes(parse('{"a": [{"b": 1}, [2, 3]], "c": {"d": null}}'))
    parents = {n[0]: n[2] for n in nodes}
    for x in nodes:
        around = [y for y in nodes if y[0] < x[0] and x[1] < y[1]]
        chain, at = [], x[2]
        while at >= 0:
            chain.append(at)
            at = parents[at]
        assert sorted(y[0] for y in around) == sorted(chain)
