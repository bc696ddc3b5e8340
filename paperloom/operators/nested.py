"""Nested JSON records to flat tables, by interval labels.

A depth-first walk gives every node of a payload its pre-order number on entry
and its post-order number on exit, so that node ``x`` lies inside node ``y``
exactly if ``y.pre < x.pre`` and ``x.post < y.post``. Tables of one node type
are cut from the labelled nodes and linked by that containment alone; because
the nodes come in pre-order, one pass with a stack of open intervals finds each
node's container. Nothing recurses, so depth is limited by memory only.

Payloads are independent of each other: there is no shuffle besides the one
that removes repeated rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame

from paperloom.session import spread

NODES = (
    "fdf_id bigint, pre bigint, post bigint, parent_pre bigint, depth int, kind string, member string, position bigint, content string"
)
FIELD_VALUES = "fdf_id bigint, field_pre bigint, field_post bigint, parent_pre bigint, field_path string, name string, full_name string, value_no bigint, value string"

#: Rows of an output batch, so that a payload with very many nodes stays small in memory.
BATCH_ROWS = 20_000


class Number(str):
    """A JSON number as it was written."""


def _no_constant(text: str) -> None:
    raise ValueError(f"{text} is no JSON")


_decode = json.JSONDecoder(parse_int=Number, parse_float=Number, parse_constant=_no_constant).decode
_SPACE = re.compile(r"[ \t\n\r]*")
_ATOM = re.compile(r"(true|false|null)|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?)", re.ASCII)
_WORDS = {"true": True, "false": False, "null": None}


def _decode_deep(text: str) -> object:
    """A JSON decoder with its own stack, for payloads too deep for the recursive one."""
    top: list = []
    open_: list = [top]
    keys: list = [None]
    at, want = 0, "value"
    while True:
        at = _SPACE.match(text, at).end()
        if at >= len(text):
            break
        ch = text[at]
        holder = open_[-1]
        if want in ("value", "first") and not (want == "first" and ch in "]}"):
            if isinstance(holder, dict) and keys[-1] is None:
                if ch != '"':
                    raise ValueError("a key is missing")
                keys[-1], at = scanstring(text, at + 1, True)
                at = _SPACE.match(text, at).end()
                if text[at : at + 1] != ":":
                    raise ValueError("a colon is missing")
                at, want = at + 1, "value"
                continue
            if ch in "[{":
                value: object = [] if ch == "[" else {}
                at += 1
            elif ch == '"':
                value, at = scanstring(text, at + 1, True)
            elif m := _ATOM.match(text, at):
                value, at = (_WORDS[m[1]] if m[1] else Number(m[2])), m.end()
            else:
                raise ValueError("no JSON value")
            if isinstance(holder, dict):
                holder[keys[-1]] = value
                keys[-1] = None
            else:
                holder.append(value)
            if isinstance(value, (list, dict)):
                open_.append(value)
                keys.append(None)
                want = "first"
            else:
                want = "next"
        elif ch in "]}" and len(open_) > 1 and isinstance(holder, list) == (ch == "]"):
            open_.pop()
            keys.pop()
            at, want = at + 1, "next"
        elif ch == "," and want == "next" and len(open_) > 1:
            at, want = at + 1, "value"
        else:
            raise ValueError("no JSON")
        if want == "next" and len(open_) == 1:
            if _SPACE.match(text, at).end() != len(text):
                raise ValueError("text after the end")
            return top[0]
    raise ValueError("the text ends early")


class Invalid:
    """Stands for a payload that is no JSON."""


def parse(text: str | None) -> object:
    """The value of a JSON text, numbers as written; `Invalid` if it is null or no JSON. Of a repeated member the last counts."""
    if text is None:
        return Invalid
    try:
        return _decode(text)
    except RecursionError:
        try:
            return _decode_deep(text)
        except ValueError:
            return Invalid
    except ValueError:
        return Invalid


def label_nodes(root: object) -> list[tuple]:
    """The nodes of a parsed payload in pre-order: ``(pre, post, parent_pre, depth, kind, member, position, value)``.

    ``pre`` and ``post`` count entries and exits with one clock. ``member`` is
    the key under which a node or the array around it stands; ``position`` is
    its place in that array.
    """
    nodes: list[list] = []
    clock = 0
    stack: list = [(root, None, None, -1, 0, None)]
    while stack:
        value, member, position, parent, depth, closing = stack.pop()
        if closing is not None:
            nodes[closing][1] = clock
            clock += 1
            continue
        pre, clock = clock, clock + 1
        index = len(nodes)
        if isinstance(value, dict):
            nodes.append([pre, 0, parent, depth, "object", member, position, None])
            stack.append((None, None, None, 0, 0, index))
            stack.extend((v, k, None, pre, depth + 1, None) for k, v in reversed(value.items()))
        elif isinstance(value, list):
            nodes.append([pre, 0, parent, depth, "array", member, position, None])
            stack.append((None, None, None, 0, 0, index))
            stack.extend((v, member, i, pre, depth + 1, None) for i, v in zip(range(len(value) - 1, -1, -1), reversed(value)))
        else:
            kind = "null" if value is None else "boolean" if isinstance(value, bool) else "number" if isinstance(value, Number) else "string"
            nodes.append([pre, clock, parent, depth, kind, member, position, value])
            clock += 1
    return [tuple(n) for n in nodes]


def as_text(kind: str, value: object) -> str | None:
    return None if kind in ("null", "object", "array") else ("true" if value else "false") if kind == "boolean" else str(value)


def field_values(nodes: list[tuple]) -> Iterator[tuple]:
    """The form fields among labelled nodes, one row per value; a field without one gives a row with ``value_no`` 0.

    Field intervals stay open on a stack while the walk is inside them, so the
    innermost open one contains the node at hand.
    """
    arrays: dict[int, str] = {}  # pre of a `fields` or `kids` array of fields -> path prefix of its items
    open_: list[dict] = []
    done: list[dict] = []
    holders: dict[int, dict] = {}  # pre of a `value` array -> its field
    root = nodes[0] if nodes else None
    for pre, post, parent, depth, kind, member, position, value in nodes:
        while open_ and open_[-1]["post"] < pre:
            open_.pop()
        field = open_[-1] if open_ else None
        if kind == "object" and position is not None and parent in arrays:
            path = f"{arrays[parent]}{position}"
            field = {"pre": pre, "post": post, "parent": field, "path": path, "name": None, "values": []}
            open_.append(field)
            done.append(field)
        elif kind == "array" and position is None and parent == root[0] and depth == 1 and root[4] == "object" and member == "fields":
            arrays[pre] = ""
        elif field is not None and position is None and parent == field["pre"]:
            if member == "kids" and kind == "array":
                arrays[pre] = field["path"] + "/"
            elif member == "name":
                field["name"] = as_text(kind, value)
            elif member == "value" and kind == "array":
                holders[pre] = field
            elif member == "value" and kind != "null":
                field["values"].append((1, as_text(kind, value)))
        elif parent in holders and kind != "null":
            holders[parent]["values"].append((position + 1, as_text(kind, value)))
    for field in done:  # a parent comes before its kids
        above = field["parent"]
        own = field["name"] or ""
        prefix = above["full"] if above else ""
        field["full"] = f"{prefix}.{own}" if prefix and own else prefix or own
        for number, content in field["values"] or [(0, None)]:
            yield field["pre"], field["post"], above["pre"] if above else None, field["path"], field["name"], field["full"], number, content


def _write(rows: Iterator[tuple], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    block: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*block), types)], names=names)

    for row in rows:
        block.append(row)
        if len(block) >= BATCH_ROWS:
            yield batch()
            block = []
    if block:
        yield batch()


def _clean(text: str | None) -> str | None:
    """Text that UTF-8 can hold: a lone surrogate, which JSON may escape, becomes U+FFFD."""
    if text is None or text.isascii():
        return text
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


_LONG, _STRING = pa.int64(), pa.string()


def _nodes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if (root := parse(text)) is not Invalid:
                    for pre, post, parent, depth, kind, member, position, value in label_nodes(root):
                        yield key, pre, post, None if parent < 0 else parent, depth, kind, _clean(member), position, _clean(as_text(kind, value))

    yield from _write(rows(), [c.split()[0] for c in NODES.split(", ")], [_LONG, _LONG, _LONG, _LONG, pa.int32(), _STRING, _STRING, _LONG, _STRING])


def _fields_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if (root := parse(text)) is not Invalid:
                    for pre, post, parent, path, name, full, number, content in field_values(label_nodes(root)):
                        yield key, pre, post, parent, path, _clean(name), _clean(full), number, _clean(content)

    yield from _write(rows(), [c.split()[0] for c in FIELD_VALUES.split(", ")], [_LONG, _LONG, _LONG, _LONG, _STRING, _STRING, _STRING, _LONG, _STRING])


def _records(records: DataFrame, key: str, payload: str, once: bool) -> DataFrame:
    rows = records.selectExpr(f"cast(`{key}` as bigint) fdf_id", f"`{payload}` payload")
    return rows.distinct() if once else spread(rows)


def nested_nodes(records: DataFrame, key: str = "fdf_id", payload: str = "payload") -> DataFrame:
    """Every node of every valid payload with its interval labels (`NODES`).

    Repeated ``(key, payload)`` rows count once; null and invalid payloads give
    no rows; an empty table gives none. Only the two named columns are read.
    """
    return _records(records, key, payload, True).mapInArrow(_nodes_of, NODES)


def form_field_values(records: DataFrame, key: str = "fdf_id", payload: str = "payload", once: bool = True) -> DataFrame:
    """The form fields of every valid payload with their values (`FIELD_VALUES`).

    A field's parent link is ``parent_pre``, the label of the field whose
    interval contains it. A scalar value has number 1, an array one row per
    non-null entry with its 1-based position, anything else one row numbered 0.
    An object or array that stands where a scalar is expected counts as one
    value without text. A name that is no string counts as its JSON text;
    entries of ``fields`` and ``kids`` that are no objects are no fields but
    keep their position. Nulls, repeats and empty tables as in `nested_nodes`;
    who drops repeated rows later anyway need not have whole payloads shuffled
    for it first and says that they need not come ``once``.
    """
    return _records(records, key, payload, once).mapInArrow(_fields_of, FIELD_VALUES)
