"""XML of form data and metadata: XFDF in and out, and the properties of XMP packets."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_RDF = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}"
_LANG = "{http://www.w3.org/XML/1998/namespace}lang"


def fields_to_xfdf(fields: list[tuple[str, str | None]], file: str | None = None) -> str:
    """Form fields ``(full name, value)`` as XFDF; names with dots become nested fields, a name may come several times."""
    tree: dict = {}
    for name, value in fields:
        node = tree
        for part in name.split("."):
            node = node.setdefault(part, {})
        if value is not None:
            node.setdefault("", []).append(value)
    out = ['<?xml version="1.0" encoding="UTF-8"?>\n<xfdf xmlns="http://ns.adobe.com/xfdf/">', f"<f href={quoteattr(file)}/>" if file else "", "<fields>"]
    stack: list = [iter(tree.items())]
    while stack:
        entry = next(stack[-1], None)
        if entry is None:
            stack.pop()
            if stack:
                out.append("</field>")
            continue
        name, node = entry
        if name == "":
            continue
        out.append(f"<field name={quoteattr(name)}>")
        out += [f"<value>{escape(v)}</value>" for v in node.get("", [])]
        stack.append(iter([kv for kv in node.items() if kv[0] != ""]))
    return "".join(out) + "</fields></xfdf>"


def xfdf_to_fields(text: str | None) -> list[tuple[str, str | None]]:
    """``(full name, value)`` of an XFDF text's fields that have values or no fields below; none of a text that is no XML."""
    try:
        root = ET.fromstring(text or "")
    except ET.ParseError:
        return []
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    out: list[tuple[str, str | None]] = []
    stack = [(f, "") for part in root if local(part) == "fields" for f in reversed(list(part)) if local(f) == "field"]
    while stack:
        field, prefix = stack.pop()
        name = ".".join(filter(None, (prefix, field.get("name") or "")))
        values = [v.text or "" for v in field if local(v) in ("value", "value-richtext")]
        kids = [k for k in field if local(k) == "field"]
        out += [(name, v) for v in values] or ([] if kids else [(name, None)])
        stack.extend((k, name) for k in reversed(kids))
    return out


def xmp_properties(packet: str | None) -> list[tuple[str, str, str, int]]:
    """``(namespace, name, value, place)`` of an XMP packet's properties; items of arrays are counted from 1, other values have place 0."""
    try:
        root = ET.fromstring((packet or "").strip())
    except ET.ParseError:
        return []
    out: list[tuple[str, str, str, int]] = []

    def split(tag: str) -> tuple[str, str]:
        space, _, name = tag[1:].partition("}") if tag.startswith("{") else ("", "", tag)
        return space, name

    for description in root.iter(f"{_RDF}Description"):
        for key, value in description.attrib.items():
            if not key.startswith(_RDF) and key != _LANG:
                out.append((*split(key), value, 0))
        for child in description:
            items = [i for box in child if box.tag in (f"{_RDF}Bag", f"{_RDF}Seq", f"{_RDF}Alt") for i in box if i.tag == f"{_RDF}li"]
            if items:
                out += [(*split(child.tag), "".join(i.itertext()).strip(), n) for n, i in enumerate(items, 1)]
            elif child.attrib.get(f"{_RDF}resource"):
                out.append((*split(child.tag), child.attrib[f"{_RDF}resource"], 0))
            elif (text := "".join(child.itertext()).strip()) or not len(child):
                out.append((*split(child.tag), text, 0))
    return out


def xfdf_files(values: DataFrame, key: str = "fdf_id") -> DataFrame:
    """``key, xfdf``: a file of each form from ``key, full_name, value_no, value`` rows.

    The fields of one form are one file, so they meet in one task.
    """
    # positions in the path are numbers: the tenth field stands behind the second
    place = F.transform(F.split("field_path", "/"), lambda n: n.cast("int")).alias("place")
    rows = F.array_sort(F.collect_list(F.struct(place, "value_no", "full_name", "value")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = [fields_to_xfdf([(r["full_name"], r["value"]) for r in form]) for form in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.string())], names=[key, "xfdf"])

    return values.groupBy(key).agg(rows.alias("form")).mapInArrow(run, f"{key} bigint, xfdf string")


def xmp_table(metadata: DataFrame) -> DataFrame:
    """``path, namespace, name, value, place`` of ``path, packet`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(path, *p) for path, packet in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for p in xmp_properties(packet)]
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string()] * 4 + [pa.int32()])], names=["path", "namespace", "name", "value", "place"])

    return metadata.select("path", "packet").mapInArrow(run, "path string, namespace string, name string, value string, place int")


def xfdf_values(texts: DataFrame) -> DataFrame:
    """``path, full_name, value`` of ``path, text`` rows of XFDF; texts that are no XML give no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(path, *f) for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for f in xfdf_to_fields(text)]
            columns = list(zip(*rows)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["path", "full_name", "value"])

    return texts.select("path", "text").mapInArrow(run, "path string, full_name string, value string")


def with_imported(fields: DataFrame, values: DataFrame) -> DataFrame:
    """Form fields with imported values where there are some: ``fields`` and ``values`` meet by ``path`` and ``full_name``.

    Of several values of one field the least counts, so that the result does
    not depend on their order; values of unknown fields are left out.
    """
    given = values.where("value is not null").groupBy("path", "full_name").agg(F.min("value").alias("_value"))
    return fields.join(given, ["path", "full_name"], "left").withColumn("value", F.coalesce("_value", "value")).drop("_value")
