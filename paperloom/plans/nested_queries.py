"""Queries over the form data files, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators.nested import form_field_values, nested_nodes
from paperloom.session import table


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Fields with their values: one row per value, or one numbered 0."""
    return form_field_values(table(spark, folder, "fdf_documents"), once=False).select("fdf_id", "field_path", "full_name", "value_no").distinct()


def p6_fields(spark: SparkSession, folder: str) -> DataFrame:
    """The field table: path, own name and the parent's path, per file."""
    rows = form_field_values(table(spark, folder, "fdf_documents"), once=False)
    return rows.select("fdf_id", "field_path", "name", F.regexp_extract("field_path", "^(.*)/[0-9]+$", 1).alias("parent_path")).distinct()


def p6_values(spark: SparkSession, folder: str) -> DataFrame:
    """The value table: the text of each value, linked to its field by path."""
    rows = form_field_values(table(spark, folder, "fdf_documents"), once=False)
    return rows.where("value_no > 0").select("fdf_id", "field_path", "value_no", "value").distinct()


def p6_node_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How often each member name occurs with each kind of node, over all files."""
    nodes = nested_nodes(table(spark, folder, "fdf_documents"))
    return nodes.where("position is null and member is not null").groupBy("member", "kind").agg(F.count("*").alias("nodes"))


_FIELDS = """
with recursive docs as (
  select distinct fdf_id, payload from fdf_documents where payload is not null and json_valid(payload)
), f as (
  select fdf_id, cast(i as varchar) as field_path, '' as parent_path,
    json_extract_string(payload, '$.fields[' || i || '].name') as name,
    coalesce(json_extract_string(payload, '$.fields[' || i || '].name'), '') as full_name,
    json_extract(payload, '$.fields[' || i || ']') as node
  from docs, range(cast(json_array_length(payload, '$.fields') as bigint)) t(i)
  where json_type(payload, '$.fields') = 'ARRAY'
  union all
  select fdf_id, field_path || '/' || i, field_path,
    json_extract_string(node, '$.kids[' || i || '].name'),
    case when coalesce(json_extract_string(node, '$.kids[' || i || '].name'), '') = '' then full_name
      when full_name = '' then json_extract_string(node, '$.kids[' || i || '].name')
      else full_name || '.' || json_extract_string(node, '$.kids[' || i || '].name') end,
    json_extract(node, '$.kids[' || i || ']')
  from f, range(cast(json_array_length(node, '$.kids') as bigint)) t(i)
  where json_type(node, '$.kids') = 'ARRAY'
), g as (select * from f where json_type(node) = 'OBJECT'), v as (
  select g.*, 1 as value_no, json_extract_string(node, '$.value') as value from g
  where json_type(node, '$.value') not in ('NULL', 'ARRAY')
  union all
  select g.*, i + 1, json_extract_string(node, '$.value[' || i || ']') from g, range(cast(json_array_length(node, '$.value') as bigint)) t(i)
  where json_type(node, '$.value') = 'ARRAY' and json_type(node, '$.value[' || i || ']') <> 'NULL'
)
"""

SQL: dict[str, str] = {
    "p6_found": _FIELDS
    + """select distinct g.fdf_id, g.field_path, g.full_name, cast(coalesce(v.value_no, 0) as bigint) as value_no
from g left join v on g.fdf_id = v.fdf_id and g.field_path = v.field_path""",
    "p6_fields": _FIELDS + "select distinct fdf_id, field_path, name, parent_path from g",
    "p6_values": _FIELDS + "select distinct fdf_id, field_path, cast(value_no as bigint) as value_no, value from v",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p6_found": p6_found,
    "p6_fields": p6_fields,
    "p6_values": p6_values,
    "p6_node_counts": p6_node_counts,
}
