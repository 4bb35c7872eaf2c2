"""Table schemas declared in JSON: ``cols`` of ``col_name`` and ``type``, ``primary_key``."""

from __future__ import annotations

import json
import re

from pyspark.sql import types as T

MONEY = (7, 2)  # a decimal declared without precision

# Declared type names and the Spark types they load as.
PLAIN = {"int": T.IntegerType(), "integer": T.IntegerType(), "bigint": T.LongType(),
         "smallint": T.ShortType(), "date": T.DateType(), "ascii": T.StringType(),
         "text": T.StringType(), "varchar": T.StringType(), "char": T.StringType()}


def spark_type(name: str) -> T.DataType:
    base, _, args = name.strip().lower().partition("(")
    base = base.strip()
    if base in ("decimal", "numeric"):
        precision = [int(x) for x in re.findall(r"\d+", args)] or list(MONEY)
        return T.DecimalType(precision[0], precision[1] if len(precision) > 1 else 0)
    if base not in PLAIN:
        raise ValueError(f"unknown column type {name!r}")
    return PLAIN[base]


def read_schema(source: str | dict) -> dict:
    """A schema document from a path, JSON text or an already parsed mapping."""
    if isinstance(source, dict):
        return source
    if source.lstrip().startswith("{"):
        return json.loads(source)
    with open(source, encoding="utf-8") as f:
        return json.load(f)


def struct_type(source: str | dict) -> T.StructType:
    """Primary key columns are required, all others nullable."""
    doc = read_schema(source)
    keys = set(doc.get("primary_key", []))
    return T.StructType([T.StructField(c["col_name"], spark_type(c["type"]), c["col_name"] not in keys)
                         for c in doc["cols"]])


def create_table(source: str | dict) -> str:
    """DDL of the declared types with the primary key, single or composite."""
    doc = read_schema(source)
    keys = doc["primary_key"]
    lines = [f"{c['col_name']} {c['type']}" for c in doc["cols"]]
    lines.append(f"PRIMARY KEY ({keys[0] if len(keys) == 1 else '(' + ', '.join(keys) + ')'})")
    body = ",\n  ".join(lines)
    return f"CREATE TABLE {doc['namespace']}.{doc['table']} (\n  {body}\n)"


def document(table: str, schema: T.StructType, primary_key: list[str], namespace: str = "retail") -> dict:
    """The schema document of a Spark schema, inverse of :func:`struct_type`."""
    names = {T.StringType: "varchar", T.LongType: "bigint", T.IntegerType: "int",
             T.ShortType: "smallint", T.DateType: "date"}
    cols = [{"col_name": f.name, "type": f"decimal({f.dataType.precision},{f.dataType.scale})"
             if isinstance(f.dataType, T.DecimalType) else names[type(f.dataType)]} for f in schema]
    return {"namespace": namespace, "table": table, "cols": cols, "primary_key": primary_key,
            "clustering_key": []}
