"""Typed JSON lines: dates, 64-bit integers and decimals are wrapped so that no type is lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

WRAPPER = {T.LongType: "$numberLong", T.DecimalType: "$numberDecimal", T.DateType: "$date"}


def _wrap(field: T.StructField) -> Column:
    col, key = F.col(field.name), WRAPPER.get(type(field.dataType))
    if key is None:
        return col.alias(field.name)
    if key == "$date":
        text = F.concat(F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    else:
        text = col.cast("string")
    return F.when(col.isNotNull(), F.struct(text.alias(key))).alias(field.name)


def to_lines(df: DataFrame) -> DataFrame:
    """One JSON document per row; nulls are written, quotes are escaped."""
    doc = F.to_json(F.struct(*[_wrap(f) for f in df.schema]), {"ignoreNullFields": "false"})
    return df.select(doc.alias("value"))


def save(df: DataFrame, path: str) -> None:
    to_lines(df).write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read typed JSON lines back with the declared schema, unwrapping the typed values."""
    fields, cols = [], []
    for f in schema:
        key = WRAPPER.get(type(f.dataType))
        inner = T.StringType() if key else f.dataType
        fields.append(T.StructField(f.name, T.StructType([T.StructField(key, inner)]) if key else inner))
        value = F.col(f"`{f.name}`.`{key}`") if key else F.col(f.name)
        if key == "$date":
            value = F.to_date(F.substring(value, 1, 10))
        cols.append(value.cast(f.dataType).alias(f.name))
    return spark.read.schema(T.StructType(fields)).json(path).select(*cols)
