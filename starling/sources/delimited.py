"""Pipe-delimited extracts: one record per line, ISO-8859-1, empty field for null."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

ENCODING = "ISO-8859-1"


BARE = "\u0001"  # a separator that no extract holds: lines are read whole
UNFIT = r"[^\x02-\xFF]|[|\r\n]"


def load(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Typed rows of an extract; a trailing delimiter and blank padding of text are dropped.

    Fields are taken as they stand: the format has no quoting, so a quote is data.  A line with
    more or fewer fields than the schema is an error, never cut or filled up.
    """
    lines, n = _lines(spark, path), len(schema)
    fields, fits = _fields(n)
    wrong = F.raise_error(F.concat(F.lit(f"not {n} fields: "), F.substring("line", 1, 200))).cast("boolean")
    rows = lines.filter(F.when(fits, F.lit(True)).otherwise(wrong)).select(fields.alias("f"))
    return rows.select(*[_typed(F.nullif(F.col("f")[i], F.lit("")), f.dataType).alias(f.name) for i, f in enumerate(schema)])


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.schema("line string").option("sep", BARE).option("encoding", ENCODING)
            .option("quote", "\u0000").option("escape", "\u0000").option("mode", "FAILFAST").csv(path))


def _fields(n: int):
    """The fields of a line and whether there are as many as the schema has."""
    fields = F.split("line", r"\|", -1)
    return fields, (F.size(fields) == n) | ((F.size(fields) == n + 1) & (fields[n] == ""))


def load_sorted_out(spark: SparkSession, path: str, schema: T.StructType, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Loads the lines that fit and sets the others aside: (rows, rejects, totals).

    One scan writes both below ``folder``, apart by verdict.  A reject has the ``line`` and its
    ``reason``: the number of fields, or the first column whose text is no value of its type.
    ``totals`` counts lines by reason (null: loaded) and is the whole extract.  The lines read
    are counted while they are written; another number of stored lines is an error.
    """
    n = len(schema)
    fields, fits = _fields(n)
    bad = F.coalesce(*[F.when(F.nullif(F.trim(F.col("f")[i]), F.lit("")).isNotNull() & F.expr(f"try_cast(trim(f[{i}]) as {f.dataType.simpleString()})").isNull(), F.lit(f"{f.name} is no {f.dataType.simpleString()}"))
                       for i, f in enumerate(schema) if not isinstance(f.dataType, T.StringType)], F.lit(None).cast("string"))
    cells = [_typed(F.nullif(F.col("f")[i], F.lit("")), T.StringType()).alias(f"c{i}") for i in range(n)]
    read = Observation()
    lines = _lines(spark, path).observe(read, F.count(F.lit(1)).alias("lines"))
    judged = lines.select("line", fields.alias("f"), fits.alias("fits")).withColumn(
        "reason", F.when(~F.col("fits"), F.concat((F.size("f")).cast("string"), F.lit(f" fields, not {n}"))).otherwise(bad))
    good = F.col("reason").isNull()
    out = judged.select(F.when(~good, F.col("line")).alias("line"), "reason", F.when(good, F.struct(*cells)).alias("row"), F.when(good, 1).otherwise(0).alias("fit"))
    out.write.mode("overwrite").partitionBy("fit").parquet(folder)
    stored = spark.read.parquet(folder)
    totals = stored.groupBy("reason").agg(F.count(F.lit(1)).alias("lines"))
    if read.get["lines"] != stored.count():
        raise ValueError(f"{read.get['lines']} lines read, {stored.count()} stored")
    rows = stored.where("fit = 1").select(*[_typed(F.col(f"row.c{i}"), f.dataType).alias(f.name) for i, f in enumerate(schema)])
    return rows, stored.where("fit = 0").select("line", "reason"), totals


def _typed(col, kind):
    if isinstance(kind, T.StringType):
        return F.rtrim(col)
    return F.nullif(F.trim(col), F.lit("")).cast(kind)


def save(df: DataFrame, path: str) -> None:
    """Write an extract with the trailing delimiter of the source systems.

    A text that the format cannot hold (a delimiter, a line break, a character outside its
    encoding) is an error.
    """
    def field(column):
        text = F.coalesce(F.col(column).cast("string"), F.lit(""))
        return F.when(text.rlike(UNFIT), F.raise_error(F.concat(F.lit(f"{column} does not fit the format: "), text)).cast("string")).otherwise(text)
    fields = [field(c) for c in df.columns]
    df.select(F.concat(F.concat_ws("|", *fields), F.lit("|")).alias("value")).write.mode("overwrite").option(
        "encoding", ENCODING).text(path)
