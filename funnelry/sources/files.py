"""File sources with declared schemas (no inference): S1-S4.

* raw GA flat export as CSV or Parquet (sessions, hits, products)
* processed tables written by this library (clean sessions, purchases)
* nested GA export (one row per session, repeated ``hits``), Parquet or JSON,
  optionally partitioned by ``date`` so a date range prunes directories.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegerType, LongType, StringType, StructField, StructType

from .. import schema as S
from ..functions.columns import usd_to_micros


class BadInput(ValueError):
    """A file that does not have the columns it should have."""


def _typed(name: str, kind: DataType, strict: bool):
    """A text column as ``kind``. An empty cell is NULL; any other cell that does
    not fit raises, or is NULL if not ``strict``. Whole numbers may be written
    as ``1.0``."""
    text = F.nullif(F.trim(F.col(f"`{name}`")), F.lit(""))
    if isinstance(kind, StringType):
        return F.col(f"`{name}`").alias(name)
    if isinstance(kind, (IntegerType, LongType)):
        plain = text.try_cast(kind)
        number = text.try_cast("decimal(38,6)")
        value = F.coalesce(plain, F.when(number == F.floor(number), number.try_cast(kind)))
    else:
        value = text.try_cast(kind)
    if strict:
        value = F.when(text.isNotNull() & value.isNull(), F.raise_error(F.concat(
            F.lit(f"column {name}: not a {kind.simpleString()}: "), text)).cast(kind)).otherwise(value)
    return value.alias(name)


def _read_csv(spark: SparkSession, path: str, schema: StructType, strict: bool) -> DataFrame:
    """Columns are found by their name in the header, in whatever order they come;
    further columns are left out. A file whose header differs from the first
    one's, and a missing column, is an error."""
    header = spark.read.option("header", True).csv(path).columns
    missing = [f.name for f in schema.fields if f.name not in header]
    if missing:
        raise BadInput(f"{path}: no column {', '.join(missing)}")
    rows = (spark.read.schema(StructType([StructField(c, StringType()) for c in header]))
            .option("header", True).option("enforceSchema", False).option("mode", "FAILFAST" if strict else "PERMISSIVE")
            .csv(path))
    return rows.select(*[_typed(f.name, f.dataType, strict) for f in schema.fields])


def _read(spark: SparkSession, path: str, schema: StructType, fmt: str, strict: bool = True) -> DataFrame:
    if fmt == "csv":
        return _read_csv(spark, path, schema, strict)
    reader = spark.read.schema(schema)
    if fmt == "json":
        return reader.option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)
    if fmt == "parquet":
        return reader.parquet(path)
    raise ValueError(f"unsupported format {fmt!r}")


# --- S1: raw flat export --------------------------------------------------------
def read_raw_sessions(spark: SparkSession, path: str, fmt: str = "csv", strict: bool = True) -> DataFrame:
    return _read(spark, path, S.RAW_SESSIONS, fmt, strict)


def read_raw_hits(spark: SparkSession, path: str, fmt: str = "csv", strict: bool = True) -> DataFrame:
    return _read(spark, path, S.RAW_HITS, fmt, strict)


def read_products(spark: SparkSession, path: str, fmt: str = "csv", strict: bool = True) -> DataFrame:
    return _read(spark, path, S.PRODUCTS, fmt, strict)


# --- S2: processed tables ---------------------------------------------------------
def read_clean_sessions(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Clean sessions; a CSV without ``revenue_micros`` gets it from revenue.

    Flags are parsed as typed booleans ("False" stays false, unlike a
    truthiness cast of the string).
    """
    if fmt == "parquet":
        return spark.read.parquet(path)
    without = StructType([f for f in S.CLEAN_SESSIONS.fields if f.name != "revenue_micros"])
    df = _read(spark, path, without, fmt)
    return df.withColumn("revenue_micros", usd_to_micros("revenue"))


def read_purchases(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    if fmt == "parquet":
        return spark.read.parquet(path)
    return _read(spark, path, S.PURCHASES, fmt)


# --- S3 / S4: nested export and date-range scan -----------------------------------
RECORD = "record_id"
NESTED_WITH_FRAGMENT = StructType([*S.NESTED_SESSIONS.fields, StructField("hit_fragment", IntegerType()),
                                   StructField(RECORD, StringType())])


def read_nested_sessions(spark: SparkSession, path: str, fmt: str = "parquet",
                         date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """Nested sessions from a directory (``date=yyyyMMdd`` partitions allowed).

    Both formats are read with the declared schema. Fields that a file lacks are
    NULL, and records without a ``record_id`` are never merged, so the same
    records give the same sessions from JSON and from Parquet. Parquet files
    without ``record_id`` (a plain export) are read without it. The inclusive
    ``date`` range is a partition filter when ``date`` is a partition column,
    so untouched days are never listed or read.
    """
    if fmt == "json":
        df = spark.read.schema(NESTED_WITH_FRAGMENT).option("basePath", path).option("mode", "FAILFAST").json(path)
    elif fmt == "parquet":
        # one footer tells whether there are fragments to be merged at all
        cut = RECORD in spark.read.option("basePath", path).parquet(path).columns
        df = spark.read.schema(NESTED_WITH_FRAGMENT if cut else S.NESTED_SESSIONS).option("basePath", path).parquet(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}")
    return date_range(df, date_from, date_to)


def date_range(df: DataFrame, date_from: str | None, date_to: str | None, col: str = "date") -> DataFrame:
    """Inclusive yyyyMMdd range on a string date column (suffix-range scan)."""
    c = F.col(col).cast("string")
    if date_from is not None:
        df = df.where(c >= F.lit(date_from))
    if date_to is not None:
        df = df.where(c <= F.lit(date_to))
    return df
