"""One table a day, named by a prefix and the day (``ga_sessions_20161101``).

The root is listed once. A folder whose name is the prefix and a date is a day's
table; all others (an intraday table, a half-written one) are left alone. A
range of days picks folders before anything is opened, so no file of another
day is listed or read. Each row tells its day by the path of its file.

Tables of different days may differ: fields come and go, numbers get wider, ids
turn from text to numbers. The footer of one file a day tells its schema; days
with one schema are read together, and each such scan reads only the fields that
are wanted and brings them to one schema by name, also inside structs and arrays.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, ByteType, DataType, DoubleType, FloatType, IntegerType, LongType, ShortType,
                               StringType, StructField, StructType)

from .. import schema as S
from .files import BadInput

PREFIX, SUFFIX = "ga_sessions_", "table_suffix"
_WIDER = [ByteType(), ShortType(), IntegerType(), LongType(), FloatType(), DoubleType()]


@dataclass(frozen=True)
class DayTable:
    day: str        # yyyyMMdd
    path: str


def _is_day(text: str) -> bool:
    if not re.fullmatch(r"[0-9]{8}", text):
        return False
    try:
        dt.datetime.strptime(text, "%Y%m%d")
    except ValueError:
        return False
    return True


def _children(spark: SparkSession, path: str) -> list:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return list(at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at))


def list_day_tables(spark: SparkSession, root: str, date_from: str | None = None, date_to: str | None = None,
                    prefix: str = PREFIX) -> list[DayTable]:
    """The day tables under ``root``, by day; the range is inclusive. One listing."""
    found = [DayTable(s.getPath().getName()[len(prefix):], s.getPath().toString()) for s in _children(spark, root)
             if s.isDirectory() and s.getPath().getName().startswith(prefix)]
    days = sorted((t for t in found if _is_day(t.day)), key=lambda t: t.day)
    return [t for t in days if (date_from is None or t.day >= date_from) and (date_to is None or t.day <= date_to)]


def missing_days(tables: list[DayTable], date_from: str, date_to: str) -> list[str]:
    """The days of an inclusive range that have no table."""
    have = {t.day for t in tables}
    first, last = (dt.datetime.strptime(d, "%Y%m%d") for d in (date_from, date_to))
    every = ((first + dt.timedelta(days=i)).strftime("%Y%m%d") for i in range((last - first).days + 1))
    return [d for d in every if d not in have]


# --- schemas that differ ------------------------------------------------------------
def united(a: DataType, b: DataType, where: str = "") -> DataType:
    """The type that holds both: fields of structs are united by name, numbers take the wider type."""
    if a == b:
        return a
    if isinstance(a, StructType) and isinstance(b, StructType):
        names = {f.name: f.dataType for f in a.fields}
        for f in b.fields:
            names[f.name] = united(names[f.name], f.dataType, f"{where}.{f.name}") if f.name in names else f.dataType
        return StructType([StructField(n, t) for n, t in names.items()])
    if isinstance(a, ArrayType) and isinstance(b, ArrayType):
        return ArrayType(united(a.elementType, b.elementType, f"{where}[]"))
    if a in _WIDER and b in _WIDER:
        return max(a, b, key=_WIDER.index)
    raise BadInput(f"field {where.lstrip('.')}: {a.simpleString()} in one day, {b.simpleString()} in another")


def _plain(kind: DataType) -> DataType:
    """Without the nullability that files declare."""
    if isinstance(kind, StructType):
        return StructType([StructField(f.name, _plain(f.dataType)) for f in kind.fields])
    return ArrayType(_plain(kind.elementType)) if isinstance(kind, ArrayType) else kind


def _wanted(have: DataType, want: DataType) -> DataType:
    """What is read of ``have``: the fields that ``want`` has, with the types of the file."""
    if isinstance(have, StructType) and isinstance(want, StructType):
        names = {f.name: f.dataType for f in want.fields}
        return StructType([StructField(f.name, _wanted(f.dataType, names[f.name])) for f in have.fields if f.name in names])
    if isinstance(have, ArrayType) and isinstance(want, ArrayType):
        return ArrayType(_wanted(have.elementType, want.elementType))
    return have


def conformed(c: Column, have: DataType, want: DataType) -> Column:
    """A column of type ``have`` as ``want``: fields go by name, absent ones and values that don't fit are NULL."""
    if have == want:
        return c
    if isinstance(have, StructType) and isinstance(want, StructType):
        names = {f.name: f.dataType for f in have.fields}
        return F.when(c.isNotNull(), F.struct(*[
            (conformed(c[f.name], names[f.name], f.dataType) if f.name in names else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in want.fields]))
    if isinstance(have, ArrayType) and isinstance(want, ArrayType):
        return F.transform(c, lambda x: conformed(x, have.elementType, want.elementType))
    return c.try_cast(want)


def _day_schemas(spark: SparkSession, tables: list[DayTable], fmt: str) -> dict[StructType, list[DayTable]]:
    """The days of each schema. Parquet: by a footer a day; files of a day share their schema."""
    groups: dict[StructType, list[DayTable]] = {}
    for t in tables:
        groups.setdefault(_plain(spark.read.format(fmt).load(t.path).schema), []).append(t)
    return groups


def read_day_tables(spark: SparkSession, root: str, date_from: str | None = None, date_to: str | None = None,
                    schema: StructType = S.NESTED_SESSIONS, fmt: str = "parquet", prefix: str = PREFIX,
                    extra_fields: bool = False, all_days: bool = False) -> DataFrame:
    """The rows of the day tables of a range, with ``table_suffix`` (the day, by the file's path).

    Columns are those of ``schema``, with its types; with ``extra_fields`` also all others
    that any of the days has. A NULL or absent ``date`` takes the day of the table. Without any
    day table under ``root``, or with ``all_days`` and a day of the range missing, it is an error.
    JSON is read with ``schema`` alone unless ``extra_fields`` asks for a look at the records.
    """
    tables = list_day_tables(spark, root, date_from, date_to, prefix)
    if not tables and not list_day_tables(spark, root, prefix=prefix):
        raise BadInput(f"{root}: no table {prefix}yyyyMMdd")
    if all_days and tables:
        gone = missing_days(tables, date_from or tables[0].day, date_to or tables[-1].day)
        if gone:
            raise BadInput(f"{root}: no table for {', '.join(gone)}")
    if not tables:
        return spark.createDataFrame([], StructType([*schema.fields, StructField(SUFFIX, StringType())]))
    if fmt == "json" and not extra_fields:
        groups = {schema: tables}
    else:
        groups = _day_schemas(spark, tables, fmt)
    target = declared = _plain(schema)
    if extra_fields:
        for have in groups:
            target = _with_more(target, have, declared)
    parts = [_scan(spark, have, days, target, fmt, prefix) for have, days in groups.items()]
    out = parts[0]
    for other in parts[1:]:
        out = out.unionByName(other)
    return out


def _with_more(target: DataType, have: DataType, declared: DataType | None, where: str = "") -> DataType:
    """``target`` with the fields that only ``have`` has. Declared types stay; those of further fields are united."""
    if isinstance(target, StructType) and isinstance(have, StructType):
        names = {f.name: f.dataType for f in target.fields}
        own = {f.name: f.dataType for f in declared.fields} if isinstance(declared, StructType) else {}
        for f in have.fields:
            names[f.name] = (_with_more(names[f.name], f.dataType, own.get(f.name), f"{where}.{f.name}")
                             if f.name in names else f.dataType)
        return StructType([StructField(n, t) for n, t in names.items()])
    if isinstance(target, ArrayType) and isinstance(have, ArrayType):
        own = declared.elementType if isinstance(declared, ArrayType) else None
        return ArrayType(_with_more(target.elementType, have.elementType, own, f"{where}[]"))
    return target if declared is not None else united(target, have, where)


def _scan(spark: SparkSession, have: StructType, days: list[DayTable], target: StructType, fmt: str, prefix: str) -> DataFrame:
    read = _wanted(have, target)
    rows = spark.read.schema(read).format(fmt).load([t.path for t in days])
    day = F.regexp_extract(F.col("_metadata.file_path"), f"/{re.escape(prefix)}([0-9]{{8}})/", 1)
    names = {f.name: f.dataType for f in read.fields}
    columns: dict[str, Column] = {
        f.name: conformed(F.col(f"`{f.name}`"), names[f.name], f.dataType) if f.name in names else F.lit(None).cast(f.dataType)
        for f in target.fields}
    if "date" in columns:
        columns["date"] = F.coalesce(columns["date"], day)
    return rows.select(*[c.alias(n) for n, c in columns.items()], day.alias(SUFFIX))
