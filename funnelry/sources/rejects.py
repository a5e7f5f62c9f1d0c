"""Input that is not clean, split into rows that hold and rejects.

Every cell is read as text and then parsed. A cell that is there but does not
fit its type, a date that is no date and a missing key each give a reject: column,
value, reason. A row with any reject goes to the rejects, all others are typed rows. Both
come from one pass over the input, written side by side, so no cell ends a job
and no row is lost.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .. import schema as S
from ..functions.columns import parse_yyyymmdd
from ..session import scratch_path
from .files import BadInput, _typed

REJECTS, REJECTED, LINE = "_rejects", "_rejected", "_line"


class Split(NamedTuple):
    good: DataFrame       # typed rows, the declared columns
    rejects: DataFrame    # the key columns as text, column, value, reason: a row per bad cell


def _text(name: str) -> Column:
    return F.nullif(F.trim(F.col(f"`{name}`")), F.lit(""))


def checked(rows: DataFrame, schema: StructType, dates: Sequence[str] = ("date",), keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """The columns of ``schema`` from columns of text, typed, and ``_rejects``: what did not fit.

    ``dates`` are yyyyMMdd text and stay text; an empty cell is NULL and no reject, but
    in ``keys``. A column ``_line`` (see ``read_checked``) is a reject of its row where it isn't NULL.
    """
    def reject(name: str, bad: Column, reason: str) -> Column:
        return F.when(bad, F.struct(F.lit(name).alias("column"), F.col(f"`{name}`").cast("string").alias("value"), F.lit(reason).alias("reason")))

    found = []
    if LINE in rows.columns:
        found.append(reject(LINE, F.col(LINE).isNotNull(), "not the columns of the header"))
    for f in schema.fields:
        text = _text(f.name)
        if f.name in keys:
            found.append(reject(f.name, text.isNull(), "missing"))
        if f.name in dates:
            found.append(reject(f.name, text.isNotNull() & parse_yyyymmdd(text, tolerant=True).isNull(), "not a date yyyyMMdd"))
        elif not isinstance(f.dataType, StringType):
            found.append(reject(f.name, text.isNotNull() & _typed(f.name, f.dataType, False).isNull(), f"not a {f.dataType.simpleString()}"))
    raw = [F.col(f"`{k}`").cast("string").alias(f"_key_{i}") for i, k in enumerate(keys)]
    bad = F.filter(F.array(*found), lambda r: r.isNotNull()).alias(REJECTS)
    return rows.select(*[_typed(f.name, f.dataType, False) for f in schema.fields], *raw, bad)


def split(rows: DataFrame, schema: StructType, path: str | None = None, dates: Sequence[str] = ("date",),
          keys: Sequence[str] = ("session_id",)) -> Split:
    """Rows of text columns, split by one pass that writes ``path`` (by default in the shared
    folder): a part with the typed rows, one with the rejected ones."""
    spark = rows.sparkSession
    done = checked(rows, schema, dates, keys).withColumn(REJECTED, F.size(REJECTS) > 0)
    path = path or scratch_path(spark, "checked")
    done.write.mode("overwrite").partitionBy(REJECTED).parquet(path)
    both = spark.read.schema(done.schema).parquet(path)
    good = both.where(~F.col(REJECTED)).select(*[F.col(f"`{f.name}`") for f in schema.fields])
    named = [F.col(f"_key_{i}").alias(k) for i, k in enumerate(keys)]
    return Split(good, both.where(REJECTED).select(*named, F.inline(REJECTS)))


def read_checked(spark: SparkSession, path: str, schema: StructType = S.RAW_SESSIONS, out: str | None = None,
                 dates: Sequence[str] = ("date",), keys: Sequence[str] = ("session_id",)) -> Split:
    """A CSV with a header, split. Columns go by name; a line with too few or too many cells is a reject with the
    whole line as its value. A column that the header lacks is an error, as nothing of the file could be used."""
    header = spark.read.option("header", True).csv(path).columns
    missing = [f.name for f in schema.fields if f.name not in header]
    if missing:
        raise BadInput(f"{path}: no column {', '.join(missing)}")
    text = StructType([StructField(c, StringType()) for c in [*header, LINE]])
    rows = spark.read.schema(text).option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE") \
        .option("columnNameOfCorruptRecord", LINE).csv(path)
    return split(rows, schema, out, dates, keys)


def reject_counts(rejects: DataFrame) -> DataFrame:
    """column, reason, rows: for the data-quality report."""
    return rejects.groupBy("column", "reason").agg(F.count(F.lit(1)).alias("rows"))


def write_rejects(rejects: DataFrame, path: str) -> None:
    rejects.write.mode("overwrite").option("header", True).csv(path)


