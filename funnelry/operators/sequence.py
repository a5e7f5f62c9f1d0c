"""1-based position of each row within its group (e.g. hitNumber per session).

``row_number() OVER (PARTITION BY key ORDER BY ...)`` alone would put a whole
group into one task. Here a group is cut into buckets that follow its order:

1. rows are numbered within (key, bucket);
2. buckets are counted with a map-side combined aggregate, and a running sum
   per key over the counts gives each bucket its offset;
3. offset and number are added in a join on (key, bucket), which both sides
   are already partitioned by.

The same plan runs at every size. A task holds the rows of a bucket, and the
counts of one key's buckets, never a whole group's rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_AT, _POS, _N, _OFF = "_seq_at", "_seq_pos", "_seq_n", "_seq_off"


def sequence_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column,
                    name: str = "seq", as_int: bool = True) -> DataFrame:
    """Add ``name`` = 1-based row position within ``keys`` ordered by ``order``.

    ``order`` must make rows unique within a key (end it with a unique id).
    ``bucket`` must never decrease along the order within a key, NULL counting
    as smallest. It bounds what one task holds: the minute of a timestamp
    bounds it by a key's rows in a minute. Where one key can have too many
    rows in one instant, end the bucket with a range of the unique id, as in
    ``struct(ts, floor(id / 1000000))``.
    """
    # One struct: equal keys compare equal also where they hold NULL, and the
    # window, the aggregate and the join share one partitioning.
    at = df.withColumn(_AT, F.struct(*[F.col(k) for k in keys], bucket.alias("_bucket")))
    numbered = at.withColumn(_POS, F.row_number().over(Window.partitionBy(_AT).orderBy(*order)))
    counts = at.groupBy(_AT).agg(F.count(F.lit(1)).alias(_N))
    earlier = Window.partitionBy(F.struct(*[F.col(f"{_AT}.{k}") for k in keys])) \
        .orderBy(f"{_AT}._bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(_AT, F.coalesce(F.sum(_N).over(earlier), F.lit(0)).alias(_OFF))
    seq = F.col(_POS) + F.col(_OFF)
    return (numbered.join(offsets, _AT)
            .select(*df.columns, (seq.cast("int") if as_int else seq).alias(name)))
