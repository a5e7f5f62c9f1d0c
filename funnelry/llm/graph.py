"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tasks import stored


def _settled(links: DataFrame) -> bool:
    """Whether every node either points at one root or is a root: then the roots are
    the components. One number comes to the driver."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("root")).unionByName(
        links.select(F.col("v").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("root")))
    roles = ends.groupBy("node").agg((F.sum("child") + F.max("root")).alias("n"))
    return (roles.agg(F.max("n")).first()[0] or 0) <= 1


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for each node that isn't the smallest of its component, root
    being that smallest node, from the columns u and v of ``links`` (any type that
    has an order).

    Links point from the larger node to the smaller. In each round a link first
    moves on to the smallest node its target points at, then all targets of a
    node are linked to the smallest of them. Minima are combined before the
    shuffle, and the links are written after each round, so lost executors cost
    one round at most.
    """
    order = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    now = stored(links.where("u <> v").select(*order).distinct(), "links")
    for _ in range(rounds):
        if _settled(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        # a target that very many nodes point at is split by the join on a new key
        least = now.groupBy("u").agg(F.min("v").alias("m")).select(F.xxhash64("u").alias("at"), F.col("u").alias("w"), "m")
        moved = now.withColumn("to", F.xxhash64("v")).join(least, F.expr("to = at AND v = w"), "left") \
            .select("u", F.coalesce("m", "v").alias("v"))
        least = moved.groupBy("u").agg(F.min("v").alias("m"))
        near = moved.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(near.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
    raise RuntimeError(f"links did not settle in {rounds} rounds")
