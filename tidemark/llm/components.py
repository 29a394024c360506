"""Connected components of links too many for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import checkpointed


def components(links: DataFrame) -> DataFrame:
    """``id``, ``component`` (the smallest id that can be reached) of every id in ``a`` and ``b``.

    Alternates two steps until no link changes: every id links its greater neighbours to its smallest one, then its
    smaller neighbours. Minima are aggregated on the map side, so an id with very many links is no hot spot; rounds grow
    with the logarithm of the longest chain. Each round is a checkpoint. Null ends and links of an id to itself are ignored.
    """
    links = checkpointed(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct())
    if links.isEmpty():
        return links.toDF("id", "component")
    before = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        links = checkpointed(small.select("e.u", "e.v").where("u <> v").distinct())
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    tops = links.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(tops)
