"""Ranges of offsets: sweeps, subtraction, runs and lookups, all by windows over sorted bounds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.text.locate import ITEMS


def item_order(items: Column) -> Column:
    """Item labels in the order of an annual report, unknown ones last."""
    known = F.array(*[F.lit(i) for i in ITEMS])
    place = lambda x: F.when(F.array_position(known, x) == 0, len(ITEMS) + 1).otherwise(F.array_position(known, x))
    return F.transform(F.array_sort(F.transform(items, lambda x: F.struct(place(x).alias("r"), x.alias("i")))), lambda s: s["i"])


def segments(spans: DataFrame, *, by: str = "accession", label: str = "item", start: str = "span_start", end: str = "span_end") -> DataFrame:
    """``by``, ``start``, ``end``, ``items``: maximal stretches that the same labels claim; stretches that none claims are left out.

    Bounds are swept once for each label: a span adds its label at its start and takes it away at its end, so no bound is joined
    to the spans around it. What passes through grows with bounds x labels of one ``by``, however many spans overlap.
    """
    spans = spans.where((F.col(end) > F.col(start)) & F.col(label).isNotNull()).select(by, F.col(label).alias("l"), F.col(start).alias("a"), F.col(end).alias("z"))
    events = spans.select(by, F.col("a").alias("at"), "l", F.lit(1).alias("d")).unionByName(spans.select(by, F.col("z").alias("at"), "l", F.lit(-1).alias("d")))
    # How many spans of each label are open behind each of its own bounds; a stretch between them is labelled if any is.
    per = events.groupBy(by, "l", "at").agg(F.sum("d").alias("d"))
    per = per.withColumn("open", F.sum("d").over(Window.partitionBy(by, "l").orderBy("at")))
    per = per.withColumn("was", F.coalesce(F.lag("open").over(Window.partitionBy(by, "l").orderBy("at")), F.lit(0)))
    turns = per.where((F.col("open") > 0) != (F.col("was") > 0)).select(by, "l", "at", (F.col("open") > 0).alias("on"))
    # Each label's state at each bound of its ``by``: as its last turn left it. All of it stays where ``by`` was brought together.
    turns = turns.repartition(by).withColumn("labels", F.collect_set("l").over(Window.partitionBy(by)))
    bounds = turns.groupBy(by, "at").agg(F.map_from_entries(F.collect_list(F.struct("l", "on"))).alias("turned"), F.first("labels").alias("labels"))
    bounds = bounds.withColumn("next", F.lead("at").over(Window.partitionBy(by).orderBy("at")))
    states = bounds.select(by, "at", "next", "turned", F.explode("labels").alias("l")).withColumn("on", F.col("turned")[F.col("l")])
    states = states.withColumn("now", F.last("on", ignorenulls=True).over(Window.partitionBy(by, "l").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    open_ = states.where("now").groupBy(by, "at", "next").agg(F.collect_list("l").alias("items"))
    stretches = open_.select(by, F.col("at").alias("start"), F.col("next").alias("end"), item_order(F.col("items")).alias("items"))
    order = Window.partitionBy(by).orderBy("start")
    new = ~((F.col("start") == F.lag("end").over(order)) & (F.col("items") == F.lag("items").over(order)))
    runs = stretches.withColumn("run", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(order))
    return runs.groupBy(by, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("items").alias("items")).drop("run")


def uncovered(wholes: DataFrame, holes: DataFrame, *, by: str, start: str, end: str) -> DataFrame:
    """``by``, ``start``, ``end``: what the holes leave of each whole range, one whole for each ``by``."""
    h = holes.where(F.col(end) > F.col(start)).select(by, F.col(start).alias("a"), F.col(end).alias("z"))
    # The ends of the whole are holes of no width around it.
    edges = wholes.select(by, F.col(start).alias("lo"), F.col(end).alias("hi"))
    cut = h.join(edges, by).select(by, F.greatest("a", "lo").alias("a"), F.least("z", "hi").alias("z")).where("a < z")
    marks = cut.unionByName(edges.select(by, F.col("lo").alias("a"), F.col("lo").alias("z"))).unionByName(edges.select(by, F.col("hi").alias("a"), F.col("hi").alias("z")))
    w = Window.partitionBy(by).orderBy("a", "z")
    reach = F.max("z").over(w.rowsBetween(Window.unboundedPreceding, 0))
    gaps = marks.withColumn("reach", reach).withColumn("next", F.lead("a").over(w))
    return gaps.where("next > reach").select(by, F.col("reach").alias("start"), F.col("next").alias("end"))


def runs(df: DataFrame, *, by: Sequence[str], at: str, rank: str, max_gap: float, tie: str) -> DataFrame:
    """``df`` with ``run_no`` and ``run_size``: a new run where the gap is too wide or ``rank`` does not ascend."""
    w = Window.partitionBy(*by).orderBy(at, tie)
    gap = F.col(at).cast("double") - F.lag(F.col(at).cast("double")).over(w)
    new = (gap > max_gap) | (F.col(rank) <= F.lag(rank).over(w)) | F.lag(tie).over(w).isNull()
    numbered = df.withColumn("__new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("run_no", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.withColumn("run_size", F.count(F.lit(1)).over(Window.partitionBy(*by, "run_no"))).drop("__new")


def until_next(df: DataFrame, *, by: Sequence[str], at: str, tie: str, last: Column) -> DataFrame:
    """``df`` with ``until``: where the next one begins, or ``last``."""
    w = Window.partitionBy(*by).orderBy(at, tie)
    return df.withColumn("until", F.coalesce(F.lead(at).over(w), last))
