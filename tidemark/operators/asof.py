"""Attributes as known at event time.

Every time at which something became known about an entity is a version. Narrow rows of times, those of
versions and those of events, are numbered by a cumulative count of changes; the wide attributes are then
equi-joined on entity and number, so no range join and no scan of an entity's history is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_ENTITY, _TIME, _NO = ("__entity1", "__entity2"), "__time", "__no"


def _entity(keys: Sequence[Column]) -> list[Column]:
    """All keys in 128 bits of hash, nulls told apart from any text."""
    said = [F.coalesce(F.concat(F.lit("="), k.cast("string")), F.lit("-")) for k in keys]
    return [F.xxhash64(F.lit(seed), *said).alias(name) for seed, name in enumerate(_ENTITY)]


def _numbered(timeline: DataFrame) -> DataFrame:
    """``timeline`` with the number of changes of the entity up to each of its rows; of one time, changes come first.

    Days of an entity are few, so one window counts them. Finer times may be a large part of all rows: these are
    counted within each day, and moved up by what the entity's days before hold, so no task sorts a whole history.
    """
    until = (Window.unboundedPreceding, 0)
    order = [F.col(_TIME), F.desc("change")]
    if dict(timeline.dtypes)[_TIME] == "date":
        return timeline.withColumn(_NO, F.sum("change").over(Window.partitionBy(*_ENTITY).orderBy(*order).rowsBetween(*until)))
    timeline = timeline.withColumn("__day", F.to_date(_TIME))
    days = timeline.groupBy(*_ENTITY, "__day").agg(F.sum("change").alias("__n"))
    before = Window.partitionBy(*_ENTITY).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(*_ENTITY, "__day", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*_ENTITY, "__day").orderBy(*order).rowsBetween(*until)
    inside = timeline.withColumn("__in", F.sum("change").over(within))
    return inside.join(days, [*_ENTITY, "__day"]).withColumn(_NO, F.col("__before") + F.col("__in")).drop("__day", "__before", "__in")


def attributes_as_of(
    events: DataFrame,
    attributes: DataFrame,
    *,
    event_keys: Sequence[Column],
    attribute_keys: Sequence[Column],
    event_id: str,
    event_time: Column,
    known_time: Column,
    order: Column,
    attribute_id: str,
    carry: Sequence[str] = (),
) -> DataFrame:
    """For each event the first and the latest attribute row known by its time.

    Out: ``event_id``, ``reported`` and ``restated``, structs of ``id`` and the columns of ``carry``.
    ``reported`` has the earliest time, then the smallest ``order``, then the smallest id; ``restated`` the latest
    time not after the event's, then the greatest ``order``, then the smallest id. Events for which nothing was
    known are absent.

    Times are compared as they are: a row known at 15:00 does not count for an event at 09:00 of that day. Where days
    are what counts, both must be dates; if only one is, it stands for its midnight.

    Nulls: keys compare null-safely; rows without a time are never known, events without a time know nothing; a
    null ``order`` counts as an empty string. Repeated rows make no further version; repeated events each keep
    their row. Empty tables give an empty result. Columns of either side cannot clash, as only the named ones
    are taken.

    Scale: attribute rows are first reduced to one per entity and time (with a map-side combine); only entity, time and
    a flag are sorted and numbered, see ``_numbered``; of the wide rows only those whose number is asked for are moved
    again. All joins are equi-joins on entity and number or time, which adaptive execution may split.
    """
    by_order = F.coalesce(order.cast("string"), F.lit(""))
    rows = attributes.select(*_entity(attribute_keys), known_time.alias(_TIME), by_order.alias("__order"), F.col(attribute_id).alias("id"), *[F.col(c).alias(c) for c in carry])
    asked = events.select(F.col(event_id), *_entity(event_keys), event_time.alias(_TIME))
    if dict(rows.dtypes)[_TIME] != "date" or dict(asked.dtypes)[_TIME] != "date":
        rows, asked = (x.withColumn(_TIME, F.col(_TIME).cast("timestamp")) for x in (rows, asked))
    rows, asked = rows.where(F.col(_TIME).isNotNull()), asked.where(F.col(_TIME).isNotNull())

    wide = F.struct("id", *carry)
    ends = F.array(F.min_by(wide, F.struct("__order", "id")), F.max_by(wide, F.struct(F.col("__order"), -F.col("id"))))
    versions = rows.groupBy(*_ENTITY, _TIME).agg(ends.alias("ends"))
    times = asked.select(*_ENTITY, _TIME).distinct()
    # The flag reads the wide column, so that both uses of ``versions`` share one exchange; the column itself stays behind.
    change = F.when(F.size("ends") > 0, 1).otherwise(0)
    timeline = versions.select(*_ENTITY, _TIME, change.alias("change")).unionByName(times.select(*_ENTITY, _TIME, F.lit(0).alias("change")))
    numbered = _numbered(timeline)
    at = numbered.where((F.col("change") == 0) & (F.col(_NO) > 0)).select(*_ENTITY, F.col(_TIME).alias("__at"), F.col(_NO).alias("__latest"))
    # Each time asks for two numbers, the first one's and its latest version's: one join serves both.
    asks = at.select(*_ENTITY, "__at", F.explode(F.array(F.struct(F.lit(0).alias("end"), F.lit(1).cast("bigint").alias(_NO)), F.struct(F.lit(1).alias("end"), F.col("__latest").alias(_NO)))).alias("w"))
    found = numbered.where("change = 1").select(*_ENTITY, _TIME, _NO).join(asks.select(*_ENTITY, "__at", "w.*"), [*_ENTITY, _NO])
    found = found.join(versions, [*_ENTITY, _TIME]).select(*_ENTITY, F.col("__at").alias(_TIME), "end", F.get("ends", F.col("end")).alias("row"))
    known = found.groupBy(*_ENTITY, _TIME).agg(F.first(F.when(F.col("end") == 0, F.col("row")), ignorenulls=True).alias("reported"), F.first(F.when(F.col("end") == 1, F.col("row")), ignorenulls=True).alias("restated"))
    return asked.join(known, [*_ENTITY, _TIME]).select(event_id, "reported", "restated")
