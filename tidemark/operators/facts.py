"""The fact table: derived years, annual periods, restatements and the reports made of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ids import cik10

# Days that a fiscal year may last, and days that compared periods may lie apart.
ANNUAL_DAYS = (330, 400)
ALIGNED_DAYS = 45


def period_year(start: Column, end: Column) -> Column:
    """The year that holds most of a period; instants and periods within one year have the year of their end."""
    one_year = start.isNull() | (F.year(start) == F.year(end))
    mostly_last = 2 * F.dayofyear(end) >= F.datediff(end, start)
    return F.when(one_year | mostly_last, F.year(end)).otherwise(F.year(start))


def period_days(start: Column, end: Column) -> Column:
    return F.datediff(end, start)


def is_annual(start: str | Column = "period_start", end: str | Column = "period_end") -> Column:
    """Whether a period lasts a fiscal year; false for instants."""
    start, end = (F.col(c) if isinstance(c, str) else c for c in (start, end))
    return F.coalesce(period_days(start, end).between(*ANNUAL_DAYS), F.lit(False))


def with_keys(facts: DataFrame) -> DataFrame:
    """Facts with company keys in their one rendering; rows without such a key are dropped."""
    return facts.withColumn("cik", cik10("cik")).where(F.col("cik").isNotNull())


def observations(
    facts: DataFrame,
    *,
    unit: str,
    period_type: str,
    ciks: Sequence[str] | None = None,
    tags: Sequence[str] | None = None,
    years: tuple[int, int] | None = None,
    year: int | None = None,
) -> DataFrame:
    """Rows of one unit and period type, which are never optional, and of whatever else is asked for."""
    rows = facts.where((F.col("unit") == unit) & (F.col("period_type") == period_type))
    if ciks is not None:
        rows = rows.where(F.col("cik").isin(*ciks))
    if tags is not None:
        rows = rows.where(F.col("tag").isin(*tags))
    if years is not None:
        rows = rows.where(F.col("period_year").between(*years))
    if year is not None:
        rows = rows.where(F.col("period_year") == year)
    return rows


def tags_present(facts: DataFrame, companies: DataFrame) -> DataFrame:
    """Each company with its different tags; one without facts has an empty list."""
    tags = facts.groupBy("cik").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    return companies.join(tags, "cik", "left").withColumn("tags", F.coalesce("tags", F.expr("cast(array() as array<string>)")))


def fiscal_year_ends(facts: DataFrame) -> DataFrame:
    """``cik``, ``period_year``, ``fye``: the day on which most annual rows of a company and year end, the later among equals."""
    counted = facts.where(is_annual() & (F.col("period_type") == "duration")).groupBy("cik", "period_year", "period_end").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("cik", "period_year").agg(F.max_by("period_end", F.struct("n", "period_end")).alias("fye"))


def select_annual(rows: DataFrame, ends: DataFrame, keys: Sequence[str], prefer: str | None = None) -> DataFrame:
    """Of each group of ``keys`` (with ``cik`` and ``period_year``) the rows of the annual period.

    If there is a ``prefer``, only rows with its least value in the group count, annual or not. Durations: annual rows, those ending on the fiscal year end if there are any, else all. Instants: those of the
    fiscal year end if there are any, else those of the latest day.
    """
    joined, w = rows.join(ends, ["cik", "period_year"], "left"), Window.partitionBy(*keys)
    if prefer is not None:
        joined = joined.withColumn("__least", F.min(prefer).over(w)).where(F.col(prefer) == F.col("__least")).drop("__least")
    fits = F.coalesce(F.col("period_end") == F.col("fye"), F.lit(False))
    joined = joined.where((F.col("period_type") != "duration") | is_annual()).withColumn("__fits", fits)
    joined = joined.withColumn("__any", F.max("__fits").over(w)).withColumn("__last", F.max("period_end").over(w))
    instead = F.when(F.col("period_type") == "duration", F.lit(True)).otherwise(F.col("period_end") == F.col("__last"))
    return joined.where(F.when(F.col("__any"), F.col("__fits")).otherwise(instead)).drop("__fits", "__any", "__last")


def restatement(rows: DataFrame, keys: Sequence[str], carry: Sequence[str] = ("val", "filed", "accn")) -> DataFrame:
    """First and last report of each group of ``keys``, by ``filed``, then ``accn``, then ``fact_id`` (without one, ``val``)."""
    order, what = F.struct("filed", "accn", "fact_id" if "fact_id" in rows.columns else "val"), F.struct(*carry)
    ends = rows.groupBy(*keys).agg(F.min_by(what, order).alias("a"), F.max_by(what, order).alias("z"))
    return ends.select(
        *keys,
        F.col("a.val").alias("as_reported"),
        F.col("z.val").alias("as_restated"),
        (F.col("a.val") != F.col("z.val")).alias("restated"),
        *[F.col(f"{s}.{c}").alias(f"{n}_{c}") for s, n in (("a", "first"), ("z", "last")) for c in carry if c != "val"],
    )


def ingest_report(facts: DataFrame, companies: DataFrame) -> DataFrame:
    """For each company the rows, different tags and years that were loaded; zero and null where none were."""
    loaded = facts.groupBy("cik").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("taxonomy", "tag").alias("n_tags"), F.min("period_year").alias("first_year"), F.max("period_year").alias("last_year")
    )
    joined = companies.join(loaded, "cik", "left")
    return joined.withColumn("n_rows", F.coalesce("n_rows", F.lit(0))).withColumn("n_tags", F.coalesce("n_tags", F.lit(0))).withColumn("is_empty", F.col("n_rows") == 0)
