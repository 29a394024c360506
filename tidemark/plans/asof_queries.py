"""Problem 1: answers as they were known on their day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.ids import cik10
from tidemark.operators.asof import attributes_as_of
from tidemark.plans.registry import Registry, table

query = Registry()

_CIK = "lpad(regexp_extract(upper(trim({0}.cik)), '^(?:CIK[-_]?)?0*([0-9]{{1,10}})$', 1), 10, '0')"
_KNOWN = f"""
WITH f AS (SELECT {_CIK.format('facts')} AS c, * FROM facts WHERE filed IS NOT NULL),
v AS (SELECT value_id, {_CIK.format('concept_values')} AS c, tag, unit, period_start, period_end,
             CAST(answered_at AS DATE) AS day FROM concept_values),
m AS (SELECT v.value_id, f.fact_id, f.val, f.filed, f.accn,
        row_number() OVER (PARTITION BY v.value_id ORDER BY f.filed, f.accn, f.fact_id) AS r1,
        row_number() OVER (PARTITION BY v.value_id ORDER BY f.filed DESC, f.accn DESC, f.fact_id) AS r2
      FROM v JOIN f ON v.c = f.c AND v.tag = f.tag AND v.unit = f.unit AND v.period_end = f.period_end
        AND v.period_start IS NOT DISTINCT FROM f.period_start AND f.filed <= v.day)
"""


def _as_known(spark: SparkSession, sf_dir: str, carry: tuple[str, ...]) -> DataFrame:
    keys = [cik10("cik"), F.col("tag"), F.col("unit"), F.col("period_start"), F.col("period_end")]
    whole = cik10("cik").isNotNull() & F.col("tag").isNotNull() & F.col("unit").isNotNull() & F.col("period_end").isNotNull()
    return attributes_as_of(
        table(spark, sf_dir, "concept_values").where(whole),
        table(spark, sf_dir, "facts").where(whole),
        event_keys=keys,
        attribute_keys=keys,
        event_id="value_id",
        event_time=F.to_date("answered_at"),
        known_time=F.to_date("filed"),
        order=F.col("accn"),
        attribute_id="fact_id",
        carry=carry,
    )


@query(
    "p1_found",
    _KNOWN
    + "SELECT value_id, max(fact_id) FILTER (r1 = 1) AS reported_fact_id, max(fact_id) FILTER (r2 = 1) AS restated_fact_id FROM m GROUP BY value_id",
)
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _as_known(spark, sf_dir, ())
    return known.select("value_id", F.col("reported.id").alias("reported_fact_id"), F.col("restated.id").alias("restated_fact_id"))


@query(
    "p1_values",
    _KNOWN
    + """SELECT value_id, max(val) FILTER (r1 = 1) AS as_reported, max(val) FILTER (r2 = 1) AS as_restated,
       max(val) FILTER (r1 = 1) <> max(val) FILTER (r2 = 1) AS restated, max(filed) FILTER (r2 = 1) AS last_filed
       FROM m GROUP BY value_id""",
)
def p1_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both amounts of each answer and whether they differ, from what had been filed by its day."""
    known = _as_known(spark, sf_dir, ("val", "filed"))
    return known.select(
        "value_id",
        F.col("reported.val").alias("as_reported"),
        F.col("restated.val").alias("as_restated"),
        (F.col("reported.val") != F.col("restated.val")).alias("restated"),
        F.col("restated.filed").alias("last_filed"),
    )
