"""Business concepts: the tag each company reports, annual values on both bases, warnings and coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.facts import ALIGNED_DAYS, fiscal_year_ends, restatement, select_annual


def resolve_concepts(facts: DataFrame, concepts: DataFrame) -> DataFrame:
    """``cik``, ``period_year``, ``concept``, ``tag``, ``tag_rank``: the candidate of the lowest rank with any row in the year.

    A tag counts as present before annual periods are selected, so a preferred tag with quarterly rows only is not
    passed over. ``concepts`` is the registry, a few rows for each concept.
    """
    present = facts.select("cik", "period_year", "tag", "unit", "period_type").distinct()
    candidates = concepts.select("concept", "unit", "period_type", "tag_rank", "tag")
    least = present.join(candidates, ["tag", "unit", "period_type"]).groupBy("cik", "period_year", "concept").agg(F.min("tag_rank").alias("tag_rank"))
    return least.join(candidates, ["concept", "tag_rank"]).select("cik", "period_year", "concept", "tag", "tag_rank", "unit", "period_type")


def concept_values(facts: DataFrame, concepts: DataFrame, basis: str = "as_restated") -> DataFrame:
    """One row for each company, year and concept with an annual period: both values, and period, form and filing of the basis."""
    if basis not in ("as_reported", "as_restated"):
        raise ValueError(f"basis must be as_reported or as_restated, not {basis!r}")
    # As ``resolve_concepts``, but of the rows themselves: they are brought together by company and year once, for all that follows.
    rows = facts.join(concepts.select("concept", "unit", "period_type", "tag_rank", "tag"), ["tag", "unit", "period_type"])
    keys = ["cik", "period_year", "concept", "tag", "tag_rank"]
    annual = select_annual(rows, fiscal_year_ends(facts), ["cik", "period_year", "concept"], prefer="tag_rank")
    both = restatement(annual, keys, ("val", "period_start", "period_end", "form", "filed", "accn"))
    end = "first" if basis == "as_reported" else "last"
    return both.select(
        *keys, F.col(basis).alias("val"), F.lit(basis).alias("basis"), "as_reported", "as_restated", "restated", *[F.col(f"{end}_{c}").alias(c) for c in ("period_start", "period_end", "form", "filed", "accn")]
    )


def unavailable(values: DataFrame, resolved: DataFrame, companies: DataFrame, concepts: DataFrame, years: Sequence[int]) -> DataFrame:
    """Company, concept and year without a value, and why. Companies and concepts are dimensions; their product with the years is the question itself."""
    asked = companies.select("cik").crossJoin(concepts.select("concept").distinct()).withColumn("period_year", F.explode(F.array(*[F.lit(y) for y in years])))
    found = values.select("cik", "concept", "period_year", F.lit(True).alias("has_value"))
    tagged = resolved.select("cik", "concept", "period_year", F.lit(True).alias("has_tag"))
    keys = ["cik", "concept", "period_year"]
    rows = asked.join(found, keys, "left").join(tagged, keys, "left").where("has_value IS NULL")
    return rows.select(*keys, F.when(F.col("has_tag"), "no annual period").otherwise("no candidate tag").alias("reason"))


def comparability(values: DataFrame) -> DataFrame:
    """For each concept and year over its companies: days between the first and the last period end, and different tags, with a flag for each."""
    per = values.groupBy("concept", "period_year").agg(
        F.count(F.lit(1)).alias("n_values"), F.datediff(F.max("period_end"), F.min("period_end")).alias("days_apart"), F.countDistinct("tag").alias("n_tags")
    )
    return per.withColumn("misaligned", (F.col("n_values") > 1) & (F.col("days_apart") > ALIGNED_DAYS)).withColumn("mixed_tags", F.col("n_tags") > 1)


def coverage(facts: DataFrame, concepts: DataFrame, companies: DataFrame, years: tuple[int, int]) -> DataFrame:
    """``concept``, ``n_scope``, ``n_resolved``, ``n_fallback``, ``missing``, ``tags``: how far the companies in a concept's scope report any of its tags.

    Tags are looked for over all ``years`` together. The scope of ``lenders`` is the companies that are known to be.
    """
    cells = coverage_cells(facts, concepts, companies, years).where("in_scope")
    return cells.groupBy("concept").agg(
        F.count(F.lit(1)).alias("n_scope"),
        F.count("tag_rank").alias("n_resolved"),
        F.count(F.when(F.col("tag_rank") > 0, 1)).alias("n_fallback"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("tag_rank").isNull(), F.col("ticker")))), " ").alias("missing"),
        F.array_join(F.array_sort(F.collect_set("tag")), " ").alias("tags"),
    )


def coverage_cells(facts: DataFrame, concepts: DataFrame, companies: DataFrame, years: tuple[int, int]) -> DataFrame:
    """One row for each company and concept: whether it is in scope, and the rank and tag it resolves to."""
    found = resolve_concepts(facts.where(F.col("period_year").between(*years)).withColumn("period_year", F.lit(0)), concepts).drop("period_year", "unit", "period_type")
    scope = concepts.select("concept", "applies_to").distinct()
    grid = companies.select("cik", "ticker", F.coalesce("lender", F.lit(False)).alias("lender")).crossJoin(scope)
    grid = grid.withColumn("in_scope", (F.col("applies_to") != "lenders") | F.col("lender"))
    return grid.join(found, ["cik", "concept"], "left").select("cik", "ticker", "concept", "in_scope", "tag", "tag_rank")


def coverage_grid(cells: DataFrame, concepts: Sequence[str]) -> DataFrame:
    """Companies by concepts: the rank of the tag, ``.`` where none is reported, ``n/a`` out of scope."""
    cell = F.when(~F.col("in_scope"), F.lit("n/a")).otherwise(F.coalesce(F.col("tag_rank").cast("string"), F.lit(".")))
    return cells.withColumn("cell", cell).groupBy("ticker").pivot("concept", list(concepts)).agg(F.first("cell"))
