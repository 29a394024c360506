"""The filing index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The forms that report a year, and those that report any period.
ANNUAL_FORMS = ("10-K",)
PERIODIC_FORMS = ("10-K", "10-Q")


def of_forms(filings: DataFrame, forms: Sequence[str] = ANNUAL_FORMS) -> DataFrame:
    """Filings of the forms that say for which day they report."""
    return filings.where(F.col("form").isin(*forms) & F.col("report_date").isNotNull())


def latest_per_year(filings: DataFrame, years: int | None = None, forms: Sequence[str] = ANNUAL_FORMS) -> DataFrame:
    """Of each company and fiscal year (that of the report date) the latest filing, and of these the newest ``years``.

    Latest: by report date, then filing date, then accession. A filing delivered twice counts once.
    """
    order = [F.desc("report_date"), F.desc("filing_date"), F.desc("accession")]
    rows = of_forms(filings, forms).withColumn("fiscal_year", F.year("report_date"))
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy("cik", "fiscal_year").orderBy(*order))).where("__n = 1")
    if years is not None:
        rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy("cik").orderBy(*order))).where(F.col("__n") <= years)
    return rows.drop("__n")


def coverage_window(filings: DataFrame) -> DataFrame:
    """First and last filing date and number of different filings of each company."""
    return filings.groupBy("cik").agg(F.min("filing_date").alias("first_filed"), F.max("filing_date").alias("last_filed"), F.countDistinct("accession").alias("n_filings"))


def completeness(filings: DataFrame, unread_pages: DataFrame, years: int) -> DataFrame:
    """``cik``, ``n_years``, ``n_unread``, ``truncated``: fewer years than asked for although pages are left unread.

    A company that is short of years with nothing left unread is young, not truncated.
    """
    found = latest_per_year(filings, years).groupBy("cik").agg(F.count(F.lit(1)).alias("n_years"))
    pages = unread_pages.groupBy("cik").agg(F.count(F.lit(1)).alias("n_unread"))
    both = filings.select("cik").distinct().join(found, "cik", "left").join(pages, "cik", "left").fillna(0, ["n_years", "n_unread"])
    return both.withColumn("truncated", (F.col("n_years") < years) & (F.col("n_unread") > 0))
