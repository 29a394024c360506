from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import facts as fa
from tidemark.operators import filings as fi
from tidemark.operators import financials as fn

D = dt.date
FACTS = "fact_id bigint, cik string, taxonomy string, tag string, unit string, period_type string, period_start date, period_end date, period_year int, val double, form string, filed date, accn string"
C = "0000000001"


def duration(n, tag, start, end, val, filed, accn="a", year=2024, cik=C):
    return (n, cik, "t", tag, "USD", "duration", start, end, year, val, "10-K", filed, accn)


def instant(n, tag, end, val, filed, year=2024, cik=C):
    return (n, cik, "t", tag, "USD", "instant", None, end, year, val, "10-K", filed, "a")


CONCEPTS = [("rev", "all", "USD", "duration", 0, "Revenues"), ("rev", "all", "USD", "duration", 1, "Sales"), ("debt", "lenders", "USD", "instant", 0, "Debt")]


@pytest.fixture(scope="module")
def concepts(spark):
    return spark.createDataFrame(CONCEPTS, "concept string, applies_to string, unit string, period_type string, tag_rank int, tag string")


def values(spark, concepts, rows, **how):
    out = fn.concept_values(spark.createDataFrame(rows, FACTS), concepts, **how)
    return {(r["cik"], r["concept"]): r for r in out.collect()}


@pytest.mark.parametrize(
    ("start", "end", "year"),
    [
        (None, D(2024, 12, 31), 2024),
        (D(2024, 1, 1), D(2024, 12, 31), 2024),
        (D(2023, 10, 1), D(2024, 9, 30), 2024),
        (D(2023, 12, 1), D(2024, 11, 30), 2024),
        (D(2023, 2, 1), D(2024, 1, 31), 2023),
        (D(2023, 12, 1), D(2024, 2, 29), 2024),
    ],
)
def test_period_year(spark, start, end, year):
    row = spark.createDataFrame([(start, end)], "s date, e date").select(fa.period_year(F.col("s"), F.col("e"))).first()
    assert row[0] == year


def test_annual_over_quarterly_and_restated(spark, concepts):
    rows = [
        duration(1, "Revenues", D(2024, 10, 1), D(2024, 12, 31), 25.0, D(2025, 2, 1)),
        duration(2, "Revenues", D(2024, 1, 1), D(2024, 12, 31), 98.0, D(2025, 2, 1)),
        duration(3, "Revenues", D(2024, 1, 1), D(2024, 12, 31), 102.0, D(2026, 2, 1)),
    ]
    r = values(spark, concepts, rows)[C, "rev"]
    assert (r["as_reported"], r["as_restated"], r["restated"], r["val"], r["filed"]) == (98.0, 102.0, True, 102.0, D(2026, 2, 1))
    r = values(spark, concepts, rows, basis="as_reported")[C, "rev"]
    assert (r["val"], r["filed"]) == (98.0, D(2025, 2, 1))
    with pytest.raises(ValueError):
        values(spark, concepts, rows, basis="other")


def test_refiled_unchanged_is_not_restated(spark, concepts):
    rows = [duration(n, "Revenues", D(2024, 1, 1), D(2024, 12, 31), 5.0, D(2025 + n, 1, 1)) for n in (0, 1)]
    assert values(spark, concepts, rows)[C, "rev"]["restated"] is False


def test_instant_takes_fiscal_year_end(spark, concepts):
    rows = [
        duration(1, "Revenues", D(2023, 10, 1), D(2024, 9, 30), 1.0, D(2024, 11, 1)),
        instant(2, "Debt", D(2024, 9, 30), 20.0, D(2024, 11, 1)),
        instant(3, "Debt", D(2024, 12, 31), 99.0, D(2025, 2, 1)),
        instant(4, "Debt", D(2024, 3, 31), 7.0, D(2025, 2, 1), cik="0000000002"),
        instant(5, "Debt", D(2024, 6, 30), 8.0, D(2025, 2, 1), cik="0000000002"),
    ]
    found = values(spark, concepts, rows)
    assert found[C, "debt"]["val"] == 20.0
    assert found["0000000002", "debt"]["val"] == 8.0


def test_preferred_tag_with_quarters_only_has_no_value(spark, concepts):
    rows = [
        duration(1, "Revenues", D(2024, 10, 1), D(2024, 12, 31), 25.0, D(2025, 2, 1)),
        duration(2, "Sales", D(2024, 1, 1), D(2024, 12, 31), 100.0, D(2025, 2, 1)),
    ]
    facts = spark.createDataFrame(rows, FACTS)
    vals, resolved = fn.concept_values(facts, concepts), fn.resolve_concepts(facts, concepts)
    assert vals.count() == 0
    companies = spark.createDataFrame([(C,)], "cik string")
    why = {r["concept"]: r["reason"] for r in fn.unavailable(vals, resolved, companies, concepts, [2024]).collect()}
    assert why == {"rev": "no annual period", "debt": "no candidate tag"}


def test_fiscal_year_end_mode_and_tie(spark):
    rows = [duration(n, f"T{n}", D(2023, 1, 1 + n % 2), D(2023, 12, 30 + n % 2), 1.0, D(2024, 2, 1), year=2023) for n in range(4)]
    got = fa.fiscal_year_ends(spark.createDataFrame(rows, FACTS)).collect()
    assert [(r["period_year"], r["fye"]) for r in got] == [(2023, D(2023, 12, 31))]


def test_warnings_and_coverage(spark, concepts):
    rows = [
        duration(1, "Revenues", D(2024, 1, 1), D(2024, 12, 31), 1.0, D(2025, 2, 1)),
        duration(2, "Sales", D(2023, 10, 1), D(2024, 9, 30), 1.0, D(2025, 2, 1), cik="0000000002"),
    ]
    facts = spark.createDataFrame(rows, FACTS)
    w = fn.comparability(fn.concept_values(facts, concepts)).first()
    assert (w["days_apart"], w["misaligned"], w["mixed_tags"]) == (92, True, True)
    companies = spark.createDataFrame([(C, "A", True), ("0000000002", "B", None)], "cik string, ticker string, lender boolean")
    got = {r["concept"]: r for r in fn.coverage(facts, concepts, companies, (2022, 2025)).collect()}
    assert (got["rev"]["n_scope"], got["rev"]["n_resolved"], got["rev"]["n_fallback"]) == (2, 2, 1)
    assert (got["debt"]["n_scope"], got["debt"]["missing"]) == (1, "A")
    grid = {r["ticker"]: r for r in fn.coverage_grid(fn.coverage_cells(facts, concepts, companies, (2022, 2025)), ["rev", "debt"]).collect()}
    assert (grid["A"]["rev"], grid["A"]["debt"], grid["B"]["rev"], grid["B"]["debt"]) == ("0", ".", "1", "n/a")


def test_observations_and_tags(spark):
    rows = [duration(1, "Revenues", D(2024, 1, 1), D(2024, 12, 31), 1.0, D(2025, 1, 1)), instant(2, "Debt", D(2024, 12, 31), 2.0, D(2025, 1, 1))]
    facts = spark.createDataFrame(rows, FACTS)
    assert [r["fact_id"] for r in fa.observations(facts, unit="USD", period_type="instant", ciks=[C], year=2024).collect()] == [2]
    companies = spark.createDataFrame([(C,), ("0000000009",)], "cik string")
    assert {r["cik"]: r["tags"] for r in fa.tags_present(facts, companies).collect()} == {C: ["Debt", "Revenues"], "0000000009": []}


def test_filing_index(spark):
    rows = [
        ("1", "a", "10-K", D(2024, 2, 1), D(2023, 12, 31)),
        ("1", "b", "10-K", D(2024, 6, 1), D(2023, 12, 31)),
        ("1", "b", "10-K", D(2024, 6, 1), D(2023, 12, 31)),
        ("1", "c", "10-K", D(2023, 2, 1), D(2022, 12, 31)),
        ("1", "d", "10-Q", D(2025, 5, 1), D(2025, 3, 31)),
        ("1", "e", "10-K", D(2022, 2, 1), None),
        ("2", "f", "10-K", D(2024, 2, 1), D(2023, 12, 31)),
    ]
    filings = spark.createDataFrame(rows, "cik string, accession string, form string, filing_date date, report_date date")
    assert sorted(r["accession"] for r in fi.latest_per_year(filings, 2).collect()) == ["b", "c", "f"]
    pages = spark.createDataFrame([("1", "p1")], "cik string, name string")
    got = {r["cik"]: r["truncated"] for r in fi.completeness(filings, pages, 3).collect()}
    assert got == {"1": True, "2": False}  # young, not truncated


def test_partition_filters_and_no_python(spark, tmp_path):
    from tidemark.sources.tables import read_facts, write_facts

    rows = [duration(1, "Revenues", D(2024, 1, 1), D(2024, 12, 31), 1.0, D(2025, 1, 1)), duration(2, "Revenues", D(2023, 1, 1), D(2023, 12, 31), 1.0, D(2024, 1, 1), year=2023)]
    facts = spark.createDataFrame(rows, FACTS).drop("fact_id").withColumns({"fy": F.lit(1), "fp": F.lit("FY"), "frame": F.lit(None).cast("string")})
    write_facts(facts, str(tmp_path / "f"))
    back = read_facts(spark, str(tmp_path / "f"))
    plan = fa.observations(back, unit="USD", period_type="duration", year=2024)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(period_year" in plan and "Python" not in plan
    assert back.where("period_year = 2024").first()["cik"] == C  # zeros kept
    write_facts(facts.where("period_year = 2024").withColumn("val", F.lit(9.0)), str(tmp_path / "f"))
    assert sorted((r["period_year"], r["val"]) for r in read_facts(spark, str(tmp_path / "f")).collect()) == [(2023, 1.0), (2024, 9.0)]
