"""Facts, concepts, coverage and the filing index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.ids import accession_digits, cik10, cik_for_archives, cik_for_facts
from tidemark.operators import facts as fa
from tidemark.operators import filings as fi
from tidemark.operators import financials as fn
from tidemark.plans.registry import Registry, table

query = Registry()
YEARS = (2016, 2026)

_CIK = "lpad(regexp_extract(upper(trim(cik)), '^(?:CIK[-_]?)?0*([0-9]{1,10})$', 1), 10, '0')"
_F = f"WITH f AS (SELECT * REPLACE ({_CIK} AS cik) FROM facts)"
_ANNUAL = "coalesce(date_diff('day', period_start, period_end) BETWEEN 330 AND 400, false)"
_FYE = f""", fye0 AS (SELECT cik, period_year, period_end, count(*) AS n FROM f WHERE period_type = 'duration' AND {_ANNUAL} GROUP BY ALL),
fye AS (SELECT cik, period_year, period_end AS fye FROM fye0 QUALIFY row_number() OVER (PARTITION BY cik, period_year ORDER BY n DESC, period_end DESC) = 1)"""
_CHOSEN = """, chosen AS (SELECT DISTINCT f.cik, f.period_year, c.concept, c.tag, c.tag_rank, c.unit, c.period_type
  FROM f JOIN concepts c ON f.tag = c.tag AND f.unit = c.unit AND f.period_type = c.period_type
  QUALIFY rank() OVER (PARTITION BY f.cik, f.period_year, c.concept ORDER BY c.tag_rank) = 1)"""
_VALUES = f""", r0 AS (SELECT f.*, c.concept, c.tag_rank, fye.fye, coalesce(f.period_end = fye.fye, false) AS fits
  FROM f JOIN chosen c USING (cik, period_year, tag, unit, period_type) LEFT JOIN fye USING (cik, period_year)
  WHERE f.period_type <> 'duration' OR {_ANNUAL}),
r1 AS (SELECT *, bool_or(fits) OVER w AS has_fit, max(period_end) OVER w AS last_end FROM r0 WINDOW w AS (PARTITION BY cik, period_year, concept)),
r2 AS (SELECT * FROM r1 WHERE CASE WHEN has_fit THEN fits WHEN period_type = 'duration' THEN true ELSE period_end = last_end END),
r3 AS (SELECT *, row_number() OVER (PARTITION BY cik, period_year, concept ORDER BY filed, accn, fact_id) AS a,
         row_number() OVER (PARTITION BY cik, period_year, concept ORDER BY filed DESC, accn DESC, fact_id DESC) AS z FROM r2),
vals AS (SELECT x.cik, x.period_year, x.concept, x.tag, x.tag_rank, y.val, 'as_restated' AS basis, x.val AS as_reported, y.val AS as_restated,
    x.val <> y.val AS restated, y.period_start, y.period_end, y.form, y.filed, y.accn
  FROM r3 x JOIN r3 y ON x.a = 1 AND y.z = 1 AND x.cik = y.cik AND x.period_year = y.period_year AND x.concept = y.concept)"""


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fa.with_keys(table(spark, sf_dir, "facts"))


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fn.concept_values(_facts(spark, sf_dir), table(spark, sf_dir, "concepts"))


@query(
    "facts_period_year",
    """SELECT fact_id, CAST(CASE WHEN period_start IS NULL OR year(period_start) = year(period_end) THEN year(period_end)
       WHEN 2 * dayofyear(period_end) >= date_diff('day', period_start, period_end) THEN year(period_end) ELSE year(period_start) END AS INTEGER) AS derived_year FROM facts""",
)
def facts_period_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "facts").select("fact_id", fa.period_year(F.col("period_start"), F.col("period_end")).alias("derived_year"))


@query(
    "facts_tags_present",
    f"{_F} SELECT c.cik, c.ticker, array_to_string(list_sort(list_distinct(coalesce(list(f.tag) FILTER (f.tag IS NOT NULL), []))), ' ') AS tags FROM companies c LEFT JOIN f ON c.cik = f.cik GROUP BY ALL",
)
def facts_tags_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fa.tags_present(_facts(spark, sf_dir), table(spark, sf_dir, "companies"))
    return found.select("cik", "ticker", F.array_join("tags", " ").alias("tags"))


@query(
    "facts_observations",
    f"""{_F} SELECT fact_id, cik, tag, unit, period_type, period_start, period_end, period_year, val, fy, fp, form, filed, accn FROM f
    WHERE unit = 'USD' AND period_type = 'duration' AND tag IN ('Revenues', 'NetIncomeLoss', 'NoninterestExpense') AND period_year BETWEEN 2018 AND 2022""",
)
def facts_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fa.observations(_facts(spark, sf_dir), unit="USD", period_type="duration", tags=["Revenues", "NetIncomeLoss", "NoninterestExpense"], years=(2018, 2022))
    return rows.select("fact_id", "cik", "tag", "unit", "period_type", "period_start", "period_end", "period_year", "val", "fy", "fp", "form", "filed", "accn").orderBy("period_end", "filed")


@query("facts_fiscal_year_end", f"{_F}{_FYE} SELECT * FROM fye")
def facts_fiscal_year_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fa.fiscal_year_ends(_facts(spark, sf_dir))


@query(
    "facts_annual",
    f"""{_F}{_FYE}, a AS (SELECT f.*, coalesce(f.period_end = fye.fye, false) AS fits FROM f LEFT JOIN fye USING (cik, period_year) WHERE period_type <> 'duration' OR {_ANNUAL}),
    b AS (SELECT *, bool_or(fits) OVER w AS has_fit, max(period_end) OVER w AS last_end FROM a WINDOW w AS (PARTITION BY cik, tag, unit, period_type, period_year))
    SELECT fact_id FROM b WHERE CASE WHEN has_fit THEN fits WHEN period_type = 'duration' THEN true ELSE period_end = last_end END""",
)
def facts_annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _facts(spark, sf_dir)
    return fa.select_annual(facts, fa.fiscal_year_ends(facts), ["cik", "tag", "unit", "period_type", "period_year"]).select("fact_id")


@query(
    "facts_restatement",
    f"""{_F}, o AS (SELECT *, row_number() OVER (w ORDER BY filed, accn, fact_id) AS a, row_number() OVER (w ORDER BY filed DESC, accn DESC, fact_id DESC) AS z
      FROM f WINDOW w AS (PARTITION BY cik, tag, unit, period_start, period_end))
    SELECT x.cik, x.tag, x.unit, x.period_start, x.period_end, x.val AS as_reported, y.val AS as_restated, x.val <> y.val AS restated, x.filed AS first_filed, x.accn AS first_accn, y.filed AS last_filed, y.accn AS last_accn
    FROM o x JOIN o y ON x.a = 1 AND y.z = 1 AND x.cik = y.cik AND x.tag = y.tag AND x.unit = y.unit AND x.period_start IS NOT DISTINCT FROM y.period_start AND x.period_end = y.period_end""",
)
def facts_restatement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fa.restatement(_facts(spark, sf_dir), ["cik", "tag", "unit", "period_start", "period_end"])


@query(
    "ingest_report",
    f"""{_F}, l AS (SELECT cik, count(*) AS n_rows, count(DISTINCT (taxonomy, tag)) AS n_tags, min(period_year) AS first_year, max(period_year) AS last_year FROM f GROUP BY cik)
    SELECT c.ticker, coalesce(n_rows, 0) AS n_rows, coalesce(n_tags, 0) AS n_tags, first_year, last_year, coalesce(n_rows, 0) = 0 AS is_empty FROM companies c LEFT JOIN l USING (cik)""",
)
def ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fa.ingest_report(_facts(spark, sf_dir), table(spark, sf_dir, "companies"))
    return found.select("ticker", "n_rows", "n_tags", "first_year", "last_year", "is_empty")


@query("concepts_first_available", f"{_F}{_CHOSEN} SELECT cik, period_year, concept, tag, tag_rank FROM chosen")
def concepts_first_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fn.resolve_concepts(_facts(spark, sf_dir), table(spark, sf_dir, "concepts")).select("cik", "period_year", "concept", "tag", "tag_rank")


@query("financials_values", f"{_F}{_FYE}{_CHOSEN}{_VALUES} SELECT * FROM vals")
def financials_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, sf_dir)


@query(
    "financials_unavailable",
    f"""{_F}{_FYE}{_CHOSEN}{_VALUES}, asked AS (SELECT cik, concept, period_year FROM companies, (SELECT DISTINCT concept FROM concepts), (SELECT unnest([2020, 2021, 2022]) AS period_year))
    SELECT a.cik, a.concept, a.period_year, CASE WHEN c.tag IS NOT NULL THEN 'no annual period' ELSE 'no candidate tag' END AS reason
    FROM asked a LEFT JOIN vals v USING (cik, concept, period_year) LEFT JOIN chosen c USING (cik, concept, period_year) WHERE v.tag IS NULL""",
)
def financials_unavailable(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, concepts = _facts(spark, sf_dir), table(spark, sf_dir, "concepts")
    return fn.unavailable(fn.concept_values(facts, concepts), fn.resolve_concepts(facts, concepts), table(spark, sf_dir, "companies"), concepts, [2020, 2021, 2022])


@query(
    "financials_warnings",
    f"""{_F}{_FYE}{_CHOSEN}{_VALUES}, w AS (SELECT concept, period_year, count(*) AS n_values, date_diff('day', min(period_end), max(period_end)) AS days_apart, count(DISTINCT tag) AS n_tags FROM vals GROUP BY ALL)
    SELECT *, n_values > 1 AND days_apart > 45 AS misaligned, n_tags > 1 AS mixed_tags FROM w""",
)
def financials_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fn.comparability(_values(spark, sf_dir))


_CELLS = f"""{_F}, s AS (SELECT DISTINCT f.cik, c.concept, c.tag, c.tag_rank FROM f JOIN concepts c ON f.tag = c.tag AND f.unit = c.unit AND f.period_type = c.period_type
  WHERE f.period_year BETWEEN 2016 AND 2026 QUALIFY rank() OVER (PARTITION BY f.cik, c.concept ORDER BY c.tag_rank) = 1),
cells AS (SELECT k.ticker, d.concept, d.applies_to <> 'lenders' OR coalesce(k.lender, false) AS in_scope, s.tag, s.tag_rank
  FROM companies k CROSS JOIN (SELECT DISTINCT concept, applies_to FROM concepts) d LEFT JOIN s ON s.cik = k.cik AND s.concept = d.concept)"""


@query(
    "coverage_report",
    f"""{_CELLS} SELECT concept, count(*) AS n_scope, count(tag_rank) AS n_resolved, count(*) FILTER (tag_rank > 0) AS n_fallback,
    coalesce(array_to_string(list_sort(list(ticker) FILTER (tag_rank IS NULL)), ' '), '') AS missing, coalesce(array_to_string(list_sort(list(DISTINCT tag) FILTER (tag IS NOT NULL)), ' '), '') AS tags FROM cells WHERE in_scope GROUP BY concept""",
)
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fn.coverage(_facts(spark, sf_dir), table(spark, sf_dir, "concepts"), table(spark, sf_dir, "companies"), YEARS)


# The concepts of the registry, which are the columns of the grid.
_CONCEPTS = ("assets_total", "debt_total", "deposit_total", "equity_total", "loss_allowance", "loss_provision", "opex_total", "profit_net", "revenue_total")


@query(
    "coverage_matrix",
    f"{_CELLS} SELECT ticker, "
    + ", ".join(f"max(CASE WHEN NOT in_scope THEN 'n/a' ELSE coalesce(CAST(tag_rank AS VARCHAR), '.') END) FILTER (concept = '{c}') AS {c}" for c in _CONCEPTS)
    + " FROM cells GROUP BY ticker",
)
def coverage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = fn.coverage_cells(_facts(spark, sf_dir), table(spark, sf_dir, "concepts"), table(spark, sf_dir, "companies"), YEARS)
    return fn.coverage_grid(cells, _CONCEPTS)


_LATEST = """WITH l AS (SELECT *, CAST(year(report_date) AS INTEGER) AS fiscal_year FROM filings WHERE form = '10-K' AND report_date IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY cik, year(report_date) ORDER BY report_date DESC, filing_date DESC, accession DESC) = 1),
n AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY cik ORDER BY report_date DESC, filing_date DESC, accession DESC) <= 3)"""


@query("filings_latest_per_year", f"{_LATEST} SELECT cik, accession, fiscal_year, report_date, filing_date FROM n")
def filings_latest_per_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fi.latest_per_year(table(spark, sf_dir, "filings"), 3).select("cik", "accession", "fiscal_year", "report_date", "filing_date")


@query("filings_coverage_window", "SELECT cik, min(filing_date) AS first_filed, max(filing_date) AS last_filed, count(DISTINCT accession) AS n_filings FROM filings GROUP BY cik")
def filings_coverage_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fi.coverage_window(table(spark, sf_dir, "filings"))


@query(
    "filings_completeness",
    f"""{_LATEST}, c AS (SELECT cik, count(*) AS n_years FROM n GROUP BY cik),
    p AS (SELECT cik, count(*) AS n_unread FROM (SELECT DISTINCT cik, year(filing_date) AS y FROM filings WHERE report_date IS NULL) GROUP BY cik),
    k AS (SELECT DISTINCT cik FROM filings)
    SELECT k.cik, coalesce(n_years, 0) AS n_years, coalesce(n_unread, 0) AS n_unread, coalesce(n_years, 0) < 3 AND coalesce(n_unread, 0) > 0 AS truncated FROM k LEFT JOIN c USING (cik) LEFT JOIN p USING (cik)""",
)
def filings_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years with filings of an unknown report date stand for pages of the history that are still to be read."""
    filings = table(spark, sf_dir, "filings")
    pages = filings.where("report_date IS NULL").select("cik", F.year("filing_date").alias("page")).distinct()
    return fi.completeness(filings, pages, 3)


@query("filings_periodic", "SELECT form, CAST(year(report_date) AS INTEGER) AS fiscal_year, count(DISTINCT accession) AS n FROM filings WHERE form IN ('10-K', '10-Q') AND report_date IS NOT NULL GROUP BY ALL")
def filings_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fi.of_forms(table(spark, sf_dir, "filings"), fi.PERIODIC_FORMS)
    return rows.groupBy("form", F.year("report_date").alias("fiscal_year")).agg(F.countDistinct("accession").alias("n"))


@query(
    "cik_renderings",
    f"SELECT fact_id, {_CIK} AS cik, 'CIK' || {_CIK} AS facts_cik, CAST(CAST({_CIK} AS BIGINT) AS VARCHAR) AS archives_cik, replace(trim(accn), '-', '') AS accn_digits FROM facts",
)
def cik_renderings(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "facts")
    return facts.select("fact_id", cik10("cik").alias("cik"), cik_for_facts("cik").alias("facts_cik"), cik_for_archives("cik").alias("archives_cik"), accession_digits("accn").alias("accn_digits"))
