"""Sections that pages of a cross-reference table or referrals declare, in filings laid out around each accession number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import adjudicate as ad
from tidemark.operators import kernels as ke
from tidemark.plans.registry import Registry, table
from tidemark.session import spread

query = Registry()

_TABLE = "Item 1.\\nBusiness\\n3 - 5, 8\\nItem 1A.\\nRisk Factors\\n6\\nItem 3.\\nLegal Proceedings\\n7\\nItem 7.\\nDiscussion\\n9\\nItem 7A.\\nNot applicable\\nItem 8.\\nStatements\\n10 - 12,\\n14\\n"
# From 21 to 51 pages, with a number in the text of page 4 that is none, and two titles.
_PAGES = """n AS (SELECT accession, max(20 + coalesce(day(filing_date), 1)) AS pages FROM filings WHERE accession IS NOT NULL GROUP BY accession),
    k AS (SELECT accession, unnest(range(1, pages + 1)) AS k FROM n),
    b AS (SELECT accession, k, {first} 'Text of page ' || k || ' of ' || accession || '.' || CASE k WHEN 4 THEN e'\\n999\\nand on' WHEN 6 THEN e'\\nMarket Risk (continued)\\nAll about it.' WHEN 9 THEN e'\\nCapital\\nOther.' ELSE '' END AS body FROM k),
    c AS (SELECT *, CAST(sum(length(body) + length(CAST(k AS VARCHAR)) + 2) OVER (PARTITION BY accession ORDER BY k) AS BIGINT) AS upto FROM b)"""


def _pages(first: Column) -> Column:
    """The pages of a filing as one text, each with its number on a line at its end; ``first`` stands before the text of the first one."""

    def page(k: Column) -> Column:
        more = F.when(k == 4, "\n999\nand on").when(k == 6, "\nMarket Risk (continued)\nAll about it.").when(k == 9, "\nCapital\nOther.").otherwise("")
        return F.concat(F.when(k == 1, first).otherwise(""), F.lit("Text of page "), k.cast("string"), F.lit(" of "), F.col("accession"), F.lit("."), more, F.lit("\n"), k.cast("string"), F.lit("\n"))

    return F.array_join(F.transform(F.sequence(F.lit(1), F.col("pages")), page), "")


def _filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "filings").where("accession IS NOT NULL").select("accession", "filing_date"))
    return rows.groupBy("accession").agg(F.max(20 + F.coalesce(F.dayofmonth("filing_date"), F.lit(1))).alias("pages"))


_FIRST = "CASE k WHEN 1 THEN e'" + _TABLE + "' ELSE '' END ||"


@query(
    "sections_paged",
    f"""WITH {_PAGES.format(first=_FIRST)}, r AS (SELECT * FROM (VALUES ('1', 0, 3, 5), ('1', 1, 8, 8), ('1A', 0, 6, 6), ('3', 0, 7, 7), ('7', 0, 9, 9), ('8', 0, 10, 12), ('8', 1, 14, 14)) AS r(item, span_no, f, l)),
    s AS (SELECT c.accession, item, span_no, x.upto - 1 AS span_start, c.upto - 1 - length(CAST(c.k AS VARCHAR)) AS span_end FROM r JOIN c ON c.k = l JOIN c x ON x.accession = c.accession AND x.k = f - 1)
    SELECT accession, item, 'crossref_pages' AS strategy, min(span_start) FILTER (span_no = 0) OVER (PARTITION BY accession, item) AS heading_start, span_no, span_start, span_end FROM s""",
)
def sections_paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings without headings, whose items are where a cross-reference table says."""
    return ke.located(_filings(spark, sf_dir).select("accession", _pages(F.lit(_TABLE.replace("\\n", "\n"))).alias("text")))


_BODY = "Words about the matter at hand. "
_REFERRED = [
    ("1", "Business", None),
    ("7", "Discussion", "Information in response to this Item can be found in the Annual Report on pages 3 to 4. More follows."),
    ("7A", "Market risk", "Refer to “Market Risk” in the report."),
    ("8", "Statements", None),
    ("10", "Directors", "Information required by this Item is incorporated by reference from pages 1 and 2."),
]
_PRIMARY = " || ".join(f"'Item {i}. {title}' || chr(10) || {f"repeat('{_BODY}', 60)" if said is None else f"'{said}'"} || chr(10)" for i, title, said in _REFERRED)


def _referring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings that refer to the pages and titles of a report behind them."""
    primary = "".join(f"Item {i}. {title}\n{_BODY * 60 if said is None else said}\n" for i, title, said in _REFERRED)
    report = _pages(F.lit(""))
    at = lambda name, a, z: F.struct(F.lit(name).alias("name"), a.cast("bigint").alias("start"), z.cast("bigint").alias("end"))
    rows = _filings(spark, sf_dir).withColumn("text", F.concat(F.lit(primary), report))
    n = F.lit(len(primary))
    titles = F.array(*[F.struct(F.lit(t).alias("title"), F.lit(g).alias("is_group")) for t, g in (("Market Risk", False), ("Capital", False), ("Annual Report", True))])
    return rows.select("accession", "text", F.array(at("main", F.lit(0), n), at("report", n, F.length("text"))).alias("parts"), titles.alias("outline"))


_SPOTS = f"""{_PAGES.format(first="")}, p AS (SELECT {_PRIMARY} AS main), m AS (SELECT main, length(main) AS low FROM p),
    d AS (SELECT accession, m.low, m.main, max(upto) FILTER (k = 2) AS p2, max(upto) FILTER (k = 4) AS p4, max(upto - length(body) - length(CAST(k AS VARCHAR)) - 2 + strpos(body, 'Market Risk') - 1) FILTER (k = 6) AS risk,
            max(upto - length(body) - length(CAST(k AS VARCHAR)) - 2 + strpos(body, 'Capital') - 1) FILTER (k = 9) AS capital FROM c, m GROUP BY ALL),
    h AS (SELECT * FROM (VALUES ('1', 1, '7'), ('7', 2, '7A'), ('7A', 3, '8'), ('8', 4, '10'), ('10', 5, NULL)) AS h(item, i, following)),
    o AS (SELECT accession, item, low, p2, p4, risk, capital, strpos(main, 'Item ' || item || '. ') - 1 AS heading_start, strpos(main, 'Item ' || item || '. ') + 6 + length(item) AS own_start,
            CASE WHEN following IS NULL THEN low ELSE strpos(main, 'Item ' || following || '. ') - 1 END AS own_end FROM d, h),
    located AS (SELECT accession, item, CASE WHEN item IN ('7', '7A') THEN 'referral' ELSE 'item_heading' END AS strategy, heading_start, CASE WHEN item IN ('7', '7A') THEN 1 ELSE 0 END AS span_no, own_start AS span_start, own_end AS span_end FROM o
      UNION ALL SELECT accession, item, 'referral', heading_start, 0, low + CASE item WHEN '7' THEN p2 - 1 ELSE risk END, low + CASE item WHEN '7' THEN p4 - 2 ELSE capital END FROM o WHERE item IN ('7', '7A'))"""


@query("sections_referred", f"WITH {_SPOTS} SELECT * FROM located")
def sections_referred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that pages or titles of another document hold, with their own sentence; items from 10 on are never followed."""
    return ke.located(_referring(spark, sf_dir))


@query(
    "parser_states",
    f"WITH {_SPOTS} SELECT accession, 'partial' AS state, 'referral' AS strategy, '1A 9A' || CASE WHEN min(span_end - span_start) FILTER (item = '7' AND span_no = 0) < 1000 THEN ' 7' ELSE '' END AS missing, 'sections too short' AS reason FROM located GROUP BY accession",
)
def parser_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the filings of ``sections_referred`` were read: two core items are not there at all, and the pages of the third are short."""
    filings = _referring(spark, sf_dir)
    states = ad.parser_states(filings, ke.located(filings))
    order = F.array_sort(F.transform("missing_core", lambda x: F.struct((x == "7").cast("int").alias("late"), x.alias("item"))))
    return states.select("accession", "state", "strategy", F.array_join(F.transform(order, lambda x: x["item"]), " ").alias("missing"), "reason")


@query("offsets_checked", f"WITH {_SPOTS} SELECT accession, count(*) AS n_spans, CAST(0 AS BIGINT) AS n_bad FROM located GROUP BY accession")
def offsets_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All spans of ``sections_referred`` lie within their texts."""
    filings = _referring(spark, sf_dir)
    spans = ke.located(filings)
    bad = ad.bad_offsets(filings, spans).groupBy("accession").agg(F.count(F.lit(1)).alias("n"))
    return spans.groupBy("accession").agg(F.count(F.lit(1)).alias("n_spans")).join(bad, "accession", "left").select("accession", "n_spans", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_bad"))
