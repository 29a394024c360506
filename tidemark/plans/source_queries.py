"""Sources: nested and columnar JSON, addresses, and a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.ids import cik10
from tidemark.plans.registry import Registry, table
from tidemark.session import scratch
from tidemark.sources import json_sources as js
from tidemark.sources import urls
from tidemark.streaming.ingest import late_filings

query = Registry()

_CIK = "lpad(regexp_extract(upper(trim(cik)), '^(?:CIK[-_]?)?0*([0-9]{1,10})$', 1), 10, '0')"


@query(
    "facts_from_json",
    f"""SELECT {_CIK} AS cik, taxonomy, tag, unit, CASE WHEN period_start IS NULL THEN 'instant' ELSE 'duration' END AS period_type, period_start, period_end, val, fy, fp, form, filed, accn, frame,
    CAST(CASE WHEN period_start IS NULL OR year(period_start) = year(period_end) OR 2 * dayofyear(period_end) >= date_diff('day', period_start, period_end) THEN year(period_end) ELSE year(period_start) END AS INTEGER) AS period_year FROM facts""",
)
def facts_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts put into the nested JSON that companies publish, one tag a text, and flattened again."""
    rows = table(spark, sf_dir, "facts")
    names = {"start": "period_start", "end": "period_end", "val": "val", "accn": "accn", "fy": "fy", "fp": "fp", "form": "form", "filed": "filed", "frame": "frame"}
    observation = F.struct(*[(F.date_format(c, "yyyy-MM-dd") if c in ("period_start", "period_end", "filed") else F.col(c)).alias(k) for k, c in names.items()])
    tags = rows.groupBy("cik", "taxonomy", "tag", "unit").agg(F.collect_list(observation).alias("o"))
    member = F.struct(F.lit("made up").alias("entityName"), F.create_map("taxonomy", F.create_map("tag", F.struct(F.create_map("unit", "o").alias("units")))).alias("facts"))
    return js.flatten_facts(tags.select("cik", F.to_json(member).alias("json")))


@query(
    "filings_from_columns",
    "SELECT cik, accession, form, filing_date, report_date, coalesce(primary_document, '') AS primary_document, coalesce(is_xbrl, false) AS is_xbrl FROM filings WHERE report_date IS NOT NULL AND form IN ('10-K', '10-Q')",
)
def filings_from_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filing index put into parallel arrays, one company a text, and zipped again."""
    day = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(""))
    row = F.struct("accession", "form", day("filing_date").alias("f"), day("report_date").alias("r"), F.coalesce("primary_document", F.lit("")).alias("p"), F.coalesce("is_xbrl", F.lit(False)).cast("int").alias("x"))
    per = table(spark, sf_dir, "filings").groupBy("cik").agg(F.collect_list(row).alias("o"))
    columns = {"accessionNumber": "accession", "form": "form", "filingDate": "f", "reportDate": "r", "primaryDocument": "p", "isXBRL": "x"}
    recent = F.struct(*[F.col(f"o.{c}").alias(k) for k, c in columns.items()])
    return js.recent_filings(per.select(F.to_json(F.struct("cik", F.struct(recent.alias("recent")).alias("filings"))).alias("json")), ["10-K", "10-Q"])


@query("json_properties", "SELECT event_id, k AS name, json_extract_string(props, '$.' || k) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events WHERE props IS NOT NULL)")
def json_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of events, an object of any keys, as rows."""
    return table(spark, sf_dir, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("name", "value"))


_DATA, _WWW = urls.DATA, urls.WWW
_SHORT = f"CAST(CAST({_CIK} AS BIGINT) AS VARCHAR)"


@query(
    "archive_urls",
    f"""SELECT accession, primary_document, '{_DATA}/submissions/CIK' || {_CIK} || '.json' AS submissions, '{_DATA}/api/xbrl/companyfacts/CIK' || {_CIK} || '.json' AS facts,
    '{_WWW}/Archives/edgar/data/' || {_SHORT} || '/' || replace(accession, '-', '') || '/' || accession || '-index.htm' AS index_page,
    '{_WWW}/Archives/edgar/data/' || {_SHORT} || '/' || replace(accession, '-', '') || '/' || primary_document AS document FROM filings""",
)
def archive_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, a = F.col("cik"), F.col("accession")
    return table(spark, sf_dir, "filings").select(
        "accession", "primary_document", urls.submissions_url(c).alias("submissions"), urls.facts_url(c).alias("facts"), urls.filing_index_page_url(c, a).alias("index_page"), urls.document_url(c, a, F.col("primary_document")).alias("document")
    )


@query(
    "landing_paths",
    f"SELECT accession, primary_document, 'filings/' || {_SHORT} || '/' || replace(accession, '-', '') || '/' || primary_document AS place, 'submissions/CIK' || {_CIK} || '.json' AS submissions_place FROM filings WHERE primary_document IS NOT NULL",
)
def landing_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, rows = F.col("cik"), table(spark, sf_dir, "filings").where("primary_document IS NOT NULL")
    return rows.select("accession", "primary_document", urls.landing_path(urls.document_url(c, F.col("accession"), F.col("primary_document"))).alias("place"), urls.landing_path(urls.submissions_url(c)).alias("submissions_place"))


@query("company_keys", f"SELECT ticker, {_CIK} AS cik, 'CIK' || {_CIK} || '.json' AS member FROM companies")
def company_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "companies").withColumn("cik", cik10("cik"))
    return rows.select("ticker", "cik").join(js.member_names(rows), "cik")


@query("stream_loads", "SELECT CAST(loaded_at AS DATE) AS day, form, count(*) AS n FROM facts GROUP BY ALL")
def stream_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads by day and form, counted by a stream over the fact files that works off what is there."""
    given = spark.read.parquet(f"{sf_dir}/facts.parquet").schema
    rows = spark.readStream.schema(given).parquet(f"{sf_dir}/fact[s].parquet").withColumn("loaded_at", F.col("loaded_at").cast("timestamp"))
    counted = late_filings(rows, late="100000 days")  # what is there is all of it, however old
    folder = scratch(spark, "loads")

    def put(batch: DataFrame, no: int) -> None:
        """What a batch changed; rows of a batch that is done again are the same."""
        batch.select(F.col("window.start").cast("date").alias("day"), "form", "n", F.lit(no).alias("batch")).write.mode("overwrite").parquet(f"{folder}/counts/batch_no={no}")

    counted.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/counts").groupBy("day", "form").agg(F.max_by("n", "batch").alias("n"))

