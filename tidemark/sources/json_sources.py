"""Nested and columnar JSON as rows."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions.ids import cik10, cik_for_facts
from tidemark.operators.facts import period_year


def zip_members(spark: SparkSession, archive: str, ciks: Sequence[str]) -> DataFrame:
    """``cik`` and ``json`` of the members ``CIK##########.json`` of an archive, read in place, each company in a task of its own.

    A company without a member is an error that names it. The archive must be readable where the tasks run.
    """
    keys = spark.createDataFrame([(c,) for c in ciks], "cik string").repartition(max(1, len(ciks)), "cik")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cik in b.column(0).to_pylist():
                with zipfile.ZipFile(archive) as z:
                    try:
                        text = z.read(f"CIK{int(cik):010d}.json").decode()
                    except KeyError:
                        raise ValueError(f"the archive has no member for company {cik}") from None
                yield pa.RecordBatch.from_arrays([pa.array([cik]), pa.array([text])], ["cik", "json"])

    return keys.mapInArrow(read, "cik string, json string")


def _day(c: str) -> Column:
    """An ISO day, also without leading zeros; null for anything else."""
    return F.when(F.col(c).rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.col(c).try_cast("date"))


def _number(c: str) -> Column:
    return F.when(F.col(c).rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), F.col(c).cast("double"))


def flatten_facts(members: DataFrame) -> DataFrame:
    """Fact rows of the JSON of companies (``cik``, ``json``).

    Observations without a number, an end or a filing day, or with a start that is no day, are dropped; a missing ``accn`` is
    empty. A text that is no JSON object with ``facts`` is an error.
    """
    parsed = members.select(cik10("cik").alias("cik"), F.from_json("json", schemas.COMPANY_FACTS, {"mode": "PERMISSIVE"}).alias("j"))
    facts = F.when(F.col("j.facts").isNull(), F.raise_error(F.concat(F.lit("no facts in the JSON of "), F.col("cik"))).cast(schemas.COMPANY_FACTS_MAP)).otherwise(F.col("j.facts"))
    rows = parsed.select("cik", F.explode(facts).alias("taxonomy", "tags"))
    rows = rows.select("cik", "taxonomy", F.explode("tags").alias("tag", "t"))
    rows = rows.select("cik", "taxonomy", "tag", F.explode("t.units").alias("unit", "o"))
    rows = rows.select("cik", "taxonomy", "tag", "unit", F.explode("o").alias("o")).select("cik", "taxonomy", "tag", "unit", "o.*")
    rows = rows.withColumns({"s": _day("start"), "e": _day("end"), "f": _day("filed"), "v": _number("val"), "y": F.when(F.col("fy").rlike(r"^-?\d+$"), F.col("fy").try_cast("int"))})
    rows = rows.where("v IS NOT NULL AND e IS NOT NULL AND f IS NOT NULL AND (start IS NULL OR s IS NOT NULL)")
    return rows.select(
        "cik", "taxonomy", "tag", "unit", F.when(F.col("s").isNull(), "instant").otherwise("duration").alias("period_type"), F.col("s").alias("period_start"), F.col("e").alias("period_end"),
        period_year(F.col("s"), F.col("e")).alias("period_year"), F.col("v").alias("val"), F.col("y").alias("fy"), "fp", "form", F.col("f").alias("filed"), F.coalesce("accn", F.lit("")).alias("accn"), "frame",
    )


def _filings(columns: Column, cik: Column) -> list[Column]:
    zipped = F.arrays_zip(*[columns[c].alias(c) for c in ("accessionNumber", "form", "filingDate", "reportDate", "primaryDocument", "isXBRL")])
    return [cik.alias("cik"), F.inline(zipped)]


def _as_filings(rows: DataFrame, forms: Sequence[str] | None) -> DataFrame:
    if forms is not None:
        rows = rows.where(F.col("form").isin(*forms))
    return rows.where("reportDate <> ''").select(
        "cik", F.col("accessionNumber").alias("accession"), "form", _day("filingDate").alias("filing_date"), _day("reportDate").alias("report_date"), F.col("primaryDocument").alias("primary_document"), (F.col("isXBRL") == 1).alias("is_xbrl")
    )


def recent_filings(payloads: DataFrame, forms: Sequence[str] | None = None) -> DataFrame:
    """Filings of the recent part of submissions (``json``): parallel arrays zipped to rows; those without a report date are left out."""
    p = payloads.select(F.from_json("json", schemas.SUBMISSIONS).alias("j"))
    return _as_filings(p.select(*_filings(F.col("j.filings.recent"), cik10("j.cik"))), forms)


def page_filings(pages: DataFrame, forms: Sequence[str] | None = None) -> DataFrame:
    """Filings of older pages (``cik``, ``json``), which have the arrays at the top."""
    p = pages.select("cik", F.from_json("json", schemas.SUBMISSIONS_PAGE).alias("j"))
    return _as_filings(p.select(*_filings(F.col("j"), cik10("cik"))), forms)


def older_pages(payloads: DataFrame) -> DataFrame:
    """``cik``, ``name``, ``n_filings``, ``first_filed``, ``last_filed`` of the pages that submissions name."""
    p = payloads.select(F.from_json("json", schemas.SUBMISSIONS).alias("j"))
    return p.select(cik10("j.cik").alias("cik"), F.inline("j.filings.files")).toDF("cik", "name", "n_filings", "a", "z").select("cik", "name", "n_filings", _day("a").alias("first_filed"), _day("z").alias("last_filed"))


def tickers(payloads: DataFrame) -> DataFrame:
    """``ticker``, ``cik``, ``title`` of an object keyed by row number (``json``); of a repeated ticker the last row counts."""
    m = payloads.select(F.from_json("json", "map<string,struct<cik_str:bigint,ticker:string,title:string>>").alias("m"))
    rows = m.select(F.explode("m").alias("k", "r")).select(F.col("k").cast("bigint").alias("k"), F.upper(F.trim("r.ticker")).alias("ticker"), cik10(F.col("r.cik_str")).alias("cik"), F.col("r.title").alias("title"))
    return rows.groupBy("ticker").agg(F.max_by(F.struct("cik", "title"), "k").alias("r")).select("ticker", "r.cik", "r.title")


def find_ticker(table: DataFrame, ticker: str) -> str:
    row = table.where(F.col("ticker") == ticker.strip().upper()).first()
    if row is None:
        raise LookupError(f"unknown ticker {ticker!r}")
    return row["cik"]


def member_names(companies: DataFrame) -> DataFrame:
    return companies.select("cik", F.concat(cik_for_facts("cik"), F.lit(".json")).alias("member"))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole files with their names: one row each."""
    files = spark.read.format("binaryFile").load(str(Path(path)) if "://" not in path else path)
    return files.select(F.regexp_extract("path", r"[^/]+$", 0).alias("name"), F.col("content").cast("string").alias("text"), "length", F.col("modificationTime").alias("modified"))


def filing_texts(parts: DataFrame, *, id_col: str = "accession") -> DataFrame:
    """``id_col``, ``text`` and ``parts`` (name, start, end) of filings whose documents (``part_no``, ``name``, ``text``) are joined by an empty line."""
    gathered = parts.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("part_no", "name", F.coalesce("text", F.lit("")).alias("text")))).alias("d"))
    ends = F.aggregate(
        "d",
        F.expr("cast(array() as array<struct<name:string,start:bigint,end:bigint>>)"),
        lambda s, p: F.concat(s, F.array(F.struct(p["name"].alias("name"), _next(s).alias("start"), (_next(s) + F.length(p["text"])).alias("end")))),
    )
    return gathered.select(id_col, F.array_join(F.transform("d", lambda p: p["text"]), "\n\n").alias("text"), ends.alias("parts"))


def _next(done: Column) -> Column:
    return F.when(F.size(done) == 0, F.lit(0).cast("bigint")).otherwise(F.element_at(done, -1)["end"] + 2)
