"""Addresses of the public archive, and where their answers are kept in a landing folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.ids import accession_digits, cik_for_archives, cik_for_facts

# The hosts of the archive.
WWW, DATA = "https://www.sec.gov", "https://data.sec.gov"


def tickers_url() -> Column:
    return F.lit(f"{WWW}/files/company_tickers.json")


def submissions_url(cik: Column) -> Column:
    return F.concat(F.lit(f"{DATA}/submissions/"), cik_for_facts(cik), F.lit(".json"))


def submissions_page_url(name: Column) -> Column:
    return F.concat(F.lit(f"{DATA}/submissions/"), name)


def facts_url(cik: Column) -> Column:
    return F.concat(F.lit(f"{DATA}/api/xbrl/companyfacts/"), cik_for_facts(cik), F.lit(".json"))


def facts_archive_url() -> Column:
    return F.lit(f"{WWW}/Archives/edgar/daily-index/xbrl/companyfacts.zip")


def _folder(cik: Column, accession: Column) -> Column:
    return F.concat(F.lit(f"{WWW}/Archives/edgar/data/"), cik_for_archives(cik), F.lit("/"), accession_digits(accession), F.lit("/"))


def filing_index_url(cik: Column, accession: Column) -> Column:
    return F.concat(_folder(cik, accession), F.lit("index.json"))


def filing_index_page_url(cik: Column, accession: Column) -> Column:
    return F.concat(_folder(cik, accession), accession, F.lit("-index.htm"))


def document_url(cik: Column, accession: Column, document: Column) -> Column:
    return F.concat(_folder(cik, accession), document)


# Which paths are kept where; the first that matches counts.
LANDING = [
    (r"^/files/(company_tickers\.json)$", "reference/$1"),
    (r"^/submissions/(CIK\d{10}\.json)$", "submissions/$1"),
    (r"^/api/xbrl/companyfacts/(CIK\d{10}\.json)$", "companyfacts/$1"),
    (r"^/Archives/edgar/data/(\d+)/(.+)$", "filings/$1/$2"),
    (r"^/Archives/edgar/daily-index/(.+)$", "bulk/$1"),
]


def landing_path(url: Column) -> Column:
    """The place of an answer below the landing folder; no part of it leads out of there."""
    host, path = F.regexp_extract(url, r"^[a-z]+://([^/]+)", 1), F.regexp_extract(url, r"^[a-z]+://[^/]+(/[^?#]*)", 1)
    safe = lambda c: F.regexp_replace(F.regexp_replace(c, r"(?<=^|/)\.+(?=/|$)", ""), r"[^A-Za-z0-9._/-]", "_")
    out = F.concat(F.lit("misc/"), safe(host), F.lit("/"), safe(F.regexp_replace(path, "^/+", "")))
    for pattern, place in reversed(LANDING):
        out = F.when(path.rlike(pattern), safe(F.regexp_replace(path, pattern, place))).otherwise(out)
    return F.regexp_replace(out, "/{2,}", "/")


def landing_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Number, bytes, oldest and newest of the answers in a landing folder; notes and unfinished files do not count."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")
    kept = files.where(~F.col("path").rlike(r"\.(meta\.json|partial)$"))
    return kept.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"), F.min("modificationTime").alias("oldest"), F.max("modificationTime").alias("newest"))
