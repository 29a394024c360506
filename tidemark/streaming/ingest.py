"""Incremental ingest: what lands in a folder is flattened and replaces its companies' years."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.sources.json_sources import flatten_facts
from tidemark.sources.tables import read_facts, write_facts


def facts_stream(spark: SparkSession, landing: str) -> DataFrame:
    """Files of company facts as they land: ``cik`` (from the file's name) and ``json``."""
    files = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", "CIK*.json").load(landing)
    return files.select(F.regexp_extract("_metadata.file_name", r"CIK(\d{10})", 1).alias("cik"), F.col("value").alias("json"))


def ingest_landing(spark: SparkSession, landing: str, facts_path: str, checkpoint: str) -> StreamingQuery:
    """Work off all files that are there and not yet ingested; running it again does nothing, a changed company replaces its years."""

    def put(batch: DataFrame, _: int) -> None:
        write_facts(flatten_facts(batch), facts_path)

    return facts_stream(spark, landing).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_filings(stream: DataFrame, *, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Filings a window and form, as they come in (``loaded_at``, ``form``); rows later than ``late`` are not counted any more."""
    return stream.withWatermark("loaded_at", late).groupBy(F.window("loaded_at", window), "form").agg(F.count(F.lit(1)).alias("n"), F.sum("val").alias("total"))


__all__ = ["facts_stream", "ingest_landing", "late_filings", "read_facts"]
