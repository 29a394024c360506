"""Problem 10: repetition inside a single document.

The log-likelihood ratio of a text's hashed n-grams between a trusted target and the raw corpus, divided by their number. Over
the n-grams as such that ratio tells which of them a text has, not how often it says them again; so the multinomials are over what the
hashes say of each n-gram within its own text: said first, or said again.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map
from tidemark.plans.registry import Registry, table
from tidemark.session import checkpointed, spread

query = Registry()

# Odd multipliers that mix the hashes of the words of a run.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


class _WordHash(dict):
    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 1_000_000:
            self[word] = h
        return h


_hash = _WordHash()


def run_hashes(text: str | None, n: int) -> np.ndarray:
    """64-bit hashes of all runs of ``n`` lower-cased words between white space."""
    words = text.lower().split() if text else []
    if len(words) < n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hash.__getitem__, words), np.uint64, len(words))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        part = h[k : k + len(out)] * _MIX[k]
        out ^= (part ^ (part >> np.uint64(29))) * _MIX[(k + 1) % len(_MIX)]
    return out


def repeated_share(df: DataFrame, *, id_col: str = "doc_id", n: int = 5) -> DataFrame:
    """``id_col``, ``n_runs``, ``n_distinct``, ``repeated`` (1 - distinct runs / all runs of ``n`` words) of each row's ``text``.

    A text of fewer than ``n`` words, also an empty or null one, has no runs and a null share. Repeated rows each come
    out; other columns are ignored; an empty table gives an empty result. ``n`` is 1 to 8.

    Scale: no shuffle; each text is read whole and on its own.
    """
    if not 1 <= n <= len(_MIX):
        raise ValueError("n must be 1 to 8")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        runs, distinct = [], []
        for t in b.column(1).to_pylist():
            h = run_hashes(t, n)
            h.sort()
            runs.append(len(h))
            distinct.append(int(np.count_nonzero(h[1:] != h[:-1])) + 1 if len(h) else 0)
        all_runs, some = pa.array(runs, pa.int64()), pa.array(distinct, pa.int64())
        share = pc.subtract(1.0, pc.divide(some.cast(pa.float64()), pc.if_else(pc.equal(all_runs, 0), None, all_runs).cast(pa.float64())))
        return pa.RecordBatch.from_arrays([b.column(0), all_runs, some, share], ["id", "n_runs", "n_distinct", "repeated"])

    kind = dict(df.dtypes)[id_col]
    return arrow_map(df.select(id_col, "text"), run, f"id {kind}, n_runs bigint, n_distinct bigint, repeated double").withColumnRenamed("id", id_col)


def repetition_ratio(df: DataFrame, *, trusted: Column, id_col: str = "doc_id", n: int = 5, share: float = 0.5) -> DataFrame:
    """``id_col``, ``n_runs``, ``n_distinct``, ``ratio`` and ``repeats``: whether at least ``share`` of a text's runs of ``n`` words are repeated.

    The hashes of a text's runs tell which of them the text has said before. So each run is one of two features, said first or said again,
    and there are two multinomials over these: that of the whole corpus and that of its ``trusted`` texts, with one added to each
    count. ``ratio`` is the log-likelihood ratio of a text under these, trusted against raw, divided by its number of runs.

    The ratio of a text is a linear function of its repeated share, so it passes that of a text with just ``share`` exactly
    where the share does; texts so near that rounding may decide are told by their counts, and so is every text where trusted and raw
    repeat alike, as the ratio then says nothing. Which texts are trusted thus moves the ratios but never the result.

    A text of fewer than ``n`` words, also an empty or null one, has no runs, a null ratio and does not repeat. A null ``trusted`` is false.
    Repeated rows each come out; other columns are ignored; an empty table gives an empty result. ``n`` is 1 to 8.

    Scale: each text is read once, whole and on its own; its counts (some 25 bytes) are written to the checkpoint folder. Four sums go to the driver.
    """
    kind = dict(df.dtypes)[id_col]
    rows = df.select(F.struct(F.col(id_col).alias("id"), F.coalesce(trusted, F.lit(False)).alias("trusted")).alias("__row"), "text")
    counted = checkpointed(repeated_share(rows, id_col="__row", n=n).select(F.col("__row.id").cast(kind).alias(id_col), "__row.trusted", "n_runs", "n_distinct"))
    again = F.col("n_runs") - F.col("n_distinct")
    of = lambda c: F.coalesce(F.sum(F.when(F.col("trusted"), c)), F.lit(0))
    raw_first, raw_again, first, later = counted.agg(F.coalesce(F.sum("n_distinct"), F.lit(0)), F.coalesce(F.sum(again), F.lit(0)), of(F.col("n_distinct")), of(again)).first()
    said_first = math.log((first + 1) / (first + later + 2)) - math.log((raw_first + 1) / (raw_first + raw_again + 2))
    said_again = math.log((later + 1) / (first + later + 2)) - math.log((raw_again + 1) / (raw_first + raw_again + 2))
    least = (1 - share) * said_first + share * said_again
    ratio = (F.col("n_distinct") * said_first + again * said_again) / F.when(F.col("n_runs") > 0, F.col("n_runs"))
    counted = counted.withColumn("ratio", ratio)
    # Where trusted texts repeat less, a repeating one is less likely under them, and the other way round.
    beyond = (F.col("ratio") - least) * (1 if said_again > said_first else -1)
    clear = F.abs(beyond) > 1e-9 * (abs(said_first) + abs(said_again))
    by_count = F.col("n_distinct") <= (1 - share) * F.col("n_runs")
    repeats = F.coalesce(F.when(clear, beyond > 0).otherwise(by_count), F.lit(False)) & (F.col("n_runs") > 0)
    return counted.select(id_col, "n_runs", "n_distinct", "ratio", repeats.alias("repeats"))


_RUNS = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) AS r FROM w WHERE len(w) >= 5),
s AS (SELECT doc_id, len(r) AS n_runs, len(list_distinct(r)) AS n_distinct FROM r)
"""


def _ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trusted texts are the filings themselves, without their companions."""
    return repetition_ratio(spread(table(spark, sf_dir, "documents")), trusted=F.col("source") == "main_filing")


@query("p10_found", _RUNS + "SELECT doc_id FROM s WHERE 1 - n_distinct / n_runs >= 0.5")
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ratios(spark, sf_dir).where("repeats").select("doc_id")


@query(
    "p10_ratio",
    _RUNS
    + """, d AS (SELECT documents.doc_id, source, coalesce(n_runs, 0) AS n_runs, coalesce(n_distinct, 0) AS n_distinct FROM documents LEFT JOIN s USING (doc_id)),
q AS (SELECT sum(n_distinct) AS a, sum(n_runs) AS n, coalesce(sum(n_distinct) FILTER (source = 'main_filing'), 0) AS b,
        coalesce(sum(n_runs) FILTER (source = 'main_filing'), 0) AS m FROM d),
x AS (SELECT ln((b + 1) / (m + 2)) - ln((a + 1) / (n + 2)) AS first, ln((m - b + 1) / (m + 2)) - ln((n - a + 1) / (n + 2)) AS again FROM q)
SELECT doc_id, n_runs, n_distinct, round((n_distinct * first + (n_runs - n_distinct) * again) / nullif(n_runs, 0), 9) AS ratio,
  n_runs > 0 AND 2 * n_distinct <= n_runs AS repeats FROM d, x""",
)
def p10_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ratios(spark, sf_dir).withColumn("ratio", F.round("ratio", 9))


@query(
    "p10_share",
    _RUNS + "SELECT doc_id, coalesce(n_runs, 0) AS n_runs, coalesce(n_distinct, 0) AS n_distinct, round(1 - n_distinct / n_runs, 9) AS repeated FROM documents LEFT JOIN s USING (doc_id)",
)
def p10_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_share(spread(table(spark, sf_dir, "documents"))).withColumn("repeated", F.round("repeated", 9))
