"""Problem 7: lines repeated across one source's documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.registry import Registry, table
from tidemark.session import checkpointed, spread

query = Registry()

# White space as the Unicode property has it, and the separators of information.
_SPACE = r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def line_form(line: Column) -> Column:
    """What lines that count as one have in common: no case, single blanks, none outside, one digit for a run of digits."""
    blanks = F.regexp_replace(line, f"[{_SPACE}]{{2,}}|[{_SPACE}&&[^ ]]", " ")
    return F.lower(F.regexp_replace(F.trim(blanks), "[0-9]+", "0"))


def repeated_lines(
    df: DataFrame,
    *,
    id_col: str = "row_id",
    source_col: str = "ticker",
    date_col: str | None = "period_end",
    min_rows: int = 6,
    min_clusters: int = 1,
    min_dates: int = 0,
) -> DataFrame:
    """``id_col``, ``line_no`` (from 1) and ``n_rows``, ``n_clusters``, ``n_dates`` of each line repeated within its source.

    Texts that are equal within a source are first collapsed into a cluster, dated by its earliest row. Each line, in
    the form of ``line_form``, is then counted once per cluster: over how many clusters and dates it occurs, and how
    many rows these clusters have. A line is repeated if all three counts reach their thresholds; with ``min_clusters``
    above 1 the lines of an article that was only republished are not taken for boilerplate, with ``min_dates`` above 1 those of
    one that came out once in several versions.

    Nulls: rows without a source or text have no lines; clusters without a date have one further date in common. Blank lines never count. A line
    that occurs twice in one text counts once and comes out with both numbers. Every row of a repeated ``id_col`` counts as
    a row. Other columns are ignored; an empty table gives an empty result.

    Scale: lines are hashed where they are read; only hashes are shuffled. Copies of a text are combined on the map
    side before its lines are unfolded, and counts before they are shuffled, so neither a text nor a line that a third
    of all rows share gathers in one task. The clusters' lines are written once to the checkpoint folder.
    """
    day = F.col(date_col).cast("date") if date_col else F.lit(None).cast("date")
    texts = df.where(F.col(source_col).isNotNull() & F.col("text").isNotNull())
    source, doc = F.xxhash64(source_col).alias("source"), F.xxhash64(F.lit(1), source_col, "text").alias("doc")
    forms = F.transform(F.split("text", "\n"), line_form)
    hashes = F.transform(forms, lambda x: F.when(x != "", F.xxhash64(x)))
    undated = F.lit("0001-01-01").cast("date")
    clusters = texts.select(source, doc, day.alias("day"), hashes.alias("lines")).groupBy("source", "doc").agg(
        F.count(F.lit(1)).alias("size"), F.coalesce(F.min("day"), undated).alias("day"), F.first("lines").alias("lines")
    )
    lines = checkpointed(clusters.select("source", "doc", "size", "day", F.posexplode("lines").alias("line_no", "h")).where("h IS NOT NULL"))
    once = lines.groupBy("source", "h", "doc").agg(F.first("size").alias("size"), F.first("day").alias("day"))
    counted = once.groupBy("source", "h").agg(F.sum("size").alias("n_rows"), F.count(F.lit(1)).alias("n_clusters"), F.countDistinct("day").alias("n_dates"))
    kept = counted.where((F.col("n_rows") >= min_rows) & (F.col("n_clusters") >= min_clusters) & (F.col("n_dates") >= min_dates))
    found = lines.join(kept, ["source", "h"]).select("doc", (F.col("line_no") + 1).alias("line_no"), "n_rows", "n_clusters", "n_dates")
    return texts.select(id_col, doc).join(found, "doc").select(id_col, "line_no", "n_rows", "n_clusters", "n_dates")


def without_repeated_lines(df: DataFrame, *, id_col: str = "row_id", **how) -> DataFrame:
    """All rows of ``df`` with the repeated lines taken out of ``text`` and their number in ``n_removed``.

    ``id_col`` must be unique and not null. Texts without such lines come out as they are, null ones null.
    ``how``: as for ``repeated_lines``.
    """
    found = repeated_lines(df, id_col=id_col, **how).groupBy(id_col).agg(F.collect_set("line_no").alias("__gone"))
    joined = df.join(found, id_col, "left")
    left = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("__gone", i + 1))
    return joined.withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))).withColumn(
        "n_removed", F.coalesce(F.size("__gone"), F.lit(0))
    ).drop("__gone")


_FORM = r"lower(regexp_replace(trim(regexp_replace(line, '[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')), '[0-9]+', '0', 'g'))"
_LINES = f"""
WITH l AS (SELECT row_id, ticker, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no
           FROM manifest WHERE text IS NOT NULL AND ticker IS NOT NULL),
f AS (SELECT row_id, ticker, line_no, {_FORM} AS form FROM l),
k AS (SELECT ticker, form FROM f WHERE form <> '' GROUP BY ticker, form HAVING count(DISTINCT row_id) >= 6)
"""


@query("p7_found", _LINES + "SELECT row_id, CAST(line_no AS INTEGER) AS line_no FROM f JOIN k USING (ticker, form)")
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines(spread(table(spark, sf_dir, "manifest"))).select("row_id", "line_no")


_CLEAN = f"""
WITH c AS (SELECT ticker, text, coalesce(min(period_end), DATE '0001-01-01') AS day FROM manifest WHERE text IS NOT NULL AND ticker IS NOT NULL GROUP BY ticker, text),
l AS (SELECT row_id, ticker, text, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM manifest WHERE text IS NOT NULL),
f AS (SELECT l.*, day, {_FORM} AS form FROM l LEFT JOIN c USING (ticker, text)),
k AS (SELECT ticker, form FROM f WHERE form <> '' AND ticker IS NOT NULL GROUP BY ticker, form
      HAVING count(DISTINCT row_id) >= 6 AND count(DISTINCT text) >= 2 AND count(DISTINCT day) >= 2),
g AS (SELECT row_id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (k.form IS NULL), '') AS text, count(k.form) AS n
      FROM f LEFT JOIN k ON f.ticker = k.ticker AND f.form = k.form GROUP BY row_id)
SELECT row_id, g.text, CAST(coalesce(n, 0) AS INTEGER) AS n_removed FROM manifest LEFT JOIN g USING (row_id)
"""


@query("p7_clean", _CLEAN)
def p7_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in six rows or more, in at least two different texts of at least two dates, are taken out."""
    rows = spread(table(spark, sf_dir, "manifest")).select("row_id", "ticker", "period_end", "text")
    return without_repeated_lines(rows, min_clusters=2, min_dates=2).select("row_id", "text", "n_removed")
