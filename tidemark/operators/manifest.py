"""Chunk manifests: identity, context, what must be embedded, and the gates before an index is built."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Titles of the items, the prefix that documents and queries have for the encoder, the width of vectors.
TITLES = {
    "1": "Business", "1A": "Risk Factors", "1B": "Unresolved Staff Comments", "1C": "Cybersecurity", "2": "Properties", "3": "Legal Proceedings",
    "5": "Market for Registrant's Common Equity", "7": "Management's Discussion and Analysis", "7A": "Quantitative and Qualitative Disclosures About Market Risk",
    "8": "Financial Statements and Supplementary Data", "9A": "Controls and Procedures",
}
DOCUMENT, QUERY = "search_document: ", "search_query: "
CHARS_PER_TOKEN = 4


def item_label(item: Column) -> Column:
    titles = F.create_map(*[F.lit(x) for pair in TITLES.items() for x in pair])
    return F.concat(F.lit("Item "), item, F.coalesce(F.concat(F.lit(". "), titles[item]), F.lit("")))


def _labels(items: Column) -> Column:
    return F.array_join(F.transform(items, item_label), "; ")


def has_items(items: Column) -> Column:
    return F.coalesce(F.size(items) > 0, F.lit(False))


def contextual_prefix(company: Column, ticker: Column, form: Column, period_end: Column, items: Column) -> Column:
    """The line that says to the encoder where a chunk is from."""
    where = F.when(has_items(items), _labels(items)).otherwise("full document")
    return F.concat_ws(" · ", F.concat(company, F.lit(" ("), ticker, F.lit(")")), form, F.concat(F.lit("period ending "), F.date_format(period_end, "yyyy-MM-dd")), where)


def section_path(form: Column, items: Column) -> Column:
    return F.when(has_items(items), F.concat(form, F.lit(" > "), _labels(items))).otherwise(form)


def chunk_id(accession: Column, start: Column) -> Column:
    return F.concat_ws(":", accession, start.cast("string"))


def estimated_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / CHARS_PER_TOKEN)


def embedding_input(prefix: Column, text: Column) -> Column:
    """The encoder's own prefix comes first, then the context, then the text."""
    return F.concat(F.lit(DOCUMENT), prefix, F.lit("\n\n"), text)


def query_input(question: Column) -> Column:
    return F.concat(F.lit(QUERY), question)


def corpus_plan(chunks: DataFrame, prefix: str = "prefix") -> DataFrame:
    """Chunks with the ``input`` that the encoder gets for each and its ``digest``."""
    return chunks.withColumn("input", embedding_input(F.col(prefix), F.col("text"))).withColumn("digest", digest(F.col("input")))


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def snippet(text: Column, length: int = 100) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, length)


def exact_quantiles(df: DataFrame, value: Column, shares: Sequence[float]) -> DataFrame:
    """``share``, ``value``: the sorted value at the place floor(n * share), exactly, by counts of equal values."""
    from pyspark.sql import Window

    counts = df.select(value.alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    # There are far fewer different lengths than rows: what goes through one window is bounded by the longest text.
    up = counts.withColumn("upto", F.sum("c").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(Window.partitionBy()))
    wanted = up.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    place = F.floor(F.col("n") * F.col("share"))
    return wanted.where((place >= F.col("upto") - F.col("c")) & (place < F.col("upto"))).select("share", F.col("v").alias("value"))


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def assert_unique(df: DataFrame, key: str) -> DataFrame:
    """``df``, after an error if a key occurs twice."""
    twice = repeated_keys(df, key).take(3)
    if twice:
        raise ValueError(f"{key} occurs more than once: {', '.join(str(r[0]) for r in twice)}")
    return df


def missing_vectors(rows: DataFrame, vectors: DataFrame, key: str = "digest") -> DataFrame:
    """Keys of rows that have no vector yet, each once: what is left to embed."""
    return rows.select(key).where(F.col(key).isNotNull()).distinct().join(vectors.select(key), key, "left_anti")


def index_problems(rows: DataFrame, vectors: DataFrame, *, key: str = "digest", model: str = "model", vector: str = "vector", tolerance: float = 1e-3) -> DataFrame:
    """``problem``, ``n``: more than one model, rows without a vector, vectors that are not of unit length. Empty when an index may be built."""
    from tidemark.functions.vectors import norm

    models = rows.agg(F.countDistinct(model).alias("n")).where("n > 1").select(F.lit("models").alias("problem"), "n")
    absent = missing_vectors(rows, vectors, key).agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit("missing").alias("problem"), "n")
    used = vectors.join(rows.select(key).distinct(), key, "left_semi").where(F.abs(norm(vector) - 1) > tolerance)
    return models.unionByName(absent).unionByName(used.agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit("norm").alias("problem"), "n"))


def vocabulary(manifest: DataFrame) -> DataFrame:
    """``field``, ``value``: tickers, years and items that a question may name as its scope."""
    one = lambda name, c: manifest.select(F.lit(name).alias("field"), c.cast("string").alias("value")).where("value IS NOT NULL").distinct()
    return one("ticker", F.col("ticker")).unionByName(one("fiscal_year", F.col("fiscal_year"))).unionByName(manifest.select(F.explode("items").alias("i")).select(F.lit("item").alias("field"), F.col("i").alias("value")).distinct())
