"""The text kernels as operators over DataFrames: one row of a filing in, rows of spans or chunks out."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions.breaks import Breaks
from tidemark.operators.text import locate, markup_text, passages
from tidemark.session import ship


def rows_of(df: DataFrame, f: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """Apply a kernel to each row (its columns are the arguments), which gives tuples of the schema. Arrow both ways."""
    from pyspark.sql.types import StructType

    ship(df.sparkSession)
    names = schemas.names(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for args in zip(*[c.to_pylist() for c in b.columns], strict=True):
                out.extend(f(*args))
            if out:
                columns: list[Any] = [pa.array(c, arrow.field(n).type) for n, c in zip(names, zip(*out, strict=True), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return df.mapInArrow(run, schema)


def normalized(pages: DataFrame, *, id_col: str, raw: str = "html") -> DataFrame:
    """``id_col`` and the ``text`` of each page; null stays null."""
    kind = dict(pages.dtypes)[id_col]
    return rows_of(pages.select(id_col, raw), lambda i, html: [(i, markup_text.text_of(html))], f"{id_col} {kind}, text string")


def located(filings: DataFrame, *, id_col: str = "accession") -> DataFrame:
    """``id_col``, ``item``, ``strategy``, ``heading_start``, ``span_no`` (0 is the primary), ``span_start``, ``span_end``.

    In: ``id_col``, ``text``, and if there are such ``parts`` (array of structs of name, start and end) and ``outline`` (array of
    structs of title and is_group). A null text has no sections.
    """
    kind, have = dict(filings.dtypes)[id_col], set(filings.columns)
    parts = F.col("parts") if "parts" in have else F.lit(None)
    outline = F.col("outline") if "outline" in have else F.lit(None)

    def find(i: Any, text: str | None, parts: list | None, outline: list | None) -> Iterator[tuple]:
        spans = [(p["start"], p["end"]) for p in parts or []]
        titles = [(o["title"], o["is_group"]) for o in outline or []]
        for s in locate.find_sections(text or "", spans, titles).values():
            for no, (a, z) in enumerate(s.spans):
                yield i, s.item, s.strategy, s.heading, no, a, z

    schema = f"{id_col} {kind}, item string, strategy string, heading_start bigint, span_no int, span_start bigint, span_end bigint"
    return rows_of(filings.select(id_col, "text", parts.alias("parts"), outline.alias("outline")), find, schema)


_SEGMENTS = "array<struct<start:bigint,end:bigint,items:array<string>>>"


def chunked(texts: DataFrame, *, id_col: str = "accession", tokens: int = passages.TARGET_TOKENS, overlap: float = passages.OVERLAP) -> DataFrame:
    """``id_col``, ``items``, ``char_start``, ``char_end``, ``text`` of the windows over each segment of a text, those under 200 characters left out.

    In: ``id_col``, ``text`` (whole), ``segments`` (array of structs of start, end and items). A segment that is a document gives fixed
    windows, one that is a run of the same items gives item-aware chunks. Each text is sent once, with all of its segments.
    """
    kind = dict(texts.dtypes)[id_col]

    def split(i: Any, text: str | None, segments: list[dict] | None) -> Iterator[tuple]:
        if text and segments:
            breaks = Breaks(text)
            for s in segments:
                for a, z in passages.windows(breaks, s["start"], s["end"], tokens=tokens, overlap=overlap):
                    if z - a >= passages.MIN_CHARS:
                        yield i, s["items"], a, z, text[a:z]

    rows = texts.select(id_col, "text", F.col("segments").cast(_SEGMENTS))
    return rows_of(rows, split, f"{id_col} {kind}, items array<string>, char_start bigint, char_end bigint, text string")


def fixed_windows(filings: DataFrame, *, id_col: str = "accession", **how: Any) -> DataFrame:
    """Chunks of each document of a filing, without items."""
    none = F.expr("cast(array() as array<string>)").alias("items")
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.length("text").cast("bigint").alias("end"), none))
    given = F.transform("parts", lambda p: F.struct(p["start"].cast("bigint").alias("start"), p["end"].cast("bigint").alias("end"), none)) if "parts" in filings.columns else F.lit(None)
    return chunked(filings.where("text IS NOT NULL").select(id_col, "text", F.coalesce(given.cast(_SEGMENTS), whole.cast(_SEGMENTS)).alias("segments")), id_col=id_col, **how)


def item_aware(filings: DataFrame, segments: DataFrame, *, id_col: str = "accession", items: list[str] | None = None, **how: Any) -> DataFrame:
    """Chunks of each segment (``start``, ``end``, ``items``), if asked for only of those with any of some items."""
    if items is not None:
        segments = segments.where(F.arrays_overlap("items", F.array(*[F.lit(x) for x in items])))
    # A text has few segments, which are narrow: they are put together before its text is joined, once.
    own = segments.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("start", "end", "items"))).alias("segments"))
    return chunked(filings.select(id_col, "text").join(own, id_col), id_col=id_col, **how)


def with_passages(texts: DataFrame, phrase: str, *, id_col: str, most: int = 10) -> DataFrame:
    """``id_col``, ``char_start``, ``char_end``, ``quote`` of the paragraphs with a phrase. Texts without it never leave the JVM."""
    if not phrase.strip():
        raise ValueError("a phrase is needed")
    kind = dict(texts.dtypes)[id_col]
    rows = texts.where(F.lower("text").contains(phrase.lower())).select(id_col, "text")

    def find(i: Any, text: str) -> Iterator[tuple]:
        for a, z in passages.find_passages(text, phrase, most=most):
            yield i, a, z, text[a:z]

    found = rows_of(rows, find, f"{id_col} {kind}, char_start bigint, char_end bigint, quote string")
    return found.withColumn("quote", passages.quoted(F.col("quote")))
