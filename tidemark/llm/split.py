"""Problem 3: oversized items cut at natural boundaries, with an overlap."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.breaks import RangeMaximum
from tidemark.llm.common import arrow_map
from tidemark.plans.registry import Registry, table
from tidemark.session import spread

query = Registry()

#: What may end a piece, weakest first; the cut lies behind the match. The strength is the place in this list.
BOUNDARIES = [r"\s+", r"[,;:]\s+", r"[.!?…][)\]\"'”’]*\s+|[。！？]", r"\n[^\S\n]*", r"\n[^\S\n]*\n\s*"]
_PATTERNS = [re.compile(p) for p in BOUNDARIES]
#: Positions for which one sparse table is built; longer texts get the next table when they come there.
_SPAN = 1 << 16


def boundary_strengths(text: str) -> np.ndarray:
    """At each cut position 0..len(text) the strength of the boundary there, 0 where there is none."""
    strength = np.zeros(len(text) + 1, np.int8)
    for k, p in enumerate(_PATTERNS, 1):
        for m in p.finditer(text):
            strength[m.end()] = k
    return strength


def cut(text: str, size: int, overlap: int, least: int) -> list[tuple[int, int]]:
    """Half-open spans of the pieces of a text."""
    n = len(text)
    if n <= size:
        return [(0, n)]
    strength, spans, start = boundary_strengths(text), [], 0
    base, index = 0, RangeMaximum(strength[: _SPAN + size + 1], size)
    while n - start > size:
        if start - base > _SPAN - size:
            base = start
            index = RangeMaximum(strength[base : base + _SPAN + size + 1], size)
        stop = base + index.strongest(start + least - base, start + size - base)
        spans.append((start, stop))
        start = stop - overlap if stop - overlap > start else stop
    return [*spans, (start, n)]


def split_oversized(df: DataFrame, *, id_col: str = "row_id", size: int = 3200, overlap: int = 480, least: int | None = None) -> DataFrame:
    """Pieces of the rows whose ``text`` is longer than ``size`` characters (code points).

    In: ``id_col``, ``text``, ``char_start``, ``items``; other columns are ignored. Out: ``id_col``, ``piece_no``
    from 0, ``char_start``, ``char_end``, ``items``, ``text``. A piece ends at the strongest boundary of
    ``least`` (default: half of ``size``) to ``size`` characters, the rightmost among equally strong ones; where
    there is none, at ``size``. The next begins ``overlap`` characters before that end if this advances, else at it.

    ``char_start`` is the row's plus the place in the text, a null one counting as 0; ``char_end`` follows from the
    piece's length, so offsets that do not fit the text do no harm. Rows with a null or short text give no piece;
    null ``items`` stay null; repeated rows each give their pieces; an empty table gives an empty result. Needs
    0 <= overlap < least <= size.

    Scale: no shuffle. Short rows never leave the JVM; memory is bounded by the text and one table of 2**16 positions.
    """
    least = size // 2 if least is None else least
    if not 0 <= overlap < least <= size:
        raise ValueError("0 <= overlap < least <= size must hold")
    rows = df.select(F.col(id_col), F.coalesce("char_start", F.lit(0)).cast("bigint").alias("char_start"), "items", "text").where(F.length("text") > size)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        which, no, start, stop, parts = [], [], [], [], []
        for r, (at, text) in enumerate(zip(b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True)):
            for k, (s, e) in enumerate(cut(text, size, overlap, least)):
                which.append(r), no.append(k), start.append(at + s), stop.append(at + e), parts.append(text[s:e])
        take = pa.array(which, pa.int32())
        columns = [b.column(0).take(take), pa.array(no, pa.int32()), pa.array(start, pa.int64()), pa.array(stop, pa.int64()), b.column(2).take(take), pa.array(parts, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["id", "piece_no", "char_start", "char_end", "items", "text"])

    kind = dict(rows.dtypes)
    return arrow_map(rows, run, f"id {kind[id_col]}, piece_no int, char_start bigint, char_end bigint, items {kind['items']}, text string").withColumnRenamed("id", id_col)


@query("p3_found", "SELECT row_id FROM manifest WHERE length(text) > 3200")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(spread(table(spark, sf_dir, "manifest"))).where("piece_no = 0").select("row_id")


# The boundaries of BOUNDARIES, weakest first, with white space spelled out as this dialect's does not know all of it. What is taken out
# each time reaches to the end of a match, so the ends are running sums of lengths.
_S = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_B = r"\t\x0b-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_ENDS = [f"[{_S}]+", f"[,;:][{_S}]+", f"[.!?…][)\\]\"''”’]*[{_S}]+|[。！？]", f"\\n[{_B}]*", f"\\n[{_B}]*\\n[{_S}]*"]
_PIECES = (
    "WITH RECURSIVE t AS MATERIALIZED (SELECT row_id, text, coalesce(char_start, 0) AS char_start, items, length(text) AS n FROM manifest WHERE length(text) > 3200), p AS ("
    + " UNION ALL ".join(f"SELECT row_id, {k} AS k, regexp_extract_all(text, '(?s).*?(?:{e})') AS parts FROM t" for k, e in enumerate(_ENDS, 1))
    + """),
u AS (SELECT row_id, k, unnest(parts) AS part, unnest(range(1, len(parts) + 1)) AS i FROM p),
e AS (SELECT row_id, k, sum(length(part)) OVER (PARTITION BY row_id, k ORDER BY i) AS pos FROM u),
b AS MATERIALIZED (SELECT t.*, list(k * 10000000 + pos) FILTER (pos IS NOT NULL) AS marks FROM t LEFT JOIN e USING (row_id) GROUP BY ALL),
r AS (SELECT row_id, 0 AS piece_no, 0 AS s,
        coalesce(list_max(list_filter(marks, lambda x: x % 10000000 BETWEEN 1600 AND 3200))::BIGINT % 10000000, 3200) AS z FROM b
      UNION ALL
      SELECT row_id, piece_no + 1, z - 480, CASE WHEN n - (z - 480) <= 3200 THEN n
        ELSE coalesce(list_max(list_filter(marks, lambda x: x % 10000000 BETWEEN z - 480 + 1600 AND z - 480 + 3200))::BIGINT % 10000000, z - 480 + 3200) END
      FROM r JOIN b USING (row_id) WHERE z < n)
SELECT row_id, CAST(piece_no AS INTEGER) AS piece_no, char_start + s AS char_start, char_start + z AS char_end, array_to_string(items, ' ') AS items, substring(text, s + 1, z - s) AS text FROM r JOIN b USING (row_id)
"""
)


@query("p3_pieces")
def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(spread(table(spark, sf_dir, "manifest")))


@query("p3_spans", _PIECES)
def p3_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of ``p3_pieces`` with their items on a line."""
    return p3_pieces(spark, sf_dir).withColumn("items", F.array_join("items", " "))
