"""Retrieval: filters, exact vector search, BM25, rank fusion, fan-out over companies and section targeting."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.analysis import english_terms, plain_terms
from tidemark.functions.vectors import dot_with, score_of_cosine
from tidemark.session import checkpointed, ship

# Saturation and length normalisation of BM25, the constant of reciprocal rank fusion, its depth.
K1, B = 1.2, 0.75
RRF_K = 60
CANDIDATES = 100


@dataclass(frozen=True)
class Filters:
    """Any of the values within a field, all of the fields; an empty field asks for nothing."""

    ticker: tuple[str, ...] = ()
    fiscal_year: tuple[int, ...] = ()
    form: tuple[str, ...] = ()
    items: tuple[str, ...] = ()

    @classmethod
    def of(cls, **fields: Sequence[Any] | None) -> Filters:
        clean = {k: tuple(v.strip().upper() if isinstance(v, str) else v for v in vs or ()) for k, vs in fields.items()}
        return cls(**clean)

    def merged(self, other: Filters) -> Filters:
        """With the fields that the other asks for in place of one's own."""
        return replace(self, **{k: v for k, v in vars(other).items() if v})

    def condition(self) -> Column:
        test = F.lit(True)
        for name in ("ticker", "fiscal_year", "form"):
            if values := getattr(self, name):
                test = test & F.col(name).isin(*values)
        if self.items:
            test = test & F.arrays_overlap("items", F.array(*[F.lit(x) for x in self.items]))
        return test

    def apply(self, df: DataFrame) -> DataFrame:
        return df.where(self.condition())


def ranked(scored: DataFrame, k: int, *, by: Sequence[str] = (), score: str = "score", tie: str = "chunk_id") -> DataFrame:
    """The best ``k`` (of each group) with their ``rank`` from 1; equal scores by ``tie``."""
    order = [F.desc(score), F.col(tie)]
    if not by:
        scored = scored.orderBy(*order).limit(k)
    w = Window.partitionBy(*by).orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def vector_search(vectors: DataFrame, query: Sequence[float], k: int = 10, *, where: Column | None = None, embedding: str = "embedding", tie: str = "vec_id") -> DataFrame:
    """The ``k`` rows nearest by cosine (of unit vectors) among those that pass the filter, which comes first."""
    rows = vectors if where is None else vectors.where(where)
    return ranked(rows.withColumn("cosine", dot_with(embedding, query)).withColumn("score", score_of_cosine("cosine")), k, score="cosine", tie=tie)


def _packed(vectors: DataFrame, id_col: str, embedding: str, block: int) -> DataFrame:
    """Vectors in blocks of at most ``block``, one row each: ``ids`` and their numbers one after the other in ``flat``."""
    kind = dict(vectors.dtypes)[id_col]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = batch.filter(batch.column(1).is_valid())
            for at in range(0, keep.num_rows, block):
                part = keep.slice(at, block)
                columns = [pa.array([part.column(0)], pa.list_(part.column(0).type)), pa.array([part.column(1).flatten().cast(pa.float64())], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, ["ids", "flat"])

    return vectors.select(id_col, embedding).mapInArrow(pack, f"ids array<{kind}>, flat array<double>")


def vector_search_all(vectors: DataFrame, queries: DataFrame, k: int = 10, *, id_col: str = "vec_id", embedding: str = "embedding", block: int = 4096) -> DataFrame:
    """``query_id``, ``id_col``, ``cosine``, ``rank``: for each query row its ``k`` nearest others, exactly.

    Queries and vectors are packed into blocks of at most ``block``, and each block of queries meets each of vectors in one
    product of matrices that keeps ``k`` candidates for each query, so what is shuffled is bounded by queries x blocks of vectors x k.
    Nothing of it passes through the driver. Rows without a vector are skipped.
    """
    ship(vectors.sparkSession)
    kind = dict(vectors.dtypes)[id_col]

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                asked, mine = batch.column(0)[row].values, batch.column(2)[row].values
                q, v = (batch.column(c)[row].values.to_numpy().reshape(len(ids), -1) for c, ids in ((1, asked), (3, mine)))
                cosines = q @ v.T
                m = min(k + 1, len(mine))
                top = np.argpartition(-cosines, m - 1, axis=1)[:, :m]
                rows = np.repeat(np.arange(len(asked)), m)
                columns = [asked.take(pa.array(rows)), mine.take(pa.array(top.ravel())), pa.array(cosines[rows, top.ravel()])]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", id_col, "cosine"])

    asked = _packed(queries, id_col, embedding, block).toDF("asked", "q")
    pairs = asked.crossJoin(_packed(vectors, id_col, embedding, block))  # blocks of a stated query set against blocks of all rows
    found = pairs.mapInArrow(nearest, f"query_id {kind}, {id_col} {kind}, cosine double")
    return ranked(found.where(F.col("query_id") != F.col(id_col)), k, by=["query_id"], score="cosine", tie=id_col)


@dataclass(frozen=True)
class LexicalIndex:
    """Postings (``id``, ``term``, ``tf``), lengths (``id``, ``dl``), document frequencies (``term``, ``df``) and the two numbers of the whole index."""

    postings: DataFrame
    lengths: DataFrame
    frequencies: DataFrame
    totals: DataFrame


def lexical_index(docs: DataFrame, *, id_col: str, english: bool = False) -> LexicalIndex:
    """An inverted index over the whole collection; filters never change its statistics. Texts without terms count as empty documents."""
    if english:
        ship(docs.sparkSession)

        def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([english_terms(t) for t in b.column(1).to_pylist()], pa.list_(pa.string()))], ["id", "terms"])

        kind = dict(docs.dtypes)[id_col]
        analysed = docs.select(F.col(id_col).alias("id"), "text").mapInArrow(terms, f"id {kind}, terms array<string>")
    else:
        analysed = docs.select(F.col(id_col).alias("id"), F.coalesce(plain_terms("text"), F.expr("cast(array() as array<string>)")).alias("terms"))
    # Texts are analysed once: their terms are written to the checkpoint folder, and all else is read from these.
    analysed = checkpointed(analysed)
    lengths = analysed.select("id", F.size("terms").alias("dl"))
    # An outer explode: from an inner one the planner infers a filter on the number of terms.
    said = analysed.select("id", F.size("terms").alias("dl"), F.explode_outer("terms").alias("term")).where("term IS NOT NULL")
    postings = said.groupBy("id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    frequencies = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return LexicalIndex(postings, lengths, frequencies, lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl")))


def bm25_scores(index: LexicalIndex, queries: DataFrame) -> DataFrame:
    """``query_id``, ``id``, ``score``: of all documents with any term of the query; a repeated term counts each time.

    ``queries``: ``query_id``, ``term``. They are few terms against the postings, which is for the planner to see.
    """
    asked = queries.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    # Only postings of asked terms matter, which the planner filters before it counts them.
    own = index.postings.join(queries.select("term").distinct(), "term", "left_semi")
    known = own.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(asked, "term").crossJoin(F.broadcast(index.totals))
    known = known.withColumn("idf", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    hits = own.join(known.drop("df"), "term")
    part = F.col("times") * F.col("idf") * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.groupBy("query_id", "id").agg(F.sum(part).alias("score"))


def query_terms(spark, texts: dict[Any, str], *, english: bool = False) -> DataFrame:
    import re

    split = english_terms if english else lambda t: re.findall("[a-z0-9]+", t.lower())
    rows = [(q, t) for q, text in texts.items() for t in split(text)]
    kind = "string" if any(isinstance(q, str) for q in texts) else "bigint"
    if not rows:
        return spark.createDataFrame([], f"query_id {kind}, term string")
    # Literals, so that the planner knows how few they are.
    pairs = F.array(*[F.struct(F.lit(q).cast(kind).alias("query_id"), F.lit(t).alias("term")) for q, t in rows])
    return spark.range(1).select(F.inline(pairs))


def reciprocal_rank_fusion(lists: DataFrame, *, by: Sequence[str], item: str, retriever: str = "retriever", rank: str = "rank", k: int = RRF_K, limit: int | None = None) -> DataFrame:
    """``by``, ``item``, ``score`` (sum of 1 / (k + rank) over the lists), ``sources`` and the fused ``rank``; equal scores by ``item``.

    Each list gives an item its own rank, wherever the list has gaps.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    fused = lists.groupBy(*by, item).agg(
        F.sum(1.0 / (k + F.col(rank))).alias("score"), F.sort_array(F.collect_list(F.struct(F.col(retriever).alias("retriever"), F.col(rank).alias("rank")))).alias("sources")
    )
    # Two sums of the same terms in another order must tie.
    fused = fused.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.round("score", 12)), F.col(item))))
    return fused if limit is None else fused.where(F.col("rank") <= limit)


def provenance(sources: Column) -> Column:
    """Where a fused hit is from: the first letter of each list and the rank there."""
    return F.array_join(F.transform(sources, lambda s: F.concat(F.substring(s["retriever"], 1, 1), F.lit("#"), s["rank"].cast("string"))), " ")


def hybrid(vector_hits: DataFrame, lexical_hits: DataFrame, *, by: Sequence[str], item: str, k: int = 10, candidates: int = CANDIDATES) -> DataFrame:
    """Fusion of the best ``candidates`` of two ranked lists."""
    if candidates < k:
        raise ValueError("candidates must not be fewer than k")
    columns = [*by, item, "rank"]
    lists = [d.where(F.col("rank") <= candidates).select(*columns, F.lit(name).alias("retriever")) for name, d in (("bm25", lexical_hits), ("vector", vector_hits))]
    return reciprocal_rank_fusion(lists[0].unionByName(lists[1]), by=by, item=item, limit=k)


def fan_out(scored: DataFrame, peers: Sequence[str], *, by: Sequence[str] = (), n_per_company: int = 3, score: str = "score", tie: str = "chunk_id") -> DataFrame:
    """The best ``n_per_company`` of each peer, dealt in turns: all first ones in the order of the peers, then all second ones."""
    if len(set(peers)) != len(peers):
        raise ValueError("a peer is named twice")
    place = F.array_position(F.array(*[F.lit(p) for p in peers]), F.col("ticker")) - 1
    rows = scored.where(F.col("ticker").isin(*peers)).withColumn("peer", place.cast("int"))
    rows = rows.withColumn("turn", F.row_number().over(Window.partitionBy(*by, "ticker").orderBy(F.desc(score), F.col(tie)))).where(F.col("turn") <= n_per_company)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("turn", "peer")))


def fan_out_empty(found: DataFrame, questions: DataFrame, peers: Sequence[str], *, by: Sequence[str]) -> DataFrame:
    """Peers for which a question found nothing."""
    asked = questions.select(*by).distinct().withColumn("ticker", F.explode(F.array(*[F.lit(p) for p in peers])))
    return asked.join(found.select(*by, "ticker").distinct(), [*by, "ticker"], "left_anti")


def section_targeted(scored: DataFrame, items: Sequence[str], k: int = 10, **how: Any) -> DataFrame:
    if not items:
        raise ValueError("name at least one item")
    return ranked(Filters.of(items=items).apply(scored), k, **how)


MODES = ("vector", "bm25", "hybrid")


def search(mode: str, *, vectors: DataFrame | None = None, encode: Callable[[str], Sequence[float]] | None = None, index: LexicalIndex | None = None, question: str, vector_question: str | None = None, k: int = 10, where: Column | None = None, id_col: str = "chunk_id", rows: DataFrame | None = None) -> DataFrame:
    """One question in one of the three modes over chunk ``rows`` (``vector_question``: what the encoder gets instead of it); the filter comes before the best ``k`` and leaves BM25's statistics alone."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    if mode != "bm25" and encode is None:
        raise ValueError(f"mode {mode} needs an encoder")
    depth = k if mode != "hybrid" else CANDIDATES
    near = lexical = None
    if mode != "bm25":
        near = vector_search(vectors, encode(vector_question or question), depth, where=where, tie=id_col).select(id_col, "score", "rank")
    if mode != "vector":
        scores = bm25_scores(index, query_terms(rows.sparkSession, {0: question}, english=True)).withColumnRenamed("id", id_col)
        allowed = rows if where is None else rows.where(where)
        lexical = ranked(scores.join(allowed.select(id_col), id_col, "left_semi"), depth, tie=id_col).select(id_col, "score", "rank")
    if mode == "hybrid":
        one = [d.withColumn("q", F.lit(0)) for d in (near, lexical)]
        return hybrid(*one, by=["q"], item=id_col, k=k).drop("q")
    return near if lexical is None else lexical
