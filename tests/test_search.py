from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import vectors as vec
from tidemark.functions.analysis import english_terms, stem
from tidemark.operators import evaluate as ev
from tidemark.operators import search as se


@pytest.mark.parametrize(
    ("word", "out"),
    [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("conditional", "condit"), ("triplicate", "triplic"), ("hopeful", "hope"), ("revival", "reviv"), ("adjustment", "adjust"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("controll", "control"), ("sky", "sky"), ("as", "as")],
)
def test_stems(word, out):
    assert stem(word) == out


def test_english_terms():
    assert english_terms("The Company's allowances for losses") == ["compani", "allow", "loss"]
    assert english_terms(None) == []


def test_rrf(spark):
    lists = spark.createDataFrame([(1, "vector", "a", 1), (1, "vector", "b", 2), (1, "vector", "c", 3), (1, "bm25", "c", 1), (1, "bm25", "a", 2), (1, "bm25", "d", 3)], "q int, retriever string, item string, rank int")
    got = se.reciprocal_rank_fusion(lists, by=["q"], item="item").orderBy("rank").collect()
    assert [r["item"] for r in got] == ["a", "c", "b", "d"]
    assert got[0]["score"] == pytest.approx(1 / 61 + 1 / 62) and got[3]["score"] == pytest.approx(1 / 63)
    assert [(s["retriever"], s["rank"]) for s in got[0]["sources"]] == [("bm25", 2), ("vector", 1)]
    with pytest.raises(ValueError):
        se.reciprocal_rank_fusion(lists, by=["q"], item="item", k=0)
    with pytest.raises(ValueError):
        se.hybrid(lists, lists, by=["q"], item="item", k=10, candidates=5)


def test_filter_before_k(spark):
    rows = [(n, [1.0, 0.0] if n < 50 else [0.6, 0.8], n >= 50) for n in range(60)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<float>, wanted boolean")
    assert se.vector_search(df, [1.0, 0.0], 10, where=F.col("wanted")).count() == 10
    assert se.vector_search(df, [1.0, 0.0], 10).where("wanted").count() == 0
    assert se.vector_search_all(df, df.where("vec_id % 20 = 0"), 5, block=2).count() == 15
    plan = se.vector_search(df, [1.0, 0.0], 10)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan or "Limit" in plan


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "loan loss loan"), (2, "loan growth"), (3, ""), (4, None)], "id int, text string")
    index = se.lexical_index(docs, id_col="id")
    got = {r["id"]: r["score"] for r in se.bm25_scores(index, se.query_terms(spark, {0: "loan loss loss"})).collect()}
    avg = 5 / 4
    idf = lambda df: math.log(1 + (4 - df + 0.5) / (df + 0.5))
    part = lambda tf, dl: tf / (tf + 1.2 * (0.25 + 0.75 * dl / avg))
    assert got == {1: pytest.approx(idf(2) * part(2, 3) + 2 * idf(1) * part(1, 3)), 2: pytest.approx(idf(2) * part(1, 2))}
    assert se.bm25_scores(index, se.query_terms(spark, {0: "..."})).count() == 0


def test_search_modes(spark):
    rows = spark.createDataFrame([("a", "credit losses grew", "X"), ("b", "rewards growth", "Y")], "chunk_id string, text string, ticker string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0], "X"), ("b", [0.0, 1.0], "Y")], "chunk_id string, embedding array<float>, ticker string")
    index = se.lexical_index(rows, id_col="chunk_id", english=True)
    how = {"vectors": vectors, "encode": lambda t: [0.0, 1.0], "index": index, "rows": rows, "question": "credit loss", "k": 2}
    assert [r["chunk_id"] for r in se.search("bm25", **how).collect()] == ["a"]
    assert [r["chunk_id"] for r in se.search("vector", **how).orderBy("rank").collect()] == ["b", "a"]
    assert [r["chunk_id"] for r in se.search("hybrid", **how).orderBy("rank").collect()] == ["a", "b"]
    assert [r["chunk_id"] for r in se.search("hybrid", where=F.col("ticker") == "Y", **how).collect()] == ["b"]
    with pytest.raises(ValueError):
        se.search("other", question="x")
    with pytest.raises(ValueError):
        se.search("vector", question="x")


def test_filters():
    f = se.Filters.of(ticker=[" jpm "], items=["1a"])
    assert f.ticker == ("JPM",) and f.merged(se.Filters.of(ticker=["C"])).ticker == ("C",) and f.merged(se.Filters()).items == ("1A",)


def test_fan_out(spark):
    rows = spark.createDataFrame([("A", "a1", 0.9), ("A", "a2", 0.8), ("A", "a3", 0.7), ("B", "b1", 0.99), ("Z", "z", 1.0)], "ticker string, chunk_id string, score double").withColumn("q", F.lit(1))
    got = se.fan_out(rows, ["A", "B", "C"], by=["q"], n_per_company=2)
    assert [r["chunk_id"] for r in got.orderBy("rank").collect()] == ["a1", "b1", "a2"]
    assert [r["ticker"] for r in se.fan_out_empty(got, rows, ["A", "B", "C"], by=["q"]).collect()] == ["C"]
    with pytest.raises(ValueError):
        se.fan_out(rows, ["A", "A"])
    with pytest.raises(ValueError):
        se.section_targeted(rows, [])


@pytest.mark.parametrize(("score", "cosine"), [(2.0, 1.0), (1.72, 0.72), (1.0, 0.0), (0.5, -1.0), (1 / 1.5716, -0.5716)])
def test_score_transform(spark, score, cosine):
    row = spark.range(1).select(vec.cosine_of_score(F.lit(score)), vec.score_of_cosine(F.lit(cosine))).first()
    assert row[0] == pytest.approx(cosine) and row[1] == pytest.approx(score)


def test_vectors(spark):
    row = spark.createDataFrame([([3.0, 4.0, 12.0], [0.0, 0.0])], "v array<float>, z array<float>").select(
        vec.norm("v"), vec.l2_normalized("z"), vec.truncated("v", 2), vec.dot("v", "v"), vec.dot_with("v", [1.0, 0.5, 0.0])
    ).first()
    assert row[0] == 13.0 and row[1] == [0.0, 0.0] and row[2] == pytest.approx([0.6, 0.8]) and row[3] == 169.0 and row[4] == 5.0


HITS = "question_id bigint, config string, position int, accession string, ticker string, char_start bigint, char_end bigint"
SPANS = "question_id bigint, span_id bigint, accession string, span_start bigint, span_end bigint, grade int"


def test_metrics_by_hand(spark):
    hits = spark.createDataFrame(
        [(1, "m", 1, "x", "A", 0, 1000), (1, "m", 2, "x", "A", 900, 2000), (1, "m", 3, "y", "B", 0, 500), (2, "m", 1, "x", "A", 0, 10)], HITS
    )
    spans = spark.createDataFrame([(1, 1, "x", 500, 800, 1), (1, 2, "x", 850, 1100, 2), (1, 3, "z", 0, 100, 1), (1, 4, "y", 0, 50, 0)], SPANS)
    got = {r["question_id"]: r for r in ev.question_scores(hits, spans, expected=spark.createDataFrame([(1, ["A", "C"])], "question_id bigint, tickers array<string>")).collect()}
    r = got[1]
    # Passage 2 shares 150 with the first hit and 200 with the second, which is enough.
    dcg, ideal = 1 / math.log2(2) + 2 / math.log2(3), 2 / math.log2(2) + 1 / math.log2(3) + 1 / math.log2(4)
    assert (r["recall_10"], r["reciprocal_rank"], r["unjudged_10"], r["issuers"]) == (pytest.approx(2 / 3), 1.0, 0, 2)
    assert r["ndcg_10"] == pytest.approx(dcg / ideal) and r["coverage_10"] == 0.5
    assert got[2]["recall_10"] is None and got[2]["ndcg_10"] is None and got[2]["unjudged_10"] == 1 and not got[2]["labelled"]
    grades = {(g["question_id"], g["position"]): g["grade"] for g in ev.graded_hits(hits, spans).collect()}
    assert grades == {(1, 1): 1, (1, 2): 2, (1, 3): 0, (2, 1): None}


def test_a_passage_is_credited_once(spark):
    hits = spark.createDataFrame([(1, "m", 1, "x", "A", 0, 1000), (1, "m", 2, "x", "A", 0, 1000)], HITS)
    spans = spark.createDataFrame([(1, 1, "x", 0, 500, 2)], SPANS)
    assert ev.question_scores(hits, spans).first()["ndcg_10"] == pytest.approx(1.0)


def test_kappa(spark):
    df = spark.createDataFrame([(2, 2), (2, 1), (0, 0), (0, 0), (1, None)], "a int, b int")
    r = ev.agreement(df, "a", "b").first()
    assert r["n"] == 4 and r["percent_agreement"] == 0.75 and r["kappa"] == pytest.approx((0.75 - 0.375) / (1 - 0.375))
    assert ev.agreement(df.where("a = 0"), "a", "b").first()["kappa"] == 1.0
    with pytest.raises(Exception, match="no pairs"):
        ev.agreement(df.limit(0), "a", "b").collect()


def test_win_loss_tolerance(spark):
    df = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5 + 1e-12), (2, "a", 0.9), (2, "b", 0.1), (3, "a", None), (3, "b", 1.0)], "question_id int, config string, ndcg_10 double")
    assert tuple(ev.win_loss(df).first()) == ("a", "b", 1, 0, 1)
