"""Search, fusion and evaluation over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import vectors as vec
from tidemark.operators import evaluate as ev
from tidemark.operators import search as se
from tidemark.plans.registry import Registry, table
from tidemark.session import spread

query = Registry()

# A question vector, so that both engines ask the same.
_Q = [round(((i * 37) % 64 - 31.5) / 147.8, 6) for i in range(64)]
_QSQL = "CAST([" + ", ".join(map(str, _Q)) + "] AS DOUBLE[])"
_DOT = f"list_dot_product(CAST(embedding AS DOUBLE[]), {_QSQL})"
_SCORE = "CASE WHEN {0} >= 0 THEN 1 + {0} ELSE 1 / (1 - {0}) END"


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The retrievers' lists: an item once, at its best rank, with its place among all that have a rank."""
    best = table(spark, sf_dir, "hits").where("hit_rank IS NOT NULL").groupBy("question_id", "retriever", "row_id").agg(F.min("hit_rank").alias("rank"))
    w = Window.partitionBy("question_id", "retriever").orderBy("rank", "row_id")
    return best.withColumn("position", F.row_number().over(w))


_LISTS = """lists AS (SELECT question_id, retriever, row_id, min(hit_rank) AS rank, row_number() OVER (PARTITION BY question_id, retriever ORDER BY min(hit_rank), row_id) AS position
  FROM hits WHERE hit_rank IS NOT NULL GROUP BY question_id, retriever, row_id)"""


@query("knn_topk", f"SELECT vec_id, label, round({_DOT}, 6) AS cosine, round({_SCORE.format(_DOT)}, 6) AS score FROM embeddings ORDER BY {_DOT} DESC, vec_id LIMIT 10")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = se.vector_search(table(spark, sf_dir, "embeddings"), _Q, 10)
    return found.select("vec_id", "label", F.round("cosine", 6).alias("cosine"), F.round("score", 6).alias("score"))


@query("knn_filtered", f"SELECT vec_id, round({_DOT}, 6) AS cosine FROM embeddings WHERE label = 3 ORDER BY {_DOT} DESC, vec_id LIMIT 10")
def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter comes before the best ten are taken."""
    found = se.vector_search(table(spark, sf_dir, "embeddings"), _Q, 10, where=F.col("label") == 3)
    return found.select("vec_id", F.round("cosine", 6).alias("cosine"))


@query(
    "knn_all",
    """SELECT query_id, vec_id, round(cosine, 6) AS cosine, CAST(rank AS INTEGER) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS cosine,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) DESC, e.vec_id) AS rank
    FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0) WHERE rank <= 10""",
)
def knn_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth vector is a query against all vectors."""
    rows = table(spark, sf_dir, "embeddings")
    found = se.vector_search_all(rows, rows.where("vec_id % 20 = 0"), 10)
    return found.select("query_id", "vec_id", F.round("cosine", 6).alias("cosine"), "rank")


@query(
    "vector_norms",
    """SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm,
    abs(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) - 1) <= 0.001 AS is_unit FROM embeddings""",
)
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vec.norm("embedding"), 6).alias("norm"), (F.abs(vec.norm("embedding") - 1) <= 0.001).alias("is_unit"))


@query(
    "vector_truncated",
    """WITH t AS (SELECT vec_id, CAST(embedding[1:16] AS DOUBLE[]) AS v FROM embeddings)
    SELECT vec_id, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS x0, round(v[16] / sqrt(list_dot_product(v, v)), 6) AS x15, len(v) AS width FROM t""",
)
def vector_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "embeddings").select("vec_id", vec.truncated("embedding", 16).alias("v"))
    return t.select("vec_id", F.round(F.col("v")[0], 6).alias("x0"), F.round(F.col("v")[15], 6).alias("x15"), F.size("v").cast("bigint").alias("width"))


@query("vector_score_round_trip", f"SELECT vec_id, round({_DOT}, 6) AS cosine FROM embeddings")
def vector_score_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosines turned into index scores and back."""
    c = vec.dot_with("embedding", _Q)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vec.cosine_of_score(vec.score_of_cosine(c)), 6).alias("cosine"))


# Questions for lexical search.
_TEXTS = {1: "allowance for credit losses", 2: "lease properties renewal options", 3: "court hearing range range", 4: "risque de liquidité", 5: "secured borrowing cost"}
_TERMS = "(VALUES " + ", ".join(f"({q}, '{t}')" for q, text in _TEXTS.items() for t in __import__("re").findall("[a-z0-9]+", text.lower())) + ") AS q(query_id, term)"
_BM25 = f"""WITH a AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS terms FROM documents),
n AS (SELECT count(*) AS n_docs, avg(len(terms)) AS avgdl FROM a),
p AS (SELECT doc_id, len(terms) AS dl, unnest(terms) AS term FROM a),
t AS (SELECT doc_id, dl, term, count(*) AS tf FROM p GROUP BY ALL),
d AS (SELECT term, count(*) AS df FROM t GROUP BY term),
q AS (SELECT query_id, term, count(*) AS times FROM {_TERMS} GROUP BY ALL),
s AS (SELECT query_id, doc_id, sum(times * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM q JOIN d USING (term) JOIN t USING (term) CROSS JOIN n GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)"""


def _bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = se.lexical_index(spread(table(spark, sf_dir, "documents")), id_col="doc_id")
    scores = se.bm25_scores(index, se.query_terms(spark, _TEXTS)).withColumnRenamed("id", "doc_id")
    return scores.withColumn("score", F.round("score", 9))


@query("bm25_topk", f"{_BM25} SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.ranked(_bm25(spark, sf_dir), 10, by=["query_id"], tie="doc_id").select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(
    "bm25_filtered",
    f"""{_BM25}, f AS (SELECT s.query_id, s.doc_id, s.score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s JOIN documents USING (doc_id) WHERE source = 'exhibit_13')
    SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, round(score, 6) AS score FROM f WHERE rank <= 10""",
)
def bm25_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter chooses documents and leaves the statistics of the whole index as they are."""
    allowed = table(spark, sf_dir, "documents").where("source = 'exhibit_13'").select("doc_id")
    found = se.ranked(_bm25(spark, sf_dir).join(allowed, "doc_id", "left_semi"), 10, by=["query_id"], tie="doc_id")
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query("bm25_english")
def bm25_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With stop words, possessives and stems."""
    index = se.lexical_index(spread(table(spark, sf_dir, "documents")), id_col="doc_id", english=True)
    return se.ranked(se.bm25_scores(index, se.query_terms(spark, _TEXTS, english=True)), 10, by=["query_id"], tie="id").withColumnRenamed("id", "doc_id")


_FUSED = f"""WITH {_LISTS}, f AS (SELECT question_id, row_id, sum(1.0 / (60 + position)) AS score, array_to_string(list_sort(list(retriever || '#' || position)), ' ') AS sources
  FROM lists WHERE retriever IN ('bm25', 'vector') AND position <= 100 GROUP BY ALL),
g AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 12) DESC, row_id) AS rank FROM f)"""


def _fused(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    lists = _lists(spark, sf_dir).drop("rank").withColumnRenamed("position", "rank")
    one = {r: lists.where(F.col("retriever") == r) for r in ("vector", "bm25")}
    return se.hybrid(one["vector"], one["bm25"], by=["question_id"], item="row_id", k=k)


@query("rrf_hybrid", f"{_FUSED} SELECT question_id, row_id, round(score, 9) AS score, sources, CAST(rank AS INTEGER) AS rank FROM g WHERE rank <= 10")
def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = F.array_join(F.transform("sources", lambda s: F.concat_ws("#", s["retriever"], s["rank"].cast("string"))), " ")
    return _fused(spark, sf_dir, 10).select("question_id", "row_id", F.round("score", 9).alias("score"), sources.alias("sources"), "rank")


@query("rrf_provenance", f"{_FUSED.replace("retriever || '#' || position", "left(retriever, 1) || '#' || position")} SELECT question_id, row_id, sources AS label FROM g WHERE rank <= 10")
def rrf_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir, 10).select("question_id", "row_id", se.provenance(F.col("sources")).alias("label"))


_SCORED = """scored AS (SELECT question_id, row_id, ticker, max(score) AS score FROM hits WHERE retriever = 'vector' AND score IS NOT NULL AND NOT isnan(score) GROUP BY ALL)"""
# The peers that are compared.
_PEERS = ["HVQT", "DDGNN", "KAMYO", "ZZNONE"]
_PEERSQL = "[" + ", ".join(f"'{p}'" for p in _PEERS) + "]"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "hits").where("retriever = 'vector' AND score IS NOT NULL AND NOT isnan(score)")
    return hits.groupBy("question_id", "row_id", "ticker").agg(F.max("score").alias("score"))


@query(
    "fan_out",
    f"""WITH {_SCORED}, t AS (SELECT *, list_position({_PEERSQL}, ticker) - 1 AS peer, row_number() OVER (PARTITION BY question_id, ticker ORDER BY score DESC, row_id) AS turn FROM scored WHERE list_contains({_PEERSQL}, ticker))
    SELECT question_id, row_id, ticker, CAST(turn AS INTEGER) AS turn, CAST(row_number() OVER (PARTITION BY question_id ORDER BY turn, peer) AS INTEGER) AS rank FROM t WHERE turn <= 3""",
)
def fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.fan_out(_scored(spark, sf_dir), _PEERS, by=["question_id"], tie="row_id").select("question_id", "row_id", "ticker", "turn", "rank")


@query(
    "fan_out_empty",
    f"WITH {_SCORED} SELECT q.question_id, p.ticker FROM (SELECT DISTINCT question_id FROM hits) q, (SELECT unnest({_PEERSQL}) AS ticker) p WHERE NOT EXISTS (SELECT 1 FROM scored s WHERE s.question_id = q.question_id AND s.ticker = p.ticker)",
)
def fan_out_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = se.fan_out(_scored(spark, sf_dir), _PEERS, by=["question_id"], tie="row_id")
    return se.fan_out_empty(found, table(spark, sf_dir, "hits"), _PEERS, by=["question_id"])


@query(
    "section_targeted",
    f"""WITH {_SCORED}, s AS (SELECT c.*, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, row_id) AS rank FROM scored c JOIN manifest m USING (row_id) WHERE list_has_any(m.items, ['1A', '7']))
    SELECT question_id, row_id, CAST(rank AS INTEGER) AS rank FROM s WHERE rank <= 5""",
)
def section_targeted(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir).join(table(spark, sf_dir, "manifest").select("row_id", "items"), "row_id")
    return se.section_targeted(scored, ["1a", "7"], 5, by=["question_id"], tie="row_id").select("question_id", "row_id", "rank")


@query("metadata_filter", "SELECT row_id FROM manifest WHERE ticker IN ('HVQT', 'DDGNN') AND fiscal_year IN (2020, 2021) AND form = '10-K' AND list_has_any(items, ['7', '7A'])")
def metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = se.Filters.of(ticker=["hvqt", " ddgnn "], fiscal_year=[2020, 2021], form=["10-k"]).merged(se.Filters.of(items=["7", "7a"]))
    return wanted.apply(table(spark, sf_dir, "manifest")).select("row_id")


@query(
    "compare_modes",
    f"""WITH {_LISTS}, t AS (SELECT l.question_id, l.retriever, l.row_id, m.ticker FROM lists l JOIN manifest m USING (row_id) WHERE position <= 10),
    v AS (SELECT * FROM t WHERE retriever = 'vector'), b AS (SELECT * FROM t WHERE retriever = 'bm25')
    SELECT question_id, (SELECT count(*) FROM v JOIN b USING (question_id, row_id) WHERE v.question_id = q.question_id) AS common,
    (SELECT count(DISTINCT ticker) FROM v WHERE v.question_id = q.question_id) AS vector_companies, (SELECT count(DISTINCT ticker) FROM b WHERE b.question_id = q.question_id) AS bm25_companies
    FROM (SELECT DISTINCT question_id FROM t WHERE retriever IN ('vector', 'bm25')) q""",
)
def compare_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two modes have in common among their best ten, and over how many companies each spreads."""
    top = _lists(spark, sf_dir).where("position <= 10 AND retriever IN ('vector', 'bm25')").join(table(spark, sf_dir, "manifest").select("row_id", "ticker"), "row_id")
    per = lambda r, c: F.collect_set(F.when(F.col("retriever") == r, F.col(c)))
    rows = top.groupBy("question_id").agg(per("vector", "row_id").alias("v"), per("bm25", "row_id").alias("b"), per("vector", "ticker").alias("vt"), per("bm25", "ticker").alias("bt"))
    return rows.select("question_id", F.size(F.array_intersect("v", "b")).cast("bigint").alias("common"), F.size("vt").cast("bigint").alias("vector_companies"), F.size("bt").cast("bigint").alias("bm25_companies"))


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The judged manifest rows as graded passages; of repeated judgments the best grade."""
    judged = table(spark, sf_dir, "judgments").where("grade IS NOT NULL").groupBy("question_id", "row_id").agg(F.max("grade").alias("grade"))
    rows = table(spark, sf_dir, "manifest").select("row_id", "accession", F.col("char_start").alias("span_start"), F.col("char_end").alias("span_end"), "text_sha256")
    return judged.join(rows, "row_id").withColumnRenamed("row_id", "span_id")


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "manifest").select("row_id", "accession", "ticker", "char_start", "char_end")
    return _lists(spark, sf_dir).where("position <= 10").withColumnRenamed("retriever", "config").join(rows, "row_id")


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.question_scores(_hits(spark, sf_dir), _spans(spark, sf_dir))


_EVAL = f"""WITH {_LISTS}, spans AS (SELECT j.question_id, j.row_id AS span_id, max(j.grade) AS grade, m.accession, m.char_start AS span_start, m.char_end AS span_end, m.text_sha256
  FROM judgments j JOIN manifest m USING (row_id) WHERE j.grade IS NOT NULL GROUP BY ALL),
top AS (SELECT l.question_id, l.retriever AS config, l.position, l.row_id, m.accession, m.ticker, m.char_start, m.char_end FROM lists l JOIN manifest m USING (row_id) WHERE l.position <= 10),
cov AS (SELECT t.question_id, t.config, t.position, s.span_id, s.grade FROM top t JOIN spans s ON t.question_id = s.question_id AND t.accession = s.accession
  AND greatest(0, least(t.char_end, s.span_end) - greatest(t.char_start, s.span_start)) >= least(200, s.span_end - s.span_start)),
fst AS (SELECT question_id, config, span_id, grade, min(position) AS position FROM cov GROUP BY ALL),
rel AS (SELECT question_id, count(*) AS n FROM spans WHERE grade >= 1 GROUP BY ALL),
idl AS (SELECT question_id, sum(grade / log2(r + 1)) AS ideal FROM (SELECT question_id, grade, row_number() OVER (PARTITION BY question_id ORDER BY grade DESC, span_id) AS r FROM spans WHERE grade > 0) WHERE r <= 10 GROUP BY ALL),
fnd AS (SELECT question_id, config, count(*) FILTER (position <= 5) AS f5, count(*) AS f10, min(position) AS p FROM fst WHERE grade >= 1 GROUP BY ALL),
dcg AS (SELECT question_id, config, sum(g / log2(position + 1)) AS dcg FROM (SELECT question_id, config, position, max(grade) AS g FROM fst GROUP BY ALL) GROUP BY ALL),
jud AS (SELECT question_id, config, count(DISTINCT position) AS j FROM cov GROUP BY ALL),
bas AS (SELECT question_id, config, count(*) AS n_hits, count(DISTINCT ticker) AS issuers FROM top GROUP BY ALL),
scores AS (SELECT question_id, config, n IS NOT NULL AS labelled, CASE WHEN n IS NOT NULL THEN coalesce(f5, 0) / n END AS recall_5, CASE WHEN n IS NOT NULL THEN coalesce(f10, 0) / n END AS recall_10,
  CASE WHEN n IS NOT NULL THEN coalesce(1 / p, 0) END AS reciprocal_rank, CASE WHEN n IS NOT NULL THEN coalesce(dcg, 0) / ideal END AS ndcg_10, n_hits - coalesce(j, 0) AS unjudged_10, issuers
  FROM bas LEFT JOIN fnd USING (question_id, config) LEFT JOIN dcg USING (question_id, config) LEFT JOIN jud USING (question_id, config) LEFT JOIN rel USING (question_id) LEFT JOIN idl USING (question_id))"""
_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in ("recall_5", "recall_10", "reciprocal_rank", "ndcg_10"))


@query("eval_scores", f"{_EVAL} SELECT question_id, config, labelled, {_ROUNDED}, unjudged_10, issuers FROM scores")
def eval_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scores(spark, sf_dir)
    return s.select("question_id", "config", "labelled", *[F.round(c, 6).alias(c) for c in ("recall_5", "recall_10", "reciprocal_rank", "ndcg_10")], "unjudged_10", "issuers")


@query(
    "eval_coverage",
    f"""{_EVAL}, x AS (SELECT question_id, list(DISTINCT ticker) AS wanted FROM spans JOIN manifest ON span_id = row_id WHERE grade >= 1 GROUP BY question_id),
    y AS (SELECT question_id, config, list(DISTINCT ticker) AS had FROM top GROUP BY ALL)
    SELECT question_id, config, issuers, round(len(list_intersect(had, wanted)) / len(wanted), 6) AS coverage_10 FROM scores JOIN y USING (question_id, config) LEFT JOIN x USING (question_id)""",
)
def eval_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the companies with a relevant passage the share that a list has among its best ten."""
    spans = _spans(spark, sf_dir)
    tickers = table(spark, sf_dir, "manifest").select(F.col("row_id").alias("span_id"), "ticker")
    expected = spans.where("grade >= 1").join(tickers, "span_id").groupBy("question_id").agg(F.collect_set("ticker").alias("tickers"))
    scores = ev.question_scores(_hits(spark, sf_dir), spans, expected=expected)
    return scores.select("question_id", "config", "issuers", F.round("coverage_10", 6).alias("coverage_10"))


@query(
    "eval_hit_grades",
    f"{_EVAL} SELECT t.question_id, t.config, t.position, t.row_id, max(c.grade) AS grade FROM top t LEFT JOIN cov c USING (question_id, config, position) GROUP BY ALL",
)
def eval_hit_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.graded_hits(_hits(spark, sf_dir), _spans(spark, sf_dir)).select("question_id", "config", F.col("position").cast("bigint").alias("position"), "row_id", "grade")


_MEANS = ", ".join(f"round(avg({c}) FILTER (labelled), 6) AS {c}" for c in ("recall_5", "recall_10", "reciprocal_rank", "ndcg_10"))


@query("eval_summary", f"{_EVAL} SELECT config, count(*) AS n_questions, count(*) FILTER (labelled) AS n_labelled, {_MEANS}, round(coalesce(avg(unjudged_10) FILTER (labelled), 0), 6) AS unjudged_10 FROM scores GROUP BY config")
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ev.summarized(_scores(spark, sf_dir))
    return s.select("config", "n_questions", "n_labelled", *[F.round(c, 6).alias(c) for c in ("recall_5", "recall_10", "reciprocal_rank", "ndcg_10", "unjudged_10")])


@query(
    "eval_win_loss",
    f"""{_EVAL}, p AS (SELECT a.config AS config_a, b.config AS config_b, a.ndcg_10 AS x, b.ndcg_10 AS y, abs(a.ndcg_10 - b.ndcg_10) <= greatest(1e-9 * greatest(abs(a.ndcg_10), abs(b.ndcg_10)), 1e-9) AS tie
      FROM scores a JOIN scores b ON a.question_id = b.question_id AND a.config < b.config WHERE a.ndcg_10 IS NOT NULL AND b.ndcg_10 IS NOT NULL)
    SELECT config_a, config_b, count(*) FILTER (NOT tie AND x > y) AS wins, count(*) FILTER (NOT tie AND x < y) AS losses, count(*) FILTER (tie) AS ties FROM p GROUP BY ALL""",
)
def eval_win_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.win_loss(_scores(spark, sf_dir))


# A made-up rule stands for the tagger, so that there are tags to count.
_CAUSES = "CASE WHEN issuers > 8 THEN 'scattered' WHEN recall_10 = 0 THEN 'missed' ELSE 'late' END"


@query(
    "eval_failures",
    f"""{_EVAL}, t AS (SELECT config, {_CAUSES} AS cause FROM scores WHERE labelled AND (recall_10 < 1 OR reciprocal_rank < 0.5))
    SELECT cause, count(*) FILTER (config = 'bm25') AS bm25, count(*) FILTER (config = 'hybrid') AS hybrid, count(*) FILTER (config = 'vector') AS vector FROM t GROUP BY cause""",
)
def eval_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scores(spark, sf_dir)
    tags = ev.needs_failure_tag(s).join(s, ["question_id", "config"]).select("question_id", "config", F.expr(_CAUSES).alias("cause"))
    return ev.failure_table(tags, ["bm25", "hybrid", "vector"])


@query(
    "eval_untagged",
    f"""{_EVAL} SELECT question_id, config FROM scores WHERE labelled AND (recall_10 < 1 OR reciprocal_rank < 0.5) AND NOT (question_id % 3 = 0) AND NOT (question_id % 3 = 1 AND config = 'bm25')""",
)
def eval_untagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third question has a tag for all configs, the ones after them one for a single config."""
    s = _scores(spark, sf_dir)
    ids = s.select("question_id").distinct()
    tags = ids.where("question_id % 3 = 0").withColumn("config", F.lit("all")).unionByName(ids.where("question_id % 3 = 1").withColumn("config", F.lit("bm25")))
    return ev.untagged(s, tags)


@query(
    "eval_agreement",
    f"""{_EVAL}, g AS (SELECT t.config, t.question_id, t.position, t.row_id, max(c.grade) AS grade FROM top t LEFT JOIN cov c USING (question_id, config, position) GROUP BY ALL),
    p AS (SELECT a.grade AS a, b.grade AS b FROM g a JOIN g b ON a.question_id = b.question_id AND a.row_id = b.row_id AND a.config = 'bm25' AND b.config = 'cross_encoder' WHERE a.grade IS NOT NULL AND b.grade IS NOT NULL),
    r AS (SELECT a, b FROM p), n AS (SELECT count(*) AS n, count(*) FILTER (a = b) / count(*) AS po FROM r), e AS (SELECT sum(l.c * m.c) AS lr FROM (SELECT a AS g, count(*) AS c FROM r GROUP BY a) l JOIN (SELECT b AS g, count(*) AS c FROM r GROUP BY b) m USING (g))
    SELECT n, round(po, 6) AS percent_agreement, round(CASE WHEN lr / (n * n) = 1 THEN 1 ELSE (po - lr / (n * n)) / (1 - lr / (n * n)) END, 6) AS kappa FROM n, e""",
)
def eval_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades that the same rows have in two lists."""
    g = ev.graded_hits(_hits(spark, sf_dir), _spans(spark, sf_dir))
    pair = g.where("config = 'bm25'").select("question_id", "row_id", F.col("grade").alias("a")).join(g.where("config = 'cross_encoder'").select("question_id", "row_id", F.col("grade").alias("b")), ["question_id", "row_id"])
    return ev.agreement(pair, "a", "b").select("n", F.round("percent_agreement", 6).alias("percent_agreement"), F.round("kappa", 6).alias("kappa"))


@query(
    "judgment_agreement",
    """WITH g AS (SELECT ticker, fiscal_year, grade FROM judgments JOIN manifest USING (row_id)), r AS (SELECT CAST(fiscal_year % 3 AS INTEGER) AS a, grade AS b FROM g WHERE fiscal_year IS NOT NULL AND grade IS NOT NULL),
    n AS (SELECT count(*) AS n, count(*) FILTER (a = b) / count(*) AS po FROM r), e AS (SELECT sum(l.c * m.c) AS lr FROM (SELECT a AS g, count(*) AS c FROM r GROUP BY a) l JOIN (SELECT b AS g, count(*) AS c FROM r GROUP BY b) m USING (g))
    SELECT n, round(po, 6) AS percent_agreement, round((po - lr / (n * n)) / (1 - lr / (n * n)), 6) AS kappa FROM n, e""",
)
def judgment_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades against a label that has nothing to do with them: a kappa near 0."""
    rows = table(spark, sf_dir, "judgments").join(table(spark, sf_dir, "manifest").select("row_id", "fiscal_year"), "row_id").withColumn("a", (F.col("fiscal_year") % 3).cast("int"))
    return ev.agreement(rows, "a", "grade").select("n", F.round("percent_agreement", 6).alias("percent_agreement"), F.round("kappa", 6).alias("kappa"))


_NOW = "SELECT accession, text_sha256 AS now_sha, max(char_end) OVER (PARTITION BY accession) AS extent FROM manifest QUALIFY row_number() OVER (PARTITION BY accession ORDER BY char_start DESC, chunk_id DESC, row_id DESC) = 1"


@query(
    "drift_check",
    f"""{_EVAL}, now AS ({_NOW}), d AS (SELECT question_id, span_id, CASE WHEN extent IS NULL THEN 'missing' WHEN CASE WHEN span_id % 5 = 0 THEN 'x' ELSE text_sha256 END <> now_sha THEN 'changed' WHEN span_end + span_id % 2 * 100000000 > extent THEN 'past end' END AS problem
      FROM (SELECT * REPLACE (CASE WHEN span_id % 7 = 0 THEN 'gone' ELSE accession END AS accession) FROM spans) LEFT JOIN now USING (accession))
    SELECT question_id, span_id, problem FROM d WHERE problem IS NOT NULL""",
)
def drift_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of which some were made not to fit any more."""
    spans = _spans(spark, sf_dir).withColumn("accession", F.when(F.col("span_id") % 7 == 0, "gone").otherwise(F.col("accession")))
    spans = spans.withColumn("filing_sha256", F.when(F.col("span_id") % 5 == 0, "x").otherwise(F.col("text_sha256"))).drop("text_sha256").withColumn("span_end", F.col("span_end") + F.col("span_id") % 2 * 100000000)
    return ev.drift(spans, table(spark, sf_dir, "manifest")).select("question_id", "span_id", "problem")


_SCOPED = """WITH sc AS (SELECT question_id, list_sort(list(DISTINCT m.ticker)) AS tickers FROM judgments j JOIN manifest m USING (row_id) WHERE j.grade >= 1 GROUP BY question_id),
h AS (SELECT question_id, retriever AS config, row_id, ticker, max(score) AS score FROM hits WHERE score IS NOT NULL AND NOT isnan(score) AND retriever <> 'l2_distance' GROUP BY ALL),
t AS (SELECT h.*, len(tickers) AS n, list_position(tickers, h.ticker) AS place, row_number() OVER (PARTITION BY h.question_id, config, CASE WHEN len(tickers) > 1 THEN h.ticker END ORDER BY score DESC, row_id) AS turn FROM h JOIN sc USING (question_id) WHERE list_contains(tickers, h.ticker)),
p AS (SELECT *, row_number() OVER (PARTITION BY question_id, config ORDER BY turn, place) AS position FROM t WHERE turn <= ceil(10 / n))"""


@query("eval_scoped", f"{_SCOPED} SELECT question_id, config, row_id, position FROM p WHERE position <= 10")
def eval_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each retriever within the scope of its question: the companies of which passages were judged relevant."""
    hits = table(spark, sf_dir, "hits").where("score IS NOT NULL AND NOT isnan(score) AND retriever <> 'l2_distance'")
    scored = hits.groupBy("question_id", F.col("retriever").alias("config"), "row_id", "ticker").agg(F.max("score").alias("score"), F.first("fiscal_year").alias("fiscal_year"), F.first("items").alias("items"))
    tickers = table(spark, sf_dir, "manifest").select("row_id", "ticker")
    judged = table(spark, sf_dir, "judgments").where("grade >= 1").join(tickers, "row_id").groupBy("question_id").agg(F.array_sort(F.collect_set("ticker")).alias("tickers"))
    scopes = judged.withColumn("fiscal_years", F.expr("cast(array() as array<int>)")).withColumn("items", F.lit(None).cast("array<string>"))
    return ev.scoped_hits(scored, scopes).select("question_id", "config", "row_id", F.col("position").cast("bigint").alias("position"))


@query("eval_grid", "SELECT DISTINCT q.question_id, c.config FROM hits q, (VALUES ('bm25'), ('hybrid'), ('vector')) AS c(config)")
def eval_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.grid(table(spark, sf_dir, "hits").select("question_id").distinct(), ["bm25", "hybrid", "vector"])
