"""Evaluation of ranked lists against graded passages, and agreement between graders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Characters by which a hit must overlap a passage, depths, and the parts of the questions.
MIN_OVERLAP = 200
DEPTH = 10
SPLITS = ("dev", "blind")


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Length that two half-open ranges share."""
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


def covers(hit_start: Column, hit_end: Column, start: Column, end: Column) -> Column:
    """Whether a hit covers a passage: by 200 characters, or wholly if it is shorter."""
    return overlap(hit_start, hit_end, start, end) >= F.least(F.lit(MIN_OVERLAP), end - start)


def grid(questions: DataFrame, configs: Sequence[str]) -> DataFrame:
    """Each question with each config."""
    return questions.withColumn("config", F.explode(F.array(*[F.lit(c) for c in configs])))


def of_split(questions: DataFrame, which: str, *, id_col: str = "question_id") -> DataFrame:
    """The questions of a split, of all splits, or the one question with that id."""
    if which == "all":
        return questions
    return questions.where(F.col("split") == which) if which in SPLITS else questions.where(F.col(id_col).cast("string") == which)


def scoped_hits(scored: DataFrame, scopes: DataFrame, k: int = DEPTH, *, tie: str = "row_id") -> DataFrame:
    """The ``k`` best of each question and config within the question's scope, with their ``position``.

    Scopes: ``question_id`` and arrays ``tickers``, ``fiscal_years``, ``items`` of which an empty or null one asks for
    nothing. The scope is applied before the best are taken. A question about several companies takes the same number
    of each, rounded up, dealt in turns in the order of the scope, and of these the first ``k``.
    """
    joined = scored.join(scopes.select("question_id", "tickers", "fiscal_years", F.col("items").alias("wanted")), "question_id")
    free = lambda c: F.coalesce(F.size(c) <= 0, F.lit(True))
    joined = joined.where(
        (free("tickers") | F.array_contains("tickers", F.col("ticker")))
        & (free("fiscal_years") | F.array_contains("fiscal_years", F.col("fiscal_year")))
        & (free("wanted") | F.arrays_overlap("items", "wanted"))
    )
    peers = F.greatest(F.size("tickers"), F.lit(1))
    company = F.when(peers > 1, F.col("ticker"))
    w = Window.partitionBy("question_id", "config", company).orderBy(F.desc("score"), tie)
    rows = joined.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= F.ceil(F.lit(k) / peers))
    place = F.when(peers > 1, F.array_position("tickers", F.col("ticker"))).otherwise(0)
    dealt = rows.withColumn("__place", place).withColumn("position", F.row_number().over(Window.partitionBy("question_id", "config").orderBy("turn", "__place")))
    return dealt.where(F.col("position") <= k).drop("tickers", "fiscal_years", "wanted", "turn", "__place")


def covered_spans(hits: DataFrame, spans: DataFrame) -> DataFrame:
    """Each hit with the passages of its question that it covers. Equi-join on question and filing, ranges as a condition.

    Hits: ``question_id``, ``config``, ``position``, ``accession``, ``char_start``, ``char_end``. Spans: ``question_id``,
    ``span_id``, ``accession``, ``span_start``, ``span_end``, ``grade``.
    """
    joined = hits.join(spans, ["question_id", "accession"])
    return joined.where(covers(F.col("char_start"), F.col("char_end"), F.col("span_start"), F.col("span_end")))


def graded_hits(hits: DataFrame, spans: DataFrame) -> DataFrame:
    """Hits with the best grade of what they cover; null, which is not 0, where nothing judged is covered."""
    best = covered_spans(hits, spans).groupBy("question_id", "config", "position").agg(F.max("grade").alias("grade"))
    return hits.join(best, ["question_id", "config", "position"], "left")


def question_scores(hits: DataFrame, spans: DataFrame, *, k: int = DEPTH, expected: DataFrame | None = None) -> DataFrame:
    """For each question and config of ``hits``: recall at 5 and ``k``, reciprocal rank, nDCG, unjudged hits and companies.

    Recall, reciprocal rank and nDCG are null for a question without a relevant passage (grade 1 or more). A passage is
    credited once, to the first hit that covers it; what a hit gains is the best grade among those it is the first for.
    """
    key = ["question_id", "config"]
    top = hits.where(F.col("position") <= k)
    covered = covered_spans(top, spans).select(*key, "position", "span_id", "grade")
    relevant = spans.where("grade >= 1")
    wanted = relevant.groupBy("question_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    ideal = spans.where("grade > 0").withColumn("r", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("grade"), "span_id"))).where(F.col("r") <= k)
    ideal = ideal.groupBy("question_id").agg(F.sum(F.col("grade") / F.log2(F.col("r") + 1)).alias("ideal"))
    # One pass over what is covered: a passage counts for the first hit that covers it, a hit as judged if it covers any.
    is_first = F.col("position") == F.min("position").over(Window.partitionBy(*key, "span_id"))
    own = F.when(is_first, F.col("grade"))
    places = covered.withColumn("own", own).groupBy(*key, "position").agg(F.max("own").alias("g"), F.count(F.when(F.col("own") >= 1, 1)).alias("n"))
    found = places.groupBy(*key).agg(
        F.sum(F.when(F.col("position") <= 5, F.col("n"))).alias("found_5"), F.sum("n").alias("found_k"), F.min(F.when(F.col("n") > 0, F.col("position"))).alias("first_position"),
        F.sum(F.col("g") / F.log2(F.col("position") + 1)).alias("dcg"), F.count(F.lit(1)).alias("judged"),
    )
    base = top.groupBy(*key).agg(F.count(F.lit(1)).alias("n_hits"), F.countDistinct("ticker").alias("issuers"), F.collect_set("ticker").alias("__tickers"))
    rows = base.join(found, key, "left").join(wanted, "question_id", "left").join(ideal, "question_id", "left")
    has = F.col("n_relevant").isNotNull()
    rows = (
        rows.withColumn("recall_5", F.when(has, F.coalesce("found_5", F.lit(0)) / F.col("n_relevant")))
        .withColumn("recall_10", F.when(has, F.coalesce("found_k", F.lit(0)) / F.col("n_relevant")))
        .withColumn("reciprocal_rank", F.when(has, F.coalesce(1 / F.col("first_position"), F.lit(0.0))))
        .withColumn("ndcg_10", F.when(has, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")))
        .withColumn("unjudged_10", F.col("n_hits") - F.coalesce("judged", F.lit(0)))
        .withColumn("labelled", has)
    )
    if expected is not None:
        rows = rows.join(expected.select("question_id", F.col("tickers").alias("__expected")), "question_id", "left")
        share = F.size(F.array_intersect("__tickers", "__expected")) / F.size("__expected")
        rows = rows.withColumn("coverage_10", F.when(F.col("__expected").isNull(), F.lit(None)).when(F.size("__expected") == 0, F.lit(1.0)).otherwise(share))
    names = [*key, "labelled", "recall_5", "recall_10", "reciprocal_rank", "ndcg_10", "unjudged_10", "issuers"]
    return rows.select(*names, *(["coverage_10"] if expected is not None else []))


def summarized(scores: DataFrame) -> DataFrame:
    """Means of each config over its labelled questions, nulls left out."""
    on = lambda c: F.avg(F.when(F.col("labelled"), F.col(c)))
    return scores.groupBy("config").agg(
        F.count(F.lit(1)).alias("n_questions"),
        F.count(F.when(F.col("labelled"), 1)).alias("n_labelled"),
        *[on(c).alias(c) for c in ("recall_5", "recall_10", "reciprocal_rank", "ndcg_10")],
        F.coalesce(on("unjudged_10"), F.lit(0.0)).alias("unjudged_10"),
    )


def _close(x: Column, y: Column) -> Column:
    return F.abs(x - y) <= F.greatest(1e-9 * F.greatest(F.abs(x), F.abs(y)), F.lit(1e-9))


def win_loss(scores: DataFrame, metric: str = "ndcg_10") -> DataFrame:
    """For each pair of configs how many questions the first wins, loses and ties; questions without the metric are left out."""
    rows = scores.where(F.col(metric).isNotNull()).select("question_id", "config", F.col(metric).alias("m"))
    both = rows.toDF("question_id", "config_a", "x").join(rows.toDF("question_id", "config_b", "y"), "question_id").where("config_a < config_b")
    tie = _close(F.col("x"), F.col("y"))
    count = lambda c: F.count(F.when(c, 1))
    return both.groupBy("config_a", "config_b").agg(count(~tie & (F.col("x") > F.col("y"))).alias("wins"), count(~tie & (F.col("x") < F.col("y"))).alias("losses"), count(tie).alias("ties"))


def needs_failure_tag(scores: DataFrame) -> DataFrame:
    """Labelled results that miss a relevant passage or find the first one late."""
    return scores.where("labelled AND (recall_10 < 1 OR reciprocal_rank < 0.5)").select("question_id", "config")


def untagged(scores: DataFrame, tags: DataFrame) -> DataFrame:
    """Results that need a failure tag and have none, for their config or for all."""
    both = tags.select("question_id", F.col("config").alias("__c")).withColumn("__c", F.col("__c"))
    return needs_failure_tag(scores).alias("n").join(both.alias("t"), (F.col("n.question_id") == F.col("t.question_id")) & F.col("__c").isin("all", F.col("n.config")), "left_anti")


def failure_table(tags: DataFrame, configs: Sequence[str]) -> DataFrame:
    """Causes by configs, counted."""
    return tags.groupBy("cause").pivot("config", list(configs)).agg(F.count(F.lit(1))).fillna(0)


def agreement(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``n``, ``percent_agreement``, ``kappa`` of two grades; rows without one of them are left out, and none at all is an error.

    Cohen's kappa is 1 where chance alone agrees wholly.
    """
    rows = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
    n = rows.agg(F.sum("c").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(0)).alias("same"))
    left, right = rows.groupBy(F.col("a").alias("g")).agg(F.sum("c").alias("l")), rows.groupBy(F.col("b").alias("g")).agg(F.sum("c").alias("r"))
    chance = left.join(right, "g").agg(F.coalesce(F.sum(F.col("l") * F.col("r")), F.lit(0)).alias("lr"))
    both = n.crossJoin(chance)  # one row each
    po, pe = F.col("same") / F.col("n"), F.col("lr") / (F.col("n") * F.col("n"))
    kappa = F.when(pe == 1, F.lit(1.0)).otherwise((po - pe) / (1 - pe))
    checked = F.when(F.col("n").isNull(), F.raise_error(F.lit("no pairs of grades")).cast("bigint")).otherwise(F.col("n"))
    return both.select(checked.alias("n"), po.alias("percent_agreement"), kappa.alias("kappa"))


def drift(spans: DataFrame, manifest: DataFrame) -> DataFrame:
    """Passages that no longer fit the manifest: filing missing, other text, or end past the filing's extent, in this order."""
    per = manifest.groupBy("accession").agg(F.max_by("text_sha256", F.struct("char_start", "chunk_id", "row_id")).alias("now_sha"), F.max("char_end").alias("extent"))
    rows = spans.join(per, "accession", "left")
    why = F.when(F.col("extent").isNull(), "missing").when(F.col("filing_sha256") != F.col("now_sha"), "changed").when(F.col("span_end") > F.col("extent"), "past end")
    return rows.withColumn("problem", why).where("problem IS NOT NULL")
