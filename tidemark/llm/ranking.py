"""Problem 4: one ranking from several differently scaled scores, by robust rank aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.plans.registry import Registry, table
from tidemark.session import checkpointed

query = Registry()

#: Lists with more distinct scores than this are numbered in parts of about as many.
PART = 100_000


def _longer(df: DataFrame, by: Sequence[str], part: int) -> bool:
    """Whether any list has more than ``part`` rows."""
    return not df.groupBy(*by).agg(F.count(F.lit(1)).alias("__m")).where(F.col("__m") > part).isEmpty()


def positions(df: DataFrame, by: Sequence[str], order: str, part: int = PART) -> DataFrame:
    """``df`` with ``before``: how many rows of the same ``by`` have a smaller ``order``, and ``ties``: how many the same (itself too).

    ``df`` should be cheap to read again. Lists of up to ``part`` rows are numbered as they are. Otherwise equal values are counted on the
    map side, the counts are put in order over as many tasks as they need, numbered in each and moved up by what a list has in the tasks
    before. So no task sorts a whole long list, however long it is, and the numbers are the same either way.
    """
    if not _longer(df, by, part):
        return df.withColumn("before", F.rank().over(Window.partitionBy(*by).orderBy(order)) - 1).withColumn("ties", F.count(F.lit(1)).over(Window.partitionBy(*by, order)))
    counts = checkpointed(df.groupBy(*by, order).agg(F.count(F.lit(1)).alias("ties")))
    parts = -(-counts.count() // part)
    parted = checkpointed(counts.repartitionByRange(max(1, parts), *by, order).withColumn("__part", F.spark_partition_id()))
    upto = Window.unboundedPreceding, -1
    w = Window.partitionBy(*by).orderBy("__part").rowsBetween(*upto)
    sums = parted.groupBy(*by, "__part").agg(F.sum("ties").alias("__s")).select(*by, "__part", F.coalesce(F.sum("__s").over(w), F.lit(0)).alias("__base"))
    w = Window.partitionBy(*by, "__part").orderBy(order).rowsBetween(*upto)
    placed = parted.withColumn("__in", F.coalesce(F.sum("ties").over(w), F.lit(0))).join(sums, [*by, "__part"]).withColumn("before", F.col("__base") + F.col("__in"))
    return df.join(placed.select(*by, order, "before", "ties"), [*by, order])


def _log_factorials(n: Column) -> Column:
    """The logarithms of 0! to n!."""
    start = F.array(F.lit(0.0))
    return F.aggregate(F.sequence(F.lit(1).cast("bigint"), n), start, lambda s, k: F.concat(s, F.array(F.element_at(s, -1) + F.log(k.cast("double")))))


def _tails(norm: str, n: Column, logs: str) -> Column:
    """For the k-th of n sorted values the probability that the k-th smallest of n uniform values is at most it:
    the distribution function of the beta distribution of k and n - k + 1, which is a binomial sum. ``logs`` are those of 0! to n!."""
    log = F.col(logs)

    def tail(r: Column, i: Column) -> Column:
        ways = lambda j: log[n] - log[j] - log[n - j]
        term = lambda j: F.exp(ways(j) + j * F.log(r) + F.when(j == n, 0.0).otherwise((n - j) * F.log1p(-r)))
        return F.when(r >= 1, 1.0).otherwise(F.aggregate(F.sequence(i + 1, n), F.lit(0.0), lambda s, j: s + term(j)))

    return F.transform(norm, tail)


def robust_rank_aggregation(
    hits: DataFrame,
    *,
    question: str = "question_id",
    retriever: str = "retriever",
    item: str = "row_id",
    score: str = "score",
    rank: str = "hit_rank",
    smaller_is_better: Sequence[str] = ("l2_distance",),
    part: int = PART,
) -> DataFrame:
    """``question``, ``item``, ``fused_rank``, ``rho``, ``n_lists``, ``n_found`` and ``sources`` (retriever and its position, sorted).

    In each list (question and retriever) items are placed by score, the best first, equal ones in the middle of their
    places; an item hit repeatedly keeps its best score. Items whose scores are all null or NaN follow behind the scored
    ones, by ``hit_rank``, those without a rank last. A position divided by the number of the question's different items is
    the normalised rank; an item that a list lacks has 1 there. The sorted normalised ranks of an item are compared with
    the order statistics of uniform values; ``rho`` is the least of these probabilities times the number of lists, at
    most 1. Items are ranked by ``rho``, then mean normalised rank, then ``item``; all differ. A question may have any number
    of lists. As only places within lists matter, no list's range can dominate, and an infinite score is just the best or the worst.

    Rows with a null question, retriever or item are left out. Empty tables give an empty result.

    Scale: repeated hits are combined on the map side; places of long lists are found in parts (see ``positions``), for the
    final ranking too. The narrow tables in between are written to the checkpoint folder. What is gathered for an item is bounded by the number of lists.
    """
    valid = F.col(score).isNotNull() & ~F.isnan(score)
    better = F.when(F.col(retriever).isin(*smaller_is_better), -F.col(score)).otherwise(F.col(score))
    best = hits.where(F.col(question).isNotNull() & F.col(retriever).isNotNull() & F.col(item).isNotNull()).groupBy(question, retriever, item).agg(
        F.max(F.when(valid, better)).alias("__s"), F.min(F.when(F.col(rank) > 0, F.col(rank))).alias("__r")
    )
    # One ascending number for both orders: scores by their sign and size, then ranks, then nothing.
    scored = F.struct(F.lit(0).alias("kind"), (-F.col("__s")).cast("double").alias("v"))
    ranked = F.struct(F.lit(1).alias("kind"), F.coalesce(F.col("__r").cast("double"), F.lit(float("inf"))).alias("v"))
    best = checkpointed(best.withColumn("__o", F.when(F.col("__s").isNotNull(), scored).otherwise(ranked)).select(question, retriever, item, F.col("__o.kind").alias("__kind"), (F.col("__o.v") + 0.0).alias("__v")))
    by_value = positions(best, [question, retriever, "__kind"], "__v", part)
    scored_n = best.where("__kind = 0").groupBy(question, retriever).agg(F.count(F.lit(1)).alias("__n0"))
    placed = by_value.join(scored_n, [question, retriever], "left").withColumn(
        "place", F.col("before") + (F.col("ties") + 1) / 2 + F.when(F.col("__kind") == 1, F.coalesce("__n0", F.lit(0))).otherwise(0)
    )
    items = placed.groupBy(question, item).agg(F.sort_array(F.collect_list(F.struct(F.col("place"), F.col(retriever).alias("retriever")))).alias("__l"))
    pairs = best.select(question, retriever).distinct().groupBy(question).agg(F.count(F.lit(1)).alias("n_lists"))
    many = best.select(question, item).distinct().groupBy(question).agg(F.count(F.lit(1)).alias("__n"))
    pairs = pairs.join(many, question).withColumn("__logs", _log_factorials(F.col("n_lists"))).withColumn("n_lists", F.col("n_lists").cast("int"))
    items = items.join(pairs, question)
    # An item that a list lacks has 1 there, whose probability is 1: such places need not be looked at.
    items = items.withColumn("__norm", F.transform("__l", lambda x: x["place"] / F.col("__n")))
    rho = F.least(F.lit(1.0), F.col("n_lists") * F.array_min(_tails("__norm", F.col("n_lists"), "__logs")))
    # In halves of places, which are exact: the mean of the normalised ranks in other units.
    mean = F.aggregate("__l", (F.col("n_lists") - F.size("__l")) * F.col("__n").cast("double"), lambda s, x: s + x["place"])
    items = items.withColumn("rho", rho).withColumn("__mean", mean)
    sources = F.array_sort(F.transform("__l", lambda x: F.struct(x["retriever"].alias("retriever"), x["place"].alias("place"))))
    items = checkpointed(items.select(question, item, "rho", "n_lists", F.size("__l").alias("n_found"), sources.alias("sources"), "__mean"))
    # In long lists ties in rho may be many, ties in both hardly: long ones are placed by mean rank in parts, others in one window.
    columns = [question, item, "fused_rank", "rho", "n_lists", "n_found", "sources"]
    if not _longer(items, [question], part):
        return items.withColumn("fused_rank", F.row_number().over(Window.partitionBy(question).orderBy("rho", "__mean", item)).cast("bigint")).select(*columns)
    if items.groupBy(question, "rho").agg(F.count(F.lit(1)).alias("__m")).where(F.col("__m") > part).isEmpty():
        w = Window.partitionBy(question, "rho").orderBy("__mean", item)
        return positions(items, [question], "rho", part).withColumn("fused_rank", F.col("before") + F.row_number().over(w)).select(*columns)
    placed = positions(items, [question, "rho"], "__mean", part).withColumnRenamed("before", "__mean_before").drop("ties")
    w = Window.partitionBy(question, "rho", "__mean").orderBy(item)
    fused = F.col("before") + F.col("__mean_before") + F.row_number().over(w)
    return positions(placed, [question], "rho", part).withColumn("fused_rank", fused).select(*columns)


_RANKING = """
WITH h AS (SELECT question_id AS q, retriever AS t, row_id AS i,
        max(CASE WHEN NOT isnan(score) THEN CASE WHEN retriever = 'l2_distance' THEN -score ELSE score END END) AS s, min(hit_rank) FILTER (hit_rank > 0) AS r
      FROM hits WHERE question_id IS NOT NULL AND retriever IS NOT NULL AND row_id IS NOT NULL GROUP BY ALL),
v AS (SELECT *, s IS NULL AS none, coalesce(-s, r, 'infinity'::DOUBLE) AS v FROM h),
p AS (SELECT *, rank() OVER (PARTITION BY q, t ORDER BY none, v) + (count(*) OVER (PARTITION BY q, t, none, v) - 1) / 2 AS place FROM v),
n AS (SELECT q, count(DISTINCT t) AS lists, count(DISTINCT i) AS items FROM h GROUP BY q),
o AS (SELECT p.*, lists, items, place / items AS x, row_number() OVER (PARTITION BY q, i ORDER BY place, t) AS k FROM p JOIN n USING (q)),
b AS (SELECT *, CASE WHEN x >= 1 THEN 1.0 ELSE list_sum(list_transform(range(k, lists + 1),
        lambda j: factorial(lists::INT) / (factorial(j::INT) * factorial((lists - j)::INT)) * pow(x, j) * pow(1 - x, lists - j))) END AS tail FROM o),
f AS (SELECT q, i, least(1, any_value(lists) * min(tail)) AS rho, any_value(lists) AS lists, count(*) AS found,
        (any_value(lists) - count(*)) * any_value(items) + sum(place) AS mean, string_agg(t || '#' || CAST(place AS DOUBLE), ' ' ORDER BY t) AS sources FROM b GROUP BY q, i)
SELECT q AS question_id, i AS row_id, row_number() OVER (PARTITION BY q ORDER BY rho, mean, i) AS fused_rank, round(rho, 9) AS rho, CAST(lists AS INTEGER) AS n_lists,
  CAST(found AS INTEGER) AS n_found, sources FROM f
"""


@query("p4_ranking", _RANKING)
def p4_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = F.array_join(F.transform("sources", lambda s: F.concat_ws("#", s["retriever"], s["place"].cast("string"))), " ")
    return robust_rank_aggregation(table(spark, sf_dir, "hits")).withColumns({"rho": F.round("rho", 9), "sources": sources})
