"""Problem 5: the best representative of each group of copies."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.ids import cik10
from tidemark.llm.components import components
from tidemark.plans.registry import Registry, table
from tidemark.session import checkpointed

query = Registry()

#: Figures with more rows than this in one spelling are not gone through in order, each in one task: all their kinds go to the grid.
HOT = 1_000_000
#: What a null trust counts as: earlier than any other.
_NEVER = "0001-01-01 00:00:00"


def _digest(columns: Sequence[Column]) -> Column:
    """64 bits of all columns, nulls told apart from any value."""
    return F.xxhash64(*[F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in columns])


def _split(df: DataFrame, by: list[str], value: str, apart: Callable[[Column, Column], Column]) -> tuple[DataFrame, list[str]]:
    """The parts of ``by`` parted further, by one more column, where two neighbours in the order of ``value`` are apart."""
    w = Window.partitionBy(*by).orderBy(value)
    df = df.withColumn("__new", F.coalesce(apart(F.lag(value).over(w), F.col(value)).cast("int"), F.lit(0)))
    return df.withColumn(f"s{len(by)}", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__new"), [*by, f"s{len(by)}"]


def _within(low: Column, high: Column, tolerance: float) -> Column:
    return (low == high) | (high - low <= tolerance * F.greatest(F.abs(low), F.abs(high)))


def _value_cell(val: Column, tolerance: float) -> Column:
    """A whole number that grows with ``val``: values of one cell are within the tolerance, those within it at most two cells apart."""
    # Cells are a hair narrower than the tolerance, so that rounding puts no two values into one that are not within it.
    width = -math.log1p(-tolerance) * (1 - 1e-9)
    size = F.floor(F.log(F.abs(val)) / width)
    # Offset by more than any double's logarithm needs, so that both signs keep their order and zero stands alone.
    reach = int(800 / width)
    ends = F.when(val == math.inf, 4 * reach).when(val == -math.inf, -4 * reach)
    return ends.when(val > 0, size + reach).when(val < 0, -(size + reach)).otherwise(F.lit(0)).cast("bigint")


def _linked_parts(nodes: DataFrame, seg: Sequence[str], days: Sequence[str], within_days: int, tolerance: float) -> DataFrame:
    """``node``, ``part`` (the smallest node that links lead to) of the nodes that have links.

    In: ``node``, ``seg``, ``days``, ``cell``, ``low``, ``high``, ``accn``. A node stands for values of one cell, days and filing, all of which are
    linked with each other; two nodes are linked if the two nearest of their values are.

    Candidates come from an equi-join on the cells of a grid (as many days wide as a link may bridge) and their neighbours, once on
    equal filings and once on an empty one with any. A cell has at most ``within_days`` squared nodes of one filing, so there are only so many
    candidates for each node, however many nodes a figure has.
    """
    grid = [F.floor(F.col(c) / within_days).cast("int") for c in days]
    here = nodes.select("node", *seg, *days, "low", "high", "accn", *[g.alias(f"g_{c}") for g, c in zip(grid, days, strict=True)], F.col("cell").alias("g_cell"))
    around = here
    for c in days:
        around = around.withColumn(f"g_{c}", F.explode(F.array(*[F.col(f"g_{c}") + k for k in (-1, 0, 1)])))
    # A link is found from its smaller value.
    around = around.withColumn("g_cell", F.explode(F.array(*[F.col("g_cell") + k for k in (0, 1, 2)])))
    keys = [*seg, *[f"g_{c}" for c in days], "g_cell"]
    names = {c: f"{c}_" for c in ("node", *days, "low", "high", "accn")}
    other = here.withColumnsRenamed(names)
    near = _within(F.col("high"), F.col("low_"), tolerance) | (F.col("low_") <= F.col("high"))
    for c in days:
        near &= F.abs(F.col(c) - F.col(f"{c}_")) < within_days
    same = around.where("accn IS NOT NULL").withColumn("k", F.col("accn")).join(other.where("accn_ IS NOT NULL").withColumn("k", F.col("accn_")), [*keys, "k"]).where(near)
    empty = around.where("accn IS NULL").join(other, keys).where(near)
    empty_ = around.where("accn IS NOT NULL").join(other.where("accn_ IS NULL"), keys).where(near)
    links = [x.select(F.col("node").alias("a"), F.col("node_").alias("b")) for x in (same, empty, empty_)]
    return components(links[0].unionByName(links[1]).unionByName(links[2])).toDF("node", "part")


def copies(
    facts: DataFrame,
    *,
    figure: Sequence[Column],
    spelled: Sequence[Column] | None = None,
    filing: Column,
    days: Sequence[str] = ("period_end", "filed"),
    within_days: int = 7,
    val: str = "val",
    tolerance: float = 0.01,
    filled: Sequence[str] = ("fy", "fp", "form", "accn", "frame"),
    id_col: str = "fact_id",
    trust: str = "loaded_at",
) -> DataFrame:
    """Kinds of rows that state one figure out of one filing, with the group they belong to; rows that are alone do not come out.

    One row for each group, day, value, filing and set of filled fields that occurs: ``group`` (a key within this
    result), the ``days``, ``val``, ``accn`` (normalised), ``mask`` (which of ``filled`` are), ``n`` rows, ``id`` the
    smallest id, and ``best``: greatest ``trust`` (a null one is less than any) and then smallest id.

    Two rows are linked if all of ``figure`` are equal (nulls too), each of ``days`` differs by less than
    ``within_days``, ``val`` by at most ``tolerance`` of the greater amount, and ``filing`` is equal or empty in one; a
    group is all that links lead to. ``spelled`` may name columns from which ``figure`` follows and which are cheaper to
    count by; it changes nothing of the result. Rows with a null or NaN value, a null day or a null id belong to no group and do not come out.

    Method: rows are combined into kinds on the map side, then sorted by one property after the other; a gap that no
    link can bridge parts them, which rules out links but states none. In most of the segments that are left any two kinds are
    linked, as their extremes show. In the others every link is found and checked (see ``_linked_parts``), and groups are the
    components of these links.

    Scale: an exact copy costs nothing after the map side, whatever share of all rows it is. All sorts share one partitioning by
    figure; a figure of more than ``HOT`` rows of one spelling is not sorted but goes to the grid, which spreads it by days and values. Segments that are not
    alone are written to the checkpoint folder. No segment is gathered; candidates of the unclear ones grow in proportion to their kinds.
    ``figure`` is hashed to 64 bits; as a link also needs near days and values, figures with one hash would still have to agree on these.
    """
    if not (0 < tolerance < 1 and within_days > 0):
        raise ValueError("0 < tolerance < 1 and within_days > 0 must hold")
    d = [F.datediff(F.col(c).cast("date"), F.lit("1970-01-01").cast("date")) for c in days]
    full = [F.when(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != ""), F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(filled)]
    mask = full[0]
    for f in full[1:]:
        mask = mask + f
    rows = facts.select(
        _digest(figure).alias("figure"),
        *[x.alias(f"d{k}") for k, x in enumerate(d)],
        (F.col(val).cast("double") + 0.0).alias("val"),
        F.when(filing == "", F.lit(None)).otherwise(F.xxhash64(filing)).alias("accn"),
        mask.alias("mask"),
        F.col(id_col).cast("bigint").alias("id"),
        F.coalesce(F.col(trust).cast("timestamp"), F.lit(_NEVER).cast("timestamp")).alias("trust"),
    ).where("val IS NOT NULL AND NOT isnan(val) AND id IS NOT NULL" + "".join(f" AND d{k} IS NOT NULL" for k in range(len(d))))
    own = [f"d{k}" for k in range(len(d))]
    kinds = rows.groupBy("figure", *own, "val", "accn", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("id"), F.max(F.struct("trust", (-F.col("id")).alias("i"))).alias("best")
    )
    written = facts.select(F.xxhash64(*(spelled or figure)).alias("w"), _digest(figure).alias("figure"))
    often = checkpointed(written.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("w"))
    any_hot = not often.isEmpty()
    hot = checkpointed(written.join(often, "w", "left_semi").select("figure").distinct()) if any_hot else None
    parted, seg = (kinds.join(hot, "figure", "left_anti") if any_hot else kinds).repartition("figure"), ["figure"]
    for c in reversed(own):
        parted, seg = _split(parted, seg, c, lambda low, high: high - low >= within_days)
    parted, seg = _split(parted, seg, "val", lambda low, high: ~_within(low, high, tolerance))
    # Rows that are alone go before anything else is shuffled.
    w = Window.partitionBy(*seg)
    near = _within(F.min("val").over(w), F.max("val").over(w), tolerance) & F.coalesce(F.min("accn").over(w) == F.max("accn").over(w), F.lit(True))
    for c in own:
        near &= F.max(c).over(w) - F.min(c).over(w) < within_days
    parted = checkpointed(parted.withColumn("__all", F.sum("n").over(w)).withColumn("__near", near).where("__all > 1").drop("__all"))

    out = [*own, "val", "accn", "mask", "n", "id", "best"]
    clear = parted.where("__near").select(F.struct(*seg, F.lit(None).cast("bigint").alias("part")).alias("group"), *out)
    unclear = parted.where("NOT __near").drop("__near")
    if any_hot:
        whole = kinds.join(hot, "figure", "left_semi")
        for c in seg[1:]:
            whole = whole.withColumn(c, F.lit(0))
        unclear = unclear.unionByName(whole)
    unclear = unclear.withColumn("cell", _value_cell(F.col("val"), tolerance))
    if unclear.isEmpty():
        return clear
    place = [*seg, *own, "cell"]
    nodes = checkpointed(unclear.groupBy(*place, "accn").agg(F.min("val").alias("low"), F.max("val").alias("high"), F.sum("n").alias("size"), F.min("id").alias("node")))
    parts = nodes.join(_linked_parts(nodes, seg, own, within_days, tolerance), "node", "left").withColumn("part", F.coalesce("part", "node"))
    # A node without links is a group only if it has copies itself.
    many = parts.groupBy("part").agg(F.sum("size").alias("size")).where("size > 1").select("part")
    parts = parts.join(many, "part", "left_semi").select(*[F.col(c).alias(f"{c}_") for c in (*place, "accn")], "part")
    same = F.lit(True)
    for c in (*place, "accn"):
        same &= F.col(c).eqNullSafe(F.col(f"{c}_"))
    return clear.unionByName(unclear.join(parts, same).select(F.struct(*seg, "part").alias("group"), *out))


def _facts_copies(facts: DataFrame) -> DataFrame:
    low = lambda c: F.lower(F.trim(c))
    return copies(
        facts,
        figure=[F.coalesce(cik10("cik"), low("cik")), low("tag"), low("unit"), F.col("period_start")],
        spelled=[F.col(c) for c in ("cik", "tag", "unit", "period_start")],
        filing=F.regexp_replace(F.coalesce(low("accn"), F.lit("")), "[^0-9a-z]", ""),
    )


def survivors(kinds: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``group_id``, ``n_rows``, ``best_id``, ``layers`` and for each of ``fields`` the id of the row that gives it, of each group.

    A row is a point of completeness (number of filled fields), recency (``d1``, the second day) and trust. The first
    layer are the points that no other dominates (as good in all three and better in one), the second those that then
    none dominates, and so on. The best row is of the first layer: the most complete, then the latest, then the most trusted,
    then the smallest id. A field that it lacks comes from the best row, in the same order, of the first layer that has it.

    Kinds differ in their filled fields and days, so what is gathered for a group is bounded by 2 ** fields x days;
    kinds that differ in value or filing only are combined first, as all but the most trusted of them are dominated.
    """
    points = kinds.groupBy("group", "mask", "d1").agg(F.sum("n").alias("n"), F.min("id").alias("id"), F.max("best").alias("best"))
    point = F.struct(F.bit_count("mask").alias("filled"), F.col("d1").alias("day"), F.col("best.trust").alias("trust"), F.col("best.i").alias("i"), "mask")
    groups = points.groupBy("group").agg(F.sum("n").alias("n_rows"), F.min("id").alias("group_id"), F.sort_array(F.collect_list(point), asc=False).alias("p"))
    # In this order a point comes after all that dominate it: its layer is one more than the last of these.
    beats = lambda q, p: (q["filled"] >= p["filled"]) & (q["day"] >= p["day"]) & (q["trust"] >= p["trust"]) & ((q["filled"] > p["filled"]) | (q["day"] > p["day"]) | (q["trust"] > p["trust"]))
    start = F.expr("cast(array() as array<struct<filled:int,day:int,trust:timestamp,i:bigint,mask:int,layer:int>>)")
    placed = F.aggregate(
        "p",
        start,
        lambda done, p: F.concat(
            done,
            F.array(
                F.struct(
                    p["filled"].cast("int").alias("filled"), p["day"].cast("int").alias("day"), p["trust"].alias("trust"), p["i"].alias("i"), p["mask"].cast("int").alias("mask"),
                    (F.coalesce(F.array_max(F.transform(F.filter(done, lambda q: beats(q, p)), lambda q: q["layer"])), F.lit(0)) + 1).alias("layer"),
                )
            ),
        ),
    )
    layered = groups.withColumn("p", placed)
    order = F.array_sort(F.transform("p", lambda x: F.struct(x["layer"].alias("layer"), (-x["filled"]).alias("f"), (-x["day"]).alias("d"), (-F.unix_micros(x["trust"])).alias("t"), (-x["i"]).alias("id"), x["mask"].alias("mask"))))
    layered = layered.withColumn("o", order)

    def giver(k: int) -> Column:
        return F.get(F.filter("o", lambda x: x["mask"].bitwiseAND(F.lit(1 << k)) != 0), F.lit(0))["id"]

    return layered.select("group_id", "n_rows", F.col("o")[0]["id"].alias("best_id"), F.array_max(F.transform("p", lambda x: x["layer"])).alias("layers"), *[giver(k).alias(f"{c}_from") for k, c in enumerate(fields)])


FIELDS = ("fy", "fp", "form", "accn", "frame")


_COPIES = r"""
WITH RECURSIVE f AS MATERIALIZED (
  SELECT fact_id, val, filed, period_end, period_start, loaded_at, lower(trim(tag)) AS t, lower(trim(unit)) AS u,
    coalesce(nullif(lpad(regexp_extract(upper(trim(cik)), '^(?:CIK[-_]?)?0*([0-9]{1,10})$', 1), 10, '0'), '0000000000'), lower(trim(cik))) AS c,
    regexp_replace(lower(trim(coalesce(accn, ''))), '[^0-9a-z]', '', 'g') AS a,
    CAST(fy IS NOT NULL AS INT) + CAST(coalesce(trim(fp), '') <> '' AS INT) + CAST(coalesce(trim(form), '') <> '' AS INT)
      + CAST(coalesce(trim(accn), '') <> '' AS INT) + CAST(coalesce(trim(frame), '') <> '' AS INT) AS filled
  FROM facts WHERE val IS NOT NULL AND filed IS NOT NULL AND period_end IS NOT NULL),
l AS MATERIALIZED (
  SELECT x.fact_id AS a, y.fact_id AS b FROM f x JOIN f y
    ON x.c IS NOT DISTINCT FROM y.c AND x.t IS NOT DISTINCT FROM y.t AND x.u IS NOT DISTINCT FROM y.u AND x.period_start IS NOT DISTINCT FROM y.period_start
   AND x.fact_id <> y.fact_id AND abs(date_diff('day', x.filed, y.filed)) < 7 AND abs(date_diff('day', x.period_end, y.period_end)) < 7
   AND abs(x.val - y.val) <= 0.01 * greatest(abs(x.val), abs(y.val)) AND (x.a = y.a OR x.a = '' OR y.a = '')),
r AS (SELECT a AS id, b AS met FROM l UNION SELECT r.id, l.b FROM r JOIN l ON r.met = l.a),
g AS (SELECT id, least(id, min(met)) AS group_id FROM r GROUP BY id),
b AS (SELECT group_id, fact_id, row_number() OVER (PARTITION BY group_id ORDER BY filled DESC, filed DESC, loaded_at DESC NULLS LAST, fact_id) AS k
      FROM g JOIN f ON g.id = f.fact_id)
"""


@query("p5_found", _COPIES + "SELECT group_id, fact_id AS best_id FROM b WHERE k = 1")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors(_facts_copies(table(spark, sf_dir, "facts")), ()).select("group_id", "best_id")


_LAYERS = (
    _COPIES
    + """,
m AS (SELECT group_id, facts.*, coalesce(loaded_at, TIMESTAMP '0001-01-01') AS trust, fy IS NOT NULL AS h1, coalesce(trim(fp), '') <> '' AS h2,
        coalesce(trim(form), '') <> '' AS h3, coalesce(trim(facts.accn), '') <> '' AS h4, coalesce(trim(frame), '') <> '' AS h5
      FROM g JOIN facts ON g.id = facts.fact_id),
p AS (SELECT DISTINCT ON (group_id, h1, h2, h3, h4, h5, filed) *, CAST(h1 AS INT) + CAST(h2 AS INT) + CAST(h3 AS INT) + CAST(h4 AS INT) + CAST(h5 AS INT) AS filled
      FROM m ORDER BY group_id, h1, h2, h3, h4, h5, filed, trust DESC, fact_id),
d AS MATERIALIZED (SELECT q.fact_id AS over, p.fact_id AS under FROM p q JOIN p ON q.group_id = p.group_id AND q.filled >= p.filled AND q.filed >= p.filed AND q.trust >= p.trust
      AND (q.filled > p.filled OR q.filed > p.filed OR q.trust > p.trust)),
c AS (SELECT fact_id, 1 AS layer FROM p UNION SELECT d.under, c.layer + 1 FROM c JOIN d ON c.fact_id = d.over),
y AS (SELECT fact_id, max(layer) AS layer FROM c GROUP BY fact_id),
o AS (SELECT p.*, layer, row_number() OVER (PARTITION BY group_id ORDER BY layer, filled DESC, filed DESC, trust DESC, fact_id) AS k FROM p JOIN y USING (fact_id)),
n AS (SELECT group_id, count(*) AS n_rows FROM m GROUP BY group_id),
s AS (SELECT group_id, arg_min(fact_id, k) AS best_id, max(layer) AS layers, arg_min(fy, k) FILTER (h1) AS fy, arg_min(fp, k) FILTER (h2) AS fp,
        arg_min(form, k) FILTER (h3) AS form, arg_min(accn, k) FILTER (h4) AS accn, arg_min(frame, k) FILTER (h5) AS frame FROM o GROUP BY group_id)
SELECT s.group_id, n_rows, best_id, layers, b.cik, b.tag, b.unit, b.val, b.filed, b.period_end, s.fy, s.fp, s.form, s.accn, s.frame
FROM s JOIN n USING (group_id) JOIN facts b ON b.fact_id = s.best_id
"""
)


@query("p5_survivors", _LAYERS)
def p5_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each group: the best row, its empty fields filled from the next layers."""
    facts = table(spark, sf_dir, "facts")
    chosen = survivors(_facts_copies(facts), FIELDS)
    given = chosen.select("group_id", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"{c}_from").alias("fact_id")) for c in FIELDS], F.struct(F.lit("best").alias("field"), F.col("best_id").alias("fact_id")))).alias("g"))
    given = given.where("g.fact_id IS NOT NULL").select("group_id", "g.*")
    values = facts.select("fact_id", "val", "filed", "accn", "period_end", "fy", "fp", "form", "frame", "cik", "tag", "unit")
    took = given.join(values, "fact_id").groupBy("group_id").agg(
        *[F.max(F.when(F.col("field") == "best", F.col(c))).alias(c) for c in ("cik", "tag", "unit", "val", "filed", "period_end")],
        *[F.max(F.when(F.col("field") == c, F.col(c))).alias(c) for c in FIELDS],
    )
    return chosen.select("group_id", "n_rows", "best_id", "layers").join(took, "group_id")
