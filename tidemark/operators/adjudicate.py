"""Judging: the pool of unjudged hits, repeated grades, samples to check again, and how well filings were parsed."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.evaluate import covered_spans
from tidemark.operators.text.locate import INCORPORATION, TARGETS
from tidemark.operators.text.passages import SPACE

# The share of the shorter one that two hits of one passage have in common, days for which a label is fresh.
SAME, FRESH_DAYS, SEED = 0.5, 3, 20260101
# The items that must be there, the least length of a real section, where a stub says so.
CORE, PLAUSIBLE, STUB_WINDOW = ("1A", "7", "9A"), 1_000, 400
# Fixed value: the line above and below a text on a judge's sheet.
RULE = "-" * 72


def unjudged(hits: DataFrame, spans: DataFrame) -> DataFrame:
    """Hits that cover no graded passage."""
    key = ["question_id", "config", "position"]
    return hits.join(covered_spans(hits, spans).select(*key).distinct(), key, "left_anti")


def pool(hits: DataFrame, spans: DataFrame, *, depth: int = 10, seed: int = SEED) -> DataFrame:
    """``question_id``, ``place``, ``row_id``, ``accession``, ``char_start``, ``char_end``: each unjudged passage once, shuffled.

    Configs are read in their order; a hit that shares half of the shorter one's length with one taken before is
    the same passage. That choice depends on the order, so a question is worked off in one group, which is bounded by
    configs x ``depth``. The shuffle has the question as its seed.
    """
    rows = unjudged(hits.where(F.col("position") <= depth), spans).select("question_id", "config", "position", "row_id", "accession", "char_start", "char_end")
    from tidemark.session import ship

    ship(hits.sparkSession)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: dict[str, list[tuple[int, int]]] = {}
        take = []
        for i, r in enumerate(pdf.sort_values(["config", "position"]).itertuples(index=False)):
            mine = kept.setdefault(r.accession, [])
            if all(min(e, r.char_end) - max(s, r.char_start) < SAME * min(e - s, r.char_end - r.char_start) for s, e in mine):
                mine.append((r.char_start, r.char_end))
                take.append(i)
        random.Random(f"{seed}:{pdf['question_id'].iloc[0]}").shuffle(take)
        out = pdf.sort_values(["config", "position"]).iloc[take].copy()
        out["place"] = range(1, len(out) + 1)
        return out[["question_id", "place", "row_id", "accession", "char_start", "char_end"]]

    kinds = dict(rows.dtypes)
    return rows.groupBy("question_id").applyInPandas(choose, f"question_id {kinds['question_id']}, place int, row_id {kinds['row_id']}, accession string, char_start bigint, char_end bigint")


def sheets(pooled: DataFrame, questions: DataFrame, manifest: DataFrame, *, key: str = "row_id") -> DataFrame:
    """``question_id``, ``key``, ``sheet``: what a judge sees of each passage of a pool, where it is from and its text, but nothing of its rank.

    ``questions``: ``question_id``, ``question``. What a row of the manifest lacks is a question mark.
    """
    rows = pooled.join(questions.select("question_id", "question"), "question_id").join(manifest.select(key, "ticker", "fiscal_year", "items", "document_name", "text"), key)
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
    items = F.when(F.size("items") > 0, F.array_join("items", ", ")).otherwise("unlabelled")
    text = F.regexp_replace(F.coalesce("text", F.lit("")), f"\\A[{SPACE}]+|[{SPACE}]+\\z", "")
    head = F.concat(F.col("question_id").cast("string"), F.lit(": "), F.col("question"), F.lit("\n"), known("ticker"), F.lit(" FY"), known("fiscal_year"), F.lit(" · items "), items, F.lit(" · "), known("document_name"))
    return rows.select("question_id", key, F.concat_ws("\n", head, F.lit(RULE), text, F.lit(RULE)).alias("sheet"))


def original_grades(entries: DataFrame, key: Sequence[str]) -> DataFrame:
    """One entry for each key: gold before judgments; of gold the last, of judgments the first. ``entry_no`` is their order."""
    gold = F.col("origin") == "gold"
    best = F.struct(gold.cast("int").alias("g"), F.when(gold, F.col("entry_no")).otherwise(-F.col("entry_no")).alias("n"))
    return entries.groupBy(*key).agg(F.max_by(F.struct("grade", "origin"), best).alias("e")).select(*key, "e.grade", "e.origin")


def rechecked(entries: DataFrame, rechecks: DataFrame, key: Sequence[str]) -> DataFrame:
    """Original and new grade of what was checked again."""
    return original_grades(entries, key).join(rechecks.select(*key, "regrade"), list(key))


def recheck_sample(labels: DataFrame, key: Sequence[str], fraction: float, seed: int, done: DataFrame | None = None) -> DataFrame:
    """A seeded sample of ``fraction`` (rounded up) of the labels that were not checked again yet.

    The keys with the smallest hash under the seed: which they are depends on nothing but key and seed, and they are
    found without bringing all keys to one place.
    """
    keys = labels.select(*key).distinct()
    if done is not None:
        keys = keys.join(done.select(*key), list(key), "left_anti")
    n = math.ceil(fraction * keys.count())
    return keys.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key])), *key).limit(n)


def recent(labels: DataFrame, today: str, days: int = FRESH_DAYS, on: str = "judged_on") -> DataFrame:
    return labels.where(F.datediff(F.lit(today).cast("date"), F.col(on)) < days)


def gold_entries(passages: DataFrame, filings: DataFrame, *, grade: int = 2, day: str, id_col: str = "accession") -> DataFrame:
    """Passages as they go into the file of questions: with the grade, the hash of the text they are from, the quote and the day."""
    hashes = filings.select(id_col, F.sha2(F.col("text"), 256).alias("filing_sha256"))
    rows = passages.join(hashes, id_col)
    return rows.select(id_col, "char_start", "char_end", F.lit(grade).alias("grade"), "filing_sha256", "quote", F.lit(day).cast("date").alias("labelled_on"))


def parser_states(filings: DataFrame, sections: DataFrame, *, id_col: str = "accession") -> DataFrame:
    """For each filing its ``state`` (located, partial, failed), ``strategy``, missing core items and why it falls short."""
    primary = sections.where("span_no = 0")
    lengths = primary.withColumn("n", F.col("span_end") - F.col("span_start")).join(filings.select(id_col, "text"), id_col)
    pattern = "(?i)" + INCORPORATION.pattern
    stub = F.substring(F.col("text"), F.col("span_start").cast("int") + 1, F.lit(STUB_WINDOW)).rlike(pattern)
    per = lengths.groupBy(id_col).agg(
        F.collect_set(F.when(F.col("item").isin(TARGETS) & (F.col("n") >= PLAUSIBLE), F.col("item"))).alias("found"),
        F.collect_set(F.when(F.col("item").isin(TARGETS) & (F.col("n") < PLAUSIBLE) & stub, F.col("item"))).alias("incorporated"),
        F.max(F.when(F.col("strategy") == "crossref_pages", 2).when(F.col("strategy") == "referral", 1).otherwise(0)).alias("s"),
    )
    core = F.array(*[F.lit(c) for c in CORE])
    rows = filings.select(id_col).join(per, id_col, "left").withColumn("missing_core", F.array_except(core, F.coalesce("found", F.expr("cast(array() as array<string>)"))))
    ok = F.size("missing_core") == 0
    state = F.when(F.col("s").isNull(), "failed").when(ok, "located").otherwise("partial")
    by_reference = F.size(F.array_except("missing_core", "incorporated")) == 0
    reason = F.when(F.col("s").isNull(), "no headings and no page table").when(ok, "").when(by_reference, "incorporated by reference").otherwise("sections too short")
    strategy = F.when(F.col("s").isNull(), "none").when(F.col("s") == 2, "crossref_pages").when(F.col("s") == 1, "referral").otherwise("item_heading")
    return rows.select(id_col, state.alias("state"), strategy.alias("strategy"), "missing_core", reason.alias("reason"))


def parser_report(states: DataFrame) -> DataFrame:
    return states.groupBy("strategy", "state", "reason").agg(F.count(F.lit(1)).alias("n"))


def bad_offsets(filings: DataFrame, sections: DataFrame, *, id_col: str = "accession") -> DataFrame:
    """Spans that do not lie within their text."""
    rows = sections.join(filings.select(id_col, F.length("text").alias("n")), id_col)
    return rows.where(~((F.col("span_start") >= 0) & (F.col("span_start") < F.col("span_end")) & (F.col("span_end") <= F.col("n"))))
