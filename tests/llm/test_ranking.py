from __future__ import annotations

import random
from math import comb

import pytest

from tidemark.llm.ranking import positions, robust_rank_aggregation

SCHEMA = "question_id bigint, retriever string, row_id bigint, score double, hit_rank int, rho string"
NAN = float("nan")


def by_hand(places, n_items, lists):
    r = sorted([p / n_items for p in places] + [1.0] * (lists - len(places)))
    tails = [sum(comb(lists, j) * x**j * (1 - x) ** (lists - j) for j in range(k, lists + 1)) for k, x in enumerate(r, 1)]
    return min(1.0, lists * min(tails))


def ranked(spark, rows):
    return {(r["question_id"], r["row_id"]): r for r in robust_rank_aggregation(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_rho_and_scales(spark):
    rows = []
    for i in range(1, 21):
        rows += [(1, "bm25", i, 100.0 - i, i, "q"), (1, "clicks", i, 1e9 / i, i, "q"), (1, "l2_distance", i, i / 1000, i, "q")]
    got = ranked(spark, rows)
    for i in range(1, 21):
        assert abs(got[1, i]["rho"] - by_hand([i, i, i], 20, 3)) < 1e-12
        assert got[1, i]["fused_rank"] == i


def test_any_number_of_lists(spark):
    r = random.Random(3)
    for lists in (1, 25, 300):
        rows = [(1, f"list{k}", i, r.random() + (i == 3), 1, "q") for k in range(lists) for i in range(1, 9) if i < 8 or k % 2]
        got = ranked(spark, rows)
        assert set(got) == {(1, i) for i in range(1, 9 if lists > 1 else 8)}
        for (_, _), x in got.items():
            assert x["n_lists"] == lists
            assert x["rho"] == pytest.approx(by_hand([s["place"] for s in x["sources"]], len(got), lists), rel=1e-9, abs=1e-300)


def test_no_range_dominates(spark):
    r = random.Random(4)
    rows = [(1, n, i, s(i), i, "q") for n, s in (("a", lambda i: -float(i)), ("b", lambda i: -i / 1e6), ("huge", lambda i: r.random() * 1e12)) for i in range(1, 51)]
    top = sorted((x["fused_rank"], k[1]) for k, x in ranked(spark, rows).items())[:3]
    assert {i for _, i in top} <= set(range(1, 8))


def test_ties_missing_nan_repeats_nulls(spark):
    rows = [
        (1, "a", 1, 5.0, 1, "q"), (1, "a", 2, 5.0, 2, "q"), (1, "a", 3, NAN, 2, "q"), (1, "a", 4, None, 1, "q"), (1, "a", 5, None, None, "q"),
        (1, "b", 1, 0.5, 9, "q"), (1, "b", 1, 0.9, None, "q"), (1, "b", 6, float("inf"), 1, "q"), (None, "b", 1, 1.0, 1, "q"), (1, None, 1, 1.0, 1, "q"), (1, "b", None, 1.0, 1, "q"),
        (2, "a", 7, None, None, "q"),
    ]
    got = ranked(spark, rows)
    place = {(k[1], s["retriever"]): s["place"] for k, x in got.items() for s in x["sources"]}
    assert place == {(1, "a"): 1.5, (2, "a"): 1.5, (4, "a"): 3.0, (3, "a"): 4.0, (5, "a"): 5.0, (6, "b"): 1.0, (1, "b"): 2.0, (7, "a"): 1.0}
    assert sorted(x["fused_rank"] for k, x in got.items() if k[0] == 1) == [1, 2, 3, 4, 5, 6]
    assert got[1, 2]["rho"] == pytest.approx(by_hand([1.5], 6, 2))
    assert ranked(spark, []) == {}


def test_parts_give_the_same_positions(spark):
    r = random.Random(7)
    rows = [(r.choice("aab"), float(r.randint(0, 300))) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, v double")
    whole, parted = (sorted(map(tuple, positions(df, ["k"], "v", part=p).select("k", "v", "before", "ties").collect())) for p in (10**6, 20))
    assert whole == parted
    assert all(b == sum(x == k and y < v for x, y in rows) for k, v, b, _ in whole[::97])


def test_long_lists_give_the_same_ranking(spark):
    r = random.Random(9)
    rows = [(q, n, i, float(r.randint(0, 9)), r.randint(1, 60), "q") for q in (1, 1, 2) for n in "abc" for i in range(1, 61) if r.random() < 0.7]
    df = spark.createDataFrame(rows, SCHEMA)
    short, long = (sorted((x["question_id"], x["fused_rank"], x["row_id"]) for x in robust_rank_aggregation(df, part=p).collect()) for p in (10**6, 2))
    assert short == long
