from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators.asof import attributes_as_of

D = dt.date
EVENTS = "event bigint, k string, at timestamp, extra string"
FACTS = "id bigint, k string, known date, ord string, val double, extra string"


def run(spark, events, facts):
    e, f = spark.createDataFrame(events, EVENTS), spark.createDataFrame(facts, FACTS)
    out = attributes_as_of(
        e, f, event_keys=[F.col("k")], attribute_keys=[F.col("k")], event_id="event", event_time=F.col("at"), known_time=F.col("known"), order=F.col("ord"), attribute_id="id", carry=["val"]
    )
    return {r["event"]: (r["reported"]["id"], r["restated"]["id"], r["reported"]["val"], r["restated"]["val"]) for r in out.collect()}


def at(day):
    return dt.datetime(2024, 1, day, 12)


def test_never_later_and_ties(spark):
    facts = [
        (1, "a", D(2024, 1, 2), "x", 1.0, "q"),
        (2, "a", D(2024, 1, 5), "x", 2.0, "q"),
        (3, "a", D(2024, 1, 5), "y", 3.0, "q"),
        (4, "a", D(2024, 1, 5), "y", 4.0, "q"),
        (5, "a", D(2024, 1, 9), "x", 5.0, "q"),
        (6, "a", D(2024, 1, 2), "x", 1.0, "q"),
    ]
    events = [(n, "a", at(d), "z") for n, d in ((10, 1), (11, 2), (12, 4), (13, 5), (14, 8), (15, 9), (16, 20))]
    assert run(spark, events, facts) == {
        11: (1, 1, 1.0, 1.0),
        12: (1, 1, 1.0, 1.0),
        13: (1, 3, 1.0, 3.0),
        14: (1, 3, 1.0, 3.0),
        15: (1, 5, 1.0, 5.0),
        16: (1, 5, 1.0, 5.0),
    }


def test_nulls_repeats_and_unknown_keys(spark):
    facts = [(1, None, D(2024, 1, 1), None, 1.0, None), (2, "a", None, "x", 2.0, None), (3, "", D(2024, 1, 1), "x", None, None)]
    events = [(1, None, at(3), None), (1, None, at(3), None), (2, "a", at(3), None), (3, "b", at(3), None), (4, "", None, None), (5, "", at(3), None)]
    assert run(spark, events, facts) == {1: (1, 1, 1.0, 1.0), 5: (3, 3, None, None)}
    f = spark.createDataFrame(facts, FACTS)
    e = spark.createDataFrame(events, EVENTS)
    out = attributes_as_of(e, f, event_keys=[F.col("k")], attribute_keys=[F.col("k")], event_id="event", event_time=F.col("at"), known_time=F.col("known"), order=F.col("ord"), attribute_id="id")
    assert out.count() == 3  # the repeated event keeps both rows


def test_empty(spark):
    assert run(spark, [], [(1, "a", D(2024, 1, 1), "x", 1.0, None)]) == {}
    assert run(spark, [(1, "a", at(1), None)], []) == {}


def test_against_brute_force_with_a_hot_key(spark):
    import random

    r = random.Random(5)
    keys = ["hot"] * 4 + ["b", "c"]
    facts = [(i, r.choice(keys), D(2024, 1, r.randint(1, 28)), r.choice("xyz"), float(i), None) for i in range(400)]
    events = [(i, r.choice(keys), at(r.randint(1, 28)), None) for i in range(300)]
    want = {}
    for n, k, t, _ in events:
        known = [f for f in facts if f[1] == k and f[2] <= t.date()]
        if known:
            first = min(known, key=lambda f: (f[2], f[3], f[0]))
            last = min(known, key=lambda f: (-f[2].toordinal(), [-ord(c) for c in f[3]], f[0]))
            want[n] = (first[0], last[0], first[4], last[4])
    assert run(spark, events, facts) == want


def test_two_versions_on_one_day(spark):
    hour = lambda h: dt.datetime(2024, 1, 5, h)
    e = spark.createDataFrame([(1, "a", hour(8)), (2, "a", hour(9)), (3, "a", hour(12)), (4, "a", hour(16)), (5, "a", dt.datetime(2024, 1, 7))], "event bigint, k string, at timestamp")
    f = spark.createDataFrame([(1, "a", hour(9), 1.0), (2, "a", hour(15), 2.0), (3, "a", dt.datetime(2024, 1, 6), 3.0)], "id bigint, k string, known timestamp, val double")
    how = dict(event_keys=[F.col("k")], attribute_keys=[F.col("k")], event_id="event", order=F.lit(""), attribute_id="id")
    by_time = attributes_as_of(e, f, event_time=F.col("at"), known_time=F.col("known"), **how)
    assert {r["event"]: (r["reported"]["id"], r["restated"]["id"]) for r in by_time.collect()} == {2: (1, 1), 3: (1, 1), 4: (1, 2), 5: (1, 3)}
    by_day = attributes_as_of(e, f, event_time=F.to_date("at"), known_time=F.to_date("known"), **how)
    assert {r["event"]: (r["reported"]["id"], r["restated"]["id"]) for r in by_day.collect()} == {1: (1, 1), 2: (1, 1), 3: (1, 1), 4: (1, 1), 5: (1, 3)}
