from __future__ import annotations

import datetime as dt
import random

import pytest

from tidemark.llm import survivors as survivors_
from tidemark.llm.survivors import FIELDS, _facts_copies, survivors

D, T = dt.date, dt.datetime
SCHEMA = (
    "fact_id bigint, cik string, tag string, unit string, period_start date, period_end date, val double, fy int, fp string, form string, filed date, accn string, frame string, loaded_at timestamp, mask string, n string"
)


def fact(n, *, cik="0000000001", tag="Revenues", start=None, end=D(2024, 12, 31), val=100.0, fy=2024, fp="FY", form="10-K", filed=D(2025, 2, 1), accn="0000000001-25-000001", frame="CY", loaded=T(2025, 2, 2)):
    return (n, cik, tag, "USD", start, end, val, fy, fp, form, filed, accn, frame, loaded, "q", "q")


def found(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r["group_id"]: r for r in survivors(_facts_copies(df), FIELDS).collect()}


def test_spellings_and_near_values(spark):
    got = found(
        spark,
        [
            fact(1),
            fact(2, cik="CIK0000000001", accn=" 000000000125000001"),
            fact(3, cik="1", tag=" REVENUES ", accn=""),
            fact(4, val=100.5, end=D(2025, 1, 3), filed=D(2025, 2, 6)),
            fact(5, val=102.0),
            fact(6, end=D(2025, 1, 10)),
            fact(7, filed=D(2025, 3, 1)),
            fact(8, accn="0000000001-25-000002", filed=D(2025, 6, 1)),
            fact(9, start=D(2024, 1, 1)),
        ],
    )
    assert {k: r["n_rows"] for k, r in got.items()} == {1: 4}
    assert got[1]["best_id"] == 4  # complete and filed latest


def test_order_of_preference(spark):
    got = found(spark, [fact(1, fy=None), fact(2), fact(3, loaded=T(2025, 3, 1)), fact(4, loaded=T(2025, 3, 1)), fact(5, filed=D(2025, 2, 3), frame=None)])
    assert got[1]["best_id"] == 3


def test_layers_fill_fields(spark):
    got = found(spark, [fact(1, fy=None, fp=None, filed=D(2025, 2, 4)), fact(2, frame=" ", form=None, loaded=T(2025, 2, 9)), fact(3, fy=None, fp=None, form=None, frame=None, filed=D(2025, 1, 31), loaded=T(2025, 2, 1))])
    r = got[1]
    assert (r["best_id"], r["layers"]) == (1, 2)
    assert (r["fy_from"], r["fp_from"], r["form_from"], r["accn_from"], r["frame_from"]) == (2, 2, 1, 1, 1)


def test_two_filings_joined_only_by_an_empty_one(spark):
    a, b = "0000000001-25-000001", "0000000001-25-000002"
    assert set(found(spark, [fact(1, accn=a), fact(2, accn=b), fact(3, accn=a), fact(4, accn=b)])) == {1, 2}
    assert {k: r["n_rows"] for k, r in found(spark, [fact(1, accn=a), fact(2, accn=b), fact(3, accn="")]).items()} == {1: 3}


def test_only_links_join_a_group(spark):
    x, y = "0000000001-25-000001", "0000000001-25-000002"
    day = lambda n: D(2025, 2, 1) + dt.timedelta(n)
    got = found(spark, [fact(1, accn=x), fact(2, accn=y, filed=day(5)), fact(3, accn=y, filed=day(10)), fact(4, accn="", filed=day(14))])
    assert {k: r["n_rows"] for k, r in got.items()} == {2: 3}


def test_nulls_zero_negative_repeats_and_empty(spark):
    rows = [fact(1, val=None), fact(2, val=None), fact(3, val=0.0), fact(4, val=0.0), fact(5, val=-100.0, accn=None), fact(6, val=-100.9, accn=None), fact(7, end=None), fact(8, end=None)]
    got = found(spark, rows)
    assert {k: r["n_rows"] for k, r in got.items()} == {3: 2, 5: 2}
    assert found(spark, []) == {}
    many = [fact(n) for n in range(1, 300)]
    assert found(spark, many)[1]["n_rows"] == 299


def test_near_in_one_property_each_is_no_link(spark):
    end, filed = D(2024, 12, 31), D(2025, 2, 1)
    at = [(0, 0), (5, 10), (10, 20), (15, 5), (20, 15)]
    assert found(spark, [fact(n, end=end + dt.timedelta(e), filed=filed + dt.timedelta(f)) for n, (e, f) in enumerate(at, 1)]) == {}


def test_an_empty_filing_joins_only_what_is_near(spark):
    a, b, c = (f"0000000001-25-00000{k}" for k in (1, 2, 3))
    got = found(spark, [fact(1, accn=a), fact(2, accn=""), fact(3, accn=b, val=100.9), fact(4, accn=c, val=101.8)])
    assert {k: r["n_rows"] for k, r in got.items()} == {1: 3}


def test_a_null_load_is_the_least_trusted(spark):
    assert found(spark, [fact(1, loaded=None), fact(2)])[1]["best_id"] == 2
    r = found(spark, [fact(1, loaded=None, fy=None), fact(2, frame=None), fact(3, loaded=None, frame=None)])[1]
    assert (r["best_id"], r["n_rows"], r["layers"], r["frame_from"]) == (2, 3, 2, 1)


@pytest.mark.parametrize("hot", [survivors_.HOT, 100, 0])
def test_groups_are_components_of_links(spark, monkeypatch, hot):
    monkeypatch.setattr(survivors_, "HOT", hot)
    random.seed(5)
    accns = ["", None, "0000000001-25-000001", "000000000125000001", "0000000001-25-000002"]
    vals = [0.0, -0.0, 1e-320, 5e-324, 1e308, float("inf"), float("-inf"), *[100 * 1.004**k for k in range(12)], *[-100 * 1.007**k for k in range(4)]]
    rows = [
        fact(n, tag=random.choice("AAAAB"), end=D(2024, 12, 1) + dt.timedelta(random.randrange(0, 25, 2)), filed=D(2025, 2, 1) + dt.timedelta(random.randrange(0, 40, 3)), val=random.choice(vals), accn=random.choice(accns))
        for n in range(1, 500)
    ]

    def linked(x, y):
        v, w = x[6], y[6]
        a, b = ((z[11] or "").replace("-", "") for z in (x, y))
        close = v == w or abs(v - w) <= 0.01 * max(abs(v), abs(w)) < float("inf")
        return x[2] == y[2] and abs((x[5] - y[5]).days) < 7 and abs((x[10] - y[10]).days) < 7 and close and (a == b or not a or not b)

    part = {r[0]: r[0] for r in rows}
    for x in rows:
        for y in rows:
            if x[0] < y[0] and linked(x, y) and part[x[0]] != part[y[0]]:
                old, new = max(part[x[0]], part[y[0]]), min(part[x[0]], part[y[0]])
                part = {k: new if v == old else v for k, v in part.items()}
    sizes = {}
    for v in part.values():
        sizes[v] = sizes.get(v, 0) + 1
    want = {k: n for k, n in sizes.items() if n > 1}
    assert len(want) > 20 and max(want.values()) > 20
    assert {k: r["n_rows"] for k, r in found(spark, rows).items()} == want
