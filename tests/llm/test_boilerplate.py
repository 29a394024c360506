from __future__ import annotations

import datetime as dt

from tidemark.llm.boilerplate import repeated_lines, without_repeated_lines

SCHEMA = "row_id bigint, ticker string, period_end date, text string, n_rows string"


def rows():
    out = [(n, "A", dt.date(2020, 1, n), f"Content number {chr(96 + n)}\n  PAGE   {n} of\u00a0A \n\n", "q") for n in range(1, 7)]
    out += [(n, "B", dt.date(2020, 1, 1), "page 1 of a", "q") for n in (11, 12)]
    out += [(n, "C", dt.date(2020, 1, 1), "Republished article\nwith two lines", "q") for n in range(21, 28)]
    out += [(31, None, None, "page 1 of a", "q"), (32, "A", None, None, "q"), (33, "A", None, "", "q"), (34, "A", None, "Page 9 of A\nPage 8 of A\r", "q")]
    return out


def test_found(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    got = sorted((r["row_id"], r["line_no"]) for r in repeated_lines(df).collect())
    assert got == [*[(n, 2) for n in range(1, 7)], *[(n, k) for n in range(21, 28) for k in (1, 2)], (34, 1), (34, 2)]
    counts = {r["row_id"]: (r["n_rows"], r["n_clusters"], r["n_dates"]) for r in repeated_lines(df).collect()}
    assert counts[1] == (7, 7, 7) and counts[21] == (7, 1, 1)
    assert {r["row_id"] for r in repeated_lines(df, min_clusters=2).collect()} == {1, 2, 3, 4, 5, 6, 34}
    assert repeated_lines(df, min_dates=8).count() == 0
    assert repeated_lines(df.limit(0)).count() == 0


def test_clean(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    got = {r["row_id"]: (r["text"], r["n_removed"]) for r in without_repeated_lines(df, min_clusters=2).collect()}
    assert len(got) == len(rows())
    assert got[1] == ("Content number a\n\n", 1)
    assert got[34] == ("", 2)
    assert got[21] == ("Republished article\nwith two lines", 0)
    assert got[32] == (None, 0) and got[33] == ("", 0)


def test_republished_articles_keep_their_lines(spark):
    day = dt.date(2020, 5, 1)
    article = "An article that many took over\nwith its second line"
    out = [(n, "A", dt.date(2020, 1, n), article, "q") for n in range(1, 9)]  # the same text again and again
    out += [(10 + n, "B", day, f"{article}\nversion {chr(97 + n)}", "q") for n in range(8)]  # versions of one day
    out += [(20 + n, "C", dt.date(2020, 1, 1 + n), f"{article}\nbody {chr(97 + n)}", "q") for n in range(8)]  # a legal notice
    df = spark.createDataFrame(out, SCHEMA)
    removed = {r["row_id"]: r["n_removed"] for r in without_repeated_lines(df, min_clusters=2, min_dates=2).collect()}
    assert removed == {n: 2 if n >= 20 else 0 for n, *_ in out}
    without = {r["row_id"]: r["n_removed"] for r in without_repeated_lines(df).collect()}
    assert set(without.values()) == {2}
