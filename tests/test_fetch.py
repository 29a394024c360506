from __future__ import annotations

import pytest

from tidemark.sources import fetch as fe


class Clock:
    def __init__(self):
        self.now, self.slept = 0.0, []

    def __call__(self):
        return self.now

    def sleep(self, s):
        self.slept.append(s)
        self.now += s


def landing(tmp_path, answers, clock):
    asked = []

    def transport(url):
        asked.append(url)
        return answers.pop(0)

    return fe.Landing(tmp_path, transport, fe.Pace(5, clock, clock.sleep), clock.sleep), asked


def test_pace():
    c = Clock()
    p = fe.Pace(4, c, c.sleep)
    for _ in range(3):
        p.wait()
    assert c.slept == [0.25, 0.25]
    with pytest.raises(ValueError):
        fe.Pace(0)


def test_waits():
    assert fe.wait_before(0, chance=lambda: 1.0) == 1.0 and fe.wait_before(9) == 30.0
    assert fe.wait_before(0, "7") == 7.0 and fe.wait_before(0, "900") == 30.0


def test_kept_and_repeated(tmp_path):
    c = Clock()
    land, asked = landing(tmp_path, [(503, {}, []), (429, {"retry-after": "3"}, []), (200, {}, [b"a", b"b"])], c)
    url = "https://www.sec.gov/files/company_tickers.json"
    path, hit = land.get(url)
    assert (path.read_bytes(), hit, len(asked)) == (b"ab", False, 3) and 3.0 in c.slept
    assert land.get(url) == (path, True) and len(asked) == 3


def test_failures(tmp_path):
    c = Clock()
    land, asked = landing(tmp_path, [(404, {}, []), (200, {}, [b"x"])], c)
    done, failed = land.get_all(["https://x.example/a", "https://x.example/b"])
    assert len(done) == 1 and list(failed) == ["https://x.example/a"] and len(asked) == 2
    land, asked = landing(tmp_path, [(500, {}, [])] * 9, c)
    with pytest.raises(fe.FetchError):
        land.get("https://x.example/c")
    assert len(asked) == fe.TRIES


def test_places_as_in_tables(spark):
    from pyspark.sql import functions as F

    from tidemark.sources.urls import landing_path

    for u in ("https://www.sec.gov/Archives/edgar/data/12/000/../../x.htm", "https://data.sec.gov/submissions/CIK0000000001.json", "https://o.example/a b?q=1", "https://o.example/../../etc/passwd"):
        assert fe.place_of(u) == spark.range(1).select(landing_path(F.lit(u))).first()[0]
        assert ".." not in fe.place_of(u).split("/")


def test_settings(tmp_path):
    assert fe.Settings("a@b.example", tmp_path).landing == tmp_path / "landing"
    with pytest.raises(ValueError):
        fe.Settings("nobody")
