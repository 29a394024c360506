from __future__ import annotations

import datetime as dt
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.functions.ids import cik10
from tidemark.operators import manifest as ma
from tidemark.sources import config_files as cf
from tidemark.sources import json_sources as js
from tidemark.sources import tables as tb
from tidemark.sources import urls
from tidemark.streaming.ingest import ingest_landing

D = dt.date


def company(observations, tag="Assets", unit="USD"):
    return json.dumps({"cik": 1, "entityName": "One", "facts": {"us-gaap": {tag: {"label": "x", "units": {unit: observations}}}}})


def obs(**k):
    return {"end": "2024-12-31", "val": 5, "accn": "a", "fy": 2024, "fp": "FY", "form": "10-K", "filed": "2025-02-01"} | k


def flat(spark, *texts):
    return js.flatten_facts(spark.createDataFrame([("1", t) for t in texts], "cik string, json string"))


def test_flatten(spark):
    got = flat(spark, company([obs(), obs(start="2024-01-01", val=7.5, frame="CY2024"), obs(end="2024-1-5")])).orderBy("val", "period_end").collect()
    assert [(r["period_type"], r["val"], r["period_end"], r["period_year"], r["frame"]) for r in got] == [
        ("instant", 5.0, D(2024, 1, 5), 2024, None), ("instant", 5.0, D(2024, 12, 31), 2024, None), ("duration", 7.5, D(2024, 12, 31), 2024, "CY2024")
    ]
    assert got[0]["cik"] == "0000000001" and got[0]["accn"] == "a"


def test_bad_observations_are_dropped(spark):
    bad = [obs(val=None), obs(val=True), obs(val="x"), obs(end="soon"), obs(filed=None), obs(start="bad"), {"end": "2024"}]
    good = obs(fy="n/a", accn=None)
    rows = flat(spark, company([*bad, good])).collect()
    assert [(r["val"], r["fy"], r["accn"]) for r in rows] == [(5.0, None, "")]


def test_malformed_raises(spark):
    for text in ("not json", "{}"):
        with pytest.raises(Exception, match="no facts"):
            flat(spark, text).collect()


def test_zip_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("CIK0000000001.json", company([obs()]))
        z.writestr("CIK0000000002.json", company([obs(val=9)]))
    got = js.flatten_facts(js.zip_members(spark, str(tmp_path / "a.zip"), ["0000000001", "0000000002"]))
    assert sorted((r["cik"], r["val"]) for r in got.collect()) == [("0000000001", 5.0), ("0000000002", 9.0)]
    with pytest.raises(Exception, match="no member for company 0000000003"):
        js.zip_members(spark, str(tmp_path / "a.zip"), ["0000000003"]).collect()


def test_submissions(spark):
    recent = {"accessionNumber": ["a", "b", "c"], "form": ["10-K", "8-K", "10-K"], "filingDate": ["2024-02-01"] * 3, "reportDate": ["2023-12-31", "2023-12-31", ""], "primaryDocument": ["d", "e", "f"], "isXBRL": [1, 0, 1]}
    payload = {"cik": "1", "filings": {"recent": recent, "files": [{"name": "CIK0000000001-submissions-001.json", "filingCount": 5, "filingFrom": "2001-01-01", "filingTo": "2010-01-01"}]}}
    df = spark.createDataFrame([(json.dumps(payload),)], "json string")
    assert [(r["cik"], r["accession"], r["is_xbrl"]) for r in js.recent_filings(df, ["10-K"]).collect()] == [("0000000001", "a", True)]
    assert js.recent_filings(df).count() == 2
    page = js.older_pages(df).first()
    assert (page["name"], page["n_filings"], page["first_filed"]) == ("CIK0000000001-submissions-001.json", 5, D(2001, 1, 1))
    pages = spark.createDataFrame([("1", json.dumps(recent))], "cik string, json string")
    assert js.page_filings(pages, ["8-K"]).first()["accession"] == "b"


def test_tickers(spark):
    text = json.dumps({"0": {"cik_str": 1, "ticker": "aa", "title": "One"}, "1": {"cik_str": 2, "ticker": "BB", "title": "Two"}, "10": {"cik_str": 3, "ticker": "AA", "title": "Three"}})
    t = js.tickers(spark.createDataFrame([(text,)], "json string"))
    assert js.find_ticker(t, " aa ") == "0000000003"
    with pytest.raises(LookupError):
        js.find_ticker(t, "zz")


@pytest.mark.parametrize(("text", "key"), [("1", "0000000001"), ("CIK0000320193", "0000320193"), ("cik-12", "0000000012"), (" 5 ", "0000000005"), ("0", None), ("x", None), ("12345678901", None), (None, None)])
def test_cik(spark, text, key):
    assert spark.createDataFrame([(text,)], "c string").select(cik10("c")).first()[0] == key


def test_landing_paths(spark):
    place = lambda u: spark.range(1).select(urls.landing_path(F.lit(u))).first()[0]
    assert place("https://www.sec.gov/files/company_tickers.json") == "reference/company_tickers.json"
    assert place("https://www.sec.gov/Archives/edgar/data/12/000/../../x.htm") == "filings/12/000/x.htm"
    assert place("https://other.example/a b/c?q=1") == "misc/other.example/a_b/c"


def test_filing_texts(spark):
    df = spark.createDataFrame([("f", 1, "b.htm", "xyz"), ("f", 0, "a.htm", "ab"), ("f", 2, "c.htm", None)], "accession string, part_no int, name string, text string")
    r = js.filing_texts(df).first()
    assert r["text"] == "ab\n\nxyz\n\n" and [(p["name"], p["start"], p["end"]) for p in r["parts"]] == [("a.htm", 0, 2), ("b.htm", 4, 7), ("c.htm", 9, 9)]


def test_config_files(spark, tmp_path):
    good = tmp_path / "c.yaml"
    good.write_text("companies:\n- {ticker: b, cik: 2, name: B, lender: true}\n- {ticker: a, cik: CIK1, name: A}\n")
    assert [(r["ordinal"], r["ticker"], r["cik"], r["lender"]) for r in cf.read_companies(spark, good).orderBy("ordinal").collect()] == [(0, "B", "0000000002", True), (1, "A", "0000000001", False)]
    good.write_text("companies:\n- {ticker: b, cik: 2, lender: maybe}\n- {ticker: B, cik: '02'}\n- {ticker: x, cik: none}\n")
    with pytest.raises(cf.ConfigError) as e:
        cf.read_companies(spark, good)
    assert len(e.value.problems) == 4
    good.write_text("concepts:\n  rev: {label: R, rule: first_available, applies_to: all, unit: USD, period_type: duration, candidates: [A, B]}\n")
    assert [(r["tag_rank"], r["tag"]) for r in cf.read_concepts(spark, good).collect()] == [(0, "A"), (1, "B")]
    good.write_text("concepts:\n  rev: {applies_to: some, period_type: year, candidates: [A, A]}\n")
    with pytest.raises(cf.ConfigError) as e:
        cf.read_concepts(spark, good)
    assert len(e.value.problems) == 3


def test_questions_and_records(spark, tmp_path):
    p = tmp_path / "q.yaml"
    p.write_text(
        "questions:\n- {id: q1, question: why, persona: aml, archetype: peer, split: dev, written_on: 2026-01-01, scope: {tickers: [A, B], items: ['7']},"
        " gold: [{accession: a, char_start: 0, char_end: 5, grade: 2, filing_sha256: s}]}\n"
    )
    words = {"ticker": {"A", "B"}, "item": {"7"}, "fiscal_year": set()}
    questions, gold = cf.read_questions(spark, p, words)
    assert questions.first()["tickers"] == ["A", "B"] and gold.first()["labelled_on"] == D(2026, 1, 1)
    bad = [{"id": "q", "question": " ", "archetype": "x", "split": "y", "scope": {"tickers": ["Z"]}, "gold": [{"char_start": 5, "char_end": 5, "grade": 7}]}] * 2
    found = cf.validate_questions(bad, words)
    # twice: persona, written_on missing; archetype, split, ticker; of the passage accession and sha missing, grade, empty
    assert len(found) == 1 + 2 * 9 and found[0] == "question q twice"
    fine = {"id": "p", "question": "x", "persona": "aml", "archetype": "peer", "scope": {}, "split": "dev", "written_on": "2026-01-01", "gold": [{"accession": "a", "char_start": 0, "char_end": 9, "grade": None, "filing_sha256": "s"}]}
    assert cf.validate_questions([fine], words) == []  # a peer question may name no company at all
    assert cf.validate_questions([fine | {"scope": {"tickers": ["A"]}}], words) == ["p: a peer question with a single company"]
    assert len(cf.validate_questions([fine | {"persona": "x", "gold": [fine["gold"][0] | {"grade": 0, "source": "y"}, 5]}, 7], words)) == 5
    assert cf.validate_questions("x", words) == ["questions must be a list"]
    records = tmp_path / "j.yaml"
    assert cf.read_records(spark, records, "judgments").count() == 0
    cf.append_records(records, "judgments", [{"question": "q1", "accession": "a", "char_start": 0, "char_end": 5, "grade": 1, "judged_on": "2026-01-02"}], "# made by a machine\n")
    cf.append_records(records, "judgments", [{"question": "q2", "accession": "a", "char_start": 0, "char_end": 5, "grade": 0, "judged_on": "2026-01-03"}])
    assert records.read_text().startswith("# made by a machine\n") and cf.read_records(spark, records, "judgments").count() == 2


def test_manifest_cache_and_index(spark, tmp_path):
    rows = spark.createDataFrame([(f"f:{n}", "10-K", f"text about credit {n} " * 20, f"d{n}", "m") for n in range(5)], "chunk_id string, form string, text string, digest string, model string")
    cache = tb.VectorCache(spark, str(tmp_path / "cache"), "My Model/x", 64)
    assert cache.read().count() == 0 and cache.stats().first()["n"] == 0
    assert tb.embed_missing(rows, cache, tb.hashing_encoder(), rounds=2) == 5
    assert tb.embed_missing(rows, cache, tb.hashing_encoder()) == 0
    assert cache.stats().first()["n"] == 5 and cache.digests().count() == 5
    vectors = cache.load(rows)
    with pytest.raises(Exception, match="not 64 wide"):
        cache.append(spark.createDataFrame([("z", [1.0])], "digest string, vector array<float>"), 9)
    with pytest.raises(Exception, match="empty or longer"):
        tb.embed_missing(spark.createDataFrame([("e", " ")], "digest string, text string"), cache, tb.hashing_encoder())
    assert tb.build_index(rows, vectors, str(tmp_path / "index")) == 5
    chunks, index = tb.open_index(spark, str(tmp_path / "index"))
    assert chunks.count() == 5 and index.totals.first()["n_docs"] == 5
    with pytest.raises(ValueError, match="missing"):
        tb.build_index(rows, vectors.where("digest <> 'd1'"), str(tmp_path / "index"))
    (tmp_path / "index/000002/chunks").mkdir(parents=True)  # as a build that broke off leaves it
    assert tb.open_index(spark, str(tmp_path / "index"))[0].count() == 5  # the complete one counts
    assert tb.build_index(rows.limit(4), vectors, str(tmp_path / "index")) == 4 and tb.open_index(spark, str(tmp_path / "index"))[0].count() == 4
    with pytest.raises(ValueError, match="more than once"):
        ma.assert_unique(rows.union(rows), "chunk_id")


def test_files(tmp_path):
    note = tb.keep_answer(tmp_path / "a/b.json", iter([b"ab", b"c"]), url="u")
    assert (tmp_path / "a/b.json").read_bytes() == b"abc" and note["bytes"] == 3 and not list(tmp_path.rglob("*.partial"))
    assert tb.log_run(tmp_path / "log", {"config": "x", "split": "blind"}) == 0
    assert tb.log_run(tmp_path / "log", {"config": "x", "split": "blind"}) == 1
    assert tb.safe_name("item_aware", "My Model@64") == "item_aware-my_model_64"


def test_landing_stats(spark, tmp_path):
    tb.keep_answer(tmp_path / "a/b.json", iter([b"abc"]), url="u")
    (tmp_path / "a/c.partial").write_bytes(b"zz")
    r = urls.landing_stats(spark, str(tmp_path)).first()
    assert (r["n"], r["bytes"]) == (1, 3)


def test_results_csv(spark, tmp_path):
    row = ("q", "a", "dev", "bm25", "fixed", "one", True, 1.0, None, 0.5, 0.1, 2, 3, None, ["c1", "c2"])
    schema = "question string, archetype string, split string, mode string, chunker string, strategy string, labelled boolean, recall_5 double, recall_10 double, reciprocal_rank double, ndcg_10 double, unjudged_10 int, issuers_10 int, coverage_10 double, hits array<string>"
    tb.write_results(spark.createDataFrame([row], schema), str(tmp_path / "r"))
    text = [x for p in sorted((tmp_path / "r").glob("*.csv")) for x in p.read_text().splitlines() if x]
    assert text[0].startswith("question,archetype") and text[-1] == "q,a,dev,bm25,fixed,one,true,1.0,,0.5,0.1,2,3,,c1 c2"


def test_streaming_ingest(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    run = lambda: ingest_landing(spark, str(landing), str(tmp_path / "facts"), str(tmp_path / "ck")).awaitTermination()
    (landing / "CIK0000000001.json").write_text(company([obs()]))
    run()
    run()
    assert tb.read_facts(spark, str(tmp_path / "facts")).count() == 1
    (landing / "CIK0000000002.json").write_text(company([obs(), obs(end="2023-12-31")]))
    run()
    assert sorted(r["cik"] for r in tb.read_facts(spark, str(tmp_path / "facts")).collect()) == ["0000000001", "0000000002", "0000000002"]


def test_context(spark):
    row = spark.createDataFrame([("One Co", "ONE", "10-K", D(2024, 12, 31), ["7", "7A"], [])], "n string, t string, f string, p date, i array<string>, e array<string>")
    got = row.select(ma.contextual_prefix(*[F.col(c) for c in "ntfpi"]), ma.contextual_prefix(*[F.col(c) for c in "ntfpe"]), ma.section_path(F.col("f"), F.col("e"))).first()
    assert got[0] == "One Co (ONE) · 10-K · period ending 2024-12-31 · Item 7. Management's Discussion and Analysis; Item 7A. Quantitative and Qualitative Disclosures About Market Risk"
    assert got[1].endswith("· full document") and got[2] == "10-K"


def test_folders_of_facts_do_not_grow_with_companies(spark, tmp_path):
    from tidemark import schemas

    def facts(keys, val):
        rows = spark.createDataFrame([(c, y, val) for c, y in keys], "cik string, period_year int, val double")
        return rows.select(*[F.col(n) if n in rows.columns else F.lit(None).cast(t).alias(n) for n, t in (x.strip().split(" ") for x in schemas.FACTS.split(","))])

    path = str(tmp_path / "f")
    keys = [(None if i == 0 else f"{i:010d}", y) for i in range(100) for y in (2023, 2024, None)]
    tb.write_facts(facts(keys, 1.0), path)
    folders = {p.parent for p in (tmp_path / "f").rglob("*.parquet")}
    assert len(folders) < 100  # of 300 companies and years
    again = [(None, 2023), (None, None), ("0000000007", 2024), ("0000000008", None), ("0000000100", 2024), ("0000000100", 2025)]
    tb.write_facts(facts(again, 2.0), path)
    tb.write_facts(facts([], 3.0), path)
    want = dict.fromkeys(keys, 1.0) | dict.fromkeys(again, 2.0)
    assert sorted(map(repr, (((r["cik"], r["period_year"]), r["val"]) for r in tb.read_facts(spark, path).collect()))) == sorted(map(repr, want.items()))
    tb.write_facts(tb.read_facts(spark, path).where("period_year = 2025").withColumn("val", F.lit(4.0)), path)  # read from where it is written to
    assert tb.read_facts(spark, path).count() == len(want) and tb.read_facts(spark, path).where("val = 4").count() == 1


def test_facts_of_an_earlier_layout_stay(spark, tmp_path):
    from tidemark import schemas

    path = str(tmp_path / "f")
    facts = spark.createDataFrame([(None,) * 15], schemas.FACTS).withColumns({"cik": F.lit("0000000001"), "period_year": F.lit(2024)})
    facts.write.partitionBy("cik", "period_year").parquet(path)
    with pytest.raises(ValueError, match="earlier version"):
        tb.write_facts(facts, path)
    assert [r["cik"] for r in tb.read_facts(spark, path).collect()] == ["0000000001"]
