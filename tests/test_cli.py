from __future__ import annotations

import json
import zipfile

from tidemark.cli import main
from tidemark.sources import tables as tb
from tests.test_sources import company, obs


def test_structured_commands(spark, tmp_path, capsys):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("CIK0000000001.json", company([obs(start="2024-01-01", val=7)], tag="Revenues"))
    (tmp_path / "c.yaml").write_text("companies:\n- {ticker: A, cik: 1, name: A, lender: false}\n")
    (tmp_path / "k.yaml").write_text("concepts:\n  rev: {label: R, applies_to: all, unit: USD, period_type: duration, candidates: [Revenues]}\n")
    base = ["--facts", str(tmp_path / "f"), "--companies", str(tmp_path / "c.yaml")]
    assert main(["ingest-facts", "--archive", str(tmp_path / "a.zip"), *base]) == 0
    k = ["--concepts", str(tmp_path / "k.yaml")]
    assert main(["coverage", *base, *k]) == 0
    assert main(["financials", *base, *k, "--concept", "rev", "--year", "2024"]) == 0
    assert "\t7.0\t" in capsys.readouterr().out
    assert main(["financials", *base, *k, "--concept", "rev", "--year", "2020"]) == 1
    assert main(["financials", *base, *k, "--concept", "zz", "--year", "2024"]) == 2
    assert main(["financials", *base, *k, "--concept", "rev", "--year", "2024", "-t", "ZZ"]) == 2
    (tmp_path / "t.json").write_text(json.dumps({"0": {"cik_str": 1, "ticker": "A", "title": "One"}}))
    assert main(["resolve", "--file", str(tmp_path / "t.json"), "-t", "a"]) == 0
    assert main(["resolve", "--file", str(tmp_path / "t.json"), "-t", "b"]) == 1
    assert main(["resolve", "--file", str(tmp_path / "t.json")]) == 2


def test_text_commands(spark, tmp_path, capsys):
    body = "Credit losses rose in the year. " * 60
    text = "".join(f"Item {i}. T\n{body}\n" for i in ("1", "1A", "7", "9A"))
    spark.createDataFrame([("f", text)], "accession string, text string").write.parquet(str(tmp_path / "t"))
    t = ["--texts", str(tmp_path / "t")]
    assert main(["sections", *t, "--out", str(tmp_path / "chunks")]) == 0
    assert spark.read.parquet(str(tmp_path / "chunks")).count() == 4
    assert main(["show", *t, "--accession", "f", "--item", "7"]) == 0
    assert main(["show", *t, "--accession", "f", "--item", "8"]) == 1
    assert main(["show", *t, "--accession", "x", "--item", "8"]) == 2
    assert main(["label-span", *t, "--accession", "f", "--phrase", "credit losses"]) == 0
    rows = spark.read.parquet(str(tmp_path / "chunks")).selectExpr(
        "concat('f:', char_start) chunk_id", "'1' cik", "'A' ticker", "accession", "'10-K' form", "date'2024-12-31' period_end", "2024 fiscal_year", "items", "'p' section_path", "'d' document_name", "char_start", "char_end", "text",
        "'s' text_sha256", "sha2(text, 256) digest", "'m' model",
    )
    rows = rows.dropDuplicates(["digest"])
    tb.write_manifest(rows, str(tmp_path / "m"))
    how = ["--manifest", str(tmp_path / "m"), "--cache", str(tmp_path / "v"), "--model", "m", "--index", str(tmp_path / "i")]
    assert main(["build-index", *how, "--dry-run"]) == 0 and main(["build-index", *how]) == 0
    for mode in ("vector", "bm25", "hybrid"):
        assert main(["search", "--index", str(tmp_path / "i"), "--question", "credit loss", "--mode", mode, "-t", "a"]) == 0
    assert main(["search", "--index", str(tmp_path / "i"), "--question", "credit loss", "-t", "zz"]) == 1
    capsys.readouterr()


def test_fetch_commands(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "c.yaml").write_text("companies:\n- {ticker: A, cik: 1, name: One, group: g, lender: true}\n- {ticker: B, cik: 2, name: Two, group: g, lender: false}\n")
    asked = []

    def transport(url):
        asked.append(url)
        if url.endswith("CIK0000000002.json"):
            return 404, {}, ()
        filing = {"accessionNumber": ["0000000001-25-000001"], "form": ["10-K"], "filingDate": ["2025-02-01"], "reportDate": ["2024-12-31"], "primaryDocument": ["a.htm"], "isXBRL": [1]}
        files = [{"name": "CIK0000000001-submissions-001.json", "filingCount": 1, "filingFrom": "2010-01-01", "filingTo": "2011-01-01"}]
        body = json.dumps({"cik": "1", "filings": {"recent": filing, "files": files}} if url.endswith("CIK0000000001.json") else {})
        return 200, {}, [body.encode()]

    monkeypatch.setattr("tidemark.cli.http_transport", lambda settings: transport)
    how = ["--folder", str(tmp_path / "landing"), "--contact", "me@x.example", "--rate", "1000", "--companies", str(tmp_path / "c.yaml")]
    assert main(["fetch-submissions", *how]) == 1  # one company has none
    assert "status 404" in capsys.readouterr().out
    pages = tmp_path / "landing/misc/data.sec.gov/submissions"
    assert (pages / "CIK0000000001-submissions-001.json").exists()
    assert main(["filings", "--folder", str(tmp_path / "landing/submissions"), "--pages", str(pages), "--years", "1"]) == 0
    assert "0000000001-25-000001" in capsys.readouterr().out
    assert main(["fetch-filings", *how, "-t", "A"]) == 0
    assert {u.rsplit("/", 1)[1] for u in asked} >= {"a.htm", "0000000001-25-000001-index.htm"}
    before = len(asked)
    assert main(["fetch-companyfacts", *how, "-t", "A"]) == 0 and main(["fetch-companyfacts", *how, "-t", "A"]) == 0
    assert len(asked) == before + 1  # the second time it is there


def test_embed_command(spark, tmp_path, capsys):
    text = "Credit losses rose. " * 30
    rows = spark.createDataFrame([(f"f:{n}", text + str(n)) for n in range(4)], "chunk_id string, text string").selectExpr(
        "chunk_id", "'1' cik", "'A' ticker", "'f' accession", "'10-K' form", "date'2024-12-31' period_end", "2024 fiscal_year", "array('7') items", "'p' section_path", "'d' document_name", "0L char_start", "9L char_end", "text",
        "'s' text_sha256", "sha2(text, 256) digest", "'hashing' model",
    )
    tb.write_manifest(rows, str(tmp_path / "m"))
    how = ["--manifest", str(tmp_path / "m"), "--cache", str(tmp_path / "v")]
    assert main(["embed", *how, "--dry-run"]) == 0 and "4 to embed" in capsys.readouterr().out
    assert main(["embed", *how, "--rounds", "2"]) == 0 and "4 embedded" in capsys.readouterr().out
    assert main(["build-index", *how, "--index", str(tmp_path / "i")]) == 0 and "0 embedded\n4 indexed" in capsys.readouterr().out
