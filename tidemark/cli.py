"""``python -m tidemark.cli``: the engine over local files and tables."""

from __future__ import annotations

import argparse
import datetime as dt
import sys
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import evaluate as ev
from tidemark.operators import facts as fa
from tidemark.operators import filings as fi
from tidemark.operators import financials as fn
from tidemark.operators import intervals as iv
from tidemark.operators import kernels as ke
from tidemark.operators import manifest as ma
from tidemark.operators import search as se
from tidemark.session import local_session
from tidemark.sources import config_files as cf
from tidemark.sources import json_sources as js
from tidemark.sources import tables as tb
from tidemark.sources import urls
from tidemark.sources.encoders import HttpEncoder
from tidemark.sources.fetch import Landing, Pace, Settings, http_transport


def _show(df: DataFrame, n: int = 200) -> int:
    """Print up to ``n`` rows; how many there were."""
    rows = df.limit(n).collect()
    print("\t".join(df.columns))
    for r in rows:
        print("\t".join("" if v is None else str(v) for v in r))
    return len(rows)


def _tickers(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    companies = cf.read_companies(spark, a.companies)
    if a.ticker:
        wanted = [t.upper() for t in a.ticker]
        known = {r[0] for r in companies.select("ticker").collect()}  # the registry, a small file
        if unknown := [t for t in wanted if t not in known]:
            raise SystemExit2(f"unknown: {', '.join(unknown)}; known are {', '.join(sorted(known))}")
        companies = companies.where(F.col("ticker").isin(*wanted))
    return companies


class SystemExit2(Exception):
    """A wrong request: exit code 2."""


def resolve(spark: SparkSession, a: argparse.Namespace) -> int:
    if bool(a.ticker) == bool(a.cik):
        raise SystemExit2("give a ticker or a company key, not both")
    table = js.tickers(js.text_files(spark, a.file).select(F.col("text").alias("json")))
    rows = table.where(F.col("ticker") == a.ticker[0].upper()) if a.ticker else table.where(F.col("cik") == a.cik.zfill(10))
    return 0 if _show(rows) else 1


def ingest_facts(spark: SparkSession, a: argparse.Namespace) -> int:
    companies = _tickers(spark, a)
    keys = [r[0] for r in companies.select("cik").collect()]
    tb.write_facts(js.flatten_facts(js.zip_members(spark, a.archive, keys)), a.facts)
    report = fa.ingest_report(tb.read_facts(spark, a.facts), companies).orderBy("ordinal")
    _show(report)
    return int(not report.where("is_empty").isEmpty())


def landing(spark: SparkSession, a: argparse.Namespace) -> int:
    _show(urls.landing_stats(spark, a.folder))
    return 0


def coverage(spark: SparkSession, a: argparse.Namespace) -> int:
    concepts, companies = cf.read_concepts(spark, a.concepts), _tickers(spark, a)
    names = [r[0] for r in concepts.select("concept").distinct().orderBy("concept").collect()]
    cells = fn.coverage_cells(tb.read_facts(spark, a.facts), concepts, companies, tuple(a.years))
    _show(fn.coverage_grid(cells, names).orderBy("ticker"))
    return 0


def financials(spark: SparkSession, a: argparse.Namespace) -> int:
    concepts = cf.read_concepts(spark, a.concepts).where(F.col("concept") == a.concept)
    if concepts.isEmpty():
        raise SystemExit2(f"unknown concept {a.concept!r}")
    companies = _tickers(spark, a)
    facts = tb.read_facts(spark, a.facts).join(companies.select("cik"), "cik", "left_semi")
    year = facts.where(F.col("period_year") == a.year)
    values = fn.concept_values(year, concepts, a.basis)
    n = _show(values.join(companies.select("cik", "ticker", "ordinal"), "cik").orderBy("ordinal").drop("ordinal"))
    _show(fn.unavailable(values, fn.resolve_concepts(year, concepts), companies, concepts, [a.year]))
    _show(fn.comparability(values).where("misaligned OR mixed_tags"))
    return int(n == 0)


def filings(spark: SparkSession, a: argparse.Namespace) -> int:
    payloads = js.text_files(spark, a.folder).where(F.col("name").rlike(r"^CIK\d{10}\.json$")).select(F.col("text").alias("json"))
    rows, pages = js.recent_filings(payloads, fi.ANNUAL_FORMS), js.older_pages(payloads)
    read = js.text_files(spark, a.pages or a.folder).where(F.col("name").contains("-submissions-"))
    older = js.page_filings(read.select(F.regexp_extract("name", r"CIK(\d{10})", 1).alias("cik"), F.col("text").alias("json")), fi.ANNUAL_FORMS)
    rows = rows.unionByName(older)
    unread = pages.join(read.select("name"), "name", "left_anti")
    short = fi.completeness(rows, unread, a.years).where("truncated")
    _show(fi.latest_per_year(rows, a.years).orderBy("cik", F.desc("report_date")))
    return int(_show(short) > 0)


def sections(spark: SparkSession, a: argparse.Namespace) -> int:
    from tidemark.operators import adjudicate as ad

    texts = spark.read.parquet(a.texts)
    located = ke.located(texts)
    states = ad.parser_states(texts, located)
    _show(ad.parser_report(states))
    _show(ad.bad_offsets(texts, located))
    r = states.agg(F.avg((F.col("state") == "located").cast("double"))).first()[0] or 0.0
    print(f"located {r:.2%}")
    if a.out:
        segments = iv.segments(located)
        (ke.item_aware(texts, segments) if a.chunker == "item_aware" else ke.fixed_windows(texts)).write.mode("overwrite").parquet(a.out)
    return int(r < a.threshold)


def show(spark: SparkSession, a: argparse.Namespace) -> int:
    text = spark.read.parquet(a.texts).where(F.col("accession") == a.accession)
    if text.isEmpty():
        raise SystemExit2(f"no filing {a.accession!r}")
    spans = ke.located(text).where(F.col("item") == a.item.upper()).join(text.select("accession", "text"), "accession")
    body = F.substring(F.col("text"), F.col("span_start").cast("int") + 1, (F.col("span_end") - F.col("span_start")).cast("int"))
    return int(_show(spans.orderBy("span_no").select("item", "strategy", "span_start", "span_end", body.alias("text"))) == 0)


def search(spark: SparkSession, a: argparse.Namespace) -> int:
    chunks, index = tb.open_index(spark, a.index)
    where = se.Filters.of(ticker=a.ticker, fiscal_year=a.year, form=a.form, items=a.item).condition()
    width = len(chunks.select("vector").first()[0])
    encode = _encoder(a, width)
    asked = ma.QUERY + a.question if a.encoder else a.question
    found = se.search(a.mode, vectors=chunks.withColumnRenamed("vector", "embedding"), encode=lambda t: encode([t])[0], index=index, question=a.question, vector_question=asked, k=a.k, where=where, rows=chunks)
    return int(_show(found.join(chunks.select("chunk_id", "ticker", "section_path", F.substring("text", 1, 100).alias("snippet")), "chunk_id").orderBy("rank")) == 0)


def _encoder(a: argparse.Namespace, width: int) -> tb.Encode:
    return HttpEncoder(a.encoder, a.model, width) if a.encoder else tb.hashing_encoder(width)


def embed(spark: SparkSession, a: argparse.Namespace) -> int:
    """Encode what a cache lacks of a manifest; an interruption loses one of the rounds."""
    inputs, cache = tb.read_manifest(spark, a.manifest).select("digest", "text"), tb.VectorCache(spark, a.cache, a.model, a.width)
    if a.dry_run:
        print(inputs.select("digest").distinct().join(cache.digests(), "digest", "left_anti").count(), "to embed")
        return 0
    print(tb.embed_missing(inputs, cache, _encoder(a, a.width), rounds=a.rounds), "embedded")
    return 0


def build_index(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = tb.read_manifest(spark, a.manifest)
    if embed(spark, a) or a.dry_run:
        return 0
    print(tb.build_index(rows, tb.VectorCache(spark, a.cache, a.model, a.width).load(rows), a.index), "indexed")
    return 0


def label_span(spark: SparkSession, a: argparse.Namespace) -> int:
    """The passages of a filing with a phrase, ready to be put into the file of questions."""
    from tidemark.operators.adjudicate import gold_entries

    texts = spark.read.parquet(a.texts).where(F.col("accession") == a.accession)
    found = ke.with_passages(texts, a.phrase, id_col="accession")
    return int(_show(gold_entries(found, texts, grade=a.grade, day=dt.date.today().isoformat()).orderBy("char_start")) == 0)


def _fetch(a: argparse.Namespace, wanted: list[str]) -> int:
    """Answers of addresses that the landing folder lacks; 1 if any failed."""
    done, failed = Landing(a.folder, http_transport(Settings(a.contact)), Pace(a.rate)).get_all(wanted)
    print(len(done), "there")
    for url, why in failed.items():
        print(url, why, sep="\t")
    return int(bool(failed))


def _addresses(rows: DataFrame, *columns: Column) -> list[str]:
    return [u for r in rows.select(*columns).collect() for u in r if u]  # a few for each company of the registry


def fetch_submissions(spark: SparkSession, a: argparse.Namespace) -> int:
    """Lists of filings, and the older pages they name."""
    companies = _tickers(spark, a)
    failed = _fetch(a, _addresses(companies, urls.submissions_url(F.col("cik"))))
    payloads = js.text_files(spark, f"{a.folder}/submissions").where(F.col("name").rlike(r"^CIK\d{10}\.json$")).select(F.col("text").alias("json"))
    older = js.older_pages(payloads).join(companies.select("cik"), "cik", "left_semi")
    return _fetch(a, _addresses(older, urls.submissions_page_url(F.col("name")))) | failed


def fetch_companyfacts(spark: SparkSession, a: argparse.Namespace) -> int:
    """Tagged facts of each company."""
    return _fetch(a, _addresses(_tickers(spark, a), urls.facts_url(F.col("cik"))))


def fetch_filings(spark: SparkSession, a: argparse.Namespace) -> int:
    """Main documents and index pages of the annual reports of the last years."""
    payloads = js.text_files(spark, f"{a.folder}/submissions").where(F.col("name").rlike(r"^CIK\d{10}\.json$")).select(F.col("text").alias("json"))
    rows = js.recent_filings(payloads, fi.ANNUAL_FORMS).join(_tickers(spark, a).select("cik"), "cik", "left_semi")
    c, n = F.col("cik"), F.col("accession")
    return _fetch(a, _addresses(fi.latest_per_year(rows, a.years), urls.document_url(c, n, F.col("primary_document")), urls.filing_index_page_url(c, n)))


def eval_retrieval(spark: SparkSession, a: argparse.Namespace) -> int:
    scores = ev.question_scores(spark.read.parquet(a.hits), spark.read.parquet(a.spans))
    _show(ev.summarized(scores).orderBy("config"))
    _show(ev.win_loss(scores).orderBy("config_a", "config_b"))
    tags = spark.read.parquet(a.tags) if a.tags else None
    _show(ev.needs_failure_tag(scores) if tags is None else ev.untagged(scores, tags))
    return 0


def adjudicate(spark: SparkSession, a: argparse.Namespace) -> int:
    from tidemark.operators.adjudicate import pool

    _show(pool(spark.read.parquet(a.hits), spark.read.parquet(a.spans)))
    return 0


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark")
    sub = p.add_subparsers(dest="command", required=True)

    def command(f: Callable, *options: tuple) -> None:
        c = sub.add_parser(f.__name__.replace("_", "-"), help=f.__doc__)
        c.set_defaults(run=f)
        for names, how in options:
            c.add_argument(*names.split(), **how)

    need, many = {"required": True}, {"action": "append", "default": []}
    ticker, companies, facts, concepts = ("--ticker -t", many), ("--companies", need), ("--facts", need), ("--concepts", need)
    texts, hits, spans = ("--texts", need), ("--hits", need), ("--spans", need)
    command(resolve, ("--file", need), ticker, ("--cik", {}))
    command(ingest_facts, ("--archive", need), companies, facts, ticker)
    command(landing, ("--folder", need))
    command(coverage, facts, concepts, companies, ticker, ("--years", {"type": int, "nargs": 2, "default": [2022, 2025]}))
    command(financials, facts, concepts, companies, ticker, ("--concept", need), ("--year", need | {"type": int}), ("--basis", {"default": "as_restated", "choices": ["as_reported", "as_restated"]}))
    command(filings, ("--folder", need), ("--pages", {"help": "where older pages are, if elsewhere"}), ("--years", {"type": int, "default": 3}))
    command(sections, texts, ("--threshold", {"type": float, "default": 0.9}), ("--out", {}), ("--chunker", {"default": "item_aware", "choices": ["item_aware", "fixed_window"]}))
    command(show, texts, ("--accession", need), ("--item", need))
    encoding = ("--encoder", {"help": "address of an encoder; words are hashed without one"}), ("--model", {"default": "hashing"})
    embedding = ("--manifest", need), ("--cache", need), *encoding, ("--width", {"type": int, "default": 64}), ("--rounds", {"type": int, "default": 1}), ("--dry-run", {"action": "store_true"})
    landed = ("--folder", need), ("--contact", need), ("--rate", {"type": float, "default": 5.0}), companies, ticker
    command(embed, *embedding)
    command(build_index, *embedding, ("--index", need))
    command(fetch_submissions, *landed)
    command(fetch_companyfacts, *landed)
    command(fetch_filings, *landed, ("--years", {"type": int, "default": 3}))
    command(search, ("--index", need), ("--question", need), ("--mode", {"default": "vector", "choices": list(se.MODES)}), ("-k", {"type": int, "default": 10}), *encoding, ticker, ("--year", many | {"type": int}), ("--form", many), ("--item", many))
    command(label_span, texts, ("--accession", need), ("--phrase", need), ("--grade", {"type": int, "default": 2, "choices": [1, 2]}))
    command(eval_retrieval, hits, spans, ("--tags", {}))
    command(adjudicate, hits, spans)
    return p


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    try:
        return a.run(SparkSession.getActiveSession() or local_session("tidemark"), a)
    except (SystemExit2, cf.ConfigError) as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
