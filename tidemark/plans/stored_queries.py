"""Sources and sinks: what is written into the shared folder and read again, by the ways the engine offers."""

from __future__ import annotations

import os
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions.ids import cik10
from tidemark.operators import adjudicate as ad
from tidemark.operators import evaluate as ev
from tidemark.operators import facts as fa
from tidemark.operators import kernels as ke
from tidemark.operators import manifest as ma
from tidemark.operators import search as se
from tidemark.operators.text import markup_text, passages
from tidemark.plans.registry import Registry, table
from tidemark.plans.retrieval_queries import _DOT, _Q
from tidemark.plans.source_queries import _CIK
from tidemark.session import scratch, spread
from tidemark.sources import config_files as cf
from tidemark.sources import json_sources as js
from tidemark.sources import tables as tb
from tidemark.sources import urls

query = Registry()

_FACTS = schemas.names(schemas.FACTS)
_YEAR = "CAST(CASE WHEN period_start IS NULL OR year(period_start) = year(period_end) OR 2 * dayofyear(period_end) >= date_diff('day', period_start, period_end) THEN year(period_end) ELSE year(period_start) END AS INTEGER)"


@query("facts_replaced", f"SELECT {', '.join(f'{_CIK} AS cik' if c == 'cik' else f'{_YEAR} AS period_year' if c == 'period_year' else f'CASE WHEN {_YEAR} = 2021 THEN -val ELSE val END AS val' if c == 'val' else c for c in _FACTS)} FROM facts")
def facts_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact table by company and year; then one year of all companies is written anew, and the others stay."""
    path = scratch(spark, "facts")
    rows = table(spark, sf_dir, "facts").withColumn("cik", cik10("cik")).withColumn("period_year", fa.period_year(F.col("period_start"), F.col("period_end")))
    tb.write_facts(rows, path)
    tb.write_facts(rows.where("period_year = 2021").withColumn("val", -F.col("val")), path)
    return tb.read_facts(spark, path)


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest rows of which no two have one chunk id."""
    w = Window.partitionBy("chunk_id").orderBy("row_id")
    return table(spark, sf_dir, "manifest").where("chunk_id IS NOT NULL").withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


_CHUNKS = "k AS (SELECT * FROM manifest WHERE chunk_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY row_id) = 1)"


@query("manifest_stored", f"WITH {_CHUNKS} SELECT chunk_id, ticker, fiscal_year, array_to_string(items, ' ') AS items, char_start, char_end, sha256(text) AS text_sha256, digest FROM k")
def manifest_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "manifest")
    tb.write_manifest(_chunks(spark, sf_dir), path)
    rows = tb.read_manifest(spark, path)
    return rows.select("chunk_id", "ticker", "fiscal_year", F.array_join("items", " ").alias("items"), "char_start", "char_end", ma.digest(F.col("text")).alias("text_sha256"), "digest")


@query("digests_stored", f"WITH {_CHUNKS} SELECT DISTINCT digest FROM k")
def digests_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the digests of a stored manifest; the scan reads no other column."""
    path = scratch(spark, "manifest")
    tb.write_manifest(_chunks(spark, sf_dir), path)
    return tb.read_manifest(spark, path).select("digest").distinct()


def _cache(spark: SparkSession, sf_dir: str) -> tb.VectorCache:
    """A cache with all vectors in its first part and those of one label, turned round, in a second one."""
    cache = tb.VectorCache(spark, scratch(spark, "vectors"), "made up", 64)
    rows = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), "vec_id").alias("digest"), "label", F.col("embedding").cast("array<float>").alias("vector"))
    cache.append(rows, 0)
    cache.append(rows.where("label = 3").withColumn("vector", F.transform("vector", lambda x: -x)), 1)
    return cache


@query("vectors_cached", "SELECT 'v' || vec_id AS digest, len(embedding) AS width, round(CAST(CASE WHEN label = 3 THEN -embedding[1] ELSE embedding[1] END AS DOUBLE), 6) AS x0 FROM embeddings")
def vectors_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the asked digests; of one that was added twice the later counts."""
    asked = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), "vec_id").alias("digest"))
    return _cache(spark, sf_dir).load(asked).select("digest", F.size("vector").cast("bigint").alias("width"), F.round(F.col("vector")[0].cast("double"), 6).alias("x0"))


@query("vector_cache_stats", "SELECT count(*) + count(*) FILTER (label = 3) AS n, true AS has_files FROM embeddings")
def vector_cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cache(spark, sf_dir).stats().select("n", ((F.col("files") > 0) & (F.col("bytes") > 0)).alias("has_files"))


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "companies").withColumn("cik", cik10("cik"))


@query("zip_members_read", f"SELECT {_CIK} AS cik, ticker, company_name AS name FROM companies")
def zip_members_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of an archive that one task wrote, read in place."""
    path = scratch(spark, "archive").removeprefix("file:") + ".zip"
    companies = _registry(spark, sf_dir)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for b in batches:
                for cik, json in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    z.writestr(f"CIK{cik}.json", json)
                yield b.select(["cik"])

    members = companies.select("cik", F.to_json(F.struct("ticker", F.col("company_name").alias("name"))).alias("json")).coalesce(1)
    keys = [r[0] for r in members.mapInArrow(write, "cik string").collect()]  # the registry, as on the command line
    read = js.zip_members(spark, path, keys).select("cik", F.from_json("json", "ticker string, name string").alias("j"))
    return read.select("cik", "j.ticker", "j.name")


@query("tickers_resolved", f"SELECT upper(trim(ticker)) AS ticker, {_CIK} AS cik, company_name AS title FROM companies")
def tickers_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies put into the object of rows that the archive publishes, and read again."""
    w = Window.partitionBy(F.lit(0)).orderBy("ticker")  # a registry
    entry = F.struct(F.col("n").cast("string"), F.struct(F.col("cik").cast("bigint").alias("cik_str"), "ticker", F.col("company_name").alias("title")))
    rows = _registry(spark, sf_dir).withColumn("n", F.row_number().over(w)).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("json"))
    return js.tickers(rows)


_PAGES = "p AS (SELECT cik, year(filing_date) AS y, accession, form, filing_date, report_date, primary_document, is_xbrl FROM filings WHERE filing_date IS NOT NULL)"


def _submission_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each company and year a page of parallel arrays, and what its submissions say of it."""
    day = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(""))
    row = F.struct("accession", "form", day("filing_date").alias("f"), day("report_date").alias("r"), F.coalesce("primary_document", F.lit("")).alias("p"), F.coalesce("is_xbrl", F.lit(False)).cast("int").alias("x"))
    per = table(spark, sf_dir, "filings").where("filing_date IS NOT NULL").groupBy("cik", F.year("filing_date").alias("y")).agg(F.sort_array(F.collect_list(row)).alias("o"), F.min("filing_date").alias("a"), F.max("filing_date").alias("z"))
    columns = {"accessionNumber": "accession", "form": "form", "filingDate": "f", "reportDate": "r", "primaryDocument": "p", "isXBRL": "x"}
    page = F.to_json(F.struct(*[F.col(f"o.{c}").alias(k) for k, c in columns.items()]))
    name = F.concat(F.lit("CIK"), cik10("cik"), F.lit("-submissions-"), F.col("y"), F.lit(".json"))
    return per.select("cik", page.alias("json"), F.struct(name.alias("name"), F.size("o").alias("filingCount"), day("a").alias("filingFrom"), day("z").alias("filingTo")).alias("entry"))


@query("filings_paged", f"WITH {_PAGES} SELECT {_CIK.replace('cik', 'p.cik')} AS cik, accession, form, filing_date, report_date, coalesce(primary_document, '') AS primary_document, coalesce(is_xbrl, false) AS is_xbrl FROM p WHERE report_date IS NOT NULL")
def filings_paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return js.page_filings(_submission_pages(spark, sf_dir).select("cik", "json"))


@query("pages_listed", f"WITH {_PAGES} SELECT {_CIK.replace('cik', 'p.cik')} AS cik, 'CIK' || {_CIK.replace('cik', 'p.cik')} || '-submissions-' || y || '.json' AS name, CAST(count(*) AS INTEGER) AS n_filings, min(filing_date) AS first_filed, max(filing_date) AS last_filed FROM p GROUP BY p.cik, y")
def pages_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _submission_pages(spark, sf_dir).groupBy("cik").agg(F.collect_list("entry").alias("files"))
    return js.older_pages(files.select(F.to_json(F.struct("cik", F.struct("files").alias("filings"))).alias("json")))


def _landed(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a file for each company, its notes and an unfinished one beside it."""
    folder = scratch(spark, "landing").removeprefix("file:")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cik, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                tb.keep_answer(f"{folder}/submissions/CIK{cik}.json", iter([text.encode()]), url=f"made up/{cik}")
                with open(f"{folder}/submissions/CIK{cik}x.json.partial", "w") as f:
                    f.write("half")
            yield b.select(["cik"])

    from tidemark.session import ship

    ship(spark)
    rows = _registry(spark, sf_dir).select("cik", F.coalesce("company_name", F.lit("none")).alias("text"))
    rows.mapInArrow(write, "cik string").write.format("noop").mode("overwrite").save()
    return folder


@query("landing_counted", "SELECT count(*) AS n, CAST(sum(strlen(coalesce(company_name, 'none'))) AS BIGINT) AS bytes FROM companies")
def landing_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in a landing folder; notes and unfinished files do not count."""
    return urls.landing_stats(spark, _landed(spark, sf_dir)).select("n", "bytes")


@query("landing_read", f"SELECT 'CIK' || {_CIK} || '.json' AS name, coalesce(company_name, 'none') AS text FROM companies")
def landing_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole files of a folder with their names."""
    files = js.text_files(spark, f"{_landed(spark, sf_dir)}/submissions")
    return files.where(F.col("name").rlike(r"^CIK\d{10}\.json$")).select("name", "text")


_JOINED = "j AS (SELECT accession, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY row_id) AS text, count(*) AS n FROM manifest WHERE accession IS NOT NULL GROUP BY accession)"


def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings whose documents are the rows of the manifest."""
    rows = table(spark, sf_dir, "manifest").where("accession IS NOT NULL")
    return js.filing_texts(rows.select("accession", F.col("row_id").alias("part_no"), F.coalesce("document_name", F.lit("")).alias("name"), "text"))


@query("filings_joined", f"WITH {_JOINED} SELECT accession, sha256(text) AS sha, CAST(n AS INTEGER) AS n_parts, CAST(length(text) AS BIGINT) AS last_end FROM j")
def filings_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _joined(spark, sf_dir)
    return rows.select("accession", ma.digest(F.col("text")).alias("sha"), F.size("parts").alias("n_parts"), F.element_at("parts", -1)["end"].alias("last_end"))


@query(
    "offsets_placed",
    """WITH p AS (SELECT accession, row_id, length(coalesce(text, '')) AS n, sum(length(coalesce(text, '')) + 2) OVER (PARTITION BY accession ORDER BY row_id) AS after FROM manifest WHERE accession IS NOT NULL)
    SELECT accession, row_id, after - 2 - n + n // 2 AS pos, row_id AS part FROM p WHERE n > 0""",
)
def offsets_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In which document of a filing an offset lies: asked for the middle of each document."""
    from tidemark.operators.text.locate import part_at

    rows = table(spark, sf_dir, "manifest").where("accession IS NOT NULL").select("accession", F.col("row_id").alias("part_no"), F.col("row_id").cast("string").alias("name"), "text")
    filings = js.filing_texts(rows).select("accession", "parts")

    def place(accession: str, parts: list[dict]) -> Iterator[tuple]:
        spans = [(p["name"], p["start"], p["end"]) for p in parts]
        for name, a, z in spans:
            if z > a:
                pos = a + (z - a) // 2
                yield accession, int(name), pos, int(part_at(spans, pos))

    return ke.rows_of(filings, place, "accession string, row_id bigint, pos bigint, part bigint")


@query("exhibits_listed", "SELECT accession, filing_date, 'ex' || accession || '.htm' AS exhibit FROM filings WHERE is_xbrl AND accession IS NOT NULL AND form IS NOT NULL")
def exhibits_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annual reports that the HTML index of a filing names; the index is made of the filing's own row, an exhibit 13 for those with tagged data."""
    cells = lambda *c: F.concat(F.lit("<tr>"), *[x for v in c for x in (F.lit("<td>"), v, F.lit("</td>"))], F.lit("</tr>"))
    kind = F.when(F.col("is_xbrl"), F.lit("EX-13.1")).otherwise(F.lit("EX-99"))
    page = F.concat(
        F.lit("<p>Index</p><table class='tableFile'><tr><th>Seq</th><th>Document</th><th>Type</th></tr>"),
        cells(F.lit("1"), F.concat(F.coalesce("primary_document", F.lit("main.htm")), F.lit(" iXBRL")), F.col("form")),
        cells(F.lit("2"), F.concat(F.lit("<a href='#'>ex"), F.col("accession"), F.lit(".htm</a>")), kind),
        F.lit("</table>"),
    )
    rows = table(spark, sf_dir, "filings").where("accession IS NOT NULL AND form IS NOT NULL").select("accession", "filing_date", page.alias("html"))
    return ke.rows_of(rows, lambda a, d, html: [(a, d, e) for e in markup_text.exhibit_names(html)], "accession string, filing_date date, exhibit string")


@query(
    "html_rendered",
    """WITH r AS (SELECT cik, accession, count(*) + 1 AS n FROM filings WHERE accession IS NOT NULL GROUP BY cik, accession)
    SELECT cik, accession, 'Report ' || accession || chr(10) || 'R&D rose < 5 %' || chr(10) || 'Item 7. Results' || chr(10) || chr(10)
      || CASE WHEN n >= 3 THEN '[TABLE: ' || n || ' rows x 2 cols]' ELSE array_to_string(list_transform(range(n), lambda i: '1,234' || chr(10) || '(56)'), chr(10) || chr(10)) END
      || chr(10) || chr(10) || 'The end' AS text FROM r""",
)
def html_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page made of each filing's row, with scripts, references, a layout table and one of figures, as text."""
    rows = table(spark, sf_dir, "filings").where("accession IS NOT NULL").groupBy("cik", "accession").agg((F.count(F.lit(1)) + 1).cast("int").alias("n"))
    page = F.concat(
        F.lit("<html><head><style>p {x: 1}</style><script>if (a < b) c()</script></head><body><h1>Report "), F.col("accession"), F.lit("</h1><p>R&amp;D   rose &lt; 5&#160;%</p><table><tr><td>Item&nbsp;7. Results</td></tr></table>"),
        F.lit("<table>"), F.repeat(F.lit("<tr><td>1,234</td><td>(56)</td></tr>"), F.col("n")), F.lit("</table><p>The end"),
    )
    return ke.rows_of(rows.select("cik", "accession", page.alias("html")), lambda c, a, html: [(c, a, markup_text.text_of(html))], "cik string, accession string, text string")


@query("concepts_configured", "SELECT concept, concept_label, applies_to, unit, period_type, tag_rank, tag FROM concepts")
def concepts_configured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The concepts as a file of the registry, read and checked."""
    import yaml

    rows = table(spark, sf_dir, "concepts").orderBy("concept", "tag_rank").collect()  # 16 rows at every size
    concepts: dict[str, dict] = {}
    for r in rows:
        one = concepts.setdefault(r["concept"], {"label": r["concept_label"], "applies_to": r["applies_to"], "unit": r["unit"], "period_type": r["period_type"], "rule": "first_available", "candidates": []})
        one["candidates"].append(r["tag"])
    path = scratch(spark, "concepts").removeprefix("file:") + ".yaml"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        yaml.safe_dump({"concepts": concepts}, f)
    return cf.read_concepts(spark, path)


@query("inputs_embedded", f"WITH {_CHUNKS} SELECT DISTINCT digest, true AS of_unit_length FROM k WHERE trim(text) <> '' AND digest IS NOT NULL")
def inputs_embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cache lacks is encoded, each input once, in two shares; a second run finds nothing to do."""
    from tidemark.functions.vectors import norm

    inputs = _chunks(spark, sf_dir).where("trim(text) <> '' AND digest IS NOT NULL").select("digest", "text")
    cache = tb.VectorCache(spark, scratch(spark, "vectors"), "hashing", 64)
    tb.embed_missing(inputs, cache, tb.hashing_encoder(), rounds=2, longest=1 << 31)  # hashing takes texts of any length
    if tb.embed_missing(inputs, cache, tb.hashing_encoder()):
        raise AssertionError("inputs were left")
    return cache.load(inputs).select("digest", (F.abs(norm("vector") - 1) < 1e-3).alias("of_unit_length"))


@query("index_stored", f"WITH {_CHUNKS} SELECT chunk_id, ticker, true AS has_vector, true AS has_length FROM k WHERE digest IS NOT NULL")
def index_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A version of an index, built and opened; one vector stands for all texts here."""
    rows = _chunks(spark, sf_dir).where("digest IS NOT NULL").withColumn("model", F.lit("one"))
    vectors = rows.select("digest").distinct().withColumn("vector", F.array(F.lit(1.0).cast("float"), F.lit(0.0).cast("float")))
    path = scratch(spark, "index")
    tb.build_index(rows, vectors, path)
    chunks, index = tb.open_index(spark, path)
    both = chunks.join(index.lengths.select(F.col("id").alias("chunk_id"), "dl"), "chunk_id", "left")
    return both.select("chunk_id", "ticker", (F.size("vector") == 2).alias("has_vector"), F.col("dl").isNotNull().alias("has_length"))


@query(
    "results_stored",
    """SELECT CAST(question_id AS VARCHAR) AS question, retriever AS strategy, CAST(CAST(count(DISTINCT ticker) AS INTEGER) AS VARCHAR) AS issuers_10, array_to_string(list_sort(list(DISTINCT lpad(CAST(row_id AS VARCHAR), 12, '0'))), ' ') AS hits
    FROM hits WHERE question_id IS NOT NULL AND retriever IS NOT NULL AND row_id IS NOT NULL GROUP BY question_id, retriever""",
)
def results_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results as CSV with the columns of the evaluation, read again."""
    rows = table(spark, sf_dir, "hits").where("question_id IS NOT NULL AND retriever IS NOT NULL AND row_id IS NOT NULL")
    rows = rows.groupBy(F.col("question_id").cast("string").alias("question"), F.col("retriever").alias("strategy")).agg(
        F.countDistinct("ticker").cast("int").alias("issuers_10"), F.sort_array(F.collect_set(F.lpad(F.col("row_id").cast("string"), 12, "0"))).alias("hits")
    )
    filled = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in schemas.EVAL_COLUMNS])
    path = scratch(spark, "results")
    tb.write_results(filled, path)
    return spark.read.option("header", True).csv(path).select("question", "strategy", "issuers_10", "hits")


@query("searched", f"SELECT vec_id, round(1 + {_DOT}, 6) AS score, CAST(row_number() OVER (ORDER BY {_DOT} DESC, vec_id) AS INTEGER) AS rank FROM embeddings WHERE label IN (1, 2) ORDER BY {_DOT} DESC, vec_id LIMIT 10")
def searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question through the entry point, by vectors within a filter."""
    found = se.search("vector", vectors=table(spark, sf_dir, "embeddings"), encode=lambda _: _Q, question="any", k=10, where=F.col("label").isin(1, 2), id_col="vec_id")
    return found.select("vec_id", F.round("score", 6).alias("score"), "rank")


@query("rechecked_grades", "SELECT question_id, row_id, min(grade) AS grade, 'judgment' AS origin, max(grade) AS regrade FROM judgments WHERE grade IS NOT NULL GROUP BY question_id, row_id")
def rechecked_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first grade of each passage beside its last; the grade stands for the order of judging here."""
    rows = table(spark, sf_dir, "judgments").where("grade IS NOT NULL")
    entries = rows.select("question_id", "row_id", "grade", F.lit("judgment").alias("origin"), F.col("grade").alias("entry_no"))
    again = rows.groupBy("question_id", "row_id").agg(F.max("grade").alias("regrade"))
    return ad.rechecked(entries, again, ["question_id", "row_id"])


@query(
    "passages_narrowed",
    """WITH p AS (SELECT row_id, char_start, text, strpos(lower(text), 'loan') AS s FROM manifest WHERE strpos(lower(text), 'loan') > 0 AND char_start IS NOT NULL),
    q AS (SELECT *, s - 1 - length(regexp_extract(left(text, s - 1), '[^\n]*\\z')) AS a, s - 1 + length(regexp_extract(substring(text, s), '\\A[^\n]*')) AS z FROM p),
    r AS (SELECT *, CASE WHEN z - a > 2000 THEN greatest(a, s - 1 - 998) ELSE a END AS low FROM q)
    SELECT row_id, char_start + low AS passage_start, char_start + CASE WHEN z - a > 2000 THEN greatest(s + 3, least(z, low + 2000)) ELSE z END AS passage_end FROM r""".replace("\\\\", "\\"),
)
def passages_narrowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line of each chunk that has a word, as offsets of its filing."""
    rows = spread(table(spark, sf_dir, "manifest")).where("char_start IS NOT NULL AND text IS NOT NULL").select("row_id", "char_start", "text")

    def find(row_id: int, start: int, text: str) -> Iterator[tuple]:
        if found := passages.narrow(text, start, "loan"):
            yield row_id, *found

    return ke.rows_of(rows, find, "row_id bigint, passage_start bigint, passage_end bigint")


@query("questions_split", "SELECT DISTINCT question_id, 'dev' AS split FROM hits WHERE question_id IN (SELECT question_id FROM judgments)")
def questions_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions of one split; those without any judgment count as blind here."""
    judged = table(spark, sf_dir, "judgments").select("question_id").distinct().withColumn("split", F.lit("dev"))
    questions = table(spark, sf_dir, "hits").where("question_id IS NOT NULL").select("question_id").distinct().join(judged, "question_id", "left")
    return ev.of_split(questions.withColumn("split", F.coalesce("split", F.lit("blind"))), "dev")
