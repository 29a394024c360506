"""Texts, chunks, ranges and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import adjudicate as ad
from tidemark.operators import intervals as iv
from tidemark.operators import kernels as ke
from tidemark.operators import manifest as ma
from tidemark.operators.text.locate import INCORPORATION
from tidemark.plans.registry import Registry, table
from tidemark.session import spread
from tidemark.plans.retrieval_queries import _EVAL, _hits, _spans

query = Registry()

_ITEMSQL = "['1','1A','1B','1C','2','3','4','5','6','7','7A','8','9','9A','9B','10','11','12','13','14','15','16']"
_TITLESQL = "MAP {" + ", ".join(f"'{k}': '{v.replace(chr(39), chr(39) * 2)}'" for k, v in ma.TITLES.items()) + "}"
_LABELS = f"array_to_string(list_transform(items, lambda i: 'Item ' || i || coalesce('. ' || {_TITLESQL}[i], '')), '; ')"
_PREFIX = f"""concat_ws(' · ', coalesce(c.company_name, m.ticker) || ' (' || m.ticker || ')', form, 'period ending ' || strftime(period_end, '%Y-%m-%d'), CASE WHEN len(items) > 0 THEN {_LABELS} ELSE 'full document' END)"""


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All manifest rows with their prefix: a company without a name goes by its ticker, and what a row lacks is left out of the prefix."""
    names = table(spark, sf_dir, "companies").select("ticker", "company_name")
    rows = table(spark, sf_dir, "manifest").join(names, "ticker", "left").withColumn("company_name", F.coalesce("company_name", "ticker"))
    return rows.withColumn("prefix", ma.contextual_prefix(*[F.col(c) for c in ("company_name", "ticker", "form", "period_end", "items")]))


_NAMED = "FROM manifest m LEFT JOIN companies c USING (ticker)"


@query("contextual_prefix", f"SELECT row_id, {_PREFIX} AS prefix, form || CASE WHEN len(items) > 0 THEN ' > ' || {_LABELS} ELSE '' END AS path, accession || ':' || char_start AS id {_NAMED}")
def contextual_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _named(spark, sf_dir)
    return rows.select("row_id", "prefix", ma.section_path(F.col("form"), F.col("items")).alias("path"), ma.chunk_id(F.col("accession"), F.col("char_start")).alias("id"))


@query("embedding_digest", f"SELECT row_id, sha256('search_document: ' || {_PREFIX} || chr(10) || chr(10) || text) AS digest {_NAMED}")
def embedding_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir).select("row_id", ma.digest(ma.embedding_input(F.col("prefix"), F.col("text"))).alias("digest"))


@query("text_hash", "SELECT doc_id, sha256(text) AS text_sha256, CAST(floor(length(text) / 4) AS BIGINT) AS tokens FROM documents")
def text_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", ma.digest(F.col("text")).alias("text_sha256"), ma.estimated_tokens(F.col("text")).alias("tokens"))


@query(
    "token_quantiles",
    """WITH t AS (SELECT list(CAST(floor(length(text) / 4) AS BIGINT) ORDER BY length(text)) AS v FROM manifest WHERE text IS NOT NULL)
    SELECT s AS share, v[CAST(floor(len(v) * s) AS BIGINT) + 1] AS value FROM t, (SELECT unnest([0.5::DOUBLE, 0.95::DOUBLE]) AS s)""",
)
def token_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ma.exact_quantiles(table(spark, sf_dir, "manifest"), ma.estimated_tokens(F.col("text")), [0.5, 0.95])


@query("snippets", r"SELECT row_id, left(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')), 100) AS snippet FROM manifest")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "manifest").select("row_id", ma.snippet(F.col("text")).alias("snippet"))


@query("repeated_chunk_ids", "SELECT chunk_id, count(*) AS n FROM manifest GROUP BY chunk_id HAVING count(*) > 1")
def repeated_chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ma.repeated_keys(table(spark, sf_dir, "manifest"), "chunk_id")


def _cached(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Manifest rows and a cache that has the vectors of some of them, under the row's digest."""
    rows = table(spark, sf_dir, "manifest")
    keys = rows.select("row_id", "digest")
    vectors = table(spark, sf_dir, "embeddings").join(keys, F.col("vec_id") == F.col("row_id")).groupBy("digest").agg(F.min_by(F.col("embedding"), F.col("vec_id")).alias("vector"))
    return rows, vectors


_CACHED = "v AS (SELECT m.digest, arg_min(e.embedding, e.vec_id) AS vector FROM embeddings e JOIN manifest m ON e.vec_id = m.row_id WHERE m.digest IS NOT NULL GROUP BY m.digest)"


@query("missing_vectors", f"WITH {_CACHED} SELECT DISTINCT digest FROM manifest WHERE digest IS NOT NULL AND digest NOT IN (SELECT digest FROM v)")
def missing_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ma.missing_vectors(*_cached(spark, sf_dir))


@query("manifest_with_vectors", f"WITH {_CACHED} SELECT row_id, model, len(vector) AS width, round(vector[1], 6) AS x0 FROM manifest JOIN v USING (digest)")
def manifest_with_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, vectors = _cached(spark, sf_dir)
    return rows.join(vectors, "digest").select("row_id", "model", F.size("vector").cast("bigint").alias("width"), F.round(F.col("vector")[0], 6).alias("x0"))


@query(
    "index_gates",
    f"""WITH {_CACHED} SELECT 'models' AS problem, count(DISTINCT model) AS n FROM manifest HAVING count(DISTINCT model) > 1
    UNION ALL SELECT 'missing', count(DISTINCT digest) FROM manifest WHERE digest NOT IN (SELECT digest FROM v) HAVING count(*) > 0
    UNION ALL SELECT 'norm', count(*) FROM v WHERE abs(sqrt(list_dot_product(CAST(vector AS DOUBLE[]), CAST(vector AS DOUBLE[]))) - 1) > 0.001 HAVING count(*) > 0""",
)
def index_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ma.index_problems(*_cached(spark, sf_dir))


@query(
    "eval_vocabulary",
    """SELECT 'ticker' AS field, ticker AS value FROM manifest WHERE ticker IS NOT NULL UNION SELECT 'fiscal_year', CAST(fiscal_year AS VARCHAR) FROM manifest WHERE fiscal_year IS NOT NULL
    UNION SELECT 'item', unnest(items) FROM manifest""",
)
def eval_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ma.vocabulary(table(spark, sf_dir, "manifest"))


@query("filing_extent", "SELECT accession, max(char_end) AS extent, count(*) AS n_chunks FROM manifest GROUP BY accession")
def filing_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "manifest").groupBy("accession").agg(F.max("char_end").alias("extent"), F.count(F.lit(1)).alias("n_chunks"))


_SPANS = "s AS (SELECT accession, unnest(items) AS item, char_start AS a, char_end AS z FROM manifest WHERE char_end > char_start)"


@query(
    "segment_sweep",
    f"""WITH {_SPANS}, b AS (SELECT accession, a AS pos FROM s UNION SELECT accession, z FROM s), i AS (SELECT accession, pos, lead(pos) OVER (PARTITION BY accession ORDER BY pos) AS nxt FROM b),
    c AS (SELECT i.accession, i.pos, i.nxt, list_sort(list(DISTINCT lpad(CAST(list_position({_ITEMSQL}, s.item) AS VARCHAR), 2, '0') || s.item)) AS k FROM i JOIN s ON s.accession = i.accession AND s.a <= i.pos AND i.nxt <= s.z GROUP BY ALL),
    d AS (SELECT *, CASE WHEN lag(nxt) OVER w = pos AND lag(k) OVER w = k THEN 0 ELSE 1 END AS new FROM c WINDOW w AS (PARTITION BY accession ORDER BY pos)),
    e AS (SELECT *, sum(new) OVER (PARTITION BY accession ORDER BY pos) AS run FROM d)
    SELECT accession, min(pos) AS start, max(nxt) AS "end", array_to_string(list_transform(first(k), lambda x: x[3:]), ' ') AS items FROM e GROUP BY accession, run""",
)
def segment_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = table(spark, sf_dir, "manifest").select("accession", F.explode("items").alias("item"), F.col("char_start").alias("span_start"), F.col("char_end").alias("span_end"))
    return iv.segments(spans).withColumn("items", F.array_join("items", " "))


@query(
    "interval_subtract",
    """WITH w AS (SELECT accession, CAST(0 AS BIGINT) AS lo, max(char_end) + 100 AS hi FROM manifest GROUP BY accession),
    h AS (SELECT m.accession, greatest(char_start, lo) AS a, least(char_end, hi) AS z FROM manifest m JOIN w USING (accession) WHERE char_end > char_start UNION ALL SELECT accession, lo, lo FROM w UNION ALL SELECT accession, hi, hi FROM w),
    r AS (SELECT accession, max(z) OVER (PARTITION BY accession ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS reach, lead(a) OVER (PARTITION BY accession ORDER BY a, z) AS nxt FROM h)
    SELECT accession, reach AS start, nxt AS "end" FROM r WHERE nxt > reach""",
)
def interval_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of each filing no chunk covers."""
    rows = table(spark, sf_dir, "manifest")
    wholes = rows.groupBy("accession").agg(F.lit(0).cast("bigint").alias("char_start"), (F.max("char_end") + 100).alias("char_end"))
    return iv.uncovered(wholes, rows, by="accession", start="char_start", end="char_end")


@query(
    "dense_runs",
    """WITH e AS (SELECT event_id, user_id, epoch(ts) AS tt, value FROM events), g AS (SELECT *, CASE WHEN tt - lag(tt) OVER w > 86400 OR value <= lag(value) OVER w OR lag(event_id) OVER w IS NULL THEN 1
      WHEN (tt - lag(tt) OVER w > 86400 OR value <= lag(value) OVER w) IS NULL THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY tt, event_id)),
    r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY tt, event_id ROWS UNBOUNDED PRECEDING) AS run_no FROM g)
    SELECT event_id, user_id, CAST(run_no AS BIGINT) AS run_no, count(*) OVER (PARTITION BY user_id, run_no) AS run_size FROM r""",
)
def dense_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of close, ascending events, as headings stand in a table of contents."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value").withColumn("at", F.col("us") / 1e6)
    return iv.runs(events, by=["user_id"], at="at", rank="value", max_gap=86400, tie="event_id").select("event_id", "user_id", "run_no", "run_size")


@query("section_ends", "SELECT row_id, coalesce(lead(char_start) OVER (PARTITION BY accession ORDER BY char_start, row_id), max(char_end) OVER (PARTITION BY accession)) AS until FROM manifest")
def section_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "manifest").withColumn("extent", F.max("char_end").over(Window.partitionBy("accession")))
    return iv.until_next(rows, by=["accession"], at="char_start", tie="row_id", last=F.col("extent")).select("row_id", "until")


@query(
    "running_titles",
    r"""WITH l AS (SELECT row_id, unnest(string_split(text, chr(10))) AS line FROM manifest), t AS (SELECT trim(regexp_extract(line, '^[ \t]*([0-9]{1,4}[ \t]+)?([^0-9\s].{2,80}?)([ \t]+[0-9]{1,4})?[ \t]*\z', 2)) AS title FROM l
      WHERE regexp_matches(line, '^[ \t]*[0-9]{1,4}[ \t]+[^0-9\s].{2,80}\z') OR regexp_matches(line, '^[ \t]*[^0-9\s].{2,80}[ \t][0-9]{1,4}[ \t]*\z'))
    SELECT title, count(*) AS n FROM t WHERE title <> '' GROUP BY title HAVING count(*) >= 10""",
)
def running_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that recur beside a number."""
    lines = table(spark, sf_dir, "manifest").select(F.explode(F.split("text", "\n")).alias("line"))
    beside = lines.where(F.col("line").rlike(r"(?d)^[ \t]*[0-9]{1,4}[ \t]+[^0-9\s].{2,80}\z") | F.col("line").rlike(r"(?d)^[ \t]*[^0-9\s].{2,80}[ \t][0-9]{1,4}[ \t]*\z"))
    title = F.trim(F.regexp_extract("line", r"(?d)^[ \t]*([0-9]{1,4}[ \t]+)?([^0-9\s].{2,80}?)([ \t]+[0-9]{1,4})?[ \t]*\z", 2))
    return beside.select(title.alias("title")).where("title <> ''").groupBy("title").agg(F.count(F.lit(1)).alias("n")).where("n >= 10")


@query("html_normalized")
def html_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ke.normalized(spread(table(spark, sf_dir, "documents")).select("doc_id", F.col("text").alias("html")), id_col="doc_id")


# Headings with their places; runs of five or more close, ascending ones are contents; of the rest the longest chain in the order of the
# items, found step by step from the lists of what was found before.
_SECTIONS = rf"""
h1 AS (SELECT doc_id, length(text) AS n, regexp_extract_all(text, '(?ism).*?^[ \t]*Item[ \t]+\d{{1,2}}[A-C]?[ \t]*[.—–:-]?[ \t]*') AS parts FROM documents),
h2 AS (SELECT doc_id, n, unnest(parts) AS part, unnest(range(1, len(parts) + 1)) AS i FROM h1),
h3 AS (SELECT doc_id, n, i, CAST(sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS body, length(regexp_extract(part, '(?ism)^[ \t]*Item[ \t]+\d{{1,2}}[A-C]?[ \t]*[.—–:-]?[ \t]*\z')) AS wide,
        upper(regexp_extract(part, '(?ism)^[ \t]*Item[ \t]+(\d{{1,2}}[A-C]?)[ \t]*[.—–:-]?[ \t]*\z', 1)) AS item FROM h2),
h4 AS (SELECT *, body - wide AS heading, list_position({_ITEMSQL}, item) AS rank FROM h3 WHERE list_contains({_ITEMSQL}, item)),
h5 AS (SELECT *, CASE WHEN heading - lag(heading) OVER w <= 300 AND rank > lag(rank) OVER w THEN 0 ELSE 1 END AS new FROM h4 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
h6 AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM h5),
h7 AS (SELECT * FROM h6 QUALIFY count(*) OVER (PARTITION BY doc_id, run) < 5),
h8 AS MATERIALIZED (SELECT doc_id, n, list({{'item': item, 'rank': rank, 'heading': heading, 'body': body}} ORDER BY i) AS h FROM h7 GROUP BY doc_id, n),
c AS (SELECT doc_id, 0 AS k, CAST([] AS BIGINT[]) AS long, CAST([] AS BIGINT[]) AS back FROM h8
      UNION ALL
      SELECT doc_id, k + 1, list_append(long, coalesce(best // 1000, 0) + 1), list_append(back, CASE WHEN best IS NULL THEN 0 ELSE 999 - best % 1000 END)
      FROM (SELECT c.*, list_max(list_transform(list_filter(range(1, k + 1), lambda j: h[j].rank < h[k + 1].rank), lambda j: long[j] * 1000 + 999 - j)) AS best, len(h) AS total
            FROM c JOIN h8 USING (doc_id)) WHERE k < total),
e AS (SELECT doc_id, long, back, list_max(list_transform(range(1, k + 1), lambda j: long[j] * 1000 + 999 - j)) AS best FROM c QUALIFY k = max(k) OVER (PARTITION BY doc_id) AND k > 0),
f AS (SELECT doc_id, back, 999 - best % 1000 AS pos FROM e UNION ALL SELECT doc_id, back, back[pos] FROM f WHERE back[pos] > 0),
sections AS MATERIALIZED (SELECT doc_id, h[pos].item AS item, 'item_heading' AS strategy, h[pos].heading AS heading_start, 0 AS span_no, h[pos].body AS span_start,
        coalesce(lead(h[pos].heading) OVER (PARTITION BY doc_id ORDER BY pos), n) AS span_end FROM f JOIN h8 USING (doc_id))"""


@query("sections_located", f"WITH RECURSIVE {_SECTIONS} SELECT * FROM sections")
def sections_located(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ke.located(spread(table(spark, sf_dir, "documents")).select("doc_id", "text"), id_col="doc_id")


# White space as the kernels see it, spelled out as this dialect's does not know all of it. Each part that is taken out reaches to the
# end of a match, so ends are running sums of lengths.
_WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_BREAKS = rf"""
d AS MATERIALIZED (SELECT doc_id, text FROM documents WHERE text IS NOT NULL),
l1 AS (SELECT doc_id, regexp_extract_all(text, '(?s).*?\n') AS parts FROM d),
l2 AS (SELECT doc_id, unnest(parts) AS part, unnest(range(1, len(parts) + 1)) AS i FROM l1),
l3 AS (SELECT doc_id, i, part, CAST(sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS p FROM l2),
s1 AS (SELECT doc_id, regexp_extract_all(text, '(?s).*?[.!?][{_WS}]+') AS parts FROM d),
s2 AS (SELECT doc_id, unnest(parts) AS part, unnest(range(1, len(parts) + 1)) AS i FROM s1),
s3 AS (SELECT doc_id, CAST(sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS e, length(regexp_extract(part, '[{_WS}]+\z')) AS n FROM s2),
b1 AS (SELECT doc_id, list(p ORDER BY p) AS ls, list({{'p': p, 'q': p - length(part) - 1}} ORDER BY p) FILTER (i > 1 AND regexp_full_match(part, '[{_WS}]*')) AS ps FROM l3 GROUP BY doc_id),
b2 AS (SELECT doc_id, list({{'s': e - n, 'e': e}} ORDER BY e) AS ss FROM s3 GROUP BY doc_id),
b AS MATERIALIZED (SELECT d.doc_id, text, ls, ps, ss FROM d LEFT JOIN b1 USING (doc_id) LEFT JOIN b2 USING (doc_id))"""


def _stop(start: str, end: str) -> str:
    """Where a window from ``start`` ends: the last end of a paragraph, else of a line, else of a sentence in its second half."""
    low, high = f"({start} + 1600)", f"({start} + 3200)"
    p, s = f"list_filter(ps, lambda x: x.p <= {high})[-1]", f"list_filter(ss, lambda x: x.s < {high})[-1]"
    line = f"list_filter(ls, lambda x: x <= {high})[-1]"
    return f"""CASE WHEN {end} - {start} <= 3200 THEN {end} ELSE coalesce(CASE WHEN {p}.q >= {low} THEN {p}.p END, CASE WHEN {line} > {low} THEN {line} END,
      CASE WHEN {s}.s > {low} THEN least({s}.e, {high}) END, {high}) END"""


def _windows(segments: str) -> str:
    """Chunks of the ranges (``doc_id``, ``a``, ``z``, ``items``) of a query."""
    return f"""g AS MATERIALIZED ({segments}),
    r AS (SELECT doc_id, items, z, a AS start, {_stop("a", "z")} AS stop FROM g JOIN b USING (doc_id) WHERE a < z
          UNION ALL SELECT doc_id, items, z, stop - 480, {_stop("(stop - 480)", "z")} FROM r JOIN b USING (doc_id) WHERE stop < z)
    SELECT doc_id, items, start AS char_start, stop AS char_end, substring(text, start + 1, stop - start) AS text FROM r JOIN b USING (doc_id) WHERE stop - start >= 200"""


@query("chunks_fixed", f"WITH RECURSIVE {_BREAKS}, {_windows("SELECT doc_id, CAST(0 AS BIGINT) AS a, length(text) AS z, '' AS items FROM d")}")
def chunks_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", "text")
    return ke.fixed_windows(docs, id_col="doc_id").withColumn("items", F.array_join("items", " "))


@query("chunks_item_aware", f"WITH RECURSIVE {_SECTIONS}, {_BREAKS}, {_windows("SELECT doc_id, span_start AS a, span_end AS z, item AS items FROM sections WHERE span_start < span_end")}")
def chunks_item_aware(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", "text")
    chunks = ke.item_aware(docs, iv.segments(ke.located(docs, id_col="doc_id"), by="doc_id"), id_col="doc_id")
    return chunks.withColumn("items", F.array_join("items", " "))


_PHRASE = "credit losses"


_PASSAGES = rf"""{_BREAKS}, m1 AS (SELECT doc_id, regexp_extract_all(text, '(?is).*?{_PHRASE}') AS parts FROM d),
    m2 AS (SELECT doc_id, unnest(parts) AS part, unnest(range(1, len(parts) + 1)) AS i FROM m1),
    m3 AS (SELECT doc_id, i, CAST(sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS e FROM m2),
    m4 AS (SELECT doc_id, i, text, e - {len(_PHRASE)} AS s, e, coalesce(list_filter(ls, lambda x: x <= e - {len(_PHRASE)})[-1], 0) AS a, coalesce(list_filter(ls, lambda x: x > e)[1] - 1, length(text)) AS z FROM m3 JOIN b USING (doc_id)),
    m5 AS (SELECT *, CASE WHEN z - a > 2000 THEN greatest(a, s - {(2000 - len(_PHRASE)) // 2}) ELSE a END AS low FROM m4),
    m6 AS (SELECT doc_id, any_value(text) AS text, low, CASE WHEN z - a > 2000 THEN greatest(e, least(z, low + 2000)) ELSE z END AS high, min(i) AS i FROM m5 GROUP BY doc_id, low, high),
    m7 AS (SELECT *, trim(regexp_replace(substring(text, low + 1, high - low), '[{_WS}]+', ' ', 'g')) AS flat FROM m6 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) <= 10),
    passages AS (SELECT doc_id, low AS char_start, high AS char_end, CASE WHEN length(flat) <= 90 THEN flat ELSE substring(flat, 1, 87) || '...' END AS quote FROM m7)"""


@query("gold_entries", f"WITH {_PASSAGES} SELECT doc_id, char_start, char_end, 2 AS grade, sha256(text) AS filing_sha256, quote, DATE '2026-01-01' AS labelled_on FROM passages JOIN documents USING (doc_id)")
def gold_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages of ``passages_found`` as entries of the file of questions."""
    return ad.gold_entries(passages_found(spark, sf_dir), table(spark, sf_dir, "documents"), day="2026-01-01", id_col="doc_id")


@query("passages_found", f"WITH {_PASSAGES} SELECT * FROM passages")
def passages_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ke.with_passages(spread(table(spark, sf_dir, "documents")), _PHRASE, id_col="doc_id")


@query(
    "parser_coverage",
    rf"""WITH RECURSIVE {_SECTIONS}, p AS (SELECT s.*, span_end - span_start AS size, regexp_matches(substring(text, span_start + 1, 400), '(?i){INCORPORATION.pattern}') AS stub FROM sections s JOIN documents USING (doc_id)),
    q AS (SELECT doc_id, list(item) FILTER (size >= 1000) AS found, list(item) FILTER (size < 1000 AND stub) AS elsewhere FROM p WHERE item IN ('1', '1A', '3', '7', '7A', '8', '9A') GROUP BY doc_id),
    t AS (SELECT d.doc_id, d.doc_id NOT IN (SELECT doc_id FROM sections) AS none, list_filter(['1A', '7', '9A'], lambda x: NOT list_contains(coalesce(found, []), x)) AS missing, coalesce(elsewhere, []) AS elsewhere
          FROM documents d LEFT JOIN q USING (doc_id))
    SELECT CASE WHEN none THEN 'none' ELSE 'item_heading' END AS strategy, CASE WHEN none THEN 'failed' WHEN missing = [] THEN 'located' ELSE 'partial' END AS state,
      CASE WHEN none THEN 'no headings and no page table' WHEN missing = [] THEN '' WHEN list_has_all(elsewhere, missing) THEN 'incorporated by reference' ELSE 'sections too short' END AS reason, count(*) AS n FROM t GROUP BY ALL""",
)
def parser_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", "text")
    return ad.parser_report(ad.parser_states(docs, ke.located(docs, id_col="doc_id"), id_col="doc_id"))


_UNJUDGED = "WITH " + _EVAL.removeprefix("WITH ")


@query("unjudged_hits", f"{_UNJUDGED} SELECT t.question_id, t.config, t.position, t.row_id FROM top t LEFT JOIN cov c USING (question_id, config, position) WHERE c.span_id IS NULL")
def unjudged_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.unjudged(_hits(spark, sf_dir), _spans(spark, sf_dir)).select("question_id", "config", F.col("position").cast("bigint").alias("position"), "row_id")


@query(
    "judging_pool",
    _UNJUDGED.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, u AS (SELECT t.* FROM top t LEFT JOIN cov c USING (question_id, config, position) WHERE c.span_id IS NULL),
    l AS (SELECT question_id, list({'row_id': row_id, 'accession': accession, 's': char_start, 'e': char_end} ORDER BY config, position) AS h FROM u GROUP BY question_id),
    r AS (SELECT question_id, 0 AS k, h[1:0] AS kept FROM l
          UNION ALL SELECT question_id, k + 1, CASE WHEN len(list_filter(kept, lambda x: x.accession = h[k + 1].accession
              AND least(x.e, h[k + 1].e) - greatest(x.s, h[k + 1].s) >= 0.5 * least(x.e - x.s, h[k + 1].e - h[k + 1].s))) = 0 THEN list_append(kept, h[k + 1]) ELSE kept END
          FROM r JOIN l USING (question_id) WHERE k < len(h)),
    o AS (SELECT question_id, unnest(kept) AS x FROM r QUALIFY k = max(k) OVER (PARTITION BY question_id))
    SELECT question_id, x.row_id AS row_id, x.accession AS accession, x.s AS char_start, x.e AS char_end FROM o""",
)
def judging_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who is in the pools; their order is a seeded shuffle, which SQL has not."""
    return ad.pool(_hits(spark, sf_dir), _spans(spark, sf_dir)).drop("place")


@query(
    "judging_sheets",
    f"""{_UNJUDGED}, u AS (SELECT DISTINCT t.question_id, t.row_id FROM top t LEFT JOIN cov c USING (question_id, config, position) WHERE c.span_id IS NULL)
    SELECT question_id, row_id, question_id || ': Question ' || question_id || chr(10) || coalesce(ticker, '?') || ' FY' || coalesce(CAST(fiscal_year AS VARCHAR), '?') || ' · items ' || CASE WHEN len(items) > 0 THEN array_to_string(items, ', ') ELSE 'unlabelled' END
      || ' · ' || coalesce(document_name, '?') || chr(10) || repeat('-', 72) || chr(10) || regexp_replace(coalesce(text, ''), '\\A[{_WS}]+|[{_WS}]+\\z', '', 'g') || chr(10) || repeat('-', 72) AS sheet FROM u JOIN manifest USING (row_id)""",
)
def judging_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a judge sees of each unjudged hit."""
    hits = ad.unjudged(_hits(spark, sf_dir), _spans(spark, sf_dir)).select("question_id", "row_id").distinct()
    questions = hits.select("question_id").distinct().withColumn("question", F.concat(F.lit("Question "), F.col("question_id").cast("string")))
    return ad.sheets(hits, questions, table(spark, sf_dir, "manifest"))


@query(
    "original_grades",
    """WITH a AS (SELECT question_id, row_id, grade, CASE WHEN row_id % 2 = 0 THEN 'gold' ELSE 'judgment' END AS origin, date_diff('day', DATE '2000-01-01', judged_on) * 10 + coalesce(grade, -1) + 1 AS entry_no FROM judgments)
    SELECT question_id, row_id, grade, origin FROM a QUALIFY row_number() OVER (PARTITION BY question_id, row_id ORDER BY origin = 'gold' DESC, CASE WHEN origin = 'gold' THEN -entry_no ELSE entry_no END) = 1""",
)
def original_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold before judgments, the last gold and the first judgment; rows with an even id stand for gold here, their day and grade for the order."""
    rows = table(spark, sf_dir, "judgments").withColumn("origin", F.when(F.col("row_id") % 2 == 0, "gold").otherwise("judgment"))
    rows = rows.withColumn("entry_no", F.datediff("judged_on", F.lit("2000-01-01").cast("date")) * 10 + F.coalesce("grade", F.lit(-1)) + 1)
    return ad.original_grades(rows, ["question_id", "row_id"]).select("question_id", "row_id", "grade", "origin")


@query(
    "recheck_sample",
    """WITH k AS (SELECT DISTINCT question_id, row_id FROM judgments WHERE grade IS NOT NULL)
    SELECT question_id, row_id FROM k QUALIFY row_number() OVER (ORDER BY md5('7:' || question_id || ':' || row_id), question_id, row_id) <= ceil(0.1::DOUBLE * (SELECT count(*) FROM k))""",
)
def recheck_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.recheck_sample(table(spark, sf_dir, "judgments").where("grade IS NOT NULL"), ["question_id", "row_id"], 0.1, 7)


@query("recent_judgments", "SELECT question_id, row_id, judged_on FROM judgments WHERE DATE '2026-10-20' - judged_on < 3")
def recent_judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that are too fresh on a day to be checked again."""
    return ad.recent(table(spark, sf_dir, "judgments"), "2026-10-20").select("question_id", "row_id", "judged_on")


@query("distinct_inputs", f"SELECT digest, count(*) AS n_chunks, max(tokens) AS tokens FROM (SELECT sha256('search_document: ' || {_PREFIX} || chr(10) || chr(10) || text) AS digest, CAST(floor(length(text) / 4) AS BIGINT) AS tokens {_NAMED}) GROUP BY digest")
def distinct_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a corpus comes to for the encoder: each different input once, with the chunks it stands for."""
    plan = ma.corpus_plan(_named(spark, sf_dir))
    return plan.groupBy("digest").agg(F.count(F.lit(1)).alias("n_chunks"), F.max(ma.estimated_tokens(F.col("text"))).alias("tokens"))
