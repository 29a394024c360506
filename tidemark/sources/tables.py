"""Tables on disk: partitioned facts, manifests, the vector cache, the search index and result files."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator, Sequence
from datetime import UTC, datetime
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import manifest as ma
from tidemark.operators.search import lexical_index
from tidemark.session import scratch, ship


#: Fixed value, by which tables on disk go: the companies of a year are dealt to so many folders.
SHARES = 16


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _put_facts(rows: DataFrame, path: str) -> None:
    """Rows are brought together by folder, but a large folder goes to as many tasks as its bytes need; companies are sorted in its files."""
    by = ["period_year", "share"]
    dealt = rows.withColumn("share", _share()).hint("rebalance", *by)
    ordered = dealt.sortWithinPartitions(*by, "cik", "tag", "period_end", "filed")
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _share() -> Column:
    return F.pmod(F.xxhash64("cik"), F.lit(SHARES)).cast("int").alias("share")


def write_facts(facts: DataFrame, path: str) -> None:
    """Replace exactly the companies and years that are in ``facts``; others stay. One writer at a time.

    A folder has one year of a share of the companies: with one for each company they would grow as the table. The other companies of a folder
    that is replaced are written again; ``facts`` is computed once, beside the table.
    """
    spark, columns = facts.sparkSession, schemas.names(schemas.FACTS)
    rows = facts.select(*columns)
    old = spark.read.schema(schemas.FACTS).parquet(path) if _exists(spark, path) else None
    if old is None or "share" not in old.columns:
        if old is not None and old.inputFiles():
            raise ValueError(f"{path} has a folder for each company, of an earlier version; facts are to be ingested into a new one")
        return _put_facts(rows, path)
    at = spark._jvm.org.apache.hadoop.fs.Path(scratch(spark, "facts-new"))
    try:
        rows.write.parquet(at.toString())
        new = spark.read.schema(rows.schema).parquet(at.toString())
        folders: dict[int | None, list[int]] = {}
        for year, share in new.select("period_year", _share()).distinct().collect():  # SHARES a year at most
            folders.setdefault(year, []).append(share)
        within = F.lit(False)
        for year, shares in folders.items():
            within |= F.col("period_year").eqNullSafe(year) & F.col("share").isin(shares)
        named = new.select(F.col("cik").alias("__cik"), F.col("period_year").alias("__year")).distinct()
        same = F.col("cik").eqNullSafe(F.col("__cik")) & F.col("period_year").eqNullSafe(F.col("__year"))
        _put_facts(new.unionByName(old.where(within).join(named, same, "left_anti").select(*columns)), path)
    finally:
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """With the schema given, so that keys keep their zeros."""
    return spark.read.schema(schemas.FACTS).parquet(path).select(*schemas.names(schemas.FACTS))


def write_manifest(rows: DataFrame, path: str) -> None:
    """Replace a manifest; a chunk id that occurs twice is an error, and nothing is written."""
    ma.assert_unique(rows, "chunk_id").select(*schemas.names(schemas.MANIFEST)).write.mode("overwrite").parquet(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MANIFEST).parquet(path)


def safe_name(*parts: str) -> str:
    """A table name for a chunker and a model."""
    return "-".join(re.sub(r"[^a-z0-9._-]+", "_", p.lower()) for p in parts)


class VectorCache:
    """Vectors by digest of what was embedded, only ever added to, one folder for each model and width."""

    def __init__(self, spark: SparkSession, root: str, model: str, width: int) -> None:
        self.spark, self.width = spark, width
        self.path = f"{root}/{safe_name(f'{model}@{width}')}"

    def read(self) -> DataFrame:
        if not _exists(self.spark, self.path):
            return self.spark.createDataFrame([], schemas.VECTORS)
        return self.spark.read.schema(schemas.VECTORS).parquet(self.path)

    def digests(self) -> DataFrame:
        return self.read().select("digest").distinct()

    def load(self, keys: DataFrame) -> DataFrame:
        """``digest``, ``vector`` of the wanted keys; the latest part counts."""
        wanted = self.read().join(keys.select("digest").distinct(), "digest", "left_semi")
        return wanted.groupBy("digest").agg(F.max_by("vector", "part_no").alias("vector"))

    def append(self, vectors: DataFrame, part_no: int) -> None:
        """Add vectors; one of another width is an error."""
        fits = F.when(F.size("vector") == self.width, F.col("vector")).otherwise(F.raise_error(F.lit(f"a vector is not {self.width} wide")).cast("array<float>"))
        vectors.select("digest", fits.alias("vector"), F.lit(part_no).alias("part_no")).write.mode("append").parquet(self.path)

    def stats(self) -> DataFrame:
        if not _exists(self.spark, self.path):
            return self.read().agg(F.count(F.lit(1)).alias("n"), F.lit(0).alias("files"), F.lit(0).cast("bigint").alias("bytes"))
        rows = self.read().select("_metadata.file_path", "_metadata.file_size")
        files = rows.groupBy("file_path").agg(F.count(F.lit(1)).alias("n"), F.max("file_size").alias("b"))
        return files.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("files"), F.sum("b").alias("bytes"))


Encode = Callable[[Sequence[str]], Sequence[Sequence[float]]]


def hashing_encoder(width: int = 64) -> Encode:
    """A deterministic encoder for tests: words hashed into a unit vector."""

    def encode(texts: Sequence[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * width
            for w in re.findall(r"\w+", t.lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % width] += 1.0 if h >> 32 & 1 else -1.0
            n = sum(x * x for x in v) ** 0.5
            out.append([x / n for x in v] if n else v)
        return out

    return encode


MAX_INPUT = 12_000


def embed_missing(inputs: DataFrame, cache: VectorCache, encode: Encode, *, rounds: int = 1, batch: int = 256, longest: int = MAX_INPUT) -> int:
    """Encode the inputs (``digest``, ``text``) that the cache lacks, each once, and add them; how many there were.

    ``rounds`` above 1 commits a share at a time, so that an interruption loses one share. Empty inputs and those over ``longest``, what the
    encoder takes, are errors.
    """
    ship(inputs.sparkSession)
    todo = inputs.dropDuplicates(["digest"]).join(cache.digests(), "digest", "left_anti")
    n = todo.count()
    latest = cache.read().agg(F.max("part_no")).first()[0]
    part = 0 if latest is None else latest + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                piece = b.slice(at, batch)
                texts = piece.column(1).to_pylist()
                if any(not (t or "").strip() or len(t) > longest for t in texts):
                    raise ValueError(f"an input is empty or longer than {longest} characters")
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(encode(texts), pa.list_(pa.float32()))], ["digest", "vector"])

    for r in range(rounds if n else 0):
        share = todo.where(F.pmod(F.xxhash64("digest"), F.lit(rounds)) == r)
        cache.append(share.select("digest", "text").mapInArrow(run, "digest string, vector array<float>"), part + r)
    return n


def _folders(spark: SparkSession, path: str) -> tuple[list[int], list[int]]:
    """The versions of an index that are there, and those that are complete."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
    there = sorted(int(n) for n in names if n.isdigit())
    return there, [n for n in there if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n:06d}/READY"))]


def build_index(manifest: DataFrame, vectors: DataFrame, path: str) -> int:
    """Write chunks with vectors, postings, lengths and frequencies as a new version of the index, after all gates are passed.

    A version counts only when all of it is written and its rows are counted: until then, and after a failure, the one before stays.
    """
    problems = ma.index_problems(manifest, vectors).collect()  # three rows at most
    if problems:
        raise ValueError("index not built: " + ", ".join(f"{r['problem']} ({r['n']})" for r in problems))
    ma.assert_unique(manifest, "chunk_id")
    spark = manifest.sparkSession
    new = f"{path}/{max(_folders(spark, path)[0], default=0) + 1:06d}"
    manifest.join(vectors, "digest").write.parquet(f"{new}/chunks")
    index = lexical_index(manifest, id_col="chunk_id", english=True)
    index.postings.hint("rebalance", "term").sortWithinPartitions("term").write.parquet(f"{new}/postings")
    index.lengths.write.parquet(f"{new}/lengths")
    spark.read.parquet(f"{new}/postings").groupBy("term").agg(F.count(F.lit(1)).alias("df")).write.parquet(f"{new}/frequencies")
    n, wanted = spark.read.parquet(f"{new}/chunks").count(), manifest.count()
    if n != wanted:
        raise ValueError(f"the index has {n} of {wanted} rows")
    ready = spark._jvm.org.apache.hadoop.fs.Path(f"{new}/READY")
    ready.getFileSystem(spark._jsc.hadoopConfiguration()).create(ready).close()
    return n


def open_index(spark: SparkSession, path: str):
    """The chunks of the latest complete version of an index, and its lexical part."""
    from tidemark.operators.search import LexicalIndex

    ready = _folders(spark, path)[1]
    if not ready:
        raise ValueError(f"no index in {path}")
    path = f"{path}/{ready[-1]:06d}"
    lengths = spark.read.parquet(f"{path}/lengths")
    totals = lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))
    return spark.read.parquet(f"{path}/chunks"), LexicalIndex(spark.read.parquet(f"{path}/postings"), lengths, spark.read.parquet(f"{path}/frequencies"), totals)


def write_results(results: DataFrame, path: str) -> None:
    """Evaluation results as CSV with the columns of ``schemas.EVAL_COLUMNS``; hits joined by blanks, nulls empty."""
    rows = results.withColumn("hits", F.array_join("hits", " ")).select(*schemas.EVAL_COLUMNS)
    rows.write.mode("overwrite").option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)


def keep_answer(path: str | Path, chunks: Iterator[bytes], *, url: str, status: int = 200, content_type: str = "", etag: str = "") -> dict:
    """Write a fetched answer in one step, with a note on where it is from."""
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    partial, h, n = p.with_name(p.name + ".partial"), hashlib.sha256(), 0
    with partial.open("wb") as f:
        for c in chunks:
            f.write(c), h.update(c)
            n += len(c)
    partial.replace(p)
    note = {"url": url, "fetched_at": datetime.now(UTC).isoformat(), "status": status, "content_type": content_type, "etag": etag, "bytes": n, "sha256": h.hexdigest()}
    p.with_name(p.name + ".meta.json").write_text(json.dumps(note))
    return note


def log_run(path: str | Path, entry: dict) -> int:
    """Add a line to a log of runs; how many earlier runs had the same ``config`` and ``split``."""
    p = Path(path)
    lines = [json.loads(x) for x in p.read_text().splitlines()] if p.exists() else []
    with p.open("a") as f:
        f.write(json.dumps(entry | {"at": datetime.now(UTC).isoformat()}) + "\n")
    return sum(all(x.get(k) == entry.get(k) for k in ("config", "split")) for x in lines)
