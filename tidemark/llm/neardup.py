"""Problem 6: near-duplicate records with small edits."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map
from tidemark.llm.components import components
from tidemark.plans.registry import Registry, table
from tidemark.session import checkpointed, spread

query = Registry()

#: A signature has CHUNKS x LENGTH minima of BITS bits. Any two within 2 x CHUNKS - 1 differing minima have, by the
#: pigeonhole principle, a chunk with at most one that differs; each chunk therefore enters the index once for each of its
#: minima left out. At a similarity of 0.7 a pair is missed with a probability of 0.0006, at 0.75 of 0.00005.
CHUNKS, LENGTH, BITS = 10, 5, 16
#: A pair goes to the exact check if so many of its 50 minima are equal; at a similarity of 0.7 fewer are with a
#: probability of 0.00006, at that of unrelated texts (0.1 and less) as many are never.
LEAST_EQUAL = 22
#: Ids up to this number (8 bytes each) are broadcast to the texts; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Exact copies of a text up to this number are unfolded into all pairs; of more each has a pair with the first copy of its own and of each linked text.
UNFOLDED = 64

_WORD = re.compile(r"[^\W_]+")
_rng = np.random.default_rng(20240229)
_A = (_rng.integers(0, 2**32, CHUNKS * LENGTH, dtype=np.uint32) | np.uint32(1))
_B = _rng.integers(0, 2**32, CHUNKS * LENGTH, dtype=np.uint32)
# Odd multipliers that mix the hashes of the words of a run.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class _WordHash(dict):
    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 1_000_000:
            self[word] = h
        return h


_hash = _WordHash()


def words_of(text: str) -> list[str]:
    """Lower-cased maximal runs of letters and digits."""
    return _WORD.findall(text.lower())


def runs_of(text: str | None, n: int) -> np.ndarray:
    """64-bit hashes of all runs of ``n`` words, repeated ones included."""
    return _runs(_word_hashes(text), n)


def _word_hashes(text: str | None) -> np.ndarray:
    words = words_of(text) if text else []
    return np.fromiter(map(_hash.__getitem__, words), np.uint64, len(words))


def _runs(h: np.ndarray, n: int) -> np.ndarray:
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        part = h[k : k + len(out)] * _MIX[k]
        out = (out ^ part ^ (part >> np.uint64(31))) * _MIX[(k + 1) % len(_MIX)]
    return out ^ (out >> np.uint64(29))


def signatures(df: DataFrame, *, id_col: str, n: int) -> DataFrame:
    """``id``, ``c1``, ``c2`` (128 bits that equal for equal sequences of words), ``t1``, ``t2`` (for equal bytes), ``runs`` and ``sig`` of each text with a run of ``n`` words."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        which, sizes, classes, exact, parts = [], [], [], [], []
        for r, text in enumerate(b.column(1).to_pylist()):
            words = _word_hashes(text)
            if len(words) >= n:
                runs = _runs(words, n)
                which.append(r)
                sizes.append(len(runs))
                classes.append(xxhash.xxh3_128_digest(words.tobytes()))
                exact.append(xxhash.xxh3_128_digest(text))
                parts.append((runs >> np.uint64(32)).astype(np.uint32) ^ runs.astype(np.uint32))
        ids = b.column(0).take(pa.array(which, pa.int32()))
        sig = np.zeros((len(which), len(_A)), np.uint32)
        if which:
            flat, edges = np.concatenate(parts), np.cumsum([0, *sizes[:-1]])
            for k in range(len(_A)):
                sig[:, k] = np.minimum.reduceat(flat * _A[k] + _B[k], edges)
        sig = ((sig ^ (sig >> np.uint32(16))) & np.uint32(2**BITS - 1)).astype(np.uint16).view(np.int16)
        pair, same = (np.frombuffer(b"".join(x), np.int64).reshape(-1, 2) for x in (classes, exact))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(which) + 1, dtype=np.int32) * len(_A)), pa.array(sig.ravel()))
        columns = [ids, pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(same[:, 0]), pa.array(same[:, 1]), pa.array(sizes, pa.int32()), lists]
        return pa.RecordBatch.from_arrays(columns, ["id", "c1", "c2", "t1", "t2", "runs", "sig"])

    kind = dict(df.dtypes)[id_col]
    rows = df.where(F.col("text").isNotNull() & F.col(id_col).isNotNull())
    return arrow_map(rows.select(id_col, "text"), run, f"id {kind}, c1 bigint, c2 bigint, t1 bigint, t2 bigint, runs int, sig array<smallint>")


def _keys(sig: str) -> Column:
    """For each chunk and each of its minima left out a hash of the others."""
    keys = []
    for c in range(CHUNKS):
        own = [F.col(sig)[c * LENGTH + k] for k in range(LENGTH)]
        keys += [F.xxhash64(F.lit(c * LENGTH + k).cast("smallint"), *(own[:k] + own[k + 1 :])) for k in range(LENGTH)]
    return F.array(*keys)


def _members(signed: DataFrame) -> DataFrame:
    """The members of ``near_duplicates``."""
    exact = signed.groupBy("c1", "c2", "t1", "t2").agg(F.min("id").alias("copy"), F.count(F.lit(1)).alias("copies"))
    firsts = exact.groupBy("c1", "c2").agg(F.min("copy").alias("first"), F.sum("copies").alias("size"))
    return signed.select("id", "c1", "c2", "t1", "t2").join(exact.join(firsts, ["c1", "c2"]), ["c1", "c2", "t1", "t2"]).select("id", "first", "size", "copy", "copies")


def _index(df: DataFrame, id_col: str, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All signatures (written once), one row for each class of equal words with its signature, and the keys of these rows."""
    signed = checkpointed(signatures(df, id_col=id_col, n=n))
    reps = signed.groupBy("c1", "c2").agg(F.min_by(F.struct("id", "sig"), "id").alias("r")).select("r.id", "r.sig")
    return signed, reps, reps.select("id", F.explode(_keys("sig")).alias("key"))


def _checked(df: DataFrame, pairs: DataFrame, reps: DataFrame, *, id_col: str, n: int, similarity: float) -> DataFrame:
    """``a``, ``b``, ``similarity`` of the candidates (``a`` < ``b``, distinct) that are as similar as asked, by their signatures and then by their texts.

    The text of ``b`` is joined first and that of ``a`` last: a text that is the first of many pairs is then shuffled once, not once for each pair.
    """
    sig = reps.select("id", "sig")
    pairs = pairs.join(sig.toDF("b", "sig_b"), "b").join(sig.toDF("a", "sig_a"), "a")
    equal = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    pairs = checkpointed(pairs.where(equal >= LEAST_EQUAL).select("a", "b"))

    asked = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    texts = df.where("text IS NOT NULL").select(F.col(id_col).alias("id"), "text")
    texts = texts.join(F.broadcast(asked) if pairs.count() <= BROADCAST_IDS // 2 else asked, "id", "left_semi")
    both = pairs.join(texts.toDF("b", "text_b"), "b").join(texts.toDF("a", "text_a"), "a")

    def compare(b: pa.RecordBatch) -> pa.RecordBatch:
        known: dict[int, np.ndarray] = {}
        out = []
        for i, x, j, y in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
            p, q = (known[k] if k in known else known.setdefault(k, np.unique(runs_of(t, n))) for k, t in ((i, x), (j, y)))
            common = len(np.intersect1d(p, q, assume_unique=True))
            out.append(common / (len(p) + len(q) - common))
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.float64())], ["a", "b", "similarity"])

    kind = dict(df.dtypes)[id_col]
    links = arrow_map(both.select("a", "b", "text_a", "text_b"), compare, f"a {kind}, b {kind}, similarity double")
    # A row that occurs repeatedly has been compared as often.
    return links.where(F.col("similarity") >= similarity).distinct()


def near_duplicates(df: DataFrame, *, id_col: str = "row_id", n: int = 5, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Links between different texts, and who belongs to which text.

    Links: ``a``, ``b`` (ids of the first rows of two classes of texts), ``similarity``: distinct runs of ``n`` words in
    both divided by distinct runs in either, at least ``similarity``. Members: ``id``, ``first`` (the smallest id of its
    class), ``size``: the rows whose texts are the same sequence of words, whatever stands between these; ``copy`` (the
    smallest id of its exact copies), ``copies``: the rows whose texts are the same bytes. This is the whole result,
    of one form at every size: any two rows are near-duplicates if they have one class or their classes have a link.

    Candidates come from a multi-index join over b-bit signatures, see CHUNKS; an exact comparison of the texts follows.
    Rows with a null id, a null text or fewer than ``n`` words are in neither result. A repeated row is in the members as
    often as it occurs and counts so often as a copy; no id is linked with itself. Other columns are ignored; empty tables give empty results.

    Scale: copies are combined before any pair is formed. The signatures (about 190 bytes a row) and the candidates
    are written to the checkpoint folder, so texts are read twice and never all shuffled unless more rows than
    ``BROADCAST_IDS`` are in question. Buckets are joined, never gathered: adaptive execution may split a large one. The work
    grows with the links there are; where groups are wanted and not links, ``near_duplicate_groups`` does without most of them.
    """
    signed, reps, keys = _index(df, id_col, n)
    pairs = keys.toDF("a", "key").join(keys.toDF("b", "key"), "key").where("a < b").select("a", "b").distinct()
    return _checked(df, pairs, reps, id_col=id_col, n=n, similarity=similarity), _members(signed)


def near_duplicate_pairs(df: DataFrame, *, id_col: str = "row_id", n: int = 5, similarity: float = 0.8) -> DataFrame:
    """``a`` < ``b``: the result of ``near_duplicates`` unfolded into pairs of rows.

    Every two different texts that are linked have pairs: each row of one with the first copy of the other. Each row has one with the
    first copy of its own text. Where both texts have up to ``UNFOLDED`` copies all pairs come out; beyond, those left out
    follow from the members, and what comes out grows with the rows and not with their square. A repeated row gives each pair once.

    Scale: variants of one text are paired by kind of text before their copies are.
    """
    links, members = near_duplicates(df, id_col=id_col, n=n, similarity=similarity)
    members = checkpointed(members.distinct())
    # Kinds of text (equal bytes) that are linked: across classes, and within a class that has several.
    kinds = members.select("first", "copy", "copies").where("id = copy")
    k, m = kinds.toDF("a", "k", "n_k"), kinds.toDF("b", "m", "n_m")
    varied = kinds.join(members.where("size > copies AND id = copy").select("copy"), "copy", "left_semi").select("first", "copy", "copies")
    linked = links.select("a", "b").join(k, "a").join(m, "b").select("k", "m", "n_k", "n_m")
    linked = linked.unionByName(varied.toDF("a", "k", "n_k").join(varied.toDF("a", "m", "n_m"), "a").where("k < m").select("k", "m", "n_k", "n_m"))
    small = (F.col("n_k") <= UNFOLDED) & (F.col("n_m") <= UNFOLDED)
    x, y = members.select(F.col("copy").alias("k"), F.col("id").alias("x")), members.select(F.col("copy").alias("m"), F.col("id").alias("y"))
    linked = checkpointed(linked)
    full = linked.where(small).join(x, "k").join(y, "m").select("x", "y")
    large = linked.where(~small)
    to_m, to_k = large.join(x, "k").select("x", F.col("m").alias("y")), large.join(y, "m").where("m <> y").select(F.col("k").alias("x"), "y")
    across = full.unionByName(to_m).unionByName(to_k).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    copied = members.where("copies > 1")
    few = copied.where(F.col("copies") <= UNFOLDED)
    within = few.select("copy", F.col("id").alias("a")).join(few.select("copy", F.col("id").alias("b")), "copy").where("a < b").select("a", "b")
    return across.unionByName(within).unionByName(copied.where((F.col("copies") > UNFOLDED) & (F.col("id") != F.col("copy"))).select(F.col("copy").alias("a"), F.col("id").alias("b")))


def near_duplicate_groups(df: DataFrame, *, id_col: str = "row_id", n: int = 5, similarity: float = 0.8) -> DataFrame:
    """``id_col``, ``class_id`` (first row with the same words), ``group_id`` (smallest id that links lead to) of each row.

    The groups are those of the links of ``near_duplicates``, without finding all of these. First each text is compared with the first of
    each of its buckets, which joins most of a family of near copies with as many comparisons as it has texts and buckets. Then only
    pairs of one bucket that are not yet in one group are compared: buckets of one group are done, in the others the texts outside
    of the largest group there are compared with all. So every link between two groups would have been found.

    Scale: a family of texts all near each other costs in proportion to its size, not to its square.
    """
    signed, reps, keys = _index(df, id_col, n)
    how = {"id_col": id_col, "n": n, "similarity": similarity}
    # Most buckets have one text: only the others are kept, with the first text of each.
    hubs = keys.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z").select("key", "a")
    shared = checkpointed(keys.join(hubs, "key"))
    tried = checkpointed(shared.where("a < id").select("a", F.col("id").alias("b")).distinct())
    links = checkpointed(_checked(df, tried, reps, **how).select("a", "b"))
    grouped = checkpointed(components(links))
    placed = shared.select("key", "id").join(grouped, "id", "left").select("key", "id", F.coalesce("component", "id").alias("g"))
    mixed = placed.groupBy("key", "g").agg(F.count(F.lit(1)).alias("n"))
    mixed = checkpointed(mixed.groupBy("key").agg(F.max_by("g", "n").alias("main"), F.count(F.lit(1)).alias("groups")).where("groups > 1").select("key", "main"))
    inside = placed.join(mixed, "key")
    outer = inside.where("g <> main").select("key", F.col("id").alias("x"), F.col("g").alias("gx"))
    pairs = outer.join(inside.select("key", F.col("id").alias("y"), F.col("g").alias("gy")), "key").where("gx <> gy")
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    more = checkpointed(_checked(df, pairs, reps, **how).select("a", "b"))
    groups = components(links.unionByName(more)).select(F.col("id").alias("first"), "component")
    out = _members(signed).join(groups, "first", "left")
    return out.select(F.col("id").alias(id_col), F.col("first").alias("class_id"), F.coalesce("component", "first").alias("group_id"))


_RUNS = r"""
WITH RECURSIVE w AS (SELECT row_id, md5(text) AS t, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM manifest WHERE text IS NOT NULL),
k AS (SELECT row_id, t, array_to_string(w, ' ') AS said, w FROM w WHERE len(w) >= {n}),
m AS MATERIALIZED (SELECT row_id, t, min(row_id) OVER (PARTITION BY said) AS class_id, count(*) OVER (PARTITION BY said) AS class_size,
        min(row_id) OVER (PARTITION BY t) AS copy_id, count(*) OVER (PARTITION BY t) AS copies FROM k),
s AS MATERIALIZED (SELECT row_id AS i, hash(unnest(list_distinct(list_transform(range(1, len(w) - {n} + 2), lambda j: array_to_string(w[j:j + {n} - 1], ' '))))) AS g
      FROM k WHERE row_id IN (SELECT class_id FROM m)),
n AS (SELECT i, count(*) AS n FROM s GROUP BY i),
c AS (SELECT x.i AS a, y.i AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.i < y.i GROUP BY x.i, y.i),
l AS MATERIALIZED (SELECT a, b, c / (p.n + q.n - c) AS similarity FROM c JOIN n p ON p.i = a JOIN n q ON q.i = b WHERE c / (p.n + q.n - c) >= {least})
"""
_PRODUCTION, _FOUND = (_RUNS.replace("{n}", str(n)).replace("{least}", str(least)) for n, least in ((5, 0.8), (3, 0.7)))


@query(
    "p6_found",
    _FOUND
    + """SELECT least(x.row_id, y.row_id) AS row_id_a, greatest(x.row_id, y.row_id) AS row_id_b FROM l JOIN m x ON x.class_id = a JOIN m y ON y.class_id = b
UNION ALL SELECT x.row_id, y.row_id FROM m x JOIN m y ON x.class_id = y.class_id AND x.row_id < y.row_id""",
)
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_pairs(spread(table(spark, sf_dir, "manifest")), n=3, similarity=0.7).toDF("row_id_a", "row_id_b")


@query("p6_links", _FOUND + "SELECT a AS class_a, b AS class_b, round(similarity, 9) AS similarity FROM l")
def p6_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links behind ``p6_found``, between the first rows of classes of equal words."""
    links, _ = near_duplicates(spread(table(spark, sf_dir, "manifest")), n=3, similarity=0.7)
    return links.select(F.col("a").alias("class_a"), F.col("b").alias("class_b"), F.round("similarity", 9).alias("similarity"))


@query("p6_members", _FOUND + "SELECT row_id, class_id, class_size, copy_id, copies FROM m")
def p6_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the links of ``p6_links`` and the pairs of ``p6_found``: the class of equal words and the exact copies to which each row belongs."""
    members = _members(checkpointed(signatures(spread(table(spark, sf_dir, "manifest")), id_col="row_id", n=3)))
    return members.toDF("row_id", "class_id", "class_size", "copy_id", "copies")


@query(
    "p6_groups",
    _PRODUCTION
    + """, r AS (SELECT i AS id, i AS met FROM n UNION SELECT r.id, e.b FROM r JOIN (SELECT a, b FROM l UNION ALL SELECT b, a FROM l) e ON r.met = e.a),
g AS (SELECT id, min(met) AS group_id FROM r GROUP BY id)
SELECT row_id, class_id, group_id FROM m JOIN g ON m.class_id = g.id""",
)
def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of rows at the production threshold: runs of five words, similarity 0.8."""
    return near_duplicate_groups(spread(table(spark, sf_dir, "manifest")))
