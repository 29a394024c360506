from __future__ import annotations

from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.bpe import MergeReplay, read_ranks
from tidemark.llm.packing import pack, vector_best_fit
from tidemark.llm.tokens import VOCABULARY, encode_texts

import numpy as np

pytestmark = pytest.mark.skipif(not Path(VOCABULARY).exists(), reason="no vocabulary")
ODD = ["aaaaaaaaaaaaaaaaaaaaa", " ​ x   y  \n\n z", "<|endoftext|> it's I'LL", "\x1c\x1d a\x1f\x85b c", "½ ² ⅷ ٣٤ 中文字 日本", "👩‍💼🏽 é́́" * 3, "x" * 5000, "\n" * 99 + "a", "'s't're've'm'll'd'x", "", None]


@pytest.fixture(scope="module")
def ranks():
    return read_ranks(Path(VOCABULARY).read_bytes())


@pytest.fixture(scope="module")
def library(ranks):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(m, texts):
    offsets, values = m.encode(texts)
    return [values[a:z].tolist() for a, z in zip(offsets, offsets[1:])]


def test_odd_texts(ranks, library):
    assert ids(MergeReplay(ranks), ODD) == [library.encode_ordinary(t) if t else [] for t in ODD]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_against_library(ranks, library, texts):
    m = MergeReplay(ranks)
    assert ids(m, texts) == [library.encode_ordinary(t) for t in texts]
    assert m.count(texts).tolist() == [len(library.encode_ordinary(t)) for t in texts]


def test_rows(spark, library):
    df = spark.createDataFrame([(1, "Net income of $5.", 1), (2, "", 1), (3, None, 1), (3, None, 1), (None, "a", 1)], "doc_id bigint, text string, ids int")
    got = sorted(((r["doc_id"], r["ids"]) for r in encode_texts(df).collect()), key=str)
    assert got == sorted([(1, library.encode_ordinary("Net income of $5.")), (2, []), (3, []), (3, []), (None, library.encode_ordinary("a"))], key=str)
    assert library.decode(dict(got)[1]) == "Net income of $5."
    assert sorted(r["n_tokens"] for r in encode_texts(df, ids=False).collect()) == [0, 0, 0, 1, 6]
    assert encode_texts(df.limit(0)).count() == 0


def fill(spark, sizes, **how):
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id bigint, n_tokens bigint")
    got = pack(df, **how).collect()
    content, cover = {}, {}
    for r in got:
        content.setdefault(r["container_id"], []).append(r["token_end"] - r["token_start"])
        cover.setdefault(r["doc_id"], []).append((r["token_start"], r["token_end"]))
    for n, s in enumerate(sizes):
        if s and s > 0:
            spans = sorted(cover[n])
            assert spans[0][0] == 0 and spans[-1][1] == s and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
            assert len(spans) == -(-s // how.get("capacity", 2048))
        else:
            assert n not in cover
    return content


def test_packing_invariants(spark):
    import random

    r = random.Random(3)
    sizes = [r.randint(0, 3000) for _ in range(600)] + [None, -5, 0, 2048, 4096, 2048]
    content = fill(spark, sizes, shard_items=200)
    assert all(sum(c) <= 2048 for c in content.values())
    total = sum(s for s in sizes if s and s > 0)
    assert total / (2048 * len(content)) > 0.97


def test_packing_other_capacities(spark):
    content = fill(spark, [1] * 50 + [10] * 3, capacity=20, most=8)
    assert all(sum(c) <= 20 and len(c) <= 8 for c in content.values())
    content = fill(spark, [90, 80, 10, 10, 20], capacity=100, attention=0.645)
    assert sorted(map(sorted, content.values())) == [[10, 10, 20], [80], [90]]  # 90 costs too much for any other, 80 leaves no cost for 10
    content = fill(spark, [10] * 10, capacity=100, attention=0.02)
    assert all(len(c) == 2 for c in content.values())
    assert fill(spark, []) == {}


def test_best_fit_takes_the_tightest_bin():
    bins = vector_best_fit(np.array([60, 50, 40, 50]), 100, 10, 1e9)
    assert bins[0] == bins[2] and bins[1] == bins[3] and bins[0] != bins[1]
