from __future__ import annotations

import random

from pyspark.sql import functions as F

from tidemark.llm.repetition import repeated_share, repetition_ratio


def share(words):
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    return 1 - len(set(runs)) / len(runs) if runs else None


def test_share(spark):
    texts = ["a b c d e " * 10, "One two three four five six seven", "a b c d", "", None, " \u00a0 ", "A b C d E a B c D e", "x " * 100_000]
    df = spark.createDataFrame([(n, t, "q") for n, t in enumerate(texts)] + [(0, texts[0], "q")], "doc_id bigint, text string, n_runs string")
    got = {r["doc_id"]: r["repeated"] for r in repeated_share(df).collect()}
    for n, t in enumerate(texts):
        want = share((t or "").lower().split())
        assert got[n] == want if want is None else abs(got[n] - want) < 1e-12
    assert repeated_share(df).count() == len(texts) + 1
    assert repeated_share(df.limit(0)).count() == 0


def test_ratio_decides_as_the_share_does(spark):
    r = random.Random(3)
    texts = [" ".join(r.choice("abcdefgh"[: r.randint(1, 8)]) for _ in range(r.randint(3, 60))) for _ in range(300)]
    texts += ["a b c d e f g a b c d e f", "a b c d e a b c d e a", "", None, "a b c d", "w " * 5000]
    df = spark.createDataFrame([(n, t, n % 3 == 0 or None, "q") for n, t in enumerate(texts)], "doc_id bigint, text string, good boolean, ratio string")
    shares = [share((t or "").lower().split()) for t in texts]
    for least in (0.5, 0.2):
        for trusted in (F.col("good"), F.lit(False), F.lit(True), F.col("doc_id") == 305):  # some, none, all, one that only repeats
            got = {x["doc_id"]: x["repeats"] for x in repetition_ratio(df, trusted=trusted, share=least).collect()}
            assert got == {n: s is not None and s >= least - 1e-12 for n, s in enumerate(shares)}
    got = {x["doc_id"]: x["ratio"] for x in repetition_ratio(df, trusted=F.col("good")).collect()}
    assert got[302] is None and got[303] is None and got[304] is None
    known = sorted((s, got[n]) for n, s in enumerate(shares) if s is not None)
    assert len({a < b for (s, a), (t, b) in zip(known, known[1:], strict=False) if t - s > 1e-9}) == 1
    assert repetition_ratio(df.limit(0), trusted=F.col("good")).count() == 0
