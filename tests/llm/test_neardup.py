from __future__ import annotations

import random

from tidemark.llm.components import components
from tidemark.llm.neardup import near_duplicate_groups, near_duplicate_pairs, near_duplicates, words_of

SCHEMA = "row_id bigint, text string, a string"


def corpus(seed=2, n=100):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, no = [], 0
    for _ in range(n):
        words = [r.choice(vocabulary) for _ in range(r.randint(30, 120))]
        rows.append((no := no + 1, " ".join(words), "q"))
        for _ in range(r.randint(0, 3)):
            copy = list(words)
            for _ in range(r.randint(0, 6)):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            rows.append((no := no + 1, ", ".join(copy).upper(), "q"))
    return rows


def runs(text, n):
    w = words_of(text or "")
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def by_hand(rows, n, least):
    sets = {i: runs(t, n) for i, t, _ in rows}
    return {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least}


def test_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    for n, least in ((3, 0.7), (5, 0.8)):
        want = by_hand(rows, n, least)
        got = {(r["a"], r["b"]) for r in near_duplicate_pairs(df, n=n, similarity=least).collect()}
        assert len(want) > 40
        assert got == want


def test_copies_nulls_and_short_texts(spark):
    long = " ".join(f"word{i}" for i in range(40))
    rows = [(1, long, "q"), (2, long.upper() + " !", "q"), (3, long, "q"), (4, "one two", "q"), (5, "one two", "q"), (6, None, "q"), (7, "", "q"), (8, long + " more", "q")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["a"], r["b"]) for r in near_duplicate_pairs(df, n=3, similarity=0.7).collect()}
    assert got == {(1, 2), (1, 3), (2, 3), (1, 8), (2, 8), (3, 8)}
    links, members = near_duplicates(df, n=3, similarity=0.7)
    assert [(r["a"], r["b"]) for r in links.collect()] == [(1, 8)]
    assert {(r["id"], r["first"], r["size"]) for r in members.collect()} == {(1, 1, 3), (2, 1, 3), (3, 1, 3), (8, 8, 1)}
    groups = {r["row_id"]: (r["class_id"], r["group_id"]) for r in near_duplicate_groups(df, n=3, similarity=0.7).collect()}
    assert groups == {1: (1, 1), 2: (1, 1), 3: (1, 1), 8: (8, 1)}
    assert near_duplicate_pairs(df.limit(0)).count() == 0 and near_duplicate_groups(df.limit(0)).count() == 0
    twice = df.union(df).union(spark.createDataFrame([(None, long, "q")], SCHEMA))
    assert sorted(tuple(r) for r in near_duplicate_pairs(twice, n=3, similarity=0.7).collect()) == sorted(got)
    assert {tuple(r) for r in near_duplicate_groups(twice, n=3, similarity=0.7).collect()} == {(k, *v) for k, v in groups.items()}


def test_a_large_class_is_a_star(spark):
    long = " ".join(f"word{i}" for i in range(40))
    df = spark.createDataFrame([(n, long, "q") for n in range(1, 101)], SCHEMA)
    got = {(r["a"], r["b"]) for r in near_duplicate_pairs(df).collect()}
    assert got == {(1, n) for n in range(2, 101)}


def test_a_large_class_of_different_texts_is_unfolded(spark):
    long = " ".join(f"word{i}" for i in range(40))
    rows = [(n, long.upper() if n % 2 else long, "q") for n in range(1, 71)] + [(71, long + " more", "q")]
    got = sorted((r["a"], r["b"]) for r in near_duplicate_pairs(spark.createDataFrame(rows, SCHEMA), n=3, similarity=0.7).collect())
    assert got == [(a, b) for a in range(1, 72) for b in range(a + 1, 72)]
    rows = [(n, long, "q") for n in range(1, 101)] + [(101, long + "!", "q"), (102, long + " more", "q")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r["a"], r["b"]) for r in near_duplicate_pairs(df, n=3, similarity=0.7).collect())
    assert got == sorted([(1, n) for n in range(2, 101)] + [(n, m) for m in (101, 102) for n in range(1, 101)] + [(101, 102)])
    members = {r["id"]: (r["first"], r["size"], r["copy"], r["copies"]) for r in near_duplicates(df, n=3, similarity=0.7)[1].collect()}
    assert (members[7], members[101], members[102]) == ((1, 101, 1, 100), (1, 101, 101, 1), (102, 1, 102, 1))


def test_large_classes_are_paired_with_each_others_first(spark):
    long = " ".join(f"word{i}" for i in range(40))
    texts = {1: long, 2: long + " more"}
    df = spark.createDataFrame([(100 * k + n, texts[k], "q") for k in texts for n in range(80)], SCHEMA)
    got = sorted((r["a"], r["b"]) for r in near_duplicate_pairs(df, n=3, similarity=0.7).collect())
    want = {(100 * k, 100 * k + n) for k in texts for n in range(1, 80)} | {(100, 200 + n) for n in range(80)} | {(100 + n, 200) for n in range(80)}
    assert got == sorted(want)


def test_groups_are_components_of_links(spark):
    rows = corpus(3, 150)
    r = random.Random(4)
    words = rows[0][1].split()
    for _ in range(60):  # a chain whose ends are not alike
        words[r.randrange(len(words))] = f"new{r.random()}"
        rows.append((len(rows) + 1, " ".join(words), "q"))
    df = spark.createDataFrame(rows, SCHEMA)
    for n, least in ((3, 0.7), (5, 0.8)):
        group = {i: i for i, *_ in rows}
        for a, b in sorted(by_hand(rows, n, least)):
            old, new = max(group[a], group[b]), min(group[a], group[b])
            group = {k: new if v == old else v for k, v in group.items()}
        assert {r["row_id"]: r["group_id"] for r in near_duplicate_groups(df, n=n, similarity=least).collect()} == group


def test_a_family_of_near_copies(spark):
    words = [f"word{i}" for i in range(150)]
    rows = [(n, " ".join([*words[: n % 100], f"date{n}", *words[n % 100 :]]), "q") for n in range(1, 2001)]
    got = {r["group_id"] for r in near_duplicate_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1}


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)]
    r = random.Random(1)
    r.shuffle(chain)
    links = spark.createDataFrame([*chain, (100, 101), (102, 101), (5, 5), (None, 3), (200, 201), (201, 200)], "a bigint, b bigint")
    got = {r["id"]: r["component"] for r in components(links).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 102: 100, 200: 200, 201: 200}
