from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.split import boundary_strengths, cut, split_oversized


def by_hand(text, size, overlap, least):
    """The same rule by looking at every position."""
    strength, spans, start = boundary_strengths(text), [], 0
    while len(text) - start > size:
        stop = max(range(start + least, start + size + 1), key=lambda p: (strength[p], p))
        spans.append((start, stop))
        start = stop - overlap if stop - overlap > start else stop
    return [*spans, (start, len(text))]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .,\n!", max_size=400), st.integers(8, 60))
def test_against_every_position(text, size):
    overlap, least = size // 5, size // 2
    assert cut(text, size, overlap, least) == by_hand(text, size, overlap, least)


def test_long_text_takes_several_tables():
    r = random.Random(1)
    text = "".join(r.choice("abcdefg  .,\n") for _ in range(200_000))
    got = cut(text, 3200, 480, 1600)
    assert got == by_hand(text, 3200, 480, 1600)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    assert all(e - s <= 3200 and e - t == 480 for (s, e), (t, _) in zip(got, got[1:]))
    assert "".join(text[s:e] if i == 0 else text[s + 480 : e] for i, (s, e) in enumerate(got)) == text


def test_paragraph_beats_line_and_rightmost_wins():
    text = "x" * 60 + "\n\n" + "y" * 20 + "\n" + "z" * 100
    assert cut(text, 100, 10, 50)[0] == (0, 62)
    assert cut("a " * 100, 100, 10, 50)[0] == (0, 100)


def test_no_boundary():
    assert cut("x" * 250, 100, 10, 50) == [(0, 100), (90, 190), (180, 250)]


def test_rows(spark):
    rows = [(1, "ab. " * 1000, 100, 5, ["7"], "q"), (2, "short", 0, 1, None, "q"), (3, None, None, None, None, "q"), (4, "z" * 3201, None, None, None, "q"), (4, "z" * 3201, None, None, None, "q"), (5, "é" * 3200, 0, 9, [], "q")]
    df = spark.createDataFrame(rows, "row_id bigint, text string, char_start bigint, char_end bigint, items array<string>, piece_no string")
    got = split_oversized(df).collect()
    assert sorted({r["row_id"] for r in got}) == [1, 4]
    one = sorted((r for r in got if r["row_id"] == 1), key=lambda r: r["piece_no"])
    assert one[0]["char_start"] == 100 and all(r["char_end"] - r["char_start"] == len(r["text"]) and r["items"] == ["7"] for r in one)
    assert sorted((r["piece_no"], r["char_start"]) for r in got if r["row_id"] == 4) == [(0, 0), (0, 0), (1, 2720), (1, 2720)]
    assert split_oversized(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        split_oversized(df, size=100, overlap=60)
