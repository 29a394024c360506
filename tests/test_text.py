from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions.breaks import Breaks
from tidemark.operators import adjudicate as ad
from tidemark.operators import intervals as iv
from tidemark.operators import kernels as ke
from tidemark.operators.text import locate as lo
from tidemark.operators.text import markup_text as mt
from tidemark.operators.text import passages as pa

BODY = "Some words about the matter at hand. " * 40


def headed(*items):
    return "".join(f"Item {i}. Title {i}\n{BODY}\n" for i in items)


def pages(n, first=1, body=None):
    return "".join(f"{(body or {}).get(k, f'Text of page number {k} here.')}\n{k}\n" for k in range(first, first + n))


# --- HTML


def test_blocks_entities_scripts():
    assert mt.text_of("<p>One</p><script>x<y</script><p>Two&#160;three</p>") == "One\nTwo three"
    assert mt.text_of("a<br>b<style>p{}</style>") == "a\nb"
    assert mt.text_of(None) is None and mt.text_of("") == ""


def grid(rows, cols, cell):
    return "<table>" + ("<tr>" + f"<td>{cell}</td>" * cols + "</tr>") * rows + "</table>"


def test_tables():
    assert mt.text_of("x" + grid(4, 3, "1,234") + "y") == "x\n[TABLE: 4 rows x 3 cols]\n\ny"
    assert mt.text_of("<table><tr><td>Item 1.</td><td>Business</td></tr></table>") == "Item 1.\nBusiness"
    assert mt.text_of(f"<table><tr><td>Intro {grid(3, 2, '$5')}</td></tr></table>") == "Intro\n[TABLE: 3 rows x 2 cols]"
    footer = "<table>" + "<tr><td></td><td>50</td><td>Name</td></tr>" + "<tr><td></td><td></td><td></td></tr>" * 2 + "</table>"
    assert "TABLE" not in mt.text_of(footer)
    assert not mt.is_data_table(3, 2, ["1", "2", "3", "4", "5", ""]) and mt.is_data_table(3, 2, ["1", "2", "a", "b", "c", "d"])


def test_exhibits_and_outline():
    index = "<table class='tableFile'><tr><th>Seq</th><th>Document</th><th>Type</th></tr><tr><td>1</td><td>a.htm iXBRL</td><td>10-K</td></tr><tr><td>2</td><td><a>b.htm</a></td><td>EX-13.1</td></tr></table>"
    assert mt.exhibit_names(index) == ["b.htm"] and mt.exhibit_names("<p>none</p>") == []
    contents = "<table>" + "<tr><td>Financial Review</td></tr>" + "".join(f"<tr><td>{n}</td><td>Part {n}</td></tr>" for n in range(1, 10)) + "</table>"
    assert mt.outline(contents)[:2] == [("Financial Review", True), ("Part 1", False)]
    assert mt.outline("<table><tr><td>x</td></tr></table>") == []


# --- sections


def test_headings_contents_and_order():
    text = "".join(f"Item {i}. Title\n" for i in ("1", "1A", "3", "7", "8")) + headed("1", "1A", "7")
    found = lo.find_sections(text)
    assert list(found) == ["1", "1A", "7"]
    assert all(text[s.heading :].startswith(f"Item {i}.") and s.spans[0][0] > s.heading for i, s in found.items())
    assert found["1"].spans[0][1] == found["1A"].heading and found["7"].spans[0][1] == len(text)
    assert lo.find_sections("") == {} and lo.find_sections("no headings") == {}


def test_longest_chain_drops_strays():
    text = headed("1", "8", "1A", "7")
    assert [h.item for h in lo.ascending(lo.headings(text))] == ["1", "1A", "7"]
    r = random.Random(2)
    for _ in range(50):
        chain = [lo.Heading(r.choice(lo.ITEMS), k, k) for k in range(12)]
        ranks = [lo.RANK[h.item] for h in lo.ascending(chain)]
        best = [1] * 12
        for i in range(12):
            best[i] += max((best[j] for j in range(i) if lo.RANK[chain[j].item] < lo.RANK[chain[i].item]), default=0)
        assert ranks == sorted(set(ranks)) and len(ranks) == max(best)


def test_page_index_skips_strays():
    text = pages(30).replace("Text of page number 12 here.", "A table\n999\n7\nmore")
    index = lo.page_index(text)
    assert list(index) == list(range(1, 31)) and text[slice(*index[12])] == "12"
    assert lo.page_index(pages(10)) == {}
    titled = "".join(f"Body {k}\n{k} Big Company 2025 Report\n" if k % 2 else f"Body {k}\n{k}\n" for k in range(1, 41))
    assert list(lo.page_index(titled)) == list(range(1, 41))


def test_cross_reference_table():
    table = "Item 1.\nBusiness\n3 - 5, 8\nItem 1A.\nRisk Factors\n6\nItem 7.\nNot applicable\n" + BODY + "\n"
    text = pages(30, body={1: table})
    found = lo.by_pages(text)
    assert set(found) == {"1", "1A"} and found["1"].strategy == lo.PAGES and len(found["1"].spans) == 2
    a, z = found["1"].spans[0]
    assert "page number 3" in text[a:z] and "page number 5" in text[a:z] and "page number 6" not in text[a:z]
    bare = pages(30, body={1: "Item Number\n1A.\nRisk\n4-6,\n\n9\n7.\nOther\n10\n"})
    assert lo.page_references(bare) == {"1A": [(4, 6), (9, 9)], "7": [(10, 10)]}
    assert lo.pages_span(2, 99, {1: (5, 6), 2: (9, 10)}) is None and lo.pages_span(1, 1, {1: (5, 6)}) == (0, 5)


def test_referrals():
    stub = "Item 7. Discussion\nInformation in response to this Item can be found in the Annual Report on pages 3 to 4. More follows.\n"
    primary = headed("1") + stub + headed("8")
    exhibit = pages(25)
    text = primary + exhibit
    found = lo.find_sections(text, [(0, len(primary)), (len(primary), len(text))])
    a, z = found["7"].spans[0]
    assert found["7"].strategy == lo.REFERRAL and "page number 3" in text[a:z] and "page number 5" not in text[a:z]
    assert len(found["7"].spans) == 2  # its own sentence stays
    assert lo.parse_referral("T\nSee “Financial Review – Risk Factors” in Note 12 there. Rest").paths == [["Financial Review", "Risk Factors"]]
    assert lo.parse_referral("T\nIt is found beginning on page 81.") is None
    assert not lo.is_stub(text, (0, 5000))
    named = headed("1") + "Item 7A. Risk\nRefer to “Market Risk” in the report.\n" + "x\nMarket Risk\nAll about it.\nCapital\nOther\n"
    spans = lo.Book(named, (0, len(named)), [("Market Risk", False), ("Capital", False)]).resolve(lo.Referral([], [["Market Risk"]], None))
    assert [named[a:z] for a, z in spans] == ["Market Risk\nAll about it.\n"]
    assert lo.Book(named, (0, len(named)), []).resolve(lo.Referral([], [["Market Risk"]], None)) == []
    notes = "NOTE 1. Basis\ntext\nNOTE 2\nLitigation\nbody\nNOTE 3\nend"
    spans = lo.Book(notes, (0, len(notes)), []).resolve(lo.Referral([], [["Note 2", "Litigation"]], 2))
    assert [notes[a:z] for a, z in spans] == ["Litigation\nbody\n"]


def test_declared_beats_inferred():
    assert lo.subtract((0, 100), [(10, 20), (15, 30), (90, 120)]) == [(0, 10), (30, 90)]
    assert lo.subtract((0, 10), [(0, 10)]) == []
    assert lo.part_at([("a", 0, 10), ("b", 12, 20)], 13) == "b" and lo.part_at([("a", 0, 10), ("b", 12, 20)], 11) == "a"


def test_located_rows(spark):
    df = spark.createDataFrame([("x", headed("1", "1A", "7")), ("y", None), ("z", "nothing")], "accession string, text string")
    rows = ke.located(df)
    assert sorted((r["accession"], r["item"]) for r in rows.collect()) == [("x", "1"), ("x", "1A"), ("x", "7")]
    assert ad.bad_offsets(df, rows).count() == 0
    states = {r["accession"]: (r["state"], r["strategy"]) for r in ad.parser_states(df, rows).collect()}
    assert states == {"x": ("partial", "item_heading"), "y": ("failed", "none"), "z": ("failed", "none")}


# --- chunks


@pytest.mark.parametrize("text", [BODY * 20, "x" * 9000, "para\n\n" * 3000, ""])
def test_windows(text):
    spans = list(pa.windows(Breaks(text), 0, len(text)))
    if not text:
        assert spans == []
        return
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for (a, b), (c, _) in zip(spans, spans[1:]):
        assert c == b - 480 and b - a <= 3200 and b - a >= 1600


def test_chunks_and_segments(spark):
    spans = spark.createDataFrame([("f", "7", 0, 5000), ("f", "7A", 3000, 5000), ("f", "8", 6000, 6100), ("f", "8", 6050, 9000)], "accession string, item string, span_start bigint, span_end bigint")
    segments = iv.segments(spans)
    assert sorted((r["start"], r["end"], tuple(r["items"])) for r in segments.collect()) == [(0, 3000, ("7",)), (3000, 5000, ("7", "7A")), (6000, 9000, ("8",))]
    df = spark.createDataFrame([("f", "é" * 9000)], "accession string, text string")
    got = ke.item_aware(df, segments, items=["7A"]).collect()
    assert [(r["char_start"], r["char_end"], r["items"]) for r in got] == [(3000, 5000, ["7", "7A"])]
    fixed = sorted((r["char_start"], r["char_end"]) for r in ke.fixed_windows(df).collect())
    assert fixed == [(0, 3200), (2720, 5920), (5440, 8640), (8160, 9000)]


def test_item_order(spark):
    row = spark.createDataFrame([(["10", "7A", "zz", "7"],)], "i array<string>").select(iv.item_order(F.col("i"))).first()
    assert row[0] == ["7", "7A", "10", "zz"]


def test_passages():
    text = "first line\nThe Allowance rose. Allowance fell.\n" + "y" * 3000 + " allowance " + "z" * 3000
    got = pa.find_passages(text, "allowance")
    assert text[slice(*got[0])] == "The Allowance rose. Allowance fell." and got[1][1] - got[1][0] <= 2000 and "allowance" in text[slice(*got[1])]
    assert pa.find_passages(text, "nothing") == [] and len(pa.find_passages(text, "allowance", most=1)) == 1
    with pytest.raises(ValueError):
        pa.find_passages(text, " ")
    assert pa.narrow(text, 1000, "ALLOWANCE rose") == (1011, 1046) and pa.narrow(text, 0, "zzq") is None


def test_breaks_are_those_of_a_search():
    r = random.Random(8)
    kinds = [re.compile(p) for p in (r"\n\s*\n", r"\n", r"(?<=[.!?])\s+")]
    for _ in range(300):
        text = "".join(r.choice("ab.! \n\n\t") for _ in range(80))
        breaks = Breaks(text)
        for _ in range(20):
            low = r.randrange(0, 70)
            high = r.randrange(low + 1, 81)
            ends = [[low + m.end() for m in k.finditer(text[low:high])] for k in kinds]
            assert breaks.last(low, high) == next((e[-1] for e in ends if e), None)


def test_quotes(spark):
    df = spark.createDataFrame([("a  b\n\u00a0c ",), ("x" * 200,), (None,)], "p string").select(pa.quoted(F.col("p")))
    assert [r[0] for r in df.collect()] == ["a b c", "x" * 87 + "...", None]


def test_longest_chain_of_pages():
    r = random.Random(6)
    for _ in range(20):
        numbers = sorted([*range(1, 31), *(r.randint(1, 40) for _ in range(25))], key=lambda n: n + 6 * r.random())
        text = "".join(f"words\n{n}\n" for n in numbers)
        best: dict[int, int] = {}
        for n in numbers:
            best[n] = max(best.get(n, 0), 1 + best.get(n - 1, 0))
        found = lo.page_index(text)
        longest = max(best.values())
        assert len(found) == (longest if longest >= lo.PAGE_RUN else 0)
        assert [text[slice(*found[n])] for n in found] == [str(n) for n in found] and list(found.values()) == sorted(found.values())


def test_uncovered(spark):
    wholes = spark.createDataFrame([("a", 0, 100), ("b", 0, 10), ("c", 5, 6)], "k string, s bigint, e bigint")
    holes = spark.createDataFrame([("a", 10, 20), ("a", 15, 30), ("a", 90, 200), ("b", -5, 50)], "k string, s bigint, e bigint")
    got = sorted(tuple(r) for r in iv.uncovered(wholes, holes, by="k", start="s", end="e").collect())
    assert got == [("a", 0, 10), ("a", 30, 90), ("c", 5, 6)]
