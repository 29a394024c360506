from __future__ import annotations

import pytest

from tidemark.llm import markup
from tidemark.llm.markup import clean_markup, clean_text, markup_kinds, p2_templates, slots_of, template_classes, template_slots

PLAIN = [
    "Holders of <5% positions; a < b and c > d.",
    "Scaling is 10**6 for dollars and 2^10 for lots; the file lies in C:\\filings\\2016\\final.",
    'the "Fia" tier uses a 5*5 grid and ~79 cells ; see note [2] and footnotes (a) | (b) | (c)',
    "Send inquiries to <ir@x.example>. M&A; R&D and T&E; AT&T",
    "amounts of $5 million and $6 million, the #3 issuer; A == B in 5 tests",
    "us-gaap_OtherDebt replaces My_Own_Portion_net [TABLE: 3 rows x 4 cols]",
    "• item\n– item\n▪ item",
    "",
    None,
    "   \n ",
]
TRACES = [
    ("a<br>b", ["html"]),
    ("x &amp; y", ["html"]),
    ("x&#8212;y", ["html"]),
    ("&lt;p&gt;x", ["html"]),
    ("a <!-- no --> b", ["html"]),
    ("<TABLE border=0><tr><td align=right>1</td></tr></TABLE>", ["html"]),
    ("# Title\n", ["markdown"]),
    ("Title\n=====\n", ["markdown"]),
    ("some **bold** word", ["markdown"]),
    ("`val` is", ["markdown"]),
    ("see [x](https://y.example/1)", ["markdown"]),
    ("| a | b |\n|---|---:|\n| 1 | 2 |", ["markdown"]),
    ("> quoted", ["markdown"]),
    ("- item", ["markdown"]),
    ("__unaudited__ x", ["markdown"]),
    ("```\n# <b>no</b> '''html'''\n```", ["markdown"]),
    ("== Title ==", ["wiki"]),
    ("some '''bold''' word", ["wiki"]),
    ("[[Page|shown]] x", ["wiki"]),
    ("{{cite |year=2019}}", ["wiki"]),
    ('{| class="wikitable"\n|-\n| a || b\n|}', ["wiki"]),
    ("; term\n: meaning", ["wiki"]),
    ("\\section{Title}", ["latex"]),
    ("the charge $\\alpha_{3}$ is", ["latex"]),
    ("\\( x \\geq 0 \\)", ["latex"]),
    ("x~\\cite{a2019}", ["latex"]),
    ("<pre><code># [[no]] **wiki** \\alpha</code></pre>", ["html"]),
    ("\\begin{verbatim}\n<b>**x**</b>\n\\end{verbatim}", ["latex"]),
    ("**net** and <b>x</b> and [[y]] and $\\beta$", ["html", "latex", "markdown", "wiki"]),
]


@pytest.mark.parametrize("text", PLAIN)
def test_plain(text):
    assert markup_kinds(text) == []
    assert clean_text(text) == ([], text)


@pytest.mark.parametrize(("text", "kinds"), TRACES)
def test_traces(text, kinds):
    assert markup_kinds(text) == kinds


def test_structure_is_kept():
    kinds, text = clean_text("<h2>Risks</h2><p>One &amp; two.</p><ul><li>a</li><li>b</li></ul><pre><code>if x &lt; 1:\n    y</code></pre>")
    assert kinds == ["html"]
    assert text == "Risks\n\nOne & two.\n\n• a\n• b\n\n    if x < 1:\n        y"
    assert clean_text("## Head\n\nsome **bold** [link](u:v)\n\n1. one\n\n```\nx = 1\n```")[1] == "Head\n\nsome bold link\n\n1. one\n\n    x = 1"
    assert clean_text("== Head ==\n'''x''' [[A|b]] {{cite}}\n* one")[1].split("\n") == ["Head", "", "x b", "• one"]
    assert clean_text("\\section{Head}\n\\begin{itemize}\n\\item one \\emph{two}\n\\end{itemize}\n$$ \\frac{a}{b} $$")[1] == "Head\n\n• one two\n\n\\frac{a}{b}"


def test_long_text_is_read_whole():
    assert markup_kinds("plain words. " * 200_000 + "<b>x</b>") == ["html"]


def test_deep_nesting():
    assert clean_text("a " + "{{x|" * 9 + "y" + "}}" * 9 + " b")[1] == "a  b"
    assert clean_text("a " + "\\emph{" * 9 + "y" + "}" * 9 + " b")[1] == "a y b"
    assert clean_text("a &" + "amp;" * 9 + "lt;b&" + "amp;" * 9 + "gt;c")[1] == "a c"
    assert clean_text("&" + "amp;" * 500_000 + " x")[1] == "& x"


def test_rows(spark):
    df = spark.createDataFrame([(1, "<b>x</b>", "q"), (1, "<b>x</b>", "q"), (2, None, "q"), (None, "", "q")], "doc_id bigint, text string, markup string")
    got = sorted(((r["doc_id"], r["markup"], r["text"]) for r in clean_markup(df).collect()), key=str)
    assert got == sorted([(1, ["html"], "x"), (1, ["html"], "x"), (2, [], None), (None, [], "")], key=str)
    assert clean_markup(df.limit(0)).count() == 0


def test_templates(spark):
    pages = [(n, "s", f"<html><title>Report</title><div>Filed by agent</div><p>{w}</p><div>Contact us</div></html>") for n, w in enumerate("ab cd ef gh ij kl".split())]
    df = spark.createDataFrame(pages, "doc_id bigint, source string, text string")
    got = template_classes(df, min_pages=5).collect()
    assert len(got) == 1 and got[0]["pages"] == 6
    assert {"<html>", "report", "contact"} <= set(got[0]["tokens"]) and not {"ab", "cd"} & set(got[0]["tokens"])


def test_templates_of_all_texts(spark, tmp_path):
    texts = [f"<p>{n} apples</p>" if n % 2 else f"# Filed {n} by agent" for n in range(50)]
    spark.createDataFrame([(n, t, "main") for n, t in enumerate(texts)], "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(tuple(r["tokens"]), r["pages"]) for r in p2_templates(spark, str(tmp_path)).collect()}
    assert got == {(("<p>", "apples", "</p>"), 25), (("filed", "by", "agent"), 25)}


def test_line_ends_and_markup_over_lines():
    for end in ("\n", "\r\n", "\r"):
        text = "```sql\nSELECT 1\n```\n\n<h2>Title</h2>\n{{Infobox\n| name = x\n}}\nSome **strong\nwords** here".replace("\n", end)
        assert markup_kinds(text) == ["html", "markdown", "wiki"]
        kinds, clean = clean_text(text)
        assert "    SELECT 1" in clean and "Title" in clean and not any(x in clean for x in ("```", "<h2>", "Infobox", "**"))
    assert markup_kinds('Net <ix:nonFraction unitRef="USD" name="us-gaap:Revenues">12</ix:nonFraction> in all') == ["html"]
    assert markup_kinds("Send to <ir@x.example> at <hh:mm>, 10**6 or\n2**10 of {{ name") == []
    assert markup_kinds("* one\n\nTotals ** of\n\nthe year**") != ["html"]


def test_slots(spark, monkeypatch):
    pages = [(n, "s", f"<html><title>Report</title><div>Filed by agent</div><p class='x'>{w} {w}</p><div>Contact us</div></html>", "q") for n, w in enumerate("ab cd ef gh ij kl".split())]
    pages += [(20, None, "Report ab", "q"), (21, "s", None, "q"), (22, "t", "Report alone", "q"), (23, "s", "。 —", "q"), (24, "s", "", "q")]
    df = spark.createDataFrame(pages, "doc_id bigint, source string, text string, slot_no string")
    got = {}
    for r in template_slots(df, min_pages=5).collect():
        got.setdefault(r["doc_id"], []).append((r["slot_no"], r["after"], r["text"]))
    assert set(got) == set(range(6))
    assert [(a, t) for _, a, t in sorted(got[1])] == [("</title>", "<div>"), ("agent", "</div>"), ("<p>", "cd cd"), ("</p>", "<div>"), ("us", "</div>")]
    assert slots_of("a <b>x</b>", frozenset()) == [] and slots_of("", frozenset({"x"})) == []
    assert slots_of("A <B class='c'>x</b> c y", frozenset({"<b>", "c"})) == [(None, "A"), ("<b>", "x</b>"), ("c", "y")]
    monkeypatch.setattr(markup, "BROADCAST_TOKENS", 0)
    joined = sorted(map(tuple, template_slots(df, min_pages=5).collect()))
    assert joined == sorted((n, k, a, t) for n, rows in got.items() for k, a, t in rows)
    assert template_slots(df.limit(0)).count() == 0
