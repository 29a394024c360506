"""Problem 2: markup residue in texts.

The method named for this problem deduces the template that pages of one host share, from tokens with equal occurrence
vectors. ``template_classes`` does that. It cannot find a single stray tag, reference or formula in an otherwise plain
text, nor say what kind of markup a text has, so ``clean_markup`` reads each text by the grammars of the four languages.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Set
from html import unescape
from html.entities import html5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map
from tidemark.plans.registry import Registry, table
from tidemark.session import checkpointed, spread

query = Registry()

# Names of HTML elements.
_TAGS = (
    "a abbr acronym address applet area article aside audio b base basefont bdi bdo big blockquote body br button canvas caption center cite code "
    "col colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 "
    "h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark meta nav noframes noscript object ol optgroup option "
    "output p param picture pre progress q rp rt ruby s samp script section select small source span strike strong style sub summary sup svg table "
    "tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr"
)
# Prefixes of the XML vocabularies that stand in pages of filings.
_PREFIXES = "ix ixt link xlink xbrli xbrldi us-gaap dei svg math xsi o v w"
_BLOCKS = "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend main nav noscript ol option p section select summary table tbody tfoot thead title tr ul br"
_ENTITIES = frozenset(k for k in html5 if k.endswith(";"))

_I, _M = re.IGNORECASE, re.MULTILINE
_ATTRIBUTES = r"(?:\s+[^\s<>=\"'/]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s<>\"']+))?)*\s*/?"
_TAG = re.compile(rf"</?({_TAGS.replace(' ', '|')}|(?:{_PREFIXES.replace(' ', '|')}):[a-z][\w.-]*){_ATTRIBUTES}>", _I)
_TAG_LIKE = re.compile(r"<!--.*?(?:-->|\Z)|<!doctype[^<>]*>|<!\[CDATA\[|<\?xml[^<>]*>", _I | re.S)
_REFERENCE = re.compile(r"&(?:#\d{1,7};|#[xX][0-9a-fA-F]{1,6};|([A-Za-z][A-Za-z0-9]*;))")
_ESCAPED = re.compile(r"&(?:(?:amp|AMP|#0{0,5}38|#[xX]0{0,4}26);)+")
_WIKI_TAG = re.compile(r"</?(?:ref|references|nowiki|syntaxhighlight|gallery|noinclude|includeonly|onlyinclude)(?:\s[^<>]*)?/?>", _I)

_LINE_END = re.compile(r"\r\n?")
_FENCE = re.compile(r"^[ ]{0,3}(`{3,}|~{3,})([^`\n]*)\n(.*?)(?:^[ ]{0,3}\1[`~]*[ \t]*$|\Z)", _M | re.S)
_PRE = re.compile(r"<(pre|code|script|style|syntaxhighlight|nowiki|source|samp|kbd)(\s[^<>]*)?>(.*?)</\1\s*>", _I | re.S)
_VERBATIM = re.compile(r"\\begin\{(verbatim\*?|lstlisting|minted|alltt)\}(.*?)\\end\{\1\}", re.S)
_CODE_SPAN = re.compile(r"(?<!`)(`{1,2})(?!`)([^`\n]+)\1(?!`)")

_MARKDOWN = [
    re.compile(p, _M)
    for p in (
        r"^[ ]{0,3}#{1,6}[ \t]+\S",
        r"^[ \t]{0,3}[^\s=-][^\n]*\r?\n[ ]{0,3}(?:={3,}|-{3,})[ \t]*\r?$",
        r"(?<![\w*\\])(\*{1,3})(?![\s*])[^*\n]*[^*\s](?:\1)(?![\w*])",
        r"(?<![\w_\\])(_{1,3})(?![\s_])[^\n]*?[^_\s\n](?:\1)(?![\w_])",
        r"(?<![\w*\\])\*\*(?![\s*])(?:[^*\n]|\n(?![ \t]*\n))*[^*\s]\*\*(?![\w*])",
        r"(?<![\w_\\])__(?![\s_])(?:[^_\n]|\n(?![ \t]*\n))*[^_\s]__(?![\w_])",
        r"(?<![\w~])~~(?![\s~])[^~\n]*[^~\s]~~(?![\w~])",
        r"!?\[[^\[\]\n]*\]\((?:[^\s()]|\([^\s()]*\))+(?:\s+\"[^\"\n]*\")?\)",
        r"\[[^\[\]\n]+\]\[[^\[\]\n]+\]",
        r"^[ ]{0,3}\[[^\[\]\n]+\]:\s+\S",
        r"^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)+\|?[ \t]*\r?$",
        r"^[ ]{0,3}>[ \t]+\S",
        r"^[ ]{0,3}(?:\*{3}|_{3}|-{3}|\* \* \*|- - -)[ \t]*\r?$",
        r"^[ \t]*(?:[-*+]|\d{1,3}[.)])[ \t]+\S",
    )
]
_WIKI = [
    re.compile(p, _M)
    for p in (
        r"^(={2,6})[^=\n](?:[^\n]*[^=\n])?\1[ \t]*\r?$",
        r"(?<!')('{2,3}|'{5})(?!['\s])[^'\n](?:[^\n]*?[^'\n])?\1(?!')",
        r"\[\[[^\[\]\n]+\]\]",
        r"\{\{[^{}\n]+\}\}",
        r"\{\{[^{}|\n]+\n\s*\|[^{}]*\}\}",
        r"^\{\|",
        r"^\|(?:\}|-(?!-))",
        r"^[;:]+[ \t]*\S",
        r"\[(?:https?:)?//[^\s\[\]]+(?:\s[^\[\]\n]*)?\](?!\()",
        r"__(?:NOTOC|TOC|FORCETOC|NOEDITSECTION)__",
    )
]
_LATEX = [
    re.compile(p, _M)
    for p in (
        r"\\(?:begin|end)\s*\{[a-zA-Z]+\*?\}",
        r"(?<![\w:\\./)])\\[a-zA-Z]+",
        r"\\[a-zA-Z]+\*?(?:\[[^\]\n]*\])?\{",
        r"\\\([^\n]*?\\\)|\\\[.*?\\\]",
        r"\$\$[^$]+\$\$",
        r"(?<![\\\w$])\$(?![\s\d$])[^$\n]*(?<![\s\\])\$(?![\w$])",
        r"(?<![\w:\\])\\[%&$#_{}](?![\w\\])|(?<=\d)\\[%&$]",
    )
]
_MAYBE = re.compile(r"[<&*`\[\]\\{}#~_]|^[ \t]*\d+[.)] |''|==|--|\$[^\d]|^[ \t]*[>:;|+-]", _M)


def _without_code(text: str) -> tuple[str, set[str]]:
    """The text with the contents of code samples taken out, and the kinds of markup that enclosed them."""
    kinds: set[str] = set()

    def gone(kind: str):
        def f(m: re.Match) -> str:
            kinds.add(kind)
            return "\n" if "\n" in m.group() else " "

        return f

    text = _FENCE.sub(gone("markdown"), text)
    text = _VERBATIM.sub(gone("latex"), text)
    text = _PRE.sub(lambda m: gone("wiki" if m[1].lower() in ("syntaxhighlight", "nowiki") else "html")(m), text)
    return _CODE_SPAN.sub(gone("markdown"), text), kinds


def markup_kinds(text: str | None) -> list[str]:
    """The kinds of markup of which a text has a trace, sorted."""
    if not text or not _MAYBE.search(text):
        return []
    text, kinds = _without_code(_LINE_END.sub("\n", text) if "\r" in text else text)
    if "<" in text:
        if _TAG.search(text) or _TAG_LIKE.search(text):
            kinds.add("html")
            text = _TAG.sub(" ", _TAG_LIKE.sub(" ", text))
        if _WIKI_TAG.search(text):
            kinds.add("wiki")
            text = _WIKI_TAG.sub(" ", text)
    if "&" in text and any(m[1] is None or m[1] in _ENTITIES for m in _REFERENCE.finditer(text)):
        kinds.add("html")
    if any(p.search(text) for p in _LATEX):
        kinds.add("latex")
    if any(p.search(text) for p in _WIKI):
        kinds.add("wiki")
    if any(p.search(text) for p in _MARKDOWN):
        kinds.add("markdown")
    return sorted(kinds)


class _Kept:
    """Code and formulas, put aside while the rest is cleaned."""

    def __init__(self) -> None:
        self.parts: list[str] = []

    def __call__(self, part: str) -> str:
        self.parts.append(part)
        return f"\ue000{len(self.parts) - 1}\ue001"

    def back(self, text: str) -> str:
        while (out := re.sub("\ue000(\\d+)\ue001", lambda m: self.parts[int(m[1])], text)) != text:
            text = out
        return text


def _block(code: str) -> str:
    """A code sample as it is, each line set in by four blanks."""
    return "\n\n" + "\n".join("    " + x if x.strip() else "" for x in code.strip("\r\n").split("\n")) + "\n\n"


def _html(text: str, keep: _Kept) -> str:
    text = re.sub(r"<(script|style)(?:\s[^<>]*)?>.*?</\1\s*>", " ", text, flags=_I | re.S)
    text = _TAG_LIKE.sub(" ", text)

    def pre(m: re.Match) -> str:
        if m[1].lower() not in ("pre", "code", "samp", "kbd", "source"):
            return m.group()
        code = unescape(_TAG.sub("", m[3]))
        return keep(_block(code)) if m[1].lower() == "pre" or "\n" in code else keep(code)

    text = _PRE.sub(pre, text)

    def tag(m: re.Match) -> str:
        name, closing = m[1].lower(), m.group()[1] == "/"
        if name == "li":
            return "" if closing else "\n• "
        if name in ("td", "th"):
            return " " if not closing else " | "
        if name in ("tr", "br"):
            return "" if closing and name == "tr" else "\n"
        return "\n\n" if name in _BLOCKS_SET else ""

    while True:  # references may hide tags, however often they are escaped; each round shortens the text
        text = _TAG.sub(tag, _ESCAPED.sub("&", text))
        plain = _REFERENCE.sub(lambda m: unescape(m.group()) if m[1] is None or m[1] in _ENTITIES else m.group(), text)
        if plain == text:
            break
        text = plain
    return re.sub(r"[ ]*\|[ ]*(?=\n|\Z)", "", text)


_BLOCKS_SET = frozenset(_BLOCKS.split())


def _latex(text: str, keep: _Kept) -> str:
    text = re.sub(r"\\begin\{(equation|align|displaymath|gather|math|eqnarray|multline)(\*?)\}(.*?)\\end\{\1\2\}", lambda m: keep("\n" + m[3].strip() + "\n"), text, flags=re.S)
    text = re.sub(r"\\\[(.*?)\\\]|\$\$([^$]+)\$\$", lambda m: keep("\n" + (m[1] or m[2]).strip() + "\n"), text, flags=re.S)
    text = re.sub(r"\\\(([^\n]*?)\\\)", lambda m: keep(m[1].strip()), text)
    text = re.sub(r"(?<![\\\w$])\$(?![\s\d$])([^$\n]*)(?<![\s\\])\$(?![\w$])", lambda m: keep(m[1]), text)
    text = re.sub(r"\\(?:part|chapter|(?:sub)*section|(?:sub)?paragraph)\*?\{([^{}]*)\}", r"\n\n\1\n\n", text)
    text = re.sub(r"~?\\(?:cite[a-z]*|ref|eqref|pageref|label|index)\*?(?:\[[^\]\n]*\])?\{[^{}]*\}", "", text)
    text = re.sub(r"\\begin\{tabular\*?\}(?:\{[^{}]*\})*(.*?)\\end\{tabular\*?\}", lambda m: "\n" + re.sub(r"[ ]*\\\\[ ]*", "\n", re.sub(r"(?<!\\)&", "|", m[1])).replace("\\hline", "") + "\n", text, flags=re.S)
    text = re.sub(r"\\(?:begin|end)\{[a-zA-Z]+\*?\}(?:\[[^\]\n]*\])?", "\n", text)
    text = re.sub(r"\\item\b(?:\[([^\]\n]*)\])?[ \t]*", lambda m: "\n• " + (f"{m[1]} " if m[1] else ""), text)
    while True:  # commands within commands
        plain = re.sub(r"\\[a-zA-Z]+\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}", r"\1", text)
        if plain == text:
            break
        text = plain
    text = re.sub(r"(?<![\w:\\./)])\\[a-zA-Z]+\b[ ]?", "", text)
    return re.sub(r"\\([%&$#_{}])", r"\1", text).replace("~", " ")


def _wiki(text: str) -> str:
    text = re.sub(r"\[\[(?:Category|File|Image):[^\[\]\n]*\]\]", "", text, flags=_I)
    text = re.sub(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]\n]*)\]\]", r"\1", text)
    while True:
        plain = re.sub(r"\{\{[^{}]*\}\}", "", text)
        if plain == text:
            break
        text = plain
    text = re.sub(r"^\{\|[^\n]*$|^\|(?:\}|-(?!-))[^\n]*$", "", text, flags=_M)
    text = re.sub(r"^[|!][ \t]*(?=\S)([^\n]*)$", lambda m: re.sub(r"\s*(?:\|\||!!)\s*", " | ", m[1]), text, flags=_M) if re.search(r"\|\||!!", text) else text
    text = re.sub(r"^(={2,6})[ \t]*([^=\n](?:[^\n]*[^=\n])?)\1[ \t]*\r?$", lambda m: "\n" + m[2].strip() + "\n", text, flags=_M)
    text = re.sub(r"(?<!')('{5}|'{2,3})(?!['\s])([^'\n](?:[^\n]*?[^'\n])?)\1(?!')", r"\2", text)
    text = re.sub(r"\[(?:https?:)?//[^\s\[\]]+(?:\s([^\[\]\n]*))?\](?!\()", lambda m: m[1] or "", text)
    text = re.sub(r"^[;:]+[ \t]*(?=\S)", "", text, flags=_M)
    return re.sub(r"^[*#]+[ \t]+(?=\S)", "• ", _WIKI_TAG.sub("", text), flags=_M)


def _markdown(text: str) -> str:
    text = re.sub(r"^[ ]{0,3}#{1,6}[ \t]+([^\n]*?)[ \t]*#*[ \t]*$", r"\n\1\n", text, flags=_M)
    text = re.sub(r"^([ \t]{0,3}[^\s=-][^\n]*)\r?\n[ ]{0,3}(?:={3,}|-{3,})[ \t]*\r?$", r"\n\1\n", text, flags=_M)
    text = re.sub(r"^[ ]{0,3}(?:\*{3}|_{3}|-{3}|\* \* \*|- - -)[ \t]*\r?$", "", text, flags=_M)
    text = re.sub(r"^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)+\|?[ \t]*\r?\n?", "", text, flags=_M)
    text = re.sub(r"^[ \t]*\|[ \t]*([^\n]*?)[ \t]*\|[ \t]*$", r"\1", text, flags=_M)
    text = re.sub(r"!?\[([^\[\]\n]*)\]\((?:[^\s()]|\([^\s()]*\))+(?:\s+\"[^\"\n]*\")?\)", r"\1", text)
    text = re.sub(r"\[([^\[\]\n]+)\]\[[^\[\]\n]+\]", r"\1", text)
    text = re.sub(r"^[ ]{0,3}\[[^\[\]\n]+\]:\s+\S+[^\n]*$", "", text, flags=_M)
    for p in (r"(?<![\w*\\])(\*\*)(?![\s*])((?:[^*\n]|\n(?![ \t]*\n))*[^*\s])\*\*(?![\w*])", r"(?<![\w_\\])(__)(?![\s_])((?:[^_\n]|\n(?![ \t]*\n))*[^_\s])__(?![\w_])", r"(?<![\w*\\])(\*{1,3})(?![\s*])([^*\n]*[^*\s])\1(?![\w*])", r"(?<![\w_\\])(_{1,3})(?![\s_])([^\n]*?[^_\s\n])\1(?![\w_])", r"(?<![\w~])(~~)(?![\s~])([^~\n]*[^~\s])~~(?![\w~])"):
        text = re.sub(p, r"\2", text)
    text = re.sub(r"^[ ]{0,3}>[ \t]+", "", text, flags=_M)
    return re.sub(r"^([ \t]*)[-*+][ \t]+(?=\S)", r"\1• ", text, flags=_M)


def clean_text(text: str | None) -> tuple[list[str], str | None]:
    """The kinds of markup of a text, and the text without them."""
    kinds = markup_kinds(text)
    if not kinds:
        return kinds, text
    keep = _Kept()
    text = re.sub("[\ue000\ue001]", "", _LINE_END.sub("\n", text))
    text = _FENCE.sub(lambda m: keep(_block(m[3])), text)
    text = _VERBATIM.sub(lambda m: keep(_block(m[2])), text)
    text = _CODE_SPAN.sub(lambda m: keep(m[2]), text)
    if "html" in kinds:
        text = _html(text, keep)
    if "latex" in kinds:
        text = _latex(text, keep)
    if "wiki" in kinds:
        text = _wiki(text)
    if "markdown" in kinds:
        text = _markdown(text)
    text = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+(?=\n)", "", text)).strip("\n")
    return kinds, re.sub(r"\n{3,}", "\n\n", keep.back(text)).strip("\n")


def clean_markup(df: DataFrame, *, id_col: str = "doc_id", text: bool = True) -> DataFrame:
    """``id_col``, ``markup`` (sorted array of html, latex, markdown, wiki) and, if asked for, the clean ``text``.

    Headings stand on lines of their own, list items begin with a bullet, cells are parted by bars, code keeps its
    lines (set in by four blanks) and is never read as markup, formulas keep their source without delimiters. A text
    without markup comes out as it is, a null one null with an empty array. Repeated rows each come out; other columns
    are ignored; an empty table gives an empty result.

    Scale: no shuffle; each text is read whole and on its own.
    """

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column(1).to_pylist()
        found = [clean_text(t) if text else (markup_kinds(t), None) for t in texts]
        columns, names = [b.column(0), pa.array([k for k, _ in found], pa.list_(pa.string()))], ["id", "markup"]
        if text:
            columns, names = [*columns, pa.array([t for _, t in found], pa.string())], [*names, "text"]
        return pa.RecordBatch.from_arrays(columns, names)

    kind = dict(df.dtypes)[id_col]
    out = arrow_map(df.select(id_col, "text"), run, f"id {kind}, markup array<string>" + ", text string" * text)
    return out.withColumnRenamed("id", id_col)


_TOKEN = re.compile(r"</?[A-Za-z][A-Za-z0-9]*|[A-Za-z0-9]+")
_TAG_END = re.compile(r"[^<>]*>")
#: Tokens of classes up to this number are broadcast to the pages; more are joined by a shuffle.
BROADCAST_TOKENS = 100_000


def _named(found: list[str]) -> list[str]:
    return [f"{t}>" if t[0] == "<" else t for t in found]


def _tokens(text: str) -> list[str]:
    found = _TOKEN.findall(text)
    return "\n".join(found).lower().split("\n") if found else []


def _pages(pages: DataFrame, id_col: str, host_col: str) -> DataFrame:
    rows = pages.where(F.col(host_col).isNotNull() & F.col("text").isNotNull())
    return rows.select(F.col(host_col).alias("host"), F.xxhash64(id_col, "text").alias("page"), F.col(id_col).alias("id"), "text")


def _occurrences(rows: DataFrame) -> DataFrame:
    """``host``, ``page``, ``token``, ``c``: how often a page has each of its tokens."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        sizes, tokens, counts = [], [], []
        for text in b.column(2).to_pylist():
            own = Counter(_tokens(text))
            sizes.append(len(own))
            tokens.extend(own)
            counts.extend(own.values())
        which = pa.array(np.repeat(np.arange(len(sizes), dtype=np.int32), sizes))
        columns = [b.column(0).take(which), b.column(1).take(which), pa.array(_named(tokens), pa.string()), pa.array(counts, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, ["host", "page", "token", "c"])

    return arrow_map(rows.select("host", "page", "text"), run, f"host {dict(rows.dtypes)['host']}, page bigint, token string, c int")


Given = Callable[[str, list | None], dict[str, tuple[int, int]]]


def _with_tokens(rows: DataFrame, wanted: DataFrame) -> tuple[DataFrame, Given]:
    """``rows`` with a column ``wanted``, and how a task gets from a host and it to the tokens of the host in ``wanted`` (``host``, ``token``, ``v``) and their classes.

    Up to ``BROADCAST_TOKENS`` of them are broadcast and the column is empty; more are joined to the rows of their host.
    """
    known = wanted.groupBy("host").agg(F.collect_list(F.struct("token", "v.low", "v.high")).alias("wanted"))
    as_dict = lambda tokens: {t["token"]: (t["low"], t["high"]) for t in tokens}
    if wanted.count() > BROADCAST_TOKENS:
        return rows.join(known, "host"), lambda _, tokens: as_dict(tokens)
    sent = rows.sparkSession.sparkContext.broadcast({r["host"]: as_dict(r["wanted"]) for r in known.collect()})
    return rows.withColumn("wanted", F.lit(None).cast("array<struct<token:string,low:bigint,high:bigint>>")), lambda host, _: sent.value.get(host, {})


def _valid(rows: DataFrame, min_pages: int, min_tokens: int) -> DataFrame:
    """Valid classes: ``host``, ``v`` (what a class has in common), its ``tokens`` in order, ``pages``, ``occurrences``, and its mean places ``at`` and ``until``."""
    hashed = _occurrences(rows).withColumn("h", F.xxhash64("page", "c"))
    vector = F.struct(F.sum(F.col("h").bitwiseAND(F.lit(2**32 - 1))).alias("low"), F.sum(F.shiftright("h", 32)).alias("high"))
    tokens = hashed.groupBy("host", "token").agg(vector.alias("v"), F.count(F.lit(1)).alias("pages"), F.sum("c").alias("occurrences"))
    tokens = checkpointed(tokens.where(F.col("pages") >= min_pages))
    sizes = tokens.groupBy("host", "v").agg(F.count(F.lit(1)).alias("size"), F.max("pages").alias("pages"), F.sum("occurrences").alias("occurrences")).where(F.col("size") >= min_tokens)
    members = checkpointed(tokens.select("host", "v", "token").join(sizes, ["host", "v"]))
    asked, given = _with_tokens(rows.select("host", "text"), members)

    def orders(b: pa.RecordBatch) -> pa.RecordBatch:
        """For each page and class on it: the tokens in the order of their first places, whether that of their last ones is the same, and what they span."""
        which, low, high, order, same, at, until = [], [], [], [], [], [], []
        for r, (host, text, wanted) in enumerate(zip(*(b.column(c).to_pylist() for c in range(3)), strict=True)):
            found, classes = _named(_tokens(text)), given(host, wanted)
            own: dict[tuple[int, int], list[str]] = {}
            for t in classes.keys() & set(found):
                own.setdefault(classes[t], []).append(t)
            if own:
                first, last = dict(zip(reversed(found), range(len(found) - 1, -1, -1), strict=True)), dict(zip(found, range(len(found)), strict=True))
            for (a, z), some in own.items():
                by_first, by_last = sorted(some, key=first.__getitem__), sorted(some, key=last.__getitem__)
                which.append(r), low.append(a), high.append(z), order.append(" ".join(by_first)), same.append(by_first == by_last)
                at.append(first[by_first[0]]), until.append(last[by_last[-1]])
        columns = [b.column(0).take(pa.array(which, pa.int32())), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(order, pa.string()), pa.array(same, pa.bool_()), pa.array(at, pa.int64()), pa.array(until, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["host", "low", "high", "order", "same", "at", "until"])

    seen = arrow_map(asked.select("host", "text", "wanted"), orders, f"host {dict(rows.dtypes)['host']}, low bigint, high bigint, order string, same boolean, at bigint, until bigint")
    kept = seen.groupBy("host", "low", "high").agg(F.min("order").alias("order"), F.max("order").alias("other"), F.bool_and("same").alias("same"), F.avg("at").alias("at"), F.avg("until").alias("until"))
    kept = kept.where("order = other AND same").select("host", F.struct("low", "high").alias("v"), F.split("order", " ").alias("tokens"), "at", "until")
    return checkpointed(kept.join(sizes.drop("size"), ["host", "v"]))


def template_classes(pages: DataFrame, *, id_col: str = "doc_id", host_col: str = "source", min_pages: int = 20, min_tokens: int = 3) -> DataFrame:
    """``host``, ``tokens``, ``pages``, ``occurrences``, ``depth``: equivalence classes of tokens over the pages of a host.

    A token is a tag or a word. Tokens of one class
    occur equally often on every page of the host; a class is valid if it has ``min_tokens`` or more on ``min_pages`` or more pages and
    its tokens keep their order on every page, both at their first and at their last places. Classes are nested by what they span: ``depth``
    counts the valid classes of the host that are on all the pages of a class and span it from first to last token. What lies between the tokens
    of a class is content, see ``template_slots``.

    Rows with a null host or text are left out, each other row is a page of its own; an empty table gives an empty result.

    Scale: an occurrence vector is kept as sums of hashes of page and count, and the order of a class as its least and greatest one, which the
    map side combines; no vector and no page of a host is gathered, and pages are read twice rather than shuffled unless classes have more
    tokens than ``BROADCAST_TOKENS``. Only the tokens of the classes of a host, of which there are few, are gathered; ``depth`` compares these classes.
    """
    classes = _valid(_pages(pages, id_col, host_col), min_pages, min_tokens)
    outer = classes.select("host", F.col("v").alias("w"), F.col("at").alias("a"), F.col("until").alias("z"), F.col("pages").alias("p"))
    around = classes.join(outer, "host").where("w <> v AND a < at AND until < z AND p >= pages").groupBy("host", "v").agg(F.count(F.lit(1)).alias("depth"))
    return classes.join(around, ["host", "v"], "left").select("host", "tokens", "pages", "occurrences", F.coalesce("depth", F.lit(0)).alias("depth"))


def slots_of(text: str, template: Set[str]) -> list[tuple[str | None, str]]:
    """The stretches of a text between its template tokens, each with the token before it; blank ones are left out. A tag ends with its bracket.
    A text without such tokens has no slots."""
    tokens = _named(_tokens(text))
    if template.isdisjoint(tokens):
        return []
    starts = [m.start() for m in _TOKEN.finditer(text)]
    out, at, before = [], 0, None
    for k, token in enumerate(tokens):
        if token in template and starts[k] >= at:  # not a word within a tag
            out.append((before, text[at : starts[k]].strip()))
            tag = token[0] == "<"
            end = _TAG_END.match(text, starts[k] + len(token) - 1) if tag else None
            at, before = end.end() if end else starts[k] + len(token) - tag, token
    return [(b, t) for b, t in [*out, (before, text[at:].strip())] if t]


def template_slots(pages: DataFrame, *, id_col: str = "doc_id", host_col: str = "source", min_pages: int = 20, min_tokens: int = 3) -> DataFrame:
    """``id_col``, ``slot_no`` (from 0), ``after``, ``text``: what the pages of a host have in the slots of their template.

    The template of a page are the tokens of the valid classes of its host that are on it (see ``template_classes``); a slot is what stands
    between two of these, ``after`` the token before it (null at the beginning). Pages without such tokens have no slots; what is left out
    is as there.

    Scale: as there; pages are read a third time, with the tokens of their host.
    """
    rows = _pages(pages, id_col, host_col)
    classes = _valid(rows, min_pages, min_tokens)
    asked, given = _with_tokens(rows.select("id", "host", "text"), classes.select("host", "v", F.explode("tokens").alias("token")))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        which, no, after, texts = [], [], [], []
        for r, (host, text, wanted) in enumerate(zip(*(b.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
            for k, (before, slot) in enumerate(slots_of(text, given(host, wanted).keys())):
                which.append(r), no.append(k), after.append(before), texts.append(slot)
        columns = [b.column(0).take(pa.array(which, pa.int32())), pa.array(no, pa.int32()), pa.array(after, pa.string()), pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["id", "slot_no", "after", "text"])

    out = arrow_map(asked.select("id", "host", "text", "wanted"), run, f"id {dict(pages.dtypes)[id_col]}, slot_no int, after string, text string")
    return out.withColumnRenamed("id", id_col)


@query("p2_templates")
def p2_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates of all texts, by source."""
    return template_classes(spread(table(spark, sf_dir, "documents")))


@query("p2_slots")
def p2_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What texts have in the slots of their source's template."""
    return template_slots(spread(table(spark, sf_dir, "documents")))


@query("p2_found")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_markup(spread(table(spark, sf_dir, "documents")), text=False).select("doc_id", F.explode("markup").alias("markup"))


@query("p2_clean")
def p2_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_markup(spread(table(spark, sf_dir, "documents")))
