"""Filing HTML as text, with the standard library's parser: one pass, with a stack of open tables."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

# Elements whose end breaks the line, elements that are dropped, and what makes a table one of figures.
BREAKING = frozenset("p div br tr td th li h1 h2 h3 h4 h5 h6 section table".split())
DROPPED = frozenset(("script", "style", "noscript"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MIN_ROWS, MIN_COLS, MIN_CELLS, NUMERIC_SHARE = 3, 2, 6, 0.30
FIGURE = re.compile(r"^[\s$(\[]*[\d,.]+[\s%)\]]*$|^\s*[—–\-$%()]+\s*$")
#: What an opening tag closes although nothing says so.
_CLOSES = {"td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "li": ("li",), "p": ("p",)}
_SCOPE = frozenset(("table", "ul", "ol", "div", "body"))


def is_data_table(rows: int, cols: int, cells: list[str]) -> bool:
    """A grid of mostly figures: enough rows, columns and filled cells, and enough of these numeric."""
    filled = [c for c in cells if c.strip()]
    if rows < MIN_ROWS or cols < MIN_COLS or len(filled) < MIN_CELLS:
        return False
    return sum(FIGURE.match(c) is not None for c in filled) >= NUMERIC_SHARE * len(filled)


def placeholder(rows: int, cols: int) -> str:
    return f"[TABLE: {rows} rows x {cols} cols]"


def collapse(text: str) -> str:
    """Single blanks, no blanks around line ends, at most one empty line, nothing outside."""
    text = re.sub("[ \t\xa0  ]+", " ", text)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]*\n[ \t]*", "\n", text)).strip()


@dataclass
class _Table:
    out: list[str] = field(default_factory=list)
    #: For each row its cells; an inner layout table leaves its rows and cells to the outer one.
    widths: list[int] = field(default_factory=list)
    cells: list[list[str]] = field(default_factory=list)
    open_cells: list[list[str]] = field(default_factory=list)


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.base = _Table()
        self.tables: list[_Table] = []
        self.open: list[str] = []
        self.dropping = 0

    @property
    def now(self) -> _Table:
        return self.tables[-1] if self.tables else self.base

    def write(self, text: str) -> None:
        self.now.out.append(text)
        for cell in self.now.open_cells:
            cell.append(text)

    def handle_data(self, data: str) -> None:
        if not self.dropping:
            self.write(data)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in DROPPED:
            self.dropping += 1
            return
        if self.dropping:
            return
        while (closes := _CLOSES.get(tag)) and (inner := next((t for t in reversed(self.open) if t in closes or t in _SCOPE), None)) in closes:
            self.finish(inner)
        if tag in VOID:
            if tag in BREAKING:
                self.write("\n")
            return
        self.open.append(tag)
        if tag == "table":
            self.tables.append(_Table())
        elif tag == "tr" and self.tables:
            self.now.widths.append(0)
        elif tag in ("td", "th") and self.tables:
            if self.now.widths:
                self.now.widths[-1] += 1
            self.now.cells.append([])
            self.now.open_cells.append(self.now.cells[-1])

    def handle_endtag(self, tag: str) -> None:
        if tag in DROPPED:
            self.dropping = max(0, self.dropping - 1)
        elif not self.dropping and tag in self.open:
            self.finish(tag)
        elif not self.dropping and tag == "br":
            self.write("\n")

    def finish(self, tag: str) -> None:
        """Close everything down to the innermost ``tag``."""
        while self.open:
            top = self.open.pop()
            if top == "table":
                self.finish_table()
            elif top in ("td", "th") and self.tables and self.now.open_cells:
                self.now.open_cells.pop()
            if top in BREAKING:
                self.write("\n")
            if top == tag:
                return

    def finish_table(self) -> None:
        t = self.tables.pop()
        rows, cols, cells = len(t.widths), max(t.widths, default=0), ["".join(c) for c in t.cells]
        if is_data_table(rows, cols, cells):
            self.write(f"\n{placeholder(rows, cols)}\n")
            return
        self.write("".join(t.out))
        if self.tables:
            if self.now.widths:
                self.now.widths[-1] += sum(t.widths)
            self.now.widths.extend(t.widths)
            self.now.cells.extend(t.cells)


def text_of(raw: str | bytes | None) -> str | None:
    """The text of a page: blocks on lines of their own, layout tables unwrapped, tables of figures as placeholders."""
    if raw is None:
        return None
    reader = _Reader()
    reader.feed(raw.decode("utf-8", "ignore") if isinstance(raw, bytes) else raw)
    reader.close()
    while reader.open:
        reader.finish(reader.open[-1])
    return collapse("".join(reader.base.out))


class _Rows(HTMLParser):
    """The tables of a page as rows of cell texts, with the class of each table. Inner tables come after outer ones."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[tuple[str, list[list[str]]]] = []
        self.stack: list[int] = []
        self.in_cell = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.tables.append((dict(attrs).get("class") or "", []))
            self.stack.append(len(self.tables) - 1)
        elif tag == "tr" and self.stack:
            self.tables[self.stack[-1]][1].append([])
        elif tag in ("td", "th") and self.stack and self.tables[self.stack[-1]][1]:
            self.tables[self.stack[-1]][1][-1].append("")
            self.in_cell = True

    def handle_endtag(self, tag: str) -> None:
        if tag == "table" and self.stack:
            self.stack.pop()
        elif tag in ("td", "th", "tr"):
            self.in_cell = False

    def handle_data(self, data: str) -> None:
        if self.in_cell and self.stack and (rows := self.tables[self.stack[-1]][1]) and rows[-1]:
            rows[-1][-1] += data


def table_rows(raw: str | bytes) -> list[tuple[str, list[list[str]]]]:
    reader = _Rows()
    reader.feed(raw.decode("utf-8", "ignore") if isinstance(raw, bytes) else raw)
    reader.close()
    return [(name, [[" ".join(c.split()) for c in row] for row in rows]) for name, rows in reader.tables]


def exhibit_names(index_html: str | bytes) -> list[str]:
    """Files that the HTML index of a filing lists as its annual report, found by the names of the columns."""
    for name, rows in table_rows(index_html):
        head = [c.lower() for c in rows[0]] if rows else []
        if "tableFile" in name and {"document", "type"} <= set(head):
            doc, kind = head.index("document"), head.index("type")
            full = [r for r in rows[1:] if len(r) > max(doc, kind) and r[doc]]
            return [r[doc].split()[0] for r in full if re.match(r"EX-13(?:\.\d+)?$", r[kind], re.IGNORECASE)]
    return []


# Fixed value: titled entries that make a table one of contents.
MIN_ENTRIES = 8


def outline(raw: str | bytes) -> list[tuple[str, bool]]:
    """The titles of the first table of contents, and of each whether it heads a group, having no page of its own.

    Pages stand before or behind the titles of a table, whichever is more common in it.
    """
    number = lambda c: c.isdigit() and len(c) <= 3
    for _, rows in table_rows(raw):
        rows = [[c for c in row if c] for row in rows]
        pages = [[number(c) for c in row] for row in rows]
        left = sum(a and not b for p in pages for a, b in zip(p, p[1:], strict=False))
        right = sum(b and not a for p in pages for a, b in zip(p, p[1:], strict=False))
        entries = []
        for row, page in zip(rows, pages, strict=True):
            beside = [False, *page[:-1]] if left >= right else [*page[1:], False]
            entries += [(c, not b) for c, own, b in zip(row, page, beside, strict=True) if not own and len(c) >= 3]
        if sum(not group for _, group in entries) >= MIN_ENTRIES:
            return entries
    return []
