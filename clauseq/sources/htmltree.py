"""Sections and tables of HTML texts by a parser with a stack: nested containers and tables, numeric entities, tags that are never closed."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from clauseq.sources.html import NUMBER

#: Elements without an end, those nobody reads, and those whose start ends an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset(("script", "style", "nav"))
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main ol p pre section table ul".split())
HEADINGS = ("h2", "h3", "h4", "h5")
#: A start tag closes these, up to the nearest of the others.
CLOSES = {
    "li": (("li",), ("ul", "ol", "table")), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("td", "th", "tr"), ("table",)),
    "thead": (("td", "th", "tr", "thead", "tbody", "tfoot"), ("table",)), "tbody": (("td", "th", "tr", "thead", "tbody", "tfoot"), ("table",)), "tfoot": (("td", "th", "tr", "thead", "tbody", "tfoot"), ("table",)),
    "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
}
#: Machine-made ids, which say nothing in a citation.
GUID = re.compile(r"^_?[0-9a-fA-F]{8}-[0-9a-fA-F-]{27}")
_NUMBER = re.compile(NUMBER)
#: Markup that needs no parser to be told apart: scripts, simple comments and doctypes, end tags, start tags with their attributes. Elements that are left to the tree.
_BLANK = r"[\t\n\r\f ]"
_VALUE = rf"""(?:"[^"<>]*"|'[^'<>]*'|[^\s<>"'=`/&]+)"""
_MARKUP = re.compile(
    rf"""(?ai)<(?:(script|style)(?:{_BLANK}[^<>"'/]*)?>[^<]*(?:<(?!!|/?(?:script|style))[^<]*)*</\1|!doctype[^<>"'-]*|!--(?:(?!--)[^<>])*--|/([a-z][a-z0-9]*){_BLANK}*"""
    rf"""|([a-z][a-z0-9]*)(?:{_BLANK}+[a-z][a-z0-9_-]*(?:{_BLANK}*={_BLANK}*{_VALUE})?)*{_BLANK}*)>"""
)
_TOLD, _PLAIN = frozenset(("body", "table", "caption", "thead", "tr", "td", "th", *HEADINGS)), frozenset("a abbr b code em i q s small span strong sub sup u".split())
_LEFT = frozenset("script style nav title textarea xmp iframe noembed noframes noscript plaintext svg math".split())


class Node:
    __slots__ = ("name", "attrs", "items", "parent")

    def __init__(self, name: str, attrs: dict, parent: Node | None) -> None:
        self.name, self.attrs, self.parent = name, attrs, parent
        self.items: list[Node | str] = []

    def walk(self) -> Iterator[Node | str]:
        """Everything within, in reading order. A stack of its own: containers may be nested as deep as a text is long."""
        stack = list(reversed(self.items))
        while stack:
            x = stack.pop()
            yield x
            if isinstance(x, Node):
                stack.extend(reversed(x.items))

    def all(self, *names: str) -> list[Node]:
        return [x for x in self.walk() if isinstance(x, Node) and x.name in names]

    def inside(self, name: str, end: Node | None = None) -> bool:
        up = self.parent
        while up is not None and up is not end:
            if up.name == name:
                return True
            up = up.parent
        return False

    def text(self, by: str = " ") -> str:
        return by.join(s for x in self.walk() if isinstance(x, str) and (s := x.strip()))

    def line(self) -> str:
        return " ".join(self.text().split())


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ENDS_P:
            self._close(("p",), ("table", "td", "th", "li"))
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        new = Node(tag, dict(attrs), self.at)
        self.at.items.append(new)
        if tag not in VOID:
            self.at = new

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        up = self.at
        while up.parent is not None and up.name != tag:
            # An end tag in a cell ends nothing outside of its table.
            if up.name == "table":
                return
            up = up.parent
        if up.parent is not None:
            self.at = up.parent

    def _close(self, names: tuple, stops: tuple) -> None:
        """Ends the outermost open element of these below the nearest of `stops`."""
        up, found = self.at, None
        while up.parent is not None and up.name not in stops:
            if up.name in names:
                found = up
            up = up.parent
        if found is None and up.parent is not None and up.name in names:
            found = up
        if found is not None:
            self.at = found.parent

    def handle_data(self, data: str) -> None:
        self.at.items.append(data)


def parse(html: str) -> Node:
    """The body of a text, else all of it, without what nobody reads."""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    for x in [tree.root, *(n for n in tree.root.walk() if isinstance(n, Node))]:
        x.items = [i for i in x.items if isinstance(i, str) or i.name not in HIDDEN]
    return next(iter(tree.root.all("body")), tree.root)


def _anchor(heading: Node) -> tuple[str, str]:
    """(anchor, title): the number that the title begins with, else the element's id, if it is no machine's."""
    title, own = heading.line(), heading.attrs.get("id") or ""
    m = _NUMBER.match(title + " ")
    return (m.group(1) if m else "" if GUID.match(own) else own), title


def _cells(row: Node) -> list[str]:
    return [t for c in row.all("th", "td") if (t := c.line())]


def section_rows(html: str, boilerplate: re.Pattern | None = None) -> list[tuple[int, str, str, str]]:
    """(pos, anchor, title, body) of each section with text."""
    out: list[tuple[int, str, str, str]] = []
    pos, anchor, title, lines = 0, "", "", []

    def flush() -> None:
        body = "\n".join(x for x in lines if x)
        if body:
            out.append((pos, anchor, title, body))
        lines.clear()

    for el in parse(html).all(*HEADINGS, "p", "li", "table", "pre"):
        if (el.name != "table" and el.inside("table")) or (el.name != "li" and el.inside("li")) or (el.name == "pre" and el.inside("pre")):
            continue
        if el.name in HEADINGS:
            flush()
            pos += 1
            anchor, title = _anchor(el)
        elif el.name == "table":
            cap = next(iter(el.all("caption")), None)
            lines += [f"Table — {cap.line()}"] if cap is not None and cap.line() else []
            lines += [" | ".join(c) for tr in el.all("tr") if (c := _cells(tr))]
        elif el.name == "pre":
            lines.append(el.text("\n"))
        elif el.name == "li":
            lines.append(f"- {t}" if (t := el.line()) else "")
        elif not (boilerplate and boilerplate.search(el.line())):
            lines.append(el.line())
    flush()
    return out


def _line(texts: list[str]) -> str:
    return " ".join(" ".join(texts).split())


class _Tables:
    """The tables of plain markup in one pass: names of open elements, and the texts of the heading, caption and cell that are open."""

    def __init__(self) -> None:
        self.open: list[str] = []
        self.body = self.heading = self.table = -1
        self.ended = False
        self.texts: list[str] | None = None
        self._afresh()

    def _afresh(self) -> None:
        self.out: list[tuple] = []
        self.pos, self.nth, self.anchor, self.title = 0, 0, "", ""

    def read(self, html: str) -> list[tuple] | None:
        """The rows of table_rows, None where the markup is not plain: tables within tables or headings, hidden parts, tags that the pattern doesn't know."""
        if "\0" in html:
            return None
        parts, stack = _MARKUP.split(html), self.open
        ends, starts = parts[2::4], parts[3::4]
        for i, text in enumerate(parts[::4]):
            if text:
                if "<" in text:
                    return None
                if (self.texts is not None or self.table >= 0 <= self.in_caption) and not text.isspace():
                    text = unescape(text) if "&" in text else text
                    if self.texts is not None:
                        self.texts.append(text)
                    if self.table >= 0 <= self.in_caption:
                        self.caption.append(text)
            if i == len(ends):
                break
            if (name := ends[i]) is not None:
                name = name.lower()
                if stack and stack[-1] == name:
                    if name in _TOLD:
                        self._shrink(len(stack) - 1)
                    else:
                        stack.pop()
                        continue
                else:
                    self._end(name)
            elif (name := starts[i]) is not None:
                name = name.lower()
                if name in _PLAIN:
                    stack.append(name)
                    continue
                if not self._start(name):
                    return None
            if self.ended:
                return self.out
        self._shrink(0)
        return self.out

    def _end(self, name: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k] == name:
                return self._shrink(k)
            if self.open[k] == "table":
                return None

    def _close(self, names: tuple, stops: tuple) -> None:
        found = None
        for k in range(len(self.open) - 1, -1, -1):
            name = self.open[k]
            if name in stops:
                found = k if found is None and name in names else found
                break
            if name in names:
                found = k
        if found is not None:
            self._shrink(found)

    def _start(self, name: str) -> bool:
        if name in _LEFT:
            return False
        if name in ENDS_P and "p" in self.open:
            self._close(("p",), ("table", "td", "th", "li"))
        if name in CLOSES and self.open and self.open[-1] not in CLOSES[name][1]:
            self._close(*CLOSES[name])
        if name == "body" and self.body < 0:
            if self.heading >= 0 or self.table >= 0:
                return False
            self._afresh()
            self.body = len(self.open)
        elif self.table >= 0:
            at = len(self.open)
            if name in ("td", "th"):
                if self.in_row >= 0:
                    self.in_cell, self.texts, self.th = at, [], self.th or name == "th"
            elif name == "tr":
                self.in_row, self.cells, self.th = at, [], False
            elif name == "thead":
                self.in_head, self.heads = at, self.heads + 1
            elif name == "caption" and self.caption is None:
                self.in_caption, self.caption = at, []
            elif name == "table":
                return False
        elif name in HEADINGS or name == "table":
            if self.heading >= 0:
                return False
            if name == "table":
                self.table, self.in_row, self.in_cell, self.in_head, self.in_caption = len(self.open), -1, -1, -1, -1
                self.heads, self.caption, self.rows = 0, None, []
            else:
                self.heading, self.texts = len(self.open), []
        if name not in VOID:
            self.open.append(name)
        return True

    def _shrink(self, size: int) -> None:
        """Only the first `size` open elements stay open."""
        del self.open[size:]
        self.ended = 0 <= size <= self.body
        if self.table >= 0:
            if self.in_cell >= size:
                if cell := _line(self.texts):
                    self.cells.append(cell)
                self.in_cell, self.texts = -1, None
            if self.in_row >= size:
                if self.cells:
                    self.rows.append((self.cells, self.th, self.heads if self.in_head >= 0 else 0))
                self.in_row = -1
            if self.in_head >= size:
                self.in_head = -1
            if self.in_caption >= size:
                self.in_caption = -1
            if self.table >= size:
                self._told()
                self.table = -1
        elif self.heading >= size:
            self.pos, self.nth, self.title = self.pos + 1, 0, _line(self.texts)
            m = _NUMBER.match(self.title + " ")
            self.anchor, self.heading, self.texts = m.group(1) if m else "", -1, None

    def _told(self) -> None:
        columns: list[str] = []
        for cells, _, head in self.rows:
            columns = cells if head == 1 else columns
        rows = []
        for cells, th, head in self.rows:
            if head:
                continue
            if not columns and th:
                columns = cells
            else:
                rows.append(cells)
        if rows:
            self.out.append((self.pos, self.nth, self.anchor, self.title, _line(self.caption or []), columns or [f"Column {i + 1}" for i in range(max(map(len, rows)))], rows, not columns))
            self.nth += 1


def table_rows(html: str) -> list[tuple]:
    """(pos, nth, anchor, title, caption, columns, rows, guessed) of each table with rows that is in no other; plain markup needs no tree."""
    found = _Tables().read(html)
    return tree_rows(html) if found is None else found


def tree_rows(html: str) -> list[tuple]:
    """The same by the tree, for any markup."""
    out, pos, nth, anchor, title = [], 0, 0, "", ""
    for el in parse(html).all(*HEADINGS, "table"):
        if el.inside("table"):
            continue
        if el.name in HEADINGS:
            pos, nth = pos + 1, 0
            anchor, title = _anchor(el)
            anchor = anchor if _NUMBER.match(title + " ") else ""
            continue
        cap, head = next(iter(el.all("caption")), None), next(iter(el.all("thead")), None)
        columns: list[str] = []
        for tr in head.all("tr") if head is not None else ():
            columns = _cells(tr) or columns
        rows = []
        for tr in el.all("tr"):
            cells = _cells(tr)
            if not cells or (head is not None and tr.inside("thead", el)):
                continue
            if not columns and tr.all("th"):
                columns = cells
            else:
                rows.append(cells)
        if rows:
            guessed = not columns
            out.append((pos, nth, anchor, title, cap.line() if cap is not None else "", columns or [f"Column {i + 1}" for i in range(max(map(len, rows)))], rows, guessed))
            nth += 1
    return out


_SECTIONS = [("pos", pa.int32(), "int"), ("anchor", pa.string(), "string"), ("title", pa.string(), "string"), ("body", pa.string(), "string")]
_TABLES = [
    ("pos", pa.int32(), "int"), ("nth", pa.int32(), "int"), ("anchor", pa.string(), "string"), ("title", pa.string(), "string"), ("caption", pa.string(), "string"),
    ("columns", pa.list_(pa.string()), "array<string>"), ("rows", pa.list_(pa.list_(pa.string())), "array<array<string>>"), ("guessed", pa.bool_(), "boolean"),
]


def _each(docs: DataFrame, key: str, html: str, made, fields: list) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                found = [made(t or "") for t in part.column(1).to_pylist()]
                of = pa.array([i for i, rows in enumerate(found) for _ in rows], pa.int64())
                flat = [r for rows in found for r in rows]
                columns = [pa.array([r[k] for r in flat], f[1]) for k, f in enumerate(fields)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(of), *columns], [key, *(f[0] for f in fields)])

    kind = docs.select(key).schema[0].dataType.simpleString()
    return docs.select(key, html).mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"{n} {t}" for n, _, t in fields))


def sections(docs: DataFrame, key: str, html: str, boilerplate: str | None = None) -> DataFrame:
    """One row per section with text: key, pos, anchor (the heading's number, else its id), title, body.

    The body has a line for each paragraph, list item (those within others too),
    preformatted text, and table row; a table within a table gives its rows again.
    Paragraphs that match `boilerplate` go. Paragraphs, items, rows and cells that are not closed end
    where another begins. A null text has no section. Rows are parsed one by one where they are.
    """
    pattern = re.compile(boilerplate) if boilerplate else None
    return _each(docs, key, html, lambda t: section_rows(t, pattern), _SECTIONS)


def tables(docs: DataFrame, key: str, html: str) -> DataFrame:
    """One row per table with rows: key, pos (of its section), nth (in it), anchor, title, caption, columns, rows, guessed.

    The header is the last row of a thead that has text, or else the first row with a `th`,
    or else `Column i` (guessed). Empty cells and rows go. A table within a table is part of it. A
    text of plain markup is read in one pass; only others are made into trees.
    """
    return _each(docs, key, html, table_rows, _TABLES)
