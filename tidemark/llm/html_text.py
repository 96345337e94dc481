"""HTML extraction: the visible text of a page as its layout shows it.

A small tree builder closes what authors leave open (paragraphs, list items, table cells), a renderer walks
the tree without recursion: hidden elements go, blocks start lines, paragraphs and headings stand apart,
lists carry markers, and the cells of a table line up in columns. Hidden is what the standard hides, attributes
and inline styles hide, or a simple selector of the page's own style sheet does; a closed details element shows
its summary.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Element groups of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript textarea title".split())
HIDDEN = frozenset("head rp script style template noscript title meta link iframe noembed noframes audio video canvas datalist param source track area base annotation annotation-xml".split())
#: Parts of a drawing that describe or define and aren't drawn themselves.
UNDRAWN = frozenset("desc defs metadata symbol".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure fieldset menu hr".split())
BLOCK = SPACED | frozenset("html body div section article aside header footer nav main address form li dt dd tr caption thead tbody tfoot figcaption details summary dialog legend center search hgroup option optgroup".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
#: A start tag ends an open element of these names, unless one of the others stands between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "tr": ({"tr", "td", "th", "caption"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
}
#: Start tags that may stand in a head; any other, and text that isn't blank, ends an open one.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
SCOPE = frozenset("table td th caption button object template html".split())

#: One pass from left to right: a quote that nothing closes runs to the end, and a tag that nothing closes shows nothing.
TOKEN = re.compile(r"<!--(?:.*?-->|.*)|<(?:[!?]|/[^a-zA-Z])[^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?>=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))|[^>=]++|=)*+)(>|\Z)|([^<]++|<)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
BLANKS = re.compile(r"[ \t\n\r\f]+")
#: Rules of a style sheet, without those of at-rules: what a simple selector of a tag, a class or an id hides.
AT_RULE, RULE = re.compile(r"@[^{};]*+(?:;|\{(?:[^{}]*+\{[^{}]*+\})*+[^{}]*+\})|/\*.*?\*/", re.S), re.compile(r"([^{}]*+)\{([^{}]*+)\}")
SELECTOR = re.compile(r"([a-zA-Z][a-zA-Z0-9-]*)?(?:([.#])([\w-]+))?")
#: A table's columns line up unless that takes more than PAD_TIMES its text and PAD_ROOM characters.
PAD_TIMES, PAD_ROOM = 4, 4000


def attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(source):
        out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return out


def hiding(sheet: str) -> list[tuple[str, str, str]]:
    """(tag, kind, name) of the simple selectors whose rule hides what they match; kind is "", "." or "#"."""
    out = []
    for m in RULE.finditer(AT_RULE.sub(" ", sheet)):
        if UNSEEN.search(m[2]):
            found = (SELECTOR.fullmatch(x.strip()) for x in m[1].split(","))
            out += [((x[1] or "").lower(), x[2] or "", x[3] or "") for x in found if x and x[0]]
    return out


class Stack:
    """Open elements, with where each name and each border of scopes stands, so that no search walks the depth."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.at: defaultdict[str, list[int]] = defaultdict(list)
        self.scopes: list[int] = []

    def push(self, tag: str) -> None:
        self.at[tag].append(len(self.names))
        if tag in SCOPE:
            self.scopes.append(len(self.names))
        self.names.append(tag)

    def pop(self) -> str:
        tag = self.names.pop()
        self.at[tag].pop()
        if tag in SCOPE:
            self.scopes.pop()
        return tag

    def last(self, tag: str) -> int:
        return self.at[tag][-1] if self.at[tag] else -1

    def in_scope(self, tag: str) -> int:
        """Where the last open element of a name stands, -1 if a scope ends above it."""
        i = self.last(tag)
        return i if not self.scopes or i >= self.scopes[-1] else -1

    def lowest(self, tags: set[str], until: set[str]) -> int:
        """The lowest element of some names above the last one of others, -1 without one."""
        low = max((self.last(x) for x in until), default=-1)
        found = [self.at[x][k] for x in tags if (k := bisect_right(self.at[x], low)) < len(self.at[x])]
        return min(found, default=-1)


def events(html: str):
    """Balanced ("open", tag, attributes), ("close", tag, None), ("text", words, None), ("style", sheet, None) with implied tags put in."""
    stack = Stack()

    def close_to(i: int):
        while len(stack.names) > i:
            yield "close", stack.pop(), None

    at = 0
    while at < len(html):
        m = TOKEN.match(html, at)
        at = m.end()
        if m[5] is not None:
            words = unescape(m[5])
            if stack.names and stack.names[-1] == "head" and words.strip(" \t\n\r\f"):
                yield from close_to(len(stack.names) - 1)
            yield "text", words, None
        elif m[2] and m[4]:
            tag = m[2].lower()
            if stack.names and stack.names[-1] == "head" and (tag == "br" if m[1] else tag not in IN_HEAD):
                yield from close_to(len(stack.names) - 1)
            if m[1]:
                if stack.at[tag]:
                    i = stack.last(tag) if tag in SCOPE else stack.in_scope(tag)
                    if i >= 0:
                        yield from close_to(i)
                elif tag == "br":
                    yield "open", "br", {}
                    yield "close", "br", None
                continue
            if tag in ENDS_P and (i := stack.in_scope("p")) >= 0:
                yield from close_to(i)
            if tag in CLOSES and (i := stack.lowest(*CLOSES[tag])) >= 0:
                yield from close_to(i)
            yield "open", tag, attributes(m[3]) if m[3].strip(" /\n\t\r\f") else {}
            if tag in VOID:
                yield "close", tag, None
                continue
            stack.push(tag)
            if tag in ("pre", "listing"):  # a line break right after the tag is not part of the text
                at += 2 * html.startswith("\r\n", at) or html.startswith("\n", at)
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at)
                words = html[at : end.start() if end else len(html)]
                if tag == "textarea":
                    yield "text", re.sub(r"^\r?\n", "", unescape(words)), None
                elif tag in ("title", "style"):
                    yield "text" if tag == "title" else "style", unescape(words) if tag == "title" else words, None
                at = end.end() if end else len(html)
                yield from close_to(len(stack.names) - 1)
    yield from close_to(0)


class Flow:
    """Lines under construction: collapsed white space, line breaks, and at most one blank line between blocks."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = self.blank = False
        self.marker = ""

    def text(self, s: str, pre: bool, indent: str) -> None:
        if pre:
            first, *rest = s.replace("\r\n", "\n").split("\n")
            self.put(first, indent)
            for x in rest:
                self.newline(force=True)
                self.put(x, indent)
            return
        parts = BLANKS.split(s)
        for i, x in enumerate(parts):
            self.space |= i > 0
            if x:
                self.put((" " if self.space and self.line else "") + x, indent)
                self.space = False

    def put(self, s: str, indent: str) -> None:
        if not s:
            return
        if not self.line:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            head = indent[: len(indent) - len(self.marker)] + self.marker if self.marker else indent
            self.marker = ""
            self.line.append(head)
        self.line.append(s)

    def newline(self, force: bool = False) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
        elif force:
            self.lines.append("")
        self.line, self.space = [], False

    def done(self) -> list[str]:
        self.newline()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def aligned(rows: list[list[tuple[str, int, int]]]) -> list[str]:
    """Rows of (cell, columns, rows it spans) as lines; each column is as wide as its widest cell of one column.

    Below a cell of several rows its columns stay empty. A cell spans no more columns than the longest row has
    cells. A table that padding would blow up has its cells side by side without.
    """
    most = max((len(row) for row in rows), default=0)
    placed, width, held = [], defaultdict(int), {}
    for k, row in enumerate(rows):
        line, at = [], 0
        for cell, span, down in row:
            while held.get(at, 0) > k:
                line.append((at, 1, None))
                at += 1
            span = min(span, most)
            line.append((at, span, cell))
            if span == 1:
                width[at] = max(width[at], len(cell))
            if down != 1:
                held |= {at + x: k + down if down else len(rows) for x in range(span)}
            at += span
        placed.append(line)
    room = lambda at, span: sum(width[at + x] for x in range(span)) + 3 * (span - 1)
    wide = sum(max(len(c or ""), room(a, n)) + 3 for line in placed for a, n, c in line[:-1])
    pad = wide <= PAD_TIMES * sum(len(c) + 3 for row in rows for c, _, _ in row) + PAD_ROOM
    return [" | ".join((c or "").ljust(room(a, n)) if pad else c for a, n, c in line if pad or c is not None).rstrip() for line in placed]


def rendered(html: str | None) -> str:
    """Visible text of a page; of nothing, an empty text."""
    flows, tables = [Flow()], []
    lists: list[list] = []
    selects: list[list] = []  # whether all options show, and (selected, disabled, words) of each
    drawings = 0
    indent, hidden, pre = [""], 0, 0
    opened: list[tuple] = []
    rules: set[tuple[str, str, str]] = set()
    number = lambda x: int(x) if re.fullmatch(r"[0-9]{1,9}", x) else 1
    for kind, what, attrs in events(html or ""):
        flow = flows[-1]
        if kind == "style":
            rules.update(hiding(what))
            continue
        if kind == "text":
            if not hidden and not (opened and opened[-1][3]):
                flow.text(what, pre > 0, indent[-1])
            continue
        if kind == "open":
            off = what in HIDDEN or (drawings > 0 and what in UNDRAWN) or "hidden" in attrs or (what == "input") or bool(UNSEEN.search(attrs.get("style", ""))) or (what == "dialog" and "open" not in attrs)
            off = off or (bool(opened) and opened[-1][3] and what != "summary")
            if rules and not off:
                names = [("", ""), *((".", x) for x in attrs.get("class", "").split()), ("#", attrs.get("id", ""))]
                off = any((what, *x) in rules or (x[0] and ("", *x) in rules) for x in names)
            shut = what == "details" and "open" not in attrs
            opened.append((what, off, len(indent), shut))
            hidden += off
            if hidden:
                continue
            drawings += what == "svg"
            if what == "select":
                selects.append(["multiple" in attrs or bool(re.fullmatch(r"0*([2-9]|[1-9][0-9]+)", attrs.get("size", ""))), []])
                flows.append(Flow())  # words outside of options don't show
                continue
            if selects and what == "option":
                flows.append(Flow())
                selects[-1][1].append(["selected" in attrs, "disabled" in attrs, attrs.get("label", "")])
                continue
            if selects and what == "optgroup":
                if attrs.get("label"):
                    selects[-1][1].append([False, True, attrs["label"]] if selects[-1][0] else [False, True, ""])
                continue
            if what in BLOCK:
                flow.newline()
                flow.blank |= what in SPACED and not (what in ("ul", "ol", "menu") and lists)
            if what == "br":
                flow.newline(force=True)
            elif what in ("pre", "textarea"):
                pre += 1
            elif what in ("ul", "ol", "menu"):
                start = attrs.get("start", "1")
                lists.append([what == "ol", int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1])
            elif what == "li":
                here = lists[-1] if lists else [False, 1]
                if here[0] and re.fullmatch(r"-?[0-9]{1,9}", attrs.get("value", "")):
                    here[1] = int(attrs["value"])
                flow.marker = f"{here[1]}. " if here[0] else "- "
                here[1] += 1
                indent.append(indent[-1] + " " * len(flow.marker))
            elif what in ("dd", "blockquote"):
                indent.append(indent[-1] + "  ")
            elif what == "table":
                tables.append([])
                indent.append("")
            elif what == "tr" and tables:
                tables[-1].append([])
            elif what in ("td", "th") and tables:
                if not tables[-1]:
                    tables[-1].append([])
                flows.append(Flow())
                tables[-1][-1].append(["", min(1000, number(attrs.get("colspan", ""))) or 1, number(attrs.get("rowspan", ""))])
            continue
        tag, off, depth, _ = opened.pop()
        if hidden:
            hidden -= off
            continue
        drawings -= tag == "svg"
        if tag == "select":
            flows.pop()
            every, options = selects.pop()
            chosen = [x for x in options if x[0]][-1:] or [x for x in options if not x[1]][:1]
            for _, _, words in options if every else chosen:
                if every:
                    flows[-1].newline()
                flows[-1].text(words, False, indent[-1])
            if every:
                flows[-1].newline()
            continue
        if selects and tag in ("option", "optgroup"):
            if tag == "option":
                words = " ".join(x.strip() for x in flows.pop().done() if x.strip())
                selects[-1][1][-1][2] = selects[-1][1][-1][2] or words
            continue
        if tag in ("td", "th") and tables:
            tables[-1][-1][-1][0] = " ".join(x.strip() for x in flows.pop().done() if x.strip())
        elif tag == "table":
            rows = [row for row in tables.pop() if row]
            del indent[depth:]
            flow.newline()
            for line in aligned(rows):
                flow.put(line, indent[-1]) if line.strip() else None
                flow.newline()
        elif tag in ("pre", "textarea"):
            pre -= 1
        elif tag in ("ul", "ol", "menu") and lists:
            lists.pop()
        if tag in BLOCK:
            flow.newline()
            flow.blank |= tag in SPACED and not (tag in ("ul", "ol", "menu") and lists)
            if tag == "li":
                flow.marker = ""
        del indent[depth:]
    return "\n".join(flows[0].done())


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_lines of every page; a null page has an empty text. Other columns stay behind.

    Each page is read whole from left to right, in time and room that follow its length. Equal pages get equal
    texts, an empty table none.
    """
    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType())])

    def render(batches):
        for batch in batches:
            texts = [rendered(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([x.count("\n") + 1 if x else 0 for x in texts], pa.int64())], schema.names)

    return pages.select("page_id", "url", "html").mapInArrow(render, schema)
