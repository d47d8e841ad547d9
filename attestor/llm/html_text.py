"""Layout-aware text of HTML pages, and the query op9.

A tokenizer feeds a tree builder that keeps the stack of open elements, closes what a tag implies (a paragraph before
a block, a list item before the next one, table parts) and ignores stray end tags. Visibility is inherited: head,
script, style, templates, `hidden`, display:none and visibility:hidden show nothing. What is visible is laid out:
blocks on lines of their own, paragraphs with a blank line, lists with markers and indents, preformatted text as it
stands, and tables with their cells aligned in columns.

Defined cases: null and empty pages give an empty text; text without tags is one paragraph; unclosed elements end with
the page, unknown elements are inline; repeated rows each get their row; an empty table gives no rows; only the id and
the page are read. Nesting is kept on a list, so that a page of any depth is laid out.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template title noscript iframe noembed noframes datalist object audio video canvas svg".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul".split()
)
#: Blocks with a blank line around them.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure".split())
#: What a start tag closes, up to the element that bounds the search.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
}
BOUNDS_P = frozenset("td th caption button table template".split())
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACE = re.compile(r"[ \t\n\f\r]+")


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("start"|"end"|"text", name or text, attributes)."""
    at = 0
    while at < len(page):
        m = TAG.search(page, at)
        if m is None:
            yield "text", html.unescape(page[at:]), ""
            return
        if m.start() > at:
            yield "text", html.unescape(page[at : m.start()]), ""
        at = m.end()
        if name := (m[2] or "").lower():
            yield ("end" if m[1] else "start"), name, m[3] or ""
            if name in RAW and not m[1]:
                close = re.compile(rf"</{name}(?=[\s/>])[^>]*>|\Z", re.I).search(page, at)
                text = page[at : close.start()]
                yield "text", html.unescape(text) if name in ("textarea", "title") else text, ""
                yield "end", name, ""
                at = close.end()


def hides(name: str, attributes: str) -> bool:
    if name in UNSEEN:
        return True
    if not attributes:
        return False
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    return "hidden" in found or bool(HIDING.search(found.get("style", ""))) or (name == "input" and found.get("type", "").lower() == "hidden")


def events(page: str) -> Iterator[tuple[str, str, bool]]:
    """The tree in document order: ("open", name, _), ("text", text, _), ("close", name, _), visible parts only."""
    stack: list[tuple[str, bool]] = []
    opened: Counter[str] = Counter()  # of the stack, so that what is not open is not searched for

    def close_to(depth: int) -> Iterator[tuple[str, str, bool]]:
        while len(stack) > depth:
            name, unseen = stack.pop()
            opened[name] -= 1
            if not unseen:
                yield "close", name, True

    def innermost(names, bounds) -> int | None:
        if not any(opened[x] for x in names):
            return None
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                return i
            if stack[i][0] in bounds:
                return None
        return None

    for kind, name, attributes in tokens(page):
        if kind == "text":
            if not (stack and stack[-1][1]):
                yield "text", name, True
        elif kind == "start":
            if name in IMPLIED:
                closes, bounds = IMPLIED[name]
                while (i := innermost(closes, bounds)) is not None:
                    yield from close_to(i)
            elif name in BLOCK and (i := innermost({"p"}, BOUNDS_P)) is not None:
                yield from close_to(i)
            if name == "body" and (i := innermost({"head"}, ())) is not None:
                yield from close_to(i)
            unseen = bool(stack and stack[-1][1]) or hides(name, attributes)
            if name in VOID or attributes.endswith("/") and name in ("svg", "path"):
                if not unseen:
                    yield "open", name, True
                    yield "close", name, True
            else:
                stack.append((name, unseen))
                opened[name] += 1
                if not unseen:
                    yield "open", name, True
        else:
            bounds = {"table"} if name not in ("table", "html", "body") else ()
            if (i := innermost({name}, bounds)) is not None:
                yield from close_to(i)
            elif name in ("p", "br"):
                yield "open", name, True
                yield "close", name, True
    yield from close_to(0)


@dataclass
class Box:
    """Laid-out lines of a page or of a cell; blank: blank lines owed before the next text."""

    lines: list[str] = field(default_factory=list)
    now: str = ""
    started: bool = False
    blank: int = 0
    gap: bool = False
    indent: str = ""
    marker: str = ""

    def text(self, text: str, keep: bool) -> None:
        if keep:
            for i, part in enumerate(text.split("\n")):
                if i:
                    self.end_line(True)
                if part:
                    self._put(part)
            return
        flat = SPACE.sub(" ", text)
        if flat.startswith(" "):
            self.gap = True
        if core := flat.strip(" "):
            self._put((" " if self.gap and self.started and not self.now.endswith(" ") else "") + core)
            self.gap = flat.endswith(" ")

    def _put(self, text: str) -> None:
        if not self.started:
            if self.lines and self.blank and self.lines[-1]:
                self.lines.append("")
            self.blank = 0
            self.now = self.indent + self.marker
            self.marker = ""
            self.started = True
        self.now += text

    def end_line(self, forced: bool = False) -> None:
        if self.started or forced:
            self.lines.append(self.now.rstrip(" ") if self.started else "")
        self.now, self.started, self.gap = "", False, False

    def add(self, lines: list[str]) -> None:
        self.end_line()
        if lines:
            if self.lines and self.blank and self.lines[-1]:
                self.lines.append("")
            self.blank = 0
            self.lines += [(self.indent + x).rstrip() for x in lines]

    def done(self) -> list[str]:
        self.end_line()
        lines = self.lines
        while lines and not lines[-1]:
            lines.pop()
        while lines and not lines[0]:
            lines.pop(0)
        return lines


def width(text: str) -> int:
    """Columns that a text takes: wide characters two, combining ones none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def aligned(rows: list[list[list[str]]]) -> list[str]:
    """Rows of cells (lists of lines) with columns of equal width and a bar between them."""
    columns = max(map(len, rows), default=0)
    wide = [max((width(x) for r in rows if i < len(r) for x in r[i]), default=0) for i in range(columns)]
    out = []
    for row in rows:
        for k in range(max((len(c) for c in row), default=0)):
            cells = [c[k] if k < len(c) else "" for c in row]
            out.append(" | ".join(x + " " * (wide[i] - width(x)) for i, x in enumerate(cells)).rstrip())
    return out


def render(page: str) -> str:
    boxes, tables, lists, keep = [Box()], [], [], 0
    for kind, name, _ in events(page):
        box = boxes[-1]
        if kind == "text":
            box.text(name, keep > 0)
            continue
        opening = kind == "open"
        if name == "br":
            if opening:
                box.end_line(True)
        elif name == "hr":
            if opening:
                box.end_line()
        elif name == "table":
            if opening:
                box.end_line()
                box.blank = 1
                tables.append([])
            elif tables:
                rows = [r for r in tables.pop() if any(r)]
                box.add(aligned(rows))
                box.blank = 1
        elif name == "tr" and tables:
            if opening:
                tables[-1].append([])
        elif name in ("td", "th") and tables:
            if opening:
                if not tables[-1]:
                    tables[-1].append([])
                boxes.append(Box())
            elif len(boxes) > 1:
                tables[-1][-1].append(boxes.pop().done())
        elif name in ("ul", "ol", "menu"):
            box.end_line()
            if opening:
                box.blank = box.blank or int(not lists)
                lists.append([name, 0])
            elif lists:
                lists.pop()
                box.blank = box.blank or int(not lists)
        elif name == "li":
            box.end_line()
            if opening:
                if lists:
                    lists[-1][1] += 1
                ordered = lists and lists[-1][0] == "ol"
                box.indent = "  " * max(0, len(lists) - 1)
                box.marker = f"{lists[-1][1]}. " if ordered else "- "
            else:
                box.indent, box.marker = "  " * max(0, len(lists) - 1) if len(lists) > 1 else "", ""
        elif name in BLOCK or name in ("caption", "tr", "td", "th"):
            box.end_line()
            if name in SPACED:
                box.blank = 1
            if name == "pre":
                keep += 1 if opening else -1
    while len(boxes) > 1:
        lines = boxes.pop().done()
        boxes[-1].add(lines)
    return "\n".join(boxes[0].done())


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, text, n_chars, n_lines) for each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [render(x or "") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64())],
                ["page_id", "text", "n_chars", "n_lines"],
            )

    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
    return pages.mapInArrow(run, "page_id long, text string, n_chars long, n_lines long")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(documents(spark, sf_dir, "pages"))
