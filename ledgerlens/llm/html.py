"""Layout-aware HTML rendering: a tree builder with implied tags, visibility rules, and block layout of text.

The builder follows the usual implied-tag rules (a paragraph ends where a block begins, list items, table cells and
rows end their like, void elements take no content, raw-text elements end at their end tag). Rendering drops what a
browser would not show (head, script, style, template, hidden and aria-hidden elements, display:none), keeps the spacing
of blocks, numbers or bullets list items by depth, aligns the cells of tables, and keeps preformatted text as it is.
One pass over a page's tokens; a search up the open elements only starts where its end is open. Elements may nest at any
depth, and a cell keeps its place in all rows and columns that it spans.
"""

from __future__ import annotations

import html as entities
import re
import sys
import unicodedata
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerlens.llm.common import by_batch

# Fixed values of the HTML language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript title meta link base iframe object embed defs symbol desc metadata canvas audio video datalist noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table ul".split())
SPACED = frozenset("p blockquote dl figure h1 h2 h3 h4 h5 h6 hr ol ul menu pre table fieldset".split())
TABLE_PARTS = frozenset("table thead tbody tfoot tr td th caption colgroup".split())
#: An element that is begun ends the nearest open one of these, if no scope stands between them.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "optgroup": ("option", "optgroup"),
    "tr": ("tr", "td", "th", "caption", "colgroup"), "td": ("td", "th"), "th": ("td", "th"),
    "thead": ("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"), "tbody": ("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"),
    "tfoot": ("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"), "rp": ("rp", "rt"), "rt": ("rp", "rt"),
}
SCOPES = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "option": ("select",), "optgroup": ("select",)}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_HIDDEN = re.compile(r"(?:^|[;\s])(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)|content-visibility\s*:\s*hidden)", re.I)
MOST_COLUMNS, MOST_ROWS = 1000, 65534  # fixed values of the HTML language: what a cell can span


def width(text: str) -> int:
    """Columns that a text takes; wide characters take two, combining ones none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def hidden(tag: str, attributes: str) -> bool:
    if tag in UNSEEN:
        return True
    if not attributes or ("hid" not in attributes.lower() and "none" not in attributes.lower() and "collapse" not in attributes.lower()):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), next((x for x in m.groups()[1:] if x is not None), "")
        if name == "hidden" and value.lower() != "until-found" or name == "aria-hidden" and value.strip().lower() == "true":
            return True
        if name == "style" and _HIDDEN.search(entities.unescape(value)):
            return True
        if name == "type" and tag == "input" and value.lower() == "hidden":
            return True
    return False


class Node:
    __slots__ = ("attributes", "children", "tag")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children = tag, attributes, []


def parse(source: str) -> Node:
    """The tree of a page; text nodes are strings."""
    root = Node("#root")
    stack, at, n = [root], 0, len(source)
    count: Counter = Counter()  # open elements by tag, so that a search up the stack only starts where it can end

    def cut(i: int) -> None:
        for x in stack[i:]:
            count[x.tag] -= 1
        del stack[i:]

    def close(tags: tuple, scope: tuple) -> None:
        i = len(stack) - 1
        while i > 0 and any(count[t] for t in tags) and stack[i].tag not in scope:
            if stack[i].tag in tags:
                cut(i)
            i = min(i, len(stack)) - 1

    while at < n:
        m = _TOKEN.search(source, at)
        if not m:
            stack[-1].children.append(entities.unescape(source[at:]))
            break
        if m.start() > at:
            stack[-1].children.append(entities.unescape(source[at : m.start()]))
        at = m.end()
        if m[2]:
            tag, attributes = m[2].lower(), m[3]
            if tag in BLOCK and stack[-1].tag == "p":
                cut(-1)
            elif tag in BLOCK and count["p"]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == "p":
                        cut(i)
                        break
                    if stack[i].tag in BLOCK or stack[i].tag in TABLE_PARTS:
                        break
            if tag in CLOSES:
                close(CLOSES[tag], SCOPES.get(tag, ("table",)))
            elif tag[0] == "h" and len(tag) == 2 and tag[1] in "123456" and stack[-1].tag[0] == "h" and stack[-1].tag[1:] in "123456" and len(stack[-1].tag) == 2:
                cut(-1)
            if tag == "body" and stack[-1].tag == "head":
                cut(-1)
            node = Node(tag, attributes)
            stack[-1].children.append(node)
            if tag in VOID or attributes.endswith("/") and (tag in ("svg", "math") or count["svg"] or count["math"]):
                continue
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
                node.children.append(source[at : end.start() if end else n])
                at = end.end() if end else n
            else:
                stack.append(node)
                count[tag] += 1
        elif m[1]:
            tag = m[1].lower()
            if tag == "p" and not count["p"]:
                stack[-1].children.append(Node("p"))
            scope = ("table",) if tag not in TABLE_PARTS else ()
            for i in range(len(stack) - 1, 0 if count[tag] else len(stack), -1):
                if stack[i].tag == tag:
                    cut(i)
                    break
                if stack[i].tag in scope or stack[i].tag in ("td", "th") and tag not in TABLE_PARTS:
                    break
        elif m.group() == "<":
            stack[-1].children.append("<")
    return root


class Lines:
    """Text as it is laid out: inline runs with collapsed spaces, breaks, and blank lines between spaced blocks."""

    def __init__(self):
        self.done: list[str] = []
        self.run: list[str] = []
        self.blank = False

    def text(self, s: str, pre: bool = False) -> None:
        if pre:
            parts = s.split("\n")
            for i, p in enumerate(parts):
                if i:
                    self.flush(keep=True)
                if p:
                    self.run.append(p)
            return
        s = _SPACE.sub(" ", s)
        if s[:1] == " " and (not self.run or self.run[-1][-1:] == " "):
            s = s[1:]
        if s:
            self.run.append(s)

    def flush(self, keep: bool = False) -> None:
        line = "".join(self.run)
        line = line.rstrip() if keep else line.strip(" ")
        self.run.clear()
        if line or keep:
            self.put(line)

    def put(self, line: str) -> None:
        if self.blank and self.done:
            self.done.append("")
        self.blank = False
        self.done.append(line)

    def gap(self) -> None:
        self.flush()
        self.blank = bool(self.done)


def render(node: Node) -> str:
    # calls between Python functions are kept on the heap, so pages may nest as deep as they like
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 10_000_000))
    out = Lines()
    _blocks(node, out, 0, False)
    out.flush()
    return "\n".join(line.rstrip() for line in out.done).strip("\n")


def _blocks(node: Node, out: Lines, depth: int, pre: bool, order: list | None = None) -> None:
    for c in node.children:
        if isinstance(c, str):
            out.text(c, pre)
            continue
        tag = c.tag
        if hidden(tag, c.attributes):
            continue
        if tag == "br":
            out.flush(keep=True) if pre or out.run else out.put("")
        elif tag == "hr":
            out.gap()
            out.put("---")
            out.gap()
        elif tag == "img":
            alt = next((m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(c.attributes) if m[1].lower() == "alt"), "")
            if alt:
                out.text(entities.unescape(alt))
        elif tag == "table":
            out.gap()
            for line in _table(c, depth):
                out.put(line)
            out.gap()
        elif tag in ("ul", "ol", "menu", "dir"):
            out.gap() if depth == 0 else out.flush()
            _blocks(c, out, depth + 1, pre, [1] if tag == "ol" else None)
            out.gap() if depth == 0 else out.flush()
        elif tag == "li":
            out.flush()
            mark = "- "
            if order:
                mark, order[0] = f"{order[0]}. ", order[0] + 1
            inner = Lines()
            _blocks(c, inner, max(depth, 1), pre)
            inner.flush()
            lines = inner.done or [""]
            out.put((mark + lines[0]).rstrip())
            for line in lines[1:]:
                out.put(" " * len(mark) + line if line else "")
        elif tag in BLOCK:
            out.gap() if tag in SPACED else out.flush()
            _blocks(c, out, depth, pre or tag == "pre")
            if (pre or tag == "pre") and out.run:
                out.flush(keep=True)
            out.gap() if tag in SPACED else out.flush()
        else:
            if tag in ("td", "th"):
                out.text(" ")
            _blocks(c, out, depth, pre or tag in ("textarea", "xmp"))


def _span(cell: Node, name: str, most: int) -> int:
    value = next((m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(cell.attributes) if m[1].lower() == name), "").strip()
    if not (value.isascii() and value.isdigit()):
        return 1
    return min(int(value[:9]), most) or (most if name == "rowspan" else 1)  # no number of rows: all that follow


def _rows(table: Node) -> tuple[list[str], list[dict[int, str]]]:
    """Caption lines and each row's cells by column; a cell's lines are joined by spaces, and what a cell spans stays empty."""
    captions, rows = [], []
    held: dict[int, int] = {}  # columns that cells from above still take, and for how many rows
    todo = list(reversed(table.children))
    while todo:
        c = todo.pop()
        if isinstance(c, str):
            if c.strip():
                captions.append(_SPACE.sub(" ", c).strip())
            continue
        if hidden(c.tag, c.attributes):
            continue
        if c.tag == "caption":
            captions += [x for x in render(c).split("\n") if x]
        elif c.tag == "tr":
            cells, column, below = {}, 0, {}
            for d in c.children:
                if isinstance(d, str) and not d.strip() or not isinstance(d, str) and hidden(d.tag, d.attributes):
                    continue
                while column in held:
                    column += 1
                if isinstance(d, str):
                    cells[column] = _SPACE.sub(" ", d).strip()
                    column += 1
                    continue
                cells[column] = " ".join(x.strip() for x in render(d).split("\n") if x.strip())
                wide, high = _span(d, "colspan", MOST_COLUMNS), _span(d, "rowspan", MOST_ROWS)
                if high > 1:
                    below |= dict.fromkeys(range(column, column + wide), high - 1)
                column += wide
            held = {k: n - 1 for k, n in held.items() if n > 1} | below
            rows.append(cells)
        elif c.tag in ("thead", "tbody", "tfoot"):
            held = {}
            todo += reversed(c.children)
        elif c.tag not in ("colgroup", "col"):
            text = render(c)
            if text:
                captions += text.split("\n")
    return captions, rows


def _table(table: Node, depth: int) -> list[str]:
    captions, rows = _rows(table)
    wide: dict[int, int] = {}
    for r in rows:
        for i, cell in r.items():
            wide[i] = max(wide.get(i, 0), width(cell))
    columns = sorted(wide)
    lines = []
    for r in rows:
        last = max((i for i, cell in r.items() if cell), default=-1)
        if last >= 0:
            cells = [r.get(i, "") for i in columns if i < last]
            lines.append(" | ".join([cell + " " * (wide[i] - width(cell)) for i, cell in zip(columns, cells, strict=False)] + [r[last]]))
    return captions + lines


def title_of(root: Node) -> str:
    todo = [root]
    while todo:
        n = todo.pop()
        if n.tag == "title":
            return _SPACE.sub(" ", entities.unescape("".join(c for c in n.children if isinstance(c, str)))).strip()
        todo += reversed([c for c in n.children if not isinstance(c, str) and c.tag in ("html", "head", "title", "body")])
    return ""


def extract(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Title and visible text of each whole page: key, title, text, n_chars, n_lines. One row per input row, no shuffle.

    Null and empty pages give empty strings. Broken markup never fails: what is left open is closed at the end.
    Repeated rows give equal rows; columns other than the two named are not read; an empty table gives no rows.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        titles, texts = [], []
        for h in batch.column(1).to_pylist():
            root = parse(h or "")
            titles.append(title_of(root))
            texts.append(render(root))
        return pa.record_batch(
            [batch.column(0), pa.array(titles, pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64())],
            names=[key, "title", "text", "n_chars", "n_lines"],
        )

    return by_batch(pages.select(key, html), run, f"`{key}` {dict(pages.dtypes)[key]}, title string, text string, n_chars long, n_lines long")
