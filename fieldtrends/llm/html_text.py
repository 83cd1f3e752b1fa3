"""HTML extraction by layout-aware rendering.

A tokenizer feeds a tree builder that supplies implied end tags; the tree is rendered as a reader would see it:
hidden and non-content elements are left out, blocks stand on lines of their own, list items have bullets or
numbers, preformatted text keeps its spaces, and the cells of a table are aligned in columns. All visible text
is kept: navigation, headers and footers too, the text of drawings and formulas as well.

What is visible follows ``display`` and the inherited ``visibility`` of inline styles and of the page's own style
sheets (selectors of one element: type, classes, id; not those with combinators or inside @-blocks), the ``hidden``
attribute, and the states of ``dialog`` and ``details``.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from fieldtrends.llm.common import map_batches

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript iframe noembed noframes title meta link base object embed audio video canvas datalist annotation annotation-xml".split())
UNDRAWN = frozenset("defs symbol clippath mask pattern marker metadata desc lineargradient radialgradient filter".split())
BLOCKS = frozenset((
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre search section summary table tbody td tfoot th thead tr ul xmp caption").split())
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre table ul".split())
CLOSES_P = BLOCKS - frozenset("body html caption tbody td tfoot th thead tr dd dt li option optgroup legend summary".split()) | {"li", "dd", "dt"}
#: An opening tag ends these open elements, up to the boundary elements.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
IN_HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
FOREIGN = frozenset("svg math".split())
SCOPE = frozenset("td th table caption button html".split())

# A tag, comment or quoted value that never ends takes the rest of the page, so each character is read once.
# A quote opens a value only right after "="; anywhere else it is part of a name or of an unquoted value.
NAME, VALUE = r"[^ \t\n\r\f/>][^ \t\n\r\f/>=]*+", r"[ \t\n\r\f]*+=[ \t\n\r\f]*+"
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)"
    rf"((?:[ \t\n\r\f/]++|{NAME}(?:{VALUE}(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^ \t\n\r\f>]*+))?+)*+)(?:>|\Z)", re.DOTALL)
ATTRIBUTE = re.compile(rf"({NAME})(?:{VALUE}(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^ \t\n\r\f>]*+)))?+")
WHITE = re.compile(r"[ \t\n\r\f]+")
CSS_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.DOTALL)
CSS_PIECE = re.compile(r"([^{}]*)([{}])")
ONE_ELEMENT = re.compile(r"\s*([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+)*)\s*\Z")
SHOWING = ("display", "visibility")

@dataclass
class Node:
    tag: str
    attributes: str = ""
    children: list = field(default_factory=list)

    def attribute(self, name: str) -> str | None:
        for m in ATTRIBUTE.finditer(self.attributes):
            if m[1].lower() == name:
                return html.unescape(next((g for g in m.groups()[1:] if g is not None), ""))
        return None

    def self_closed(self) -> bool:
        """Whether a slash outside all values ends the tag; it counts in foreign elements only."""
        if not self.attributes.endswith("/"):
            return False
        last = 0
        for m in ATTRIBUTE.finditer(self.attributes):
            last = m.end()
        return last < len(self.attributes)


def build(page: str) -> Node:
    """Tree of a page; end tags may be missing, misplaced or implied."""
    root = Node("html")
    stack, at = [root], 0

    def text(s: str) -> None:
        if s:
            if stack[-1].tag == "head" and s.strip(" \t\n\r\f"):
                stack.pop()
            stack[-1].children.append(html.unescape(s))

    def close(tags: set, stops: set) -> None:
        """Ends open elements up to the outermost of ``tags`` that no stop lies above."""
        last = None
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in stops:
                break
            if stack[i].tag in tags:
                last = i
        if last is not None:
            del stack[last:]

    while m := MARKUP.search(page, at):
        text(page[at:m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name or m[0][-1] != ">":
            continue
        if m[1]:
            if name == "p" and not any(n.tag == "p" for n in stack):
                stack[-1].children.append(Node("p"))
            elif name == "br":
                stack[-1].children.append(Node("br"))
            else:
                stops = set() if name in ("table", "body", "html") else {"table"} if name in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption") else SCOPE - {name}
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == name:
                        del stack[i:]
                        break
                    if stack[i].tag in stops:
                        break
            continue
        if name == "html" or name == "body" and any(n.tag == "body" for n in stack):
            continue
        if stack[-1].tag == "head" and name not in IN_HEAD:
            stack.pop()
        if name in IMPLIED:
            close(*IMPLIED[name])
        if name in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in SCOPE:
                    break
        if name in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            row = Node("tr")
            stack[-1].children.append(row)
            stack.append(row)
        node = Node(name, m[3] or "")
        stack[-1].children.append(node)
        if node.self_closed() and (name in FOREIGN or any(n.tag in FOREIGN for n in stack)):
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at)
            inner = page[at:end.start() if end else len(page)]
            node.children.append(html.unescape(inner) if name in ("textarea", "title") else inner)
            at = end.end() if end else len(page)
        elif name not in VOID and len(stack) < 400:  # deeper elements are taken as children of the deepest, so rendering cannot overflow
            stack.append(node)
    text(page[at:])
    return root


def declarations(style: str) -> dict:
    """{property: (important, value)} of the properties that decide what is shown, the last declaration first among equals."""
    out: dict = {}
    for part in style.split(";"):
        name, colon, value = part.partition(":")
        name = name.strip().lower()
        if colon and name in SHOWING:
            value, bang, word = value.strip().lower().partition("!")
            found = (bool(bang) and word.strip() == "important", value.strip())
            if found[1] and (name not in out or found[0] >= out[name][0]):
                out[name] = found
    return out


class Sheet:
    """Rules of the page's style sheets that decide what is shown, by one of the names their selector needs."""

    def __init__(self, root: Node):
        self.rules: dict[str, list] = {}
        self.count = 0
        stack = [root]
        while stack:
            node = stack.pop()
            if node.tag == "style":
                if (node.attribute("media") or "all").strip().lower() in ("", "all", "screen"):
                    self.read("".join(c for c in node.children if isinstance(c, str)))
            elif node.tag not in ("template", "noscript"):
                stack += [c for c in reversed(node.children) if not isinstance(c, str)]

    def read(self, css: str) -> None:
        depth, selectors = 0, ""
        for m in CSS_PIECE.finditer(CSS_COMMENT.sub(" ", css)):
            if m[2] == "{":
                if depth == 0:
                    selectors = m[1].rpartition(";")[2]
                depth += 1
            elif depth:
                depth -= 1
                if depth == 0 and not selectors.lstrip().startswith("@") and (found := declarations(m[1])):
                    for one in selectors.split(","):
                        self.add(ONE_ELEMENT.match(one), found)

    def add(self, selector, found: dict) -> None:
        if selector is None or not (selector[1] or selector[2]):
            return
        tag, names = (selector[1] or "*").lower(), re.findall(r"[.#][\w-]+", selector[2])
        ids = sum(n[0] == "#" for n in names)
        self.count += 1
        weight = (ids, len(names) - ids, int(tag != "*"), self.count)
        self.rules.setdefault(names[-1] if names else tag, []).append((tag, frozenset(names), weight, found))

    def styles(self, node: Node) -> dict:
        """{property: value} after the cascade: importance, inline before rules, specificity, order."""
        low = node.attributes.lower()
        inline = declarations(node.attribute("style") or "") if "style" in low else {}
        best = {name: ((important, 1), value) for name, (important, value) in inline.items()}
        if self.rules:
            have = {"." + c for c in (node.attribute("class") or "").split()} if "class" in low else set()
            if "id" in low and node.attribute("id"):
                have.add("#" + node.attribute("id"))
            for key in (*have, node.tag, "*"):
                for tag, names, weight, found in self.rules.get(key, ()):
                    if tag in ("*", node.tag) and names <= have:
                        for name, (important, value) in found.items():
                            rank = ((important, 0, *weight), value)
                            if name not in best or rank[0] > best[name][0]:
                                best[name] = rank
        return {name: value for name, (_, value) in best.items()}


def keep_visible(root: Node) -> Node:
    """Takes everything out of the tree that a reader does not see.

    Invisible elements keep their place (cells, list numbers) and lose their text; what is visible again inside them stays.
    """
    sheet = Sheet(root)
    stack = [(root, True, False)]
    while stack:
        node, shown, drawing = stack.pop()
        closed = node.tag == "details" and node.attribute("open") is None
        kept, summary = [], False
        for c in node.children:
            if isinstance(c, str):
                if shown and not drawing and not closed:
                    kept.append(c)
                continue
            if closed and (summary or c.tag != "summary"):
                continue
            summary = summary or c.tag == "summary"
            if c.tag in UNSEEN or drawing and c.tag in UNDRAWN:
                continue
            style = sheet.styles(c) if c.attributes or sheet.rules else {}
            display = style.get("display")
            if display == "none" or display is None and (
                    "hidden" in c.attributes.lower() and c.attribute("hidden") is not None or c.tag == "dialog" and c.attribute("open") is None):
                continue
            state = style.get("visibility")
            see = False if state in ("hidden", "collapse") else True if state in ("visible", "initial") else shown
            if c.tag == "input":
                if see and (c.attribute("type") or "text").lower() in ("submit", "button", "reset") and c.attribute("value"):
                    kept.append(" " + c.attribute("value") + " ")
            elif see or c.tag != "img":
                inside = c.tag == "svg" or drawing and c.tag not in ("text", "foreignobject")
                words = drawing and not inside
                kept += [" ", c, " "] if words else [c]
                stack.append((c, see, inside))
        node.children = kept
    return root


class Lines:
    """Text laid out in lines: white space is collapsed within a line, blank lines between blocks at most one."""

    def __init__(self):
        self.done: list[str] = []
        self.now: list[str] = []
        self.gap = False
        self.blank = False
        self.lead = ""

    def write(self, s: str, keep: bool = False) -> None:
        if keep:
            first, *rest = s.split("\n")
            self._add(first, True)
            for x in rest:
                self.end(True)
                self._add(x, True)
            return
        words = WHITE.split(s)
        for i, w in enumerate(words):
            if i:
                self.gap = True
            if w:
                self._add(w, False)

    def _add(self, s: str, keep: bool) -> None:
        if self.gap and self.now and not keep:
            self.now.append(" ")
        self.gap = False
        if s:
            self.now.append(s)

    def end(self, forced: bool = False) -> None:
        """Ends the line; an empty one is kept only if forced (line breaks)."""
        self.gap = False
        if self.now or forced:
            if self.blank and self.done and self.done[-1]:
                self.done.append("")
            self.blank = False
            self.done.append((self.lead + "".join(self.now)).rstrip() if self.now else "")
            self.lead = " " * len(self.lead)
        self.now = []

    def space(self) -> None:
        self.end()
        self.blank = True

    def text(self) -> list[str]:
        self.end()
        out = self.done
        while out and not out[-1]:
            out.pop()
        return out


def spans(cell: Node, name: str, most: int) -> int:
    """A span as HTML reads it: 1 where it is missing or no number, ``most`` at most; a rowspan of 0 reaches to the end."""
    value = (cell.attribute(name) or "").strip()
    if not (value.isascii() and value.isdigit()):
        return 1
    n = min(int(value[:9]), most)
    return n if n else most if name == "rowspan" else 1


def table_lines(node: Node) -> list[str]:
    """Rows with cells padded to the widest of their column; a cell of several lines or with an inner table takes as many lines.

    A cell that spans rows stands in its first row, and the cells of the rows below leave its columns free.
    """
    rows: list[list[tuple[int, int, list[str]]]] = []  # (column, columns spanned, lines)
    titles: list[str] = []
    taken: dict[int, int] = {}  # column: rows that a cell from above still covers

    def collect(n: Node) -> None:
        for c in n.children:
            if isinstance(c, str):
                if c.strip():  # text outside cells is shown above the table
                    titles.append(" ".join(WHITE.split(c.strip())))
            elif c.tag == "tr":
                cells, col, below = [], 0, {}
                for d in c.children:
                    if isinstance(d, str):
                        if d.strip():
                            titles.append(" ".join(WHITE.split(d.strip())))
                    elif d.tag in ("td", "th"):
                        while col in taken:
                            col += 1
                        wide, high = spans(d, "colspan", 1000), spans(d, "rowspan", 65534)
                        cells.append((col, wide, lines_of(d)))
                        if high > 1:
                            below.update(dict.fromkeys(range(col, col + wide), high))
                        col += wide
                    else:
                        titles.extend(lines_of(d))
                for k, n_rows in {**taken, **below}.items():
                    taken[k] = n_rows - 1
                    if not taken[k]:
                        del taken[k]
                if cells:
                    rows.append(cells)
            elif c.tag in ("thead", "tbody", "tfoot"):
                taken.clear()  # spans end with their group of rows
                collect(c)
                taken.clear()
            else:
                titles.extend(lines_of(c))

    collect(node)
    starts = sorted({col for cells in rows for col, _, _ in cells})  # columns in which no cell starts take no room
    place = {col: k for k, col in enumerate(starts)}
    laid = [[(place[col], bisect_left(starts, col + wide) - place[col], lines) for col, wide, lines in cells] for cells in rows]
    widths = [0] * len(starts)
    for col, wide, lines in sorted((x for cells in laid for x in cells), key=lambda x: x[1]):
        room = sum(widths[col:col + wide]) + 3 * (wide - 1)
        widths[col + wide - 1] += max(0, max(map(len, lines), default=0) - room)
    out = list(titles)
    for cells in laid:
        at = {col: (wide, lines) for col, wide, lines in cells}
        for k in range(max((len(lines) for _, _, lines in cells), default=0) or 1):
            line, col = [], 0
            while col < len(widths) and col <= cells[-1][0]:
                wide, lines = at.get(col, (1, []))
                line.append((lines[k] if k < len(lines) else "").ljust(sum(widths[col:col + wide]) + 3 * (wide - 1)))
                col += wide
            out.append(" | ".join(line).rstrip())
    return out


def render(node: Node, out: Lines, keep: bool) -> None:
    number = 0
    for c in node.children:
        if isinstance(c, str):
            out.write(c, keep)
            continue
        tag = c.tag
        if tag == "br":
            out.end(True)
        elif tag == "img":
            out.write(c.attribute("alt") or "")
        elif tag == "hr":
            out.space()
        elif tag == "table":
            out.space()
            for line in table_lines(c):
                out.now = [line]
                out.end(True)
            out.space()
        elif tag == "li":
            number += 1
            out.end()
            outer = out.lead
            value = c.attribute("value") if node.tag == "ol" else None
            number = int(value) if value and value.isdigit() else number
            mark = f"{number}. " if node.tag == "ol" else "- "
            out.lead = outer + mark
            render(c, out, keep)
            out.end()
            out.lead = outer
        elif tag in BLOCKS:
            nested = tag in ("ul", "ol", "menu", "dir") and node.tag == "li"
            (out.space if tag in SPACED and not nested else out.end)()
            outer = out.lead
            if tag == "dd" or tag == "blockquote" or nested:
                out.lead = " " * len(outer) + ("" if nested else "  ")
            render(c, out, keep or tag in ("pre", "listing", "plaintext", "xmp"))
            (out.space if tag in SPACED and not nested else out.end)()
            out.lead = " " * len(outer) if nested else outer
        else:
            render(c, out, keep or tag == "textarea")


def lines_of(node: Node) -> list[str]:
    out = Lines()
    render(node, out, False)
    return out.text()


def page_text(page: str | None) -> str:
    """Visible text of a page; null and empty pages have none."""
    return "\n".join(lines_of(keep_visible(build(page)))) if page else ""


def extract(pages: DataFrame, key: str = "page_id", source: str = "html") -> DataFrame:
    """``key``, text, n_lines for every page.

    Null pages give empty text; repeated rows are returned as often as they occur; more columns are ignored; an
    empty table gives no rows. A page is parsed whole, in time that grows with its length. From a depth of 400 on,
    elements become siblings: their text stays, their layout may change.
    """

    def make():
        import pyarrow as pa

        def step(batch):
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [page_text(p) for p in part.column("page").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.array(texts, pa.string()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64())],
                    names=["key", "text", "n_lines"])

        return step

    rows = pages.select(F.col(key).alias("key"), F.col(source).alias("page"))
    kind = dict(pages.dtypes)[key]
    return map_batches(rows, f"key {kind}, text string, n_lines bigint", make).withColumnRenamed("key", key)
