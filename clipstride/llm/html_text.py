"""Visible text of web pages by a layout-aware rendering.

A page is read tag by tag into a tree of open elements. Tags that HTML lets authors leave out are implied: a block ends a paragraph, an item ends the item
before it, rows and cells end rows and cells; end tags close what is open inside, and those without a partner are ignored. Hidden elements
(head, scripts, styles, templates, ``hidden``, ``display:none``, ``visibility:hidden`` ...) give nothing. All other text is
emitted, boilerplate included. An element is laid out when it closes, so depth costs no recursion: inline text
flows with white space collapsed, blocks start on lines of their own and paragraphs and headings keep a blank line around them, items
get a bullet or their number and are indented, preformatted text stays as it is, and the cells of a table are
aligned in columns.

Null html gives null text, empty html empty text. Each page is one row, so repeated pages give equal rows. Nothing is shuffled. Extra columns
are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from clipstride.llm.words import chunks

TOKEN = re.compile(r"""<!--(?:>|->|.*?(?:-->|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>=]|=\s*+"[^"]*"|=\s*+'[^']*'|["'=])*+)>|<[!?/][^>]*(?:>|\Z)|[^<]+|<""", re.S)
HIDING = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
BLANKS = re.compile(r"[ \t\n\r\f]+")

#: Fixed by HTML: what has no content, what is raw text, and what shows nothing.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head title script style template noscript iframe noembed noframes object audio video canvas svg math datalist".split())
#: Blocks, and the blank lines that they keep before and after.
APART = {t: 1 for t in "p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure menu hr".split()}
BLOCK = frozenset("address article aside body center details dialog dd div dt fieldset figcaption footer form header hgroup html legend li main nav optgroup option search section summary caption".split()) | frozenset(APART)
#: A start tag ends open elements of these kinds, looking no further up than the others.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}), "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "tr": ({"tr", "caption"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "caption"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
}
#: What an end tag of something outside cannot reach through.
FENCE = frozenset("table td th caption html".split())
TABLE_PARTS = frozenset("td th tr thead tbody tfoot".split())


class Element:
    """An open element. ``items``: inline strings, and blocks (lines, blank lines around)."""

    __slots__ = ("tag", "hidden", "items", "pre", "rows", "number", "own")

    def __init__(self, tag: str, parent: Element | None, hidden: bool = False):
        self.tag = tag
        self.hidden = hidden or (parent is not None and parent.hidden)
        self.own = parent is None or tag in BLOCK or tag in TABLE_PARTS
        self.items: list = [] if self.own else parent.items
        self.pre = tag in ("pre", "textarea", "xmp") or (parent is not None and parent.pre)
        self.rows: list[list[list[str]]] = [] if tag == "table" else parent.rows if parent else []
        self.number = 0


def lines_of(items: list) -> list[str]:
    """Lay out what a block holds."""
    if len(items) == 1 and not isinstance(items[0], str):
        return items[0][0]
    out: list[str] = []
    flow: list[str] = []
    blank = 0

    def flush() -> None:
        nonlocal blank
        text = "".join(flow)
        flow.clear()
        # \0, \1 and \2 stand for line ends, blanks and tabs that stay
        lines = [BLANKS.sub(" ", x).strip(" ") for x in text.split("\0")]
        while lines and not lines[-1]:
            lines.pop()
        if lines:
            if out and blank:
                out.append("")
            out.extend(x.replace("\1", " ").replace("\2", "\t").rstrip() for x in lines)
            blank = 0

    for item in items:
        if isinstance(item, str):
            flow.append(item)
            continue
        flush()
        lines, apart = item
        if lines:
            if out and max(blank, apart):
                out.append("")
            out.extend(lines)
            blank = apart
        else:
            blank = max(blank, apart)
    flush()
    return out


def table_lines(rows: list[list[list[str]]]) -> list[str]:
    """Cells (lists of lines) in aligned columns, two blanks apart."""
    width: list[int] = []
    for row in rows:
        for i, cell in enumerate(row):
            if i == len(width):
                width.append(0)
            width[i] = max(width[i], *map(len, cell or [""]))
    out = []
    for row in rows:
        for n in range(max(map(len, row), default=0)):
            cells = [(cell[n] if n < len(cell) else "").ljust(width[i]) for i, cell in enumerate(row)]
            out.append("  ".join(cells).rstrip())
    return out


def is_hidden(tag: str, attributes: str) -> bool:
    if tag in UNSEEN:
        return True
    if not attributes or ("hid" not in attributes.lower() and "none" not in attributes.lower() and "collapse" not in attributes.lower()):
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), html.unescape("".join(values))
        if name == "hidden" or (name == "style" and HIDING.search(value)) or (tag == "input" and name == "type" and value.lower() == "hidden"):
            return True
    return False


class Page:
    """The open elements of a page, from the outermost in."""

    def __init__(self):
        self.open = [Element("html", None)]
        self.count: dict[str, int] = {}  # open elements by tag

    def push(self, element: Element) -> None:
        self.open.append(element)
        self.count[element.tag] = self.count.get(element.tag, 0) + 1

    def close(self) -> None:
        """Lay out the innermost element and hand it to its parent."""
        done = self.open.pop()
        self.count[done.tag] -= 1
        parent = self.open[-1]
        if not done.own or done.hidden:
            return
        tag = done.tag
        if tag in ("td", "th"):
            cell = lines_of(done.items)
            if self.count.get("table"):
                done.rows.append([]) if not done.rows else None
                done.rows[-1].append(cell)
            else:
                parent.items.append((cell, 0))
            return
        if tag in TABLE_PARTS:
            parent.items.extend(done.items)  # text outside cells stays with the table
            return
        lines = lines_of(done.items)
        if tag == "table":
            lines += table_lines([r for r in done.rows if r])
        elif tag == "li":
            holder = next((e for e in reversed(self.open) if e.tag in ("ul", "ol", "menu")), None)
            mark = "- "
            if holder is not None and holder.tag == "ol":
                holder.number += 1
                mark = f"{holder.number}. "
            lines = [(mark if i == 0 else " " * len(mark) if x else "") + x for i, x in enumerate(lines)]
        elif tag in ("dd", "blockquote"):
            lines = ["  " + x if x else x for x in lines]
        nested = tag in ("ul", "ol", "menu") and self.count.get("li")
        parent.items.append((lines, 0 if nested else APART.get(tag, 0)))

    def close_through(self, kinds: set[str] | frozenset[str], stop: set[str] | frozenset[str]) -> bool:
        """Close up to the innermost element of these kinds, unless one of ``stop`` is inside it."""
        if not any(self.count.get(k) for k in kinds):
            return False
        for at in range(len(self.open) - 1, 0, -1):
            tag = self.open[at].tag
            if tag in kinds:
                while len(self.open) > at:
                    self.close()
                return True
            if tag in stop:
                return False
        return False

    def start(self, tag: str, attributes: str) -> None:
        if tag in ("html", "body"):
            if is_hidden(tag, attributes):
                self.push(Element(tag, self.open[-1], True))
            return
        if tag in BLOCK or tag in TABLE_PARTS:
            self.close_through({"p"}, FENCE | {"button"})
            if tag == "head":
                return
        if tag not in UNSEEN and len(self.open) > 1 and self.open[-1].tag == "head" and tag not in VOID:
            self.close()
        if tag in ENDS:
            kinds, stop = ENDS[tag]
            if tag == "tr" or tag in ("thead", "tbody", "tfoot"):
                self.close_through({"td", "th"}, stop)
                if tag != "tr":
                    self.close_through({"tr"}, stop)
            self.close_through(kinds, stop)
        top = self.open[-1]
        if tag == "br":
            top.items.append("\0")
        elif tag == "hr":
            top.items.append((["---"], 1))
        elif tag not in VOID:
            element = Element(tag, top, is_hidden(tag, attributes))
            if tag == "tr" and not element.hidden:
                element.rows.append([])
            self.push(element)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.open[-1].items.append("\0")
        elif tag not in ("html", "body"):
            # an inline end tag does not end blocks inside; parts of a table end only inside it
            stop = {"table"} - {tag} if tag in TABLE_PARTS or tag == "table" else FENCE - {tag} if tag in BLOCK else FENCE | BLOCK
            if not self.close_through({tag}, stop) and tag == "p":
                self.open[-1].items.append(([], 1))

    def text(self, data: str) -> None:
        top = self.open[-1]
        if top.hidden or not data:
            return
        data = html.unescape(data).replace("\0", "").replace("\1", "").replace("\2", "")
        if top.pre:
            data = data.replace("\r\n", "\n").replace("\n", "\0").replace(" ", "\1").replace("\t", "\2")
        top.items.append(data)


def visible_text(source: str) -> str:
    """The rendered text of one page."""
    page, at, size, last = Page(), 0, len(source), source.rfind(">")
    while at < size:
        if at > last:  # no tag can end here any more
            page.text(source[at:].split("<!--")[0])
            break
        token = TOKEN.match(source, at)
        at = token.end()
        whole, tag = token.group(), token.group(2)
        if tag is None:
            if whole[0] != "<" or whole == "<":
                page.text(whole)
            continue
        tag = tag.lower()
        if token.group(1):
            page.end(tag)
            continue
        page.start(tag, token.group(3))
        if tag in RAW and page.open[-1].tag == tag:
            stop = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
            page.text(source[at : stop.start() if stop else size])
            at = stop.start() if stop else size
    while len(page.open) > 1:
        page.close()
    return "\n".join(lines_of(page.open[0].items))


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, text and n_chars (code points) of every page."""

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "html"):
            texts = [None if x is None else visible_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), pa.array(texts, pa.string()), pa.array([x if x is None else len(x) for x in texts], pa.int64())],
                names=["page_id", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "html").mapInArrow(extract, f"page_id {kind}, text string, n_chars long")
