"""Visible text of HTML pages as a browser would lay it out: blocks, lists and aligned tables.

A tokenizer feeds a tree builder that keeps the stack of open elements and supplies the tags that HTML implies;
elements are laid out as they close, so neither deep nesting nor long pages need recursion or a whole tree.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramloom.llm.tables import pieces, table

# fixed values: element classes of HTML
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("area base datalist head link meta noembed noframes param rp script source style template title track iframe object audio video canvas annotation annotation-xml desc defs metadata symbol clippath".split())
MARGIN = set("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir table blockquote pre figure fieldset hr listing xmp".split())
LINE = set("address article aside body caption center dd details dialog div dt figcaption footer form header hgroup html legend li main nav option "
           "optgroup search section summary tbody td tfoot th thead tr".split())
CLOSES_P = MARGIN | set("address article aside center details dialog dd div dt figcaption footer form header hgroup li main nav search section summary".split())
HEADING = set("h1 h2 h3 h4 h5 h6".split())
LISTS = set("ul ol menu dir".split())
# an opening tag closes these open elements, up to the nearest of the second set
IMPLIED_ENDS = {
    "li": ({"li"}, LISTS), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}), "td": ({"td", "th", "caption"}, {"tr", "table"}), "th": ({"td", "th", "caption"}, {"tr", "table"}),
    "tr": ({"td", "th", "tr", "caption"}, {"table"}), **{t: ({"td", "th", "tr", "tbody", "thead", "tfoot", "caption"}, {"table"}) for t in ("tbody", "thead", "tfoot")},
}
SCOPE = set("td th caption table button object marquee applet".split())
MAX_COLSPAN, MAX_ROWSPAN = 1000, 65534

# a quote opens a string only directly after `=`; elsewhere it is a letter of a name or value, and the tag ends at the first `>`
NAME = r"[^ \t\n\r\f/>][^ \t\n\r\f/>=]*+"
EQUALS, BARE = r"[ \t\n\r\f]*+=[ \t\n\r\f]*+", r"""[^ \t\n\r\f>"'][^ \t\n\r\f>]*+"""
TOKEN = re.compile(rf"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[ \t\n\r\f/]++|{NAME}(?:{EQUALS}(?:"[^"]*+"|'[^']*+'|{BARE}|(?=>)))?+)*+)>|<[!?/][^>]*+>""", re.DOTALL)
ATTRIBUTE = re.compile(rf"""({NAME})(?:{EQUALS}(?:"([^"]*+)"|'([^']*+)'|({BARE})))?+""")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.IGNORECASE) for t in ("script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp")}
STYLE = re.compile(r"(?:/\*.*?\*/|[^;])+", re.DOTALL)
SPACES = re.compile(r"[ \t\n\r\f]+")


def styles(value: str) -> dict[str, str]:
    """Declarations of a style attribute, the last of a name."""
    out = {}
    for part in STYLE.findall(value.lower()):
        name, colon, rest = re.sub(r"/\*.*?\*/", " ", part, flags=re.DOTALL).partition(":")
        if colon:
            out[name.strip()] = rest.replace("!important", "").strip()
    return out


def width(line: str) -> int:
    return len(line) if line.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in line)


class Block:
    """Lines of a flow of text; `gap` asks for an empty line before the next one."""

    def __init__(self):
        self.lines: list[str] = []
        self.run: list[str] = []
        self.gap = False

    def text(self, s: str) -> None:
        s = SPACES.sub(" ", s)
        if s[:1] == " " and (not self.run or self.run[-1][-1:] == " "):
            s = s[1:]
        if s:
            self.run.append(s)

    def end_line(self, margin: bool = False) -> None:
        line = "".join(self.run).rstrip(" ")
        self.run = []
        if line:
            self.add([line])
        self.gap |= margin

    def add(self, lines: list[str]) -> None:
        if lines:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.lines += lines

    def closed(self) -> list[str]:
        self.end_line()
        return self.lines


class Element:
    __slots__ = ("tag", "hidden", "invisible", "pre", "block", "count", "rows", "span", "ended", "serial", "items")

    def __init__(self, tag: str, parent: Element | None):
        self.tag, self.block = tag, None
        self.hidden = parent.hidden if parent else False
        self.invisible = parent.invisible if parent else False
        self.pre = parent.pre if parent else False
        self.count = 0
        self.rows: list[list[tuple[int, int, list[str]]]] = []
        self.ended = False
        self.serial = 0
        self.items: list[tuple[int | None, list[str]]] | None = None  # of a list that counts down: (given number, lines)


class Page:
    """Builder and layout of one page."""

    def __init__(self):
        self.root = Element("#root", None)
        self.root.block = Block()
        self.stack = [self.root]
        self.by_tag: dict[str, list[Element]] = defaultdict(list)
        self.flows = [self.root]  # open elements with a block of their own
        self.bounds: list[Element] = []  # open elements that end lines
        self.serial = 0

    def top(self) -> Element:
        """The innermost open element."""
        while self.stack[-1].ended:
            self.stack.pop()
        return self.stack[-1]

    def block(self) -> Block:
        while self.flows[-1].ended:
            self.flows.pop()
        return self.flows[-1].block

    def is_open(self, tags) -> bool:
        return any(self.by_tag[t] for t in tags)

    def nearest(self, tags) -> Element | None:
        return max((self.by_tag[t][-1] for t in tags if self.by_tag[t]), key=lambda e: e.serial, default=None)

    def forget(self, e: Element) -> None:
        """`e`, the last open element of its tag, is open no more."""
        e.ended = True
        self.by_tag[e.tag].pop()

    def feed(self, source: str) -> list[str]:
        at = 0
        while at < len(source):
            found = TOKEN.search(source, at)
            self.text(source[at:found.start() if found else len(source)])
            if not found:
                break
            at = found.end()
            if found[2]:
                tag = found[2].lower()
                if found[1]:
                    self.end(tag)
                else:
                    self.start(tag, found[3])
                    if tag in ("pre", "textarea", "listing"):  # a line end right behind the tag is no text
                        at += 2 if source.startswith("\r\n", at) else source.startswith(("\n", "\r"), at)
                    if tag in RAW_END and self.by_tag[tag]:
                        stop = RAW_END[tag].search(source, at)
                        self.text(source[at:stop.start() if stop else len(source)], decode=tag in ("textarea", "title"))
                        at = stop.end() if stop else len(source)
                        self.end(tag)
        while self.top() is not self.root:
            self.pop()
        return self.root.block.closed()

    def text(self, s: str, decode: bool = True) -> None:
        top = self.top()
        if not s or top.hidden or top.invisible or top.tag == "details" and not top.count:
            return
        s = html.unescape(s) if decode and "&" in s else s
        if top.tag in ("table", "tbody", "thead", "tfoot", "tr"):  # text between cells stands before the table
            if s.strip(" \t\n\r\f"):
                self.block().text(s)
        elif top.pre:
            first, *rest = s.replace("\r\n", "\n").split("\n")
            block = self.block()
            block.run.append(first)
            for line in rest:
                block.add(["".join(block.run).rstrip()])
                block.run = [line]
        else:
            self.block().text(s)

    def in_scope(self, tags: set[str], until: set[str]) -> Element | None:
        """The nearest open element of `tags` inside the nearest of `until`."""
        found = self.nearest(tags)
        border = self.nearest(until) if found is not None else None
        return found if border is None or found.serial >= border.serial else None

    def close(self, element: Element | None) -> None:
        while element is not None and not element.ended:
            self.pop()

    def start(self, tag: str, attributes: str) -> None:
        if tag in CLOSES_P:
            self.close(self.in_scope({"p"}, SCOPE))
        if tag in HEADING and self.top().tag in HEADING:
            self.pop()
        if tag in IMPLIED_ENDS:
            ends, until = IMPLIED_ENDS[tag]
            found = self.in_scope(ends, until)
            while found is not None:
                self.close(found)
                found = self.in_scope(ends, until)
        if tag in ("td", "th") and self.by_tag["table"] and self.in_scope({"tr"}, {"table"}) is None:
            self.push("tr", {})
        values = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)} if attributes else {}
        if tag in VOID:
            if not self.top().hidden and not self.top().invisible:
                block = self.block()
                if tag == "br":
                    if block.run:
                        block.end_line()
                    else:
                        block.gap = bool(block.lines)
                elif tag == "hr":
                    block.end_line(margin=True)
                    block.add(["---"])
                    block.gap = True
                elif tag == "input" and values.get("type", "").lower() in ("submit", "button", "reset"):
                    block.text(html.unescape(values.get("value", "")))
            return
        self.push(tag, values)

    def push(self, tag: str, values: dict[str, str]) -> None:
        parent = self.top()
        e = Element(tag, parent)
        style = styles(html.unescape(values["style"])) if "style" in values else {}
        closed = parent.tag == "details" and parent.count == 0 and tag != "summary"
        if tag in HIDDEN or "hidden" in values or style.get("display") == "none" or closed or (tag == "dialog" and "open" not in values):
            e.hidden = True
        if style.get("visibility") in ("hidden", "collapse", "visible"):
            e.invisible = style["visibility"] != "visible"
        e.pre = parent.pre or tag in ("pre", "textarea", "listing", "xmp") or style.get("white-space", "").startswith(("pre", "break-spaces"))
        if tag == "details":
            e.count = int("open" in values)
        if not e.hidden and (tag in MARGIN or tag in LINE) and tag not in ("tr", "tbody", "thead", "tfoot", "td", "th"):
            nested = tag in LISTS and self.is_open(LISTS)
            self.block().end_line(margin=tag in MARGIN and not nested)
        if tag == "ol":
            e.count = int(values["start"]) - 1 if re.fullmatch(r"-?\d{1,9}", values.get("start", "")) else 0
            if "reversed" in values:
                e.items, e.block = [], Block()
                e.span = [int(values["start"]) if re.fullmatch(r"-?\d{1,9}", values.get("start", "")) else None]
        if tag == "li":
            owner = self.nearest(LISTS)
            if owner is not None and owner.items is not None:
                owner.items.append((int(values["value"]) if re.fullmatch(r"-?\d{1,9}", values.get("value", "")) else None, []))
                e.span = len(owner.items) - 1
            elif owner is not None:
                owner.count = int(values["value"]) if re.fullmatch(r"-?\d{1,9}", values.get("value", "")) else owner.count + 1
            e.count = owner.count if owner is not None and owner.tag == "ol" else None
        if tag in ("td", "th"):
            e.span = [min(max(int(values.get(n, "")), 1), most) if values.get(n, "").isdecimal() else 1 for n, most in (("colspan", MAX_COLSPAN), ("rowspan", MAX_ROWSPAN))]
        if tag in ("li", "td", "th", "blockquote", "dd", "caption"):
            e.block = Block()
        self.serial += 1
        e.serial = self.serial
        self.stack.append(e)
        self.by_tag[tag].append(e)
        if e.block is not None:
            self.flows.append(e)
        if tag in MARGIN or tag in LINE:
            self.bounds.append(e)

    def end(self, tag: str) -> None:
        if tag == "br":
            return self.start("br", "")
        if not self.by_tag[tag]:
            return None
        cells = tag in ("table", "tr", "tbody", "thead", "tfoot")
        found = self.in_scope({tag}, {"table"} - {tag} if cells else SCOPE - {tag})
        if tag in HEADING and found is None:
            found = self.in_scope(HEADING, SCOPE)
        if found is None:
            return None
        while self.bounds and self.bounds[-1].ended:
            self.bounds.pop()
        if tag not in MARGIN and tag not in LINE and self.bounds and self.bounds[-1].serial > found.serial:
            self.forget(found)  # an inline element does not close the blocks inside it
            return None
        return self.close(found)

    def pop(self) -> None:
        e = self.top()
        self.stack.pop()
        self.forget(e)
        if e.tag == "tr":
            owner = self.nearest({"table"})
            if owner is not None and not e.hidden:
                owner.rows.append([c for row in e.rows for c in row])
            elif not e.hidden:  # a row without a table stands in the text around it
                self.block().end_line()
                self.block().add(laid_out([[c for row in e.rows for c in row]]))
            return
        if e.hidden:
            return
        lines = e.block.closed() if e.block is not None else []
        if e.tag in ("td", "th"):
            row = self.nearest({"tr", "table"})
            if row is not None and row.tag == "tr":
                row.rows.append([(*e.span, lines)])
            else:
                self.block().end_line()
                self.block().add(lines)
        elif e.tag == "table":
            self.block().end_line(margin=True)
            self.block().add(laid_out(e.rows))
            self.block().gap = True
        elif e.tag == "li":
            owner = self.nearest(LISTS)
            if owner is not None and owner.items is not None:
                owner.items[e.span] = owner.items[e.span][0], lines
            else:
                self.block().end_line()
                self.block().add(item("- " if e.count is None else f"{e.count}. ", lines))
        elif e.items is not None:
            self.block().end_line(margin=not self.is_open(LISTS))
            self.block().add(lines)
            number = e.span[0] if e.span[0] is not None else len(e.items)
            for given, inside in e.items:
                number = number if given is None else given
                self.block().add(item(f"{number}. ", inside))
                number -= 1
            self.block().end_line(margin=not self.is_open(LISTS))
        elif e.tag in ("blockquote", "dd"):
            self.block().end_line(margin=e.tag == "blockquote")
            self.block().add([("    " if x else "") + x for x in lines])
            self.block().gap |= e.tag == "blockquote"
        elif e.tag == "caption":
            self.block().add(lines)
        elif e.tag in MARGIN or e.tag in LINE:
            nested = e.tag in LISTS and self.is_open(LISTS)
            self.block().end_line(margin=e.tag in MARGIN and not nested)


def item(mark: str, lines: list[str]) -> list[str]:
    return [(mark if i == 0 else " " * len(mark) * bool(x)) + x for i, x in enumerate(lines or [""])]


def laid_out(rows: list[list[tuple[int, int, list[str]]]]) -> list[str]:
    """Lines of a table: every column as wide as its widest cell, two spaces between columns, the end of lines bare."""
    busy: dict[int, int] = {}
    placed, widths = [], Counter()
    for row in rows:
        at, cells, now = 0, [], {c: n for c, n in busy.items() if n > 0}
        for colspan, rowspan, lines in row:
            while now.get(at, 0) > 0:
                at += 1
            cells.append((at, colspan, lines))
            if colspan == 1:
                widths[at] = max(widths[at], max(map(width, lines), default=0))
            if rowspan > 1:
                busy.update({c: rowspan for c in range(at, at + colspan)})
            at += colspan
        placed.append(cells)
        busy = {c: n - 1 for c, n in busy.items() if n > 1}
    for cells in placed:
        for at, colspan, lines in cells:
            if colspan > 1:
                need = max(map(width, lines), default=0) - sum(widths[c] for c in range(at, at + colspan)) - 2 * (colspan - 1)
                widths[at + colspan - 1] += max(need, 0)
    used = sorted(c for cells in placed for at, n, _ in cells for c in range(at, at + n))
    begins, x = {}, 0
    for c in range(used[-1] + 1 if used else 0):
        begins[c] = x
        x += widths[c] + 2
    out = []
    for cells in placed:
        for i in range(max((len(lines) for _, _, lines in cells), default=0)):
            line, at_x = [], 0
            for at, _, lines in cells:
                if i < len(lines) and lines[i]:
                    line.append(" " * (begins[at] - at_x) + lines[i])
                    at_x = begins[at] + width(lines[i])
            out.append("".join(line))
    return out


def visible_text(source: str) -> str:
    return "\n".join(Page().feed(source))


def _rendered(batches):
    for part in pieces(batches, 0):
        texts = [visible_text(s) if s else "" for s in part.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(texts, pa.string())], names=[*part.schema.names[1:], "text"])


def extract_text(pages: DataFrame, source: str = "html", carry: list[str] | None = None) -> DataFrame:
    """Columns `carry` (all but the source by default) with `text`, the visible text of each page.

    Paragraphs, headings, lists, tables and quotations stand apart by an empty line, other blocks by a line; list
    items have their bullet or number, the cells of a table are aligned. Hidden are scripts, styles, templates, head
    elements, embedded objects, `hidden`, `display:none`, `visibility:hidden` and closed details. Null and empty
    pages give an empty text, plain text stays as it is but for white space; each row is a page of its own.
    """
    carry = [c for c in ([c for c in pages.columns if c != source] if carry is None else carry) if c != "text"]
    rows = pages.select(F.col(source).alias("_html"), *carry)
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[1:]) + "text string"
    return rows.mapInArrow(_rendered, schema)


def op2_html_text(spark, sf_dir):
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "html"))
