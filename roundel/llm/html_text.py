"""HTML extraction by layout-aware rendering.

A tree builder reads tags with implied ends (a paragraph ends where a block begins, a list item where
the next one begins, and so on). The tree is then laid out: what is hidden is left out, all other text
is emitted; blocks stand on lines of their own, paragraphs, headings, lists and tables between blank
lines; list items carry their marks, indented by depth; cells of a table stand in aligned columns.

Hidden is what `hidden`, a style attribute or a style sheet of the page says (display and visibility;
rules whose selector is one type, class or id, or several of them together, outside @media other than
all or screen), a closed details but for its summary, and a closed dialog. A cell keeps its lines and
blank lines; cells with long blocks are written one below the other, not side by side. Spaces for
alignment and indents are bounded by the page's size, so a text is never more than some times its page:
a table that would need more is written with its cells two spaces apart.
Every page is one task's work of linear size; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, slices

#: An attribute as HTML reads it: a quote delimits a value only right behind `=`, elsewhere it is a plain character.
_S = r"[ \t\n\r\f]"
_ATTRIBUTE = rf"([^ \t\n\r\f/>][^ \t\n\r\f/>=]*+)(?:{_S}*+={_S}*+(?:\"([^\"]*+)\"|'([^']*+)'|(?![\"'])([^ \t\n\r\f>]*+)))?+"
ATTRIBUTE = re.compile(_ATTRIBUTE)
_NAME = r"<(/?)([a-zA-Z][^ \t\n\r\f/>]*+)"
TAG = re.compile(rf"{_NAME}((?:[ \t\n\r\f/]*+{re.sub(r'[(](?![?])', '(?:', _ATTRIBUTE)})*+)[ \t\n\r\f]*+([ \t\n\r\f/]*+)>")
#: A tag up to the next `>`, for pages on which a tag does not end by the rules.
LOOSE = re.compile(rf"{_NAME}([^>]*?)(/?)>")
#: What decides whether an element is seen, in a style attribute or a rule.
DECLARATION = re.compile(r"(?<![\w-])(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
COMPOUND = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+)*)")
INVISIBLE = ("hidden", "collapse")
BLANK = re.compile(r"[ \t\n\r\f]+")

#: Element names by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template title noscript iframe noembed noframes datalist object audio video canvas".split())
#: Below svg and math: elements that are not drawn, those with HTML inside, and HTML tags that end the drawing.
FOREIGN = ("svg", "math")
UNDRAWN = frozenset("annotation annotation-xml desc metadata defs symbol clippath mask pattern marker lineargradient radialgradient filter".split())
INTEGRATION = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
HEAD_CONTENT = frozenset("base basefont bgsound link meta title noscript noframes style script template head".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset hr".split())
BLOCK = SPACED | frozenset("html body address article aside center details dialog dd div dt figcaption footer form header hgroup legend li main nav optgroup option search section summary tr td th thead tbody tfoot caption".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
#: A start tag ends the open elements named first, looked for up to one of those named second.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
    "option": (("option",), ("select", "datalist", "optgroup")),
    "body": (("head",), ()),
}
SCOPE = frozenset("html body table td th caption button object template".split())
TABLE_PARTS, TABLE_SCOPE = frozenset("table thead tbody tfoot tr td th caption".split()), frozenset(("table", "template"))


class Element:
    __slots__ = ("tag", "attributes", "children", "foreign", "css")

    def __init__(self, tag: str, attributes: str = "", foreign: bool = False):
        self.tag, self.attributes, self.children, self.foreign = tag, attributes, [], foreign
        self.css: list[str] = []  # of the root: what its style elements hold

    def get(self, name: str) -> str | None:
        if name not in self.attributes.lower():
            return None
        for m in ATTRIBUTE.finditer(self.attributes):
            if m[1].lower() == name:
                return unescape(next((g for g in m.groups()[1:] if g is not None), ""))
        return None


def _blocks_of(css: str) -> Iterator[tuple[str, str]]:
    """(selectors, declarations) of the rules of a style sheet, those for all media and screens."""
    todo = [re.sub(r"/\*.*?(?:\*/|$)", " ", css, flags=re.S)]
    while todo:
        text, at = todo.pop(), 0
        while (brace := text.find("{", at)) >= 0:
            before = text[at:brace].rpartition(";")[2].strip()
            if not before.startswith("@"):
                end = text.find("}", brace)
                end = len(text) if end < 0 else end
                yield before, text[brace + 1 : end]
                at = end + 1
                continue
            depth, at = 1, brace + 1
            for m in re.compile("[{}]").finditer(text, at):
                depth += 1 if m[0] == "{" else -1
                at = m.end()
                if not depth:
                    break
            if depth:
                at = len(text)
            if re.fullmatch(r"@media\s+(?:only\s+)?(?:all|screen)", before, re.I):
                todo.append(text[brace + 1 : at - 1])


class Styles:
    """The rules of a page's style sheets that say whether something is seen."""

    def __init__(self, sheets: list[str]):
        self.by: dict[str, list[tuple[tuple, str, frozenset, list]]] = {}
        order = 0
        for css in sheets:
            for selectors, body in _blocks_of(css):
                if not (says := DECLARATION.findall(body)):
                    continue
                for selector in selectors.split(","):
                    m = COMPOUND.fullmatch(selector.strip())
                    if not m or not m[0]:
                        continue
                    order += 1
                    parts = frozenset(re.findall(r"[.#][\w-]+", m[2]))
                    ids, tag = sum(x[0] == "#" for x in parts), (m[1] or "*").lower()
                    weight = (ids, len(parts) - ids, tag != "*", order)
                    self.by.setdefault(min(parts, default=tag), []).append((weight, tag, parts, says))

    def said(self, node: Element) -> dict[str, str]:
        """display and visibility of an element as rules and its style attribute give them."""
        found: list[tuple[tuple, str, str]] = []
        if self.by:
            names = {"." + c for c in BLANK.split(node.get("class") or "") if c}
            if name := node.get("id"):
                names.add("#" + name)
            for key in (*names, node.tag, "*"):
                for weight, tag, parts, says in self.by.get(key, ()):
                    if tag in ("*", node.tag) and parts <= names:
                        found += [((bool(important), 0, *weight), what.lower(), value.lower()) for what, value, important in says]
        if style := node.get("style"):
            found += [((bool(important), 1), what.lower(), value.lower()) for what, value, important in DECLARATION.findall(style)]
        return {what: value for _, what, value in sorted(found)}

    def seen(self, node: Element, visible: bool) -> tuple[bool, bool]:
        """Whether an element is laid out, and whether its own text is visible, given what it inherits."""
        tag = node.tag
        if tag in UNSEEN or node.foreign and tag in UNDRAWN:
            return False, False
        if not node.attributes and not self.by:
            return tag != "dialog", visible
        says = self.said(node)
        absent = tag == "input" or node.get("hidden") is not None or tag == "dialog" and node.get("open") is None
        if node.foreign:
            absent |= node.get("display") == "none"
            if (own := node.get("visibility")) is not None:
                says.setdefault("visibility", own)
        display, own = says.get("display", "none" if absent else ""), says.get("visibility")
        return display != "none" and tag != "input", own not in INVISIBLE if own in ("visible", *INVISIBLE) else visible


def tree(html: str) -> Element:
    """The elements and texts of a page below one root.

    A tag that does not end by the rules ends at the next `>`; without one, it and the rest are dropped.
    """
    root = Element("#root")
    open_: list[Element] = [root]
    names: dict[str, int] = {}  # how many of each are open

    def pop_to(depth: int) -> None:
        while len(open_) > depth:
            names[open_.pop().tag] -= 1

    def close(which: tuple[str, ...], until) -> None:
        if not any(names.get(w) for w in which):
            return
        for k in range(len(open_) - 1, 0, -1):
            if open_[k].tag in which:
                return pop_to(k)
            if open_[k].tag in until:
                return None
        return None

    def end_head() -> None:
        while open_[-1].tag == "head":
            pop_to(len(open_) - 1)

    def foreign() -> bool:
        """Whether the innermost open element stands in svg or math, outside HTML inside them."""
        if names.get("svg") or names.get("math"):
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].tag in FOREIGN:
                    return True
                if open_[k].tag in INTEGRATION:
                    return False
        return False

    at, n, pattern = 0, len(html), TAG
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            text = unescape(html[at:lt])
            if open_[-1].tag == "head" and text.strip(" \t\n\r\f"):
                end_head()
            open_[-1].children.append(text)
        if lt == n:
            break
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        nxt = html[lt + 1 : lt + 2]
        if nxt in ("!", "?") or nxt == "/" and not (html[lt + 2 : lt + 3].isascii() and html[lt + 2 : lt + 3].isalpha()):
            end = html.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        if not (nxt == "/" or nxt.isascii() and nxt.isalpha()):
            end_head()
            open_[-1].children.append("<")
            at = lt + 1
            continue
        m = pattern.match(html, lt)
        if not m and pattern is TAG:  # once, so that a page is read in linear time
            pattern = LOOSE
            m = LOOSE.match(html, lt)
        if not m:
            break
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            if tag == "p" and not names.get("p"):
                open_[-1].children.append(Element("p"))
            elif tag == "br":
                open_[-1].children.append(Element("br"))
            else:
                close((tag,), (TABLE_SCOPE if tag in TABLE_PARTS else SCOPE) - {tag})
            continue
        if tag not in HEAD_CONTENT:
            end_head()
        inside = foreign()
        while inside and tag in BREAKOUT:
            close(FOREIGN, INTEGRATION)
            inside = foreign()
        if tag in ENDS_P:
            close(("p",), SCOPE)
        if tag in ENDS:
            close(*ENDS[tag])
        element = Element(tag, m[3], inside)
        open_[-1].children.append(element)
        if inside and "/" in m[4]:
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, at)
            stop = end.start() if end else n
            if tag == "textarea":
                element.children.append(unescape(html[at:stop]))
            elif tag == "style":
                root.css.append(html[at:stop])
            close_at = html.find(">", stop)
            at = n if close_at < 0 else close_at + 1
        elif tag not in VOID:
            open_.append(element)
            names[tag] = names.get(tag, 0) + 1
    return root


class Page:
    """Lines of text as they fill up."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space = self.gap = False
        self.mark = ""

    def text(self, s: str, indent: str) -> None:
        words = BLANK.split(s)
        if not self.parts:
            self._begin(indent, any(words))
        for k, w in enumerate(words):
            self.space |= k > 0
            if w:
                if not self.parts:
                    self._begin(indent, True)
                elif self.space and self.parts[-1] and not self.parts[-1].endswith(" "):
                    self.parts.append(" ")
                self.parts.append(w)
                self.space = False

    def _begin(self, indent: str, real: bool) -> None:
        if real:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            start = indent + self.mark
            if self.mark:
                self.mark = ""
            if start:
                self.parts.append(start)

    def end_line(self) -> None:
        if self.parts:
            self.lines.append("".join(self.parts).rstrip())
        self.parts, self.space = [], False

    def blank(self) -> None:
        self.end_line()
        self.gap = True

    def whole(self, lines: list[str], indent: str) -> None:
        """Lines that keep their inner spaces."""
        self.end_line()
        for line in lines:
            if line.strip():
                self._begin(indent, True)
                self.parts.append(line)
                self.end_line()
            elif self.lines and not self.gap:
                self.lines.append("")

    def done(self) -> str:
        self.end_line()
        return "\n".join(self.lines).strip("\n")


WIDE, MAX_COLUMNS, MAX_INDENT = 60, 1000, 20
SPACES, FREE_SPACES = 8, 20_000  # a page may spend this many times its length, and so many more, on alignment


class Table:
    """Rows of (column, lines) as cells close; columns that a cell of an earlier row still takes are passed over."""

    def __init__(self) -> None:
        self.rows: list[list[tuple[int, list[str]]]] = []
        self.busy: dict[int, int] = {}  # columns taken in this row, and in how many below it
        self.at = 0
        self.broad: set[tuple[int, int]] = set()  # row and first column of cells that span columns: they don't say how wide one is

    def row(self) -> None:
        self.busy = {c: n - 1 for c, n in self.busy.items() if n}
        self.rows.append([])
        self.at = 0

    def cell(self, lines: list[str], colspan: int, rowspan: int) -> None:
        if not self.rows:
            self.row()
        while self.at in self.busy:
            self.at += 1
        self.rows[-1].append((self.at, lines))
        if colspan > 1:
            self.broad.add((len(self.rows) - 1, self.at))
        for c in range(self.at, min(self.at + colspan, MAX_COLUMNS)):
            self.busy[c] = rowspan - 1
        self.at += colspan

    def lines(self, spare: list[int]) -> list[str]:
        """The cells in columns as wide as their widest line of WIDE characters or less, two spaces apart. spare: spaces that the page has left."""
        there = [(k, r) for k, row in enumerate(self.rows) if (r := [(c, x) for c, x in row if any(x)])]
        rows = [r for _, r in there]
        columns = sorted({c for row in rows for c, _ in row})
        if len(columns) < 2:
            return [line for row in rows for _, x in row for line in x]
        wide = dict.fromkeys(columns, 0)
        for k, row in there:
            for c, x in row:
                if (k, c) not in self.broad:
                    wide[c] = max(wide[c], *(len(line) for line in x if len(line) <= WIDE), 0)
        left, at = {}, 0
        for c in columns:
            left[c], at = at, at + wide[c] + 2
        flat = [not _has_blocks(row) for row in rows]
        need = sum(left[row[-1][0]] * max(len(x) for _, x in row) for row, f in zip(rows, flat, strict=True) if f)
        align = need <= spare[0]
        spare[0] -= need if align else 0
        out: list[str] = []
        k_before = -1
        for row, f in zip(rows, flat, strict=True):
            if not f or out and not flat[k_before]:  # blank lines around a row of blocks and between its cells
                out += [""] * (bool(out) and out[-1] != "")
            k_before += 1
            if not f:
                for n, (_, x) in enumerate(row):
                    out += ["", *x] if n else x
                continue
            for k in range(max(len(x) for _, x in row)):
                line = ""
                for c, x in row:
                    if k < len(x) and x[k]:
                        line = line + "  " if line else line
                        line = (line.ljust(left[c]) if align else line) + x[k]
                out.append(line)
        return out


def _has_blocks(row: list[tuple[int, list[str]]]) -> bool:
    """Whether the row holds several cells, and in one of them paragraphs or long lines below each other."""
    return len(row) > 1 and any(len(x) > 1 and ("" in x or max(map(len, x)) > WIDE) for _, x in row)


def drawn(svg: Element, styles: Styles, visible: bool) -> list[tuple[Element | str, bool]]:
    """What an svg element shows as text: its text elements and the HTML inside it, each apart from the others."""
    out, todo = [], [(c, visible) for c in reversed(svg.children)]
    while todo:
        node, visible = todo.pop()
        if isinstance(node, str):
            continue
        if node.tag in ("text", "foreignobject"):
            out += [(" ", visible), (node, visible), (" ", visible)]
            continue
        shown, visible = styles.seen(node, visible)
        if shown:
            todo += [(c, visible) for c in reversed(node.children)]
    return out


def _number(text: str | None, most: int) -> int:
    return min(max(1, int(text)), most) if text and re.fullmatch("[0-9]{1,6}", text) else 1


def render(root: Element, size: int = 1 << 20) -> str:
    """All visible text of a tree; size: the characters of its page, which bound the spaces for alignment."""
    styles, spare = Styles(root.css), [SPACES * size + FREE_SPACES]
    page, outer = Page(), []  # outer: the pages around open cells
    tables: list[Table] = []
    lists: list[list] = []  # [mark kind, next number]
    stray: set[Element] = set()
    keep = 0  # open pre elements
    todo: list[tuple[object, bool, bool]] = [(root, True, True)]
    while todo:
        node, enter, visible = todo.pop()
        indent = "  " * min(max(0, len(lists) - 1), MAX_INDENT)
        if isinstance(node, str):
            if not visible:
                continue
            if keep:
                page.whole(node.split("\n"), indent) if "\n" in node else page.text(node, indent)
            else:
                page.text(node, indent)
            continue
        tag = node.tag
        if enter:
            shown, visible = styles.seen(node, visible)
            if not shown:
                continue
            if tag == "br":
                if page.parts:
                    page.end_line()
                continue
            if tag == "img":
                if visible and (alt := node.get("alt")):
                    page.text(alt, indent)
                continue
            if tag in ("td", "th"):
                outer.append((page, lists))
                page, lists = Page(), []
                if not tables:  # a cell outside a table is one of its own
                    tables.append(Table())
                    stray.add(node)
            elif tag in BLOCK:
                page.blank() if tag in SPACED else page.end_line()
                if tag == "hr":
                    if visible:
                        page.whole(["---"], indent)
                    page.blank()
                elif tag in ("ul", "ol"):
                    start = node.get("start") or ""
                    if lists:
                        page.gap = False
                    lists.append([tag, int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1])
                elif tag == "li":
                    if lists and lists[-1][0] == "ol":
                        page.mark = f"{lists[-1][1]}. "
                        lists[-1][1] += 1
                    else:
                        page.mark = "- "
                elif tag == "dd":
                    page.mark = "  "
                elif tag == "table":
                    tables.append(Table())
                elif tag == "tr" and tables:
                    tables[-1].row()
                elif tag == "pre":
                    keep += 1
            if tag not in VOID:
                todo.append((node, False, visible))
                inside = drawn(node, styles, visible) if tag == "svg" else [(c, visible) for c in node.children]
                if tag == "details" and node.get("open") is None:
                    inside = [x for x in inside if isinstance(x[0], Element) and x[0].tag == "summary"][:1]
                todo += [(c, True, v) for c, v in reversed(inside)]
            continue
        if tag in ("td", "th"):
            text = page.done()
            page, lists = outer.pop()
            tables[-1].cell(text.split("\n") if text else [], _number(node.get("colspan"), MAX_COLUMNS), 65534 if node.get("rowspan") == "0" else _number(node.get("rowspan"), 65534))
            if node in stray:
                stray.discard(node)
                page.whole(tables.pop().lines(spare), indent)
        elif tag == "table":
            if tables:
                page.whole(tables.pop().lines(spare), indent)
            page.blank()
        elif tag in BLOCK:
            if tag == "li" and page.mark:
                page.mark = ""
            if tag in ("ul", "ol") and lists:
                lists.pop()
            if tag == "pre":
                keep -= 1
            page.blank() if tag in SPACED and not (tag in ("ul", "ol") and lists) else page.end_line()
    return page.done()


def extract(html: str | None) -> str:
    return render(tree(html), len(html)) if html else ""


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html"):
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array([extract(h) for h in batch.column("html").to_pylist()], pa.string())], names=["page_id", "text"])


def render_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text) for each row of pages.

    Null or empty html gives an empty text. Rows are rendered one by one: repeated rows give equal
    texts and an empty table none. A long page is rendered whole. Other columns are ignored, whatever
    their names.
    """
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html")).mapInArrow(_extract, "page_id long, text string")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render_pages(read(spark, sf_dir, "pages"))
