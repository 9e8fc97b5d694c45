"""Layout-aware text of web pages.

A tree builder takes the tags of a page and supplies the implied ones (ends of
paragraphs, list items and cells; rows around cells).  What the page hides is
left out: the head, scripts, templates, ``hidden`` elements, hidden inputs, and
what inline styles or simple rules (tag, .class, #id) of its style sheets hide
on any screen (rules for other media or under a condition hide nothing).  Of
several values the more specific, then the later counts; what is visible
inside an element of ``visibility: hidden`` shows.  Scripts don't run, so
``noscript`` shows.
All other text is laid out: blocks on lines of their own, an empty line around
paragraphs, headings, lists and tables, items with markers and indentation,
preformatted text as it is, and the cells of a table in aligned columns (cells
that span columns or rows keep theirs); images are their alternative text.

Defined results: a null or empty page has the empty text; unclosed and stray
tags are repaired; a table inside a cell is read as the cell's text; depth is
not limited (no recursion); repeated rows give repeated rows; an empty table
gives an empty table; of the input only the named columns are read, so other
columns may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import text_or_empty

# Fixed values of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = set("head script style template title meta link datalist".split())
BLOCK = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer "
            "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search "
            "section summary table ul caption".split())
SPACED = set("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul".split())
#: start tag -> open elements that it ends, not looking beyond the elements named last
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
}
ENDS["thead"] = ENDS["tfoot"] = ENDS["tbody"]
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*(hidden|collapse)", re.I)
_CSS_NOISE = re.compile(r"/\*.*?(?:\*/|$)|\"[^\"\n]*\"|'[^'\n]*'", re.S)
_CSS_MARK = re.compile(r"([{};])")
#: media that the text is for, without a condition
_SHOWN_MEDIA = re.compile(r"(only\s+)?(screen|all)", re.I)
_SPACES = re.compile(r"[ \t\n\r\f]+")
_SIMPLE = re.compile(r"^([a-z][a-z0-9]*)?([.#][\w-]+)?$", re.I)


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


class Tree(HTMLParser):
    """Builds the tree of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.open = [self.root]
        self.styles: list[str] = []

    def _end(self, tags: set[str], until: set[str]) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in until:
                return
            if self.open[k].tag in tags:
                del self.open[k:]
                if not any(n.tag in tags for n in self.open[max(1, k - 3):]):
                    return

    def _push(self, tag: str, attrs: dict[str, str]) -> None:
        node = Node(tag, attrs)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_starttag(self, tag, attrs):
        given = {k: v or "" for k, v in attrs}
        if tag in ("html", "body") and tag == "html":
            return
        if tag == "body" or (tag in BLOCK and self.open[-1].tag == "head"):
            self._end({"head"}, set())
        if tag in BLOCK:
            self._end({"p"}, {"td", "th", "button", "table"})
        if tag in ENDS:
            self._end(*ENDS[tag])
        if tag in ("td", "th") and self.open[-1].tag not in ("tr",) and any(n.tag == "table" for n in self.open):
            self._push("tr", {})
        self._push(tag, given)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in ("html", "body"):
            return
        if tag == "br":
            self._push("br", {})
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return
            if self.open[k].tag in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
                return  # a stray end tag does not leave its cell

    def handle_data(self, data):
        if self.open[-1].tag == "style" and shown_media(self.open[-1].attrs.get("media", "")):
            if self.open[-1].children:  # the rest of a style sheet
                self.styles[-1] += data
            else:
                self.styles.append(data)
        self.open[-1].children.append(data)


def shown_media(query: str) -> bool:
    """Whether a list of media has the screen, or all, without a condition."""
    return not query.strip() or any(_SHOWN_MEDIA.fullmatch(q.strip()) for q in query.split(","))


def css_rules(css: str) -> Iterator[tuple[str, str]]:
    """(selectors, declarations) that hold on any screen: without the blocks of
    conditional and other at-rules, and without rules nested in a rule."""
    opened: list[str] = []  # kinds of the open blocks: group, rule, other
    head = body = held = ""
    for piece in _CSS_MARK.split(_CSS_NOISE.sub(" ", css)):
        if piece == "{":
            head_now, held = held.strip(), ""
            if any(k != "group" for k in opened):
                opened.append("other")
            elif head_now.startswith("@"):
                named = re.match(r"@media\b(.*)", head_now, re.I | re.S)
                opened.append("group" if named and shown_media(named[1]) else "other")
            else:
                opened.append("rule")
                head, body = head_now, ""
        elif piece == "}":
            if opened and opened.pop() == "rule":
                yield head, body + held
            held = ""
        elif piece == ";":
            if opened and opened[-1] == "rule":
                body += held + ";"
            held = ""
        else:
            held += piece


def _values(body: str) -> Iterator[tuple[str, bool, bool]]:
    """(property, whether it hides, important) of the declarations that decide
    on showing, in order."""
    for d in body.split(";"):
        name, _, value = d.partition(":")
        name = name.strip().lower()
        if name in ("display", "visibility") and value.strip() and not re.match(r"\s*(inherit|unset)\b", value, re.I):
            yield name, bool(_HIDING.search(f"{name}:{value}")), "!" in value


def style_rules(styles: list[str]) -> dict[tuple[str, str], dict[str, bool]]:
    """(tag, .class or #id) of the simple selectors -> property -> whether it
    hides, by the last value (an important one is not taken back)."""
    state: dict[tuple[str, str], dict[str, tuple[bool, bool]]] = {}
    for selectors, body in (rule for css in styles for rule in css_rules(css)):
        values = list(_values(body))
        for s in selectors.split(",") if values else ():
            m = _SIMPLE.match(s.strip())
            if m and m[0]:
                own = state.setdefault(((m[1] or "").lower(), m[2] or ""), {})
                for name, hides, important in values:
                    if important or not own.get(name, (False, False))[1]:
                        own[name] = hides, important
    return {k: {name: hides for name, (hides, _) in own.items()} for k, own in state.items()}


def hidden_rules(styles: list[str]) -> set[tuple[str, str]]:
    """The simple selectors that hide."""
    return {selector for selector, own in style_rules(styles).items() if any(own.values())}


def shown(node: Node, rules: dict[tuple[str, str], dict[str, bool]], inherited: bool) -> bool | None:
    """Whether an element's own text shows; None if all in it is hidden."""
    a = node.attrs
    if node.tag in UNSEEN or "hidden" in a or (node.tag == "input" and a.get("type", "").lower() == "hidden"):
        return None
    found: dict[str, bool] = {}
    if rules:  # from the least specific on
        for mark in ["", *("." + c for c in a.get("class", "").split()), *(["#" + a["id"]] if a.get("id") else [])]:
            for tag in ("", node.tag):
                found.update(rules.get((tag, mark), {}))
    found.update((name, hides) for name, hides, _ in _values(a.get("style", "")))
    if found.get("display"):
        return None
    return not found["visibility"] if "visibility" in found else inherited


def _span(node: Node, name: str, most: int) -> int:
    text = node.attrs.get(name, "").strip()
    return min(max(int(text), 1), most) if text.isascii() and text.isdigit() else 1


class Layout:
    """Lines of a page, written from left to right."""

    def __init__(self, rules: dict[tuple[str, str], dict[str, bool]]):
        self.rules, self.lines, self.inline = rules, [], []
        self.lists: list[list] = []  # [ordered, items so far]
        self.marker = ""

    def flush(self) -> None:
        text = _SPACES.sub(" ", "".join(self.inline)).strip(" ")
        self.inline = []
        if text:
            indent = "  " * max(len(self.lists) - 1, 0)
            head = self.marker or ("  " if self.lists else "")
            self.lines.append(indent + head + text)
            self.marker = ""

    def gap(self) -> None:
        if self.lines and self.lines[-1]:
            self.lines.append("")

    def flat(self, node: Node, shows: bool) -> str:
        """All visible text of an element in one line; ``shows``: whether its own does."""
        out, todo = [], [(node, shows)]
        while todo:
            n, own = todo.pop()
            if isinstance(n, str):
                out.append(n if own else "")
                continue
            if n is not node and (own := shown(n, self.rules, own)) is None:
                continue
            if n.tag in BLOCK or n.tag in ("br", "td", "th", "tr"):
                out.append(" ")
                todo.append((" ", True))
            if n.tag == "img" and own:
                out.append(n.attrs.get("alt", ""))
            todo.extend((c, own) for c in reversed(n.children))
        return _SPACES.sub(" ", "".join(out)).strip(" ")

    def table(self, node: Node, shows: bool) -> None:
        rows: list[list[tuple[int, int, str]]] = []  # (first column, columns, text) of each cell
        loose: list[str] = []
        taken: dict[int, int] = {}  # columns that cells of earlier rows still hold, for so many rows
        todo = [(node, shows)]
        while todo:
            n, own = todo.pop()
            if isinstance(n, str):
                if n.strip() and own:
                    loose.append(_SPACES.sub(" ", n).strip(" "))
                continue
            if n is not node and (own := shown(n, self.rules, own)) is None:
                continue
            if n.tag == "tr":
                row, at = [], 0
                held, taken = taken, {c: k - 1 for c, k in taken.items() if k > 1}
                for c in n.children:
                    if isinstance(c, str) or c.tag not in ("td", "th"):
                        inside = own if isinstance(c, str) else shown(c, self.rules, own)
                        if inside is not None and (text := _SPACES.sub(" ", c if inside else "").strip(" ")
                                                   if isinstance(c, str) else self.flat(c, inside)):
                            loose.append(text)
                        continue
                    if (inside := shown(c, self.rules, own)) is None:
                        continue
                    while at in held:
                        at += 1
                    wide, high = _span(c, "colspan", 1000), _span(c, "rowspan", 65534)
                    row.append((at, wide, self.flat(c, inside)))
                    if high > 1:
                        taken.update((k, high - 1) for k in range(at, at + wide))
                    at += wide
                rows.append(row)
            elif n is node or n.tag in ("tbody", "thead", "tfoot", "colgroup"):
                todo.extend((c, own) for c in reversed(n.children))
            elif text := self.flat(n, own):
                loose.append(text)
        self.lines += loose
        width: dict[int, int] = {}
        for at, wide, text in (cell for r in rows for cell in r):
            if wide == 1:
                width[at] = max(width.get(at, 0), len(text))
        columns = {c: k for k, c in enumerate(sorted({at for r in rows for at, _, _ in r}))}  # those that a cell starts in
        for r in rows:
            line = ["".ljust(width.get(c, 0)) for c in columns]
            for at, wide, text in r:
                inner = [k for c, k in columns.items() if at <= c < at + wide]
                line[inner[0]] = text.ljust(sum(len(line[k]) for k in inner) + 3 * (len(inner) - 1))
                for k in inner[1:]:
                    line[k] = None
            parts = [x for x in line if x is not None]
            while parts and not parts[-1].strip():  # no cells, or empty ones, at the end
                parts.pop()
            if parts:
                self.lines.append(" | ".join(parts).rstrip(" "))

    def write(self, root: Node) -> str:
        todo: list = [(root, True)]
        while todo:
            n, own = todo.pop()
            if isinstance(n, str):
                self.inline.append(n if own else "")
                continue
            if isinstance(n, tuple):  # the end of an element
                self.flush()
                if n[0] in ("ul", "ol", "menu"):
                    self.lists.pop()
                    if self.lists:
                        continue
                if n[0] in SPACED:
                    self.gap()
                continue
            if (own := shown(n, self.rules, own)) is None:
                continue
            inner = [(c, own) for c in reversed(n.children)]
            if n.tag == "br":
                self.flush()
            elif n.tag in BLOCK:
                self.flush()
                if n.tag in SPACED and not (self.lists and n.tag in ("ul", "ol", "menu")):
                    self.gap()
                if n.tag == "table":
                    self.table(n, own)
                    self.gap()
                    continue
                if n.tag == "pre":
                    whole = []
                    while inner:
                        c, show = inner.pop()
                        if isinstance(c, str):
                            whole.append(c if show else "")
                        elif (show := shown(c, self.rules, show)) is not None:
                            whole.append("\n" if c.tag == "br" else "")
                            inner.extend((x, show) for x in reversed(c.children))
                    self.lines += "".join(whole).strip("\n").split("\n")
                    self.gap()
                    continue
                if n.tag in ("ul", "ol", "menu"):
                    self.lists.append([n.tag == "ol", 0])
                elif n.tag == "li":
                    if self.lists:
                        self.lists[-1][1] += 1
                    self.marker = f"{self.lists[-1][1]}. " if self.lists and self.lists[-1][0] else "- "
                todo.append(((n.tag,), own))
                todo.extend(inner)
            else:
                if n.tag == "img" and n.attrs.get("alt") and own:
                    self.inline.append(n.attrs["alt"])
                todo.extend(inner)
        self.flush()
        return "\n".join(self.lines).strip("\n")


def render(page: str) -> str:
    """Visible text of a page, laid out."""
    tree = Tree()
    tree.feed(page)
    tree.close()
    return Layout(style_rules(tree.styles)).write(tree.root)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, n_lines and text of every page; no shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [render(h) for h in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t.split("\n")) if t else 0 for t in texts], pa.int64()),
                 pa.array(texts, pa.string())], ["page_id", "n_lines", "text"])
    return (pages.select(F.col(id_col).cast("long").alias("page_id"), text_or_empty(html_col).alias("html"))
            .mapInArrow(run, "page_id long, n_lines long, text string"))
