"""Visible text of web pages with their layout.

``tokens`` cuts a page into tags and text in one pass, ``parse`` builds a tree
with the implied tags filled in, ``Sheet`` says what its style sheets hide, and
``layout`` writes the rest as text with block spacing, list marks and aligned
table cells. Every step is linear in the page, whatever is broken in it. Pages
are independent rows, so the operator is one pass without a shuffle.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import portions, shape

#: Element groups of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript title meta link base iframe object audio video canvas svg math datalist noembed noframes param source track area map dialog".split())
BLOCK = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl dir menu blockquote pre table figure fieldset".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
IN_TABLE = frozenset("caption colgroup tbody thead tfoot tr td th".split())
#: An opening tag on the left closes an open one on the right, unless one of the limits stands between.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th", "caption", "colgroup"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)), "thead": (("tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)), "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select",)), "rt": (("rt", "rp"), ("ruby",)), "rp": (("rt", "rp"), ("ruby",)), "body": (("head",), ("html",)),
}
#: Elements that an end tag inside them does not close, and tags that close past them.
SCOPE = frozenset("html table td th caption template button".split())
FREE = frozenset("table tr tbody thead tfoot".split())
#: Fixed values of HTML: the widest colspan and the longest rowspan that count.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
#: Lists inside more lists than this are indented no further.
DEEPEST = 40
#: Width in pixels of the window in which media conditions of style sheets are judged.
VIEWPORT = 1280

_name = re.compile(r"[^\s/>]*")
_gap = re.compile(r"[\s/]*")
_key = re.compile(r"=?[^\s/>=]*")
_equals = re.compile(r"\s*=\s*")
_bare = re.compile(r"[^\s>]*")
_space = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("attributes", "children", "parent", "tag")

    def __init__(self, tag: str, attributes: dict | None = None, children: list | None = None):
        self.tag, self.attributes, self.children, self.parent = tag, attributes or {}, children or [], None


def _attributes(source: str, at: int) -> tuple[dict, int]:
    """Attributes from ``at`` on, the first of each name, and the place after the tag's end (-1: it never ends)."""
    found: dict = {}
    while True:
        at = _gap.match(source, at).end()
        if at >= len(source):
            return found, -1
        if source[at] == ">":
            return found, at + 1
        hit = _key.match(source, at)
        key, at, value = hit[0].lower(), hit.end(), ""
        if hit := _equals.match(source, at):
            at = hit.end()
            quote = source[at : at + 1]
            if quote in ("'", '"') and quote:  # a quote counts only right after the equals sign
                end = source.find(quote, at + 1)
                if end < 0:
                    return found, -1
                value, at = source[at + 1 : end], end + 1
            else:
                hit = _bare.match(source, at)
                value, at = hit[0], hit.end()
        found.setdefault(key, html.unescape(value))


def tokens(source: str):
    """(kind, value, attributes) of a page: kind is text, open, close or raw (the body of a raw element).

    A tag or comment that never ends takes the rest of the page with it, as in
    browsers; a ``<`` that starts nothing is text.
    """
    at, start, size = 0, 0, len(source)
    while True:
        at = source.find("<", at)
        if at < 0:
            if start < size:
                yield "text", source[start:], None
            return
        ahead = source[at + 1 : at + 2]
        closing = ahead == "/"
        letter = source[at + 2 : at + 3] if closing else ahead
        if not (letter.isascii() and letter.isalpha() or closing and letter or ahead in ("!", "?")):
            at += 1
            continue
        if at > start:
            yield "text", source[start:at], None
        if letter.isascii() and letter.isalpha() and ahead not in ("!", "?"):
            hit = _name.match(source, at + 1 + closing)
            tag = hit[0].lower()
            at = hit.end()
            attributes, at = ({}, at + 1) if source.startswith(">", at) else _attributes(source, at)
            if at < 0:
                return
            yield "close" if closing else "open", tag, attributes
            if not closing and tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
                stop = end.start() if end else size
                yield "raw", source[at:stop], None
                at = stop
        elif source.startswith("<!--", at):
            if source.startswith(("<!-->", "<!--->"), at):
                at = source.find(">", at) + 1
            else:
                at = source.find("-->", at + 4) + 3
                if at < 3:
                    return
        else:
            at = source.find(">", at) + 1
            if not at:
                return
        start = at


def parse(source: str) -> Node:
    """Tree of a page. Missing end tags are implied, stray ones ignored, and unclosed elements end with their parent."""
    root = Node("#document")
    stack, opened, scopes = [root], {}, []  # open elements, and their places on the stack by tag and of those in SCOPE

    def add(child) -> None:
        stack[-1].children.append(child)
        if isinstance(child, Node):
            child.parent = stack[-1]

    def open_(node: Node) -> None:
        add(node)
        opened.setdefault(node.tag, []).append(len(stack))
        if node.tag in SCOPE:
            scopes.append(len(stack))
        stack.append(node)

    def close_to(index: int) -> None:
        for node in reversed(stack[index:]):
            opened[node.tag].pop()
        del stack[index:]
        while scopes and scopes[-1] >= index:
            scopes.pop()

    def last(tags) -> int:
        """Place of the innermost open element of ``tags``, or 0."""
        return max((opened[t][-1] for t in tags if opened.get(t)), default=0)

    def outermost(tags, limits) -> int:
        """Place of the outermost open element of ``tags`` inside the innermost of ``limits``, or 0."""
        floor = last(limits)
        return min((places[k] for t in tags if (places := opened.get(t)) and (k := bisect_right(places, floor)) < len(places)), default=0)

    for kind, value, attributes in tokens(source):
        if kind == "text":
            add(html.unescape(value) if "&" in value else value)
            continue
        if kind == "raw":
            if value:
                held = stack[-1].children[-1]
                held.children.append(value if held.tag in ("script", "style") else html.unescape(value))
            continue
        tag = value
        if kind == "close":
            if tag == "br" or tag == "p" and not opened.get("p"):
                add(Node(tag))
            elif tag not in ("body", "html"):  # what comes after them still belongs to the body
                place = last(HEADINGS if tag in HEADINGS else (tag,))
                if place and (tag in FREE or not scopes or scopes[-1] <= place):
                    close_to(place)
            continue
        if tag in IN_TABLE and not opened.get("table"):
            continue
        if tag in CLOSES_P and (place := last(("p",))) and (not scopes or scopes[-1] < place):
            close_to(place)
        if tag in HEADINGS and stack[-1].tag in HEADINGS:
            close_to(len(stack) - 1)
        if tag in IMPLIED and (place := outermost(*IMPLIED[tag])):
            close_to(place)
        if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            open_(Node("tr"))
        if stack[-1].tag == "head" and tag not in UNSEEN:
            close_to(len(stack) - 1)
        node = Node(tag, attributes)
        if tag in VOID or tag in RAW:
            add(node)
        else:
            open_(node)
    return root


def nodes(root: Node):
    """All elements in document order."""
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo += [c for c in reversed(node.children) if isinstance(c, Node)]


_comment = re.compile(r"/\*.*?(?:\*/|$)", re.S)
_compound = re.compile(r"\*|[A-Za-z][\w-]*|#[\w-]+|\.-?[A-Za-z_][\w-]*|\[\s*[\w-]+\s*(?:=\s*(?:\"[^\"]*\"|'[^']*'|[^\]\s]*)\s*)?\]")
_width = re.compile(r"\(\s*(min|max)-width\s*:\s*(\d+(?:\.\d+)?)(px|em|rem)\s*\)")


def media_applies(query: str) -> bool:
    """Whether a media query list holds on a screen of VIEWPORT pixels; conditions other than widths do not."""

    def one(part: str) -> bool:
        words = part.strip().lower()
        negated = words.startswith("not ")
        words = words.removeprefix("not ").removeprefix("only ").strip()
        kind, *conditions = re.split(r"\s+and\s+", words)
        if kind.startswith("("):
            kind, conditions = "all", [kind, *conditions]
        good = kind in ("", "all", "screen")
        for c in conditions:
            hit = _width.fullmatch(c.strip())
            pixels = float(hit[2]) * (1 if hit[3] == "px" else 16) if hit else 0
            good = good and bool(hit) and (VIEWPORT >= pixels if hit[1] == "min" else VIEWPORT <= pixels)
        return good != negated

    return any(map(one, query.split(",")))


def rules_of(sheet: str):
    """(selectors, declarations) of a style sheet's rules that apply, in order; blocks of other media are left out."""
    sheet = _comment.sub(" ", sheet)
    skipped, depth, start = [], 0, 0  # for each open block: whether its rules are left out
    for hit in re.finditer(r"[{};]", sheet):
        text = sheet[start : hit.start()].strip()
        if hit[0] == "{":
            if text.startswith("@"):
                word, _, rest = text[1:].partition(" ")
                off = not (word.lower() in ("supports", "layer", "container", "scope") or word.lower() == "media" and media_applies(rest))
                skipped.append(off or any(skipped[-1:]))
            else:
                selectors, depth = text, depth + 1
                if depth == 1:
                    body = hit.end()
        elif hit[0] == "}":
            if depth:
                depth -= 1
                if not depth and not any(skipped[-1:]):
                    yield selectors, sheet[body : hit.start()]
            elif skipped:
                skipped.pop()
        elif depth:
            continue
        start = hit.end()


def declared(body: str) -> dict[str, tuple[bool, str]]:
    """display and visibility of a declaration list: (important, value), the last of each kind."""
    found: dict[str, tuple[bool, str]] = {}
    for part in body.lower().split(";"):
        key, _, value = part.partition(":")
        if (key := key.strip()) in ("display", "visibility"):
            important = "!" in value
            if important or not found.get(key, (False,))[0]:
                found[key] = important, value.split("!")[0].strip()
    return found


class Sheet:
    """What the style elements of a page say about display and visibility.

    Selectors of tags, ids, classes and attributes count, joined by descendant
    and child combinators; rules with states or sibling combinators are left
    alone. Of the rules for an element the important, then the more specific,
    then the later one holds, and its own style goes before other rules.
    """

    def __init__(self, root: Node):
        self.rules: dict[str, list] = {}  # by the id, class or tag that the last compound asks for
        self.above: dict = {}
        order = 0
        for node in nodes(root):
            if node.tag != "style" or not media_applies(node.attributes.get("media", "")):
                continue
            for selectors, body in rules_of("".join(c for c in node.children if isinstance(c, str))):
                says = declared(body)
                for selector in selectors.split(",") if says else ():
                    if steps := self._steps(selector):
                        order += 1
                        tag, name, classes, _ = steps[0][1]
                        weight = tuple(sum(f(s[1]) for s in steps) for f in (lambda c: bool(c[1]), lambda c: len(c[2]) + len(c[3]), lambda c: bool(c[0])))
                        key = "#" + name if name else "." + classes[0] if classes else tag or "*"
                        self.rules.setdefault(key, []).append((steps, says, weight, order))

    @staticmethod
    def _steps(selector: str):
        """Compounds (tag, id, classes, attributes) from last to first with the combinator to the next; None if not understood."""
        out, link = [], " "
        for word in re.sub(r"\s*>\s*", " > ", selector.strip()).split():
            if word == ">":
                link = ">"
                continue
            found = _compound.findall(word)
            if "".join(found) != word:
                return None
            tag, name, classes, rest = "", "", [], []
            for part in found:
                if part[0] == "#":
                    name = part[1:]
                elif part[0] == ".":
                    classes.append(part[1:])
                elif part[0] == "[":
                    key, equals, value = part[1:-1].partition("=")
                    rest.append((key.strip().lower(), value.strip().strip("\"'") if equals else None))
                elif part != "*":
                    tag = part.lower()
            out.append((link, (tag, name, tuple(classes), tuple(rest))))
            link = " "
        return tuple(reversed(out)) or None

    @staticmethod
    def _fits(node: Node, compound) -> bool:
        tag, name, classes, rest = compound
        a = node.attributes
        return (
            (not tag or tag == node.tag) and (not name or name == a.get("id")) and (not classes or set(classes) <= set(a.get("class", "").split()))
            and all(k in a and (v is None or a[k] == v) for k, v in rest)
        )

    def _matches(self, node: Node, steps, k: int = 0) -> bool:
        if node.tag == "#document" or not self._fits(node, steps[k][1]):
            return False
        if k + 1 == len(steps):
            return True
        parent = node.parent
        return parent is not None and (self._matches(parent, steps, k + 1) if steps[k][0] == ">" else self._inside(parent, steps, k + 1))

    def _inside(self, node: Node, steps, k: int) -> bool:
        """Whether the node or one around it matches from step ``k`` on; remembered for every node on the way."""
        way = []
        while True:
            found = self.above.get((id(node), steps, k))
            if found is None and self._matches(node, steps, k):
                found = True
            if found is None and node.parent is None:
                found = False
            if found is not None:
                self.above[(id(node), steps, k)] = found
                break
            way.append(node)
            node = node.parent
        for seen in way:
            self.above[(id(seen), steps, k)] = found
        return found

    def look(self, node: Node) -> tuple[str, str]:
        """display and visibility of an element, each empty where nothing sets it."""
        a = node.attributes
        best: dict = {key: ((important, 1), value) for key, (important, value) in declared(a["style"]).items()} if "style" in a else {}
        if self.rules:
            for key in ("*", node.tag, "#" + a["id"] if "id" in a else None, *("." + c for c in set(a.get("class", "").split()))):
                for steps, says, weight, order in self.rules.get(key, ()):
                    if self._matches(node, steps):
                        for prop, (important, value) in says.items():
                            rank = (important, 0, weight, order)
                            if prop not in best or rank > best[prop][0]:
                                best[prop] = rank, value
        display, visibility = (best.get(p, (0, ""))[1] for p in ("display", "visibility"))
        return display or ("none" if "hidden" in a else ""), visibility


def prune(root: Node, sheet: Sheet) -> None:
    """Take from a tree what a reader does not see.

    Elements that are not displayed go with all they hold. Hidden ones lose
    their text and stay only around parts that are set back to visible, but
    for cells, which keep their place in a row that is seen.
    """
    unseen: dict[int, bool] = {}  # displayed elements: whether they are hidden
    order, todo = [], [(root, False)]
    while todo:
        node, off = todo.pop()
        order.append(node)
        unseen[id(node)] = off
        for c in node.children:
            if isinstance(c, str) or c.tag in UNSEEN and not (c.tag == "dialog" and "open" in c.attributes) or c.tag == "input" and c.attributes.get("type", "").lower() == "hidden":
                continue
            display, visibility = sheet.look(c)
            if display != "none" and not (visibility == "collapse" and c.tag in ("tr", "thead", "tbody", "tfoot")):
                todo.append((c, visibility in ("hidden", "collapse") or off and visibility not in ("visible", "initial")))
    kept: set[int] = set()
    for node in reversed(order):  # inner elements before those around them
        if not unseen[id(node)] or any(id(c) in kept for c in node.children):
            kept.add(id(node))
    for node in order:
        off = unseen[id(node)]
        node.children = [c for c in node.children if (not off if isinstance(c, str) else id(c) in kept or c.tag in ("td", "th") and id(c) in unseen)]


class _Writer:
    """Lines of text with at most the wanted number of line ends between blocks."""

    def __init__(self):
        self.lines, self.wanted = [], 0
        self.start()

    def start(self, text: str = "") -> None:
        """A new current line that begins with ``text``."""
        self.parts, self.empty, self.spaced = [text], not text.strip(), text[-1:] in ("", " ")

    def end(self) -> None:
        self.lines.append("".join(self.parts).rstrip())
        self.start()

    def block(self, blank: bool) -> None:
        if not self.empty:
            self.end()
            self.wanted = 0
        self.start()
        self.wanted = max(self.wanted, int(blank))

    def put(self, text: str) -> None:
        if text.strip():
            self.gap()
            self.empty = False
        if text:
            self.parts.append(text)
            self.spaced = text[-1] == " "

    def words(self, text: str, pre: bool) -> None:
        if pre:
            first, *rest = text.split("\n")
            self.put(first)
            for part in rest:
                self.end()
                self.put(part)
            return
        text = _space.sub(" ", text)
        self.put(text.lstrip(" ") if self.spaced else text)

    def gap(self) -> None:
        """The blank line that is wanted before what comes now."""
        if self.wanted:
            if self.lines and self.lines[-1]:
                self.lines.append("")
            self.wanted = 0

    def text(self) -> list[str]:
        self.block(False)
        return self.lines


def layout(root: Node) -> str:
    """Text of the visible part of a tree. Inner tables are laid out before those around them, so nesting has no limit."""
    prune(root, Sheet(root))
    tables: dict = {}
    for node in reversed([n for n in nodes(root) if n.tag == "table"]):
        tables[id(node)] = _table(node, tables)
    return "\n".join(_lines(root.children, tables)).strip("\n")


def _lines(children: list, tables: dict) -> list[str]:
    out = _Writer()
    # (child, list kind and counter, inside pre); a callable runs when its place is reached.
    todo: list = [(c, None, False) for c in reversed(children)]
    while todo:
        item, listing, pre = todo.pop()
        if callable(item):
            item()
            continue
        if isinstance(item, str):
            out.words(item, pre)
            continue
        tag = item.tag
        if tag == "br":
            out.wanted = 0 if out.empty else out.wanted
            out.end()
            continue
        if tag == "hr":
            out.block(False)
            out.words("---", False)
            out.block(False)
            continue
        if tag == "img":
            if item.attributes.get("alt", "").strip():
                out.words(item.attributes["alt"], False)
            continue
        if tag == "input":
            if item.attributes.get("type", "text").lower() in ("submit", "button", "reset", "text", "search") and item.attributes.get("value"):
                out.words(item.attributes["value"], False)
            continue
        if tag == "table":
            out.block(True)
            if rows := tables[id(item)]:
                out.gap()
                out.lines += rows
            out.wanted = 1
            continue
        if tag in ("ul", "ol", "menu", "dir"):
            nested = listing is not None
            out.block(not nested)
            start = item.attributes.get("start", "1")
            state = {"kind": tag, "next": int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1, "depth": (listing["depth"] + 1) if nested else 0}
            todo.append((lambda nested=nested: out.block(not nested), None, False))
            todo += [(c, state, pre) for c in reversed(item.children)]
            continue
        if tag == "li":
            out.block(False)
            state = listing or {"kind": "ul", "next": 1, "depth": 0}
            mark = f"{state['next']}. " if state["kind"] == "ol" else "- "
            state["next"] += 1
            out.gap()
            out.start("  " * min(state["depth"], DEEPEST) + mark)
            todo.append((lambda: out.block(False), None, False))
            todo += [(c, state, pre) for c in reversed(item.children)]
            continue
        if tag in BLOCK:
            blank = tag in SPACED
            out.block(blank)
            if tag == "dd":
                out.start("  ")
            todo.append((lambda blank=blank: out.block(blank), None, False))
            todo += [(c, listing if tag not in ("td", "th") else None, pre or tag == "pre") for c in reversed(item.children)]
            continue
        todo += [(c, listing, pre or tag in ("textarea", "xmp")) for c in reversed(item.children)]
    return out.text()


def _span(cell: Node, name: str, most: int) -> int:
    found = re.fullmatch(r"\s*(\d+)\D*", cell.attributes.get(name, "1"))
    return min(int(found[1][:9]), most) if found else 1


def _table(table: Node, tables: dict) -> list[str]:
    """Rows with cells padded to their column's width and parted by " | "; a caption comes first.

    A cell over several columns or rows has its text in the first of each and
    leaves the others empty; a row without text shows nothing.
    """
    captions, rows, todo = [], [], [(c, 0) for c in reversed(table.children)]
    sections = 0
    while todo:
        node, section = todo.pop()
        if isinstance(node, str):
            if node.strip():
                captions.append(_space.sub(" ", node).strip())
        elif node.tag == "tr":
            rows.append((node, section))
        elif node.tag in ("tbody", "thead", "tfoot"):
            sections += 1
            todo += [(c, sections) for c in reversed(node.children)]
        else:
            captions += [x for x in _lines([node], tables) if x.strip()]
    grid, spans, now = [], [], None  # spans: columns still covered from above, as (first, beyond, rows left)
    for row, section in rows:
        if section != now:
            spans, now = [], section
        line, at, fresh = {}, 0, []
        extent = max((b for _, b, _ in spans), default=0)
        for cell in row.children:
            if isinstance(cell, str):
                if not cell.strip():
                    continue
                body, wide, tall = [_space.sub(" ", cell).strip()], 1, 1
            else:
                inner = cell.children if cell.tag in ("td", "th") else [cell]
                body = [x.rstrip() for x in "\n".join(_lines(inner, tables)).strip("\n").split("\n")]
                wide, tall = max(1, _span(cell, "colspan", MOST_COLUMNS)), _span(cell, "rowspan", MOST_ROWS) or MOST_ROWS
            for a, b, _ in spans:  # ascending
                if a <= at < b:
                    at = b
            line[at] = body
            if tall > 1:
                fresh.append((at, at + wide, tall))
            at += wide
        spans = sorted([(a, b, n - 1) for a, b, n in spans if n > 1] + [(a, b, n - 1) for a, b, n in fresh])
        if any(any(body) for body in line.values()):
            grid.append((line, max(at, extent)))
    widths: dict[int, int] = {}  # of the columns in which some cell starts
    for line, _ in grid:
        for k, body in line.items():
            widths[k] = max(widths.get(k, 0), *map(len, body))
    columns, out = sorted(widths), list(captions)
    for line, extent in grid:
        shown = columns[: bisect_right(columns, extent - 1)]
        for i in range(max(map(len, line.values()))):
            parts = [(line[k][i] if k in line and i < len(line[k]) else "").ljust(widths[k]) for k in shown]
            out.append(" | ".join(parts).rstrip())
    return out


def page_text(source: str | None) -> str | None:
    """Visible text of a page (null: null)."""
    return None if source is None else layout(parse(source))


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``id_col``, text, n_lines and n_chars of every page.

    Nulls: a null page gives a null text with 0 lines; an empty page an empty
    text; a null id is kept. Repeated rows each give a row. An empty table
    gives an empty result. Pages are read whole, whatever their length or
    nesting. Broken markup is read as text or implied, never refused; what is
    inside a tag, comment or script that never ends is not text. An element
    that is not displayed takes all in it along; one of visibility ``hidden``
    all but the parts set back to visible. Other columns are left out.
    """
    line = pages.select(F.col(id_col).alias("_id"), F.col(html_col).cast("string").alias("_html"))
    schema = shape(line.select("_id", F.lit("").alias("text")))

    def run(batches):
        import pyarrow as pa

        for batch in portions(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([page_text(x) for x in batch.column(1).to_pylist()], pa.string())], names=schema.names)

    lines = F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, F.lit(0)).otherwise(F.size(F.split("text", "\n")))
    return line.mapInArrow(run, schema).select(F.col("_id").alias(id_col), "text", lines.cast("long").alias("n_lines"), F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"))
