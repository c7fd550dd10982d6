"""Visible text of HTML pages: a tree builder with implied tags, visibility rules, and a renderer for blocks, lists and tables.

The builder closes what a start tag ends by itself (p before a block, li before li, cells, rows, options and so
on), adds the tbody and tr that a bare cell implies, and ignores end tags that match nothing in scope.

Visibility follows the cascade: rules of style elements and inline declarations by importance, specificity and order; display
and visibility are read. Selectors may have several parts (descendants, children, classes, ids, attributes); those with other
combinators or pseudo-classes apply to nothing. Of at-rules, supports and those media that fit a screen VIEWPORT wide apply. display:none and
the hidden attribute remove an element, visibility:hidden its text, but not that of visible children. Scripts, head matter,
replaced elements' fallbacks, closed dialogs and what follows the summary of closed details are not shown.

Blocks are set apart by line ends, paragraphs, headings, lists and tables by a blank line; list items get their mark and
are indented by depth. A cell keeps its blocks, lists and tables as lines of its own, and a row is as high as its highest cell; columns
are padded to a common width, with cells that span rows and columns in their places.

Work and output grow in proportion to the page. Lines of more than PAD characters do not widen their column, they run over it. A table whose
columns take more than ROOM characters, or DEEP tables inside one another, is no grid: cells of one line are then joined by a bar, a row
with higher ones is a block a cell (so is each row below DEEP). Indents end at INDENT characters; columns beyond SPAN are not held free.
The renderer keeps its own stack, so nesting of any depth follows the same rules.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
UNSEEN = frozenset("head title script style template noscript iframe noembed noframes datalist object audio video canvas meta link base defs desc metadata symbol annotation annotation-xml".split())
VALUES = frozenset("text search email url tel number submit reset button".split())
AS_BLOCK = frozenset("block flex grid list-item table flow-root".split())
AS_INLINE = frozenset("inline inline-block inline-flex inline-grid contents".split())
#: Pixels; media queries by width are held against it.
VIEWPORT = 1280
#: Columns that a cell may span, as in the standard; a table's columns that rows keep free.
SPAN = 1000
#: Characters to which a column is padded, that a grid is wide, that lines are indented, each at most; grids inside one another.
PAD, ROOM, INDENT, DEEP = 80, 400, 80, 8
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split())
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre table ul menu dir".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
SCOPE = frozenset("html table td th caption template body".split())
# start tag: (open elements it closes, where the search stops)
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
}

_TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)>", re.S)
_BEGUN = re.compile(r"<[/!?A-Za-z]")
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SETS = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?\s*(?=;|\Z)", re.I)
_COMPOUND = re.compile(r"([a-z][\w-]*|\*)?((?:[.#][\w-]+|\[[^\]]*\])*)\Z", re.I)
_PART = re.compile(r"([.#])([\w-]+)|\[\s*([\w-]+)\s*(?:([~|^$*]?=)\s*(?:\"([^\"]*)\"|'([^']*)'|([^\]\s]*)))?\s*\]")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_SPACE = re.compile(r"[ \t\r\n\f]+")


class Node:
    """display and visible are None where nothing sets them; display is then the tag's own, visibility the parent's."""

    __slots__ = ("tag", "attrs", "children", "display", "visible")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children, self.display, self.visible = tag, attrs, [], None, None


def parse(html: str) -> Node:
    """The tree of a page; text nodes are strings with entities resolved."""
    root = Node("html", {})
    stack, at, n, last = [root], 0, len(html), html.rfind(">")
    places: dict[str, list[int]] = {}  # where in the stack each tag is open

    def text(part: str) -> None:
        if part:
            stack[-1].children.append(unescape(part) if "&" in part else part)

    def cut(k: int) -> None:
        for node in stack[k:]:
            places[node.tag].pop()
        del stack[k:]

    def last_of(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close(tags, stops) -> None:
        k = last_of(tags)
        if k and k >= last_of(stops):
            cut(k)

    def close_all(tags, stops) -> None:
        low, first = last_of(stops) + 1, len(stack)
        for t in tags:
            own = places.get(t, ())
            if (k := bisect_left(own, low)) < len(own):
                first = min(first, own[k])
        cut(first)

    def opened(tag: str, attrs: dict[str, str]) -> Node:
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        places.setdefault(tag, []).append(len(stack))
        stack.append(node)
        return node

    while at < n:
        m = _TOKEN.search(html, at) if at <= last or html.find("<!--", at) >= 0 else None
        if m is None:  # a tag that the page's end cuts short is no text
            rest = html[at:]
            cut = _BEGUN.search(rest)
            text(rest[: cut.start()] if cut else rest)
            break
        text(html[at : m.start()])
        at = m.end()
        tag = m[2].lower() if m[2] else ""
        if not tag:
            continue
        if m[1]:
            if tag in VOID:
                if tag == "br":
                    stack[-1].children.append(Node("br", {}))
                continue
            stops = {"table", "html"} if tag in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption") else {"html"} if tag in SCOPE else SCOPE
            close({tag}, stops)
            continue
        attrs = {a[1].lower(): unescape(a[2] or a[3] or a[4] or "") for a in _ATTR.finditer(m[3])} if m[3] else {}
        if tag in ("html", "body"):
            root.attrs.update(attrs)
            if tag == "body":
                close({"head"}, {"html"})
            continue
        if tag in CLOSES_P:
            close({"p"}, SCOPE | {"button"})
        if tag in IMPLIED:
            close_all(*IMPLIED[tag])
        if tag[0] == "h" and tag[1:].isdigit() and stack[-1].tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            cut(len(stack) - 1)
        if stack[-1].tag == "head" and tag not in ("title", "meta", "link", "base", "script", "style", "template", "noscript"):
            cut(len(stack) - 1)
        if tag == "tr" and stack[-1].tag == "table":
            opened("tbody", {})
        if tag in ("td", "th"):
            if stack[-1].tag == "table":
                opened("tbody", {})
            if stack[-1].tag in ("tbody", "thead", "tfoot"):
                opened("tr", {})
        node = opened(tag, attrs)
        if tag in VOID:
            cut(len(stack) - 1)
        elif tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            body = html[at : end.start() if end else n]
            node.children.append(unescape(body) if tag in ("title", "textarea") else body)
            at = end.end() if end else n
            cut(len(stack) - 1)
    return root


def _media_fits(query: str) -> bool:
    """Whether one of the comma-separated queries holds for a screen of the viewport's width."""
    for one in query.lower().split(","):
        words = re.sub(r"\([^)]*\)", " ", one).split()
        kinds = [w for w in words if w not in ("and", "only")]
        fits = not kinds or kinds in (["screen"], ["all"], ["not", "print"])
        for name, value, unit in re.findall(r"\(\s*([\w-]+)\s*(?::\s*([\d.]+)?\s*([\w%-]*)\s*)?\)", one):
            pixels = float(value) * (16 if unit in ("em", "rem") else 1) if value.count(".") < 2 and value.strip(".") else None
            fits = fits and pixels is not None and (name == "min-width" and VIEWPORT >= pixels or name == "max-width" and VIEWPORT <= pixels)
        if fits and one.strip():
            return True
    return not query.strip()


def _declared(body: str) -> list[tuple[str, str, bool]]:
    return [(m[1].lower(), m[2].lower(), bool(m[3])) for m in _SETS.finditer(body)]


def _rules(css: str) -> list[tuple[str, list[tuple[str, str, bool]]]]:
    """(selectors, declarations of display and visibility) in order, out of at-rules that apply too."""
    out, at, shown = [], 0, [True]
    css = _COMMENT.sub(" ", css)
    for m in re.finditer(r"[{};]", css):
        head, ended = css[at : m.start()].strip(), m[0]
        if ended == "{":
            name, _, rest = head.partition(" ")
            kind = name.lower().partition("(")[0]
            if not head.startswith("@"):
                end = css.find("}", m.end())
                body = css[m.end() : end if end >= 0 else len(css)]
                if shown[-1] and (found := _declared(body)):
                    out.append((head, found))
                shown.append(False)
            else:
                shown.append(shown[-1] and (kind in ("@supports", "@layer", "@container") or kind == "@media" and _media_fits(head[6:])))
        elif ended == "}" and len(shown) > 1:
            shown.pop()
        at = m.end()
    return out


def _compound(text: str):
    """(tag or '', [(kind, name, operator, value)]) or None for what is not understood."""
    m = _COMPOUND.match(text)
    if not m or not text:
        return None
    parts = [(p[1], p[2], "", "") if p[1] else ("[", p[3].lower(), p[4] or "", p[5] or p[6] or p[7] or "") for p in _PART.finditer(m[2])]
    return (m[1] or "").lower().replace("*", ""), parts


def _selector(text: str):
    """([(compound, combinator to its left)] from left to right, specificity) or None."""
    words = re.sub(r"\s*>\s*", " > ", text.strip()).split()
    out, near, rank = [], "", [0, 0, 0]
    for w in words:
        if w == ">":
            near = ">"
            continue
        c = _compound(w)
        if c is None:
            return None
        out.append((c, near or " "))
        near = ""
        for kind, *_ in c[1]:
            rank[0 if kind == "#" else 1] += 1
        rank[2] += bool(c[0])
    return (out, tuple(rank)) if out and not near else None


def _fits(node: Node, compound) -> bool:
    tag, parts = compound
    if tag and tag != node.tag:
        return False
    for kind, name, op, value in parts:
        if kind == "#":
            ok = node.attrs.get("id") == name
        elif kind == ".":
            ok = name in node.attrs.get("class", "").split()
        else:
            own = node.attrs.get(name)
            ok = own is not None and (not op or op == "=" and own == value or op == "~=" and value in own.split() or op == "|=" and (own == value or own.startswith(value + "-")) or bool(value) and (op == "^=" and own.startswith(value) or op == "$=" and own.endswith(value) or op == "*=" and value in own))
        if not ok:
            return False
    return True


def _styled(root: Node) -> None:
    """Sets display and visible of all nodes, by the cascade.

    Each part of a selector but the last has a bit: set in `here` where the selector up to it ends at the node, in `above` where it ends at the node
    or an ancestor. A node looks at its parent's bits only, whatever its depth."""
    sheets, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.tag == "style" and node.children and _media_fits(node.attrs.get("media", "")):
            sheets.append(node.children[0])
        todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    by_key: dict[str, list] = {}
    n = bits = 0
    for css in sheets:
        for names, sets in _rules(css):
            for name in names.split(","):
                n += 1
                parsed = _selector(name)
                if not parsed:
                    continue
                parts, rank = parsed
                for k, (compound, near) in enumerate(parts):
                    tag, tests = compound
                    own = next((kind + x for kind, x, *_ in tests if kind in ".#"), None) or tag or "*"
                    final = k == len(parts) - 1
                    by_key.setdefault(own, []).append((compound, 1 << (bits - 1) if k else 0, near == ">", 0 if final else 1 << bits, (rank, n, sets) if final else None))
                    bits += not final
    todo = [(root, 0, 0)]
    while todo:
        node, parent, above = todo.pop()
        a, found, here = node.attrs, [], 0
        if by_key:
            keys = [node.tag, "*", *(f".{c}" for c in set(a.get("class", "").split())), f"#{a.get('id', '')}"]
            for key in keys:
                for compound, needs, child, bit, rule in by_key.get(key, ()):
                    if (not needs or needs & (parent if child else above)) and _fits(node, compound):
                        here |= bit
                        if rule:
                            rank, place, sets = rule
                            found += [((important, *rank, place), name, value) for name, value, important in sets]
        if "style" in a:
            found += [((important, 1 << 30, 0, 0, k), name, value) for k, (name, value, important) in enumerate(_declared(a["style"]))]
        if "hidden" in a:
            node.display = "none"
        for _, name, value in sorted(found):
            if name == "display":
                node.display = value
            elif value != "inherit":
                node.visible = value not in ("hidden", "collapse")
        if node.display != "none":
            todo += [(c, here, above | here) for c in reversed(node.children) if isinstance(c, Node)]


def _hidden(node: Node) -> bool:
    return node.tag in UNSEEN or node.display == "none" or (node.tag == "dialog" and "open" not in node.attrs)


def _whole(text: str | None, least: int, most: int, other: int) -> int:
    t = (text or "").strip()
    return min(most, max(least, int(t))) if t.isascii() and t.lstrip("-").isdigit() and len(t) < 10 else other


class _Writer:
    """Collects lines; gap is the number of line ends due before the next text, depth that of grids around it."""

    def __init__(self, depth: int = 0):
        self.lines: list[str] = []
        self.parts: list[str] = []  # of the line that is being written, none empty
        self.gap, self.space, self.inked, self.indent, self.mark, self.depth = 0, False, False, "", "", depth

    def add(self, text: str) -> None:
        parts = _SPACE.sub(" ", text)
        if not parts:
            return
        body = parts.strip(" ")
        if parts[0] == " ":
            self.space = True
        if body:
            self._begin()
            if self.space and self.inked and not self.parts[-1].endswith(" "):
                self.parts.append(" ")
            self._put(body)
            self.space = parts[-1] == " "

    def raw(self, text: str) -> None:
        for k, part in enumerate(text.replace("\r\n", "\n").split("\n")):
            if k:
                self.line_end()
            if part:
                self._begin()
                self._put(part)

    def _put(self, part: str) -> None:
        if part:
            self.parts.append(part)
            self.inked = self.inked or bool(part.strip())

    def _begin(self) -> None:
        if self.gap:
            if self.parts or self.lines:
                self.lines.append("".join(self.parts).rstrip())
                self.lines += [""] * (self.gap - 1)
            self.parts, self.gap, self.space, self.inked = [], 0, False, False
        if not self.parts:
            self._put(self.indent + self.mark)
            if self.mark:
                self.deeper(len(self.mark))
                self.mark = ""

    def deeper(self, by: int) -> None:
        self.indent = (self.indent + " " * by)[:INDENT]

    def block(self, gap: int) -> None:
        self.space = False
        if self.parts or self.lines:
            self.gap = max(self.gap, gap)

    def line_end(self) -> None:
        if self.gap or not self.parts:
            self.gap += 1 if self.parts or self.lines else 0
        else:
            self.gap = 1
        self.space = False

    def text(self) -> str:
        return "\n".join([*self.lines, "".join(self.parts).rstrip()]).strip("\n")


def _cells(row: Node, visible: bool, out: list[tuple[list[str], int, int]], w: _Writer):
    """Each cell's lines and spans; below DEEP grids the cells go to w as blocks."""
    for c in row.children:
        if isinstance(c, Node) and c.tag in ("td", "th") and not _hidden(c):
            own = w if w.depth >= DEEP else _Writer(w.depth + 1)
            if own is w:
                w.block(1)
            yield _render(c, own, visible if c.visible is None else c.visible)
            if own is w:
                w.block(1)
            else:
                out.append((own.text().split("\n"), _whole(c.attrs.get("colspan"), 1, SPAN, 1), _whole(c.attrs.get("rowspan"), 0, 65534, 1)))


def _placed(groups: list[list[list[tuple[list[str], int, int]]]]) -> list[list[tuple[int, list[str], int]]]:
    """Each row's cells at their columns; a cell that spans rows keeps its columns, up to SPAN of a table, free in those of its group."""
    rows = []
    for group in groups:
        taken: dict[int, int] = {}
        for k, row in enumerate(group):
            at, placed, held = 0, [], {c: left - 1 for c, left in taken.items() if left > 1}
            for cell, span, down in row:
                while at in taken:
                    at += 1
                placed.append((at, cell, span))
                if down != 1:
                    for c in range(at, min(at + span, SPAN)):
                        held[c] = (len(group) - k if down == 0 else down) - 1
                at += span
            taken = {c: left for c, left in held.items() if left > 0}
            rows.append(placed)
    return rows


def _widths(rows: list[list[tuple[int, list[str], int]]]) -> dict[int, int] | None:
    """Widths of the columns, by lines of at most PAD characters, those of single columns first; None if they are no grid of ROOM characters."""
    columns = max((at + span for row in rows for at, _, span in row), default=0)
    if columns * 3 > ROOM:
        return None
    width = dict.fromkeys(range(columns), 0)
    for wide in (False, True):
        for row in rows:
            for at, cell, span in row:
                if wide == (span > 1):
                    room = sum(width[c] for c in range(at, at + span)) + 3 * (span - 1)
                    width[at + span - 1] += max(0, max((len(x) for x in cell if len(x) <= PAD), default=0) - room)
    return width if sum(width.values()) + 3 * (columns - 1) <= ROOM else None


def _grid_row(row: list[tuple[int, list[str], int]], width: dict[int, int]) -> list[str]:
    lines = []
    for k in range(max((len(cell) for _, cell, _ in row), default=0)):
        parts, at = [], 0
        for start, cell, span in row:
            parts += [" " * width[c] for c in range(at, start)]
            at = start + span
            parts.append((cell[k] if k < len(cell) else "").ljust(sum(width[c] for c in range(start, at)) + 3 * (span - 1)))
        lines.append(" | ".join(parts).rstrip(" "))
    return lines if any(x.strip(" |") for x in lines) else []


def _table(node: Node, w: _Writer, visible: bool):
    groups: list[list[list[tuple[list[str], int, int]]]] = []
    todo, loose = [(c, None) for c in reversed(node.children)], None
    while todo:
        c, own = todo.pop()
        if isinstance(c, str):
            if c.strip() and visible:
                w.add(c)
        elif not _hidden(c):
            seen = visible if c.visible is None else c.visible
            if c.tag == "tr":
                if own is None:
                    loose = own = [] if loose is None else loose
                    if not own:
                        groups.append(own)
                own.append([])
                yield _cells(c, seen, own[-1], w)
            elif c.tag in ("thead", "tbody", "tfoot"):
                groups.append([])
                todo += [(x, groups[-1]) for x in reversed(c.children)]
            elif c.tag not in ("col", "colgroup"):
                w.block(1)
                yield _render(c, w, seen)
                w.block(1)
    rows = _placed(groups)
    width = _widths(rows)
    for row in rows:
        if width is not None:
            blocks = [_grid_row(row, width)]
        elif all(len(cell) == 1 for _, cell, _ in row):
            blocks = [[line] if (line := " | ".join(cell[0] for _, cell, _ in row).strip(" ")).strip(" |") else []]
        else:
            blocks = [cell for _, cell, _ in row if any(cell)]
        for lines in blocks:
            if lines:
                w.block(1)
                w.raw("\n".join(lines))
                w.block(1)


def _mark(node: Node, number: int) -> str:
    """An item's number as its list counts: 1, a, A, i or I."""
    kind = node.attrs.get("type", "1")
    if kind in ("a", "A") and number > 0:
        out = ""
        while number:
            number, k = divmod(number - 1, 26)
            out = chr(97 + k) + out
        return (out if kind == "a" else out.upper()) + ". "
    if kind in ("i", "I") and 0 < number < 4000:
        out = ""
        for value, letters in zip((1000, 900, 500, 400, 100, 90, 50, 40, 10, 9, 5, 4, 1), "m cm d cd c xc l xl x ix v iv i".split()):
            out += letters * (number // value)
            number %= value
        return (out if kind == "i" else out.upper()) + ". "
    return f"{number}. "


def _options(select: Node) -> list[Node]:
    """The options that a select shows: all of a list box, the selected or first one of a menu."""
    own, todo = [], list(reversed(select.children))
    while todo:
        c = todo.pop()
        if isinstance(c, Node) and not _hidden(c):
            if c.tag == "option":
                own.append(c)
            else:
                todo += reversed(c.children)
    if "multiple" in select.attrs or _whole(select.attrs.get("size"), 0, 1000, 0) > 1:
        return own
    return ([c for c in own if "selected" in c.attrs] or own)[-1 if any("selected" in c.attrs for c in own) else 0 :][:1]


def _render(node: Node, w: _Writer, visible: bool, pre: bool = False):
    """Writes the children of a node. A generator: it yields the renderers of nested elements, which _run works off with a stack of its own."""
    items = [c for c in node.children if isinstance(c, Node) and c.tag == "li"] if node.tag == "ol" else []
    step = -1 if "reversed" in node.attrs else 1
    number = _whole(node.attrs.get("start"), -(10**9), 10**9, len(items) if step < 0 else 1) if node.tag == "ol" else 1
    shut = node.tag == "details" and "open" not in node.attrs
    summary = next((c for c in node.children if isinstance(c, Node) and c.tag == "summary"), None) if shut else None
    drawn = node.tag == "svg"
    for c in node.children:
        if isinstance(c, str):
            if not shut and visible and not drawn:
                w.raw(c) if pre else w.add(c)
            continue
        if _hidden(c) or (shut and c is not summary):
            continue
        tag, seen = c.tag, visible if c.visible is None else c.visible
        if tag == "br":
            w.line_end()
        elif tag == "hr":
            w.block(1)
        elif tag == "input":
            if seen and c.attrs.get("type", "text").lower() in VALUES:
                w.add(c.attrs.get("value", ""))
        elif tag == "textarea":
            if seen and c.children:
                w.raw(c.children[0].removeprefix("\n"))
        elif tag == "select":
            shown = _options(c)
            for o in shown:
                if len(shown) > 1:
                    w.block(1)
                yield _render(o, w, seen if o.visible is None else o.visible)
            if len(shown) > 1:
                w.block(1)
        elif tag == "table":
            w.block(2)
            yield _table(c, w, seen)
            w.block(2)
        elif tag == "li":
            w.block(1)
            if node.tag == "ol":
                number = _whole(c.attrs.get("value"), -(10**9), 10**9, number)
            indent, w.mark = w.indent, _mark(node, number) if node.tag == "ol" else "- "
            number += step
            yield _render(c, w, seen, pre)
            w.indent, w.mark = indent, ""
            w.block(1)
        elif c.display in AS_BLOCK or (tag in BLOCK and c.display not in AS_INLINE) or (drawn and tag == "text"):
            gap = 1 if tag in ("ul", "ol", "menu", "dir") and node.tag == "li" else 2 if tag in SPACED else 1
            w.block(gap)
            indent = w.indent
            if tag in ("blockquote", "dd"):
                w.deeper(2)
            yield _render(c, w, seen, pre or tag in ("pre", "listing", "xmp"))
            w.indent = indent
            w.block(gap)
        else:
            yield _render(c, w, seen, pre)


def _run(renderer) -> None:
    stack = [renderer]
    while stack:
        inner = next(stack[-1], None)
        if inner is None:
            stack.pop()
        else:
            stack.append(inner)


def visible_text(html: str | None) -> str:
    if not html:
        return ""
    root = parse(html)
    _styled(root)
    w = _Writer()
    if not _hidden(root):
        _run(_render(root, w, root.visible is not False))
    return w.text()


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, text, n_lines of each whole page. Null and empty pages give an empty text; null ids and repeated rows stay; other columns are ignored."""

    def run(batches):
        for b in sliced(batches):
            texts = [visible_text(h) for h in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int32())], ["page_id", "text", "n_lines"])

    return pages.select(F.col(id_col).cast("long"), F.col(html_col).cast("string")).mapInArrow(run, "page_id long, text string, n_lines int")
