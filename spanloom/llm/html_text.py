"""Layout-aware text of HTML pages: a tree builder with implied tags, visibility rules and a renderer.

The builder closes what a start tag implies closed (paragraphs before blocks, items, cells, rows, options,
terms) and ignores end tags that match nothing.  The renderer leaves out what a browser does not show, keeps
blank lines between blocks, marks and indents list items, keeps preformatted text and pads table cells so
that columns line up.
"""

from __future__ import annotations

import html
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import exactly, free_name

# Element names by role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template title meta link base noscript iframe object embed audio video canvas datalist param source track noembed noframes defs desc metadata symbol clippath mask marker pattern annotation annotation-xml rp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure fieldset menu dir".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPE = frozenset("table td th caption html template button object".split())
#: What a start tag closes, and at which ancestors the search for it ends.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist", "optgroup")), "optgroup": (("option", "optgroup"), ("select",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tr": (("td", "th", "tr", "caption", "colgroup"), ("table",)),
    "tbody": (("td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)),
    "thead": (("td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)),
    "tfoot": (("td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)),
    "body": (("head",), ("html",)), "caption": (("caption", "colgroup"), ("table",)), "colgroup": (("caption", "colgroup"), ("table",)), "col": (("caption",), ("table",)),
}
GROUPS = ("tbody", "thead", "tfoot")
#: Where a cell, a row and the rest of a table's parts may stand.
HOLDERS = {"td": ("tr", *GROUPS, "table"), "th": ("tr", *GROUPS, "table"), "tr": (*GROUPS, "table"), **{x: ("table",) for x in (*GROUPS, "caption", "colgroup")}}
IN_HEAD = frozenset("base basefont bgsound link meta title style script noscript template noframes head".split())
DEEPEST = 300

_TAG_END = re.compile(r"""(?:[^"'>]++|"[^"]*+"|'[^']*+')*+>""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_SPACES = re.compile(r"[ \t\n\r\f]+")
_DECLARATION = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)", re.I)
_RULE = re.compile(r"([^{}]*)\{([^{}]*)\}")
_SIMPLE = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+)*)$")


class Node:
    """An element: its name, attributes and children (nodes and strings)."""

    __slots__ = ("name", "attributes", "children", "parent", "depth", "open", "cut", "shown", "silent")

    def __init__(self, name: str, attributes: dict[str, str], parent: "Node | None"):
        self.name, self.attributes, self.parent = name, attributes, parent
        self.children: list = []
        self.depth = parent.depth + 1 if parent else 0
        #: The names of the element and its ancestors, shared between elements; so that a search for none of them is no walk.
        self.open = parent.open if parent is not None and name in parent.open else (parent.open if parent is not None else frozenset()) | {name}
        #: Whether it is left out with all that it holds; whether it has a box; whether its own text is hidden.
        self.cut, self.shown, self.silent = False, True, False


def _attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(source):
        if value[:1] in ("'", '"'):
            value = value[1:-1]
        out.setdefault(name.lower(), html.unescape(value))
    return out


def _close(at: Node, names: tuple[str, ...], stops) -> Node:
    """The parent of the outermost open element of ``names`` below the nearest of ``stops``; else ``at``."""
    found, node = None, at
    while node is not None and node.name not in stops and not at.open.isdisjoint(names):
        if node.name in names:
            found = node
        node = node.parent
    return found.parent if found is not None and found.parent is not None else at


def _holder(at: Node, names: tuple[str, ...]) -> Node:
    """The nearest open element of ``names``, if no cell, caption or end of a table stands between; else ``at``."""
    node = at
    if at.open.isdisjoint(names):
        return at
    while node is not None and node.name not in names:
        if node.name in ("td", "th", "caption", "table", "template"):
            return at
        node = node.parent
    return node or at


def _foreign(at: Node) -> bool:
    """Whether an element is part of a drawing or a formula, where tags may close themselves."""
    node = at
    while node is not None and node.name not in ("svg", "math", "foreignobject"):
        node = node.parent
    return node is not None and node.name != "foreignobject"


def parse(source: str) -> Node:
    """The tree of a page."""
    root = Node("#document", {}, None)
    at, pos, n = root, 0, len(source)

    foreign = "<svg" in (low := source.lower()) or "<math" in low

    def text(a: int, b: int) -> None:
        nonlocal at
        if b > a:
            if at.name in ("head", "colgroup") and at.parent and not source[a:b].isspace():
                at = at.parent
            at.children.append(html.unescape(source[a:b]))

    while pos < n:
        lt = source.find("<", pos)
        if lt < 0 or lt == n - 1:
            text(pos, n)
            break
        nxt = source[lt + 1]
        if nxt == "!" or nxt == "?":
            text(pos, lt)
            if source.startswith("<!--", lt):
                end = source.find("-->", lt + 2 if source.startswith("<!-->", lt) else lt + 4)
                pos = n if end < 0 else end + 3
            else:
                end = source.find(">", lt)
                pos = n if end < 0 else end + 1
            continue
        closing = nxt == "/"
        named = _NAME.match(source, lt + 2 if closing else lt + 1)
        if not named:
            if closing and lt + 2 < n:
                text(pos, lt)
                end = source.find(">", lt)
                pos = n if end < 0 else end + 1
            else:
                text(pos, lt + 1)
                pos = lt + 1
            continue
        text(pos, lt)
        name = named.group().lower()
        ended = _TAG_END.match(source, named.end())
        if ended:
            stop = ended.end()
        else:
            stop = source.find(">", named.end()) + 1 or n
        pos = stop
        if closing:
            if name == "br":
                at.children.append(Node("br", {}, at))
                continue
            node = at
            edge = () if name in SCOPE or name in ("tr", "tbody", "thead", "tfoot", "body", "head") else ("td", "th", "table")
            while name in at.open and node is not None and node.name != name and node.name not in edge:
                node = node.parent
            if node is not None and node.name == name:
                at = node.parent or root
            elif name == "p":
                at.children.append(Node("p", {}, at))
            continue
        if at.parent and (at.name == "head" and name not in IN_HEAD or at.name == "colgroup" and name not in ("col", "template")):
            at = at.parent
        if name in IMPLIED:
            at = _close(at, *IMPLIED[name])
        if name in HOLDERS:
            at = _holder(at, HOLDERS[name])
            if name in ("td", "th") and at.name in HOLDERS["tr"]:
                row = Node("tr", {}, at)
                at.children.append(row)
                at = row
        if name in CLOSES_P:
            at = _close(at, ("p",), SCOPE)
            if name in HEADINGS and at.name in HEADINGS and at.parent:
                at = at.parent
        inner = source[named.end() : stop - 1]
        node = Node(name, _attributes(inner) if inner.strip(" /\n\t\r") else {}, at)
        at.children.append(node)
        if name in VOID or (foreign and source[stop - 2] == "/" and _foreign(at)) or (name in ("svg", "math") and source[stop - 2] == "/"):
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, pos)
            stop = end.start() if end else n
            if stop > pos:
                node.children.append(html.unescape(source[pos:stop]) if name == "textarea" else source[pos:stop])
            close = source.find(">", stop) if end else -1
            pos = n if close < 0 else close + 1
            continue
        at = node
    _decide(root)
    return root


def style_rules(root: Node) -> list[tuple[str, frozenset[str], frozenset[str], dict[str, str]]]:
    """Element, classes and ids, with what they declare, of the simple selectors of a page's style sheets, weakest first.

    Rules of combined selectors, pseudo-classes and conditional groups (but ``@media screen`` and ``all``) aren't applied.
    """
    found, todo, count = [], [root], 0
    while todo:
        node = todo.pop()
        if node.name == "style":
            sheet = re.sub(r"/\*.*?\*/", "", "".join(c for c in node.children if isinstance(c, str)), flags=re.S)
            sheet = re.sub(r"@media\s+(?:screen|all)\s*\{((?:[^{}]*\{[^{}]*\})*)\s*\}", r"\1", sheet, flags=re.I)
            sheet = re.sub(r"@[^{};]*(?:;|\{(?:[^{}]*\{[^{}]*\})*[^{}]*\})", "", sheet)
            for selectors, block in _RULE.findall(sheet):
                says = {k.lower(): v.lower() for k, v in _DECLARATION.findall(block)}
                for one in selectors.split(",") if says else ():
                    simple = _SIMPLE.match(one.strip())
                    if not one.strip() or not simple:
                        continue
                    marks = re.findall(r"([.#])([\w-]+)", simple[2])
                    ids, classes = (frozenset(n for m, n in marks if m == k) for k in "#.")
                    count += 1
                    element = "" if simple[1] in (None, "*") else simple[1].lower()
                    found.append(((len(ids), len(classes), bool(element), count), (element, classes, ids, says)))
        todo += [c for c in reversed(node.children) if not isinstance(c, str)]
    return [rule for _, rule in sorted(found, key=lambda x: x[0])]


def _decide(root: Node) -> None:
    """Sets what a browser shows: ``display: none`` cuts a subtree; visibility is inherited, and a descendant can be visible again."""
    rules = style_rules(root)
    todo: list[tuple[Node, str]] = [(root, "visible")]
    while todo:
        node, inherited = todo.pop()
        a, says = node.attributes, {}
        if rules:
            own = frozenset(a.get("class", "").split())
            for element, classes, ids, declared in rules:
                if (not element or element == node.name) and classes <= own and (not ids or ids == {a.get("id")}):
                    says |= declared
        if "hidden" in a and "display" not in says:
            says["display"] = "none"
        if "style" in a:
            says |= {k.lower(): v.lower() for k, v in _DECLARATION.findall(a["style"])}
        visibility = says.get("visibility", "inherit")
        visibility = inherited if visibility in ("inherit", "unset") else "visible" if visibility == "initial" else visibility
        node.silent = visibility in ("hidden", "collapse")
        node.cut = node.name in HIDDEN or says.get("display") == "none" or (node.name == "input" and a.get("type", "").lower() == "hidden") or (node.name == "dialog" and "open" not in a)
        if node.parent is not None and node.parent.name == "details" and "open" not in node.parent.attributes and node.name != "summary":
            node.cut = True
        if not node.cut:
            todo += [(c, visibility) for c in node.children if not isinstance(c, str)]
    _seen(root)


def _seen(root: Node) -> None:
    """Leaves out hidden text, and joins what is nested beyond ``DEEPEST`` to the element at that depth, in order."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        node.children = [c for c in node.children if isinstance(c, str) or not c.cut]
        if node.silent or (node.name == "details" and "open" not in node.attributes):
            node.children = [c for c in node.children if not isinstance(c, str)]
        todo += [c for c in node.children if not isinstance(c, str)]
    for node in reversed(order):  # a silent element without anything to show has no marker, cell or field of its own
        node.shown = not node.silent or any(isinstance(c, str) or c.shown for c in node.children)
    for node in order:
        if node.depth == DEEPEST:
            flat, stack = [], list(reversed(node.children))
            while stack:
                c = stack.pop()
                if isinstance(c, str) or not c.children:
                    flat.append(c)
                else:
                    edge = [Node("div", {}, node)] if c.name in BLOCK else []
                    stack += [*edge, *reversed(c.children), *edge]
            node.children = flat


def visible(node: Node) -> bool:
    """Whether anything of the element shows."""
    return not node.cut and node.shown


def width(line: str) -> int:
    """Columns that a line takes: wide and full-width characters two, combining marks none."""
    if line.isascii():
        return len(line)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in line)


class Flow:
    """Lines of text: inline text collects until a block or a break ends its line; margins collapse."""

    def __init__(self):
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.margin = False

    def say(self, text: str) -> None:
        self.inline.append(text)

    def end_line(self, forced: bool = False) -> None:
        line = _SPACES.sub(" ", "".join(self.inline)).strip(" ")
        self.inline = []
        if line or (forced and self.lines and not self.margin):
            self._put(line)

    def _put(self, line: str) -> None:
        if self.margin and self.lines:
            self.lines.append("")
        self.margin = False
        self.lines.append(line)

    def space(self) -> None:
        self.end_line()
        self.margin = True

    def add(self, lines: list[str]) -> None:
        self.end_line()
        for line in lines:
            self._put(line)


def _verbatim(node: Node, out: list[str]) -> None:
    for child in node.children:
        if isinstance(child, str):
            out.append(child)
        elif child.name == "br":
            out.append("\n")
        elif visible(child):
            _verbatim(child, out)


def _block(node: Node) -> list[str]:
    flow = Flow()
    _children(node, flow)
    flow.end_line()
    while flow.lines and not flow.lines[-1]:
        flow.lines.pop()
    return flow.lines


def _list(node: Node, flow: Flow) -> None:
    number = node.attributes.get("start", "1")
    count = int(number) if re.fullmatch(r"-?\d{1,9}", number) else 1
    for child in node.children:
        if isinstance(child, str):
            flow.say(child)
        elif child.name == "li" and visible(child):
            flow.end_line()
            value = child.attributes.get("value", "")
            count = int(value) if re.fullmatch(r"-?\d{1,9}", value) else count
            mark = f"{count}. " if node.name == "ol" else "- "
            count += 1
            lines = _block(child)
            flow.add([(mark if k == 0 else " " * len(mark)) + line if line or k == 0 else "" for k, line in enumerate(lines or [""])])
        elif child.name != "li":
            _element(child, flow)


def _rows(node: Node, out: list[Node], captions: list[Node]) -> None:
    for child in node.children:
        if isinstance(child, str) or not visible(child):
            continue
        if child.name == "tr":
            out.append(child)
        elif child.name in ("tbody", "thead", "tfoot"):
            _rows(child, out, captions)
        elif child.name == "caption":
            captions.append(child)


def _span(cell: Node, name: str) -> int:
    value = cell.attributes.get(name, "1")
    return max(1, min(int(value), 100)) if re.fullmatch(r"\d{1,9}", value) else 1


def _table(node: Node, flow: Flow) -> None:
    rows: list[Node] = []
    captions: list[Node] = []
    _rows(node, rows, captions)
    _strays(node, flow)
    flow.end_line()
    for caption in captions:
        flow.add(_block(caption))
    grid: list[list[tuple[int, int, list[str]]]] = []  # per row: (column, span, lines)
    below: dict[int, int] = {}  # column -> rows that a cell above still covers
    for row in rows:
        column, cells = 0, []
        taken = {c for c, k in below.items() if k > 0}
        below = {c: k - 1 for c, k in below.items() if k > 1}
        loose = [c for c in row.children if not isinstance(c, str) and not c.cut]
        for cell in loose:
            while column in taken:
                column += 1
            if cell.name in ("td", "th"):
                wide, high = _span(cell, "colspan"), _span(cell, "rowspan")
                lines = _block(cell)
            else:
                wide, high, inner = 1, 1, Flow()
                _element(cell, inner)
                inner.end_line()
                lines = inner.lines
            cells.append((column, wide, lines))
            if high > 1:
                below |= {c: high - 1 for c in range(column, column + wide)}
            column += wide
        stray = _SPACES.sub(" ", "".join(c for c in row.children if isinstance(c, str))).strip(" ")
        if stray:
            cells.append((column, 1, [stray]))
        grid.append(cells)
    widths: dict[int, int] = {}
    for cells in grid:
        for column, wide, lines in cells:
            if wide == 1:
                widths[column] = max(widths.get(column, 0), *(width(x) for x in lines), 0)
    for cells in grid:
        for column, wide, lines in cells:
            if wide > 1:
                need = max((width(x) for x in lines), default=0) - 3 * (wide - 1) - sum(widths.get(c, 0) for c in range(column, column + wide))
                if need > 0:
                    widths[column + wide - 1] = widths.get(column + wide - 1, 0) + need
    for cells in grid:
        last = max((c + w for c, w, _ in cells), default=0)
        for k in range(max((len(x) for *_, x in cells), default=0)):
            parts, column = [], 0
            for at, wide, lines in cells:
                parts += [" " * widths.get(c, 0) for c in range(column, at)]
                room = sum(widths.get(c, 0) for c in range(at, at + wide)) + 3 * (wide - 1)
                line = lines[k] if k < len(lines) else ""
                parts.append(line + " " * (room - width(line)))
                column = at + wide
            flow.add([(" | " if last > 1 else "").join(parts).rstrip()])


def _strays(node: Node, flow: Flow) -> None:
    """What stands in a table outside of its rows and captions; a browser shows it before the table."""
    for child in node.children:
        if isinstance(child, str):
            if child.strip():
                flow.say(child)
        elif child.name in GROUPS:
            if visible(child):
                _strays(child, flow)
        elif child.name == "colgroup":
            _strays(child, flow)
        elif child.name not in ("tr", "caption", "col"):
            _element(child, flow)


def _element(node: Node, flow: Flow) -> None:
    name = node.name
    if not visible(node):
        return
    if name == "br":
        flow.end_line(forced=True)
    elif name == "wbr" or name == "img":
        return
    elif name == "input":
        kind = node.attributes.get("type", "text").lower()
        if kind in ("submit", "button", "reset") and node.attributes.get("value"):
            flow.say(f" {node.attributes['value']} ")
    elif name == "text":
        flow.say(" ")
        _children(node, flow)
        flow.say(" ")
    elif name == "select" and "multiple" not in node.attributes and not re.fullmatch(r"0*(?:[2-9]|[1-9]\d+)", node.attributes.get("size", "1")):
        _choice(node, flow)
    elif name not in BLOCK:
        _children(node, flow)
    else:
        edge = flow.space if name in SPACED and not (name in ("ul", "ol") and _in_item(node)) else flow.end_line
        edge()
        if name == "optgroup" and node.attributes.get("label"):
            flow.say(node.attributes["label"])
            flow.end_line()
        if name == "pre":
            parts: list[str] = []
            _verbatim(node, parts)
            flow.add([x.rstrip() for x in "".join(parts).expandtabs(8).strip("\n").split("\n")])
        elif name in ("ul", "ol", "menu", "dir"):
            _list(node, flow)
        elif name == "table":
            _table(node, flow)
        elif name in ("blockquote", "dd"):
            flow.add([f"  {x}" if x else "" for x in _block(node)])
        else:
            _children(node, flow)
        edge()


def _choice(node: Node, flow: Flow) -> None:
    """A menu of one line shows its selected option (the last one so marked), or else its first."""
    todo, options = list(reversed(node.children)), []
    while todo:
        c = todo.pop()
        if not isinstance(c, str):
            options += [c] if c.name == "option" else []
            todo += reversed(c.children)
    chosen = [c for c in options if "selected" in c.attributes][-1:] or options[:1]
    for option in chosen:
        _children(option, flow)


def _in_item(node: Node) -> bool:
    return node.parent is not None and node.parent.name == "li"


def _children(node: Node, flow: Flow) -> None:
    for child in node.children:
        if isinstance(child, str):
            flow.say(child)
        else:
            _element(child, flow)


def render(source: str | None) -> str:
    """The visible text of a page; empty for null, empty and invisible pages."""
    return "\n".join(_block(parse(source))) if source else ""


def extract_text(df: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), out_col: str = "text") -> DataFrame:
    """``keep`` and the visible text of every page, whole.

    Null and empty pages give the empty text.  Elements nested beyond ``DEEPEST`` keep their text, line breaks and visibility, but no
    other layout.  Pages of any length are rendered whole.  Repeated rows give repeated results; an empty table gives an empty result;
    columns not in ``keep`` aren't read, and a kept column of the name ``out_col`` comes back as ``out_col`` with a leading underscore.
    """

    def run(batches):
        for b in batches:
            text = [render(x) for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(text, pa.string())], [*b.schema.names[:-1], out_col])

    base = df.select(*(exactly(c).alias(c if c.lower() != out_col.lower() else free_name(df, f"_{c}")) for c in keep), exactly(html_col))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema[:-1])
    return base.mapInArrow(run, f"{schema}, `{out_col}` string" if len(keep) else f"`{out_col}` string")
