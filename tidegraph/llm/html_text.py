"""Visible text of web pages, laid out.

A tokenizer and a small tree builder read the page: end tags that authors leave out are implied, void elements have
no content, raw-text elements end only at their own end tag, and what is left open at the end is closed. The tree
is then rendered: blocks stand on lines of their own with the spacing of their kind, list items carry a bullet or
their number, preformatted text keeps its white space, and the cells of a table stand in columns of equal width.

Not shown, with all that they hold: elements that are never text (head, script, noscript, media and the like), those
with `hidden` or display: none, a dialog that is not open, and of a closed details all but its summary. Text under
visibility: hidden or collapse is left out until visibility: visible further in. Both properties are read from inline
styles and from style elements, where rules of tags, classes and ids without combinators and outside @-rules count,
by specificity and order. Options of a select and the text of an svg are shown.

One pass over the pages, no shuffle; a page is handled alone, without recursion, in memory in proportion to it: a
column is padded to WIDEST at most, a cell over several columns to four times that, and where the lines of a row's
cells differ too much in number, the cells stand below each other.

Defined results: a null or empty page gives the empty text; repeated rows are rendered once each; extra columns are
ignored; an empty table gives an empty result. Broken markup never fails: what is no tag is text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import in_workers, stored, text_batches, work_dir

# fixed values: element names of HTML by how they are parsed and laid out
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
NEVER_SHOWN = frozenset("head script style title noscript iframe noembed noframes template area base basefont datalist link meta param rp source track object audio video canvas desc metadata defs".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext select svg text pre search section summary table tbody td tfoot th thead tr ul xmp caption".split())
SPACED = frozenset("p blockquote dl figure h1 h2 h3 h4 h5 h6 hr listing menu dir ol pre ul table xmp".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul li dd dt".split())
#: An opening tag closes these, up to the nearest element of the second set.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
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
    "body": ({"head"}, {"html"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
}
#: An end tag does not reach past these.
SCOPES = frozenset("html body table td th caption button template".split())

TAG = re.compile(r"<(?:!--(?:-?>|.*?(?:--!?>|\Z))|[!?][^>]*(?:>|\Z)|(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z))", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
MAYBE_HIDDEN = re.compile(r"hidden|style", re.I).search
DECLARED = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)", re.I).findall
AT_RULE = re.compile(r"@[^{};]*(?:;|\{(?:[^{}]*\{[^{}]*\})*[^{}]*\})")
RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
SELECTOR = re.compile(r"(\*|[A-Za-z][\w-]*)?((?:[.#][\w-]+)*)")
#: Characters that a column of a table is padded to.
WIDEST = 60
SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("attributes", "children", "name")

    def __init__(self, name: str, attributes: str = "") -> None:
        self.name, self.attributes, self.children = name, attributes, []

    def attribute(self, name: str) -> str | None:
        for m in ATTRIBUTE.finditer(self.attributes):
            if m[1].lower() == name:
                return html.unescape(m[2] or m[3] or m[4] or "")
        return None


def sheet_rules(css: str) -> list[tuple]:
    """(tag, ids, classes, declarations) of the rules that matter here, those that win last."""
    found = []
    for m in RULE.finditer(AT_RULE.sub(" ", re.sub(r"/\*.*?(?:\*/|\Z)", " ", css, flags=re.S))):
        said = DECLARED(m[2])
        for selector in m[1].split(",") if said else ():
            simple = SELECTOR.fullmatch(selector.strip())
            if simple and simple[0]:
                names = re.findall(r"[.#][\w-]+", simple[2])
                ids, classes = {n[1:] for n in names if n[0] == "#"}, {n[1:] for n in names if n[0] == "."}
                tag = (simple[1] or "*").lower()
                found.append(((len(ids), len(classes), tag != "*"), tag, ids, classes, said))
    return [x[1:] for x in sorted(found, key=lambda x: x[0])]


def look(node: Node, rules: list[tuple]) -> tuple[bool, bool | None]:
    """Whether an element is left out with all it holds; whether its text is visible, where it says so."""
    if node.name in NEVER_SHOWN:
        return True, None
    if not rules and node.name != "dialog" and (not node.attributes or not MAYBE_HIDDEN(node.attributes)):
        return False, None
    own: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(node.attributes):
        own.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    left_out, visible = "hidden" in own and own["hidden"].lower() != "until-found" or node.name == "dialog" and "open" not in own, None
    classes = set(own.get("class", "").split())
    said = [x for tag, ids, of, x in rules if tag in ("*", node.name) and ids <= {own.get("id")} and of <= classes]
    for name, value in [y for x in said for y in x] + DECLARED(own.get("style", "")):
        if name.lower() == "display":
            left_out = value.lower() == "none"
        else:
            visible = value.lower() not in ("hidden", "collapse")
    return left_out, visible


def parse(page: str) -> Node:
    """The tree of a page. Children are nodes and strings; the root's attributes are the page's style sheets."""
    root = Node("#document")
    stack, open_names = [root], {"#document": 1}
    at, end = 0, len(page)

    def close_to(k: int) -> None:
        for node in stack[k:]:
            open_names[node.name] -= 1
        del stack[k:]

    def close_implied(names: set[str], stops: set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in stops:
                break
            if stack[k].name in names:
                close_to(k)
                if names == {"li"} or names == {"option"}:
                    break

    while at < end:
        m = TAG.search(page, at)
        if not m:
            stack[-1].children.append(html.unescape(page[at:]))
            break
        if m.start() > at:
            stack[-1].children.append(html.unescape(page[at : m.start()]))
        at = m.end()
        if not m[2]:
            continue  # a comment or a declaration
        name = m[2].lower()
        if m[1]:
            if name == "br":
                stack[-1].children.append(Node("br"))
            elif open_names.get(name):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name == name:
                        close_to(k)
                        break
                    if stack[k].name in SCOPES and name not in SCOPES and name not in ("tr", "tbody", "thead", "tfoot"):
                        break
            elif name == "p":
                stack[-1].children.append(Node("p"))
            continue
        if name in CLOSES_P and open_names.get("p"):
            close_implied({"p"}, SCOPES)
        if name in IMPLIED:
            names, stops = IMPLIED[name]
            if any(open_names.get(n) for n in names):
                close_implied(names, stops)
        node = Node(name, m[3])
        stack[-1].children.append(node)
        if name in VOID:
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            raw = page[at : close.start()] if close else page[at:]
            if name == "style":
                root.attributes += raw + "\n"
            elif name == "textarea":
                node.children.append(html.unescape(raw))
            elif name == "xmp":
                node.children.append(raw)
            at = close.end() if close else end
            continue
        stack.append(node)
        open_names[name] = open_names.get(name, 0) + 1
    return root


class Lines:
    """Collects text: white space collapses, blocks break lines, and blank lines never double."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space, self.blank, self.prefix = False, False, ""

    def text(self, s: str) -> None:
        words = SPACE.split(s)
        if len(words) == 1:
            self.word(words[0])
            return
        if words[0]:
            self.word(words[0])
        inner = " ".join(w for w in words[1:] if w)
        self.space = True
        if inner:
            self.word(inner)
            self.space = words[-1] == ""

    def word(self, s: str) -> None:
        if not s:
            return
        if not self.line:
            self.line.append(self.prefix)
            self.prefix = " " * len(self.prefix)
        elif self.space:
            self.line.append(" ")
        self.line.append(s)
        self.space = False

    def end_line(self) -> None:
        if self.line:
            if self.blank and self.lines:
                self.lines.append("")
            self.lines.append("".join(self.line).rstrip(" "))
            self.line, self.blank = [], False
        self.space = False

    def break_line(self) -> None:
        """As a br does: an empty line stays one."""
        if self.line:
            self.end_line()
        elif self.lines:
            self.blank = True

    def verbatim(self, s: str) -> None:
        first, *rest = s.split("\n")
        if first:
            self.line += [first] if self.line else [self.prefix, first]
        for part in rest:
            if self.line:
                self.end_line()
            else:
                self.lines.append("")
            if part:
                self.line = [self.prefix, part]

    def block(self, spaced: bool) -> None:
        self.end_line()
        self.blank = self.blank or spaced

    def result(self) -> str:
        self.end_line()
        return "\n".join(self.lines).strip("\n")


def rows_of(table: Node, rules: list[tuple]) -> tuple[list[Node], list[list[Node]]]:
    """Captions, and the cells of each visible row; nested tables stay in their cells."""
    captions, rows, todo = [], [], list(reversed(table.children))
    loose: list[Node] = []
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            if x.strip():
                loose.append(x)
        elif look(x, rules)[0]:
            continue
        elif x.name == "tr":
            rows.append([c for c in x.children if not isinstance(c, str) and not look(c, rules)[0] or isinstance(c, str) and c.strip()])
        elif x.name in ("thead", "tbody", "tfoot"):
            todo += reversed(x.children)
        elif x.name in ("td", "th"):
            rows.append([x])
        elif x.name == "caption":
            captions.append(x)
        elif x.name not in ("colgroup", "col"):
            loose.append(x)
    return captions + loose, rows


def span(cell) -> int:
    value = None if isinstance(cell, str) or "colspan" not in cell.attributes.lower() else cell.attribute("colspan")
    return min(1000, max(1, int(value))) if value and value.strip().isdigit() else 1


def aligned(rows: list[list[tuple[str, int]]]) -> str:
    """Cells (text, columns spanned) in columns of equal width; cells of several lines take several."""
    widths: dict[int, int] = {}
    for row in rows:
        column = 0
        for text, columns in row:
            if columns == 1:
                widths[column] = min(WIDEST, max(widths.get(column, 0), *map(len, text.split("\n"))))
            column += columns
    out = []
    for row in rows:
        cells = [(text.split("\n"), columns) for text, columns in row]
        most = max((len(c) for c, _ in cells), default=0)
        if most * len(cells) > 8 * sum(len(c) for c, _ in cells) + 64:
            out += [line for lines, _ in cells for line in lines]
            continue
        for k in range(most):
            line, column = [], 0
            for lines, columns in cells:
                over = [widths[c] for c in range(column, column + columns) if c in widths]
                width = min(sum(over) + 3 * (len(over) - 1), 4 * WIDEST if columns > 1 else WIDEST)
                line.append((lines[k] if k < len(lines) else "").ljust(width))
                column += columns
            out.append(" | ".join(line).rstrip(" "))
    return "\n".join(out)


def render(root: Node) -> str:
    """The visible text of a tree. A stack of frames instead of recursion, so depth has no limit."""
    # a task: ("open", node), ("close", node), ("cell"/"table", ...); outs: where text goes, the last is current
    outs, lists, tables, pre, tasks = [Lines()], [], [], 0, [("open", x) for x in reversed(root.children)]
    rules, visible = sheet_rules(root.attributes) if root.attributes else [], True
    while tasks:
        what, x = tasks.pop()
        out = outs[-1]
        if what == "open":
            if isinstance(x, str):
                if not visible:
                    continue
                if pre:
                    out.verbatim(x)
                else:
                    out.text(x)
                continue
            left_out, says = look(x, rules)
            if left_out:
                continue
            name = x.name
            if says is not None and says != visible:
                tasks.append(("visible", visible))
                visible = says
            if name == "br":
                out.break_line()
                continue
            if name == "hr":
                out.block(True)
                continue
            if name == "img":
                if visible and "alt" in x.attributes and (alt := x.attribute("alt")):
                    out.text(alt)
                continue
            if name == "table":
                out.block(True)
                extra, rows = rows_of(x, rules)
                tables.append([[]])
                tasks.append(("table", x))
                for row in reversed(rows):
                    tasks.append(("row", None))
                    for cell in reversed(row):
                        tasks += [("cell", span(cell)), ("open", cell), ("lines", None)]
                tasks += [("open", c) for c in reversed(extra)]
                continue
            if name in BLOCKS:
                out.block(name in SPACED and not (lists and name in ("ul", "ol", "menu", "dir")))
            if name in ("ul", "ol", "menu", "dir"):
                start = x.attribute("start") if name == "ol" and "start" in x.attributes else None
                lists.append([name, int(start) if start and re.fullmatch(r"-?\d{1,9}", start.strip()) else 1, out.prefix])
            elif name == "li":
                mark = "- "
                if lists and lists[-1][0] == "ol":
                    mark = f"{lists[-1][1]}. "
                    lists[-1][1] += 1
                tasks.append(("unmark", out.prefix))
                out.prefix = " " * len(out.prefix) + mark
            elif name in ("pre", "listing", "xmp"):
                pre += 1
            elif name in ("dd", "blockquote"):
                tasks.append(("unmark", out.prefix))
                out.prefix += "  "
            tasks.append(("close", x))
            inner = x.children
            if name == "details" and x.attribute("open") is None:
                inner = [c for c in inner if not isinstance(c, str) and c.name == "summary"][:1]
            tasks += [("open", c) for c in reversed(inner)]
        elif what == "visible":
            visible = x
        elif what == "close":
            name = x.name
            if name in ("ul", "ol", "menu", "dir"):
                lists.pop()
            elif name in ("pre", "listing", "xmp"):
                pre -= 1
            if name in BLOCKS:
                out.block(name in SPACED and not (lists and name in ("ul", "ol", "menu", "dir")))
        elif what == "unmark":
            out.end_line()
            out.prefix = " " * len(x) if not x.endswith("  ") else x
        elif what == "lines":
            outs.append(Lines())
        elif what == "cell":
            tables[-1][-1].append((outs.pop().result(), x))
        elif what == "row":
            tables[-1].append([])
        elif what == "table":
            text = aligned([row for row in tables.pop() if any(t for t, _ in row)])
            if text:
                for line in text.split("\n"):
                    out.word(line)
                    out.end_line()
            out.block(True)
    return outs[0].result()


def visible_text(page: str | None) -> str:
    return render(parse(page.replace("\r\n", "\n"))) if page else ""


def extract(pages: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    """key, text: the visible text of every row; written."""
    spark = pages.sparkSession
    given = pages.select(F.col(key).alias("key"), F.col(column).cast("string").alias("page"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([visible_text(p.as_py()) for p in b.column("page")], pa.string())], names=["key", "text"])

    with text_batches(spark):
        out = stored(in_workers(given, work, given.select("key").schema.add("text", "string")), work_dir(spark, "html-text"))
    return out.withColumnRenamed("key", key)
