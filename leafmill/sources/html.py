"""HTML pages as blocks: a lenient tree, then headings, paragraphs, lists, tables, code and images."""

from __future__ import annotations

import codecs
import re
from dataclasses import dataclass, field, replace
from html.entities import name2codepoint

from leafmill.model import Block, Cell, Options, Result, Run, Style, collapsed

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head script style noscript template".split())
RAW = frozenset("script style noscript template textarea title".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("html body".split())
#: A start tag closes the nearest of these that is open, up to a boundary.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "tr": ({"tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Depth beyond which elements are put beside their parents instead of into them.
DEPTH = 64
# Fixed values, which must be just these for the same main content: tags, roles and words of classes and ids that mark
# what is not main content (page headers and footers only outside an article), words that speak for it, the tags whose
# texts count as paragraphs and those that can hold the content, and the least length of a paragraph.
CHROME_TAGS = frozenset(["nav", "aside", "dialog", "menu"])
PAGE_CHROME_TAGS = frozenset(["header", "footer"])
CHROME_ROLES = frozenset(["navigation", "banner", "contentinfo", "complementary", "search", "dialog"])
CHROME_WORDS = frozenset([
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "footer", "masthead", "comment", "comments", "ad", "ads", "advert", "advertisement", "sponsor", "sponsored",
    "promo", "related", "share", "social", "cookie", "cookies", "consent", "newsletter", "subscribe", "popup", "modal",
])
CONTENT_WORDS = frozenset(["content", "article", "main", "post", "entry", "story", "prose", "body"])
PARAGRAPHS = frozenset(["p", "pre", "blockquote", "li", "td", "dd"])
CONTAINERS = frozenset(["div", "section", "article", "main", "td", "body", ""])
MIN_PARAGRAPH = 25


_REFERENCE = re.compile(r"&(?:#[xX]([0-9A-Fa-f]+)|#([0-9]+)|([A-Za-z][A-Za-z0-9]*));")
#: Signs of a reference, at most.
REFERENCE = 40


def decoded(text: str) -> str:
    """Text with its character references decoded: those that end in a semicolon, of numbers and of the names of HTML 4."""

    def one(m: re.Match) -> str:
        if len(m[0]) > REFERENCE:
            return m[0]
        if m[3]:
            code = 39 if m[3] == "apos" else name2codepoint.get(m[3], -1)
        else:
            code = int(m[1], 16) if m[1] else int(m[2])
        if code < 0 or code > 0x10FFFF:
            return m[0]
        return "\ufffd" if code == 0 or 0xD800 <= code < 0xE000 else chr(code)

    return _REFERENCE.sub(one, text) if "&" in text else text


@dataclass
class Node:
    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)  # nodes and texts


def parse(text: str) -> Node:
    """The tree of a page; nothing of it is dropped but comments."""
    root = Node("#root")
    stack = [root]
    at = 0

    def add(value: str) -> None:
        if value:
            stack[-1].children.append(decoded(value))

    def close(kinds: set[str], bounds: set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in bounds:
                return
            if stack[k].tag in kinds:
                del stack[k:]
                if kinds & {"tr", "thead"} and len(kinds) > 2:
                    continue
                return

    while m := _TOKEN.search(text, at):
        add(text[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                stack[-1].children.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            if any(n.tag == tag for n in stack[1:]):
                while stack.pop().tag != tag:
                    pass
            continue
        if tag in CLOSES_P:
            close({"p"}, {"table", "td", "th", "li", "button", "blockquote", "div"} - {tag})
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        node = Node(tag, {k.lower(): decoded("".join(v)) for k, *v in _ATTRIBUTE.findall(m[3])})
        stack[-1].children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}[^>]*>", re.I).search(text, at)
            node.children.append(text[at : end.start() if end else len(text)])
            at = end.end() if end else len(text)
            continue
        if len(stack) <= DEPTH:
            stack.append(node)
    add(text[at:])
    return root


def text_of(node: Node | str, keep: bool = False, skip: frozenset[int] = frozenset(), images: bool = True) -> str:
    """Text of a subtree; line breaks count as white space, which is collapsed unless it is kept."""
    parts: list[str] = []
    todo = [node]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            parts.append(n)
        elif n.tag == "br":
            parts.append("\n")
        elif n.tag == "img":
            parts.append(n.attributes.get("alt", "") if images else "")
        elif n.tag not in DROPPED and id(n) not in skip:
            if n.tag in BLOCK and n is not node:
                parts.append(" ")
                todo.append(" ")
            todo += reversed(n.children)
    whole = "".join(parts)
    return whole if keep else " ".join(re.split(r"[ \t\n\r\f]+", whole.strip(" \t\n\r\f")))


def runs_of(node: Node, skip: frozenset[int] = frozenset()) -> list[Run]:
    """The text of a subtree, as text_of gives it, in its styles."""
    out: list[Run] = []
    todo: list[tuple[Node | str, Style]] = [(node, Style())]
    while todo:
        n, style = todo.pop()
        if isinstance(n, str):
            out.append((n, style))
        elif n.tag == "br":
            out.append(("\n", style))
        elif n.tag == "img":
            out.append((n.attributes.get("alt", ""), style))
        elif n.tag not in DROPPED and id(n) not in skip:
            if n.tag in ("b", "strong"):
                style = replace(style, bold=True)
            elif n.tag in ("i", "em"):
                style = replace(style, italic=True)
            elif n.tag in ("code", "kbd", "samp", "tt"):
                style = replace(style, code=True)
            elif n.tag == "a" and n.attributes.get("href", "").strip():
                style = replace(style, href=n.attributes["href"].strip())
            inner = [(c, style) for c in n.children]
            if n.tag in BLOCK and n is not node:
                inner = [(" ", style), *inner, (" ", style)]
            todo += reversed(inner)
    return collapsed(out)


# Names of character sets that stand for others on the web.
CHARSETS = {"iso-8859-1": "windows-1252", "latin1": "windows-1252", "ascii": "windows-1252", "us-ascii": "windows-1252", "shift_jis": "cp932", "gb2312": "gb18030", "gbk": "gb18030", "euc-kr": "cp949", "ks_c_5601-1987": "cp949", "iso-8859-9": "cp1254", "tis-620": "cp874", "utf-16": "utf-8", "utf-16le": "utf-8", "utf-16be": "utf-8"}


def charset(raw: bytes, mime_type: str | None) -> str | None:
    """The character set that a page names: by its first bytes, a meta element near its start, or its type."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16le"), (b"\xfe\xff", "utf-16be")):
        if raw.startswith(mark):
            return name
    told = re.search(rb"<meta\s[^>]*?charset\s*=\s*[\"']?\s*([A-Za-z0-9_:.+-]+)", raw[:1024], re.I)
    name = told[1].decode() if told else (re.search(r"charset\s*=\s*[\"']?([A-Za-z0-9_:.+-]+)", mime_type or "", re.I) or [None, None])[1]
    try:
        return codecs.lookup(CHARSETS.get(name.lower(), name)).name if name else None
    except LookupError:
        return None


def find(node: Node, tags: set[str]) -> list[Node]:
    out, todo = [], [node]
    while todo:
        n = todo.pop()
        if isinstance(n, Node):
            if n.tag in tags:
                out.append(n)
            todo += reversed(n.children)
    return out


def span(node: Node, name: str, most: int) -> int:
    value = node.attributes.get(name, "1").strip()
    return min(max(1, int(value)), most) if value.isdigit() else 1


def table(node: Node, skip: frozenset[int]) -> Block | None:
    """The grid of a table, spans covered by empty cells; leading rows of headers alone are header rows."""
    rows = [r for r in find(node, {"tr"}) if nearest(node, r)]
    grid: list[list[Cell]] = []
    heads: list[bool] = []
    carried: dict[int, int] = {}  # column -> rows still covered from above
    for r in rows:
        line: list[Cell] = []
        cells = [c for c in r.children if isinstance(c, Node) and c.tag in ("td", "th") and id(c) not in skip]
        heads.append(bool(cells) and all(c.tag == "th" for c in cells))

        def covered() -> None:
            while carried.get(len(line), 0):
                carried[len(line)] -= 1
                line.append(Cell())

        for c in cells:
            covered()
            wide, high = span(c, "colspan", 1000), span(c, "rowspan", 65_534)
            for k in range(wide):
                if high > 1:
                    carried[len(line)] = high - 1
                line.append(Cell(text_of(c, skip=skip), row_span=high if high > 1 else None, col_span=wide if wide > 1 else None) if k == 0 else Cell())
        covered()
        grid.append(line)
    width = max(map(len, grid), default=0)
    if not width:
        return None
    caption = next((text_of(c) for c in node.children if isinstance(c, Node) and c.tag == "caption"), None)
    head = next((k for k, h in enumerate(heads) if not h), len(heads))
    return Block("table", rows=[r + [Cell() for _ in range(width - len(r))] for r in grid], header_rows=head, caption=caption or None)


def nearest(table_node: Node, row: Node) -> bool:
    """Whether a row belongs to the table itself, not to one inside it."""
    todo = [table_node]
    while todo:
        n = todo.pop()
        for c in n.children:
            if c is row:
                return True
            if isinstance(c, Node) and c.tag in ("thead", "tbody", "tfoot"):
                todo.append(c)
    return False


def list_items(node: Node, depth: int, skip: frozenset[int]) -> list[tuple[int, str | None, str]]:
    out: list[tuple[int, str | None, str]] = []
    number = int(node.attributes["start"]) - 1 if node.tag == "ol" and node.attributes.get("start", "").lstrip("-").isdigit() else None
    for c in node.children:
        if not isinstance(c, Node) or id(c) in skip:
            continue
        if c.tag in ("ul", "ol"):
            out += list_items(c, depth + 1, skip)
            continue
        inner = [x for x in find(c, {"ul", "ol"}) if x is not c]
        hidden = skip | {id(x) for x in inner}
        number = None if number is None else number + 1
        out.append((depth, None if number is None else f"{number}.", text_of(c, skip=hidden)))
        top: list[Node] = []
        for x in inner:
            if not any(x is y or x in find(y, {"ul", "ol"}) for y in top):
                top.append(x)
        for x in top:
            out += list_items(x, depth + 1, skip)
    return out


def emit(node: Node, out: list[Block], skip: frozenset[int] = frozenset(), runs: bool = False) -> None:
    """Blocks of a subtree; runs of inline content between blocks are paragraphs."""
    run: list = []

    def flush(told: bool = False) -> None:
        """told: the run is a paragraph of its own, whose images are part of its text too; else they part it."""
        part: list = []
        for n in [*run, None]:
            if n is None or isinstance(n, Node) and n.tag == "img" and not told:
                inline = Node("#run", children=part)
                if text := text_of(inline, skip=skip):
                    out.append(Block("paragraph", text, runs=runs_of(inline, skip) if runs else None))
                part = []
                if n is not None and (alt := n.attributes.get("alt", "").strip()):
                    out.append(Block("image", alt=alt))
            else:
                part.append(n)
        for n in run if told else ():
            for image in find(n, {"img"}) if isinstance(n, Node) else ():
                if alt := image.attributes.get("alt", "").strip():
                    out.append(Block("image", alt=alt))
        run.clear()

    for c in node.children:
        if isinstance(c, str) or c.tag not in BLOCK and not find(c, BLOCK):
            run.append(c)
            continue
        flush()
        if id(c) in skip or c.tag in DROPPED:
            continue
        if c.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            if text := text_of(c, skip=skip):
                out.append(Block("heading", text, level=int(c.tag[1])))
        elif c.tag == "pre":
            code = find(c, {"code"})
            language = re.search(r"(?:language|lang)-([\w+#-]+)", " ".join(n.attributes.get("class", "") for n in [c, *code]))
            out.append(Block("code", text_of(c, keep=True).strip("\n"), language=language[1] if language else None))
        elif c.tag in ("ul", "ol"):
            if items := [x for x in list_items(c, 0, skip) if x[2]]:
                out.append(Block("list", ordered=c.tag == "ol", items=items))
        elif c.tag == "table":
            if block := table(c, skip):
                out.append(block)
        elif c.tag in ("p", "blockquote") and not find(Node("#", children=c.children), BLOCK):
            run.append(c)
            flush(told=True)
        else:
            emit(c, out, skip, runs)
    flush()


def words(node: Node) -> set[str]:
    return set(re.findall(r"[a-z]+", f"{node.attributes.get('class', '')} {node.attributes.get('id', '')}".lower()))


def chrome(root: Node) -> frozenset[int]:
    """What of a page is not its main content, whatever it holds."""
    out, todo = set(), [(root, False)]
    while todo:
        n, in_article = todo.pop()
        told = n.tag in CHROME_TAGS or n.tag in PAGE_CHROME_TAGS and not in_article or n.attributes.get("role", "").lower() in CHROME_ROLES
        if told or n.tag not in ("#root", "html", "body", "main", "article") and words(n) & CHROME_WORDS:
            out.add(id(n))
        else:
            todo += [(c, in_article or n.tag == "article") for c in n.children if isinstance(c, Node)]
    return frozenset(out)


def main_content(root: Node) -> tuple[Node, frozenset[int]]:
    """The node that holds the main content, and what inside the page is chrome: the first main element, else the article
    with the most text, else the container that its paragraphs speak for."""
    skip = chrome(root)
    if mains := [n for n in find(root, {"main"}) if id(n) not in skip]:
        return mains[0], skip
    if articles := [n for n in find(root, {"article"}) if id(n) not in skip]:
        return max(articles, key=lambda n: len(text_of(n, skip=skip))), skip
    scores: dict[int, float] = {}
    nodes: dict[int, Node] = {}
    todo: list[tuple[Node, tuple]] = [(root, ())]  # a node, and the containers around it as a chain
    while todo:
        node, around = todo.pop()
        if id(node) in skip or node.tag in DROPPED:
            continue
        inner = (node, around) if node.tag in CONTAINERS or node is root else around
        todo += [(c, inner) for c in node.children if isinstance(c, Node)]
        if node.tag in PARAGRAPHS and around:
            text = text_of(node, skip=skip)
            linked = sum(len(text_of(a)) for a in find(node, {"a"}))
            if len(text) >= MIN_PARAGRAPH and 2 * linked <= len(text):
                for share in (1, 0.5):
                    if around:
                        n, around = around
                        nodes[id(n)] = n
                        scores[id(n)] = scores.get(id(n), 0) + share * (len(text) - linked)
    if not scores:
        return root, skip
    weight = lambda k: scores[k] * (1.25 if words(nodes[k]) & CONTENT_WORDS else 1)
    return nodes[max(scores, key=weight)], skip


def read(text: str, options: Options) -> Result:
    out = Result()
    root = parse(text.removeprefix("﻿"))
    if titles := find(root, {"title"}):
        if title := text_of(Node("#", children=titles[0].children)):
            out.metadata["title"] = title
    page = find(root, {"html"})
    if page and page[0].attributes.get("lang"):
        out.metadata["language"] = page[0].attributes["lang"]
    every: list[Node] = []
    todo: list = [root]
    while todo:
        n = todo.pop()
        if isinstance(n, Node):
            every.append(n)
            todo += n.children
    out.features["has_java_script"] = any(n.tag == "script" or any(a.startswith("on") for a in n.attributes) for n in every)
    out.features["has_external_links"] = any(n.tag in ("img", "link", "iframe", "source") and re.match(r"(?:https?:)?//", n.attributes.get("src") or n.attributes.get("href") or "") for n in every)
    node, skip = main_content(root) if options.main_content else (root, frozenset())
    emit(Node("#page", children=[node]) if node.tag in BLOCK else node, out.blocks, skip, options.runs)
    return out
