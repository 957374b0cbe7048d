"""Lenient HTML reading: leaf blocks of text with their tag paths, in page order.

A page is read once from start to end, in time and memory that grow with its length: tags are cut by a scanner that
never seeks a sign again which is known to be missing, and a block holds its path as a link to the nearest element.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup; it ends at the first end tag, or with the page.
RAW = frozenset("script style textarea title iframe noscript noembed noframes xmp".split())
#: Elements whose content is markup but no text of the page; one of the same kind inside is passed over too.
SKIPPED = frozenset("template svg math object select datalist canvas audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr button input".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag closes an open element of these kinds first, looking no further up than a boundary.
CLOSES = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})), "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})), "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "td": (frozenset({"td", "th"}), frozenset({"table", "tr"})), "th": (frozenset({"td", "th"}), frozenset({"table", "tr"})), "tr": (frozenset({"tr"}), frozenset({"table"})),
    "tbody": (frozenset({"thead", "tbody", "tfoot"}), frozenset({"table"})), "thead": (frozenset({"thead", "tbody", "tfoot"}), frozenset({"table"})), "tfoot": (frozenset({"thead", "tbody", "tfoot"}), frozenset({"table"})),
}
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>\"']*+)>")
_ENDS = re.compile(r"[>\"']")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I | re.A) for t in RAW}
_SAME = {t: re.compile(rf"<(/?){t}(?=[\s/>])[^>]*>?", re.I | re.A) for t in SKIPPED}
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Path:
    """An open element: the one around it, and the tokens (tags of blocks, words of classes, ids and roles) that none
    around it has had yet. tags: the last two of blocks, from outside in. Elements that lie alike are one."""

    __slots__ = ("above", "tokens", "tags", "depth", "inner", "vector")

    def __init__(self, above: Path | None, tokens: tuple[str, ...], tags: tuple[str, ...], depth: int):
        self.above, self.tokens, self.tags, self.depth, self.inner, self.vector = above, tokens, tags, depth, {}, None


#: Paths that are remembered from page to page, at most.
PATHS = 20_000


class Paths:
    """Paths by what leads to them, as a tree; begun anew when it has grown large."""

    def __init__(self) -> None:
        self.root, self.size = Path(None, (), (), 0), 0

    def begin(self) -> Path:
        if self.size > PATHS:
            self.__init__()
        return self.root

    def inside(self, above: Path, tag: str, tokens: tuple[str, ...]) -> Path:
        if (found := above.inner.get((tag, tokens))) is None:
            block = tag not in INLINE
            found = above.inner[tag, tokens] = Path(above, tokens, (*above.tags[-1:], tag) if block else above.tags, above.depth + block)
            self.size += 1
        return found


_PATHS = Paths()


@dataclass
class Block:
    text: str
    path: Path
    linked: int  # characters inside links


def attribute_words(attributes: str) -> tuple[str, ...]:
    out: list[str] = []
    for name, *values in _ATTR.findall(attributes):
        value = "".join(values)
        name = name.lower()
        if name in ("class", "id", "role"):
            out += [w.lower() for w in _WORD.findall(html.unescape(value))]
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            out.append("hidden")
    return tuple(out)


def own_tokens(tag: str, attributes: str) -> tuple[str, ...]:
    own = () if tag in INLINE else (f"t:{tag}",)
    if attributes and not attributes.isspace():
        own += tuple(f"n:{w}" for w in dict.fromkeys(attribute_words(attributes)))
    return own


_met_tokens = lru_cache(maxsize=5_000)(own_tokens)


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest): text, cdata, start and end tags; comments, declarations and what is no text are passed over.

    A "<" that begins no tag, or whose tag has no end, is text. A quote that is never closed does not hide the rest.
    """
    at = told = 0  # up to `told` all was given
    missing: set[str] = set()  # signs that do not occur any more

    def find(sign: str, start: int) -> int:
        if sign in missing:
            return -1
        if (k := page.find(sign, start)) < 0:
            missing.add(sign)
        return k

    def end_of_tag(start: int) -> int:
        if (plain := find(">", start)) < 0:
            return -1
        k = start
        while m := _ENDS.search(page, k):
            if m[0] == ">":
                return m.start()
            if (k := find(m[0], m.end()) + 1) <= 0:
                break
        return plain

    while (at := find("<", at)) >= 0:
        if ">" not in missing and (m := _PLAIN.match(page, at)):
            end, found = m.end(), ("end" if m[1] else "start", m[2].lower(), m[3])
        elif page.startswith("<!--", at):
            end = find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            found = None
        elif page.startswith("<![CDATA[", at):
            end = find("]]>", at)
            found = ("cdata", "", page[at + 9 : end if end >= 0 else len(page)])
            end = len(page) if end < 0 else end + 3
        elif page.startswith(("<!", "<?"), at):
            if (end := find(">", at) + 1) <= 0:
                break
            found = None
        elif (m := _NAME.match(page, at)) and (end := end_of_tag(m.end()) + 1) > 0:
            found = ("end" if m[1] else "start", m[2].lower(), page[m.end() : end - 1])
        else:
            at += 1
            continue
        if at > told:
            yield "text", "", page[told:at]
        if found:
            yield found
        at = told = end
        if found and found[0] == "start" and not found[2].rstrip().endswith("/"):
            if found[1] in RAW:
                m = _RAW_END[found[1]].search(page, at)
                at = told = m.end() if m else len(page)
            elif found[1] in SKIPPED and f"</{found[1]}" not in missing:
                depth = 1
                for m in _SAME[found[1]].finditer(page, at):
                    depth += -1 if m[1] else not m[0].rstrip(">").endswith("/")
                    if not depth:
                        at = told = m.end()
                        break
                else:  # never closed: its content counts as the page's
                    missing.add(f"</{found[1]}")
    if told < len(page):
        yield "text", "", page[told:]


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks of a page. White space inside is one space, character references are decoded, empty ones are left out."""
    out: list[Block] = []
    if not page:
        return out
    tags: list[str] = []
    paths: list[Path] = [_PATHS.begin()]
    had: list[tuple[str, ...]] = []  # of each open element the tokens it brought
    open_, known = Counter(), Counter()
    text: list[tuple[str, bool]] = []

    def flush() -> None:
        if text:
            whole = "".join(t for t, _ in text)
            whole = " ".join((html.unescape(whole) if "&" in whole else whole).split())
            if whole:
                out.append(Block(whole, paths[-1], sum(len(t) for t, a in text if a)))
            text.clear()

    def push(tag: str, attributes: str) -> None:
        own = _met_tokens(tag, attributes) if len(attributes) < 200 else own_tokens(tag, attributes)
        new = tuple([w for w in own if not known[w]])
        for w in new:
            known[w] += 1
        tags.append(tag), had.append(new), paths.append(_PATHS.inside(paths[-1], tag, new))
        open_[tag] += 1

    def drop(k: int) -> None:
        """The k-th open element ends; those inside it go on."""
        open_[tags.pop(k)] -= 1
        for w in had.pop(k):
            known[w] -= 1
        del paths[k + 1]

    def close(to: int) -> None:
        if any(t not in INLINE for t in tags[to:]):
            flush()
        while len(tags) > to:
            drop(len(tags) - 1)

    def nearest(kinds: frozenset[str] | set[str], bounds: frozenset[str] = frozenset()) -> int:
        if any(open_[t] for t in kinds):
            for k in range(len(tags) - 1, -1, -1):
                if tags[k] in kinds:
                    return k
                if tags[k] in bounds:
                    break
        return -1

    for kind, tag, rest in tokens(page):
        if kind == "text":
            text.append((rest, open_["a"] > 0))
        elif kind == "cdata":
            text.append((html.escape(rest), False))
        elif kind == "end":
            if (k := nearest({tag})) >= 0:
                # An inline end tag does not close blocks around it.
                if tag not in INLINE or all(t in INLINE for t in tags[k:]):
                    close(k)
                else:
                    drop(k)
            elif tag in ("br", "p"):
                text.append((" ", False))
        elif tag in RAW or tag in SKIPPED:
            if tag != "title":
                text.append((" ", False))
        elif tag == "br":
            text.append((" ", False))
        elif tag in VOID:
            if tag not in INLINE:
                flush()
        else:
            if tag not in INLINE:
                flush()
                if tag in CLOSES:
                    if (k := nearest(*CLOSES[tag])) >= 0:
                        close(k)
                elif (k := nearest({"p"})) >= 0:
                    close(k)
                if tags and tag in HEADING and tags[-1] in HEADING:
                    close(len(tags) - 1)
            push(tag, rest)
    flush()
    return out
