"""Equations of Word documents as lines of text: fractions, scripts, radicals, sums, brackets, matrices."""

from __future__ import annotations

from xml.etree import ElementTree

DEPTH = 200
ROOTS = {"2": "√", "3": "∛", "4": "∜"}


def local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def value(node: ElementTree.Element, properties: str, name: str, default: str) -> str:
    """A property's value; the default where it is not given."""
    for own in node:
        if local(own.tag) == properties:
            for p in own:
                if local(p.tag) == name:
                    return next((v for k, v in p.attrib.items() if local(k) == "val"), "")
    return default


def part(node: ElementTree.Element, name: str, depth: int) -> str:
    return next((line(c, depth + 1) for c in node if local(c.tag) == name), "")


def parts(node: ElementTree.Element, name: str, depth: int) -> list[str]:
    return [line(c, depth + 1) for c in node if local(c.tag) == name]


def grouped(text: str) -> str:
    """In parentheses, unless it is a single character or a number."""
    return text if len(text) <= 1 or text.replace(".", "", 1).isdigit() else f"({text})"


def off(node: ElementTree.Element, properties: str, name: str) -> bool:
    return value(node, properties, name, "0") not in ("0", "off", "false")


def structure(node: ElementTree.Element, depth: int) -> str | None:
    """The text of one structure; None for what is none."""
    kind = local(node.tag)
    of = lambda name: part(node, name, depth)
    if kind == "f":
        return f"{grouped(of('num'))}/{grouped(of('den'))}"
    if kind in ("sSup", "sSub", "sSubSup", "sPre"):
        low, high = of("sub"), of("sup")
        scripts = (f"_{grouped(low)}" if low else "") + (f"^{grouped(high)}" if high else "")
        return scripts + of("e") if kind == "sPre" else of("e") + scripts
    if kind == "rad":
        degree = "" if off(node, "radPr", "degHide") else of("deg")
        return f"{ROOTS.get(degree or '2', f'√[{degree}]')}({of('e')})"
    if kind == "nary":
        low = "" if off(node, "naryPr", "subHide") else of("sub")
        high = "" if off(node, "naryPr", "supHide") else of("sup")
        return value(node, "naryPr", "chr", "∫") + (f"_{grouped(low)}" if low else "") + (f"^{grouped(high)}" if high else "") + f" {of('e')}"
    if kind == "d":
        inner = [c for c in node if local(c.tag) == "e"]
        alone = len(inner) == 1 and [local(c.tag) for c in inner[0] if not local(c.tag).endswith("Pr")] == ["m"]
        texts = [matrix(next(c for c in inner[0] if local(c.tag) == "m"), depth + 1)] if alone else [line(c, depth + 1) for c in inner]
        return value(node, "dPr", "begChr", "(") + value(node, "dPr", "sepChr", "|").join(texts) + value(node, "dPr", "endChr", ")")
    if kind == "m":
        return f"[{matrix(node, depth)}]"
    if kind == "func":
        body = of("e")
        return of("fName") + (body if body.startswith("(") and body.endswith(")") else f"({body})")
    if kind in ("limLow", "limUpp"):
        return of("e") + ("_" if kind == "limLow" else "^") + grouped(of("lim"))
    if kind == "acc":
        return of("e") + value(node, "accPr", "chr", "\u0302")
    if kind == "eqArr":
        return "\n".join(parts(node, "e", depth))
    if kind == "oMathPara":
        return "\n".join(parts(node, "oMath", depth))
    return None


def matrix(node: ElementTree.Element, depth: int) -> str:
    return "; ".join(", ".join(parts(row, "e", depth)) for row in node if local(row.tag) == "mr")


def line(node: ElementTree.Element, depth: int = 0) -> str:
    """The text of an equation or a part of one; what lies too deep is left out."""
    if depth > DEPTH:
        return ""
    out = []
    for c in node:
        kind = local(c.tag)
        if kind.endswith("Pr"):
            continue
        made = structure(c, depth)
        out.append(made if made is not None else c.text or "" if kind == "t" else line(c, depth + 1))
    return "".join(out)
