"""LaTeX sources: sections, paragraphs, lists, tables, verbatim and mathematics as they stand."""

from __future__ import annotations

import re

from leafmill.model import Block, Cell, Options, Result

LEVELS = {"part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5, "subparagraph": 6}
LISTS = {"itemize": False, "enumerate": True, "description": False}
TABLES = frozenset("tabular tabular* tabularx longtable array tabulary".split())
VERBATIM = frozenset("verbatim verbatim* lstlisting minted Verbatim".split())
MATH = frozenset("equation equation* align align* gather gather* displaymath math eqnarray eqnarray* multline multline*".split())
#: Commands whose argument is text, and those that vanish with their arguments.
TEXT = frozenset("textbf textit texttt emph textsc textrm textsf textsl underline text mbox uppercase MakeUppercase footnotesize small large title author enquote url".split())
GONE = frozenset("label ref eqref pageref cite citep citet nocite index input include includegraphics usepackage documentclass documentstyle newcommand renewcommand providecommand def bibliography bibliographystyle vspace hspace setlength addtolength pagestyle thispagestyle hypersetup thanks date maketitle tableofcontents centering noindent newpage clearpage footnotemark graphicspath".split())
ACCENTS = {"'": "́", "`": "̀", "^": "̂", '"': "̈", "~": "̃", "=": "̄", ".": "̇", "c": "̧", "v": "̌", "u": "̆", "H": "̋", "r": "̊"}
SIGNS = {"ss": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "o": "ø", "O": "Ø", "l": "ł", "L": "Ł", "aa": "å", "AA": "Å", "i": "ı", "dots": "…", "ldots": "…", "textendash": "–", "textemdash": "—", "textbackslash": "\\", "LaTeX": "LaTeX", "TeX": "TeX", "S": "§", "copyright": "©", "textquotedblleft": "“", "textquotedblright": "”"}


def braced(text: str, at: int) -> tuple[str, int]:
    """The group that opens at `at`, and where it ends; nothing if none opens there."""
    while at < len(text) and text[at] in " \t\n":
        at += 1
    if at >= len(text) or text[at] != "{":
        return "", at
    depth, k = 0, at
    while k < len(text):
        if text[k] == "\\":
            k += 1
        elif text[k] == "{":
            depth += 1
        elif text[k] == "}":
            depth -= 1
            if not depth:
                return text[at + 1 : k], k + 1
        k += 1
    return text[at + 1 :], len(text)


def optional(text: str, at: int) -> int:
    """Past an option in brackets, if there is one."""
    m = re.compile(r"[ \t]*\n?[ \t]*\[[^\]]*\]").match(text, at)
    return m.end() if m else at


def plain(text: str) -> str:
    """Text without commands; mathematics stays as it is written, without its dollars."""
    out: list[str] = []
    k = 0
    while k < len(text):
        c = text[k]
        if c == "\\":
            m = re.compile(r"\\([A-Za-z@]+)\*?|\\(.)", re.S).match(text, k)
            if m is None:
                break
            k = m.end()
            name = m[1] or m[2]
            if m[2] is not None:
                if name in ACCENTS:
                    body, k = braced(text, k) if text[k : k + 1] == "{" else (text[k : k + 1], k + 1)
                    out.append(plain(body).replace("ı", "i") + ACCENTS[name])
                elif name in "([":
                    end = text.find("\\" + {"(": ")", "[": "]"}[name], k)
                    out.append(text[k : end if end >= 0 else len(text)].strip())
                    k = end + 2 if end >= 0 else len(text)
                elif name == "\\":
                    k = optional(text, k)
                    out.append("\0")
                elif name in "%$&#_{}":
                    out.append(name)
                elif name in " ,;:/~":
                    out.append(" ")
                continue
            if name == "footnote":
                body, k = braced(text, optional(text, k))
                out.append(f" {plain(body)}" if out and not out[-1].endswith(" ") else plain(body))
            elif name == "href":
                _, k = braced(text, k)
                body, k = braced(text, k)
                out.append(plain(body))
            elif name in TEXT:
                body, k = braced(text, optional(text, k))
                out.append(plain(body))
            elif name in SIGNS:
                out.append(SIGNS[name])
                k += len(re.compile(r"\{\}|[ \t]*").match(text, k)[0])
            elif name in ACCENTS and text[k : k + 1] == "{":
                body, k = braced(text, k)
                out.append(plain(body) + ACCENTS[name])
            else:
                k = optional(text, k)
                while text[k : k + 1] == "{" and name in GONE:
                    k = braced(text, k)[1]
        elif c == "$":
            wide = text.startswith("$$", k)
            end = text.find("$$" if wide else "$", k + 1 + wide)
            end = len(text) if end < 0 else end
            out.append(text[k + 1 + wide : end].strip())
            k = end + 1 + wide
        elif c in "{}":
            k += 1
        elif c == "~":
            out.append(" ")
            k += 1
        elif text.startswith("---", k):
            out.append("—")
            k += 3
        elif text.startswith("--", k):
            out.append("–")
            k += 2
        elif text.startswith("``", k) or text.startswith("''", k):
            out.append("“" if c == "`" else "”")
            k += 2
        else:
            out.append(c)
            k += 1
    return "".join(out)


def line(text: str) -> str:
    return "\n".join(" ".join(part.split()) for part in plain(text).split("\0")).strip()


def ends(text: str, name: str, at: int) -> tuple[str, int]:
    """The body of an environment that begins before `at`, nested ones of its kind included."""
    depth = 1
    for m in re.compile(rf"\\(begin|end)\{{{re.escape(name)}\}}").finditer(text, at):
        depth += 1 if m[1] == "begin" else -1
        if not depth:
            return text[at : m.start()], m.end()
    return text[at:], len(text)


def items(body: str, ordered: bool, depth: int) -> list[tuple[int, str | None, str]]:
    """Items of a list and of the lists in it, in reading order."""
    out: list[tuple[int, str | None, str]] = []
    at = 0
    parts: list[tuple[str | None, list[str], list]] = []
    token = re.compile(r"\\item(?![A-Za-z])[ \t]*(\[[^\]]*\])?|\\begin\{(\w+\*?)\}(?:\[[^\]]*\])?")
    while at < len(body):
        m = token.search(body, at)
        if parts:
            parts[-1][1].append(body[at : m.start() if m else len(body)])
        if not m:
            break
        at = m.end()
        if m[2] is None:
            parts.append((m[1] and m[1][1:-1], [], []))
        elif m[2] in LISTS:
            inner, at = ends(body, m[2], at)
            if parts:
                parts[-1][2].extend(items(inner, LISTS[m[2]], depth + 1))
        elif parts:
            inner, at = ends(body, m[2], at)
            parts[-1][1].append(inner)
    for label, texts, inner in parts:
        text = line("".join(texts))
        out.append((depth, None, f"{line(label)} {text}".strip() if label else text))
        out += inner
    return out


def table(body: str) -> Block | None:
    body = braced(body, optional(body, 0))[1:] and body[braced(body, optional(body, 0))[1] :]
    ruled = re.match(r"\s*(?:\\(?:hline|toprule)\s*)?(.*?)\\\\\s*\\(?:hline|midrule)", body, re.S)
    rows = []
    for row in re.split(r"\\\\(?:\[[^\]]*\])?", re.sub(r"\\(?:hline|toprule|midrule|bottomrule|cline\{[^}]*\}|cmidrule(?:\([^)]*\))?\{[^}]*\}|endhead|endfirsthead|endfoot)", "", body)):
        if not row.strip():
            continue
        cells: list[Cell] = []
        for cell in re.split(r"(?<!\\)&", row):
            m = re.match(r"\s*\\multicolumn\{(\d+)\}", cell)
            if m:
                _, at = braced(cell, m.end())
                text, _ = braced(cell, at)
                cells += [Cell(line(text), col_span=int(m[1]) if int(m[1]) > 1 else None)] + [Cell() for _ in range(int(m[1]) - 1)]
            else:
                cells.append(Cell(line(cell)))
        rows.append(cells)
    width = max(map(len, rows), default=0)
    return Block("table", rows=[r + [Cell() for _ in range(width - len(r))] for r in rows], header_rows=int(bool(ruled) and len(rows) > 1)) if width else None


def read(text: str, options: Options) -> Result:
    out = Result()
    source = re.sub(r"(?<!\\)%[^\n]*\n?", "", text.replace("\r\n", "\n"))
    for key, name in (("title", "title"), ("author", "authors")):
        if m := re.search(rf"\\{key}(?=[\[{{])", source):
            value, _ = braced(source, optional(source, m.end()))
            if key == "title":
                out.metadata["title"] = line(value)
            elif options.metadata:
                out.metadata[name] = [line(a) for a in re.split(r"\\and\b", value)]
    if m := re.search(r"\\begin\{document\}", source):
        body = ends(source, "document", m.end())[0]
        if "\\maketitle" in body and out.metadata.get("title"):
            out.blocks.append(Block("heading", out.metadata["title"], level=1))
    else:
        body = source
    token = re.compile(r"\\(?P<head>part|chapter|(?:sub){0,2}section|(?:sub)?paragraph)\*?(?=[\[{])|\\begin\{(?P<env>[\w*]+)\}(?:\[[^\]]*\])?|\\end\{[\w*]+\}|(?P<gap>\n[ \t]*\n\s*)|\\caption(?=[\[{])|\\(?:maketitle|title|author|date)(?![A-Za-z])")
    run: list[str] = []

    def flush() -> None:
        if value := line("".join(run)):
            out.blocks.append(Block("paragraph", value))
        run.clear()

    at = 0
    while m := token.search(body, at):
        run.append(body[at : m.start()])
        at = m.end()
        env = m["env"]
        if m["head"]:
            flush()
            value, at = braced(body, optional(body, at))
            out.blocks.append(Block("heading", line(value), level=LEVELS[m["head"]]))
        elif m["gap"]:
            flush()
        elif m[0] == "\\caption":
            value, at = braced(body, optional(body, at))
            flush()
            if value := line(value):
                out.blocks.append(Block("paragraph", value))
        elif m[0] in ("\\title", "\\author", "\\date"):
            at = braced(body, optional(body, at))[1]
        elif env in LISTS:
            flush()
            inner, at = ends(body, env, at)
            if made := items(inner, LISTS[env], 0):
                out.blocks.append(Block("list", ordered=LISTS[env], items=made))
        elif env in TABLES:
            flush()
            inner, at = ends(body, env, at)
            if made := table(inner):
                out.blocks.append(made)
        elif env in VERBATIM:
            flush()
            inner, at = ends(body, env, at)
            out.blocks.append(Block("code", re.sub(r"^(?:\[[^\]]*\])?(?:\{[^}]*\})?\n", "", inner).rstrip("\n")))
        elif env in MATH:
            flush()
            inner, at = ends(body, env, at)
            out.blocks.append(Block("code", re.sub(r"\\label\{[^}]*\}", "", inner).strip(), language="latex"))
        elif env == "abstract":
            flush()
            out.blocks.append(Block("heading", "Abstract", level=2))
        elif env in ("thebibliography",):
            flush()
            at = ends(body, env, at)[1]
    run.append(body[at:])
    flush()
    return out
