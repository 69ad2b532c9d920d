"""Chunkers of marked-up documents: sections from heading to heading."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from corpusgraph.operators.chunking.base import Options, Part, Source, chunker, document, lines_of, sections


@chunker("markdown", 50, mimes="text/markdown text/x-markdown", suffixes=".md .markdown")
def markdown(source: Source, options: Options) -> list[Part]:
    """Headings of one to six marks outside of fences."""
    text, marks, fence = source.text, [], False
    for line in lines_of(text):
        if line.text.lstrip().startswith("```"):
            fence = not fence
        elif not fence and (m := re.match(r"(#{1,6})\s+(.+)$", line.text)):
            marks.append((line.start, m[2].strip(), len(m[1])))

    def meta(heading, level, path, body):
        code = re.search(r"^```(\w*)", body, re.MULTILINE)
        return document(heading, level, path, body, has_code_block=code is not None, code_language=(code[1] or None) if code else None)

    return sections(text, marks, meta, "markdown")


@chunker("rst", 55, mimes="text/x-rst text/restructuredtext", suffixes=".rst .rest")
def rst(source: Source, options: Options) -> list[Part]:
    """Titles under (and over) lines of one punctuation mark at least as long; a style's level is its first appearance."""
    text = source.text
    lines, marks, styles = lines_of(text), [], []
    rule = lambda k: 0 <= k < len(lines) and re.fullmatch(r"([^\w\s])\1*", lines[k].text.rstrip())
    for k, line in enumerate(lines[:-1]):
        title = line.text.strip()
        under = rule(k + 1)
        if not title or not under or rule(k) or len(under[0]) < len(title) or len(under[0]) < 2:
            continue
        over = rule(k - 1)
        over = bool(over) and over[1] == under[1] and len(over[0]) >= len(title) and (k < 2 or not lines[k - 2].text.strip())
        if line.text[:1].isspace() and not over:
            continue
        style = (under[1], over)
        if style not in styles:
            styles.append(style)
        marks.append((lines[k - 1].start if over else line.start, title, styles.index(style) + 1))
    return sections(text, marks, lambda h, n, p, b: document(h, n, p, b, has_code_block="::" in b), "prose")


@chunker("asciidoc", 54, mimes="text/asciidoc text/x-asciidoc", suffixes=".adoc .asciidoc .asc")
def asciidoc(source: Source, options: Options) -> list[Part]:
    """Headings of one to six equals signs outside of delimited blocks; anchors go with their heading."""
    text, marks, block, anchor = source.text, [], "", None
    for line in lines_of(text):
        bare = line.text.strip()
        if block:
            block = "" if bare == block else block
        elif bare in ("----", "====", "....", "****", "____", "++++"):
            block = bare
        elif re.fullmatch(r"\[\[[^\]]+\]\]", bare):
            anchor = line.start
            continue
        elif m := re.match(r"(={1,6})\s+(.+)$", line.text):
            marks.append((line.start if anchor is None else anchor, m[2].strip(), len(m[1])))
        anchor = None
    return sections(text, marks, lambda h, n, p, b: document(h, n, p, b, has_code_block="[source" in b or "----" in b), "prose")


#: Sectioning commands from the top, and environments in which they don't count.
LATEX_LEVELS = ("part", "chapter", "section", "subsection", "subsubsection", "paragraph", "subparagraph")
VERBATIM = ("verbatim", "Verbatim", "lstlisting", "minted", "comment", "equation", "align", "gather", "multline", "eqnarray", "math", "displaymath", "tikzpicture")


@chunker("latex", 53, mimes="text/x-latex text/x-tex application/x-latex application/x-tex", suffixes=".tex .latex .ltx")
def latex(source: Source, options: Options) -> list[Part]:
    """Sectioning commands outside of comments, verbatim and math environments."""
    text, marks = source.text, []
    names = "|".join(VERBATIM)
    hidden = [m.span() for m in re.finditer(rf"\\begin\{{({names})(\*?)\}}.*?\\end\{{\1\2\}}|(?<!\\)%[^\n]*", text, re.DOTALL)]
    for m in re.finditer(rf"\\({'|'.join(LATEX_LEVELS)})\*?\s*(?:\[[^\]]*\])?\s*\{{((?:[^{{}}]|\{{[^{{}}]*\}})*)\}}", text):
        if not any(a <= m.start() < b for a, b in hidden):
            marks.append((m.start(), m[2].strip(), LATEX_LEVELS.index(m[1]) + 1))
    return sections(text, marks, lambda h, n, p, b: document(h, n, p, b, has_code_block="\\begin{verbatim}" in b or "\\begin{lstlisting}" in b), "prose")


class _Sections(HTMLParser):
    """Text of a page by heading."""

    SKIP = frozenset("script style noscript head".split())
    HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
    BREAK = frozenset("p div br li ul ol tr table section article header footer nav aside blockquote pre hr dl dt dd figure main form".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.done: list[tuple[str, int, str]] = []
        self.heading, self.level, self.text = "", 0, []
        self.inside = 0
        self.skip = ""

    def updatepos(self, i: int, j: int) -> int:
        """Lines and columns of tags are of no use here."""
        return j

    def _flush(self) -> None:
        body = re.sub(r"[ \t\r\f\v]+", " ", "".join(self.text))
        body = re.sub(r" ?\n ?", "\n", body)
        body = re.sub(r"\n{3,}", "\n\n", body).strip()
        if body or self.heading:
            self.done.append((self.heading.strip(), self.level, body))
        self.text = []

    def handle_starttag(self, tag, attrs):
        if self.skip or tag in self.SKIP:
            self.skip = self.skip or tag
        elif tag in self.HEADINGS:
            self._flush()
            self.heading, self.level, self.inside = "", int(tag[1]), int(tag[1])
        elif tag in self.BREAK:
            self.text.append("\n\n" if tag in ("p", "div", "section", "article", "table", "ul", "ol", "blockquote", "pre") else "\n")

    def handle_endtag(self, tag):
        if self.skip:
            self.skip = "" if tag == self.skip else self.skip
        elif self.inside and tag == f"h{self.inside}":
            self.inside = 0
            self.heading = " ".join(self.heading.split())
            self.text.append(self.heading + "\n\n")
        elif tag in self.BREAK:
            self.text.append("\n")

    def handle_data(self, data):
        if self.skip:
            return
        if self.inside:
            self.heading += data
        else:
            self.text.append(data)


@chunker("html", 75, mimes="text/html application/xhtml+xml", suffixes=".html .htm .xhtml")
def html(source: Source, options: Options) -> list[Part]:
    """The text of each h1 to h6 section without scripts, styles and the head; offsets are the page's."""
    page = _Sections()
    page.feed(source.text)
    page.close()
    page._flush()
    parts, path, n = [], [], len(source.text)
    for heading, level, body in page.done:
        if level:
            path = [x for x in path if x[1] < level] + [(heading, level)]
        parts.append(Part(0, n, "prose", document(heading, level, " > ".join(x[0] for x in path), body), content=body))
    return parts
