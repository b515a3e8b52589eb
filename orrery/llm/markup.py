"""Markup residue in text: a tree-structured graphical model decides what is markup.

A text is lexed into a document tree. Below the root stand the dialects (HTML, Markdown, wiki, LaTeX)
of which constructs occur, and the lines that hold mere characters (a bracket, a path, a price);
below them the constructs, and constructs nest in the elements that enclose them (a closing tag and
all between hang on the opening tag). Every node is a binary variable (markup or content) with a
unary potential from its own letters and a potential shared with its parent, by the kinds of both.
So a dialect that is surely in use lends weight to its doubtful constructs, and an element tells what
its content is. Sum-product message passing upward and downward yields each node's marginal. The
potentials are trained by gradient ascent on the likelihood of labelled pages, which a seeded generator
writes (:func:`labelled_pages`).

Nodes found to be markup are rendered to plain text; headings, lists, code, tables and formulas stay
as typed blocks. All other nodes stay as they are.
"""

from __future__ import annotations

import bisect
import html
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html.entities import html5

import pyarrow as pa
from pyspark.sql import DataFrame

# Names of HTML elements.
TAGS = set("""a abbr acronym address article aside audio b big blockquote body br button canvas caption center cite code col
colgroup dd del details dfn div dl dt em embed figcaption figure font footer form frame h1 h2 h3 h4 h5 h6 head header hr html i
iframe img input ins kbd label legend li link main map mark meta nav nowiki ol option p param pre q ref references s samp
script section select small source span strike strong style sub summary sup table tbody td textarea tfoot th thead time title tr
tt u ul var video wbr math""".split())
BLOCK_TAGS = set("address article aside blockquote body br center dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody tfoot thead tr ul".split())
# LaTeX commands that take arguments or stand alone in running text.
COMMANDS = set("""alpha approx begin beta bf boldsymbol caption cdot celsius chapter cite citep citet degree delta div emph end
footnote frac gamma ge geq gram href hspace hz include includegraphics infty int it item kilo label lambda le ldots left leq
mathbf mathrm mega meter metre micro milli mu nabla newline newton noindent num ohm omega overline pagebreak paragraph
parbox partial pascal per phi pi pm prod qquad quad ref rho right second section sigma si SI sin sqrt squared ss subsection
subsubsection sum tau textbf textit textrm textsc texttt theta times title underline unit url usepackage vec volt vspace watt""".split())
#: Elements whose content is shown letter by letter.
_LITERAL = {"pre", "code", "tt", "kbd", "samp"}
_UNITS = {"kilo": "k", "mega": "M", "giga": "G", "milli": "m", "micro": "µ", "watt": "W", "metre": "m", "meter": "m", "gram": "g",
          "hertz": "Hz", "second": "s", "volt": "V", "pascal": "Pa", "newton": "N", "ohm": "Ω", "per": "/", "squared": "²",
          "degree": "°", "celsius": "°C", "hour": "h", "litre": "L", "percent": "%"}

_PATTERNS = [
    ("comment", r"<!--.*?(?:-->|\Z)"),
    ("raw", r"<(?:script|SCRIPT|style|STYLE)\b[^>]*>.*?</(?:script|SCRIPT|style|STYLE)\s*>"),
    ("fence", r"^[ \t]*(?:```|~~~)[^\n]*\n.*?(?:^[ \t]*(?:```|~~~)[ \t]*$|\Z)"),
    ("wiki_table", r"^\{\|.*?(?:^\|\}|\Z)"),
    ("display_math", r"\\\[.*?\\\]"),
    ("inline_math", r"\\\(.*?\\\)"),
    ("dollar_math", r"\$\$[^$]+\$\$|\$(?!\s)[^$\n]{1,80}?(?<!\s)\$(?!\d)"),
    ("escaped_tag", r"&lt;\s*/?[A-Za-z][A-Za-z0-9]*(?:\s(?:(?!&gt;|&lt;)[^\n])*)?/?\s*&gt;"),
    ("entity", r"&(?:\#\d{1,7}|\#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"),
    ("open_entity", r"&(?:nbsp|amp|lt|gt|quot|ndash|mdash|\#\d{2,5})(?![A-Za-z0-9;])"),
    ("tag", r"</?[A-Za-z][A-Za-z0-9]*(?:\s+[^<>]*)?/?>"),
    ("cut_tag", r"</?[A-Za-z][A-Za-z0-9]*(?:\s+[A-Za-z:_-]+(?:\s*=\s*(?:\"[^\"<>]*\"?|'[^'<>]*'?|[^\s<>\"']*))?)*\s*/?\Z"),
    ("template", r"\{\{[^{}]*(?:\{\{[^{}]*\}\}[^{}]*)*\}\}"),
    ("wiki_link", r"\[\[[^\[\]\n]+\]\]"),
    ("image", r"!\[[^\]\n]*\]\([^)\n]*\)"),
    ("link", r"\[[^\[\]\n]+\]\([^)\n]*\)"),
    ("ref_link", r"\[[^\[\]\n]+\]\[[^\[\]\n]*\]|\[\^\w+\]"),
    ("url_link", r"\[https?://[^\]\s]+(?: [^\]\n]*)?\]"),
    ("command", r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?(?:\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\})+"),
    ("bare_command", r"\\[A-Za-z]+"),
    ("escape", r"\\[%,&$\#_{};:!\\ ]"),
    ("heading", r"^[ ]{0,3}\#{1,6}[ \t]+(?=\S)"),
    ("wiki_heading", r"^={1,6}[ \t]*[^=\n]+?[ \t]*={1,6}[ \t]*$"),
    ("rule", r"^[ \t]*(?:-{3,}|\*{3,}|_{3,})[ \t]*$"),
    ("table_rule", r"^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$"),
    ("table_row", r"^[ \t]*\|(?![-}+|])[^\n]*\|[ \t]*$"),
    ("star_bullet", r"^[ \t]*[*+][ \t]+(?=\S)"),
    ("dash_bullet", r"^[ \t]*-[ \t]+(?=\S)"),
    ("quote", r"^>[ \t]*(?=\S)"),
    ("wiki_quotes", r"(?<!')'{2,5}(?=[^'\s])[^\n]*?[^'\s]'{2,5}(?!')"),
    ("strong", r"\*\*(?=[^\s*])[^\n]*?[^\s*]\*\*|(?<![\w_])__(?=[^\s_])[^\n]*?[^\s_]__(?![\w_])"),
    ("star_span", r"(?<![\w*])\*(?=[^\s*])[^*\n]*?[^\s*]\*(?![\w*])|(?<![\w*])\*(?=[^\s*])[^\s*]\*(?![\w*])"),
    ("under_span", r"(?<![\w_])_(?=[^\s_])[^_\n]*?[^\s_]_(?![\w_])"),
    ("strike", r"~~(?=[^\s~])[^~\n]*?~~"),
    ("code", r"``[^\n]+?``|`[^`\n]+`"),
    ("money", r"\$"),
    ("bracket", r"\[[^\[\]\n]*\]"),
    ("brace", r"\{[^{}\n]*\}"),
    ("snake", r"(?<=\w)_+(?=\w)"),
    ("amp", r"&"),
    ("less", r"<"),
    ("more", r">"),
    ("hash", r"\#"),
    ("star", r"\*+"),
    ("tilde", r"~+"),
    ("bar", r"\|"),
    ("backslash", r"\\"),
    ("backtick", r"`"),
    ("line", r"_+"),
]
_LEX = re.compile("|".join(f"(?P<{n}>{p})" for n, p in _PATTERNS), re.M | re.S)
_MAYBE = re.compile(r"[<>&*_#$|\[\]\\~{}`]|''|^={1,6}|^-|^\+", re.M)
#: Constructs that enclose text which is lexed again.
_SPANS = {"strong", "star_span", "under_span", "strike", "wiki_quotes", "table_row", "link", "wiki_heading", "command", "bracket"}


#: Dialect of each construct that belongs to one.
_DIALECT = {kind: dialect for dialect, kinds in {
    "html": "comment raw escaped_tag entity open_entity tag cut_tag",
    "markdown": "fence image link ref_link heading rule table_rule table_row star_bullet dash_bullet quote strong star_span under_span strike code",
    "wiki": "wiki_table template wiki_link url_link wiki_heading wiki_quotes",
    "latex": "display_math inline_math dollar_math command bare_command escape"}.items() for kind in kinds.split()}
#: Constructs that are mere characters unless they are labelled on their own.
_PLAIN = {"money", "bracket", "brace", "snake", "amp", "less", "more", "hash", "star", "tilde", "bar", "backslash", "backtick", "line"}


#: Nodes that stand for a whole text, dialect or line; markup if anything below is.
_UPPER = {"root", "line", "html", "markdown", "wiki", "latex"}


@dataclass
class Node:
    kind: str
    start: int
    end: int
    parent: int
    features: list[str] = field(default_factory=list)
    text: str = ""
    number: int = -1


def _features(kind: str, text: str, start: int, end: int) -> list[str]:
    body = text[start:end]
    before, after = text[start - 1:start], text[end:end + 1]
    out = [kind]
    if kind in ("tag", "cut_tag", "escaped_tag"):
        name = re.search(r"[A-Za-z][A-Za-z0-9]*", body.replace("&lt;", ""))
        low = name.group(0).lower() if name else ""
        out.append(f"{kind}:{'literal' if low in _LITERAL else 'raised' if low == 'sup' else 'known' if low in TAGS else 'unknown'}")
        if "=" in body:
            out.append(f"{kind}:attribute")
    elif kind == "entity":
        out.append("entity:" + ("known" if body[1] == "#" or body[1:] in html5 else "unknown"))
    elif kind in ("command", "bare_command"):
        name = re.match(r"\\([A-Za-z]+)", body).group(1)
        out.append(f"{kind}:{'known' if name in COMMANDS else 'unknown'}")
        if before and (before.isalnum() or before in ":\\"):
            out.append(f"{kind}:path")
        if after == "\\":
            out.append(f"{kind}:chained")
    elif kind == "dollar_math":
        inner = body.strip("$")
        out.append("dollar_math:" + ("formula" if re.search(r"[\\^_{}=]", inner) else "plain"))
        if re.match(r"[\d.,]+(?:\s|$)", inner) and not re.search(r"[\\^_{}]", inner):
            out.append("dollar_math:price")
    elif kind == "bracket":
        out.append("bracket:" + ("digits" if re.fullmatch(r"\[\d+\]", body) else "words"))
    elif kind in ("star", "tilde", "hash", "less", "more", "amp", "bar", "money"):
        out.append(f"{kind}:{'spaced' if before.isspace() and after.isspace() else 'tight'}")
    elif kind == "escape" and before and (before.isalpha() or before == ":"):
        out.append("escape:path")
    return out


def lex(text: str) -> list[Node]:
    """The document tree in an order where parents come before their children; node 0 is the root."""
    nodes = [Node("root", 0, len(text), -1, ["root"])]
    if not _MAYBE.search(text):
        return nodes
    starts = [0, *(m.end() for m in re.finditer(r"\n", text))]
    line_of: dict[int, int] = {}
    open_tags: list[tuple[str, int]] = []

    def line(at: int) -> int:
        k = bisect.bisect_right(starts, at) - 1
        if k not in line_of:
            nodes.append(Node("line", starts[k], starts[k + 1] if k + 1 < len(starts) else len(text), 0, ["line"]))
            line_of[k] = len(nodes) - 1
        return line_of[k]

    dialects: dict[str, int] = {}

    def top(kind: str, at: int) -> int:
        dialect = _DIALECT.get(kind)
        if dialect is None:
            return line(at)
        if dialect not in dialects:
            nodes.append(Node(dialect, 0, len(text), 0, [dialect]))
            dialects[dialect] = len(nodes) - 1
        return dialects[dialect]

    def scan(lo: int, hi: int, parent: int | None) -> None:
        at = lo
        while at < hi:
            m = _LEX.search(text, at, hi)
            if not m:
                return
            kind, s, e = m.lastgroup, m.start(), m.end()
            if e == s:
                at = s + 1
                continue
            above = parent if parent is not None else (open_tags[-1][1] if open_tags else top(kind, s))
            node = Node(kind, s, e, above, _features(kind, text, s, e), text[s:e])
            nodes.append(node)
            me = len(nodes) - 1
            if kind == "tag" and parent is None:
                name = re.search(r"[A-Za-z][A-Za-z0-9]*", node.text).group(0).lower()
                if node.text.startswith("</"):
                    for k in range(len(open_tags) - 1, -1, -1):
                        if open_tags[k][0] == name:
                            node.parent = open_tags[k][1]
                            del open_tags[k:]
                            break
                elif not node.text.endswith("/>") and name not in ("br", "hr", "img", "input", "meta", "link", "p", "li"):
                    open_tags.append((name, me))
            if kind in _SPANS:
                edge = {"strong": 2, "strike": 2, "table_row": 0, "wiki_heading": 0}.get(kind, 1)
                if kind == "wiki_quotes":
                    edge = len(re.match(r"'+", node.text).group(0))
                inner = (s + edge, e - edge)
                if kind == "table_row":
                    inner = (s + node.text.index("|") + 1, s + node.text.rindex("|"))
                elif kind == "wiki_heading":
                    inner = (e, e)
                elif kind == "command":
                    inner = (s + node.text.index("{") + 1, e - 1)
                elif kind == "link":
                    inner = (s + 1, s + node.text.index("]"))
                scan(inner[0], inner[1], me)
            at = e

    scan(0, len(text), None)
    return nodes


_FLAT = [0.0] * 4


@dataclass
class Model:
    """Potentials: unary weights by feature (log-odds of markup), and 2 x 2 tables by parent's group."""

    unary: dict[str, float] = field(default_factory=dict)
    pair: dict[str, list[float]] = field(default_factory=dict)

    @staticmethod
    def group(parent: Node, child: Node) -> str:
        """Key of the table that a parent shares with a child."""
        below = "closing" if child.kind == "tag" and child.text.startswith("</") else child.kind
        return f"{parent.features[1] if parent.kind == 'tag' else parent.kind} > {below}"

    def marginals(self, nodes: list[Node]) -> tuple[list[float], list[list[float]]]:
        """P(markup) of each node, and of each edge the joint of (parent, child) as [00, 01, 10, 11]."""
        n = len(nodes)
        own = [sum(self.unary.get(f, 0.0) for f in nd.features) for nd in nodes]
        up0, up1 = [0.0] * n, own[:]  # log beliefs from below, own potential included
        msg: list[tuple[float, float]] = [(0.0, 0.0)] * n
        tables = [self.pair.get(self.group(nodes[nd.parent], nd), _FLAT) if nd.parent >= 0 else _FLAT for nd in nodes]
        for i in range(n - 1, 0, -1):
            t = tables[i]
            m0 = _lse(t[0] + up0[i], t[1] + up1[i])
            m1 = _lse(t[2] + up0[i], t[3] + up1[i])
            msg[i] = (m0, m1)
            p = nodes[i].parent
            up0[p] += m0
            up1[p] += m1
        full0, full1 = up0[:], up1[:]
        joint: list[list[float]] = [[0.0] * 4 for _ in range(n)]
        for i in range(1, n):
            p, t = nodes[i].parent, tables[i]
            o0, o1 = full0[p] - msg[i][0], full1[p] - msg[i][1]  # the parent's belief without this child
            cells = [o0 + t[0] + up0[i], o0 + t[1] + up1[i], o1 + t[2] + up0[i], o1 + t[3] + up1[i]]
            z = _lse(_lse(cells[0], cells[1]), _lse(cells[2], cells[3]))
            joint[i] = [math.exp(c - z) for c in cells]
            full0[i] = up0[i] + _lse(o0 + t[0], o1 + t[2])
            full1[i] = up1[i] + _lse(o0 + t[1], o1 + t[3])
        return [_sigmoid(b - a) for a, b in zip(full0, full1)], joint


def _lse(a: float, b: float) -> float:
    hi, lo = (a, b) if a > b else (b, a)
    return hi + math.log1p(math.exp(lo - hi))


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x > -500 else 0.0


# Labelled snippets: what stands between ⟦ and ⟧ is markup, all else is content.
_SNIPPETS = [
    "⟦<b>⟧{w}⟦</b>⟧ {w} {w}.", "⟦<i>⟧{w} {w}.⟦</i>⟧", "⟦<p>⟧{w} {w}.⟦</p>⟧", "⟦<h2>⟧{w}⟦</h2>⟧{w} {w}.", "{w} {w}.⟦<br/>⟧{w}.",
    "{w} {w}.⟦<sup>⟧⟦[{n}]⟧⟦</sup>⟧", "⟦<ul>⟧⟦<li>⟧{w}⟦</li>⟧⟦<li>⟧{w}⟦</li>⟧⟦</ul>⟧", "⟦<td>⟧{w} is {n} {u}.⟦</td>⟧",
    '⟦<a href="https://{w}.example/{n}">⟧{w}⟦</a>⟧ {w}.', "⟦<table class='t'>⟧⟦<tr>⟧⟦<th>⟧{w}⟦</th>⟧⟦<td>⟧{n}⟦</td>⟧⟦</tr>⟧⟦</table>⟧",
    '{w} {w} {n}. ⟦<td class="{w}⟧', "{w} {w}. ⟦<span style='{w}⟧", "{w} {w} ⟦<div⟧", "⟦<pre>⟧{w}\n{w}⟦</pre>⟧⟦<p>⟧{w}",
    "⟦&lt;b&gt;⟧{w} {w}⟦&lt;/b&gt;⟧ {w}.", "{w}⟦&nbsp;⟧{w} {w} ⟦&amp;⟧ {w}.", "{w} ⟦&#8211;⟧ {w}⟦&#46;⟧", "⟦&lt;⟧ {n} {u}.", "⟦<!-- {w} -->⟧{w} {w}.",
    "{w}⟦&nbsp⟧ {w}", "⟦<script>⟧var p={n};⟦</script>⟧", "⟦<ref name=\"{w}\">⟧{w} ⟦{{{{cite|no={n}}}}}⟧⟦</ref>⟧ {w}.",
    "⟦## ⟧{w}\n\n{w} {w}.", "⟦### ⟧{w} {w} is {n}.", "⟦* ⟧{w} {w}\n⟦* ⟧{w}", "⟦* ⟧⟦**{w}**⟧\n⟦* ⟧⟦`{w}`⟧", "The ⟦**{w}**⟧ is ⟦_{w}_⟧.",
    "The ⟦~~{w}~~⟧ {w} was ⟦*{w}*⟧.", "With ⟦`{n}`⟧ {u}, {w}.", "⟦```\n{w} = {n}\n```⟧\n", "⟦[{w}](https://{w}.example/{n})⟧ {w}.", "⟦![{w}](img/{n}.png)⟧",
    "⟦| {w}_{w}: {n} {u} {w} [Lot #{n}] < {n} {u}. |⟧", "⟦* ⟧{w}_{w} #{n} = ${n} & {w}", "⟦**{n}**⟧ {u} of {w}_{w}.", "⟦### ⟧The {w}_{w} of [{w} {n}] is {n}.",
    "⟦> ⟧{w} {w} {w}.", "⟦| {w} | {w} |⟧\n⟦|---|---:|⟧\n⟦| {w} | {n} |⟧", "⟦| {w} {w} = {n} {u}. |⟧", "⟦---⟧\n{w} {w}", "⟦[{w}][{n}]⟧ {w}.",
    "⟦== {w} ==⟧\n{w} {w}.", "⟦'''{w} {w}'''⟧ {w}.", "⟦''{w}''⟧ {w}.", "It uses a ⟦[[{w}|{w} {w}]]⟧.", "{w} {w}. ⟦[[{w}]]⟧", "{w} is {n}. ⟦{{{{citation needed}}}}⟧",
    "Reach is ⟦{{{{convert|{n}|km|nmi|abbr=on}}}}⟧.", "⟦{{| class=\"{w}\"\n! {w} !! {w}\n|-\n| {w} || {n}\n|}}⟧", "⟦[https://{w}.example {w}]⟧ {w}.",
    "The ⟦\\textbf{{{w}}}⟧ draws ⟦\\SI{{{n}}}{{\\kilo\\watt}}⟧.", "⟦\\section{{{w}}}⟧\n{w} {w}.", "{w} rose by {n}⟦\\,⟧⟦\\%⟧ ⟦\\cite{{{w}{n}}}⟧.",
    "⟦\\begin{{itemize}}⟧\n⟦\\item⟧ {w}\n⟦\\item⟧ {w}\n⟦\\end{{itemize}}⟧", "Here ⟦$v_{{max}}$⟧ stays below ⟦\\(c_0\\)⟧.", "⟦\\[ R = \\sqrt{{P t}} \\]⟧\n",
    "The gain is ⟦$G = \\frac{{4\\pi A}}{{\\lambda^2}}$⟧.", "{w} {n} {u}. ⟦\\footnote{{{w}}}⟧", "(cf. ⟦$v_{{{n}}}$⟧)", "⟦$x^2$⟧ {w}", "{w} ⟦\\&⟧ {w} cost {n}⟦\\%⟧.",
    "⟦<{x}>⟧{w} {n}⟦</{x}>⟧ {w}.", "⟦<{x}>⟧⟦<b>⟧{w}⟦</b>⟧⟦</{x}>⟧", "⟦<section>⟧{w} ⟦<{x}>⟧{w}⟦</{x}>⟧ {w}⟦</section>⟧", "⟦\\section{{{w}}}⟧ ⟦${n}$⟧ {w}, ⟦$k$⟧ {w}.", "⟦\\emph{{{w}}}⟧ of ⟦${w}$⟧ {w}.",
    "⟦## ⟧{w}\n\n⟦- ⟧{w} {w}\n⟦- ⟧{w}", "⟦**{w}**⟧:\n⟦- ⟧{w} {n}\n⟦- ⟧{w}", "⟦<sup>⟧⟦[{n}]⟧⟦</sup>⟧ {w}", "⟦<pre>⟧{w} &amp; *{w}* [{n}]⟦</pre>⟧", "⟦<code>⟧{w}_{w} = ${n}$⟦</code>⟧",
    # content that looks like markup
    "Enter <{x}> and <{x}> here.", "{w} <{x}> {w}.", "It cost ${n} or ${n}$ {w}.", "{w} [{n}] {w}", "Type -{w} and [{n}].",
    "Losses stay small when gain<{n} dB and swing>{n} dB.", "Range > {n} km; weight < {n} kg.", "{w} & {w} list the tag {w}_{w}_{u} and {w}_{w}.",
    "A ** marks estimated values.", "The fit is {n} * {n} * {n} modules.", "The #{n} pump and the #{n} pump were swapped.", "Costs rose from ${n} million to ${n} million.",
    "{w} is US$ {n}.", "Manual [rev. B] applies; see docs.example/{w}.", "The archive sits in C:\\{w}\\{w}\\{w} on the PC.", "The set {{A, B, C}} is fixed.",
    "Readings of ~{n} V and ~{n} V are normal.", "{w} [{w} {n}] is {n} {u}.", "{w} [Lot #{n}] = {n}", "{w}_{w}_{w}: {n} {u}", "- {w} {w} {n} {u}", "- has a {w} of {n} {u}.",
    "The operator typed '{w}' and then '{w}'.", "A 6x6 layout -- rarely used -- was kept.", "See https://{w}.example/{w}_{w}?a={n}&b={n} for more.", "{w} has a {w} of {n}$.", "{w} Lot #{n} = {n}",
    "Files are in /{w}/{w}_{n}/{w}.txt.", "{w} | {w} are the two options.", "{w} ({w}) [{w}] {{{w}}}", "{w} < {w} and {w} > {w}.", "It cost $ {n} {w}.", "{w}: $0.{n} billion.", "R&D at {w} & Sons.", "Note * and ~ mean {w}.",
]
_WORDS = "mast radar pump winch signal Design table antenna gearbox Overview sealed trial note unit range value bearing sonar deck".split()


def labelled_pages(count: int, seed: int = 7) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Pages with the spans that are markup; a third hold only content."""
    rng = random.Random(seed)
    content = [s for s in _SNIPPETS if "⟦" not in s]
    for k in range(count):
        chosen = [rng.choice(content if k % 3 == 0 or rng.random() < 0.5 else _SNIPPETS) for _ in range(rng.randint(1, 4))]
        text, spans = "", []
        for snippet in chosen:
            filled = snippet.format_map(_Filler(rng))
            filled = re.sub(r"\x00w", lambda _: rng.choice(_WORDS), filled)
            if text and (rng.random() < 0.4 or re.match(r"⟦?(?:\#|\*|>|\||==|```|-|\{\||\\\[|---)", filled)):
                text += "\n"
            elif text:
                text += " "
            if text and not text.endswith(("\n", " ")):
                text += " "
            begin = None
            for ch in filled:
                if ch == "⟦":
                    begin = len(text)
                elif ch == "⟧":
                    spans.append((begin, len(text)))
                else:
                    text += ch
            if re.search(r"<(?:td|span|div)[^>]*$", text):
                break
        yield text, spans


class _Filler(dict):
    def __init__(self, rng: random.Random):
        super().__init__()
        self.rng = rng
        self.element = rng.choice(["name", "value", "spec", "item", "port", "field"])

    def __missing__(self, key: str) -> str:
        if key == "w":
            return "\x00w"
        if key == "x":
            return self.element
        return str(self.rng.randint(2, 900)) if key == "n" else self.rng.choice(["km", "kg", "kW", "m", "h"])


@lru_cache(maxsize=4)
def train(pages: int = 1200, epochs: int = 8, seed: int = 7, pairs: bool = True) -> Model:
    """Maximum likelihood by AdaGrad over ``pages`` generated labelled pages (the documented bound of the sample).

    ``pairs`` false leaves the parent-child potentials at zero (for ablation).
    """
    model = Model()
    data = []
    for text, spans in labelled_pages(pages, seed):
        nodes = lex(text)
        if len(nodes) == 1:
            continue
        gold = [0] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):
            nd = nodes[i]
            if nd.kind in _PLAIN:  # a mere character inside a construct is content of that construct
                gold[i] = int((nd.start, nd.end) in spans)
            elif nd.kind not in _UPPER:
                gold[i] = int(any(a <= nd.start < b for a, b in spans))
            if gold[i]:
                gold[nd.parent] = 1 if nodes[nd.parent].kind in _UPPER else gold[nd.parent]
        data.append((nodes, gold))
    seen: dict[str, float] = {}
    rng = random.Random(seed)

    def move(table: dict, key: str, cell: int | None, g: float, decay: float) -> None:
        name = key if cell is None else f"{key}/{cell}"
        now = table.get(key, 0.0) if cell is None else table.setdefault(key, [0.0] * 4)[cell]
        g -= decay * now
        seen[name] = seen.get(name, 1e-6) + g * g
        step = 0.5 * g / math.sqrt(seen[name])
        if cell is None:
            table[key] = now + step
        else:
            table[key][cell] = now + step

    for _ in range(epochs):
        rng.shuffle(data)
        for nodes, gold in data:
            marg, joint = model.marginals(nodes)
            for i, nd in enumerate(nodes):
                g = gold[i] - marg[i]
                if abs(g) > 1e-4:
                    for f in nd.features:
                        move(model.unary, f, None, g, 1e-3)
                if pairs and nd.parent >= 0:
                    at = 2 * gold[nd.parent] + gold[i]
                    for c in range(4):
                        d = (c == at) - joint[i][c]
                        if abs(d) > 1e-4:
                            move(model.pair, Model.group(nodes[nd.parent], nd), c, d, 1e-3)
    return model


@dataclass
class Cleaned:
    has_markup: bool
    score: float
    text: str
    blocks: list[tuple[str, str]]


# Symbols that LaTeX commands stand for.
SYMBOLS = dict(zip("times pm mp cdot degree alpha beta gamma delta epsilon theta lambda mu nu pi rho sigma tau phi omega eta "
                   "Delta Gamma Theta Lambda Sigma Phi Omega infty approx leq le geq ge neq ne ldots dots nabla partial sum int prod sqrt "
                   "to rightarrow leftarrow div circ percent celsius ohm micro textdegree S P copyright euro pounds ss".split(),
                   "× ± ∓ · ° α β γ δ ε θ λ μ ν π ρ σ τ φ ω η Δ Γ Θ Λ Σ Φ Ω ∞ ≈ ≤ ≤ ≥ ≥ ≠ ≠ … … ∇ ∂ ∑ ∫ ∏ √ → → ← ÷ ° % °C Ω µ ° § ¶ © € £ ß".split()))
#: Commands that only lay out; they leave nothing or a line break.
_LAYOUT = set("noindent centering left right bf it em sl tt rm small large Large huge normalsize quad qquad hspace vspace clearpage maketitle tableofcontents ".split())
_LINE_ENDS = {"newline", "pagebreak", "newpage", "par", "linebreak"}
_MARK = {"heading": "\x01", "list": "\x02", "code": "\x03", "table": "\x04", "formula": "\x05", "end": "\x06"}


def _siunitx(units: str) -> str:
    return "".join(_UNITS.get(u, u) for u in re.findall(r"\\([A-Za-z]+)", units)) or units


def _template(body: str, inner) -> str:
    """Text of a wiki template: its quantity, its foreign words, its title, or else all its unnamed arguments."""
    name, *rest = [p.strip() for p in re.split(r"\|(?![^{]*\}\})", body)]
    low = name.lower()
    unnamed = [p for p in rest if not re.match(r"[\w-]+\s*=", p)]
    named = dict(re.split(r"\s*=\s*", p, maxsplit=1) for p in rest if re.match(r"[\w-]+\s*=", p))
    if low in ("convert", "cvt"):
        return " ".join(unnamed[:2])
    if low.startswith(("lang", "transl")):
        return unnamed[-1] if unnamed else ""
    if low.startswith("cite"):
        return f" ({named['title']})" if named.get("title") else ""
    return " ".join(re.sub(r"\{\{([^{}]*)\}\}", lambda m: _template(m.group(1), inner), p) for p in unnamed)


def _render(kind: str, body: str, inner) -> str:
    """Plain text of one construct; ``inner`` renders enclosed text."""
    mark = lambda block, s: f"\n{_MARK[block]}{s}{_MARK['end']}\n"
    if kind in ("tag", "cut_tag", "escaped_tag"):
        name = re.search(r"[A-Za-z][A-Za-z0-9]*", body.replace("&lt;", "").replace("&gt;", ""))
        low = name.group(0).lower() if name else ""
        closing = body.replace("&lt;", "<").startswith("</")
        if re.fullmatch(r"h[1-6]", low):
            return f"{_MARK['end']}\n" if closing else f"\n{_MARK['heading']}"
        if low == "li":
            return f"{_MARK['end']}\n" if closing else f"\n{_MARK['list']}"
        if low == "pre":
            return f"{_MARK['end']}\n" if closing else f"\n{_MARK['code']}"
        if low == "table":
            return f"{_MARK['end']}\n" if closing else f"\n{_MARK['table']}"
        if low in ("td", "th"):
            return "\t" if closing else ""
        if low == "ref" and not body.endswith("/>"):
            return ")" if closing else " ("
        return "\n" if low in BLOCK_TAGS else ""
    if kind in ("entity", "open_entity"):
        return html.unescape(body if body.endswith(";") else body + ";").replace("\xa0", " ")
    if kind in ("comment", "raw", "rule", "table_rule", "ref_link"):
        return "" if kind != "ref_link" or body.startswith("[^") else body[1:body.index("]")]
    if kind == "fence":
        return mark("code", "\n".join(body.strip().split("\n")[1:]).rstrip("`~").rstrip())
    if kind == "wiki_table":
        rows, cells = [], []
        for ln in body.split("\n")[1:]:
            if ln.startswith(("|-", "|}")):
                rows.append("\t".join(cells))
                cells = []
            elif ln[:1] in "|!":
                cells += [c.strip() for c in re.split(r"\|\||!!", ln[1:])]
        rows.append("\t".join(cells))
        return mark("table", "\n".join(r for r in rows if r))
    if kind == "display_math":
        return mark("formula", body[2:-2].strip())
    if kind == "inline_math":
        return body[2:-2].strip()
    if kind == "dollar_math":
        return body.strip("$").strip()
    if kind == "template":
        return _template(body[2:-2], inner)
    if kind == "wiki_link":
        parts = body[2:-2].split("|")
        return "" if parts[0].lower().startswith(("category:",)) else parts[-1]
    if kind == "image":
        return body[2:body.index("]")]
    if kind == "link":
        return inner(1, body.index("]"))
    if kind == "url_link":
        address, _, label = body[1:-1].partition(" ")
        return label or address
    if kind == "command":
        name = re.match(r"\\([A-Za-z]+)", body).group(1)
        args = re.findall(r"\{((?:[^{}]|\{[^{}]*\})*)\}", body)
        if name in ("begin", "end"):
            return "\n"
        if name in ("cite", "citep", "citet", "label", "ref", "footnote", "includegraphics", "usepackage"):
            return f" ({args[0]})" if name == "footnote" else ""
        if name in ("section", "subsection", "subsubsection", "chapter", "paragraph", "title"):
            return mark("heading", args[0])
        if name in ("SI", "si", "num"):
            return " ".join(_siunitx(a) if "\\" in a else a for a in args)
        if name == "href":
            return args[-1]
        return inner(body.index("{") + 1, len(body) - 1)
    if kind == "bare_command":
        name = body[1:]
        if name == "item":
            return f"\n{_MARK['list']}"
        return SYMBOLS.get(name) or ("\n" if name in _LINE_ENDS else "" if name in _LAYOUT else name)
    if kind == "escape":
        return body[1] if body[1] in "%&$#_{}" else " "
    if kind == "heading":
        return f"\n{_MARK['heading']}"
    if kind == "wiki_heading":
        return mark("heading", body.strip().strip("=").strip())
    if kind in ("star_bullet", "dash_bullet"):
        return f"\n{_MARK['list']}"
    if kind == "quote":
        return ""
    if kind == "table_row":
        cells = inner(body.index("|") + 1, body.rindex("|")).split("|")
        return mark("table", "\t".join(c.strip() for c in cells)) if len(cells) > 1 else cells[0].strip()
    if kind == "wiki_quotes":
        n = len(re.match(r"'+", body).group(0))
        return inner(n, len(body) - n)
    if kind in ("strong", "strike"):
        return inner(2, len(body) - 2)
    if kind in ("star_span", "under_span"):
        return inner(1, len(body) - 1)
    if kind == "code":
        return body.strip("`")
    return "" if kind in ("bracket",) and re.fullmatch(r"\[\d+\]", body) else body


def _blocks(rendered: str) -> list[tuple[str, str]]:
    names = {v: k for k, v in _MARK.items()}
    out: list[tuple[str, str]] = []
    kind, buffer = "text", []

    def flush(k: str) -> None:
        held = "".join(buffer)
        buffer.clear()
        if k in ("code", "table", "formula"):
            parts = ["\n".join(ln.rstrip() for ln in held.strip("\n").split("\n")).strip("\n")]
        else:
            parts = [re.sub(r"[ \t]*\n[ \t]*", "\n", re.sub(r"[ \t]{2,}", " ", p)).strip() for p in re.split(r"\n\s*\n", held)]
        out.extend((k, p) for p in parts if p.strip())

    for piece in re.split(r"([\x01-\x06])", rendered):
        if piece in names:
            flush(kind)
            kind = "text" if names[piece] == "end" else names[piece]
        elif kind in ("heading", "list"):
            head, newline, rest = piece.partition("\n")
            buffer.append(head)
            if newline:
                flush(kind)
                kind = "text"
                buffer.append(rest)
        else:
            buffer.append(piece)
    flush(kind)
    return out


def clean(text: str | None, model: Model, threshold: float = 0.5) -> Cleaned:
    """Marginals, then rendering. Null and empty texts have no markup and stay as they are."""
    if not text:
        return Cleaned(False, 0.0, text or "", [])
    nodes = lex(text)
    if len(nodes) == 1:
        return Cleaned(False, 0.0, text, [("text", text)])
    marg, _ = model.marginals(nodes)
    marked = [(nd, p) for nd, p in zip(nodes, marg) if nd.kind not in _UPPER]
    score = max((p for _, p in marked), default=0.0)
    if score < threshold:
        return Cleaned(False, score, text, [("text", text)])
    chosen = sorted((nd for nd, p in marked if p >= threshold), key=lambda nd: (nd.start, -nd.end))
    inside: dict[int, list[Node]] = {-1: []}  # outermost constructs within each chosen one, by its number
    stack: list[int] = []
    kept: list[Node] = []
    for nd in chosen:
        while stack and kept[stack[-1]].end <= nd.start:
            stack.pop()
        above = stack[-1] if stack else -1
        if above >= 0 and (nd.end > kept[above].end or (nd.start, nd.end) == (kept[above].start, kept[above].end)):
            continue
        inside[above].append(nd)
        inside[len(kept)] = []
        nd.number = len(kept)
        stack.append(len(kept))
        kept.append(nd)

    def render(lo: int, hi: int, above: int) -> str:
        out, at = [], lo
        for nd in inside[above]:
            if nd.start < at or nd.end > hi:
                continue
            out += [text[at:nd.start], _render(nd.kind, nd.text, lambda a, b, base=nd.start, me=nd.number: render(base + a, base + b, me))]
            at = nd.end
        return "".join([*out, text[at:hi]])

    blocks = _blocks(render(0, len(text), -1))
    lines = [("- " + b if k == "list" else b) for k, b in blocks]
    return Cleaned(True, score, "\n".join(lines), blocks)


def clean_texts(rows: DataFrame, key: str, column: str, src: str, model: Model | None = None) -> DataFrame:
    """src, row_key, has_markup, score, clean_text, blocks for every distinct row with a non-null text.

    Rows are independent, so there is one pass and no shuffle besides the removal of exact duplicates.
    """
    fitted = model or train()
    schema = pa.schema([("src", pa.string()), ("row_key", pa.int64()), ("has_markup", pa.bool_()), ("score", pa.float64()),
                        ("clean_text", pa.string()), ("blocks", pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            done = [clean(t, fitted) for t in texts]
            yield pa.RecordBatch.from_arrays([
                pa.array([src] * len(keys)), pa.array(keys, pa.int64()), pa.array([d.has_markup for d in done]),
                pa.array([round(d.score, 6) for d in done], pa.float64()), pa.array([d.text for d in done], pa.string()),
                pa.array([[{"kind": k, "text": b} for k, b in d.blocks] for d in done], schema.field("blocks").type)], schema=schema)

    return rows.select(key, column).where(f"{column} is not null").mapInArrow(
        run, "src string, row_key long, has_markup boolean, score double, clean_text string, blocks array<struct<kind:string,text:string>>"
    ).dropDuplicates(["row_key"])
