"""Markup residue in pages: what kinds there are, and clean text that keeps headings, lists, code blocks and formulas.

Each page is read into a tree of branches (headings, lists, code, formulas, tables, quotes, block tags, environments,
templates and links that stand alone) that span from their opening to their closing mark, with text blocks and marks within a line
(links, emphasis, entities, references, commands) as leaves. The trees of all pages of one host are merged into a site style tree, whose
nodes are paths of branches. What kinds of markup a page has is read off the nodes of the merged tree that it has a part in
(:func:`found_kinds`).

A node of the merged tree knows on how many pages it is, how often each content and each arrangement of branches occurs there.
Entropies over these pages tell what matters: a content that stands on nearly every page (notices, boxes of links) has an entropy
near 1 and an importance near 0, a content of its own an importance of 1; a node whose branches are arranged the same way
everywhere is mere presentation, one that differs from page to page is not. The importance of a branch of a page is worked out from
its leaves upwards: that of a leaf is the importance of its content, that of an inner branch with l parts is (1 - g^l) of the
entropy of its arrangements and g^l of the mean importance of its parts, with g = ``DAMPING``. Branches of low importance are
removed whole, the rest is rendered. Marks and entities are never removed by themselves; headings, lists, code, formulas,
and the rows and cells of a table stand or fall with the branch around them. Nodes on fewer than ``LEAST_PAGES`` pages of a
host say too little for a judgement: what they hold is important.

Defined results: null texts stay null, empty texts empty; unclosed markup ends with its line (code fences with the text);
what is written in nowiki tags is plain text; signs in prose that no language reads as markup are left; texts are read
whole; repeated rows are cleaned once per row and count once in the tree; without a host column all pages are one host, and so are those without a host;
empty tables give empty tables; further columns are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b
from html.entities import html5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselark.runtime import broadcast_if_small, cut

HEADING, LIST, CODE, FORMULA, OTHER = "heading", "list", "code", "formula", "other"
TEXT = "text"
#: Importance below which a branch is noise, and the fewest pages of a path from which that can be told.
NOISE_BELOW, LEAST_PAGES = 0.3, 20
#: How much the parts of a branch count against their arrangement.
DAMPING = 0.9

#: Tags that are markup; others are prose such as 'aged <18'.
TAGS = frozenset(
    "a abbr acronym address article aside b bdi bdo big blockquote body br button caption center cite code col colgroup dd del dfn div dl dt em "
    "figcaption figure font footer form frame gallery h1 h2 h3 h4 h5 h6 head header hr html i iframe img includeonly input ins kbd label li link main mark "
    "math menu meta nav noinclude nowiki ol onlyinclude option p poem pre q ref references rp rt ruby s samp script section select small source span strike "
    "strong style sub sup syntaxhighlight table tbody td textarea tfoot th thead time title tr tt u ul var video wbr chem score templatestyles imagemap".split()
)
LIST_TAGS, HEADING_TAGS = frozenset("ul ol li dl dt dd menu".split()), frozenset(f"h{i}" for i in range(1, 7))
CODE_TAGS, FORMULA_TAGS = frozenset(["pre", "syntaxhighlight", "source"]), frozenset(["math", "chem"])
_HEAD_COMMANDS = r"(?:part|chapter|section|subsection|subsubsection|paragraph|subparagraph)"
_FORMULA_ENV = r"(?:equation|align|alignat|gather|multline|eqnarray|displaymath|math|flalign)"
_CODE_ENV = r"(?:verbatim|Verbatim|lstlisting|minted|alltt)"
_LIST_ENV = r"(?:itemize|enumerate|description)"

_OPAQUE = re.compile(
    r"(?P<comment><!--.*?(?:-->|$(?![\r\n])|(?=\n\s*\n)))"
    r"|<nowiki\s*>(?P<nowiki>.*?)</nowiki\s*>"
    r"|(?P<fence>^[ ]{0,3}(?P<mark>`{3,}|~{3,})[^\n`]*\n(?P<fenced>.*?)(?:^[ ]{0,3}(?P=mark)[`~]*[ \t]*\r?$|\Z))"
    r"|(?P<codetag><(?P<ct>pre|syntaxhighlight|source)\b[^<>]*(?<!/)>(?P<coded>.*?)</(?P=ct)\s*>)"
    rf"|(?P<codeenv>\\begin\{{(?P<ce>{_CODE_ENV}\*?)\}}(?:\[[^\]\n]*\])?(?:\{{[^}}\n]*\}})?(?P<envcode>.*?)\\end\{{(?P=ce)\}})"
    r"|(?P<mathtag><(?P<mt>math|chem)\b[^<>]*(?<!/)>(?P<tagmath>.*?)</(?P=mt)\s*>)"
    rf"|(?P<mathenv>\\begin\{{(?P<me>{_FORMULA_ENV}\*?)\}}(?P<envmath>.*?)\\end\{{(?P=me)\}})"
    r"|(?P<display>\$\$(?=[^$])(?P<dollars>(?:(?!\n\s*\n)[^$])+?)\$\$)"
    r"|(?P<bracket>\\\[(?P<inbracket>(?:(?!\n\s*\n).)+?)\\\])"
    r"|(?P<paren>\\\((?P<inparen>(?:(?!\n\s*\n).)+?)\\\))"
    r"|(?P<inline>(?<![\\$\w])\$(?=[^\s$])(?P<dollar>[^$\n]*?[^\s$\\])\$(?![\w$]))"
    r"|(?P<tick>(?<!`)(?P<bt>`{1,2})(?!`)(?=\S)(?P<ticked>[^`\n]*?[^`\n])(?P=bt)(?!`))",
    re.S | re.M | re.I,
)
_FILL = "\ue001"
_WIKI_HEADING = re.compile(r"^[ \t]*(={2,6})(?!=)[ \t]*([^\n]*?[^=\s])[ \t]*=+[ \t]*(?:<!--.*-->)?[ \t]*\r?$", re.M)
_HASH = re.compile(r"^[ ]{0,3}(#{1,6})[ \t]*(?=\S)([^\n]*?)[ \t]*#*[ \t]*\r?$")
_SETEXT = re.compile(r"^[ ]{0,3}(={3,}|-{3,})[ \t]*\r?$")
_ITEM = re.compile(r"^[ \t]*(?:(?P<star>\*+)(?:[ \t]+|(?=\[\[|\{\{))|(?P<sign>[-+•])[ \t]+|(?P<number>\d{1,3}[.)]|\(\d{1,2}\))[ \t]+)(?=\S)(?P<item>[^\n]*)")
_QUOTE = re.compile(r"^[ ]{0,3}(?:>[ ]?)+(?=\S)")
_RULE = re.compile(r"^[ ]{0,3}(?:-{4,}|\*{3,}|(?:\*[ ]){2,}\*|_{3,})[ \t]*\r?$")
_MD_ROW = re.compile(r"^[ \t]*\|.*\|[ \t]*\r?$")
_MD_BAR = re.compile(r"^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*\r?$|^[ \t]*\|[ \t]*:?-{2,}:?[ \t]*\|[ \t]*\r?$")
_LATEX_HEADING = re.compile(rf"\\{_HEAD_COMMANDS}\*?\s*\{{([^{{}}\n]*)\}}?")
_LATEX_LIST = re.compile(rf"\\(?:begin|end)\{{{_LIST_ENV}\*?\}}|\\item\b(?:\[[^\]\n]*\])?")
_LATEX_OTHER = re.compile(r"\\(?:begin|end)\{[A-Za-z]+\*?\}(?:\[[^\]\n]*\])?|\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{|\\(?:LaTeX|TeX|ldots|dots|noindent|maketitle|centering|hline|newpage|footnotemark|tableofcontents)\b")
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)(\s[^<>]*|/)?>")
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")
_INLINE = [
    ("link", re.compile(r"\[\[")),
    ("template", re.compile(r"\{\{(?=[^{}\s])|\{\{\{")),
    ("external", re.compile(r"\[(?:https?:|ftp:|mailto:)?//[^\s\]]+(?:[ \t][^\]\n]*)?\]|\[mailto:[^\]\n]+\]")),
    ("image", re.compile(r"!\[[^\]\n]*\]\([^)\n]+\)")),
    ("anchor", re.compile(r"(?<!!)\[[^\]\n]+\](?:\([^()\s]+(?:[ \t]+\"[^\"\n]*\")?\)|\[[^\]\n]+\])|^\[[^\]\n]+\]:[ \t]+\S+|<https?://[^\s<>]+>", re.M)),
    ("emphasis", re.compile(r"(?<!')'''(?!')[^\n]+?'''|(?<!')''(?!')(?=\S)[^'\n][^\n]*?(?<!')''(?!')|(?<!')'''''(?!')[^\n]+?'''''")),
    ("emphasis", re.compile(r"(?<![\w*\\])\*\*(?=[^\s*])[^*\n]*[^\s*]\*\*(?![\w*])|(?<![\w*\\])\*(?=[^\s*])(?:[^*\n]*[^\s*])?\*(?![\w*])(?<!\*\*)")),
    ("emphasis", re.compile(r"(?<![\w_])__(?=[^\s_])[^_\n]*[^\s_]__(?![\w_])|(?<![\w_])_(?=[^\s_])[^_\n]*[^\s_]_(?![\w_])|~~(?=[^\s~])[^~\n]*[^\s~]~~(?!~)")),
    ("table", re.compile(r"^[ \t:]*\{\|", re.M)),
    ("switch", re.compile(r"(?<!\w)__[A-Z]{3,}__(?!\w)|(?<!~)~{3,5}(?![~\w])|^#REDIRECT\b", re.M)),
]


@dataclass(frozen=True)
class Node:
    """A presentation node: its kind, path in the tree, and span in the page."""

    kind: str
    path: str
    start: int
    end: int


def _named(entity: str) -> bool:
    return entity[1] == "#" or entity[1:] in html5


def read(text: str) -> tuple[list[Node], str, list[tuple[int, int, str, str]]]:
    """The presentation nodes of a page; the text with opaque spans filled; and these spans with their kind and content."""
    nodes: list[Node] = []
    opaque: list[tuple[int, int, str, str]] = []
    parts, at = [], 0
    for m in _OPAQUE.finditer(text):
        g = m.groupdict()
        kind, inner, path = OTHER, "", "comment"
        if g["nowiki"] is not None:
            path, inner = "nowiki", g["nowiki"]
        elif g["fence"] is not None or g["codetag"] is not None or g["codeenv"] is not None:
            kind, path = CODE, "code"
            inner = next(x for x in (g["fenced"], g["coded"], g["envcode"]) if x is not None)
        elif g["tick"] is not None:
            path, inner = "inline-code", g["ticked"]
        elif g["comment"] is None:
            kind, path = FORMULA, "formula"
            inner = next(x for x in (g["tagmath"], g["envmath"], g["dollars"], g["inbracket"], g["inparen"], g["dollar"]) if x is not None)
        nodes.append(Node(kind, path, m.start(), m.end()))
        opaque.append((m.start(), m.end(), path, inner))
        parts += [text[at : m.start()], _FILL * (m.end() - m.start())]
        at = m.end()
    plain = "".join([*parts, text[at:]])
    if not re.search(r"[=#*+\-•\d>|<&\\\[{_~']", plain):
        return nodes, plain, opaque

    lines = plain.split("\n")
    offset, hashes = 0, [bool(_HASH.match(x)) for x in lines]
    for i, line in enumerate(lines):
        start, end = offset, offset + len(line)
        offset = end + 1
        before = lines[i - 1] if i else ""
        behind = lines[i + 1] if i + 1 < len(lines) else ""
        if hashes[i]:
            listed = (i > 0 and hashes[i - 1]) or (i + 1 < len(lines) and hashes[i + 1])
            if not line.lstrip().upper().startswith("#REDIRECT"):
                m = _HASH.match(line)
                spaced = line.lstrip()[len(m[1]) : len(m[1]) + 1] in " \t"
                if listed:
                    nodes.append(Node(LIST, "list/item", start, end))
                elif spaced:
                    nodes.append(Node(HEADING, f"heading/{len(m[1])}", start, end))
        elif _SETEXT.match(line) and before.strip() and not _MD_ROW.match(before) and not _ITEM.match(before) and (i < 2 or not lines[i - 2].strip()) and not _QUOTE.match(before):
            nodes.append(Node(HEADING, f"heading/{1 if '=' in line else 2}", start - len(before) - 1, end))
        elif _RULE.match(line) and not re.match(r"\s*\*{4}\s+\S", line):
            nodes.append(Node(OTHER, "rule", start, end))
        elif _ITEM.match(line):
            nodes.append(Node(LIST, "list/item", start, end))
        elif _QUOTE.match(line):
            nodes.append(Node(OTHER, "quote", start, end))
        elif _MD_ROW.match(line) and (_MD_BAR.match(behind) or _MD_BAR.match(before) or _MD_BAR.match(line)):
            nodes.append(Node(OTHER, "table/row", start, end))
    for m in _WIKI_HEADING.finditer(plain):
        nodes.append(Node(HEADING, f"heading/{len(m[1])}", m.start(), m.end()))
    if "\\" in plain:
        for m in _LATEX_HEADING.finditer(plain):
            nodes.append(Node(HEADING, "heading/2", m.start(), m.end()))
        for m in _LATEX_LIST.finditer(plain):
            nodes.append(Node(LIST, "list/item", m.start(), m.end()))
        taken = {n.start for n in nodes}
        for m in _LATEX_OTHER.finditer(plain):
            if m.start() not in taken:
                formula = re.match(rf"\\(?:begin|end)\{{{_FORMULA_ENV}", m[0])
                code = re.match(rf"\\(?:begin|end)\{{{_CODE_ENV}", m[0])
                nodes.append(Node(FORMULA if formula else CODE if code else OTHER, "command", m.start(), m.end()))
    if "<" in plain:
        for m in _TAG.finditer(plain):
            tag = m[2].lower()
            if tag in TAGS:
                kind = LIST if tag in LIST_TAGS else HEADING if tag in HEADING_TAGS else CODE if tag in CODE_TAGS else FORMULA if tag in FORMULA_TAGS else OTHER
                nodes.append(Node(kind, f"tag/{tag}", m.start(), m.end()))
    if "&" in plain:
        for m in _ENTITY.finditer(plain):
            if _named(m[0]):
                nodes.append(Node(OTHER, "entity", m.start(), m.end()))
    for path, pattern in _INLINE:
        for m in pattern.finditer(plain):
            nodes.append(Node(OTHER, path, m.start(), m.end()))
    return nodes, plain, opaque


def kinds(text: str) -> set[str]:
    return {n.kind for n in read(text)[0]}


#: Tags that make a block; those without an end tag; those that the next of their group, or the end of what is around them, ends.
BLOCK_TAGS = LIST_TAGS | HEADING_TAGS | frozenset(
    "address article aside blockquote body caption center col colgroup div figcaption figure footer form frame gallery head header hr html iframe imagemap "
    "includeonly main meta nav noinclude onlyinclude p poem pre references script section select source style table tbody td textarea tfoot th thead title tr".split()
)
VOID_TAGS = frozenset("br hr img input meta link wbr col frame templatestyles".split())
ENDED_BY = {x: frozenset(g) for g in (("p",), ("li",), ("dd", "dt"), ("tr",), ("td", "th"), ("option",)) for x in g}
#: Branches that stand or fall with their table.
TABLE_PARTS = frozenset(f"tag/{x}" for x in "tr td th caption col colgroup thead tbody tfoot".split())
_BRACKETS = re.compile(r"\[\[|\]\]|^[ \t:]*\{\||^[ \t]*\|\}(?!\})|\{{2,}|\}|\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{", re.M)
_ENVIRONMENT = re.compile(r"\\(begin|end)\{([A-Za-z]+\*?)\}")
_BLANK_LINE = re.compile(r"\n[ \t\r]*\n")
_MARKS = re.compile(r"<!--.*?-->|\\(?:begin|end)\{[A-Za-z]+\*?\}|\\[A-Za-z]+\*?|[\[\]{}|*#=>'_~`]+", re.S)


@dataclass
class Branch:
    """A branch of a page: span from opening to closing mark, kind, path from the root, hash of its content (none if it has
    no words), and whether its importance decides that it stays. What ``holds`` others has them between opening and closing mark."""

    start: int
    end: int
    kind: str
    path: str
    block: bool = True
    holds: bool = False
    opening: int = 0
    closing: int = 0
    content: bytes | None = None
    judged: bool = False
    parent: int = -1
    shape: bytes | None = None


def _content(text: str) -> bytes | None:
    """A hash of the words of a text without its marks; none without words."""
    text = _MARKS.sub(" ", _TAG.sub(lambda m: " " if m[2].lower() in TAGS else m[0], text))
    text = " ".join(html.unescape(text).split()).lower()
    return blake2b(text.encode("utf-8", "replace"), digest_size=12).digest() if re.search(r"\w", text) else None


def _spans(text: str) -> list[Branch]:
    """All branches and marks of a page from opening to closing mark, in no order; what is unclosed ends with its line."""
    nodes, plain, _ = read(text)
    breaks = [m.start() for m in re.finditer("\n", plain)] + [len(plain)]
    out: list[Branch] = []

    def line_end(at: int) -> int:
        return breaks[bisect_left(breaks, at)]

    def alone(start: int, end: int) -> bool:
        while start and plain[start - 1] in " \t":
            start -= 1
        while end < len(plain) and plain[end] in " \t\r":
            end += 1
        return (not start or plain[start - 1] == "\n") and (end >= len(plain) or plain[end] == "\n")

    lines: list[Branch] = []
    for n in nodes:
        if n.path in ("quote", "table/row"):
            path = n.path.partition("/")[0]
            if lines and lines[-1].path == path and lines[-1].end + 1 == n.start:
                lines[-1].end = n.end
            else:
                lines.append(Branch(n.start, n.end, OTHER, path))
        elif n.path == "rule" or n.kind in (HEADING, LIST) and n.path.startswith((HEADING, LIST)) and not (n.kind == LIST and plain[n.start] == "\\"):
            out.append(Branch(n.start, n.end, n.kind, n.path))
        elif n.path in ("code", "formula"):
            out.append(Branch(n.start, n.end, n.kind, n.path, alone(n.start, n.end)))
        elif n.path in ("comment", "nowiki", "inline-code", "external", "image", "anchor", "emphasis"):
            out.append(Branch(n.start, n.end, OTHER, n.path, False))
    out += lines

    opened: list[tuple[str, int]] = []
    count = dict.fromkeys(("link", "template", "table", "command"), 0)

    def close(kind: str, end: int) -> None:
        while True:
            was, start = opened.pop()
            count[was] -= 1
            stop = end if was == kind else line_end(start)
            out.append(Branch(start, stop, OTHER, was, was == "table" or was != "command" and alone(start, stop)))
            if was == kind:
                return

    def open_(kind: str, start: int) -> None:
        opened.append((kind, start))
        count[kind] += 1

    at = 0
    for m in _BRACKETS.finditer(plain):
        if m.start() < at:
            continue
        sign = m[0].strip(" \t:")
        if sign == "[[":
            open_("link", m.start())
        elif sign == "{|":
            open_("table", m.end() - 2)
        elif sign.startswith("{{"):
            open_("template", m.start())
        elif sign.startswith("\\"):
            if not sign.startswith(("\\begin{", "\\end{")):
                open_("command", m.start())
        elif sign == "]]":
            if count["link"]:
                close("link", m.end())
        elif sign == "|}":
            if count["table"]:
                close("table", line_end(m.end()))
        elif opened and opened[-1][0] == "command":
            close("command", m.end())
        elif plain.startswith("}}", m.start()):
            at = m.end() + 1
            if count["template"]:
                close("template", at)
        elif count["command"]:
            close("command", m.end())
    while opened:
        close(opened[-1][0], line_end(opened[-1][1]))

    tags: list[tuple[str, int, int]] = []
    names: dict[str, int] = {}

    def end_tag(end: int, closing: int = 0) -> None:
        name, start, size = tags.pop()
        names[name] -= 1
        kind = LIST if name in LIST_TAGS else HEADING if name in HEADING_TAGS else CODE if name in CODE_TAGS else FORMULA if name in FORMULA_TAGS else OTHER
        out.append(Branch(start, end, kind, f"tag/{name}", name in BLOCK_TAGS, kind in (OTHER, LIST), size, closing))

    for m in _TAG.finditer(plain) if "<" in plain else ():
        name = m[2].lower()
        if name not in TAGS:
            continue
        if m[1]:
            if names.get(name):
                while tags[-1][0] != name:
                    end_tag(m.start() if tags[-1][0] in ENDED_BY else line_end(tags[-1][1]))
                end_tag(m.end(), m.end() - m.start())
        elif name in VOID_TAGS or m[0].endswith("/>"):
            out.append(Branch(m.start(), m.end(), OTHER, f"tag/{name}", name in BLOCK_TAGS))
        else:
            while tags and tags[-1][0] in ENDED_BY.get(name, ()):
                end_tag(m.start())
            tags.append((name, m.start(), m.end() - m.start()))
            names[name] = names.get(name, 0) + 1
    while tags:
        end_tag(line_end(tags[-1][1]))

    begun: list[tuple[str, int, int]] = []
    for m in _ENVIRONMENT.finditer(plain) if "\\" in plain else ():
        if m[1] == "begin":
            begun.append((m[2], m.start(), m.end() - m.start()))
        elif begun and begun[-1][0] == m[2]:
            name, start, size = begun.pop()
            kind = LIST if re.fullmatch(_LIST_ENV + r"\*?", name) else OTHER
            out.append(Branch(start, m.end(), kind, f"environment/{name}", True, True, size, m.end() - m.start()))
    return out


def tree(text: str) -> list[Branch]:
    """The branches of a page and the text blocks that are their leaves, parents first."""
    root = Branch(0, len(text), OTHER, "", True, True)
    found: list[tuple[Branch, Branch]] = []
    inline: list[Branch] = []
    stack = [root]
    for b in sorted(_spans(text), key=lambda b: (b.start, -b.end)):
        while len(stack) > 1 and stack[-1].end <= b.start:
            stack.pop()
        for around in reversed(stack):  # marks that cross: the one that began first holds the other
            if around.end >= b.end:
                break
            around.end, around.closing = b.end, 0
        if not stack[-1].block:
            continue  # part of the text block
        if b.block:
            found.append((b, stack[-1]))
        else:
            inline.append(b)
        stack.append(b)
    ends = [b.end for b in inline]  # they do not overlap
    children: dict[int, list[Branch]] = {}
    for b, parent in found:
        children.setdefault(id(parent), []).append(b)
    kept = {id(root): False}
    out: list[tuple[Branch, Branch]] = []
    walk: list[tuple[Branch, Branch]] = [(root, root)]
    while walk:
        b, parent = walk.pop()
        if b is not root:
            own = b.path
            b.path = f"{parent.path}>{own}" if parent.path else own
            if len(b.path) > 400:
                b.path = "..." + blake2b(b.path.encode(), digest_size=12).hexdigest()
            b.judged = b.kind in (OTHER, TEXT) and not kept[id(parent)] and own not in TABLE_PARTS and not (b.kind == TEXT and parent.path.rpartition(">")[2] in TABLE_PARTS | {"tag/table"})
            kept[id(b)] = kept[id(parent)] or b.kind in (HEADING, LIST, CODE, FORMULA)
            out.append((b, parent))
        if not b.holds:
            continue
        inner = children.setdefault(id(b), [])
        at, leaves = b.start + b.opening, []
        for start, end in [*((c.start, c.end) for c in inner), (b.end - b.closing, b.end)]:
            cuts = []
            for m in _BLANK_LINE.finditer(text, at, max(at, start)):
                k = bisect_right(ends, m.start())
                if k == len(ends) or inline[k].start >= m.end():
                    cuts.append(m.span())
            for to, behind in [*cuts, (start, end)]:
                piece = text[at:to]
                if piece.strip() and to > at:
                    leaves.append(Branch(at + len(piece) - len(piece.lstrip()), at + len(piece.rstrip()), TEXT, "text"))
                at = max(at, behind)
        walk += [(c, b) for c in reversed(sorted([*inner, *leaves], key=lambda c: c.start))]
        children[id(b)] = inner + leaves
    number = {id(b): i for i, (b, _) in enumerate(out)}
    for b, parent in reversed(out):  # what holds branches has the contents of these
        b.parent = number.get(id(parent), -1)
        if b.holds:
            steps = [c.path.rpartition(">")[2] for c in sorted(children[id(b)], key=lambda c: c.start)]
            b.shape = blake2b("|".join(steps).encode(), digest_size=8).digest()
            parts = [c.content for c in sorted(children[id(b)], key=lambda c: c.start) if c.content]
            b.content = blake2b(b"".join(parts), digest_size=12).digest() if parts else None
        else:
            b.content = _content(text[b.start : b.end])
        b.judged = b.judged and b.content is not None
    return [b for b, _ in out]


_PAIRS = re.compile(r"\{\{|\}\}|\[\[|\]\]")
_DROPPED = re.compile(r"<ref\b[^<>]*/>|<ref\b[^<>]*>.*?</ref\s*>|<(script|style|references|gallery|imagemap)\b[^<>]*>.*?</\1\s*>|<references\s*/>", re.S | re.I)


def _link_text(inner: str) -> str:
    target, _, label = inner.partition("|")
    if re.match(r"\s*(?:File|Image)\s*:", target, re.I):
        last = inner.split("|")[-1]
        return "" if "|" not in inner or re.fullmatch(r"\s*(?:thumb|left|right|center|none|\d+px)\s*", last) else last
    if re.match(r"\s*Category\s*:", target, re.I):
        return ""
    return (label or target).strip()


def _template_text(inner: str) -> str:
    name, *rest = inner.split("|")
    named = name.strip().lower()
    if named in ("quote", "blockquote"):
        return next((x.partition("=")[2] if x.strip().startswith("text") and "=" in x else x for x in rest), "")
    if named == "convert" and len(rest) > 1:
        return f"{rest[0]} {rest[1]}"
    return ""


def _unwrap(text: str) -> str:
    """Templates and links by what they show, from the innermost outwards in one pass. What is left open ends
    with its line: of a template its arguments go, of a link the target before its bar, and else the mark alone; closing marks that nothing opened stay."""
    stack: list[tuple[str, list[str]]] = [("", [])]
    opened = {"{{": 0, "[[": 0}
    at = 0

    def drop() -> None:
        mark, parts = stack.pop()
        opened[mark] -= 1
        line, end, rest = "".join(parts).partition("\n")
        if mark == "{{":
            line = "" if "|" in line else line  # arguments go, prose stays
        else:
            line = re.sub(r"^[^|]*\|", "", line)
        stack[-1][1].append(line + end + rest)

    for m in _PAIRS.finditer(text):
        stack[-1][1].append(text[at : m.start()])
        at = m.end()
        if m[0] in opened:
            stack.append((m[0], []))
            opened[m[0]] += 1
            continue
        mark, show = ("{{", _template_text) if m[0] == "}}" else ("[[", _link_text)
        if not opened[mark]:
            stack[-1][1].append(m[0])
            continue
        while stack[-1][0] != mark:
            drop()
        inner = "".join(stack.pop()[1])
        opened[mark] -= 1
        stack[-1][1].append(show(inner))
    stack[-1][1].append(text[at:])
    while len(stack) > 1:
        drop()
    return "".join(stack[0][1])


def render(text: str, removed: frozenset[int] = frozenset()) -> str:
    """Clean text. Headings become ``#`` lines, items ``-`` or numbered lines, code fenced blocks, formulas ``$`` spans.
    ``removed`` are the numbers of branches (of :func:`tree`) that are noise."""
    text = text.replace("\r\n", "\n")
    if removed:
        branches, pieces, at = tree(text), [], 0
        for start, end in sorted((branches[i].start, branches[i].end) for i in removed):
            pieces.append(text[at : max(at, start)])
            at = max(at, end)
        text = "".join([*pieces, text[at:]])
    _, plain, opaque = read(text)
    kept: list[str] = []

    def hold(piece: str) -> str:
        kept.append(piece)
        return f"\ue002{len(kept) - 1}\ue003"

    def heading(level: int, title: str) -> str:
        """A heading; its mark is held, so that no rule of lists takes it for an item."""
        return f"{hold('#' * level)} {title}"

    parts, at = [], 0
    for start, end, path, inner in opaque:
        if start < at:
            continue
        parts.append(plain[at:start])
        if path == "code":
            body = html.unescape(re.sub(r"^\s*<code\b[^<>]*>|</code\s*>\s*$", "", inner)) if text[start] == "<" else inner
            parts.append("\n" + hold("```\n" + body.strip("\n") + "\n```") + "\n")
        elif path == "formula":
            if re.search(r"</?m[a-z]+", inner):
                inner = re.sub(r"<[^<>]*>", " ", inner)
            long = text[start : start + 2] in ("$$", "\\[", "\\b")
            inner = " ".join(inner.split())
            parts.append(hold(f"$${inner}$$" if long else f"${inner}$"))
        elif path != "comment":
            parts.append(hold(inner))
        at = end
    parts.append(plain[at:])
    body = _DROPPED.sub("", "".join(parts))
    body = re.sub(r"^[ \t:]*\{\|[^\n]*\n(.*?)^[ \t]*\|\}[^\n]*$", lambda m: "\n".join(" | ".join(c.strip() for c in re.split(r"\|\||!!", r.lstrip("|!").strip())) for r in m[1].split("\n") if r.strip() and not r.startswith("|-") and not r.startswith("|+")), body, flags=re.S | re.M)
    body = _unwrap(body)
    body = re.sub(r"!\[([^\]\n]*)\]\([^)\n]+\)|(?<!!)\[([^\]\n]+)\]\([^()\s]+(?:[ \t]+\"[^\"\n]*\")?\)", lambda m: m[1] or m[2] or "", body)
    body = re.sub(r"\[(?:https?:|ftp:)?//[^\s\]]+(?:[ \t]([^\]\n]*))?\]", lambda m: m[1] or "", body)
    body = _WIKI_HEADING.sub(lambda m: heading(len(m[1]), m[2]), body)
    body = re.sub(r"<h([1-6])\b[^<>]*>(.*?)</h\1\s*>", lambda m: f"\n{heading(int(m[1]), ' '.join(m[2].split()))}\n", body, flags=re.S | re.I)
    body = re.sub(rf"\\({_HEAD_COMMANDS})\*?\s*\{{([^{{}}\n]*)\}}", lambda m: f"\n{heading(2 + m[1].count('sub'), m[2])}\n", body)
    body = re.sub(r"^([^\n]*\S[^\n]*)\n[ ]{0,3}(={3,}|-{3,})[ \t]*$", lambda m: heading(1 if "=" in m[2] else 2, m[1].strip()), body, flags=re.M)
    body = re.sub(rf"\\(?:begin|end)\{{{_LIST_ENV}\*?\}}", "", body)
    body = re.sub(r"\\item\b(?:\[[^\]\n]*\])?[ \t]*", "- ", body)
    body = re.sub(r"[ \t]*<li\b[^<>]*>[ \t]*", "\n- ", body, flags=re.I)
    body = re.sub(r"\\(?:emph|textbf|textit|texttt|underline|textsc|mbox|text)\{([^{}]*)\}", r"\1", body)
    body = re.sub(r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{[^{}\n]*\}", "", body)
    body = re.sub(r"<br\s*/?>|</(?:p|div|tr|table|ul|ol|h[1-6]|blockquote)\s*>", "\n", body, flags=re.I)
    body = re.sub(r"</t[dh]\s*>", " ", body, flags=re.I)
    body = _TAG.sub(lambda m: "" if m[2].lower() in TAGS else m[0], body)
    for path, pattern in _INLINE:
        if path == "emphasis":
            body = pattern.sub(lambda m: re.sub(r"^('{2,5}|\*{1,2}|_{1,2}|~~)|('{2,5}|\*{1,2}|_{1,2}|~~)$", "", m[0]), body)
    out = []
    rows = body.split("\n")
    hashes = [bool(_HASH.match(x)) for x in rows]
    for i, line in enumerate(rows):
        if _MD_BAR.match(line) or _RULE.match(line) and not re.match(r"\s*\*{4}\s+\S", line):
            continue
        line = _QUOTE.sub("", line)
        m = _ITEM.match(line)
        if hashes[i] and (i and hashes[i - 1] or i + 1 < len(rows) and hashes[i + 1]):
            line = "1. " + line.lstrip("# \t")
        elif m:
            depth = len(m["star"]) - 1 if m["star"] else (len(line) - len(line.lstrip())) // 2
            line = "  " * depth + (f"{m['number']} " if m["number"] else "- ") + m["item"]
        elif _MD_ROW.match(line):
            line = " | ".join(c.strip() for c in line.strip().strip("|").split("|"))
        out.append(line.rstrip())
    body = html.unescape("\n".join(out))
    body = re.sub(r"\ue002(\d+)\ue003", lambda m: kept[int(m[1])], body).replace(_FILL, "")
    return re.sub(r"\n{3,}", "\n\n", body).strip("\n")


def kept_text(text: str, contents: dict[int, float], shapes: dict[int, float]) -> frozenset[int]:
    """The numbers of the branches of a page that are noise, by the importance of their contents and the entropy of their
    arrangements (those that are not given have 1)."""
    branches = tree(text)
    parts: list[list[float]] = [[] for _ in branches]
    noise = []
    for n in range(len(branches) - 1, -1, -1):  # parents come before what they hold
        b = branches[n]
        if parts[n]:
            damped = DAMPING ** len(parts[n])
            importance = (1 - damped) * shapes.get(n, 1.0) + damped * sum(parts[n]) / len(parts[n])
        else:
            importance = contents.get(n, 1.0)
        if b.content is not None and b.parent >= 0:
            parts[b.parent].append(importance)
        if b.judged and importance < NOISE_BELOW:
            noise.append(n)
    return frozenset(noise)


def _rows(pages: DataFrame, key: str, text: str, host: str | None) -> DataFrame:
    return pages.select(F.col(key).cast("long").alias("id"), F.xxhash64(key, text).alias("page"), F.coalesce(F.col(host) if host else F.lit(None), F.lit("")).alias("host"), F.col(text).alias("text"))


def dom_nodes(pages: DataFrame, key: str = "id", text: str = "text", host: str | None = None) -> DataFrame:
    """``page, host, node, path, content, shape``: the branches of each page text that have words; ``content`` is a hash of
    these, ``shape`` one of the arrangement of its parts (if it holds any), ``node`` the number in :func:`tree`. Texts themselves do not
    leave their task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(6)]
            for page, h, t in zip(*(batch.column(k).to_pylist() for k in range(1, 4)), strict=True):
                for n, b in enumerate(tree(t.replace("\r\n", "\n")) if t else ()):
                    if b.content is not None:
                        for column, value in zip(columns, (page, h, n, b.path, b.content, b.shape), strict=True):
                            column.append(value)
            types = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=True)], names=["page", "host", "node", "path", "content", "shape"])

    return _rows(pages, key, text, host).mapInArrow(run, "page long, host string, node int, path string, content binary, shape binary")


def style_tree(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The merged style tree of each host. ``host, path, content, pages, of_pages, importance``: a content's importance is one
    less its entropy over the pages of its path, with their number as the base. ``host, path, of_pages, entropy``: how much the
    arrangements of a path differ over its pages (1 if each page has its own, 0 if all have the same)."""
    paths = nodes.groupBy("host", "path").agg(F.countDistinct("page").alias("of_pages"))
    contents = nodes.select("host", "path", "content", "page").distinct().groupBy("host", "path", "content").agg(F.count("*").alias("pages"))
    rows = contents.join(paths, ["host", "path"])
    base = F.when(F.col("of_pages") > 1, F.ln("of_pages"))
    contents = rows.withColumn("importance", 1 - F.coalesce(F.ln("pages") / base, F.lit(0.0)))
    shapes = nodes.where("shape is not null").groupBy("host", "path", "shape").agg(F.count("*").alias("n"))
    whole = shapes.groupBy("host", "path").agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.ln("n")).alias("s"))
    # -sum p log p of n_i of N is log N - (sum n_i log n_i) / N
    entropy = F.when(F.col("all") > 1, (F.ln("all") - F.col("s") / F.col("all")) / F.ln("all")).otherwise(1.0)
    shapes = whole.join(paths, ["host", "path"]).select("host", "path", "of_pages", entropy.alias("entropy"))
    return contents, shapes


def clean_pages(pages: DataFrame, key: str = "id", text: str = "text", host: str | None = None) -> DataFrame:
    """``id, text``: the pages in clean text, without branches of low importance."""
    nodes = cut(dom_nodes(pages, key, text, host), "branches")
    contents, shapes = style_tree(nodes)
    told = F.col("of_pages") >= LEAST_PAGES
    common = contents.where(told & (F.col("pages") > 1)).select("host", "path", "content", "importance")
    by_content = nodes.where("shape is null").join(common, ["host", "path", "content"]).select("page", "node", F.col("importance").alias("value"), F.lit(True).alias("leaf"))
    alike = broadcast_if_small(cut(shapes.where(told & (F.col("entropy") < 1)).select("host", "path", "entropy"), "shapes"))
    by_shape = nodes.where("shape is not null").join(alike, ["host", "path"]).select("page", "node", F.col("entropy").alias("value"), F.lit(False).alias("leaf"))
    # as many as the page has branches; without a common content a page has no noise
    judged = by_content.unionByName(by_shape).groupBy("page").agg(F.collect_set(F.struct("leaf", "node", "value")).alias("told")).where(F.exists("told", lambda x: x["leaf"]))
    rows = pages.select(F.col(key).cast("long").alias("id"), F.xxhash64(key, text).alias("page"), F.col(text).alias("text")).join(judged, "page", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for t, told in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if t:
                    t = t.replace("\r\n", "\n")
                    contents, shapes = ({x["node"]: x["value"] for x in told or () if x["leaf"] == leaf} for leaf in (True, False))
                    t = render(t, kept_text(t, contents, shapes) if contents else frozenset())
                texts.append(t)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return rows.select("id", "text", "told").mapInArrow(run, "id long, text string")


def marked_paths(text: str) -> set[str]:
    """The paths of all marks of a page: the branches around a mark, then its kind and what it is."""
    nodes = sorted(read(text)[0], key=lambda n: n.start)
    if not nodes:
        return set()
    around = [b for b in tree(text) if b.kind != TEXT]  # parents first, in the order of the text
    out, stack, k = set(), [], 0
    for n in nodes:
        while k < len(around) and around[k].start <= n.start:
            while stack and stack[-1].end <= around[k].start:
                stack.pop()
            stack.append(around[k])
            k += 1
        while stack and stack[-1].end <= n.start:
            stack.pop()
        inner = next((b for b in reversed(stack) if b.end >= n.end and (b.start, b.end) != (n.start, n.end)), None)
        out.add(f"{inner.path if inner else ''}>{n.kind}:{n.path}")
    return out


def found_kinds(pages: DataFrame, key: str = "id", text: str = "text", host: str | None = None) -> DataFrame:
    """``id, markup_kind``: the kinds of markup in each page, of any importance, read off the nodes of the merged style tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i, h, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                rows += [(i, h, path) for path in sorted(marked_paths(t.replace("\r\n", "\n")) if t else ())]
            columns = [pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "host", "path"])

    marks = cut(_rows(pages, key, text, host).where("id is not null").mapInArrow(run, "id long, host string, path string"), "marks")
    merged = marks.groupBy("host", "path").agg(F.count("*").alias("pages"))
    step = F.element_at(F.split("path", ">"), -1)
    nodes = broadcast_if_small(cut(merged.select("host", "path", F.substring_index(step, ":", 1).alias("markup_kind")), "style"))
    return marks.join(nodes, ["host", "path"]).select("id", "markup_kind").distinct()
