"""Wiki markup to plain text and section-aware links.

Text is cut by an ordered table of patterns: each pattern only sees the fragments that the ones before it left raw, so
that ``^`` and ``$`` also match at fragment borders. A single left-to-right fold then closes what was opened: each closer
takes everything back to its nearest opener. What a construct shows is worked out when it is closed; only headings,
links and templates keep more than that. The nearest openers are kept on stacks, so folding is linear.

``strict`` reproduces the historical rendering of paired HTML tags without a meaning of their own as ``{nil}``; otherwise
their inner text is shown.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

#: Sections that are not shown.
IGNORED_SECTIONS = frozenset(["Articles", "External links", "Further reading", "Notes", "Online biographies", "References", "See also", "Sources"])
#: HTML, parser and extension tags allowed in wiki markup.
ALLOWED_TAGS = (
    "h1", "h2", "h3", "h4", "h5", "h6", "p", "abbr", "b", "bdi", "bdo", "blockquote", "cite", "code", "data", "del", "dfn", "em", "i", "ins", "kbd",
    "mark", "pre", "q", "rp", "rt", "ruby", "s", "samp", "small", "strong", "sub", "sup", "time", "u", "var", "wbr", "dl", "dt", "dd", "ol", "ul", "li",
    "div", "span", "table", "td", "tr", "th", "caption", "thead", "tfoot", "tbody", "gallery", "includeonly", "noinclude", "onlyinclude",
    "categorytree", "charinsert", "chem", "ce", "graph", "hiero", "imagemap", "indicator", "inputbox", "mapframe", "maplink", "math", "math chem", "poem",
    "ref", "references", "score", "section", "syntaxhighlight", "source", "templatedata", "templatestyles", "timeline",
)
_TAG_NAMES = "|".join(ALLOWED_TAGS)
MATH_TOKEN = "_math_"


@dataclass
class Piece:
    """A stretch of the text: ``kind`` says what it is, ``shown`` is its rendering, ``name`` what it opens, closes or is."""

    kind: str
    shown: str
    name: str = ""
    level: int = 0


def _raw(text: str) -> Piece:
    return Piece("raw", text)


#: The marks of wiki markup, in the order in which they take effect; each entry: pattern, and what a match becomes.
_CUTS: list[tuple[re.Pattern[str], Callable[[str], Piece]]] = [
    (re.compile(r"<nowiki ?/>"), lambda s: Piece("hidden", "")),
    (re.compile(r"^={2,6}", re.M), lambda s: Piece("open", s, "header", len(s))),
    (re.compile(r"={2,6}$", re.M), lambda s: Piece("close", s, "header", len(s))),
    (re.compile(r"\{\{[^#<>\[\]|{}]+\|?"), lambda s: Piece("open", s, "template")),
    (re.compile(r"\}\}"), lambda s: Piece("close", s, "template")),
    (re.compile(r'<ref (?:(?:name|group) *= *(?:"[^"]+"|[^">]+) *)+/>'), lambda s: Piece("hidden", "")),
    (re.compile(r'<ref(?: name *= *(?:"[^"]+"|[^">]+))? *>'), lambda s: Piece("open", s, "ref")),
    (re.compile(r"</ref>"), lambda s: Piece("close", s, "ref")),
    (re.compile(r"\[\["), lambda s: Piece("open", s, "link")),
    (re.compile(r"\]\]"), lambda s: Piece("close", s, "link")),
    (re.compile(r"\[https?://[^ \]]+ [^\]]+\]"), lambda s: Piece("hidden", s[1:-1].split(" ", 1)[1])),
    (re.compile(r"<!--.*?-->"), lambda s: Piece("hidden", "")),
    (re.compile(r"\{\|"), lambda s: Piece("open", s, "table")),
    (re.compile(r"\|\}"), lambda s: Piece("close", s, "table")),
    (re.compile(f"<(?:{_TAG_NAMES})>"), lambda s: Piece("open", s, "tag:" + s[1:-1].split(" ")[0])),
    (re.compile(f"</(?:{_TAG_NAMES})>"), lambda s: Piece("close", s, "tag:" + s[2:-1])),
]


def _shown(pieces: list[Piece]) -> str:
    return "".join(p.shown for p in pieces)


def _nowiki(text: str) -> list[Piece]:
    """The first opening tag is closed by the first closing tag behind it; what lies between is kept as it is."""
    out, at = [], 0
    while True:
        start = text.find("<nowiki>", at)
        # a closing tag without an opening one before it is ordinary text that no pattern looks into
        limit = len(text) if start < 0 else start
        while (stray := text.find("</nowiki>", at, limit)) >= 0:
            out += [_raw(text[at:stray]), Piece("hidden", "</nowiki>")]
            at = stray + 9
        end = text.find("</nowiki>", start + 8) if start >= 0 else -1
        if end < 0:
            break
        out += [_raw(text[at:start]), Piece("hidden", text[start + 8 : end])]
        at = end + 9
    # openings that nothing closes part the text, but are shown
    for i, part in enumerate(text[at:].split("<nowiki>")):
        if i:
            out.append(Piece("hidden", "<nowiki>"))
        out.append(_raw(part))
    return [p for p in out if p.kind != "raw" or p.shown]


def _cut(pieces: list[Piece], pattern: re.Pattern[str], make: Callable[[str], Piece]) -> list[Piece]:
    out = []
    for p in pieces:
        if p.kind != "raw":
            out.append(p)
            continue
        at = 0
        for m in pattern.finditer(p.shown):
            if at < m.start():
                out.append(_raw(p.shown[at : m.start()]))
            out.append(make(m[0]))
            at = m.end()
        if at < len(p.shown):
            out.append(_raw(p.shown[at:]) if at else p)
    return out


class Reader:
    def __init__(self, strict: bool = False):
        self.strict = strict

    def parse(self, text: str) -> list[Piece]:
        """Top-level pieces, without sections."""
        pieces = _nowiki(text)
        for pattern, make in _CUTS:
            pieces = _cut(pieces, pattern, make)
        pieces = [Piece("text", p.shown.replace("&nbsp;", " ")) if p.kind == "raw" else p for p in pieces]
        return self._references(self._fold(pieces))

    def plain(self, text: str) -> str:
        return self._sections(self.parse(text))

    def _fold(self, pieces: list[Piece]) -> list[Piece]:
        out: list[Piece] = []
        opened: dict[str, list[int]] = {}
        for p in pieces:
            if p.kind == "close" and opened.get(p.name):
                at = opened[p.name][-1]
                closed = self._close(out[at], out[at + 1 :], p)
                del out[at:]
                for places in opened.values():
                    while places and places[-1] >= at:
                        places.pop()
                out.append(closed)
                continue
            if p.kind == "open":
                opened.setdefault(p.name, []).append(len(out))
            out.append(p)
        return out

    def _close(self, start: Piece, inner: list[Piece], end: Piece) -> Piece:
        if start.name == "header":
            low = min(start.level, end.level)
            return Piece("header", "=" * (start.level - low) + _shown(inner) + "=" * (end.level - low), level=low)
        if start.name == "template":
            name = start.shown[2:].rstrip("|")
            return Piece("template", self._template(name, inner), name)
        if start.name == "link":
            return self._link(inner)
        if start.name in ("ref", "table"):
            return Piece("hidden", "")
        text = _shown(inner)
        match start.name[4:]:
            case "blockquote":
                text = f"\n{self.plain(text)}\n"
            case "math":
                text = MATH_TOKEN
            case "sub":
                text = f"_{text}"
            case "sup":
                text = f"^{text}"
            case "em":
                pass
            case _ if self.strict:
                text = "{nil}"
        return Piece("hidden", text)

    def _link(self, inner: list[Piece]) -> Piece:
        if not inner:
            return Piece("text", "[[]]")
        target, bar, rest = _shown(inner).partition("|")
        name = target.strip()
        if not name:
            return Piece("text", f"[[{target}]]")
        if name.startswith("File:"):
            return Piece("hidden", self.plain(rest.split("|")[-1]) if bar else "")
        return Piece("link", rest.strip() or name, name)

    def _template(self, name: str, inner: list[Piece]) -> str:
        if name not in ("Blockquote", "IPAc-en", "IPA-de"):
            return ""
        given = self._arguments(inner)
        if name == "Blockquote":
            return f"\n{given.get('text', given.get('1', ''))}\n"
        if name == "IPA-de":
            before = "" if "2" not in given else "German: " if given["2"] == "lang" else "German pronunciation: "
            return f"{before}[{given.get('1', '')}]"
        sounds, n = "", 1
        while str(n) in given:
            sounds += given[str(n)] + (": /" if n == 1 else "")
            n += 1
        return sounds + "/"

    def _arguments(self, inner: list[Piece]) -> dict[str, str]:
        """Arguments end at bars in plain stretches and at the end of a last plain stretch; the value of ``a=b=c`` is
        ``b``; unnamed arguments are numbered."""
        given: dict[str, str] = {}
        held, unnamed = "", 0
        for i, p in enumerate(inner):
            parts = p.shown.split("|") if p.kind == "text" else [p.shown]
            ends = p.kind == "text" and (len(parts) > 1 or i == len(inner) - 1)
            for part in parts:
                held += part
                if ends:
                    name, value = (held.split("=") + [""])[:2] if "=" in held else ("", held)
                    if not name:
                        unnamed += 1
                        name = str(unnamed)
                    given[name] = self.plain(value)
                    held = ""
        return given

    @staticmethod
    def _references(pieces: list[Piece]) -> list[Piece]:
        """A reference list shows nothing, from its last opening template to its closing one."""
        out: list[Piece] = []
        begun: int | None = None
        for p in pieces:
            if p.kind == "template" and p.name == "refbegin":
                begun = len(out)
            out.append(p)
            if begun is not None and p.kind == "template" and p.name == "refend":
                del out[begun:]
                out.append(Piece("hidden", ""))
                begun = None
        return out

    @staticmethod
    def _sections(pieces: list[Piece]) -> str:
        """The rendering of pieces; a section that is not shown hides its subsections too."""
        shown, hidden = [], 0
        for p in pieces:
            if p.kind == "header":
                if hidden and p.level > hidden:
                    continue
                title = p.shown.strip()
                hidden = p.level if title in IGNORED_SECTIONS else 0
                if not hidden:
                    shown.append(title)
            elif not hidden:
                shown.append(p.shown)
        return "".join(shown)

    def links(self, text: str) -> list[tuple[str, str]]:
        """Target and outermost section of each link that stands in running text, in order, repeats kept. Targets have a
        capital first letter and no anchor; the section of links before the first heading is empty."""
        out, section, level = [], "", 7
        for p in self.parse(text):
            if p.kind == "header" and p.level <= level:
                section, level = p.shown, p.level
            elif p.kind == "link":
                out.append(((p.name[:1].upper() + p.name[1:]).split("#")[0], section))
        return out


_LINKS = ArrayType(StructType([StructField("target", StringType()), StructField("section", StringType())]))


@arrow_udf(StringType())
def _clean(texts: pa.Array) -> pa.Array:
    reader = Reader()
    return pa.array([None if t is None else reader.plain(t) for t in texts.to_pylist()], pa.string())


@arrow_udf(StringType())
def _clean_strict(texts: pa.Array) -> pa.Array:
    reader = Reader(strict=True)
    return pa.array([None if t is None else reader.plain(t) for t in texts.to_pylist()], pa.string())


@arrow_udf(_LINKS)
def _links(texts: pa.Array) -> pa.Array:
    reader = Reader()
    rows = [[] if not t else [{"target": a, "section": b} for a, b in reader.links(t)] for t in texts.to_pylist()]
    return pa.array(rows, pa.list_(pa.struct([("target", pa.string()), ("section", pa.string())])))


def clean_wikitext(text: Column, strict: bool = False) -> Column:
    """Plain text of wiki markup; null stays null."""
    return (_clean_strict if strict else _clean)(text)


def wikitext_links(text: Column) -> Column:
    """``array<struct<target, section>>``; null and empty texts have no links."""
    return _links(text)
