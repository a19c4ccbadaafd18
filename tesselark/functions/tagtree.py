"""Category names with template tags such as ``{{title year}}``, evaluated against the title of their page."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

from tesselark.functions.fixed import CONTINENT_OF, CONTINENTALS, COUNTRIES, NATIONALITY_OF

#: What stands in for tags that cannot be evaluated.
UNEQUAL_BRACES = "different number of open and close braces"
CURRENT_YEAR = "2021"
MONTHS = "january february march april may june july august september october november december".split()

_BRACE = re.compile(r"\{\{|\}\}")
_FOUND = {
    "title year": (re.compile(r"\b\d{3,4}\b", re.A), "<YEAR NOT FOUND>", "<MULTIPLE YEARS FOUND>"),
    "title year range": (re.compile(r"\d{4}–\d{2,4}", re.A), "<YEAR RANGE NOT FOUND>", "<MULTIPLE YEAR RANGES FOUND>"),
    "title monthname": (re.compile("|".join(MONTHS), re.I), "<MONTH NOT FOUND>", "<MULTIPLE MONTHS FOUND>"),
    "title country": (re.compile(r"\b(?:" + "|".join([*COUNTRIES, *CONTINENTALS]) + r")\b", re.I | re.A), "<COUNTRY NOT FOUND>", "<MULTIPLE COUNTRIES FOUND>"),
    "title decade": (re.compile(r"\d{2,3}0", re.A), "<DECADE NOT FOUND>", "<MULTIPLE DECADES FOUND>"),
    "title century": (re.compile(r"\d+(?=(?:st|nd|rd|th)[- ]century)", re.I | re.A), "<CENTURY NOT FOUND>", "<MULTIPLE CENTURIES FOUND>"),
}


def _found(tag: str, title: str) -> str:
    pattern, none, many = _FOUND[tag]
    hits = [m[0] for m in pattern.finditer(title)]
    return hits[0] if len(hits) == 1 else many if hits else none


def _number(text: str, bits: int = 64) -> int | None:
    return int(text) if re.fullmatch(r"[0-9]+", text) and int(text) < 1 << bits else None


def ordinal(n: int) -> str:
    ending = "th" if n % 100 // 10 == 1 else {1: "st", 2: "nd", 3: "rd"}.get(n % 10, "th")
    return f"{n}{ending}"


def century(year: str, of_decade: bool, dash: bool) -> str:
    of_decade = of_decade or year.endswith("s")
    n = _number(year.removesuffix("s") if of_decade else year, 16)
    if n is None:
        return "<UNABLE TO PARSE DECADE>" if of_decade else "<UNABLE TO PARSE YEAR>"
    return ordinal(n // 100 + 1 if of_decade else -(-n // 100)) + ("-century" if dash else " century")


def expression(text: str) -> str:
    """One sum or difference of unsigned numbers; differences wrap around at 64 bits; anything else stays as it is."""
    text = text.replace(" ", "")
    for sign, word in (("+", "PLUS"), ("-", "MINUS")):
        hits = re.findall(rf"([0-9]+)\{sign}([0-9]+)", text)
        if len(hits) > 1:
            return f"<MULTIPLE {word} EXPRESSIONS>"
        if hits:
            left, right = (_number(x) for x in hits[0])
            if left is None or right is None:
                return f"<UNABLE TO PARSE EXPRESSION {'LEFT' if left is None else 'RIGHT'}>"
            return str((left + right if sign == "+" else left - right) % (1 << 64))
    return text


def _continent(country: str) -> str:
    country = country.strip("*[]")
    return CONTINENT_OF.get(country, f'<MISSING COUNTRY CONTINENT "{country}">')


def _ordinal_of(text: str) -> str:
    n = _number(text)
    return "<UNABLE TO PARSE CENTURY>" if n is None else ordinal(n)


def _month_number(text: str) -> str:
    return str(MONTHS.index(text.lower()) + 1) if text.lower() in MONTHS else "<MONTH NUMBER NOT FOUND>"


#: Tags of one value: what a missing value reads as, and what the tag makes of it.
_UNARY: dict[str, tuple[str, Callable[[str], str]]] = {
    "country2continent": ("<MISSING COUNTRY2CONTINENT NODE>", _continent),
    "country2nationality": ("<MISSING COUNTRY2CONTINENT NODE>", lambda v: NATIONALITY_OF.get(v, "<MISSING COUNTRY NATIONALITY>")),
    "continent2continental": ("<MISSING CONTINENT NODE>", lambda v: CONTINENTALS.get(v, "<MISSING CONTINENTAL>")),
    "country2continental": ("<MISSING CONTINENT NODE>", lambda v: CONTINENTALS.get(_continent(v), "<MISSING CONTINENTAL>")),
    "decade": ("<MISSING DECADE NODE>", lambda v: v[:-1] + "0s" if v else "<MISSING DECADE>"),
    "month": ("<MISSING MONTH NODE>", lambda v: v),
    "ordinal": ("<MISSING ORDINAL NODE>", _ordinal_of),
    "monthnumber": ("<MISSING MONTH NUMBER NODE>", _month_number),
    "first word": ("<MISSING FIRST WORD NODE>", lambda v: v.split(" ")[0]),
    "last word": ("<MISSING LAST WORD NODE>", lambda v: v.split(" ")[-1]),
}


def _tag(inner: str, title: str) -> str:
    inner = inner.removeprefix("{{").removesuffix("}}").strip()
    if inner.startswith("#expr:"):
        return expression(evaluate(inner[6:], title))
    parts = inner.split("|")
    name, dash = parts[0].strip().lower(), parts[-1] == "dash"
    if name in _FOUND:
        return _found(name, title)
    if name in _UNARY:
        missing, make = _UNARY[name]
        return make(evaluate(parts[1], title) if len(parts) > 1 else missing)
    match name:
        case "century from year" | "century name from decade or year":
            if len(parts) == 1:
                return century("<MISSING CENTURY NODE>", False, dash)
            decade = re.fullmatch(r"\{\{\s*title decade\s*(?:\|.*)?\}\}", parts[1], re.I | re.S) is not None
            return century(evaluate(parts[1], title), decade, dash)
        case "century name from title year":
            return century(_found("title year", title), False, dash)
        case "century name from title decade":
            return century(_found("title decade", title), True, dash)
        case "pagename":
            return title.removeprefix("Category:")
        case "currentyear":
            return CURRENT_YEAR
        case "title year+1" | "title year-1":
            return expression(_found("title year", title) + name[-2:])
    return inner


def evaluate(category: str, title: str) -> str:
    """A category name with its tags replaced, from the outermost inwards. Braces that do not pair up make the name
    :data:`UNEQUAL_BRACES` if there are more of one sort, and else leave it as it is."""
    braces = list(_BRACE.finditer(category))
    if not braces:
        return category
    if 2 * sum(m[0] == "{{" for m in braces) != len(braces):
        return UNEQUAL_BRACES
    out, depth, at = [], 0, 0
    for m in braces:
        if m[0] == "{{":
            if not depth:
                out.append(category[at : m.start()])
                at = m.start()
            depth += 1
        else:
            depth -= 1
            if depth < 0:
                return category
            if not depth:
                out.append(_tag(category[at : m.end()], title))
                at = m.end()
    return "".join([*out, category[at:]])


_CLEANUP = [("_", " "), (re.compile(r"[\t\n\f\r ]+"), " "), ("&ndash;", "–"), (re.compile("[‎‪‬]"), ""), (re.compile(r"<!--[^>]+-->"), ""), ("{{!}}", "|")]


def disambiguate(title: str, category: str) -> str:
    for what, by in _CLEANUP:
        category = category.replace(what, by) if isinstance(what, str) else what.sub(by, category)
    return evaluate(category, title)


@arrow_udf(StringType())
def _evaluate(titles: pa.Array, categories: pa.Array) -> pa.Array:
    return pa.array([None if c is None else disambiguate(t or "", c) for t, c in zip(titles.to_pylist(), categories.to_pylist(), strict=True)], pa.string())


def category_name(title: Column, category: Column) -> Column:
    """The category name that a page with this title means; null categories stay null."""
    return _evaluate(title, category)
