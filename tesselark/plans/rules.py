"""The rules of wiki markup and of category tags, each with a text it applies to and what comes out.

``@`` stands for words of a table (names of parts, in the queries), so that each rule runs over a whole table. The rules are
made per construct: closed, nested in itself and in others, left open, closed without an opening, crossing, and at the borders
of the text.
"""

from __future__ import annotations

#: Construct -> texts and their plain form.
WIKITEXT: dict[str, list[tuple[str, str]]] = {
    "nowiki": [
        ("<nowiki>''[[@]]'' {{@}}</nowiki>", "''[[@]]'' {{@}}"),
        ("left <nowiki>== @ ==</nowiki> right", "left == @ == right"),
        ("@<nowiki/> and <nowiki />@", "@ and @"),
        ("@ <nowiki>is left open with [[@|a link]]", "@ <nowiki>is left open with a link"),
        ("@</nowiki> was never opened", "@</nowiki> was never opened"),
        ("<nowiki>@<nowiki>@</nowiki> twice", "@<nowiki>@ twice"),
    ],
    "headers": [
        ("before\n== @ ==\nafter", "before\n@\nafter"),
        ("====@====", "@"),
        ("====@==", "==@"),
        ("==@====", "@=="),
        ("== [[wood|timber]] of @ ==", "timber of @"),
        ("a == @ == b", "a == @ == b"),
        ("========@========", "==@=="),
    ],
    "templates": [
        ("{{infobox|name=@|size=3}}@", "@"),
        ("a {{b|c {{d|@}} e}} f", "a  f"),
        ("@ {{cite open", "@ {{cite open"),
        ("closed only }} @", "closed only }} @"),
        ("{{a|[[@|x]]}} y", " y"),
        ("{{ }}@", "@"),
    ],
    "rendered templates": [
        ("{{Blockquote|@}}", "@"),
        ("{{Blockquote|author=someone|text=spoken by @}}", "spoken by @"),
        ("{{Blockquote|see [[@]], now}}", "see @, now"),
        ("{{IPA-de|@|lang}}", "German: [@]"),
        ("{{IPA-de|@|pron}}", "German pronunciation: [@]"),
        ("{{IPA-de|@}}", "[@]"),
        ("{{IPAc-en|US|@|z}}", "US: /@z/"),
    ],
    "references": [
        ("@<ref>{{cite|x}} [[y]]</ref>.", "@."),
        ('@<ref name="k"/>, <ref group=n name=k />', "@, "),
        ('<ref name="k">said @</ref>end', "end"),
        ("<ref name=k>said</ref>@", "@"),
        ("@<ref>left open", "@<ref>left open"),
        ("@</ref> never opened", "@</ref> never opened"),
    ],
    "links": [
        ("[[@]]s", "@s"),
        ("[[wood#Oak|@]]", "@"),
        ("[[ @ | the @ ]]", "the @"),
        ("[[|@]] and [[]]", "[[]] and [[]]"),
        ("[[@", "[[@"),
        ("@]]", "@]]"),
        ("[[@|a [[b]] c]]", "a b c"),
    ],
    "captions": [
        ("[[File:x.jpg|thumb|left|A @ by [[y|z]].]]", "A @ by z."),
        ("@[[File:x.jpg]]", "@"),
        ("[[File:x.jpg|@<ref>no</ref>]]", "@"),
    ],
    "external links": [
        ("[https://x.example/a?b=c the @] site", "the @ site"),
        ("[http://x.example @]", "@"),
        ("[https://x.example] @", "[https://x.example] @"),
        ("https://x.example @", "https://x.example @"),
    ],
    "comments": [
        ("<!-- @ -->a", "a"),
        ("a<!-- b <i> c > d -->@", "a@"),
        ("a <!-- left open @", "a <!-- left open @"),
        ("a --> @", "a --> @"),
        ("<!--a--><!--b-->@", "@"),
    ],
    "tables": [
        ("{| border\n|-\n| @ || b\n|}\nrest", "rest"),
        ("{| a {| @ |} b |}c", "c"),
        ("{| left open @", "{| left open @"),
        ("closed only |} @", "closed only |} @"),
    ],
    "tags": [
        ("<blockquote>@ said</blockquote>", "@ said"),
        ("<em>@</em>", "@"),
        ("v<sub>@</sub>", "v_@"),
        ("v<sup>@</sup>", "v^@"),
        ("<math>\\sqrt{@}</math> holds", "_math_ holds"),
        ("<i>so</i> <b>@</b>", "so @"),
        ("<ul><li>@</li></ul>", "@"),
        ("<b>@", "<b>@"),
        ("@</b>", "@</b>"),
        ("<unknown>@</unknown>", "<unknown>@</unknown>"),
        ("<sub><sup>@</sup></sub>", "_^@"),
        ("<span id=x>@</span>", "<span id=x>@</span>"),
    ],
    "spaces": [("@&nbsp;@&nbsp;", "@ @ "), ("<nowiki>@&nbsp;</nowiki>", "@&nbsp;")],
    "reference lists": [
        ("a {{refbegin}}@{{refend}} b", "a  b"),
        ("a {{refbegin|2}}\n[[@]]\n{{refend}}", "a "),
        ("a {{refbegin}} b @", "a  b @"),
        ("a {{refend}} @", "a  @"),
        ("{{refbegin}}x{{refbegin}}@{{refend}}", "x"),
    ],
    "crossing": [
        ("{{a|[[b}}@", "@"),
        ("[[a{{b|]]@", "a{{b@"),
        ("<b>{{c|</b>@}}", "{{c|@}}"),
        ("{| a [[@|} b ]]", " b ]]"),
    ],
    "sections": [
        ("== Life ==\nborn\n=== Work ===\n@", "Life\nborn\nWork\n@"),
        ("==Life==\n@\n==See also==\nhidden\n===Books===\nhidden too", "Life\n@"),
        ("==Sources==\nhidden\n==Legacy==\n@", "Legacy\n@"),
        ("===Notes===\nhidden\n==Legacy==\n@", "Legacy\n@"),
        ("==References==\nhidden\n===@===\nhidden", ""),
    ],
}

#: Texts and the links in their running text, with the section each stands in.
LINKS: list[tuple[str, list[tuple[str, str]]]] = [
    ("[[wood]] of [[stone#Kinds|@]]", [("Wood", ""), ("Stone", "")]),
    ("{{box|[[no]]}}<ref>[[no]]</ref>{| [[no]] |} [[yes]]", [("Yes", "")]),
    ("[[]] [[ ]] [[  ash  |@]]", [("Ash", "")]),
    ("==A==\n[[b]]\n===C===\n[[d]]\n==E==\n[[b]]", [("B", "A"), ("D", "A"), ("B", "E")]),
    ("[[Category:Trees|@]] [[elm]]", [("Category:Trees", ""), ("Elm", "")]),
]

#: Titles, category names and what these mean on a page with the title. ``@`` as above; it holds no digits.
TAGS: dict[str, list[tuple[str, str, str]]] = {
    "braces": [
        ("@", "@s of the world", "@s of the world"),
        ("@", "{{@", "different number of open and close braces"),
        ("@", "}}@{{", "}}@{{"),
        ("@", "{{title year}}}} {{", "{{title year}}}} {{"),
    ],
    "years": [
        ("Floods of 1771", "{{title year}} in @", "1771 in @"),
        ("Floods", "{{TITLE YEAR}}", "<YEAR NOT FOUND>"),
        ("1771 and 1772", "{{Title Year}}", "<MULTIPLE YEARS FOUND>"),
        ("The 1987–88 winter", "{{title year range}} of @", "1987–88 of @"),
        ("A winter", "{{title year range}}", "<YEAR RANGE NOT FOUND>"),
        ("Floods of 1771", "{{title year+1}}/{{title year-1}}", "1772/1770"),
        ("@", "{{CURRENTYEAR}}", "2021"),
    ],
    "decades": [
        ("@ in the 1840s", "{{title decade}}", "1840"),
        ("Floods of 1771", "{{decade|{{title year}}}}", "1770s"),
        ("@", "{{decade|}}", "<MISSING DECADE>"),
        ("@", "{{title decade}}", "<DECADE NOT FOUND>"),
    ],
    "centuries": [
        ("@ of 1800", "{{century name from title year}}", "18th century"),
        ("@ of 1801", "{{century name from title year|dash}} @", "19th-century @"),
        ("the 1800s", "{{century name from title decade}}", "19th century"),
        ("the 1800s", "{{century name from decade or year|{{title decade}}}}", "19th century"),
        ("@", "{{century from year|1205}}", "13th century"),
        ("@", "{{century from year|x}}", "<UNABLE TO PARSE YEAR>"),
        ("@", "{{century from year}}", "<UNABLE TO PARSE YEAR>"),
        ("@", "{{century name from decade or year|210s}}", "3rd century"),
    ],
    "ordinals": [
        ("12th-century @", "{{ordinal|{{title century}}}}", "12th"),
        ("@ of the 3rd century", "{{title century}}", "3"),
        ("@", "{{title century}}", "<CENTURY NOT FOUND>"),
        ("@", "{{ordinal|101}} {{ordinal|111}} {{ordinal|22}} {{ordinal|33}}", "101st 111th 22nd 33rd"),
        ("@", "{{ordinal|x}}", "<UNABLE TO PARSE CENTURY>"),
    ],
    "months": [
        ("@ of July 1907", "{{title monthname}} {{title year}}", "July 1907"),
        ("@ of July 1907", "{{monthnumber|{{title monthname}}}}", "7"),
        ("@", "{{month|July}}", "July"),
        ("@", "{{monthnumber|Smarch}}", "<MONTH NUMBER NOT FOUND>"),
        ("May or June", "{{title monthname}}", "<MULTIPLE MONTHS FOUND>"),
    ],
    "countries": [
        ("Rivers of Norway", "@ in {{title country}}", "@ in Norway"),
        ("Rivers", "{{title country}}", "<COUNTRY NOT FOUND>"),
        ("From Norway to Chad", "{{title country}}", "<MULTIPLE COUNTRIES FOUND>"),
        ("Rivers of Europe", "{{title country}}", "Europe"),
    ],
    "continents": [
        ("Rivers of Kenya", "{{country2continent|{{title country}}}}", "Africa"),
        ("Rivers of Norway", "{{country2continent|{{title country}}}}", '<MISSING COUNTRY CONTINENT "Norway">'),
        ("Rivers of Kenya", "{{country2continental|{{title country}}}} @", "african @"),
        ("@", "{{continent2continental|Oceania}}", "oceanic"),
        ("@", "{{continent2continental|Atlantis}}", "<MISSING CONTINENTAL>"),
    ],
    "nationalities": [
        ("Rivers of Denmark", "{{country2nationality|{{title country}}}} @", "Danish @"),
        ("@", "{{country2nationality|Norway}}", "<MISSING COUNTRY NATIONALITY>"),
    ],
    "expressions": [
        ("@", "{{#expr: 40 + 2}} @", "42 @"),
        ("@", "{{#expr:9-4}}", "5"),
        ("@", "{{#expr:1-2}}", "18446744073709551615"),
        ("@", "{{#expr:1+2, 3+4}}", "<MULTIPLE PLUS EXPRESSIONS>"),
        ("Floods of 1771", "{{#expr:{{title year}}+100}}", "1871"),
        ("@", "{{#expr:x}}", "x"),
    ],
    "words": [
        ("Category:Wide @ here", "{{first word|{{PAGENAME}}}}-{{last word|{{PAGENAME}}}}", "Wide-here"),
        ("@", "{{first word}}", "<MISSING"),
        ("Category:@", "{{pagename}}", "@"),
        ("@", "{{no such tag|@}}", "no such tag|@"),
    ],
    "cleanup": [
        ("@ of 1771", "a_b &ndash;  {{title_year}}{{!}}c<!-- d -->", "a b – 1771|c"),
        ("@", "a\t\n b", "a b"),
    ],
}


def sql_text(text: str) -> str:
    """A text as a literal of SQL."""
    return "'" + text.replace("'", "''") + "'"


def sql_table(rows: list[tuple[str, ...]], columns: str) -> str:
    """Rows as a table of SQL, every value a text."""
    return "(VALUES " + ", ".join("(" + ", ".join(sql_text(x) for x in r) + ")" for r in rows) + f") AS rules({columns})"
