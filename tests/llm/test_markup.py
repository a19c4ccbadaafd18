import math
import time

import pytest

from tesselark.llm import markup

from ..conftest import rows

KINDS = [
    ("== History ==\ntext", {"heading"}), ("=== ''Reception'' ===", {"heading", "other"}), ("# Alone\n\ntext", {"heading"}), ("Title\n=====", {"heading"}), ("Title\n-----\n\nx", {"heading"}),
    ("<h2>A</h2>", {"heading"}), ("<h3 id=\"s\" class='sub'>A</h3>", {"heading"}), ("\\section{A}", {"heading"}), ("\\subsection*{A}\n\\begin{enumerate}\n\\item x\n\\end{enumerate}", {"heading", "list"}),
    ("# one\n# two", {"list"}), ("* a\n** b", {"list"}), ("+ a\n  + b", {"list"}), ("1. a\n2. b", {"list"}), ("1) a, with $x > 0$\n2) b", {"list", "formula"}), ("<OL><LI>A<LI>B</OL>", {"list"}), ("\\begin{itemize}\n\\item a\n\\end{itemize}", {"list"}),
    ("```\n# x\n* y [[z]]\n```", {"code"}), ("~~~yaml\n- a: b\n~~~", {"code"}), ("<pre><code>a &gt; b</code></pre>", {"code"}), ('<syntaxhighlight lang="c">\n* p = 0;\n</syntaxhighlight>', {"code"}), ("\\begin{verbatim}\n[[x]]\n\\end{verbatim}", {"code"}), ("\\begin{lstlisting}[language=R]\n# a <- b\n\\end{lstlisting}", {"code"}),
    ("$$\na_1\n$$", {"formula"}), ("it is $$ a / b $$ then", {"formula"}), ("$x_{1}$ holds", {"formula"}), ("\\( a \\), \\[ b \\]", {"formula"}), ('<math display="block">\\bar{s}</math>', {"formula"}), ("\\begin{align*}\na &= b \\\\\n\\end{align*}", {"formula"}), ("<math><mi>p</mi></math>", {"formula"}),
    ("[[a|b]]", {"other"}), ("a [[unclosed|link", {"other"}), ("'''b''' is ''i''", {"other"}), ("**b** and *i*", {"other"}), ("a `code` b", {"other"}), ("{{t|x=1", {"other"}), ("{| border=1\n|-\n| a || <math>p</math>\n|}", {"other", "formula"}), ("| a | b |\n|---|---|\n| c | d |", {"other"}),
    ("x<ref name=\"n\">y</ref>", {"other"}), ("<!-- c -->", {"other"}), ("> quoted\n> text", {"other"}), ("![a](b.png)", {"other"}), ("[a](https://b.example/c)", {"other"}), ("[https://b.example/c label]", {"other"}), ("a &amp; b", {"other"}), ("&lt;small&gt;", {"other"}), ("<b>unclosed", {"other"}), ("\\emph{x} \\cite{y}", {"other"}), ("<nowiki>== A ==</nowiki>", {"other"}), ("[[Category:X]]", {"other"}),
]
PROSE = [
    "The result, 5 * 3 * 2, is it.", "2 ** 3 is read as eight, x == y", "rated **** of five", "ranked #3 among", "The set {1, 2, 3} has", "cost $5 in 1354 and $12 later.", "aged <18 and >65", "R&D office", "a < b and c > d", "40° 12' 30'' N, not far", "C:\\data\\files and\\or",
    "ha`rvest", "40 <-> 60", "E = mc2", "[1911] is a guess; (sic) and [sic]", "10^6 was | not", "theorem_id", "C# and F#", "https://a.example/b for now", "– That, they said", "only one - so far - and", "ratio ~4 : 1", "", "\n", " ", "In 1979. Then",
]


@pytest.mark.parametrize("text, want", KINDS)
def test_kinds(text, want):
    assert markup.kinds(text) == want
    assert markup.kinds(f"Prose before.\n\n{text}\n\nProse behind.") == want


@pytest.mark.parametrize("text", PROSE)
def test_signs_in_prose_are_no_markup(text):
    assert markup.kinds(text) == set()
    assert markup.render(text).strip() == text.strip()


def test_rendering_keeps_structure():
    text = "== A ==\nSome '''bold''' [[x|text]]{{t}}<ref>r</ref> &amp; $a_1$.\n\n* one\n** two\n\n# p\n# q\n\n```\n# code [[x]]\n```\n\n<h3>B</h3>\n<p>para</p>\n\\section{C}\n\\begin{itemize}\n\\item i\n\\end{itemize}\n<!-- gone --> <nowiki>[[kept]]</nowiki>"
    out = markup.render(text)
    for piece in ("## A", "Some bold text & $a_1$.", "- one\n  - two", "1. p\n1. q", "```\n# code [[x]]\n```", "### B", "para", "## C", "- i", "[[kept]]"):
        assert piece in out, piece
    for gone in ("'''", "{{", "<ref", "<!--", "\\item", "<p>", "&amp;"):
        assert gone not in out


def test_style_tree_removes_what_stands_on_every_page(spark):
    notice = '<div class="n">Please help to improve this page of ours</div>'
    data = [(i, f"Page {i} has words of its own.\n\n> a quote of page {i}\n\n> Shared notice of the site", f"h{i % 2}", "p") for i in range(80)]
    df = spark.createDataFrame([*data, (900, None, "h0", "p"), (901, "", "h0", "p"), (902, notice, None, "p"), data[3]], "id long, text string, host string, page string")
    got = {r.id: r.text for r in markup.clean_pages(df, host="host").collect()}
    assert got[5] == "Page 5 has words of its own.\n\na quote of page 5" and got[900] is None and got[901] == ""
    contents, shapes = markup.style_tree(markup.dom_nodes(df, host="host"))
    tree = {(r.host, r.path, r.pages): r.importance for r in contents.where("path = 'quote'").collect()}
    assert tree["h0", "quote", 40] == 0.0 and tree["h0", "quote", 1] == 1.0
    assert {(r.host, r.path): r.entropy for r in shapes.where("host = ''").collect()} == {("", "tag/div"): 1.0}


def test_entropy_of_arrangements_and_importance_from_the_leaves_upwards(spark):
    """Boxes arranged alike everywhere whose parts are the same go; with parts of their own, or other arrangements, they stay."""
    same, own = "<div><p>Home</p><p>Imprint</p></div>", "<div><p>Alpha {i}</p><p>Beta {i}</p></div>"
    data = [(i, f"Text {i}.\n\n{same}\n\n" + f"<section>{'<p>Menu</p>' * (i % 4 + 1)}<p>own {i}</p></section>\n\n" + own.format(i=i).replace("div", "main")) for i in range(64)]
    df = spark.createDataFrame(data, "id long, text string")
    contents, shapes = markup.style_tree(markup.dom_nodes(df))
    entropy = {r.path: r.entropy for r in shapes.collect()}
    assert entropy["tag/div"] == 0.0 and entropy["tag/main"] == 0.0
    assert abs(entropy["tag/section"] - math.log(4) / math.log(64)) < 1e-9
    got = {r.id: r.text for r in markup.clean_pages(df).collect()}
    assert got[5] == "Text 5.\n\nown 5\n\nAlpha 5\nBeta 5"
    text = data[5][1]
    numbers = {b.path: n for n, b in enumerate(markup.tree(text))}
    assert markup.kept_text(text, {}, {}) == frozenset() and markup.kept_text(text, {numbers["tag/div>tag/p>text"]: 0.0}, {}) >= {numbers["tag/div>tag/p>text"]}


def test_line_ends_of_windows_do_not_matter(spark):
    page = "Text {i} here.\n\n<b>menu</b> x\n\n> Shared notice\n\n== A ==\nmore {i}"
    data = [(i, page.format(i=i).replace("\n", "\r\n" if i % 2 else "\n")) for i in range(40)]
    df = spark.createDataFrame(data, "id long, text string")
    assert {r.id: r.text for r in markup.clean_pages(df).collect()} == {i: f"Text {i} here.\n\n## A\nmore {i}" for i in range(40)}


def test_any_depth_and_open_marks():
    deep = "x " + "{{quote|" * 500 + "deep" + "}}" * 500 + " y"
    assert markup.render(deep) == "x deep y"
    assert markup.render("x {{a|{{b|{{c|{{d|{{e|{{f|deep}}}}}}}}}}}} y") == "x  y"
    assert markup.render("[[a|[[b|[[c|[[d|[[e|inner]]]]]]]]]]") == "inner"
    assert markup.render("{{unclosed [[Foo]] rest of sentence\nnext") == "unclosed Foo rest of sentence\nnext"
    assert markup.render("a {{cite|x=1\nnext") == "a \nnext".replace(" \n", "\n") and markup.render("a [[b|c\nnext") == "a c\nnext"
    assert markup.render("}} and ]] stay") == "}} and ]] stay"
    start = time.perf_counter()
    markup.render("{{a|" * 100_000)
    assert time.perf_counter() - start < 30


def test_headings_side_by_side_are_no_list():
    assert markup.render("# a\n# b\n== H ==\ntext") == "1. a\n1. b\n## H\ntext"
    assert markup.render("== A ==\n=== B ===\ntext") == "## A\n### B\ntext"
    assert markup.render("<h1>A</h1>\n<h2>B</h2>") == "# A\n\n## B"


def test_marks_are_nodes_of_the_tree():
    text = "<div>a [[b]]\n\n* c\n\n</div>\n\n$x$ and &amp;"
    assert markup.marked_paths(text) == {"tag/div>other:tag/div", "tag/div>other:link", "tag/div>list:list/item", ">formula:formula", ">other:entity"}


def test_marks_that_stand_on_every_page_stay_whole(spark):
    page = "Page {i} is on [[basin {i}|its basin]] &amp; {{{{convert|{i}|km}}}}, \\emph{{word {i}}}<ref>note {i}\n\nof two parts</ref>.\n\n{{|\n|-\n| cell {i} || yes\n|}}\n\n<div class=\"n{i}\">Please help with this page.</div>\n\nText {i} from [[every page]].\n\nShared [[notice]] of the site.\n\n* every page"
    df = spark.createDataFrame([(i, page.format(i=i)) for i in range(60)], "id long, text string")
    want = "Page {i} is on its basin & {i} km, word {i}.\n\ncell {i} | yes\n\nText {i} from every page.\n\n- every page"
    assert {r.id: r.text for r in markup.clean_pages(df).collect()} == {i: want.format(i=i) for i in range(60)}


def test_branches_span_their_marks_and_nest():
    text = "<div><p>a {{t\n\n|x}}</p>\n\nb [[c]]</div>\n\n{|\n| {{d}}\n|}\n\n> e\n> f\n\n<p>g\n\n&amp;\n\n[[h"
    got = [(b.path, text[b.start : b.end]) for b in markup.tree(text) if b.judged]
    assert got == [
        ("tag/div", text[: text.index("</div>") + 6]), ("tag/div>tag/p", "<p>a {{t\n\n|x}}</p>"), ("tag/div>tag/p>text", "a {{t\n\n|x}}"), ("tag/div>text", "b [[c]]"),
        ("table", "{|\n| {{d}}\n|}"), ("quote", "> e\n> f"), ("tag/p", "<p>g"), ("tag/p>text", "g"), ("link", "[[h"),
    ]


def test_found(spark):
    df = spark.createDataFrame([(1, "[[a]]", 1), (1, "[[a]]", 1), (2, None, 1), (3, "", 1), (4, "x " * 100_000 + "''i''", 1), (None, "[[a]]", 1), (5, "a\r\n\r\nT\r\n===\r\n", 1)], "id long, text string, markup_kind int")
    assert rows(markup.found_kinds(df)) == [(1, "other"), (4, "other"), (5, "heading")]
    assert rows(markup.found_kinds(df.where("false"))) == [] and rows(markup.clean_pages(df.where("false"))) == []
