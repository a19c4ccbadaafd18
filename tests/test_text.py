import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesselark.functions import nlp, tagtree
from tesselark.functions.titles import wiki_title
from tesselark.functions.wikitext import Reader, clean_wikitext, wikitext_links
from tesselark.plans import rules

from .conftest import rows

WORDS = ["oak", "two words", "x1"]


@pytest.mark.parametrize("rule", rules.WIKITEXT)
def test_wikitext_rules(rule):
    for word in WORDS:
        for text, want in rules.WIKITEXT[rule]:
            assert Reader().plain(text.replace("@", word)).strip("\n") == want.replace("@", word), text


#: Openings and closings of constructs that show nothing, and of those that show what they hold.
HIDING = [("{{t|", "}}"), ("<ref>", "</ref>"), ("{|", "|}"), ("<!--", "-->")]
SHOWING = [("<em>", "</em>"), ("<i>", "</i>"), ("[[", "]]"), ("<nowiki>", "</nowiki>"), ("[[target|", "]]"), ("[https://a.example ", "]")]
PROSE = st.text("abc dé,.", min_size=1).map(lambda x: f"a{x}z")


@given(PROSE, PROSE, PROSE, st.sampled_from(HIDING))
def test_hiding_constructs_leave_no_trace(before, inner, after, marks):
    assert Reader().plain(before + marks[0] + inner + marks[1] + after) == before + after


@given(PROSE, PROSE, PROSE, st.sampled_from(SHOWING))
def test_showing_constructs_leave_what_they_hold(before, inner, after, marks):
    assert Reader().plain(before + marks[0] + inner + marks[1] + after) == before + inner + after


@given(PROSE, PROSE, st.sampled_from(HIDING + SHOWING[:4]))
def test_half_a_construct_is_text(before, after, marks):
    for half in marks:
        if half != "{{t|":  # bars that nothing opened stay, and so do these
            assert Reader().plain(before + half + after) == before + half + after


@given(st.lists(st.sampled_from(["{{a|", "}}", "[[", "]]", "{|", "|}", "<ref>", "</ref>", "<b>", "</b>", "==", "\n", "<nowiki>", "</nowiki>", "word", "|"]), max_size=30))
def test_any_mixture_of_marks_is_read(parts):
    text = "".join(parts)
    assert Reader().plain(text).count("word") <= text.count("word")
    assert all(target for target, _ in Reader().links(text))


def test_paired_tags_in_strict_mode():
    assert Reader(strict=True).plain("<u>a</u> <em>b</em> <small>c</small>") == "{nil} b {nil}"


def test_links_stand_in_running_text():
    for text, want in rules.LINKS:
        assert Reader().links(text.replace("@", "oak")) == want
    assert Reader().links("[[étude]] ==x [[no|y]]\n") == [("Étude", ""), ("No", "")]


def test_deep_and_long_markup_is_linear():
    assert Reader().plain("]]" * 20_000) == "]]" * 20_000
    assert Reader().plain("{{a|" * 150 + "x" + "}}" * 150) == ""
    assert len(Reader().plain("word " * 50_000)) == 250_000


def test_wikitext_columns(spark):
    df = spark.createDataFrame([(1, "[[A|b]]"), (2, None), (3, "")], "id long, text string")
    assert rows(df.select("id", clean_wikitext(F.col("text")))) == [(1, "b"), (2, None), (3, "")]
    assert [r[0] for r in df.orderBy("id").select(F.size(wikitext_links(F.col("text")))).collect()] == [1, 0, 0]


@pytest.mark.parametrize("rule", rules.TAGS)
def test_category_tag_rules(rule):
    for word in ("oak", "two words"):
        for title, category, want in rules.TAGS[rule]:
            assert tagtree.disambiguate(title.replace("@", word), category.replace("@", word)) == want.replace("@", word), category


@given(st.integers(1, 9999))
def test_centuries_and_ordinals_of_years(year):
    number = (year + 99) // 100
    assert tagtree.evaluate(f"{{{{century from year|{year}}}}}", "") == f"{tagtree.ordinal(number)} century"
    assert tagtree.ordinal(number).startswith(str(number)) and tagtree.ordinal(number)[-2:] in ("st", "nd", "rd", "th")
    assert tagtree.evaluate(f"{{{{#expr:{year}+{number}}}}}", "") == str(year + number)


@given(st.lists(st.sampled_from(["{{", "}}", "title year", "|", "decade", "x"]), max_size=12))
def test_braces_pair_up_or_the_name_stays(parts):
    text = "".join(parts)
    got = tagtree.evaluate(text, "In 1850")
    if text.count("{{") == 0 and text.count("}}") == 0:
        assert got == text
    assert isinstance(got, str)


def test_words_and_normal_articles(spark):
    df = spark.createDataFrame([("don't 'quote' ' it_s é12 x-y",), ("In 1,234.5 and 12% on 3 may 1999, May 4, 2000; 7 é12",), ("",), (None,)], "text string")
    got = [r[0] for r in df.select(nlp.words(F.col("text"))).collect()]
    assert got == [["don't", "quote", "it_s", "12", "x", "y"], ["In", "1", "234", "5", "and", "12", "on", "3", "may", "1999", "May", "4", "2000", "7", "12"], [], None]
    assert df.select(nlp.normal_article(F.col("text"))).collect()[1][0] == "in _num_ and _percent_ on _date_, _date_; _num_ é_num_"
    assert [tuple(x) for x in df.select(nlp.pairs(nlp.words(F.col("text")))).first()[0]][:2] == [("don't", "quote"), ("quote", "it_s")]


def brute_tokens(words, known):
    """The longest chain of known prefixes from each place on, found by trying."""
    out, at = [], 0
    while at < len(words):
        n = 1
        while at + n < len(words) and " ".join(words[at : at + n + 1]) in known:
            n += 1
        out.append(" ".join(words[at : at + n]))
        at += n
    return out


@given(st.lists(st.lists(st.sampled_from("pqr"), max_size=9), max_size=4), st.sets(st.lists(st.sampled_from("pqr"), min_size=2, max_size=4).map(" ".join)))
def test_ngram_tokens_equal_brute_force(texts, known):
    tree = nlp.PhraseTree(known)
    flat = [w for t in texts for w in t]
    ends = np.cumsum([0, *map(len, texts)])
    tokens, offsets = tree.tokens(pa.array(flat, pa.string()), ends)
    got = tokens.to_pylist()
    assert [got[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [brute_tokens(t, known) for t in texts]


def test_ngram_token_columns(spark):
    df = spark.createDataFrame([(["a", "b", "a", "b", "c"],), (None,), ([],)], "words array<string>")
    assert [r[0] for r in df.select(nlp.ngram_tokens(spark, ["a b", "a b a"])(F.col("words"))).collect()] == [["a b a", "b", "c"], None, []]
    phrases = spark.createDataFrame([("m n o",)], "text string")
    assert rows(phrases.select(F.explode(nlp.prefixes(F.col("text"))))) == [("m n o",), ("m n",), ("m",)]


def test_titles(spark):
    data = ["a_b", " A  b", "a b#C", "éa", "‎a b", None, "", "#x", "_"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in data], "t string").select(wiki_title("t")).collect()]
    assert got == ["A b", "A b", "A b", "Éa", "A b", None, None, None, None]
