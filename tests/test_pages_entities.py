import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tesselark.functions import distributions, nlp
from tesselark.operators import categories, classify, entities, pages, words
from tesselark.plans import registry

from .conftest import rows
from .test_text import brute_tokens


def test_redirects(spark):
    targets = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "Article"), ("self", "self"), ("x", "y"), ("y", "x"), ("z", "x"), ("Article2", "a"), ("lost", "nowhere")] + [(f"n{i}", f"n{i + 1}") for i in range(50)], "title string, redirect string")
    titles = spark.createDataFrame([("Article",), ("Article2",)], "title string")
    got = {r.title: (r.destination, r.hops) for r in pages.resolve_redirects(targets, titles).collect()}
    assert got["a"] == ("Article", 3) and got["c"] == ("Article", 1) and got["self"] == ("self", 0) and got["Article2"] == ("Article2", 0)
    assert got["x"] == got["y"] == got["z"] == (None, None) and got["lost"] == ("nowhere", 1) and got["n0"] == ("n50", 50)


def test_links_job(spark):
    p = spark.createDataFrame([(1, "A", "[[b]] [[Old b]] [[missing]] [[b]]\n==Notes==\n[[C]]"), (2, "B", "none"), (3, "C", None)], "id long, title string, text string")
    ends = pages.resolve_redirects(spark.createDataFrame([("Old b", "B")], "title string, redirect string"), p)
    found = pages.resolved_links(pages.page_links(p), p, ends)
    assert rows(pages.link_lists(p, found)) == [(1, [2, 2, 2, 3]), (2, []), (3, [])]
    assert rows(pages.link_lists(p, pages.resolved_links(pages.page_links(p), p, ends, ["Notes"]))) == [(1, [2, 2, 2]), (2, []), (3, [])]
    assert rows(pages.raw_links(p, 2)) == [(1, "Old b"), (1, "b")]


def test_view_and_titles(spark):
    p = spark.createDataFrame([(1, "A", "x"), (2, "B", "y")], "id long, title string, text string")
    assert rows(pages.view(p, ids=[2])) == [(2, "B", "y")] and rows(pages.view(p, titles=["A"])) == [(1, "A", "x")]
    with pytest.raises(KeyError):
        pages.view(p, titles=["A", "Z"])
    before = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C"), (4, "D")], "id long, title string")
    after = spark.createDataFrame([(1, "A"), (2, "B2"), (5, "E")], "id long, title string")
    assert tuple(pages.compare_titles(before, after).first()) == pytest.approx((4, 3, 1, 2, -1 / 3, 0.5, 0.5))
    assert spark.range(1).select(pages.is_person(F.lit("{{Infobox Writer\n|a=b}}")), pages.is_person(F.lit("{{Infobox writers|\n"))).first()[:] == (True, False)


CLAIMS = "array<struct<value:string,rank:string>>"
CASES = [
    (None, entities.NO_CLAIMS),
    ([], entities.NO_CLAIMS),
    ([("Q1", "deprecated")], entities.NO_CLAIMS),
    ([("Q1", "normal")], "Q1"),
    ([("Q2449503", "normal")], "Q2449503"),
    ([("Q1", "normal"), ("Q2", "preferred")], "Q2"),
    ([("Q2449503", "preferred"), ("Q2", "normal")], "Q2449503"),
    ([("Q1", "preferred"), ("Q2", "preferred")], entities.CONFLICT),
    ([("Q6581097", "normal"), ("Q2449503", "normal")], entities.MAN),
    ([("Q1", "normal"), ("Q2", "normal")], entities.CONFLICT),
    ([("Q1", "normal"), ("Q2", "deprecated")], "Q1"),
]


def test_gender_inference_in_both_forms(spark):
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(CASES)], f"id long, claims {CLAIMS}")
    assert [r[0] for r in df.orderBy("id").select(entities.infer_gender(F.col("claims"))).collect()] == [w for _, w in CASES]
    flat = df.select("id", F.explode("claims").alias("c")).select("id", "c.value", "c.rank")
    got = dict(map(tuple, entities.infer_by_rows(flat, ["id"]).collect()))
    assert got == {i: w for i, (c, w) in enumerate(CASES) if c}


RAW = "id string, sitelinks map<string,struct<site:string,title:string,url:string>>, claims map<string,array<struct<mainsnak:struct<property:string,datavalue:struct<value:string>>,rank:string>>>"


def snak(v, rank="normal"):
    return (("P", (v,)), rank)


def test_entities(spark):
    item = lambda q: snak('{"id": "%s"}' % q)
    data = [
        ("Q10", {"enwiki": ("enwiki", "Ann", "")}, {"P31": [item("Q5")], "P21": [item("Q6581072")], "P569": [snak('{"time": "+1900-01-02T00:00:00Z"}')], "P9": [item("Q1")]}),
        ("Q11", {}, {"P31": [item("Q5")], "P21": [item("Q6581097")]}),
        ("Q12", {"enwiki": ("enwiki", "Rock", "")}, {"P31": [item("Q7"), None]}),
        ("Q13", {"enwiki": ("enwiki", "Bob", "")}, {"P31": [item("Q5")]}),
        ("Q14", {"enwiki": ("enwiki", "Unknown title", "")}, {"P31": [item("Q5")], "P21": [item("Q1")]}),
        ("Q15", None, None),
    ]
    titles = spark.createDataFrame([(1, "Ann"), (2, "Bob"), (3, "Rock")], "id long, title string")
    found = entities.parse_entities(spark.createDataFrame(data, RAW), titles, ["P31", "P21", "P569"], ["Q5"], ["Q5"])
    assert rows(found.select("id", "wikidata_id")) == [(1, "Q10"), (2, "Q13")]
    claims = {r.id: r.claims for r in found.collect()}
    assert set(claims[1]) == {"P31", "P21", "P569"} and claims[1]["P569"][0].value == "+1900-01-02T00:00:00Z"
    index = entities.gender_index(found)
    assert rows(index) == [(1, entities.WOMAN), (2, entities.NO_CLAIMS)]
    assert [tuple(r) for r in entities.frequency(index).collect()] == [("NO CLAIMS", 1), (entities.WOMAN, 1)]
    assert [r[0] for r in index.orderBy("id").select(entities.gender_label(F.col("gender"))).collect()] == ["woman", "no claims"]


def test_categories(spark):
    text = "x\n[[Category:{{title year}} births]] [[Category:Oaks|key]]\n [[Category:indented]]\n[[Category:Missing]]\n[[Category:]]\n[[Category:{{Bad]]"
    p = spark.createDataFrame([(1, "In 1900", text)], "id long, title string, text string")
    titles = spark.createDataFrame([(7, "Category:1900 Births"), (8, "Category:oaks")], "id long, title string")
    assert rows(categories.categorize(p, titles)) == [(1, 0, 7), (1, 1, 8)]


def test_bayes(spark):
    dictionary = spark.createDataFrame([(i, f"w{i}") for i in range(1, 61)], "ordinal long, word string")
    bags = spark.createDataFrame([(1, [(56, 3), (57, 1), (1, 9)]), (2, [(58, 4)]), (3, [(56, 1), (58, 1), (58, 1)]), (4, None)], "id long, words array<struct<word:long,count:long>>")
    labels = spark.createDataFrame([(1, 1), (2, 2)], "id long, classification int")
    model = {r.word: r.logp for r in classify.train_bayes(bags, labels, dictionary, 3).collect()}
    assert set(model[1]) == {0.0}
    logs = [math.log(5 / 300), math.log(8 / 313), math.log(5 / 304)]
    assert model[56] == pytest.approx([x - max(logs) for x in logs])
    got = {r.id: r.classes for r in classify.classify_bayes(bags, classify.train_bayes(bags, labels, dictionary, 3), 3).collect()}
    assert [c.classification for c in got[1]] == [1, 2] and [c.classification for c in got[2]] == [2, 1] and set(got) == {1, 2, 3}
    assert sum(c.p for c in got[3]) == pytest.approx(1)
    parents = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (4, 1)], "id long, parent long")
    seeds = spark.createDataFrame([(2, 5), (3, 6), (4, 7)], "id long, classification int")
    assert rows(classify.ancestor_classes(parents, seeds)) == [(1, [5, 6]), (2, [5, 6]), (3, [5, 6]), (4, [5, 6, 7])]


def test_distributions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    arr = lambda *x: F.array(*(F.lit(float(v)) for v in x)).cast("array<double>")
    assert one(distributions.normalize(arr(1, 3))) == [0.25, 0.75] and one(distributions.normalize(arr(0, 0))) == [0.0, 0.0] and one(distributions.normalize(arr())) == []
    assert one(distributions.from_log(arr(-1000, -1000))) == [0.5, 0.5] and one(distributions.from_log(arr())) == []
    assert one(distributions.to_log(arr(0, 1))) == [float("-inf"), 0.0]
    assert one(distributions.add_logs(arr(1, 2), arr(3, 4))) == [4.0, 6.0]
    bins = distributions.logarithmic_bins(10, 10_000_000, 10 ** (1 / 3))
    assert bins[:5] == [10, 22, 46, 100, 215]


def test_word_tables(spark):
    table = spark.createDataFrame([("b", 2), ("a", 2), ("c", 9)], "word string, count long")
    assert [r.word for r in words.ranked(table).collect()] == ["c", "a", "b"]
    assert rows(words.ordinals(table)) == [("a", 2), ("b", 3), ("c", 1)]
    assert words.union_tables(table, table).count() == 6
    lines = spark.createDataFrame([("new york city\nnew york",)] * 40 + [("york new",)] * 3, "text string")
    got = dict(map(tuple, words.discover_ngrams(lines, F.split("text", " "), 40).collect()))
    assert got["new york"] == 80 and got["new york city"] == 40 and "york new" not in got


def _ngrams(lines, least):
    """Brute force: passes of at least 2, 2, 4, 8 ... words until nothing new is found."""
    known = {w: n for w, n in Counter(w for x in lines for w in x).items() if n >= least}
    size, n = -1, 1
    while size != len(known):
        size = len(known)
        dictionary = frozenset(" ".join(w.split(" ")[: k + 1]) for w in known for k in range(w.count(" ") + 1))
        tokens = [brute_tokens(x, dictionary) for x in lines]
        pairs = Counter(f"{a} {b}" for x in tokens for a, b in zip(x, x[1:]) if a in dictionary and b in dictionary)
        known |= {w: k for w, k in pairs.items() if k >= least and w.count(" ") + 1 >= max(2, n)}
        n *= 2
    return known


def test_ngrams_of_any_length(spark):
    rng = random.Random(5)
    lines = [[w for _ in range(rng.randint(0, 6)) for w in rng.choice(["a b c d", "a b c e", "f g", "h", "a b c d f g h i", "e i"]).split()] for _ in range(200)]
    want = _ngrams(lines, 5)
    got = dict(map(tuple, words.discover_ngrams(spark.createDataFrame([(" ".join(x),) for x in lines], "text string"), F.filter(F.split("text", " "), lambda w: w != ""), 5).collect()))
    assert got == want and max(w.count(" ") for w in want) >= 7


def test_ngram_query_goes_on_until_nothing_is_new(spark, tmp_path):
    lines = [["by", "the", "end", "of", w] for w in ("it", "them") * 20]
    spark.createDataFrame([(" ".join(x),) for x in lines], "text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = dict(map(tuple, registry.QUERIES["ngram_discovery_all"](spark, str(tmp_path)).collect()))
    assert got == _ngrams(lines, words.NGRAM_COUNT) and got["by the end of"] == 40
