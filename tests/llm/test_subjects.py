import math
import random

import numpy as np

from tesselark.llm import subjects

from ..conftest import rows

BAG = "id long, title string, words array<struct<word:long,count:long>>, counts int, leaf string"


def corpus(seed=0, classes=5, pages=400):
    """Pages of one or two subjects with 40 words each, among words of everyday and function words."""
    r = random.Random(seed)
    own = {c: list(range(100 + 40 * c, 140 + 40 * c)) for c in range(1, classes + 1)}
    common = list(range(500, 800))
    bags, truth, seeds = [], set(), []
    for i in range(1, pages + 1):
        subject = r.sample(sorted(own), r.choice([0, 1, 1, 1, 1, 2]))
        words = {}
        for c in subject:
            for w in r.sample(own[c], 24 // len(subject)):
                words[w] = r.randint(1, 3)
        for w in r.sample(common, 35) + [r.choice(own[c]) for c in own]:
            words[w] = words.get(w, 0) + 1
        words[3] = 9
        truth |= {(i, c) for c in subject}
        bags.append((i, f"t{i}", sorted(words.items()), 1, "x"))
        if subject and r.random() < 0.25:
            seeds += [(i, c if r.random() > 0.04 else r.choice(sorted(own))) for c in subject]
    return bags, truth, seeds


def test_held_out_accuracy(spark):
    bags, truth, seeds = corpus()
    bags += bags[:20] + [(9001, None, None, 1, "x"), (9002, None, [], 1, "x"), (9003, "n", [(0, 5), (None, 3), (120, None), (99_999, 4)], 1, "x"), (None, "n", [(150, 3)], 1, "x")]
    dictionary = spark.createDataFrame([(i, f"w{i}") for i in range(1, 801)], "ordinal long, word string")
    labels = spark.createDataFrame([*seeds, (9999, 3), (1, 0)], "id long, classification int")
    got = subjects.subjects(spark.createDataFrame(bags, BAG), dictionary, labels)
    found = {(r.id, r.classification) for r in got.collect()}
    known = {i for i, _ in seeds}
    out, want = {x for x in found if x[0] not in known}, {x for x in truth if x[0] not in known}
    assert len(out & want) > 0.95 * len(want) and len(out & want) > 0.95 * len(out)
    names = spark.createDataFrame([(c, f"C{c}") for c in range(6)], "classification int, class_name string")
    parts = subjects.composition(got, names).collect()
    assert abs(sum(r.share for r in parts) - 1) < 1e-9 and sum(r.pages for r in parts) == len(found)


def test_whole_counts_and_words_beyond_the_dimensions(spark, monkeypatch):
    """Counts are not cut, and words that share a dimension count together."""
    monkeypatch.setattr(subjects, "DIMENSIONS", 4)
    pages = spark.createDataFrame([(1, [60, 61, 64], [1000, 1, 7]), (2, [61], [2]), (3, [], [])], "id long, words array<long>, counts array<long>")
    got = {r.id: r.features.toArray() for r in subjects.vectors_of(pages, [60, 61, 62, 63, 64]).collect()}
    idf = [math.log(3 / 3), math.log(3 / 3), math.log(3 / 1), math.log(3 / 1)]
    raw = [(1000 + 7) * math.log(3 / (1 + 1 + 1)), 1 * math.log(3 / 3), 0, 0]
    assert set(got) == {1, 2} and len(got[1]) == 4
    assert abs(np.linalg.norm(got[1]) - (1 if any(raw) else 0)) < 1e-9 and idf[0] == 0


def test_mixtures_of_pages():
    """Two components, a page of each and one of both."""
    said = np.array([[0.45, 0.05], [0.45, 0.05], [0.05, 0.45], [0.05, 0.45]], np.float32)
    words = np.array([0, 1, 2, 3, 0, 2])
    page = np.array([0, 0, 2, 2, 3, 3])  # page 1 has no words
    mixture, held = subjects.fit_mixture(page, np.array([5.0, 5, 4, 4, 6, 6]), said[words], np.full((4, 2), 0.5), 50)
    assert mixture[0, 0] > 0.95 and mixture[2, 1] > 0.95 and abs(mixture[3, 0] - 0.5) < 1e-6
    assert held.sum(1).round(6).tolist() == [10, 0, 8, 12]


def test_clean_bags(spark):
    df = spark.createDataFrame([(1, "a", [(60, 2), (60, 3), (7, 9), (61, None), (62, -1), (0, 4)], 1, "x"), (2, None, None, 1, "x"), (1, "a", [(60, 1)], 1, "x")], BAG)
    assert rows(subjects.clean_bags(df, [60, 61, 62])) == [(1, [60], [5]), (2, [], [])]


def test_nothing_to_learn_from(spark):
    bags = spark.createDataFrame([(1, "a", [(60, 2)], 1, "x")], BAG)
    dictionary = spark.createDataFrame([(60, "w")], "ordinal long, word string")
    labels = spark.createDataFrame([(1, 2)], "id long, classification int")
    assert rows(subjects.subjects(bags.where("false"), dictionary, labels)) == []
    assert rows(subjects.subjects(bags, dictionary.where("false"), labels)) == []
    assert rows(subjects.subjects(bags, dictionary, labels.where("false"))) == []
