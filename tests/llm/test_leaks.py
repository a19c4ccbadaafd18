import random

import numpy as np
import pyarrow as pa
import pytest

from tesselark.llm import leaks

from ..conftest import rows


@pytest.mark.parametrize("seed", range(6))
def test_index_finds_all_occurrences(seed):
    r = np.random.default_rng(seed)
    symbols = [2, 3, 6, 40][seed % 4]
    text = r.integers(0, symbols, 900)
    if seed == 5:
        text[:] = 1
        text[::50] = 0
    index = leaks.FmIndex(text, symbols)
    for size in (1, 2, 5):
        windows = np.array([text[i : i + size] for i in r.integers(0, 890, 60)] + [[1] * size])
        windows = windows[(windows > 0).all(1)]
        found, low, high = index.search(windows)
        got = {int(f): set(index.locate(np.arange(a, b)).tolist()) for f, a, b in zip(found, low, high, strict=True)}
        for k, w in enumerate(windows):
            places = {i for i in range(len(text) - size + 1) if (text[i : i + size] == w).all()}
            assert got.get(k, set()) == places


def test_suffixes_in_order():
    text = np.array([1, 2, 1, 2, 1, 2, 1, 2, 0, 1, 2, 1])
    key = lambda i: [x for x in text[i:]]
    order = leaks.suffix_order(text).tolist()
    assert sorted(order) == list(range(len(text)))
    cut = lambda i: tuple(key(i)[: key(i).index(0) + 1] if 0 in key(i) else key(i))
    assert [cut(i) for i in order if text[i]] == sorted(cut(i) for i in range(len(text)) if text[i])


def brute(docs, items, window):
    found = set()
    grams = [(i, {tuple(w[k : k + window]) for k in range(len(w) - window + 1)}) for i, t in items if t for w in [leaks._words(leaks.plain(t))]]
    for d, t in docs:
        w = leaks._words(leaks.plain(t)) if t else []
        mine = {tuple(w[k : k + window]) for k in range(len(w) - window + 1)}
        found |= {(d, i) for i, g in grams if g & mine}
    return found


@pytest.mark.parametrize("seed", range(3))
def test_leaks_equal_brute_force(spark, seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["don't", "naïve", "İstanbul", "Straße", "3.14", "x—y"]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(3, 20)))) for i in range(25)] + [(100, None), (101, ""), (102, "one two")]
    docs = []
    for i in range(150):
        words = [r.choice(vocabulary) for _ in range(r.randrange(0, 40))]
        if r.random() < 0.4:
            part = items[r.randrange(25)][1].split()
            a = r.randrange(len(part))
            spoilt = [w.upper() if r.random() < 0.3 else w.replace("w", "w\u200b") if r.random() < 0.2 else w for w in part[a:]]
            words[5:5] = spoilt
        docs.append((i, r.choice([" ", "  ", ", ", "\n", " - "]).join(words)))
    docs += [(200, None), (201, ""), (202, "short"), docs[3], (203, " ".join(docs[0][1] for _ in range(300)))]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int")
    it = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    got = set(map(tuple, leaks.leaks(df, it, 5).collect()))
    assert got == brute(docs, items, 5) and got


def test_spans_are_merged(spark):
    words = [f"a{i}" for i in range(30)]
    df = spark.createDataFrame([(1, "x y " + " ".join(words[:20]) + " z " + " ".join(words[15:28]))], "doc_id long, text string")
    it = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    assert rows(leaks.leaked_spans(df, it)) == sorted([(1, 7, 2, 21), (1, 7, 23, 35)], key=repr)


def test_empty(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    it = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert rows(leaks.leaks(df.where("false"), it)) == rows(leaks.leaks(df, it.where("false"))) == rows(leaks.leaks(df, it)) == []


def test_folding_without_python_strings():
    texts = ["ABC def", "Ünïcode\u00ad x", None, "", "ﬁ SS ẞ"]
    data, offsets = leaks.folded_bytes(pa.array(texts))
    got = [bytes(data[a:b]).decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    assert got == [leaks.plain(t) if t else "" for t in texts]


def test_more_items_than_a_worker_holds(spark, monkeypatch):
    """Items in several parts give the same pairs."""
    words = [f"w{i}" for i in range(400)]
    items = spark.createDataFrame([(i, " ".join(words[10 * i : 10 * i + 20])) for i in range(38)] + [(99, None)], "item_id long, text string")
    docs = spark.createDataFrame([(i, "x " + " ".join(words[7 * i : 7 * i + 40]) + " y") for i in range(50)] + [(77, None)], "doc_id long, text string")
    whole = rows(leaks.leaks(docs, items))
    monkeypatch.setattr(leaks, "MAX_CHARS", 500)
    assert rows(leaks.leaks(docs, items)) == whole and len(whole) > 100
