from collections import Counter, defaultdict

from tesselark.llm import term_counts

from ..conftest import rows

SCHEMA = "id long, words map<string,long>, term string, form int, n string"


def table(spark, data):
    return spark.createDataFrame([(i, w, "t", 1, "n") for i, w in data], SCHEMA)


def test_terms_equal_brute_force(spark):
    data = [(i, {"the": 2, "The": 1, f"w{i % 40}": 1, f"rare{i}": 3, "'quoted' ": 1 if i % 2 else None}) for i in range(1, 120)]
    data += data[:30]
    data += [(200, None), (201, {}), (202, {"zero": 0, "minus": -2, "none": None, " ' ": 4}), (None, {"lost": 1}), (203, {"x" * 100_000: 1})]
    entries = {(i, k, n) for i, w in data if i is not None and w for k, n in w.items() if n and n > 0}
    total, pages = Counter(), defaultdict(set)
    for i, k, n in entries:
        t = k.lower().strip("' ’")
        if t:
            total[t] += n
            pages[t].add(i)
    holders = len({i for p in pages.values() for i in p})
    want = sorted(((t, total[t], len(pages[t]), "rare" if len(pages[t]) < 3 else "common" if 5 * len(pages[t]) > 2 * holders else None) for t in total), key=repr)
    assert rows(term_counts.term_frequencies(table(spark, data))) == want
    assert dict((r[0], r[3]) for r in want)["the"] == "common"


def test_empty(spark):
    assert rows(term_counts.term_frequencies(table(spark, []))) == []


def test_runs_over_batches_and_hot_terms(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        data = [(i, {"hot": 1, f"b{i % 3}": 2}) for i in range(1, 400)]
        got = {r[0]: r[1:3] for r in term_counts.term_frequencies(table(spark, data)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert got["hot"] == (399, 399) and got["b1"] == (266, 133)
