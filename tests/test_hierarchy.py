import random

import pytest

from tesselark.operators import hierarchy

from .conftest import rows


def brute(nodes, links):
    up = {}
    for c, p in links:
        up.setdefault(c, set()).add(p)
    every = set(nodes) | set(up) | {p for _, p in links}
    reach = {}
    for n in every:
        seen, front, d = {n: 0}, [n], 0
        while front:
            d += 1
            front = sorted({p for x in front for p in up.get(x, ()) if p not in seen})
            seen |= {p: d for p in front}
        reach[n] = seen
    circle = {n for n in every if any(n in reach[p] for p in up.get(n, ()))}
    out = set()
    for n in every:
        if any(x in circle for x in reach[n]):
            out.add((n, "cycle", -1))
        else:
            out |= {(n, x, d) for x, d in reach[n].items() if x not in up}
    return out, reach, circle


def tables(spark, nodes, links):
    return spark.createDataFrame([(n,) for n in nodes], "node string"), spark.createDataFrame(links, "child string, parent string")


def forest(seed, n=120):
    r = random.Random(seed)
    links = [(str(a), str(r.randrange(a, n) if r.random() < 0.97 else r.randrange(n))) for a in range(n - 1) for _ in range(r.choice([0, 1, 1, 1, 2]))]
    links = [(a, b) for a, b in links if a != b or r.random() < 0.1]
    return [str(x) for x in range(n)] + ["alone"], links


@pytest.mark.parametrize("seed, size, stalled", [(0, 1000, 0.8), (1, 20, 0.8), (2, 5, 0.9), (3, 9, 0.0), (4, 30, 0.8)])
def test_roots_equal_brute_force(spark, monkeypatch, seed, size, stalled):
    """Fragments of all sizes; with ``stalled`` at 0 each quotient is solved by doubling."""
    monkeypatch.setattr(hierarchy, "FRAGMENT_LINKS", size)
    monkeypatch.setattr(hierarchy, "STALLED", stalled)
    nodes, links = forest(seed)
    want, _, _ = brute(nodes, links)
    df_nodes, df_links = tables(spark, nodes, [*links, *links[:9], (None, "1"), ("1x", None)])
    assert set(map(tuple, hierarchy.roots(df_nodes, df_links).collect())) == want


def test_paths_and_descendants_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "FRAGMENT_LINKS", 25)
    nodes, links = forest(5, 90)
    want, reach, circle = brute(nodes, links)
    df_nodes, df_links = tables(spark, nodes, links)
    dirty = {n for n, root, _ in want if root == "cycle"}
    up = {}
    for c, p in links:
        up.setdefault(c, set()).add(p)

    def path(n, root, d):  # the smallest next node that is as near as it must be
        out = [n]
        while d:
            d -= 1
            n = min(p for p in up[n] if reach[p].get(root) == d)
            out.append(n)
        return out

    got = {(r.node, r.root): (r.steps, r.path) for r in hierarchy.paths(df_nodes, df_links).collect()}
    assert got == {(n, root): (d, path(n, root, d) if d >= 0 else None) for n, root, d in want}
    below = {(a, n, d) for n, seen in reach.items() for a, d in seen.items() if d and a not in dirty}
    assert set(map(tuple, hierarchy.descendants(df_nodes, df_links).collect())) == below


def test_no_fragment_outgrows_its_size(spark, monkeypatch):
    """One parent with most nodes, and long chains below it: kin lie together, crowds are spread."""
    monkeypatch.setattr(hierarchy, "FRAGMENT_LINKS", 100)
    links = [(f"s{i}", "hub") for i in range(2000)] + [(f"c{i}.{k}", f"c{i}.{k + 1}") for i in range(50) for k in range(20)]
    df = spark.createDataFrame(links, "child string, parent string")
    kin = {r.node: r.f for r in hierarchy._kin(df, 30).collect()}
    sizes = [list(kin.values()).count(f) for f in set(kin.values())]
    assert max(sizes) < 300
    together = sum(kin[c] == kin.get(p) for c, p in links if c[0] == "c")
    assert together > 0.7 * 50 * 19


def test_long_chains_circles_and_paths(spark):
    chain = [(f"c{i}", f"c{i + 1}") for i in range(300)]
    links = [*chain, ("a", "b"), ("b", "c"), ("c", "a"), ("tail", "a"), ("own", "own"), ("two", "c5"), ("two", "top")]
    nodes = sorted({x for link in links for x in link})
    df_nodes, df_links = tables(spark, nodes, links)
    got = {(r.node, r.root): r for r in hierarchy.paths(df_nodes, df_links).collect()}
    assert got["c0", "c300"].steps == 300 and got["c0", "c300"].path == [f"c{i}" for i in range(301)]
    assert got["two", "top"].path == ["two", "top"] and got["two", "c300"].steps == 296
    assert {n for n, root in got if root == "cycle"} == {"a", "b", "c", "tail", "own"}
    assert got["top", "top"].path == ["top"]


def test_descendants(spark):
    links = [("a", "b"), ("b", "c"), ("d", "b"), ("a", "c"), ("x", "x"), ("y", "x")]
    df_nodes, df_links = tables(spark, list("abcdxy"), links)
    assert rows(hierarchy.descendants(df_nodes, df_links)) == [("b", "a", 1), ("b", "d", 1), ("c", "a", 1), ("c", "b", 1), ("c", "d", 2)]
    # what runs into a circle is still below a node that does not
    more = [*links, ("d", "x"), ("e", "d")]
    assert rows(hierarchy.descendants(*tables(spark, list("abcdexy"), more))) == sorted([("b", "a", 1), ("b", "d", 1), ("b", "e", 2), ("c", "a", 1), ("c", "b", 1), ("c", "d", 2), ("c", "e", 3)])


def test_empty_and_nulls(spark):
    df_nodes, df_links = tables(spark, [], [])
    assert rows(hierarchy.roots(df_nodes, df_links)) == []
    cats = spark.createDataFrame([(1, [2, None, 2]), (1, [2]), (3, None), (None, [4]), (5, [])], "id long, categories array<long>")
    assert rows(hierarchy.roots(*hierarchy.category_links(cats))) == [("1", "2", 1), ("2", "2", 0), ("3", "3", 0), ("5", "5", 0)]


def test_redirect_titles_are_one_node_under_wiki_conventions(spark):
    data = [("a_b", "Target one#Part", 1), ("A  b ", "target_one", 2), ("Target_one", None, 3), ("x", " ", 4), ("éa", "Éb", 5)]
    df = spark.createDataFrame(data, "title string, redirect string, node int")
    assert rows(hierarchy.roots(*hierarchy.redirect_links(df))) == sorted([("A b", "Target one", 1), ("Target one", "Target one", 0), ("Éa", "Éb", 1), ("Éb", "Éb", 0)], key=repr)
