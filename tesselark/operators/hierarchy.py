"""Parent-child rows to full hierarchies: roots, distances, paths, descendants, circles.

Nodes are gathered in fragments with their kin: one node in ``HEADS``, chosen by hash, is a head, and each node goes with the
nearest head above it (by the smallest parent at each step), so that pieces of chains and subtrees lie together. Groups that would outgrow a fragment are cut by parent, and
children of one parent that would alone outgrow it are spread. In each fragment the chains that stay inside are contracted:
every node gets its exits, the nearest nodes outside the fragment (or roots inside it) with the number of links to them.
The nodes that other fragments enter form the quotient graph, whose links are the exits; it is fragmented anew by its own
kin and solved in the same way, until it fits into one fragment by its measured size. Then the exits of each level are
expanded by the solution of the next. A circle inside a fragment is found there; one across fragments becomes a circle
inside a fragment of a later quotient. A quotient that does not shrink any more is solved by doubling, as joins.

What one task holds is a fragment of about ``FRAGMENT_LINKS`` links, at every level.

Defined results: null nodes and links are ignored, repeated rows count once, a node without parents is its own root at
distance 0, a node from which a circle can be reached has the root ``cycle`` at -1 and nothing else; several parents
give one row per root with the fewest links; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselark.functions.titles import wiki_title
from tesselark.runtime import Latest, Rounds, cut

#: Links per fragment, from which the number of fragments follows.
FRAGMENT_LINKS = 25_000
#: One node in so many is a head, and steps to it double so many times. Nine nodes in ten find their head within these.
HEADS, ROUNDS = 4, 3
#: A quotient with more than this part of the links it came from is solved by doubling.
STALLED = 0.8


def _expand(counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Indexes of runs of the given starts and lengths, run after run."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)


def contract_fragment(child: np.ndarray, parent: np.ndarray, links: np.ndarray, local: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exits of every child of a fragment, as (node, exit, links).

    ``child`` and ``parent`` are node numbers, ``links`` the length of each link, ``local`` whether a node (by number)
    belongs to the fragment. Exits are nodes that are not local, and local nodes without parents. A node from which a
    local circle can be reached has the exit -1. Nodes are settled level by level, from the exits downwards: a node is
    settled when all its parents are; what stays unsettled can run into a circle.
    """
    n = len(local)
    out_degree = np.bincount(child, minlength=n)
    inside = local[parent] & (out_degree[parent] > 0)  # links whose parent must be settled first
    waiting = np.bincount(child[inside], minlength=n)
    by_parent = np.argsort(parent[inside], kind="stable")
    down_child = child[inside][by_parent]
    down_start = np.searchsorted(parent[inside][by_parent], np.arange(n))
    down_count = np.bincount(parent[inside], minlength=n)
    by_child = np.argsort(child, kind="stable")
    up_parent, up_links = parent[by_child], links[by_child]
    up_start = np.searchsorted(child[by_child], np.arange(n))
    # exits of settled nodes lie one after another in arrays that double when they are full; each node has one run
    exits, dists, filled = np.append(np.arange(n), np.zeros(n, np.int64)), np.zeros(2 * n, np.int64), n
    run_start, run_count = np.arange(n), np.ones(n, np.int64)  # an exit is its own exit
    ready = np.flatnonzero((out_degree > 0) & (waiting == 0))
    settled_nodes, result = [], []
    while len(ready):
        up = _expand(out_degree[ready], up_start[ready])
        who = np.repeat(ready, out_degree[ready])
        p, w = up_parent[up], up_links[up]
        at = _expand(run_count[p], run_start[p])
        node, exit_, dist = np.repeat(who, run_count[p]), exits[at], dists[at] + np.repeat(w, run_count[p])
        order = np.lexsort((dist, exit_, node))
        node, exit_, dist = node[order], exit_[order], dist[order]
        first = np.ones(len(node), bool)
        first[1:] = (node[1:] != node[:-1]) | (exit_[1:] != exit_[:-1])
        node, exit_, dist = node[first], exit_[first], dist[first]
        result.append((node, exit_, dist))
        starts = np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(node) else np.zeros(0, int)
        run_start[node[starts]] = filled + starts
        run_count[node[starts]] = np.diff(np.append(starts, len(node)))
        while filled + len(node) > len(exits):
            exits, dists = np.append(exits, np.zeros_like(exits)), np.append(dists, np.zeros_like(dists))
        exits[filled : filled + len(node)], dists[filled : filled + len(node)] = exit_, dist
        filled += len(node)
        settled_nodes.append(ready)
        below = down_child[_expand(down_count[ready], down_start[ready])]
        np.subtract.at(waiting, below, 1)
        ready = np.unique(below)
        ready = ready[waiting[ready] == 0]
    settled = np.zeros(n, bool)
    for s in settled_nodes:
        settled[s] = True
    circling = np.flatnonzero((out_degree > 0) & ~settled)
    result.append((circling, np.full(len(circling), -1), np.full(len(circling), -1)))
    return tuple(np.concatenate(x) for x in zip(*result, strict=True))


def _kin(links: DataFrame, fragments: int) -> DataFrame:
    """``node, f``: the fragment of each child of ``links``."""
    head = F.pmod(F.xxhash64("node", F.lit(fragments)), F.lit(HEADS)) == 0
    up = links.groupBy(F.col("child").alias("node")).agg(F.min("parent").alias("a1"), F.count("*").alias("n"))
    at = Latest(up.withColumn("top", F.when(head, F.col("node")).otherwise(F.col("a1"))), "kin")
    for _ in range(ROUNDS):
        onward = at.df.select(F.col("node").alias("top"), F.col("top").alias("further"))
        at.replace(at.df.join(onward, "top", "left").select("node", "a1", "n", F.coalesce("further", "top").alias("top")))

    def crowded(by: str) -> DataFrame:  # at most one row per full fragment
        return at.df.groupBy(by).agg(F.sum("n").alias("all")).where(F.col("all") > FRAGMENT_LINKS).select(by, F.lit(True).alias(f"crowded_{by}"))

    rows = at.df.join(crowded("top"), "top", "left").join(crowded("a1"), "a1", "left")
    key = F.when(F.col("crowded_a1") & F.col("crowded_top"), F.col("node")).when(F.col("crowded_top"), F.col("a1")).otherwise(F.col("top"))
    return rows.select("node", F.pmod(F.xxhash64(key), F.lit(fragments)).cast("int").alias("f"))


def _contract(links: DataFrame, fragments: int) -> DataFrame:
    """``node, exit, steps``: the exits of each child of ``links`` (``child, parent, steps, f, inside``); a null exit is a
    circle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        rows = pd.concat(parts) if parts else None
        if rows is None or rows.empty:
            return
        for _, part in rows.groupby("f", sort=False):
            codes, names = pd.factorize(pd.concat([part["child"], part["parent"]], ignore_index=True))
            k = len(part)
            local = np.zeros(len(names), bool)
            local[codes[:k]] = True
            local[codes[k:][part["inside"].to_numpy()]] = True
            node, exit_, steps = contract_fragment(codes[:k], codes[k:], part["steps"].to_numpy(), local)
            names = np.append(names.to_numpy(dtype=object), None)
            yield pd.DataFrame({"node": names[node], "exit": names[exit_], "steps": steps})

    return links.select("child", "parent", "steps", "f", "inside").repartition(fragments, "f").mapInPandas(run, "node string, exit string, steps long")


def _doubled(links: DataFrame, size: int) -> DataFrame:
    """``node, root, steps`` of each child, by doubling: what has not ended after more links than there are is in a circle."""
    tops = links.select(F.col("parent").alias("up")).distinct().join(links.select(F.col("child").alias("up")).distinct(), "up", "left_anti")
    rows = links.join(tops.select(F.col("up").alias("parent"), F.lit(True).alias("top")), "parent", "left")
    at = Latest(rows.select(F.col("child").alias("node"), F.col("parent").alias("up"), "steps", F.coalesce("top", F.lit(False)).alias("ended")), "doubled")
    reach = 1
    while reach <= size and not at.df.where("not ended").isEmpty():
        onward = at.df.select(F.col("node").alias("up"), F.col("up").alias("further"), F.col("steps").alias("more"), F.col("ended").alias("then"))
        moved = at.df.where("not ended").join(onward, "up").select("node", F.col("further").alias("up"), (F.col("steps") + F.col("more")).alias("steps"), F.col("then").alias("ended"))
        at.replace(at.df.where("ended").unionByName(moved).groupBy("node", "up", "ended").agg(F.min("steps").alias("steps")).select("node", "up", "steps", "ended"))
        reach *= 2
    root = F.when(F.col("ended"), F.col("up"))
    return at.df.select("node", root.alias("root"), F.when(F.col("ended"), F.col("steps")).otherwise(-1).alias("steps")).distinct()


def _solve(links: DataFrame, size: int) -> DataFrame:
    """``node, root, steps`` of each child of ``links`` (``size`` rows of ``child, parent, steps``); a null root is a circle."""
    fragments = -(-size // FRAGMENT_LINKS)
    if fragments <= 1:
        return cut(_contract(links.withColumns({"f": F.lit(0), "inside": F.lit(True)}), 1), "exits").withColumnRenamed("exit", "root")
    kin = cut(_kin(links, fragments), "kin")
    placed = links.join(kin.withColumnRenamed("node", "child"), "child").join(kin.select(F.col("node").alias("parent"), F.col("f").alias("g")), "parent", "left")
    placed = cut(placed.withColumn("inside", F.coalesce(F.col("f") == F.col("g"), F.lit(False))), "placed")
    exits = cut(_contract(placed, fragments), "exits")
    entered = placed.where("not inside").select(F.col("parent").alias("node")).distinct()
    quotient = exits.join(entered, "node", "left_semi").select(
        F.col("node").alias("child"), F.coalesce("exit", "node").alias("parent"), F.greatest("steps", F.lit(1)).alias("steps")
    )
    quotient = cut(quotient, "quotient")
    rest = quotient.count()
    above = _solve(quotient, rest) if rest <= STALLED * size else _doubled(quotient, rest)
    above = above.select(F.col("node").alias("exit"), F.col("root").alias("up"), F.col("steps").alias("more"), F.lit(True).alias("found"))
    joined = exits.join(above, "exit", "left")
    root = F.when(F.col("found"), F.col("up")).otherwise(F.col("exit"))
    rows = joined.select("node", root.alias("root"), F.when(root.isNull(), -1).otherwise(F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"))
    return cut(rows.groupBy("node", "root").agg(F.min("steps").alias("steps")), "roots")


def _clean_links(links: DataFrame) -> DataFrame:
    return cut(links.where("child is not null and parent is not null").select("child", "parent", F.lit(1).cast("long").alias("steps")).distinct(), "links")


def roots(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``node, root, steps`` for all ``nodes`` (``node``) under ``links`` (``child, parent``)."""
    return _roots(nodes, _clean_links(links))


def _roots(nodes: DataFrame, links: DataFrame) -> DataFrame:
    solved = _solve(links, links.count())
    circling = solved.where("root is null").select("node").distinct()
    clean = solved.where("root is not null").join(circling, "node", "left_anti")
    rows = clean.unionByName(circling.select("node", F.lit("cycle").alias("root"), F.lit(-1).cast("long").alias("steps")))
    tops = nodes.where("node is not null").select("node").distinct().join(links.select(F.col("child").alias("node")).distinct(), "node", "left_anti")
    return rows.unionByName(tops.select("node", F.col("node").alias("root"), F.lit(0).cast("long").alias("steps"))).select("node", "root", F.col("steps").cast("int").alias("steps"))


def contract_chains(node: list[str], root: list[str], next_: list[str | None], steps: np.ndarray) -> tuple[list[list[str]], list[str | None]]:
    """The path of each row inside its fragment, itself first, and the node outside that it goes on to (none at a root)."""
    paths: dict[tuple[str, str], tuple[list[str], str | None]] = {}
    out: list = [None] * len(node)
    for i in np.argsort(steps, kind="stable").tolist():  # the next node of a row has a step less
        n, r, then = node[i], root[i], next_[i]
        path, exit_ = ([], then) if then is None or (then, r) not in paths else paths[then, r]
        out[i] = paths[n, r] = ([n, *path], exit_)
    return [p for p, _ in out], [e for _, e in out]


def paths(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``node, root, steps, path``: a shortest path from each node to each of its roots, both included; of several the one
    with the smallest next node at each step. Circling nodes have a null path.

    Chains of next nodes are contracted in the fragments of their nodes; the chains that other fragments enter are joined
    by doubling, which takes as many rounds as the logarithm of the fragments on a path; then all chains are expanded."""
    links = _clean_links(links)
    size = links.count()
    found = cut(_roots(nodes, links), "found")
    own = found.where("steps >= 0")
    above = own.select(F.col("node").alias("parent"), "root", (F.col("steps") + 1).alias("steps"))
    hop = own.where("steps > 0").join(links.select(F.col("child").alias("node"), "parent"), "node").join(above, ["parent", "root", "steps"])
    hop = hop.groupBy("node", "root", "steps").agg(F.min("parent").alias("next"))
    fragments = max(1, -(-size // FRAGMENT_LINKS))
    kin = _kin(links, fragments) if fragments > 1 else links.select(F.col("child").alias("node"), F.lit(0).alias("f")).distinct()
    steps = own.join(hop, ["node", "root", "steps"], "left").join(kin, "node", "left")
    steps = steps.withColumn("f", F.coalesce("f", F.pmod(F.xxhash64("node"), F.lit(fragments)).cast("int")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if parts:
            rows = pd.concat(parts).astype({"next": object})
            rows["next"] = rows["next"].where(rows["next"].notna(), None)
            path, exit_ = contract_chains(rows["node"].tolist(), rows["root"].tolist(), rows["next"].tolist(), rows["steps"].to_numpy())
            yield pd.DataFrame({"node": rows["node"].to_numpy(), "root": rows["root"].to_numpy(), "steps": rows["steps"].to_numpy(), "path": path, "exit": pd.Series(exit_, dtype=object)})

    chains = steps.select("node", "root", "steps", "next", "f").repartition(fragments, "f").mapInPandas(run, "node string, root string, steps int, path array<string>, exit string")
    chains = cut(chains, "chains")
    entered = chains.where("exit is not null").select(F.col("exit").alias("node"), "root").distinct()
    crossing = Latest(chains.join(entered, ["node", "root"], "left_semi").select("node", "root", "path", "exit"), "crossing")
    tail = ["exit", "root"]
    while not crossing.df.where("exit is not null").isEmpty():
        onward = crossing.df.select(F.col("node").alias("exit"), "root", F.col("path").alias("tail"), F.col("exit").alias("then"))
        joined = crossing.df.join(onward, tail, "left")
        crossing.replace(joined.select("node", "root", F.when(F.col("tail").isNull(), F.col("path")).otherwise(F.concat("path", "tail")).alias("path"), F.col("then").alias("exit")))
    ends = crossing.df.select(F.col("node").alias("exit"), "root", F.col("path").alias("tail"))
    whole = chains.join(ends, tail, "left").select("node", "root", "steps", F.when(F.col("tail").isNull(), F.col("path")).otherwise(F.concat("path", "tail")).alias("path"))
    circling = found.where("steps < 0").select("node", "root", "steps", F.lit(None).cast("array<string>").alias("path"))
    return whole.unionByName(circling)


def descendants(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``node, descendant, steps``: every pair of a node and a node below it, with the fewest links between them.

    Nodes that can run into a circle have no descendants (:func:`roots` names them), but they are descendants of those above them
    that cannot. The result is as large as the hierarchy's closure. Distances double: pairs as far apart as the longest
    known distance are joined with all known ones, which makes each pair once per node in the middle of its ways, in as many rounds as the
    logarithm of the depth."""
    links = _clean_links(links)
    circling = _roots(nodes, links).where("steps < 0").select(F.col("node").alias("parent"))
    pairs = Rounds(links.select("child", "parent", "steps"), "pairs")
    reach = 1
    while not pairs.last.isEmpty():
        known = pairs.all()
        far = known.where(F.col("steps") == reach).select("child", F.col("parent").alias("mid"), "steps")
        onward = known.select(F.col("child").alias("mid"), "parent", F.col("steps").alias("more"))
        longer = far.join(onward, "mid").groupBy("child", "parent").agg(F.min(F.col("steps") + F.col("more")).alias("steps"))
        pairs.add(longer.join(known.select("child", "parent"), ["child", "parent"], "left_anti").select("child", "parent", "steps"))
        reach *= 2
    below = pairs.all().where("child <> parent").join(circling, "parent", "left_anti")
    return below.select(F.col("parent").alias("node"), F.col("child").alias("descendant"), F.col("steps").cast("int").alias("steps"))


def category_links(page_categories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and links of the category tree: ids as decimal strings."""
    links = page_categories.where("id is not null").select(F.col("id").cast("string").alias("child"), F.explode(F.col("categories").cast("array<string>")).alias("parent"))
    nodes = page_categories.select(F.col("id").cast("string").alias("node")).unionByName(links.select(F.col("parent").alias("node"))).where("node is not null").distinct()
    return nodes, links


def redirect_links(redirects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and links of the redirects that have both sides, under wiki conventions."""
    links = redirects.select(wiki_title("title").alias("child"), wiki_title("redirect").alias("parent")).where("child is not null and parent is not null").distinct()
    nodes = links.select(F.col("child").alias("node")).unionByName(links.select(F.col("parent").alias("node"))).distinct()
    return nodes, links


def forest(*trees: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Nodes and links of several trees as one: names with the number of their tree before them, so that one run does all."""
    marked = []
    for i, (nodes, links) in enumerate(trees):
        mark = F.lit(f"{i}:")
        marked.append((nodes.select(F.concat(mark, "node").alias("node")), links.select(F.concat(mark, "child").alias("child"), F.concat(mark, "parent").alias("parent"))))
    nodes, links = marked[0]
    for n, k in marked[1:]:
        nodes, links = nodes.unionByName(n), links.unionByName(k)
    return nodes, links


def tree_of(name: Column) -> tuple[Column, Column]:
    """The number of its tree, and the name of a node of a forest."""
    return F.substring_index(name, ":", 1).cast("int"), F.substring(name, F.instr(name, ":") + 1, F.length(name))
