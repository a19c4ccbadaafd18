"""Operators on link graphs: ranks, weights, distances, paths, degrees, reach.

Graphs are ``src, dst`` rows. Parallel links are merged into a multiplicity before any loop, so that a loop moves each
pair of nodes once. Ranks keep links bucketed by their source and weights bucketed by node: no step moves a link, it moves
weights to the links and pre-aggregated sums back. A source with more than ``HUB_LINKS`` links is split into pieces of that size, each
with its part of the sums. Each step is written, so that the plan of a step does not grow with the steps before it; the mass of dead
ends and the distance to the step before are read off the written table in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselark.runtime import Rounds, broadcast_if_small, bucketed, cut, free, shuffle_partitions

DAMPING, THRESHOLD, MAX_STEPS = 0.85, 1e-9, 100
#: Links of a piece of a source.
HUB_LINKS = 1_000_000


def multiplicities(edges: DataFrame, distinct: bool = False, self_links: bool = True) -> DataFrame:
    """``src, dst, times``; once each with ``distinct``, without links to oneself unless ``self_links``."""
    rows = edges.where("src is not null and dst is not null")
    if not self_links:
        rows = rows.where("src <> dst")
    times = F.lit(1).cast("long") if distinct else F.count("*")
    return rows.groupBy("src", "dst").agg(times.alias("times")) if not distinct else rows.select("src", "dst").distinct().withColumn("times", times)


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).where("id is not null").distinct()


def out_degree(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id, degree`` of all nodes, links to oneself included."""
    found = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def in_degree(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id, degree`` of all nodes, links to oneself excluded."""
    found = edges.where("src <> dst").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("degree"))
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


class _Walk:
    """The weights of a graph, step by step."""

    def __init__(self, links: DataFrame, nodes: DataFrame):
        self.buckets = shuffle_partitions(links.sparkSession)
        degree = cut(links.groupBy("src").agg(F.sum("times").alias("degree"), F.count("*").alias("n")), "degree")
        # at most one row per HUB_LINKS links
        self.hubs = cut(degree.where(F.col("n") > HUB_LINKS).select("src", F.ceil(F.col("n") / HUB_LINKS).cast("int").alias("pieces")), "hubs")
        self.split = not self.hubs.isEmpty()
        piece = F.lit(0)
        if self.split:
            links = links.join(broadcast_if_small(self.hubs), "src", "left")
            piece = F.pmod(F.xxhash64("dst"), F.coalesce("pieces", F.lit(1))).cast("int")
        self.links = bucketed(links.select(F.xxhash64("src", piece).alias("key"), "src", "dst", "times"), "key", self.buckets, label="links")
        rows = nodes.join(degree.select(F.col("src").alias("id"), "degree"), "id", "left")
        self.nodes = bucketed(rows, "id", self.buckets, label="nodes")
        self.count = self.nodes.count()

    def start(self, weight: Column) -> DataFrame:
        w = weight.cast("double")
        return bucketed(self.nodes.select("id", w.alias("w"), w.alias("old"), "degree"), "id", self.buckets, label="weights", placed=True)

    def step(self, weights: DataFrame, damping: float, restart: Column, lost: float) -> DataFrame:
        """``id, w, old, degree`` after a step in which each node also gets its part of the ``lost`` weight of dead ends."""
        sent = weights.where("degree > 0").select(F.col("id").alias("from"), (F.col("w") / F.col("degree")).alias("share"))
        piece = F.lit(0)
        if self.split:
            sent = sent.join(broadcast_if_small(self.hubs.withColumnRenamed("src", "from")), "from", "left")
            sent = sent.select("from", "share", F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1)).alias("piece"))
            piece = F.col("piece")
        moved = self.links.join(sent.withColumn("key", F.xxhash64("from", piece)), "key").where(F.col("src") == F.col("from"))
        moved = moved.groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("share") * F.col("times")).alias("m"))
        new = damping * F.coalesce("m", F.lit(0.0)) + restart + damping * lost / self.count
        before = weights.select("id", F.col("w").alias("old"))
        return self.nodes.join(moved, "id", "left").join(before, "id", "left").select("id", new.alias("w"), "old", "degree")

    def run(self, weights: DataFrame, damping: float, restart: Column, dead_ends: bool, steps: int | None, threshold: float, most: int, power: int = 1) -> DataFrame:
        """``steps`` steps, or else until the distance between two steps (L1 or L2 by ``power``) is under ``threshold``."""
        read = (F.coalesce(F.sum(F.when(F.col("degree").isNull(), F.col("w"))), F.lit(0.0)), F.coalesce(F.sum(F.pow(F.abs(F.col("w") - F.col("old")), F.lit(power))), F.lit(0.0)))
        lost = weights.agg(*read).first()[0] if dead_ends and self.count else 0.0
        for _ in range((steps if steps is not None else most) if self.count else 0):
            new = bucketed(self.step(weights, damping, restart, lost), "id", self.buckets, label="weights", placed=True)
            free(weights.scratch)
            weights, (dead, moved) = new, new.agg(*read).first()
            lost = dead if dead_ends else 0.0
            if steps is None and moved ** (1 / power) < threshold:
                break
        return weights.select("id", "w")


def pagerank(edges: DataFrame, nodes: DataFrame | None = None, steps: int | None = None, damping: float = DAMPING, chosen: Column | None = None) -> DataFrame:
    """``id, pagerank`` with a mean of 1. Links count with multiplicity, the mass of dead ends goes to all nodes alike.

    With ``chosen``, a condition on ``nodes``, only chosen nodes start with weight and get the restart share; ranks for
    disjoint choices add up to the rank for their union."""
    walk = _Walk(multiplicities(edges), (nodes if nodes is not None else nodes_of(edges)).dropDuplicates(["id"]))
    on = F.lit(1.0) if chosen is None else F.when(F.coalesce(chosen, F.lit(False)), 1.0).otherwise(0.0)
    weights = walk.run(walk.start(on), damping, (1 - damping) * on, True, steps, THRESHOLD * max(1, walk.count), MAX_STEPS)
    return weights.select("id", F.col("w").alias("pagerank"))


def rank_report(ranks: DataFrame, titles: DataFrame, top: int = 100) -> DataFrame:
    """``rank, id, title, pagerank``: the highest ranks, numbered from 1; equal ones by id. A page without a title keeps its number."""
    best = ranks.orderBy(F.desc("pagerank"), "id").limit(top)  # at most ``top`` rows from here on
    numbered = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("pagerank"), "id")))
    return numbered.join(titles.groupBy("id").agg(F.max("title").alias("title")), "id", "left").select("rank", "id", "title", "pagerank")


def uniform_rank(edges: DataFrame, nodes: DataFrame | None = None, steps: int = 40, damping: float = 0.99) -> DataFrame:
    """``id, weight`` with a sum of 1: distinct links, none to oneself, a fixed number of steps."""
    walk = _Walk(multiplicities(edges, distinct=True, self_links=False), (nodes if nodes is not None else nodes_of(edges)).select("id").distinct())
    n = max(1, walk.count)
    weights = walk.run(walk.start(F.lit(1.0 / n)), damping, F.lit((1 - damping) / n), True, steps, 0.0, steps)
    return weights.select("id", F.col("w").alias("weight"))


def markov(edges: DataFrame, threshold: float = 1e-6, most: int = 100, steps: int | None = None) -> DataFrame:
    """``id, weight``: stationary weights of a walk over distinct links, from 1 each; the mass of dead ends is lost."""
    walk = _Walk(multiplicities(edges, distinct=True), nodes_of(edges))
    weights = walk.run(walk.start(F.lit(1.0)), 1.0, F.lit(0.0), False, steps, threshold, most, power=2)
    return weights.select("id", F.col("w").alias("weight"))


def distances(edges: DataFrame, start: int | str) -> DataFrame:
    """``id, steps, parent``: links from ``start`` to each node that it reaches; of several parents the smallest."""
    links = cut(edges.where("src <> dst").select("src", "dst").distinct(), "links")
    first = nodes_of(edges).where(F.col("id") == F.lit(start)).select("id", F.lit(0).alias("steps"), F.lit(None).cast(links.schema["src"].dataType).alias("parent"))
    seen, steps = Rounds(first, "seen"), 0
    while not seen.last.isEmpty():
        steps += 1
        found = links.join(seen.last.select(F.col("id").alias("src")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        seen.add(found.join(seen.all().select("id"), "id", "left_anti").select("id", F.lit(steps).alias("steps"), "parent"))
    return seen.all()


def closeness_harmonic(edges: DataFrame, start: int | str) -> DataFrame:
    """One row ``closeness, harmonic``: nodes less one by the sum of distances to the nodes reached (infinite if none),
    and the mean of inverse distances over all other nodes."""
    n = nodes_of(edges).agg(F.count("*").alias("n"))
    far = distances(edges, start).where("steps > 0").agg(F.sum("steps").alias("far"), F.sum(1 / F.col("steps")).alias("near"))
    others = F.col("n") - 1
    return far.join(n).select(
        F.when(F.col("far").isNull(), F.lit(float("inf"))).otherwise(others / F.col("far")).alias("closeness"),
        F.when(others > 0, F.coalesce("near", F.lit(0.0)) / others).otherwise(0.0).alias("harmonic"),
    )


def shortest_path(edges: DataFrame, start: int | str, end: int | str) -> list:
    """The nodes of a shortest path with both ends, the smallest before each where several are as short; empty if there
    is none. With ``start`` equal to ``end`` it is a shortest circle without its last node; a link to oneself is none."""
    links = edges.where("src <> dst")
    if start == end:
        into = [r[0] for r in distances(links, start).join(links.where(F.col("dst") == F.lit(end)).select(F.col("src").alias("id")).distinct(), "id").orderBy("steps", "id").select("id").limit(1).collect()]
        return shortest_path(links, start, into[0]) if into and into[0] != start else []
    seen = distances(links, start)
    path, at = [end], end
    if seen.where(F.col("id") == F.lit(end)).isEmpty():
        return []
    while at != start:
        at = seen.where(F.col("id") == F.lit(at)).select("parent").first()[0]
        path.append(at)
    return path[::-1]


class DistanceCache:
    """Distances from nodes that have been asked for, each kept as a written table of the nodes that it reaches."""

    def __init__(self, edges: DataFrame):
        self.edges = cut(edges.where("src is not null and dst is not null").select("src", "dst").distinct(), "links")
        self.known: dict[int | str, DataFrame] = {}

    def distance(self, start: int | str, end: int | str) -> int | None:
        """Links on a shortest path, 0 from a node to itself, none if there is no path."""
        if start not in self.known:
            self.known[start] = cut(distances(self.edges, start), "distances")
        found = self.known[start].where(F.col("id") == F.lit(end)).first()
        return found["steps"] if found else None


def find_cycle(edges: DataFrame, start: int | str) -> list:
    return shortest_path(edges, start, start)


def reachable(edges: DataFrame) -> DataFrame:
    """``src, dst``: all pairs with a way from one to the other of at least one link. As large as the closure; new pairs
    only are joined in each round."""
    links = cut(edges.where("src is not null and dst is not null").select("src", "dst").distinct(), "links")
    onward = links.select(F.col("src").alias("dst"), F.col("dst").alias("next"))
    seen = Rounds(links, "reach")
    while not seen.last.isEmpty():
        further = seen.last.join(onward, "dst").select("src", F.col("next").alias("dst")).distinct()
        seen.add(further.join(seen.all(), ["src", "dst"], "left_anti"))
    return seen.all()


def two_hop_topics(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """``topic, roots``: from how many roots each node is one or two links away; links to oneself do not count."""
    links = edges.where("src <> dst").select("src", "dst").distinct()
    first = links.join(roots.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("src").alias("root"), F.col("dst").alias("topic"))
    second = first.join(links.select(F.col("src").alias("topic"), F.col("dst").alias("next")), "topic").select("root", F.col("next").alias("topic"))
    return first.unionByName(second).where("root <> topic").distinct().groupBy("topic").agg(F.count("*").alias("roots"))
