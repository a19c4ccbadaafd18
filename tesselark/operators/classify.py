"""Classes of pages: naive Bayes over word bags, and the classes of categories above them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselark.runtime import Latest, broadcast_if_small, bucketed, cut, shuffle_partitions

#: Smoothing of every count, and the first word number that says something.
BASE_COUNT, FIRST_WORD, CLASSES = 5, 55, 20
#: Articles that stand for the classes.
SEEDS = {
    13692155: 1, 22921: 2, 25414: 3, 10772350: 4, 18963910: 5, 26781: 6, 24388: 7, 18949668: 8, 9252: 9, 18839: 10, 90317: 11,
    23193: 12, 22760983: 12, 18963870: 13, 26700: 14, 22939: 14, 25202: 14, 18957: 15, 627: 16, 29816: 17, 86586: 18, 149354: 19,
}


def seed_labels(spark) -> DataFrame:
    return spark.createDataFrame(list(SEEDS.items()), "id long, classification int")


def _exploded(bags: DataFrame) -> DataFrame:
    rows = bags.select("id", F.explode("words").alias("w")).select("id", "w.word", "w.count")
    return rows.where("word > 0 and count > 0")


def train_bayes(bags: DataFrame, labels: DataFrame, dictionary: DataFrame, classes: int = CLASSES) -> DataFrame:
    """``word, logp``: per word the logarithms of its probabilities in classes 0, 1, ..., less the largest; without
    priors; words with small numbers are the function words and say nothing."""
    counts = _exploded(bags.join(broadcast_if_small(labels.select("id", "classification")), "id", "left_semi")).join(broadcast_if_small(labels.select("id", "classification")), "id")
    per_word = counts.groupBy("word").agg(*(F.sum(F.when(F.col("classification") == c, F.col("count")).otherwise(0)).alias(f"n{c}") for c in range(classes)))
    totals = counts.groupBy().agg(*(F.coalesce(F.sum(F.when(F.col("classification") == c, F.col("count"))), F.lit(0)).alias(f"t{c}") for c in range(classes)), F.lit(1).alias("one"))  # one row
    size = dictionary.agg(F.count("*").alias("size"))  # one row
    rows = dictionary.select(F.col("ordinal").alias("word")).join(per_word, "word", "left").join(F.broadcast(totals)).join(F.broadcast(size))
    logs = F.array(*(F.ln((F.coalesce(f"n{c}", F.lit(0)) + BASE_COUNT) / (BASE_COUNT * F.col("size") + F.col(f"t{c}"))) for c in range(classes)))
    rows = rows.select("word", logs.alias("l"))
    quiet = F.transform("l", lambda x: F.lit(0.0))
    return rows.select("word", F.when(F.col("word") < FIRST_WORD, quiet).otherwise(F.transform("l", lambda x: x - F.array_max("l"))).alias("logp"))


def classify_bayes(bags: DataFrame, model: DataFrame, classes: int = CLASSES) -> DataFrame:
    """``id, classes``: ``array<struct<p, classification>>``, the likeliest first; class 0 is never chosen. The model has
    one row per dictionary word and joins once per word of a page, not once per class."""
    rows = _exploded(bags).join(model, "word")
    sums = rows.groupBy("id").agg(*(F.sum(F.col("count") * F.get("logp", F.lit(c))).alias(f"s{c}") for c in range(1, classes)))
    scores = F.array(*(F.struct(F.col(f"s{c}").alias("p"), F.lit(c).alias("classification")) for c in range(1, classes)))
    best = F.array_max(F.transform("scores", lambda s: s["p"]))
    exp = F.transform("scores", lambda s: F.struct(F.exp(s["p"] - best).alias("p"), s["classification"].alias("classification")))
    rows = sums.select("id", scores.alias("scores")).select("id", exp.alias("e"))
    whole = F.aggregate("e", F.lit(0.0), lambda a, x: a + x["p"])
    return rows.select("id", F.reverse(F.array_sort(F.transform("e", lambda x: F.struct((x["p"] / whole).alias("p"), (-x["classification"]).alias("c"))))).alias("r")).select(
        "id", F.transform("r", lambda x: F.struct(x["p"].alias("p"), (-x["c"]).alias("classification"))).alias("classes")
    )


def ancestor_classes(parents: DataFrame, labels: DataFrame) -> DataFrame:
    """``id, classes``: the classes of each page itself and of all categories above it, as a sorted array. Classes are bits of
    numbers that go down from parents to children, as long as they bring a child something new: as many rounds as the
    hierarchy is deep, in each of which only what is new moves. Circles do no harm."""
    names = sorted(r[0] for r in labels.where("classification is not null").select("classification").distinct().collect())  # one row per class
    if not names:
        return parents.sparkSession.createDataFrame([], f"id {parents.schema['id'].dataType.simpleString()}, classes array<int>")
    at = F.array_position(F.array(*(F.lit(c) for c in names)), F.col("classification")).cast("int") - 1
    width = -(-len(names) // _BITS)
    masks = [f"m{k}" for k in range(width)]
    bits = [F.bit_or(F.when(F.floor(at / _BITS) == k, F.expr(f"shiftleft(1L, cast(pmod({_place(names)}, {_BITS}) as int))")).otherwise(F.lit(0).cast("long"))).alias(m) for k, m in enumerate(masks)]
    buckets = shuffle_partitions(parents.sparkSession)
    links = bucketed(parents.where("id is not null and parent is not null").select("id", "parent").distinct(), "parent", buckets, label="parents")
    own = labels.where("classification is not null").groupBy("id").agg(*bits)
    nodes = links.select("id").unionByName(links.select(F.col("parent").alias("id"))).distinct()
    state = Latest(nodes.join(own, "id", "left").select("id", *(F.coalesce(m, F.lit(0).cast("long")).alias(m) for m in masks), F.lit(True).alias("new")), "masks")
    while not state.df.where("new").isEmpty():
        sent = state.df.where("new").select(F.col("id").alias("parent"), *masks)
        got = links.join(sent, "parent").groupBy("id").agg(*(F.bit_or(m).alias(f"{m}_got") for m in masks))
        merged = [F.col(m).bitwiseOR(F.coalesce(f"{m}_got", F.lit(0).cast("long"))) for m in masks]
        grown = F.lit(False)
        for m, new in zip(masks, merged, strict=True):
            grown = grown | (new != F.col(m))
        state.replace(state.df.drop("new").join(got, "id", "left").select("id", *(x.alias(m) for m, x in zip(masks, merged, strict=True)), grown.alias("new")))
    held = F.array_compact(F.array(*(F.when(F.col(masks[i // _BITS]).bitwiseAND(F.lit(1 << (i % _BITS))) != 0, F.lit(c)) for i, c in enumerate(names))))
    rows = state.df.join(links.select("id").distinct(), "id", "left_semi").select("id", held.alias("classes"))
    return rows.where("size(classes) > 0")


#: Bits of a number that stand for classes.
_BITS = 62


def _place(names: list) -> str:
    """The place of a class among all, as SQL."""
    return f"(array_position(array({', '.join(map(str, names))}), classification) - 1)"


def classified_titles(classified: DataFrame, titles: DataFrame) -> DataFrame:
    """``id, title, classification``; a classified page without a title is an error."""
    rows = cut(classified.where("id is not null").join(titles.select("id", "title"), "id", "left"), "classified")
    if missing := rows.where("title is null").select("id").first():
        raise KeyError(f"no title for the classified page {missing[0]}")
    return rows.select("id", "title", "classification")


def category_sets(page_categories: DataFrame) -> DataFrame:
    """``id, categories``: the sorted distinct parents of each page over all its rows."""
    rows = page_categories.select("id", F.explode("categories").alias("parent")).where("parent is not null").distinct()
    return rows.groupBy("id").agg(F.array_sort(F.collect_set("parent")).alias("categories"))
