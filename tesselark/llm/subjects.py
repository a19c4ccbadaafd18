"""Subject areas of documents by clustering their word vectors.

Documents are vectors of their words, weighted by rarity and normalised. Bisecting k-means splits them into leaves. A leaf
is labelled by its discriminative terms: terms that the seed documents of a class use more than the corpus vote, in the measure
in which the leaf uses them more. What a leaf says is then taken apart by expectation maximisation: each leaf is a mixture of
subjects and of common speech, each subject a distribution over terms, so that the leaves that share a subject sharpen its
terms and leaves of two subjects come apart. A document, in turn, is a mixture of these components, fitted from the mixture of
its own leaf, and has every subject that holds a good part of its words; it can have several or none.

Nothing of the size of the documents, nor of leaves times words, is on the driver: terms with their counts per leaf are a
table, each round of fitting is one pass over it, and only mixtures (leaves times subjects) come back. The terms of
the subjects (words times subjects, 4 bytes each) are broadcast for the last pass; ``MAX_VOCABULARY`` bounds them. Vectors, document
frequencies, clusters and counts cover all documents; all seed labels are used.

Defined results: several rows of one page count as one (the largest bag); words that are unknown (0 or not in the
dictionary), function words, and counts that are null or below one say nothing; a word twice in a bag counts with the
sum; null and empty bags have no subject; without seeds or documents there are no subjects.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tesselark.runtime import Latest, bounded_collect, broadcast_if_small, cut, scratch_path

#: The first words of the dictionary are function words.
FUNCTION_WORDS = 55
#: Leaves, and rounds of k-means per level. Leaves follow the subjects that are to be told apart, not the number of documents.
LEAVES, ROUNDS = 192, 2
#: Dimensions in which documents are clustered: a word has its own if the dictionary is not larger, else shares one.
DIMENSIONS = 1 << 16
#: Rounds in which leaves are taken apart, and in which a document is.
LEAF_ROUNDS, PAGE_ROUNDS = 8, 16
#: Words of the dictionary, whose terms are broadcast; a larger one has to be given in parts.
MAX_VOCABULARY = 2_000_000
#: A subject needs so many words of a document, so much of all its words and so much of those of all subjects.
LEAST_WORDS, LEAST_OF_ALL, LEAST_OF_TOPICAL = 4, 0.12, 0.2
#: Pages fitted at once.
AT_ONCE = 1024


def clean_bags(bags: DataFrame, words: list[int]) -> DataFrame:
    """``id, words, counts``: one row per page, its words in order without repeats. ``words`` are the words that count."""
    known = bags.sparkSession.sparkContext.broadcast(np.array(sorted(words), np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            values = lists.flatten()
            word = values.field("word").fill_null(0).to_numpy(zero_copy_only=False)
            count = values.field("count").fill_null(0).to_numpy(zero_copy_only=False)
            size = np.asarray(lists.value_lengths().fill_null(0))
            page = np.repeat(np.arange(len(size)), size)
            at = np.minimum(np.searchsorted(known.value, word), max(0, len(known.value) - 1))
            keep = (count > 0) & (known.value[at] == word) if len(known.value) else np.zeros(len(word), bool)
            page, word, count = page[keep], word[keep], count[keep]
            by = np.lexsort((word, page))
            page, word, count = page[by], word[by], count[by]
            first = np.flatnonzero(np.append(True, (page[1:] != page[:-1]) | (word[1:] != word[:-1]))) if len(page) else np.zeros(0, int)
            total = np.add.reduceat(count, first) if len(first) else count
            ends = pa.array(np.append(0, np.cumsum(np.bincount(page[first], minlength=len(size)))).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(ends, pa.array(word[first])), pa.ListArray.from_arrays(ends, pa.array(total))], names=["id", "words", "counts"]
            )

    one = bags.where("id is not null").groupBy("id").agg(F.max("words").alias("words"))
    return one.select("id", F.coalesce("words", F.array().cast(one.schema["words"].dataType)).alias("words")).mapInArrow(run, "id long, words array<long>, counts array<long>")


def vectors_of(pages: DataFrame, words: list[int]) -> DataFrame:
    """``id, words, counts, features``: the pages that have words, with their vectors of words weighted by rarity and normalised;
    written once."""
    spark, size = pages.sparkSession, min(DIMENSIONS, len(words))
    known = np.array(words, np.int64)
    spoken = pages.where("size(words) > 0")
    held = spoken.select(F.explode("words").alias("word")).groupBy("word").count().toArrow()  # one row per word
    frequency = np.bincount(np.searchsorted(known, held.column("word").to_numpy()) % size, held.column("count").to_numpy(), minlength=size)
    shared = spark.sparkContext.broadcast((known, np.log((spoken.count() + 1) / (frequency + 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, idf = shared.value
        for batch in batches:
            sizes = np.asarray(batch.column(1).value_lengths())
            page = np.repeat(np.arange(len(sizes)), sizes)
            at = np.searchsorted(known, batch.column(1).flatten().to_numpy()) % size
            key, back = np.unique(page * size + at, return_inverse=True)
            page, at = key // size, key % size
            weight = np.bincount(back, batch.column(2).flatten().to_numpy(), minlength=len(key)) * idf[at]
            norm = np.sqrt(np.bincount(page, weight**2, minlength=len(sizes)))
            weight /= np.where(norm > 0, norm, 1)[page]
            ends = pa.array(np.searchsorted(page, np.arange(len(sizes) + 1)).astype(np.int32))
            parts = [np.zeros(len(sizes), np.int8), np.full(len(sizes), size, np.int32)]
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (at.astype(np.int32), weight)]
            vector = pa.StructArray.from_arrays([*map(pa.array, parts), *lists], names=["type", "size", "indices", "values"])
            yield pa.RecordBatch.from_arrays([*batch.columns, vector], names=["id", "words", "counts", "features"])

    schema = "id long, words array<long>, counts array<long>"
    rows = spoken.select("id", "words", "counts").mapInArrow(run, f"{schema}, features struct<type:tinyint,size:int,indices:array<int>,values:array<double>>")
    path = scratch_path(spark, "vectors")
    rows.write.parquet(path)
    # the type of a vector is this struct by another name
    typed = StructType([*StructType.fromDDL(schema).fields, StructField("features", VectorUDT())])
    return spark.read.schema(typed).parquet(path)


def leaves_of(pages: DataFrame, words: list[int], leaves: int = LEAVES) -> DataFrame:
    """``id, words, counts, leaf``: bisecting k-means over the vectors of all pages that have words."""
    vectors = vectors_of(pages, words)
    model = BisectingKMeans(k=leaves, maxIter=ROUNDS, seed=7, featuresCol="features", predictionCol="leaf", minDivisibleClusterSize=12.0).fit(vectors)
    return model.transform(vectors).select("id", "words", "counts", "leaf")


def _log_odds(counts: np.ndarray, totals: np.ndarray, overall: np.ndarray, whole: float, words: int) -> np.ndarray:
    """How much commoner each word (row) is in each group (column) than overall, as a logarithm; ``totals`` and ``whole`` are
    sums over all words, of which there are ``words``."""
    share = (counts + 0.02) / (totals + 0.02 * words)
    return np.log(share + 1e-7) - np.log((overall + 1) / (whole + words) + 1e-7)[:, None]


def fit_mixture(page: np.ndarray, count: np.ndarray, spoken: np.ndarray, mixture: np.ndarray, rounds: int = PAGE_ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The mixtures of components that pages are, and their words of each component. ``spoken`` has for each word of each page
    (in the order of pages) how likely each component says it; ``mixture`` is where pages start from."""
    start = np.flatnonzero(np.append(True, page[1:] != page[:-1]))
    who = page[start]
    held = np.zeros_like(mixture)
    for _ in range(rounds):
        part = mixture[page] * spoken
        part *= (count / np.maximum(part.sum(1), 1e-30))[:, None]
        held[who] = np.add.reduceat(part, start)
        mixture = held / np.maximum(held.sum(1, keepdims=True), 1e-30)
    return mixture, held


def _dense(lists: pa.Array, values: pa.Array, width: int) -> np.ndarray:
    """Lists of columns and of their values as a matrix."""
    out = np.zeros((len(lists), width))
    out[np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths())), lists.flatten().to_numpy()] = values.flatten().to_numpy()
    return out


class TermTable:
    """Terms with the pages of each leaf and of each class's seeds that hold them, and what the components say of each term."""

    def __init__(self, grouped: DataFrame, labels: DataFrame, leaves: int, classes: list[int]):
        self.leaves, self.classes = leaves, classes
        number = F.array_position(F.array(*(F.lit(c) for c in classes)), F.col("classification")).cast("int") - 1
        pair = grouped.select("leaf", F.explode("words").alias("word")).groupBy("word", "leaf").count()
        by_leaf = pair.groupBy("word").agg(F.collect_list("leaf").alias("leaf"), F.collect_list("count").alias("n"))  # as many as leaves
        seed = grouped.join(broadcast_if_small(labels), "id").select(number.alias("c"), F.explode("words").alias("word")).groupBy("word", "c").count()
        by_class = seed.groupBy("word").agg(F.collect_list("c").alias("c"), F.collect_list("count").alias("m"))  # as many as classes
        empty = F.array().cast("array<int>")
        rows = by_leaf.join(by_class, "word", "left").select("word", "leaf", "n", F.coalesce("c", empty).alias("c"), F.coalesce("m", empty.cast("array<long>")).alias("m"))
        self.rows = cut(rows, "terms")
        sums = self._pass(lambda leaf, seed, _: {"leaf": leaf.sum(0), "seed": seed.sum(0), "words": np.array([len(leaf)])}, self.rows)
        self.leaf_total, self.seed_total, self.words = sums["leaf"], sums["seed"], int(sums["words"][0])

    def _run(self, step, keep: bool):
        """A function over batches of terms: ``step`` takes counts per leaf, counts per class and what is said of each term, and gives
        sums over the terms and, with ``keep``, what is said of each term now. Sums come out once per task, as the last row."""
        leaves, classes, width = self.leaves, len(self.classes), 4096

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[str, np.ndarray] = {}
            for whole in batches:
                for at in range(0, whole.num_rows, width):
                    batch = whole.slice(at, width)
                    said = batch.column(5).flatten().to_numpy().reshape(batch.num_rows, classes + 1) if batch.num_columns > 5 else None
                    got = step(_dense(batch.column(1), batch.column(2), leaves), _dense(batch.column(3), batch.column(4), classes), said)
                    new = got.pop("said", None)
                    for k, v in got.items():
                        total[k] = total[k] + v if k in total else v
                    if keep:
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, new.size + 1, classes + 1, dtype=np.int32)), pa.array(new.ravel()))
                        names = pa.array([None] * len(new), pa.list_(pa.string()))
                        yield pa.RecordBatch.from_arrays([*batch.columns[:5], lists, names, pa.array([None] * len(new), pa.list_(pa.float64()))], names=["word", "leaf", "n", "c", "m", "said", "name", "total"])
            if total:
                names = [f"{k}:{','.join(map(str, v.shape))}" for k, v in total.items()]
                last = [pa.array([None], t) for t in (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.float64()))]
                sums = np.concatenate([np.ravel(v).astype(float) for v in total.values()])
                yield pa.RecordBatch.from_arrays([*last, pa.array([names], pa.list_(pa.string())), pa.array([sums], pa.list_(pa.float64()))], names=["word", "leaf", "n", "c", "m", "said", "name", "total"])

        return run

    def _pass(self, step, rows: DataFrame, keep: bool = False) -> dict[str, np.ndarray]:
        """One pass over the terms; the sums of all tasks."""
        columns = ["word", "leaf", "n", "c", "m"]
        done = rows.select(*columns, *(["said"] if "said" in rows.columns else [])).mapInArrow(
            self._run(step, keep), "word long, leaf array<int>, n array<long>, c array<int>, m array<long>, said array<double>, name array<string>, total array<double>"
        )
        if keep:
            self.said.replace(done) if hasattr(self, "said") else setattr(self, "said", Latest(done, "said"))
            done = self.said.df.where("name is not null")
        out: dict[str, np.ndarray] = {}
        for r in done.select("name", "total").toArrow().to_pylist():  # one row per task
            at = 0
            for name in r["name"]:
                key, _, shape = name.partition(":")
                dims = [int(x) for x in shape.split(",")]
                size = int(np.prod(dims))
                part = np.array(r["total"][at : at + size]).reshape(dims)
                out[key], at = out.get(key, 0) + part, at + size
        return out

    def fit(self) -> tuple[np.ndarray, np.ndarray]:
        """The mixture of components that each leaf is, and the sum of what each component says over all terms. Component 0 is common
        speech, component k the k-th class."""
        leaf_total, seed_total, words = self.leaf_total, self.seed_total, self.words
        overall_total = leaf_total.sum()

        def vote(leaf: np.ndarray, seed: np.ndarray, _) -> dict[str, np.ndarray]:
            overall = leaf.sum(1)
            of_seeds = np.maximum(_log_odds(seed, seed_total, overall, overall_total, words), 0) * np.minimum(seed / 3, 1)
            of_leaves = np.maximum(_log_odds(leaf, leaf_total, overall, overall_total, words), 0)
            return {"votes": of_leaves.T @ of_seeds, "norm": (of_seeds**2).sum(0)}

        got = self._pass(vote, self.rows)
        votes = got["votes"] / np.maximum(np.sqrt(got["norm"]), 1e-9)
        label = np.where(votes >= 0.5 * votes.max(1, keepdims=True), votes, 0) ** 2
        label /= np.maximum(label.sum(1, keepdims=True), 1e-9)

        def begin(leaf: np.ndarray, _, __) -> dict[str, np.ndarray]:
            overall = leaf.sum(1)
            own = leaf * (_log_odds(leaf, leaf_total, overall, overall_total, words) > 0.5)  # discriminative terms of each leaf
            said = np.concatenate([overall[:, None], own @ label], 1)
            return {"said": said, "sum": said.sum(0)}

        mixture = np.concatenate([np.full((self.leaves, 1), 0.5), 0.5 * label], 1)
        total = self._pass(begin, self.rows, True)["sum"]
        for _ in range(LEAF_ROUNDS):

            def step(leaf: np.ndarray, _, said: np.ndarray, mixture=mixture, total=total) -> dict[str, np.ndarray]:
                said = likelihood(said, total, words)
                ratio = leaf / np.maximum(said @ mixture.T, 1e-12)
                new = said * (ratio @ mixture)
                return {"said": new, "sum": new.sum(0), "mixture": mixture * (ratio.T @ said)}

            got = self._pass(step, self.said.df.where("name is null"), True)
            total, mixture = got["sum"], got["mixture"] / np.maximum(got["mixture"].sum(1, keepdims=True), 1e-12)
        return mixture, total


def likelihood(said: np.ndarray, total: np.ndarray, words: int) -> np.ndarray:
    """How likely each component says each term."""
    return (said + 1e-6) / (total + 1e-6 * words)


def subjects(bags: DataFrame, dictionary: DataFrame, seeds: DataFrame, leaves: int = LEAVES) -> DataFrame:
    """``id, classification, share``: the subjects of each page, with their shares of the words of all its subjects."""
    words = sorted(r[0] for r in bounded_collect(dictionary.select("ordinal").where(f"ordinal > {FUNCTION_WORDS}").distinct(), MAX_VOCABULARY, "the dictionary"))
    nothing = bags.sparkSession.createDataFrame([], "id long, classification int, share double")
    if not words:
        return nothing
    pages = cut(clean_bags(bags, words), "pages")
    labels = seeds.where("classification > 0 and id is not null").select("id", F.col("classification").cast("int").alias("classification")).distinct()
    known_labels = labels.join(pages.where("size(words) > 0").select("id"), "id", "left_semi")
    classes = sorted(r[0] for r in known_labels.select("classification").distinct().collect())  # one row per class
    if not classes:
        return nothing
    grouped = cut(leaves_of(pages, words, leaves), "leaves")
    terms = TermTable(grouped, labels, grouped.agg(F.max("leaf")).first()[0] + 1, classes)
    mixture, total = terms.fit()
    said = terms.said.df.where("name is null").select("word", "said").toArrow()
    order = np.argsort(said.column("word").to_numpy())
    table = likelihood(said.column("said").combine_chunks().flatten().to_numpy().reshape(-1, len(classes) + 1)[order], total, terms.words).astype(np.float32)
    shared = bags.sparkSession.sparkContext.broadcast((said.column("word").to_numpy()[order], table, (0.5 * mixture + 0.5 / mixture.shape[1]).astype(np.float32), np.array(classes, np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table, mixture, classes = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(at, AT_ONCE)
                size = np.asarray(batch.column(1).value_lengths())
                page = np.repeat(np.arange(len(size)), size)
                word = np.searchsorted(known, batch.column(1).flatten().to_numpy())
                count = batch.column(2).flatten().to_numpy().astype(np.float32)
                part, held = fit_mixture(page, count, table[word], mixture[batch.column(3).to_numpy()])
                part, held = part[:, 1:], held[:, 1:]
                topical = part.sum(1)
                has = (held >= LEAST_WORDS) & (part >= LEAST_OF_ALL) & (part >= LEAST_OF_TOPICAL * topical[:, None])
                p, c = np.nonzero(has)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(p)), pa.array(classes[c]), pa.array((part[p, c] / topical[p]).astype(float))], names=["id", "classification", "share"])

    return grouped.mapInArrow(run, "id long, classification int, share double")


def composition(found: DataFrame, names: DataFrame) -> DataFrame:
    """``classification, class_name, pages, share``: how the corpus is made up; a page with several subjects counts in
    parts."""
    parts = found.groupBy("classification").agg(F.count("*").alias("pages"), F.sum("share").alias("weight"))
    total = parts.select(F.sum("weight").alias("total"))  # one row
    rows = parts.join(broadcast_if_small(names), "classification").join(F.broadcast(total))
    return rows.select("classification", "class_name", "pages", (F.col("weight") / F.col("total")).alias("share"))
