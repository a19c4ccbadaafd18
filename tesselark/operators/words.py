"""Word counts, frequency tables, dictionaries, word bags and n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselark.functions import nlp
from tesselark.runtime import bounded_collect, broadcast_if_small, cut, shuffle_partitions

#: An n-gram is kept if it occurs so often.
NGRAM_COUNT = 40
MAX_DICTIONARY = 5_000_000


def word_counts(pages: DataFrame, tokens: Column) -> DataFrame:
    """``word, count``."""
    return pages.select(F.explode(tokens).alias("word")).groupBy("word").agg(F.count("*").alias("count"))


def at_least(table: DataFrame, least: int) -> DataFrame:
    return table.where(F.col("count") >= least)


def ranked(table: DataFrame) -> DataFrame:
    """A frequency table in order: counts descending, words ascending."""
    return table.orderBy(F.desc("count"), "word")


def pair_counts(pages: DataFrame, tokens: Column, known: DataFrame | None = None, least_words: int = 2) -> DataFrame:
    """``word, count`` of adjacent tokens joined by a space; both must be known if a table of words is given."""
    # tokens are a column of their own, so that they are worked out once per page
    rows = pages.select(tokens.alias("tokens")).select(F.explode(nlp.pairs(F.col("tokens"))).alias("p")).select("p.left", "p.right").groupBy("left", "right").agg(F.count("*").alias("count"))
    if known is not None:
        names = broadcast_if_small(known.select("word").distinct())
        rows = rows.join(names.withColumnRenamed("word", "left"), "left", "left_semi").join(names.withColumnRenamed("word", "right"), "right", "left_semi")
    joined = rows.select(F.concat_ws(" ", "left", "right").alias("word"), "count")
    return joined.where(F.size(F.split("word", " ")) >= least_words).groupBy("word").agg(F.sum("count").alias("count"))


def prefix_dictionary(table: DataFrame) -> DataFrame:
    """``word``: all n-grams and their prefixes."""
    return table.select(F.explode(nlp.prefixes(F.col("word"))).alias("word")).distinct()


def ordinals(table: DataFrame) -> DataFrame:
    """``word, ordinal``: words numbered from 1 by descending count; a word that occurs twice keeps its later number. The
    table is sorted in ranges and numbered within each; the sizes of the ranges before it (one number per range) are added."""
    ranges = shuffle_partitions(table.sparkSession)
    ordered = table.repartitionByRange(ranges, F.desc("count"), "word").sortWithinPartitions(F.desc("count"), "word")
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = cut(ordered.select("word", F.spark_partition_id().alias("range"), within.alias("at")), "ordered")
    sizes = {r["range"]: r["count"] for r in rows.groupBy("range").count().collect()}
    before, total = [], 0
    for k in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(k, 0)
    offset = F.get(F.array(*(F.lit(x).cast("long") for x in before)), F.col("range")) if before else F.lit(0).cast("long")
    return rows.groupBy("word").agg(F.max((offset + F.col("at") + 1).cast("int")).alias("ordinal"))


def report_order(table: DataFrame) -> DataFrame:
    """A table of n-grams in the order of its report: fewest words first, then counts descending, words ascending."""
    return table.orderBy(F.size(F.split("word", " ")), F.desc("count"), "word")


def word_bags(pages: DataFrame, tokens: Column, dictionary: DataFrame, by_line: bool = False) -> DataFrame:
    """``id, words``: the known words of each page, ``array<struct<word, count>>`` by word number. ``tokens`` is an expression over
    ``text``; ``by_line`` applies it to each line by itself, so that no n-gram reaches over the end of a line."""
    if by_line:
        pages = pages.select("id", F.explode(F.split("text", "\n")).alias("text"))
    rows = pages.select("id", F.explode(tokens).alias("word")).groupBy("id", "word").agg(F.count("*").alias("count"))
    known = broadcast_if_small(dictionary.select("word", F.col("ordinal").cast("long").alias("ordinal")))
    bags = rows.join(known, "word").groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.col("ordinal").alias("word"), "count"))).alias("words"))  # as many as a page has words
    return bags


def union_tables(*tables: DataFrame) -> DataFrame:
    """Frequency tables one after another; equal words are not merged."""
    out = tables[0].select("word", "count")
    for t in tables[1:]:
        out = out.unionByName(t.select("word", "count"))
    return out


def discover_ngrams(pages: DataFrame, tokens: Column, least: int = NGRAM_COUNT, passes: int | None = None) -> DataFrame:
    """``word, count``: words and n-grams that occur at least ``least`` times. Each pass tokenizes with the n-grams known
    so far and keeps frequent pairs of known tokens (n-grams or their prefixes) of at least 1, 2, 4, 8 ... words; the count of an n-gram is that of
    the last pass that made it. Ends when a pass finds nothing new."""
    rows = cut(pages.select(F.explode(F.split("text", "\n")).alias("text")).select(tokens.alias("words")).where("size(words) > 0"), "lines")
    known = cut(at_least(word_counts(rows, F.col("words")), least), "ngrams")
    size, n, done = known.count(), 1, 0
    while passes is None or done < passes:
        dictionary = cut(prefix_dictionary(known), "prefixes")
        names = [r[0] for r in bounded_collect(dictionary, MAX_DICTIONARY, "the dictionary of n-grams")]
        cut_tokens = nlp.ngram_tokens(pages.sparkSession, names, MAX_DICTIONARY)(F.col("words"))
        found = at_least(pair_counts(rows, cut_tokens, dictionary, max(2, n)), least)
        known = cut(known.join(found.select("word"), "word", "left_anti").unionByName(found), "ngrams")
        grown, done, n = known.count(), done + 1, n * 2
        if grown == size:
            break
        size = grown
    return known
