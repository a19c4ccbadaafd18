"""Queries of the problems of training text (2, 3, 4, 8, 9, 10) and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesselark.llm import byte_bpe, leaks, markup, personal, subjects, term_counts
from tesselark.runtime import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return term_counts.term_frequencies(table(spark, d, "frequency_maps")).where("mark is not null").select("term", "mark")


def p2_terms(spark: SparkSession, d: str) -> DataFrame:
    """Every term with its total count, the pages that hold it, and its mark."""
    return term_counts.term_frequencies(table(spark, d, "frequency_maps"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.found_kinds(table(spark, d, "page_texts"))


def p3_clean(spark: SparkSession, d: str) -> DataFrame:
    """The pages in clean text, without branches of low importance."""
    return markup.clean_pages(table(spark, d, "page_texts"))


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subjects(table(spark, d, "page_word_bags"), table(spark, d, "word_dictionary"), table(spark, d, "classified_articles"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).select("id", "classification")


def p4_composition(spark: SparkSession, d: str) -> DataFrame:
    """How much of the corpus each subject makes up."""
    return subjects.composition(_subjects(spark, d), table(spark, d, "class_names"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return byte_bpe.encode_column(table(spark, d, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_spans(spark: SparkSession, d: str) -> DataFrame:
    """The spans of words to remove from each document."""
    return leaks.leaked_spans(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.found_kinds(table(spark, d, "documents"))


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The documents with typed placeholders."""
    return personal.redacted(table(spark, d, "documents")).select("doc_id", "text")


QUERIES = {f.__name__: f for f in (p2_found, p2_terms, p3_found, p3_clean, p4_found, p4_composition, p8_ids, p9_found, p9_spans, p10_found, p10_redacted)}

_TERMS = r"""
WITH entries AS (
  SELECT DISTINCT id, u.key AS form, u.value AS n FROM frequency_maps, unnest(map_entries(words)) AS t(u) WHERE id IS NOT NULL AND u.value > 0
), pairs AS (
  SELECT nullif(regexp_replace(lower(form), '^[\s''’]+|[\s''’]+$', '', 'g'), '') AS term, id, n FROM entries
), terms AS (
  SELECT term, cast(sum(n) AS bigint) AS occurrences, count(DISTINCT id) AS records FROM pairs WHERE term IS NOT NULL GROUP BY term
), marked AS (
  SELECT *, CASE WHEN records < 3 THEN 'rare' WHEN records * 5 > 2 * (SELECT count(DISTINCT id) FROM pairs WHERE term IS NOT NULL) THEN 'common' END AS mark FROM terms
)
"""

SQL = {
    "p2_found": _TERMS + "SELECT term, mark FROM marked WHERE mark IS NOT NULL",
    "p2_terms": _TERMS + "SELECT term, occurrences, records, mark FROM marked",
}
