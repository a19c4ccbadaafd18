"""Dumps of articles (XML) and of linked-data entities (JSON lines)."""

from __future__ import annotations

import re
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tesselark.schemas import DUMP_PAGE, RAW_ENTITY
from tesselark.sources.tables import counted

#: Names of published dump files.
_ARTICLES = re.compile(r"wiki-(\d+)-pages-articles-multistream(\d*)\.xml(?:-p(\d+)p(\d+))?(?:\.bz2)?$")
_INDEX = re.compile(r"wiki-(\d+)-pages-articles-multistream-index(\d*)\.txt(?:-p(\d+)p(\d+))?(?:\.bz2)?$")
_ENTITIES = re.compile(r"-(\d{8})-all\.json(?:\.bz2|\.gz)?$")


@dataclass(frozen=True)
class DumpName:
    date: str
    shard: str
    pages: tuple[int, int] | None

    @property
    def corpus(self) -> str:
        return f"{self.date}.{self.shard}" if self.shard else self.date


def _name(path: str, pattern: re.Pattern[str]) -> DumpName:
    m = pattern.search(PurePosixPath(path).name)
    if not m:
        raise ValueError(f"{path} is not the name of a dump")
    return DumpName(m[1], m[2], (int(m[3]), int(m[4])) if m[3] else None)


def corpus_of(articles: str, index: str | None = None) -> str:
    """The corpus that a dump belongs to, from its file name; the index must be of the same date and shard."""
    name = _name(articles, _ARTICLES)
    if index is not None:
        other = _name(index, _INDEX)
        if (name.date, name.shard) != (other.date, other.shard):
            raise ValueError(f"{articles} and {index} are of different dumps")
    return name.corpus


def entity_corpus(path: str) -> str:
    """The article corpus that an entity dump goes with: its date, with 1 for the last digit."""
    m = _ENTITIES.search(PurePosixPath(path).name)
    if not m:
        raise ValueError(f"{path} is not the name of an entity dump")
    return m[1][:-1] + "1"


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """``offset, page_id, title`` of a dump's index; bzip2 by its name."""
    if not re.search(r"\.txt(-p\d+p\d+)?(\.bz2)?$", path):
        raise ValueError(f"{path} is neither text nor compressed text")
    parts = F.split("value", ":", 3)
    return spark.read.text(path).select(parts[0].cast("long").alias("offset"), parts[1].cast("long").alias("page_id"), parts[2].alias("title"))


def stream_offsets(index: DataFrame) -> DataFrame:
    return index.select("offset").distinct()


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """All pages of XML dumps as :data:`DUMP_PAGE`.

    Text is split at the ends of pages, so that one compressed file feeds many tasks; each page is parsed on its own.
    This is safe because ``<`` is escaped inside of texts."""
    lines = spark.read.option("lineSep", "</page>").text(path)
    at = F.instr("value", "<page>")
    pages = lines.where(at > 0).select(F.concat(F.expr("substring(value, instr(value, '<page>'))"), F.lit("</page>")).alias("value"))
    parsed = F.from_xml("value", DUMP_PAGE, {"ignoreSurroundingSpaces": "false", "rowTag": "page"})
    rows = pages.select(parsed.alias("p")).select("p.*")
    return rows.withColumn("title", F.trim("title"))


def articles(dump: DataFrame, namespaces: list[int] = (0,)) -> DataFrame:
    """``id, title, text`` of pages in the namespaces that do not redirect."""
    kept = dump.where(F.col("ns").isin(list(namespaces)))
    return kept.where(F.coalesce("redirect._title", F.lit("")) == "").select("id", "title", F.coalesce("revision.text", F.lit("")).alias("text"))


def dump_redirects(dump: DataFrame, namespaces: list[int] = (0,)) -> DataFrame:
    """``title, redirect`` of pages in the namespaces that redirect."""
    kept = dump.where(F.col("ns").isin(list(namespaces)))
    return kept.where(F.coalesce("redirect._title", F.lit("")) != "").select("title", F.col("redirect._title").alias("redirect"))


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """Entities of a JSON dump as :data:`RAW_ENTITY`: one a line, within the brackets of an array. Lines that cannot be
    read are skipped; empty claims written as arrays give nulls."""
    return read_entities_counted(spark, path)[0]


def read_entities_counted(spark: SparkSession, path: str) -> tuple[DataFrame, Observation]:
    """The same, and counters of all lines and of those that cannot be read."""
    line = F.regexp_replace("value", r"[,\]\s]+$", "")
    rows = spark.read.text(path).select(line.alias("line")).where(~F.col("line").isin("", "["))
    good, seen = counted(rows.select(F.from_json("line", RAW_ENTITY).alias("e")), F.col("e.id").isNotNull())
    return good.select("e.*"), seen
