"""Categories that pages name in their text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselark.functions.tagtree import UNEQUAL_BRACES, category_name
from tesselark.operators.pages import by_title


def named_categories(pages: DataFrame) -> DataFrame:
    """``id, name``: the category lines of each page, template tags evaluated, lower case, in order of the text."""
    lines = F.split(F.regexp_replace("text", r"\]\][\t\n\f\r ]*\[\[", "]]\n[["), "\n")
    chosen = F.filter(lines, lambda x: x.startswith("[[Category:") & x.endswith("]]"))
    rows = pages.select("id", "title", F.posexplode(chosen).alias("pos", "line"))
    inner = F.expr("substring(line, 3, length(line) - 4)")
    name = F.substring_index(category_name(F.col("title"), inner), "|", 1)
    name = F.regexp_replace(F.lower(name), r"^\s+|\s+$", "")
    name = F.regexp_replace(name, "^category: ", "category:")
    rows = rows.select("id", "pos", name.alias("name"))
    return rows.where(~F.col("name").isin("category:", "category:{category}") & ~F.col("name").contains(UNEQUAL_BRACES))


def categorize(pages: DataFrame, titles: DataFrame) -> DataFrame:
    """``id, category``: the ids of the named categories; a name that no title has is tried again with spaces for
    dashes. Titles compare in lower case."""
    ids = by_title(titles.select(F.lower("title").alias("title"), "id"))
    rows = named_categories(pages).withColumn("spaced", F.replace("name", F.lit("-"), F.lit(" ")))
    exact = ids.select(F.col("title").alias("name"), F.col("id").alias("a"))
    spaced = ids.select(F.col("title").alias("spaced"), F.col("id").alias("b"))
    rows = rows.join(exact, "name", "left").join(spaced, "spaced", "left")
    return rows.select("id", "pos", F.coalesce("a", "b").alias("category")).where("category is not null")
