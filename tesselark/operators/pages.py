"""Pages, their titles, redirects and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselark.functions.fixed import PERSON_INFOBOXES
from tesselark.functions.wikitext import clean_wikitext, wikitext_links
from tesselark.runtime import Latest, Rounds, cut

SHARDS = 100
#: Rounds of doubling in which a chain of redirects must end: enough for 2**40 redirects in a row.
MAX_DOUBLINGS = 40


def title_index(pages: DataFrame) -> DataFrame:
    """``id, title``: one title per id, the last one in order if there are several."""
    return pages.where("id is not null and title is not null").groupBy("id").agg(F.max("title").alias("title"))


def by_title(titles: DataFrame) -> DataFrame:
    """``title, id``: one id per title, the largest if there are several."""
    return titles.where("title is not null").groupBy("title").agg(F.max("id").alias("id"))


def clean(pages: DataFrame, strict: bool = False) -> DataFrame:
    return pages.withColumn("text", clean_wikitext(F.col("text"), strict))


def view(pages: DataFrame, ids: list[int] | None = None, titles: list[str] | None = None) -> DataFrame:
    """The pages asked for by id or title. An id or a title that no page has is an error."""
    if ids:
        have = {r[0] for r in pages.where(F.col("id").isin(list(ids))).select("id").distinct().collect()}  # as many as asked for
        if missing := [i for i in ids if i not in have]:
            raise KeyError(f"no page has the id {missing[0]!r}")
    wanted = list(titles or [])
    if wanted:
        known = {r[0] for r in pages.where(F.col("title").isin(wanted)).select("title").distinct().collect()}  # as many as asked for
        if missing := sorted(set(wanted) - known):
            raise KeyError(f"no page has the title {missing[0]!r}")
    asked = F.lit(False)
    if ids:
        asked = asked | F.col("id").isin(list(ids))
    if wanted:
        asked = asked | F.col("title").isin(wanted)
    return pages.where(asked)


def with_shard(rows: DataFrame, key: str = "id", shards: int = SHARDS) -> DataFrame:
    return rows.withColumn("shard", F.pmod(F.col(key), F.lit(shards)).cast("int"))


def is_person(text: Column, infoboxes: list[str] = PERSON_INFOBOXES) -> Column:
    """Whether a text has an infobox of a person."""
    return F.lower(text).rlike("infobox (" + "|".join(infoboxes) + ")\n")


def redirect_targets(redirects: DataFrame, order: str | None = None) -> DataFrame:
    """``title, redirect``: one target per title, the last by ``order``."""
    last = F.max(F.struct(*([F.col(order)] if order else []), F.col("redirect"))).alias("last")
    return redirects.where("title is not null and redirect is not null").groupBy("title").agg(last).select("title", "last.redirect")


def resolve_redirects(targets: DataFrame, titles: DataFrame) -> DataFrame:
    """``title, destination, hops`` of every redirect, by pointer doubling.

    A title that an article has leads to itself, and so does a redirect to itself; a chain ends at an article or at what
    redirects no further. Chains that run in a circle have no destination (null). Rows whose end is known leave the loop."""
    articles = titles.select("title").distinct().withColumn("article", F.lit(True))
    rows = targets.join(articles, "title", "left")
    stays = F.coalesce(F.col("article"), F.lit(False)) | (F.col("title") == F.col("redirect"))
    rows = cut(rows.select("title", F.col("redirect").alias("to"), F.when(stays, 0).otherwise(1).cast("long").alias("hops")), "at")
    settled = Rounds(rows.where("hops = 0").select("title", F.col("title").alias("to"), "hops"), "settled")
    moving = Latest(rows.where("hops > 0"), "moving")
    for _ in range(MAX_DOUBLINGS):
        # where a row's target leads: on, if it still moves; to its end, if that is known; and else the target is the end
        on = moving.df.select(F.col("title").alias("to"), F.col("to").alias("further"), F.col("hops").alias("more"), F.lit(False).alias("done"))
        ends = settled.all().where("hops > 0").select(F.col("title").alias("to"), F.col("to").alias("further"), F.col("hops").alias("more"), F.lit(True).alias("done"))
        jumped = moving.df.join(on.unionByName(ends), "to", "left").select(
            "title", F.coalesce("further", "to").alias("to"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.coalesce("done", F.lit(True)).alias("done")
        )
        jumped = cut(jumped, "jumped")
        settled.add(jumped.where("done").drop("done"))
        # of rows that have an end the nearest settles in each round: where none does, all that moves is in circles
        if settled.last.isEmpty():
            break
        moving.replace(jumped.where("not done").drop("done"))
    nowhere = moving.df.select("title", F.lit(None).cast("string").alias("destination"), F.lit(None).cast("long").alias("hops"))
    return settled.all().select("title", F.col("to").alias("destination"), "hops").unionByName(nowhere)


def raw_links(pages: DataFrame, first: int | None = None) -> DataFrame:
    """``id, target``: targets between double brackets up to a bar, as written, repeats kept; only the ``first`` ones of
    each page if a number is given."""
    found = F.regexp_extract_all(F.col("text"), F.lit(r"(\[\[[^]]+\]\])"), F.lit(1))
    if first is not None:
        found = F.slice(found, 1, first)
    return pages.select("id", F.explode(found).alias("link")).select("id", F.substring_index(F.expr("substring(link, 3, length(link) - 4)"), "|", 1).alias("target"))


def page_links(pages: DataFrame) -> DataFrame:
    """``id, target, section``: links in running text, in order, with the outermost section they stand in."""
    return pages.select("id", F.posexplode(wikitext_links(F.col("text"))).alias("pos", "link")).select("id", "pos", "link.target", "link.section")


def resolved_links(links: DataFrame, titles: DataFrame, destinations: DataFrame | None = None, ignored_sections: list[str] = (), ignore_categories: bool = False) -> DataFrame:
    """``id, pos, section, link``: links whose target, or what it redirects to, is a title; repeats kept.

    A target that is itself a title is not redirected. Links in ignored sections or to categories can be left out."""
    if ignored_sections:
        links = links.where(~F.trim("section").isin(list(ignored_sections)))
    if ignore_categories:
        links = links.where(~F.lower("target").startswith("category:"))
    ids = by_title(titles)
    direct = links.join(ids.select(F.col("title").alias("target"), F.col("id").alias("link")), "target", "left")
    if destinations is not None:
        ends = destinations.where("destination is not null").join(ids.select(F.col("title").alias("destination"), F.col("id").alias("end")), "destination").select(F.col("title").alias("target"), "end")
        direct = direct.join(ends, "target", "left").withColumn("link", F.coalesce("link", "end"))
    return direct.where("link is not null").select("id", "pos", "section", "link")


def link_lists(pages: DataFrame, resolved: DataFrame) -> DataFrame:
    """``id, links``: the links of every page in order; a page without links has an empty list."""
    lists = resolved.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "link"))).alias("l"))  # as many as a page has links
    rows = pages.select("id").distinct().join(lists, "id", "left")
    return rows.select("id", F.coalesce(F.transform("l", lambda x: x["link"]), F.array().cast("array<long>")).alias("links"))


def compare_titles(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row of how the articles changed between two title indexes: counts and shares."""
    old = by_title(before).groupBy("id").agg(F.max("title").alias("title"))
    new = by_title(after).groupBy("id").agg(F.max("title").alias("after_title"))
    both = old.join(new, "id", "left").agg(
        F.count("*").alias("before"), F.count_if(F.col("after_title").isNull()).alias("deleted"), F.count_if(F.col("after_title") != F.col("title")).alias("renamed")
    )
    rows = both.join(new.agg(F.count("*").alias("after")))

    def share(a: Column, b: Column) -> Column:
        return F.when(b != 0, a / b)

    return rows.select(
        "before", "after", "renamed", "deleted",
        share(F.col("after") - F.col("before"), F.col("after")).alias("added_share"), share(F.col("deleted"), F.col("before")).alias("deleted_share"),
        share(F.col("renamed"), F.col("before") - F.col("deleted")).alias("renamed_share"),
    )


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """``id, before, after``: the texts of pages that both corpora have and that differ between them."""
    both = before.select("id", F.col("text").alias("before")).join(after.select("id", F.col("text").alias("after")), "id")
    return both.where(~F.col("before").eqNullSafe(F.col("after")))


def topic_title(title: Column) -> Column:
    """A title without its category prefix, in title case, but for of, in and the within it."""
    text = F.initcap(F.regexp_replace(title, "(?i)^category:", ""))
    for word in ("Of", "In", "The"):
        text = F.replace(text, F.lit(f" {word} "), F.lit(f" {word.lower()} "))
    return text
