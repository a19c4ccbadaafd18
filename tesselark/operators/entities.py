"""Linked-data entities: reading, filtering, and what their claims say about gender."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_CLAIMS, CONFLICT = "NO CLAIMS", "CONFLICTING CLAIMS"
#: Items of gender.
WOMAN, MAN, NON_BINARY, INTERSEX = "Q6581072", "Q6581097", "Q48270", "Q1097630"
COLLAPSED = {"Q96000630": NON_BINARY, "Q2449503": MAN, "Q1052281": WOMAN, "Q104717073": INTERSEX}
LABELS = {
    MAN: "man",
    WOMAN: "woman",
    "Q1052281": "trans woman",
    CONFLICT: "conflict",
    NON_BINARY: "non-binary",
    "Q2449503": "trans man",
    NO_CLAIMS: "no claims",
    "Q121307100": "intersex woman",
    "Q18116794": "genderfluid",
    "Q121307094": "intersex man",
    "Q12964198": "genderqueer",
    "Q179294": "eunuch",
    "Q189125": "transgender",
    "Q301702": "two-spirit",
    "Q505371": "agender",
}
INSTANCE_OF, GENDER, HUMAN = "P31", "P21", "Q5"


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for p in pairs.items() for x in p)), key)


def collapsed(gender: Column) -> Column:
    return F.coalesce(_lookup(COLLAPSED, gender), gender)


def gender_label(gender: Column, fallback: bool = True) -> Column:
    """A readable label; without one the item itself, or an empty string."""
    return F.coalesce(_lookup(LABELS, gender), gender if fallback else F.lit(""))


def infer_gender(claims: Column) -> Column:
    """What an ``array<struct<value, rank>>`` of gender claims says: deprecated ones do not count; a single claim and a
    single preferred one stand as they are; else all must agree once collapsed."""
    live = F.filter(F.coalesce(claims, F.array().cast("array<struct<value:string,rank:string>>")), lambda c: F.coalesce(c["rank"], F.lit("")) != "deprecated")
    preferred = F.filter(live, lambda c: c["rank"] == "preferred")
    same = F.array_distinct(F.transform(live, lambda c: collapsed(c["value"])))
    return (
        F.when(F.size(live) == 0, NO_CLAIMS)
        .when(F.size(live) == 1, F.get(live, F.lit(0))["value"])
        .when(F.size(preferred) == 1, F.get(preferred, F.lit(0))["value"])
        .when(F.size(same) == 1, F.get(same, F.lit(0)))
        .otherwise(CONFLICT)
    )


def infer_by_rows(claims: DataFrame, keys: list[str]) -> DataFrame:
    """The same over claim rows ``value, rank``: only aggregates of fixed size, so that an entity with a huge number of
    claims is pre-aggregated like any other."""
    live = F.coalesce("rank", F.lit("")) != "deprecated"
    preferred = F.col("rank") == "preferred"
    c = collapsed(F.col("value"))
    rows = claims.groupBy(*keys).agg(
        F.count_if(live).alias("n"), F.count_if(preferred).alias("p"), F.max(F.when(live, F.col("value"))).alias("v"),
        F.max(F.when(preferred, F.col("value"))).alias("pv"), F.min(F.when(live, c)).alias("lo"), F.max(F.when(live, c)).alias("hi"),
    )
    said = F.when(F.col("n") == 0, NO_CLAIMS).when(F.col("n") == 1, F.col("v")).when(F.col("p") == 1, F.col("pv")).when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(CONFLICT)
    return rows.select(*keys, said.alias("gender"))


def snak_value(value: Column) -> Column:
    """The main value of a snak: the id or time of an object, a JSON string unquoted, else null."""
    text = F.trim(value)
    return F.when(text.startswith("{"), F.coalesce(F.get_json_object(text, "$.id"), F.get_json_object(text, "$.time"))).when(text.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), text, F.lit("}")), "$.v"))


def _values(claims: Column, prop: str) -> Column:
    listed = F.coalesce(F.try_element_at(claims, F.lit(prop)), F.array().cast("array<struct<mainsnak:struct<property:string,datavalue:struct<value:string>>,rank:string>>"))
    return F.filter(F.transform(listed, lambda c: snak_value(c["mainsnak"]["datavalue"]["value"])), lambda v: v.isNotNull())


def parse_entities(raw: DataFrame, titles: DataFrame | None, kept: list[str], instance_of: list[str] = (), require_article: list[str] = (), site: str = "enwiki") -> DataFrame:
    """``id, wikidata_id, title, claims`` of raw entities: the article by the title of its sitelink, and the kept claims
    with a main value as ``map<property, array<value, rank>>``.

    Entities must be an instance of one of ``instance_of`` if any are given, have at least one kept claim, and have an
    article; ``require_article`` names classes whose entities are dropped already without a sitelink."""
    kinds = _values(F.col("claims"), INSTANCE_OF)
    rows = raw
    if instance_of:
        rows = rows.where(F.exists(kinds, lambda v: v.isin(list(instance_of))))
    title = F.try_element_at("sitelinks", F.lit(site))["title"]
    if require_article:
        rows = rows.where(~(F.exists(kinds, lambda v: v.isin(list(require_article))) & (F.coalesce(title, F.lit("")) == "")))
    chosen = F.map_filter("claims", lambda k, v: k.isin(kept) & v.isNotNull())
    parsed = F.transform_values(
        chosen,
        lambda k, v: F.filter(
            F.transform(F.filter(v, lambda c: c.isNotNull()), lambda c: F.struct(snak_value(c["mainsnak"]["datavalue"]["value"]).alias("value"), F.coalesce(c["rank"], F.lit("normal")).alias("rank"))),
            lambda c: c["value"].isNotNull(),
        ),
    )
    rows = rows.select(F.col("id").alias("wikidata_id"), title.alias("title"), F.map_filter(parsed, lambda k, v: F.size(v) > 0).alias("claims")).where("size(claims) > 0")
    if titles is None:
        return rows.select(F.lit(None).cast("long").alias("id"), "wikidata_id", "title", "claims")
    from tesselark.operators.pages import by_title

    return rows.join(by_title(titles), "title").select("id", "wikidata_id", "title", "claims")


def gender_index(entities: DataFrame, human: str = HUMAN) -> DataFrame:
    """``id, gender`` of humans."""
    people = entities.where(F.exists(F.coalesce(F.try_element_at("claims", F.lit(INSTANCE_OF)), F.array().cast("array<struct<value:string,rank:string>>")), lambda c: c["value"] == human))
    return people.select("id", infer_gender(F.try_element_at("claims", F.lit(GENDER))).alias("gender"))


def frequency(index: DataFrame) -> DataFrame:
    """``gender, count``, the most frequent first."""
    return index.groupBy("gender").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "gender")


def link_comparison(links: DataFrame, index: DataFrame) -> DataFrame:
    """``gender, linking, linked``: articles of each gender that link anywhere, and links to articles of each gender."""
    source = links.select(F.col("src").alias("id")).distinct().join(index, "id").groupBy("gender").agg(F.count("*").alias("linking"))
    target = links.select(F.col("dst").alias("id")).join(index, "id").groupBy("gender").agg(F.count("*").alias("linked"))
    return source.join(target, "gender", "full").select("gender", F.coalesce("linking", F.lit(0)).alias("linking"), F.coalesce("linked", F.lit(0)).alias("linked"))


def section_shares(links: DataFrame, index: DataFrame, top: int = 20) -> DataFrame:
    """``gender, section, links, percent``: which part of a gender's links stands in each of the ``top`` sections."""
    rows = links.join(index, "id").groupBy("gender", "section").agg(F.count("*").alias("links"))
    best = rows.groupBy("section").agg(F.sum("links").alias("all")).orderBy(F.desc("all"), "section").limit(top)
    whole = rows.groupBy("gender").agg(F.sum("links").alias("whole"))
    return rows.join(whole, "gender").join(F.broadcast(best.select("section")), "section").select("gender", "section", "links", (100.0 * F.col("links") / F.col("whole")).alias("percent"))


def compare_ranks(before: DataFrame, before_index: DataFrame, after: DataFrame, after_index: DataFrame) -> DataFrame:
    """``gender, before, after``: the rank held by each gender in two corpora; genders of the first only."""
    a = before.join(before_index, "id").groupBy("gender").agg(F.sum("pagerank").alias("before"))
    b = after.join(after_index, "id").groupBy("gender").agg(F.sum("pagerank").alias("after"))
    return a.join(b, "gender", "left").select(gender_label(F.col("gender")).alias("gender"), "before", F.coalesce("after", F.lit(0.0)).alias("after"))


def class_matrix(links: DataFrame, classes: DataFrame, other: str = "other") -> DataFrame:
    """``from_class, to_class, links, share``: links between classes, and their share of all links from a class."""
    a = classes.select(F.col("id").alias("src"), F.col("class").alias("from_class"))
    b = classes.select(F.col("id").alias("dst"), F.col("class").alias("to_class"))
    rows = links.join(a, "src", "left").join(b, "dst", "left").select(F.coalesce("from_class", F.lit(other)).alias("from_class"), F.coalesce("to_class", F.lit(other)).alias("to_class"))
    counted = rows.groupBy("from_class", "to_class").agg(F.count("*").alias("links"))
    whole = counted.groupBy("from_class").agg(F.sum("links").alias("whole"))
    return counted.join(whole, "from_class").select("from_class", "to_class", "links", (F.col("links") / F.col("whole")).alias("share"))
