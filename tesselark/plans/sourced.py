"""Queries of sources, sinks, named jobs, and of the rules of markup and tags, with their SQL.

Dumps, indexes and entity files are written from whole tables to the shared folder and read back as published ones are. Rules
run over all names of parts, with expected results stated beside them (:mod:`tesselark.plans.rules`)."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselark.functions import tagtree
from tesselark.functions.wikitext import clean_wikitext, wikitext_links
from tesselark.operators import classify, entities, graph, pages, words
from tesselark.plans import jobs, rules
from tesselark.plans.analyses import _SNAK
from tesselark.runtime import cut, scratch_path, table
from tesselark.sources import dumps, tables

CHOSEN = [2, 3, 5, 8, 13]


# --- the rules -------------------------------------------------------------------------------------------------------


def _applied(spark: SparkSession, d: str, cases: list[tuple[str, ...]], names: str) -> DataFrame:
    """All names of parts with each case; ``@`` in a case is the name. Cases are a list of literals in the plan."""
    listed = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names.split(), c, strict=True))) for c in cases))
    rows = table(spark, d, "part").select("p_partkey", "p_name", F.explode(listed).alias("c"))
    return rows.select("p_partkey", *(F.replace(F.col("c")[n], F.lit("@"), F.col("p_name")).alias(n) for n in names.split()))


def _wikitext_query(rule: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        cases = [(str(i), text) for i, (text, _) in enumerate(rules.WIKITEXT[rule])]
        return _applied(spark, d, cases, "rule text").select("p_partkey", "rule", F.btrim(clean_wikitext(F.col("text")), F.lit("\n")).alias("text"))

    query.__name__ = f"wikitext_{rule.replace(' ', '_')}"
    query.__doc__ = f"The rules of {rule} in wiki markup, over all names of parts."
    return query


def _tag_query(rule: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        cases = [(str(i), title, category) for i, (title, category, _) in enumerate(rules.TAGS[rule])]
        rows = _applied(spark, d, cases, "rule title category")
        return rows.select("p_partkey", "rule", tagtree.category_name(F.col("title"), F.col("category")).alias("category"))

    query.__name__ = f"tags_{rule.replace(' ', '_')}"
    query.__doc__ = f"The rules of {rule} in category tags, over all names of parts."
    return query


def wikitext_link_rules(spark: SparkSession, d: str) -> DataFrame:
    cases = [(str(i), text) for i, (text, _) in enumerate(rules.LINKS)]
    rows = _applied(spark, d, cases, "rule text").select("p_partkey", "rule", F.posexplode(wikitext_links(F.col("text"))).alias("pos", "link"))
    return rows.select("p_partkey", "rule", "pos", "link.target", "link.section")


def _rule_sql(cases: list[tuple[str, str]], column: str) -> str:
    return f"SELECT p_partkey, rule, replace(want, '@', p_name) AS {column} FROM part, {rules.sql_table([(str(i), w) for i, (_, w) in enumerate(cases)], 'rule, want')}"


# --- dumps -----------------------------------------------------------------------------------------------------------


def _escaped(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def _written_dump(spark: SparkSession, d: str) -> str:
    """A compressed dump of several streams: articles from the page texts, categories as pages of namespace 14, and redirects."""
    texts = table(spark, d, "page_texts").where("id is not null and title is not null").groupBy("id").agg(F.max(F.struct("title", "text")).alias("p"))
    articles = texts.select(F.col("p.title").alias("title"), F.lit(0).alias("ns"), "id", F.lit(None).cast("string").alias("to"), F.coalesce("p.text", F.lit("")).alias("text"))
    named = table(spark, d, "page_categories").where("id is not null").select(F.concat(F.lit("Category:"), F.col("id").cast("string")).alias("title"), F.lit(14).alias("ns"), "id", F.lit(None).cast("string").alias("to"), F.lit("x").alias("text")).distinct()
    moved = table(spark, d, "redirects").where("title is not null and trim(redirect) <> ''").groupBy("title").agg(F.max("redirect").alias("to"))
    moved = moved.select("title", F.lit(0).alias("ns"), F.abs(F.xxhash64("title")).alias("id"), "to", F.concat(F.lit("#REDIRECT [["), "to", F.lit("]]")).alias("text"))
    rows = articles.unionByName(named).unionByName(moved)
    redirect = F.when(F.col("to").isNull(), "").otherwise(F.concat(F.lit('<redirect title="'), _escaped(F.col("to")), F.lit('" />')))
    xml = F.concat(
        F.lit("  <page>\n    <title>"), _escaped(F.col("title")), F.lit("</title>\n    <ns>"), F.col("ns").cast("string"), F.lit("</ns>\n    <id>"), F.col("id").cast("string"), F.lit("</id>\n    "),
        redirect, F.lit('\n    <revision>\n      <id>1</id>\n      <text xml:space="preserve">'), _escaped(F.col("text")), F.lit("</text>\n    </revision>\n  </page>"),
    )
    path = f"{scratch_path(spark, 'dump')}/somewiki-20230101-pages-articles-multistream.xml.bz2"
    rows.select(xml.alias("value")).write.option("compression", "bzip2").text(path)
    return path


CONFIG = jobs.Config(
    {
        "ingest": jobs.Job("ingest", {"namespaces": [0], "out": "articles", "outRedirects": "redirects"}),
        "ingest-categories": jobs.Job("ingest", {"namespaces": [14], "out": "categories", "outRedirects": "none"}),
        "clean": jobs.Job("clean", {"in": "linked", "out": "clean"}),
        "titles": jobs.Job("title-index", {"in": "articles", "out": "titles"}),
        "links": jobs.Job("links", {"in": "linked", "index": "titles", "redirects": "redirects", "out": "links"}),
        "normalize": jobs.Job("normalize", {"in": "clean", "out": "normal"}),
        "view": jobs.Job("view", {"in": "articles", "ids": CHOSEN}),
        "genders": jobs.Job("gender-index", {"wikidata": "entities", "out": "genders"}),
        "frequency": jobs.Job("gender-frequency", {"genderIndex": "classes"}),
        "comparison": jobs.Job("gender-comparison", {"genderIndex": "classes", "links": "links"}),
        "sections": jobs.Job("gender-comparison", {"genderIndex": "classes", "articles": "sections"}),
        "ranks": jobs.Job("pagerank", {"index": "titles", "links": "links", "out": "ranks", "outReport": "report"}),
        "women": jobs.Job("pagerank", {"index": "titles", "links": "links", "genderIndex": "classes", "genderFilter": "Brand#11", "out": "ranks"}),
        "compare": jobs.Job("pagerank-compare", {"pageRanks": "ranks", "genderIndex": "classes"}),
        "renamed": jobs.Job("renamed-articles", {"index": "titles"}),
        "ngrams": jobs.Job("ngrams", {"in": "linked", "out": "ngrams", "minCount": 40}),
        "first": jobs.Job("first-links", {"in": "linked"}),
        "network": jobs.Job("reference-network", {"in": "linked", "genderIndex": "people", "outTotals": "totals"}),
        "weights": jobs.Job("reference-network-2", {"in": "linked", "genderIndex": "people"}),
    },
    {"start": ["ingest", "titles"], "clean-all": ["clean", "normalize"]},
)


class _Work:
    """A workspace with one corpus."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, scratch_path(spark, "work")
        self.corpus = jobs.Corpus(spark, self.folder, "c")

    def run(self, name: str, *more: str, files: tuple[str, ...] = ()) -> DataFrame:
        return jobs.run(self.spark, CONFIG, name, self.folder, "c", *more, files=list(files))


def ingest_articles(spark: SparkSession, d: str) -> DataFrame:
    """Articles of a compressed dump, through the job."""
    return _Work(spark).run("ingest", files=(_written_dump(spark, d),)).select("id", "title", "text", "shard")


def ingest_redirects(spark: SparkSession, d: str) -> DataFrame:
    work = _Work(spark)
    work.run("ingest", files=(_written_dump(spark, d),))
    return work.corpus.read("redirects")


def ingest_namespaces(spark: SparkSession, d: str) -> DataFrame:
    return _Work(spark).run("ingest-categories", files=(_written_dump(spark, d),)).select("id", "title")


def title_index_job(spark: SparkSession, d: str) -> DataFrame:
    """A workflow: ingest, then the index of titles."""
    return _Work(spark).run("start", files=(_written_dump(spark, d),))


def clean_job(spark: SparkSession, d: str) -> DataFrame:
    """A workflow: plain text, then normal text."""
    return _linked(spark, d).run("clean-all").select("id", "text")


def view_job(spark: SparkSession, d: str) -> DataFrame:
    work = _Work(spark)
    work.corpus.write(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("text")), "articles")
    return work.run("view")


def dump_index(spark: SparkSession, d: str) -> DataFrame:
    """The index of a dump, and the offsets of its streams."""
    path = f"{scratch_path(spark, 'index')}/index.txt"
    rows = table(spark, d, "part").select(F.concat_ws(":", (F.floor(F.col("p_partkey") / 100) * 1000 + 600).cast("string"), F.col("p_partkey").cast("string"), F.concat("p_name", F.lit(": a "), "p_type")).alias("value"))
    rows.write.text(path)
    index = dumps.read_index(spark, path)
    return index.join(dumps.stream_offsets(index), "offset")


def dump_names(spark: SparkSession, d: str) -> DataFrame:
    names = [f"enwiki-{y}0{m}01-pages-articles-multistream{s}.xml{r}.bz2" for y in (2021, 2022) for m in (1, 7) for s, r in (("", ""), ("3", "-p10p99"))]
    rows = [(n, dumps.corpus_of(n, n.replace("multistream", "multistream-index").replace(".xml", ".txt"))) for n in names]
    rows += [(n, dumps.entity_corpus(n)) for n in ("wikidata-20220103-all.json.bz2", "latest-20211206-all.json.gz")]
    return spark.createDataFrame(rows, "name string, corpus string")


def _written_entities(spark: SparkSession, d: str) -> str:
    """Entities as an array of JSON objects, one a line, with a line that cannot be read for each that can."""
    path = f"{scratch_path(spark, 'entities')}/wikidata-20230102-all.json"
    rows = table(spark, d, "raw_entities").select("line_no", F.to_json(F.struct("id", "sitelinks", "claims")).alias("line"))
    lines = rows.select(F.explode(F.array(F.concat("line", F.lit(",")), F.concat(F.lit('{"broken": '), F.col("line_no").cast("string")), F.lit("]"))).alias("value"))
    lines.write.text(path)
    return path


def entities_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Entities of a dump: how many sitelinks and properties each has."""
    raw = dumps.read_entities(spark, _written_entities(spark, d))
    return raw.select("id", F.size(F.coalesce("sitelinks", F.create_map().cast("map<string,struct<site:string,title:string,url:string>>"))).alias("sitelinks"), F.coalesce(F.size(F.map_keys("claims")), F.lit(0)).alias("claims"))


def entities_counted(spark: SparkSession, d: str) -> DataFrame:
    """Counters of lines that were read and of those that were skipped."""
    raw, seen = dumps.read_entities_counted(spark, _written_entities(spark, d))
    raw.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["rows"], seen.get["failed"])], "rows long, failed long")


def _entity_ids(spark: SparkSession, d: str, **filters) -> DataFrame:
    raw = table(spark, d, "raw_entities")
    return entities.parse_entities(raw, None, ["P21", "P31", "P569", "P9008"], **filters).select("wikidata_id").distinct()


def entities_instance_of(spark: SparkSession, d: str) -> DataFrame:
    """Entities that are an instance of the commonest class."""
    return _entity_ids(spark, d, instance_of=[_class(spark, d)])


def entities_with_article(spark: SparkSession, d: str) -> DataFrame:
    """Entities of that class only with an article, others all."""
    return _entity_ids(spark, d, require_article=[_class(spark, d)])


def _class(spark: SparkSession, d: str) -> str:
    kinds = entities._values(F.col("claims"), entities.INSTANCE_OF)
    best = table(spark, d, "raw_entities").select(F.explode(kinds).alias("k")).groupBy("k").count().orderBy(F.desc("count"), "k").first()
    return best["k"] if best else ""


def gender_index_job(spark: SparkSession, d: str) -> DataFrame:
    """The genders of humans, from made entities: every part is a human, its size decides its claims."""
    size = F.col("p_size")

    def claim(value: str | Column, rank: str) -> Column:
        return F.struct(F.lit(value).alias("value") if isinstance(value, str) else value.alias("value"), F.lit(rank).alias("rank"))

    said = F.when(size < 10, F.array(claim(entities.WOMAN, "normal"))).when(size < 20, F.array(claim(entities.MAN, "normal"), claim("Q2449503", "normal"))).when(size < 30, F.array(claim(entities.MAN, "normal"), claim(entities.WOMAN, "preferred")))
    said = said.when(size < 40, F.array(claim(entities.MAN, "normal"), claim(entities.WOMAN, "normal"))).otherwise(F.array(claim(entities.MAN, "deprecated")))
    human = F.array(claim(F.when(size % 2 == 0, "Q5").otherwise("Q1"), "normal"))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.create_map(F.lit("P31"), human, F.lit("P21"), said).alias("claims"))
    work = _Work(spark)
    work.corpus.write(rows, "entities")
    return work.run("genders").select("id", entities.gender_label(F.col("gender"), fallback=False).alias("label"), "gender")


# --- jobs on links ---------------------------------------------------------------------------------------------------


def _linked(spark: SparkSession, d: str) -> _Work:
    """A corpus in which each part links to its suppliers' numbers, by title or by a redirect to the title."""
    work = _Work(spark)
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    title = F.concat(F.lit("Part "), F.col("id").cast("string"))
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("to"), (F.col("l_linenumber") % 2).alias("old")).distinct()
    link = F.concat(F.when(F.col("old") == 1, "[[Old ").otherwise("[[Part "), F.col("to").cast("string"), F.when(F.col("old") == 1, "#x|it]]").otherwise("|it]]"))
    texts = lines.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(link)), " ").alias("text"))
    rows = parts.join(texts, "id", "left").select("id", title.alias("title"), F.coalesce("text", F.lit("")).alias("text"))
    infobox = F.when(F.col("id") % 2 == 0, F.lit("{{Infobox writer\n}}\n")).otherwise("")
    work.corpus.write(rows.select("id", "title", F.concat(infobox, "text").alias("text")), "linked")
    work.corpus.write(rows.select("id", "title"), "titles")
    work.corpus.write(parts.select(F.concat(F.lit("Old "), F.col("id").cast("string")).alias("title"), F.concat(F.lit("Part "), F.col("id").cast("string")).alias("redirect")), "redirects")
    work.corpus.write(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("gender")), "classes")
    size = F.col("p_size")
    gender = F.when(size < 15, entities.WOMAN).when(size < 30, entities.MAN).when(size < 40, entities.CONFLICT).otherwise("Q1")
    work.corpus.write(table(spark, d, "part").select(F.col("p_partkey").alias("id"), gender.alias("gender")), "people")
    return work


def links_job(spark: SparkSession, d: str) -> DataFrame:
    """Links through redirects, in the order of the text."""
    return _linked(spark, d).run("links").select("id", F.array_join("links", ",").alias("links"))


def rank_report_job(spark: SparkSession, d: str) -> DataFrame:
    """Ranks to convergence, and the report of the 100 highest with their titles."""
    work = _linked(spark, d)
    work.run("links")
    work.run("ranks")
    return work.corpus.read("report").select("rank", "id", "title", F.round("pagerank", 4).alias("pagerank"))


def rank_compare_job(spark: SparkSession, d: str) -> DataFrame:
    """Ranks by class in a corpus compared with itself, restarts at one class only."""
    work = _linked(spark, d)
    work.run("links")
    work.run("women")
    return work.run("compare", "c").select("gender", F.round("before", 3).alias("before"), F.round("after", 3).alias("after"))


def gender_frequency_job(spark: SparkSession, d: str) -> DataFrame:
    return _linked(spark, d).run("frequency")


def gender_comparison_job(spark: SparkSession, d: str) -> DataFrame:
    work = _linked(spark, d)
    work.run("links")
    return work.run("comparison", "c")


def gender_sections_job(spark: SparkSession, d: str) -> DataFrame:
    """Shares of links in sections by class: in the lead, and below a heading."""
    work = _linked(spark, d)
    text = F.lit("[[A]]\n== Life ==\n[[B]] [[C]]\n=== Youth ===\n[[D]]")
    work.corpus.write(work.corpus.read("linked").select("id", "title", text.alias("text")), "sections")
    return work.run("sections").select("gender", "section", "links", F.round("percent", 4).alias("percent"))


def renamed_job(spark: SparkSession, d: str) -> DataFrame:
    """A corpus against one in which small parts are gone and others have another title."""
    work = _linked(spark, d)
    part = table(spark, d, "part")
    name = F.concat(F.when(F.col("p_size") > 40, "Item ").otherwise("Part "), F.col("p_partkey").cast("string"))
    jobs.Corpus(spark, work.folder, "later").write(part.where("p_size > 5").select(F.col("p_partkey").alias("id"), name.alias("title")), "titles")
    return work.run("renamed", "later").select("before", "after", "renamed", "deleted")


def ngrams_job(spark: SparkSession, d: str) -> DataFrame:
    """N-grams of the links' texts in the order of their report: place, words and count of single words."""
    found = _linked(spark, d).run("ngrams")
    return found.where(~F.col("word").contains(" ")).select("word", "count")


def first_links_job(spark: SparkSession, d: str) -> DataFrame:
    """From how many pages of persons each topic is at most two of their first 20 links away: the 1,000 highest."""
    return _linked(spark, d).run("first").select("topic", "title", "roots")


def network_job(spark: SparkSession, d: str) -> DataFrame:
    work = _linked(spark, d)
    return work.run("network").select("from_class", "to_class", "links", F.round("share", 6).alias("share"))


def network_totals_job(spark: SparkSession, d: str) -> DataFrame:
    work = _linked(spark, d)
    work.run("network")
    return work.corpus.read("totals")


def network_weights_job(spark: SparkSession, d: str) -> DataFrame:
    """All 40 steps of the uniform rank, by class."""
    return _linked(spark, d).run("weights").select("class", F.round("weight", 6).alias("weight"))


# --- tables at rest --------------------------------------------------------------------------------------------------


def sharded_table(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a sharded folder, each from the folder of its shard."""
    path = scratch_path(spark, "sharded")
    tables.write_sharded(table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name"), path)
    return tables.read(spark, path)


def table_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Two parts written to one folder, read as one table."""
    path = scratch_path(spark, "folder")
    parts = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    tables.write_new(parts.where("p_size <= 25"), f"{path}/half=1")
    tables.write(parts.where("p_size > 25"), f"{path}/half=2")
    return tables.read(spark, path, "p_partkey long, p_name string, p_size int, half int")


def table_lookup(spark: SparkSession, d: str) -> DataFrame:
    return tables.lookup(table(spark, d, "part").select("p_partkey", "p_name"), CHOSEN, "p_partkey")


def shard_of_key(spark: SparkSession, d: str) -> DataFrame:
    """The shard of each part, of shards whose ends are the suppliers' numbers."""
    shards = table(spark, d, "supplier").select(F.concat(F.lit("shard-"), F.col("s_suppkey").cast("string")).alias("path"), (F.col("s_suppkey") * 11).alias("max"))
    return tables.locate_shard(shards, table(spark, d, "part").select(F.col("p_partkey").alias("id")))


def rows_in_memory(spark: SparkSession, d: str) -> DataFrame:
    """A map and a list of rows as tables."""
    return tables.from_map(spark, {"a": 1, "b": 2}, schema="key string, value long").unionByName(tables.from_rows(spark, [("c", 3), ("c", 3)], "key string, value long"))


def frequency_files(spark: SparkSession, d: str) -> DataFrame:
    """Frequency tables written as JSON lines and as YAML, and read one after another; and one object."""
    counts = table(spark, d, "part").groupBy(F.col("p_brand").alias("word")).agg(F.count("*").alias("count"))
    path = scratch_path(spark, "frequencies")
    tables.write_frequency_table(counts, f"{path}/a.json")
    local = path.removeprefix("file://").removeprefix("file:")
    Path(local).mkdir(parents=True, exist_ok=True)
    tables.write_frequency_table(counts, f"{local}/b.yaml")
    first = tables.read_one(f"{local}/b.yaml")
    one = tables.from_rows(spark, [(f"first {first[0]['word']}", first[0]["count"])], "word string, count long")
    return tables.read_frequency_tables(spark, f"{path}/a.json", f"{local}/b.yaml").unionByName(one)


def dictionary_file(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "dictionary")
    tables.write(table(spark, d, "word_dictionary"), path)
    return tables.read_dictionary(spark, path).unionByName(tables.read_dictionary(spark, None))


def upsert_whole(spark: SparkSession, d: str) -> DataFrame:
    """Page titles of an old table with those of the snapshots on top, all columns."""
    new = table(spark, d, "page_snapshots").where("id <> 0").select("id", "title", "loaded_at")
    old = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.lit(None).cast("timestamp").alias("loaded_at"))
    kept = tables.upsert(old, new.groupBy("id", "loaded_at").agg(F.max("title").alias("title")).select("id", "title", "loaded_at"), "id", "loaded_at")
    return kept.select("id", "title", F.date_format("loaded_at", "yyyy-MM-dd HH:mm:ss").alias("loaded_at"))


# --- further operators -----------------------------------------------------------------------------------------------


def before_after(spark: SparkSession, d: str) -> DataFrame:
    """Texts of pages that differ between two corpora."""
    part = table(spark, d, "part")
    old, new = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text")), part.where("p_size > 3").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.col("p_type")).alias("text"))
    return pages.before_after(old, new)


def classified_titles(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    classes = part.where("p_size > 10").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("classification"))
    return classify.classified_titles(classes, part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title")))


def class_seeds(spark: SparkSession, d: str) -> DataFrame:
    return classify.seed_labels(spark).groupBy("classification").agg(F.count("*").alias("articles"))


def ngram_report(spark: SparkSession, d: str) -> DataFrame:
    """Pairs and words of part names in the order of a report, numbered."""
    names = table(spark, d, "part").select(F.explode(F.array("p_name", F.element_at(F.split("p_name", " "), 1))).alias("word")).groupBy("word").agg(F.count("*").alias("count"))
    ordered = words.report_order(names).coalesce(1)
    return ordered.withColumn("place", F.monotonically_increasing_id() + 1)


def word_bag_by_line(spark: SparkSession, d: str) -> DataFrame:
    """Word bags in which pairs do not reach over the end of a line: pairs of known words as n-grams."""
    from tesselark.functions import nlp

    docs = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit("\n"), F.lower("p_type"), F.lit(" "), F.lower("p_type")).alias("text"))
    dictionary = table(spark, d, "part").select(F.col("p_name").alias("word")).unionByName(table(spark, d, "part").select(F.lower("p_type").alias("word"))).groupBy("word").agg(F.min(F.length("word")).alias("n"))
    dictionary = cut(words.ordinals(dictionary.select("word", F.lit(1).alias("count"))), "dictionary")
    known = [r[0] for r in table(spark, d, "part").select("p_name").distinct().collect()]  # names of parts are few
    tokens = nlp.ngram_tokens(spark, known)(F.split("text", " "))
    bags = words.word_bags(docs, tokens, dictionary, by_line=True)
    return bags.select("id", F.transform("words", lambda w: w["count"]).cast("array<int>").alias("c")).select("id", F.size("c").alias("kinds"), F.aggregate("c", F.lit(0), lambda a, x: a + x).alias("words"))


def _ring(spark: SparkSession, d: str) -> DataFrame:
    """A ring of nations with steps of five as well."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("src"))
    return n.select("src", ((F.col("src") + 1) % 25).alias("dst")).unionByName(n.select("src", ((F.col("src") + 5) % 25).alias("dst")))


def shortest_path_nodes(spark: SparkSession, d: str) -> DataFrame:
    """A shortest path; of several the one whose nodes are the smallest, seen from the end."""
    return spark.createDataFrame(list(enumerate(graph.shortest_path(_ring(spark, d), 3, 20))), "pos int, id long")


def circle_through_node(spark: SparkSession, d: str) -> DataFrame:
    ring = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("src"), ((F.col("n_nationkey") + 1) % 25).cast("long").alias("dst"))
    return spark.createDataFrame(list(enumerate(graph.find_cycle(ring, 7))), "pos int, id long")


def cached_distances(spark: SparkSession, d: str) -> DataFrame:
    """Distances from two nations to all, each start searched once."""
    cache = graph.DistanceCache(_ring(spark, d))
    return spark.createDataFrame([(a, b, cache.distance(a, b)) for a in (0, 7) for b in range(0, 25)], "src long, dst long, steps int")


def _chain(spark: SparkSession, d: str) -> DataFrame:
    """Parts to suppliers and back: a graph without dead ends."""
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 1_000_000).alias("dst"))
    return lines.unionByName(lines.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def markov_converged(spark: SparkSession, d: str) -> DataFrame:
    """Stationary weights to convergence, of a walk that goes on by one or starts again."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("src"))
    links = n.select("src", ((F.col("src") + 1) % 25).alias("dst")).unionByName(n.select("src", F.lit(0).cast("long").alias("dst")))
    return graph.markov(links, 1e-9, 400).select("id", F.round("weight", 4).alias("weight"))


def uniform_rank_converged(spark: SparkSession, d: str) -> DataFrame:
    """All 40 steps of the uniform variant."""
    return graph.uniform_rank(_chain(spark, d)).select("id", F.round(F.col("weight") * 1000, 6).alias("weight"))


QUERIES = {
    f.__name__: f
    for f in (
        *map(_wikitext_query, rules.WIKITEXT), *map(_tag_query, rules.TAGS), wikitext_link_rules, ingest_articles, ingest_redirects, ingest_namespaces, title_index_job, clean_job, view_job, dump_index,
        dump_names, entities_ingest, entities_counted, entities_instance_of, entities_with_article, gender_index_job, links_job, rank_report_job, rank_compare_job, gender_frequency_job,
        gender_comparison_job, gender_sections_job, renamed_job, ngrams_job, first_links_job, network_job, network_totals_job, network_weights_job, sharded_table, table_round_trip, table_lookup,
        shard_of_key, rows_in_memory, frequency_files, dictionary_file, upsert_whole, before_after, classified_titles, class_seeds, ngram_report, word_bag_by_line, shortest_path_nodes,
        circle_through_node, cached_distances, markov_converged, uniform_rank_converged,
    )
}


_LINES = "lines AS (SELECT DISTINCT l_partkey AS id, l_suppkey AS dst, l_linenumber % 2 AS old, CASE l_linenumber % 2 WHEN 1 THEN '[[Old ' || l_suppkey || '#x|it]]' ELSE '[[Part ' || l_suppkey || '|it]]' END AS link FROM lineitem)"
_PLACED = f"{_LINES}, placed AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY link) AS pos FROM lines)"
_ARTICLES = "articles AS (SELECT id, trim(title) AS title, replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text FROM page_texts WHERE id IS NOT NULL AND title IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY title DESC, text DESC NULLS LAST) = 1)"
_SNAKS = f"""l AS (SELECT line_no, id, sitelinks, u.key AS property, u.value AS list FROM raw_entities, unnest(map_entries(claims)) AS t(u)),
  c AS (SELECT line_no, id, sitelinks, property, list[i].mainsnak.datavalue.value AS v FROM l, unnest(range(1, len(list) + 1)) AS r(i)), s AS (SELECT *, {_SNAK} AS value FROM c),
  top AS (SELECT value FROM s WHERE property = 'P31' AND value IS NOT NULL GROUP BY value ORDER BY count(*) DESC, value LIMIT 1),
  kept AS (SELECT * FROM s WHERE property IN ('P21', 'P31', 'P569', 'P9008') AND value IS NOT NULL), are AS (SELECT DISTINCT line_no FROM s WHERE property = 'P31' AND value = (SELECT value FROM top))"""
_PEOPLE = "people AS (SELECT p_partkey AS id, CASE WHEN p_size < 15 THEN 'female' WHEN p_size < 30 THEN 'male' WHEN p_size < 40 THEN 'non-biography' ELSE 'unknown' END AS class FROM part)"


def _ranks(steps: int, edges: str, nodes: str, damping: float, start: str, restart: str) -> str:
    """Common table expressions of ranks with dead ends: ``edges`` has ``src, dst, t``, ``nodes`` has ``id`` and what ``start`` and
    ``restart`` are made of; the last is ``w<steps>``."""
    parts = [f"e AS MATERIALIZED ({edges})", f"n AS MATERIALIZED ({nodes})", "size AS MATERIALIZED (SELECT count(*) AS c FROM n)", "deg AS MATERIALIZED (SELECT src, sum(t) AS d FROM e GROUP BY src)"]
    parts.append("p AS MATERIALIZED (SELECT e.src, e.dst, e.t / deg.d AS share FROM e JOIN deg ON deg.src = e.src)")
    parts.append(f"w0 AS MATERIALIZED (SELECT n.id, cast({start} AS double) AS w FROM n, size)")
    for k in range(1, steps + 1):
        parts.append(f"m{k} AS MATERIALIZED (SELECT p.dst AS id, sum(w.w * p.share) AS m FROM w{k - 1} w JOIN p ON p.src = w.id GROUP BY p.dst)")
        lost = f"(SELECT coalesce(sum(w), 0) FROM w{k - 1} x WHERE x.id NOT IN (SELECT src FROM deg))"
        parts.append(f"w{k} AS MATERIALIZED (SELECT n.id, {damping} * coalesce(m, 0) + {restart} + {damping} * {lost} / c AS w FROM n CROSS JOIN size LEFT JOIN m{k} ON m{k}.id = n.id)")
    return ", ".join(parts)


_LINKED = f"{_LINES}, "
_NODES = "SELECT p_partkey AS id, p_brand AS brand FROM part"
_EDGES = "SELECT id AS src, dst, count(*) AS t FROM lines GROUP BY id, dst"
_RAW = "SELECT id AS src, dst, 1 AS t FROM lines WHERE old = 0 AND id <> dst"
_BOTH_WAYS = "SELECT DISTINCT src, dst, 1 AS t FROM (SELECT l_partkey AS src, l_suppkey + 1000000 AS dst FROM lineitem UNION ALL SELECT l_suppkey + 1000000, l_partkey FROM lineitem)"
_CHOSEN_BRAND = "CASE WHEN brand = 'Brand#11' THEN {} ELSE 0 END"

SQL = {
    **{f"wikitext_{r.replace(' ', '_')}": _rule_sql(cases, "text") for r, cases in rules.WIKITEXT.items()},
    **{f"tags_{r.replace(' ', '_')}": _rule_sql([(c, w) for _, c, w in cases], "category") for r, cases in rules.TAGS.items()},
    "wikitext_link_rules": "SELECT p_partkey, rule, cast(pos AS int) AS pos, replace(target, '@', p_name) AS target, section FROM part, "
    + rules.sql_table([(str(i), str(k), t, s) for i, (_, want) in enumerate(rules.LINKS) for k, (t, s) in enumerate(want)], "rule, pos, target, section"),
    "ingest_articles": f"WITH {_ARTICLES} SELECT id, title, text, cast(id % 100 AS int) AS shard FROM articles",
    "ingest_redirects": "SELECT trim(title) AS title, max(redirect) AS redirect FROM redirects WHERE title IS NOT NULL AND trim(redirect) <> '' GROUP BY redirects.title",
    "ingest_namespaces": "SELECT DISTINCT id, 'Category:' || id AS title FROM page_categories WHERE id IS NOT NULL",
    "title_index_job": f"WITH {_ARTICLES} SELECT id, title FROM articles",
    "clean_job": f"WITH {_LINES} SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN chr(10) ELSE '' END || coalesce(string_agg('it', ' '), '') AS text FROM part LEFT JOIN (SELECT id FROM lines) k ON k.id = p_partkey WHERE k.id IS NOT NULL GROUP BY p_partkey UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN chr(10) ELSE '' END FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)",
    "view_job": f"SELECT p_partkey AS id, p_name AS title, p_type AS text FROM part WHERE p_partkey IN ({', '.join(map(str, CHOSEN))})",
    "dump_index": "SELECT p_partkey // 100 * 1000 + 600 AS offset, p_partkey AS page_id, p_name || ': a ' || p_type AS title FROM part",
    "dump_names": "SELECT 'enwiki-' || y || '0' || m || '01-pages-articles-multistream' || s || '.xml' || r || '.bz2' AS name, y || '0' || m || '01' || CASE WHEN s <> '' THEN '.' || s ELSE '' END AS corpus FROM (VALUES ('2021'), ('2022')) AS a(y), (VALUES ('1'), ('7')) AS b(m), (VALUES ('', ''), ('3', '-p10p99')) AS c(s, r) UNION ALL SELECT * FROM (VALUES ('wikidata-20220103-all.json.bz2', '20220101'), ('latest-20211206-all.json.gz', '20211201'))",
    "entities_ingest": "SELECT id, coalesce(cardinality(sitelinks), 0) AS sitelinks, coalesce(cardinality(claims), 0) AS claims FROM raw_entities",
    "entities_counted": "SELECT 2 * count(*) AS rows, count(*) AS failed FROM raw_entities",
    "entities_instance_of": f"WITH {_SNAKS} SELECT DISTINCT id AS wikidata_id FROM kept WHERE line_no IN (SELECT line_no FROM are)",
    "entities_with_article": f"WITH {_SNAKS} SELECT DISTINCT id AS wikidata_id FROM kept WHERE NOT (line_no IN (SELECT line_no FROM are) AND coalesce(sitelinks['enwiki'].title, '') = '')",
    "gender_index_job": "SELECT p_partkey AS id, CASE WHEN p_size < 10 THEN 'woman' WHEN p_size < 20 THEN 'man' WHEN p_size < 30 THEN 'woman' WHEN p_size < 40 THEN 'conflict' ELSE 'no claims' END AS label, CASE WHEN p_size < 10 THEN 'Q6581072' WHEN p_size < 20 THEN 'Q6581097' WHEN p_size < 30 THEN 'Q6581072' WHEN p_size < 40 THEN 'CONFLICTING CLAIMS' ELSE 'NO CLAIMS' END AS gender FROM part WHERE p_size % 2 = 0",
    "links_job": f"WITH {_LINES} SELECT p_partkey AS id, coalesce(string_agg(cast(dst AS varchar), ',' ORDER BY link), '') AS links FROM part LEFT JOIN lines ON lines.id = p_partkey GROUP BY p_partkey",
    "rank_report_job": f"WITH {_LINKED}{_ranks(100, _EDGES, _NODES, 0.85, '1', '0.15')} SELECT cast(row_number() OVER (ORDER BY w DESC, id) AS int) AS rank, id, 'Part ' || id AS title, round(w, 4) AS pagerank FROM w100 QUALIFY rank <= 100",
    "rank_compare_job": f"WITH {_LINKED}{_ranks(100, _EDGES, _NODES, 0.85, _CHOSEN_BRAND.format(1), _CHOSEN_BRAND.format(0.15))} SELECT brand AS gender, round(sum(w), 3) AS before, round(sum(w), 3) AS after FROM w100 JOIN n USING (id) GROUP BY brand",
    "gender_frequency_job": "SELECT p_brand AS gender, count(*) AS count FROM part GROUP BY 1",
    "gender_comparison_job": f"WITH {_LINES}, a AS (SELECT p_brand AS gender, count(DISTINCT id) AS x FROM lines JOIN part ON p_partkey = id GROUP BY 1), b AS (SELECT p_brand AS gender, count(*) AS y FROM lines JOIN part ON p_partkey = dst GROUP BY 1), k AS (SELECT coalesce(a.gender, b.gender) AS gender, coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM a FULL JOIN b USING (gender)) SELECT gender, x AS linking_before, y AS linked_before, x AS linking_after, y AS linked_after FROM k",
    "gender_sections_job": "SELECT p_brand AS gender, s AS section, k * count(*) AS links, cast(25 * k AS double) AS percent FROM part, (VALUES ('', 1), ('Life', 3)) AS v(s, k) GROUP BY p_brand, s, k",
    "renamed_job": "SELECT count(*) AS before, count(*) FILTER (p_size > 5) AS after, count(*) FILTER (p_size > 40) AS renamed, count(*) FILTER (p_size <= 5) AS deleted FROM part",
    "ngrams_job": f"WITH {_LINES}, c AS (SELECT unnest(['part', 'old', '_num_', 'x', 'it']) AS word, unnest([count(*) FILTER (old = 0), count(*) FILTER (old = 1), count(*), count(*) FILTER (old = 1), count(*)]) AS count FROM lines UNION ALL SELECT w, (SELECT count(*) FROM part WHERE p_partkey % 2 = 0) FROM (VALUES ('infobox'), ('writer')) AS v(w)) SELECT word, count FROM c WHERE count >= 40",
    "first_links_job": f"WITH {_PLACED}, e AS (SELECT DISTINCT id AS src, dst FROM placed WHERE pos <= 20 AND old = 0 AND id <> dst), a AS (SELECT src AS root, dst AS topic FROM e WHERE src % 2 = 0), b AS (SELECT root, topic FROM a UNION SELECT a.root, e.dst FROM a JOIN e ON e.src = a.topic) SELECT topic, 'Part ' || topic AS title, count(*) AS roots FROM b WHERE root <> topic GROUP BY topic ORDER BY roots DESC, topic LIMIT 1000",
    "network_job": f"WITH {_LINES}, {_PEOPLE}, r AS (SELECT a.class AS from_class, b.class AS to_class, count(*) AS links FROM lines JOIN people a ON a.id = lines.id JOIN people b ON b.id = lines.dst WHERE old = 0 GROUP BY 1, 2) SELECT *, round(links / sum(links) OVER (PARTITION BY from_class), 6) AS share FROM r",
    "network_totals_job": f"WITH {_LINES}, {_PEOPLE}, raw AS (SELECT * FROM lines WHERE old = 0) SELECT 'class ' || class AS name, count(*) AS n FROM people GROUP BY class UNION ALL SELECT 'links', count(*) FROM raw UNION ALL SELECT 'singletons', count(*) FROM part WHERE p_partkey NOT IN (SELECT id FROM raw)",
    "network_weights_job": f"WITH {_LINKED}{_PEOPLE}, {_ranks(40, _RAW, _NODES, 0.99, '1.0 / c', '0.01 / c')} SELECT class, round(sum(w), 6) AS weight FROM w40 JOIN people USING (id) GROUP BY class",
    "sharded_table": "SELECT p_partkey AS id, p_name, cast(p_partkey % 100 AS int) AS shard FROM part",
    "table_round_trip": "SELECT p_partkey, p_name, p_size, CASE WHEN p_size <= 25 THEN 1 ELSE 2 END AS half FROM part",
    "table_lookup": f"SELECT p_partkey, p_name FROM part WHERE p_partkey IN ({', '.join(map(str, CHOSEN))})",
    "shard_of_key": "SELECT p_partkey AS id, 'shard-' || (SELECT min(s_suppkey) FROM supplier WHERE s_suppkey * 11 > p_partkey) AS path FROM part",
    "rows_in_memory": "SELECT * FROM (VALUES ('a', 1), ('b', 2), ('c', 3), ('c', 3)) AS v(key, value)",
    "frequency_files": "WITH c AS (SELECT p_brand AS word, count(*) AS count FROM part GROUP BY 1) SELECT * FROM c UNION ALL SELECT * FROM c UNION ALL (SELECT 'first ' || word, count FROM c ORDER BY count DESC, word LIMIT 1)",
    "dictionary_file": "SELECT ordinal, word FROM word_dictionary",
    "upsert_whole": "WITH new AS (SELECT id, title, loaded_at FROM page_snapshots WHERE id <> 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC NULLS LAST, title DESC NULLS LAST) = 1) SELECT id, title, strftime(loaded_at, '%Y-%m-%d %H:%M:%S') AS loaded_at FROM new UNION ALL SELECT p_partkey, p_name, NULL FROM part WHERE p_partkey NOT IN (SELECT id FROM new)",
    "before_after": "SELECT p_partkey AS id, p_name AS before, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_type END AS after FROM part WHERE p_size > 3 AND p_name <> CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_type END",
    "classified_titles": "SELECT p_partkey AS id, p_name AS title, p_size AS classification FROM part WHERE p_size > 10",
    "class_seeds": "SELECT cast(c AS int) AS classification, CASE c WHEN 12 THEN 2 WHEN 14 THEN 3 ELSE 1 END AS articles FROM range(1, 20) AS r(c)",
    "ngram_report": "WITH w AS (SELECT p_name AS word FROM part UNION ALL SELECT split_part(p_name, ' ', 1) FROM part), c AS (SELECT word, count(*) AS count FROM w GROUP BY word) SELECT word, count, row_number() OVER (ORDER BY len(string_split(word, ' ')), count DESC, word) AS place FROM c",
    "word_bag_by_line": "SELECT p_partkey AS id, 2 AS kinds, 3 AS words FROM part",
    "shortest_path_nodes": """WITH RECURSIVE e AS (SELECT n_nationkey AS src, (n_nationkey + 1) % 25 AS dst FROM nation UNION SELECT n_nationkey, (n_nationkey + 5) % 25 FROM nation),
      d AS (SELECT 3 AS id, 0 AS steps UNION SELECT e.dst, d.steps + 1 FROM d JOIN e ON e.src = d.id WHERE d.steps < 9), best AS (SELECT id, min(steps) AS steps FROM d GROUP BY id),
      prev AS (SELECT e.dst AS id, min(e.src) AS before FROM e JOIN best a ON a.id = e.src JOIN best b ON b.id = e.dst AND b.steps = a.steps + 1 GROUP BY e.dst),
      back AS (SELECT id, steps FROM best WHERE id = 20 UNION ALL SELECT p.before, b.steps - 1 FROM back b JOIN prev p ON p.id = b.id WHERE b.steps > 0)
      SELECT cast(steps AS int) AS pos, cast(id AS bigint) AS id FROM back""",
    "circle_through_node": "SELECT cast(i AS int) AS pos, (7 + i) % 25 AS id FROM range(0, 25) AS r(i)",
    "cached_distances": "SELECT a AS src, b AS dst, cast((b - a + 25) % 25 // 5 + (b - a + 25) % 25 % 5 AS int) AS steps FROM (VALUES (0), (7)) AS v(a), range(0, 25) AS r(b)",
    "markov_converged": "WITH p AS (SELECT i AS id, pow(0.5, i) AS w FROM range(0, 25) AS r(i)) SELECT id, round(25 * w / (SELECT sum(w) FROM p), 4) AS weight FROM p",
    "uniform_rank_converged": f"WITH {_ranks(40, _BOTH_WAYS, 'SELECT DISTINCT src AS id FROM e', 0.99, '1.0 / c', '0.01 / c')} SELECT id, round(w * 1000, 6) AS weight FROM w40",
}
