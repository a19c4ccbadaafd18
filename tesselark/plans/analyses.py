"""Queries of text, link, graph, class and entity operators, and their SQL.

The tables hold no link graph and no classes of persons, so that lines of orders stand in for links (parts to suppliers,
whose ids overlap), brands of parts for classes, and events of users for links in sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesselark.functions import distributions, nlp, tagtree
from tesselark.functions.fixed import PERSON_INFOBOXES
from tesselark.functions.wikitext import clean_wikitext
from tesselark.operators import categories, classify, eav, entities, graph, pages, words
from tesselark.runtime import bounded_collect, table
from tesselark.sources import tables

BOXES = ["settlement", *PERSON_INFOBOXES]
VIEWED = [1, 2, 3, 5, 8, 13, 21]
STEPS = 3


def _tokens() -> Column:
    return nlp.words(F.col("text"))


def _links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))


def _brands(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("gender"))


def _parents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "page_categories").select(F.col("id"), F.explode("categories").alias("parent")).where("id is not null and parent is not null").distinct()


def _titles(spark: SparkSession, d: str) -> DataFrame:
    return pages.title_index(table(spark, d, "page_texts"))


def _bags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "page_word_bags").select("id", "words").distinct()


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "classified_articles").where("classification > 0").groupBy("id").agg(F.min("classification").alias("classification"))


def word_count(spark: SparkSession, d: str) -> DataFrame:
    return words.word_counts(table(spark, d, "documents"), _tokens())


def word_min_count(spark: SparkSession, d: str) -> DataFrame:
    return words.ranked(words.at_least(word_count(spark, d), 40))


def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", nlp.normal_article(F.col("text")).alias("text"))


def normal_words(spark: SparkSession, d: str) -> DataFrame:
    rows = word_count(spark, d).select(nlp.normal_word(F.col("word")).alias("word"), "count")
    return rows.groupBy("word").agg(F.sum("count").alias("count"))


def xml_tag_count(spark: SparkSession, d: str) -> DataFrame:
    return words.word_counts(table(spark, d, "page_texts"), nlp.xml_tags(F.col("text")))


def bigram_count(spark: SparkSession, d: str) -> DataFrame:
    return words.at_least(words.pair_counts(table(spark, d, "documents"), _tokens()), 10)


def ngram_prefixes(spark: SparkSession, d: str) -> DataFrame:
    return words.prefix_dictionary(table(spark, d, "page_texts").where("title is not null").select(F.col("title").alias("word")))


def word_ordinality(spark: SparkSession, d: str) -> DataFrame:
    return words.ordinals(words.at_least(word_count(spark, d), 20))


def word_bag(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    bags = words.word_bags(docs, _tokens(), table(spark, d, "word_dictionary"))
    return bags.select("id", F.array_join(F.transform("words", lambda w: F.concat_ws(":", w["word"].cast("string"), w["count"].cast("string"))), " ").alias("words"))


def ngram_tokens(spark: SparkSession, d: str) -> DataFrame:
    frequent = words.prefix_dictionary(words.at_least(words.pair_counts(table(spark, d, "documents"), _tokens()), 100))
    known = [r[0] for r in bounded_collect(frequent, words.MAX_DICTIONARY, "the dictionary of n-grams")]
    rows = table(spark, d, "documents").select("doc_id", nlp.ngram_tokens(spark, known)(_tokens()).alias("tokens"))
    return rows.select("doc_id", F.size("tokens").alias("tokens"), F.size(F.filter("tokens", lambda t: t.contains(" "))).alias("ngrams"))


def ngram_discovery(spark: SparkSession, d: str) -> DataFrame:
    """One pass, words and pairs: as far as SQL can follow."""
    return words.discover_ngrams(table(spark, d, "documents"), _tokens(), passes=1)


def ngram_discovery_all(spark: SparkSession, d: str) -> DataFrame:
    """N-grams of any length: passes until nothing new is found. SQL has no such loop."""
    return words.discover_ngrams(table(spark, d, "documents"), _tokens())


def frequency_union(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return words.union_tables(*(words.word_counts(docs.where(F.lower("lang") == x), _tokens()) for x in ("de", "fr")))


def title_index(spark: SparkSession, d: str) -> DataFrame:
    return _titles(spark, d)


def view_by_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "title", "text")
    return pages.view(rows, ids=VIEWED)


def shard_counts(spark: SparkSession, d: str) -> DataFrame:
    return pages.with_shard(table(spark, d, "documents"), "doc_id").groupBy("shard").agg(F.count("*").alias("pages"))


def upsert_pages(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "page_snapshots").where("id <> 0").select("id", "title", "loaded_at")
    return tables.upsert(None, rows, "id", "loaded_at").select("id", "loaded_at")


def page_sample(spark: SparkSession, d: str) -> DataFrame:
    """A sample of pages: the sampling operator."""
    return table(spark, d, "documents").sample(0.1, seed=1).select("doc_id")


def printed_pages(spark: SparkSession, d: str) -> DataFrame:
    return tables.printable(table(spark, d, "class_names")).withColumn("value", F.regexp_replace("value", " ", ""))


def redirect_resolve(spark: SparkSession, d: str) -> DataFrame:
    return pages.resolve_redirects(pages.redirect_targets(table(spark, d, "redirects"), "seen_at"), _titles(spark, d))


def regex_links(spark: SparkSession, d: str) -> DataFrame:
    return pages.raw_links(table(spark, d, "page_texts")).groupBy("target").agg(F.count("*").alias("links"))


def first_page_links(spark: SparkSession, d: str) -> DataFrame:
    return pages.raw_links(table(spark, d, "page_texts"), 2).groupBy("id").agg(F.count("*").alias("links"))


def _written(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("See [["), F.col("title"), F.lit("#Part|it]] and [[Nowhere]].\n== Notes ==\n[["), F.col("title"), F.lit("]]"))
    return _titles(spark, d).select("id", "title", text.alias("text"))


def links_resolved(spark: SparkSession, d: str) -> DataFrame:
    rows = _written(spark, d)
    return pages.resolved_links(pages.page_links(rows), rows).select("id", "pos", F.trim("section").alias("section"), "link")


def link_lists(spark: SparkSession, d: str) -> DataFrame:
    rows = _written(spark, d)
    found = pages.resolved_links(pages.page_links(rows), rows, ignored_sections=["Notes"], ignore_categories=True)
    return pages.link_lists(rows, found).select("id", F.size("links").alias("links"))


def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "page_texts").select("id", clean_wikitext(F.col("text")).alias("text"))


def clean_restricted(spark: SparkSession, d: str) -> DataFrame:
    return _written(spark, d).select("id", clean_wikitext(F.regexp_replace("text", "Notes", "Life")).alias("text"))


def wikitext_sections(spark: SparkSession, d: str) -> DataFrame:
    return pages.page_links(table(spark, d, "page_texts"))


def infobox_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "page_texts").where(pages.is_person(F.col("text"), BOXES)).select("id").distinct()


def page_categories_named(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("[[Category:{{title year}} in "), F.col("c_mktsegment"), F.lit("]] [[Category:Customers|x]]\nprose"))
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("Year "), (1000 + F.col("c_custkey") % 1000).cast("string")).alias("title"), text.alias("text"))
    return categories.named_categories(rows)


def page_categories_joined(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("[[Category:"), F.col("n_name"), F.lit("]]\n[[Category:No such]]"))
    rows = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("title"), text.alias("text"))
    titles = table(spark, d, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("id"), F.concat(F.lit("Category:"), F.replace("n_name", F.lit("_"), F.lit(" "))).alias("title"))
    return categories.categorize(rows, titles)


def renamed_articles(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "page_snapshots").where("id <> 0")
    days = rows.agg(F.min("corpus").alias("a"), F.max("corpus").alias("b")).first()
    return pages.compare_titles(rows.where(F.col("corpus") == days["a"]), rows.where(F.col("corpus") == days["b"]))


def kept_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "page_snapshots").where("id <> 0")
    days = rows.agg(F.min("corpus").alias("a"), F.max("corpus").alias("b")).first()
    return rows.where(F.col("corpus") == days["a"]).select("id").intersect(rows.where(F.col("corpus") == days["b"]).select("id"))


def deleted_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "page_snapshots").where("id <> 0")
    days = rows.agg(F.min("corpus").alias("a"), F.max("corpus").alias("b")).first()
    return rows.where(F.col("corpus") == days["a"]).select("id").distinct().join(rows.where(F.col("corpus") == days["b"]).select("id").distinct(), "id", "left_anti")


def out_degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.out_degree(_links(spark, d), graph.nodes_of(_links(spark, d)))


def in_degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.in_degree(_links(spark, d), graph.nodes_of(_links(spark, d)))


def link_counts(spark: SparkSession, d: str) -> DataFrame:
    degree = graph.out_degree(_links(spark, d), graph.nodes_of(_links(spark, d)))
    return degree.agg(F.sum("degree").alias("links"), F.count_if(F.col("degree") == 0).alias("singletons"), F.count("*").alias("nodes"))


def two_hop_topics(spark: SparkSession, d: str) -> DataFrame:
    roots = table(spark, d, "part").where("p_size <= 5").select(F.col("p_partkey").alias("id"))
    return graph.two_hop_topics(_links(spark, d), roots)


def class_matrix(spark: SparkSession, d: str) -> DataFrame:
    classes = _brands(spark, d).withColumnRenamed("gender", "class")
    return entities.class_matrix(_links(spark, d), classes).withColumn("share", F.round("share", 6))


def pagerank_k(spark: SparkSession, d: str) -> DataFrame:
    return graph.pagerank(_links(spark, d), steps=STEPS).select("id", F.round("pagerank", 6).alias("pagerank"))


def pagerank_converged(spark: SparkSession, d: str) -> DataFrame:
    """Ranks to convergence over categories."""
    links = _parents(spark, d).select(F.col("id").alias("src"), F.col("parent").alias("dst"))
    return graph.pagerank(links).select("id", F.round("pagerank", 6).alias("pagerank"))


def pagerank_filtered_k(spark: SparkSession, d: str) -> DataFrame:
    nodes = graph.nodes_of(_links(spark, d)).join(_brands(spark, d), "id", "left")
    return graph.pagerank(_links(spark, d), nodes, STEPS, chosen=F.col("gender") == "Brand#11").select("id", F.round("pagerank", 6).alias("pagerank"))


def pagerank_uniform_k(spark: SparkSession, d: str) -> DataFrame:
    return graph.uniform_rank(_links(spark, d), steps=STEPS).select("id", F.round(F.col("weight") * 1000, 6).alias("weight"))


def markov_k(spark: SparkSession, d: str) -> DataFrame:
    return graph.markov(_links(spark, d), steps=STEPS).select("id", F.round("weight", 6).alias("weight"))


def pagerank_top(spark: SparkSession, d: str) -> DataFrame:
    """The report of the 100 highest ranks, numbered before nodes without a class are left out."""
    ranks = graph.pagerank(_links(spark, d), steps=STEPS).select("id", F.round("pagerank", 6).alias("pagerank"))
    best = ranks.orderBy(F.desc("pagerank"), "id").limit(100).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("pagerank"), "id")))
    return best.join(_brands(spark, d), "id").select("rank", "id", "gender", "pagerank")


def pagerank_compare(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    before = graph.pagerank(lines.where("l_linenumber <= 3").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")), steps=2)
    after = graph.pagerank(_links(spark, d), steps=2)
    rows = entities.compare_ranks(before, _brands(spark, d), after, _brands(spark, d))
    return rows.select("gender", F.round("before", 4).alias("before"), F.round("after", 4).alias("after"))


def class_weights(spark: SparkSession, d: str) -> DataFrame:
    ranks = graph.uniform_rank(_links(spark, d), steps=2).join(_brands(spark, d), "id")
    return ranks.groupBy("gender").agg(F.round(F.sum("weight") * 1000, 4).alias("weight"))


def shortest_path_len(spark: SparkSession, d: str) -> DataFrame:
    links = _parents(spark, d).select(F.col("id").alias("src"), F.col("parent").alias("dst"))
    start = links.agg(F.max("src")).first()[0]
    return graph.distances(links, start).select("id", "steps")


def closeness_harmonic(spark: SparkSession, d: str) -> DataFrame:
    links = _parents(spark, d).select(F.col("id").alias("src"), F.col("parent").alias("dst"))
    start = links.agg(F.max("src")).first()[0]
    return graph.closeness_harmonic(links, start).select(F.round("closeness", 6).alias("closeness"), F.round("harmonic", 6).alias("harmonic"))


def find_cycle(spark: SparkSession, d: str) -> DataFrame:
    """The shortest circle through the smallest category that is on one; empty if there is none."""
    links = _parents(spark, d).where("id <> parent").select(F.col("id").alias("src"), F.col("parent").alias("dst"))
    far = graph.reachable(links)
    start = far.where("src = dst").agg(F.min("src")).first()[0]
    found = graph.find_cycle(links, start) if start is not None else []
    return spark.createDataFrame(list(enumerate(found)), "pos int, id long")


def category_closure(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "page_categories").select("id", (F.col("id") % 20).cast("int").alias("classification")).distinct()
    return classify.ancestor_classes(_parents(spark, d), labels).select("id", F.array_join("classes", ",").alias("classes"))


def category_sets(spark: SparkSession, d: str) -> DataFrame:
    return classify.category_sets(table(spark, d, "page_categories")).select("id", F.array_join("categories", ",").alias("categories"))


def _gender_claims(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "claims").where("id <> 0")
    rows = rows.where(eav.attribute_code(F.col("property")) == "P21")
    return rows.select("id", eav.read_item(F.trim("claim_value")).alias("value"), eav.rank_code(F.col("claim_rank")).alias("rank")).where("value is not null")


def gender_infer(spark: SparkSession, d: str) -> DataFrame:
    return entities.infer_by_rows(_gender_claims(spark, d), ["id"])


def gender_infer_nested(spark: SparkSession, d: str) -> DataFrame:
    parsed = entities.parse_entities(table(spark, d, "raw_entities").dropDuplicates(["id"]), None, ["P21"])
    return parsed.select("wikidata_id", entities.infer_gender(F.try_element_at("claims", F.lit("P21"))).alias("gender"))


def gender_frequency(spark: SparkSession, d: str) -> DataFrame:
    return entities.frequency(_brands(spark, d))


def gender_link_targets(spark: SparkSession, d: str) -> DataFrame:
    return entities.link_comparison(_links(spark, d), _brands(spark, d))


def gender_section_share(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("section"))
    index = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("gender"))
    return entities.section_shares(links, index).withColumn("percent", F.round("percent", 6))


def claims_parse(spark: SparkSession, d: str) -> DataFrame:
    parsed = entities.parse_entities(table(spark, d, "raw_entities"), None, ["P21", "P31", "P569", "P9008"])
    rows = parsed.select("wikidata_id", F.explode("claims").alias("property", "list")).select("wikidata_id", "property", F.explode("list").alias("c"))
    return rows.select("wikidata_id", "property", "c.value", "c.rank")


def entity_articles(spark: SparkSession, d: str) -> DataFrame:
    parsed = entities.parse_entities(table(spark, d, "raw_entities"), _titles(spark, d), ["P21", "P31"])
    return parsed.select("id", "wikidata_id", "title").distinct()


def nb_train(spark: SparkSession, d: str) -> DataFrame:
    model = classify.train_bayes(_bags(spark, d), _labels(spark, d), table(spark, d, "word_dictionary"))
    return model.select("word", F.posexplode("logp").alias("classification", "logp")).select("word", "classification", F.round("logp", 6).alias("logp"))


def nb_classify(spark: SparkSession, d: str) -> DataFrame:
    model = classify.train_bayes(_bags(spark, d), _labels(spark, d), table(spark, d, "word_dictionary"))
    best = classify.classify_bayes(_bags(spark, d).groupBy("id").agg(F.max("words").alias("words")), model).select("id", F.get("classes", F.lit(0)).alias("c"))
    return best.select("id", "c.classification", F.round("c.p", 4).alias("p"))


def softmax(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    p = distributions.from_log(F.col("e"))
    return rows.select("vec_id", F.round(F.array_max(p), 8).alias("top"), F.round(F.get(p, F.lit(0)), 8).alias("first"))


def dist_normalize(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda x: F.abs(x)).alias("e"))
    p = distributions.normalize(F.col("e"))
    logs = distributions.to_log(p)
    return rows.select("vec_id", F.round(F.array_max(p), 8).alias("top"), F.round(F.array_max(distributions.add_logs(logs, logs)), 6).alias("log_top"))


def log_bins(spark: SparkSession, d: str) -> DataFrame:
    bins = distributions.logarithmic_bins(10, 10_000_000, 10 ** (1 / 3))
    return spark.createDataFrame([(x,) for x in bins], "bin long")


def _years(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", F.concat(F.lit("Events of "), (100 + F.col("c_custkey") % 2000).cast("string"), F.lit(" in Norway")).alias("title"))


def tag_title_year(spark: SparkSession, d: str) -> DataFrame:
    name = tagtree.category_name(F.col("title"), F.lit("Category:{{Title_year}} in {{title country}}"))
    return _years(spark, d).select("c_custkey", name.alias("category"))


def tag_century(spark: SparkSession, d: str) -> DataFrame:
    name = tagtree.category_name(F.col("title"), F.lit("{{century name from title year|dash}} events"))
    return _years(spark, d).select("c_custkey", name.alias("category"))


def tag_expression(spark: SparkSession, d: str) -> DataFrame:
    name = tagtree.category_name(F.col("title"), F.lit("{{#expr:{{title year}} + 10}} and {{title year-1}} of {{first word|{{PAGENAME}}}} {{last word|{{PAGENAME}}}}"))
    return _years(spark, d).select("c_custkey", name.alias("category"))


def topic_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", pages.topic_title(F.concat(F.lit("Category:history of the "), F.lower("n_name"))).alias("topic"))


QUERIES = {
    f.__name__: f
    for f in (
        word_count, word_min_count, normalize_text, normal_words, xml_tag_count, bigram_count, ngram_prefixes, word_ordinality, word_bag, ngram_tokens, ngram_discovery, ngram_discovery_all,
        frequency_union, title_index, view_by_ids, shard_counts, upsert_pages, page_sample, printed_pages, redirect_resolve, regex_links, first_page_links, links_resolved,
        link_lists, clean_text, clean_restricted, wikitext_sections, infobox_filter, page_categories_named, page_categories_joined, renamed_articles, kept_ids, deleted_ids,
        out_degree, in_degree, link_counts, two_hop_topics, class_matrix, pagerank_k, pagerank_converged, pagerank_filtered_k, pagerank_uniform_k, markov_k, pagerank_top,
        pagerank_compare, class_weights, shortest_path_len, closeness_harmonic, find_cycle, category_closure, category_sets, gender_infer, gender_infer_nested,
        gender_frequency, gender_link_targets, gender_section_share, claims_parse, entity_articles, nb_train, nb_classify, softmax, dist_normalize, log_bins,
        tag_title_year, tag_century, tag_expression, topic_titles,
    )
}

_WORDS = "SELECT word, count(*) AS count FROM (SELECT trim(unnest(regexp_extract_all({text}, '[\\w'']+')), '''') AS word FROM {source}) WHERE word <> '' GROUP BY word"
_DOC_WORDS = _WORDS.format(text="text", source="documents")
_TOKENS = "list_filter(list_transform(regexp_extract_all(text, '[\\w'']+'), lambda w: trim(w, '''')), lambda w: w <> '')"
_TITLES = "titles AS (SELECT id, max(title) AS title FROM page_texts WHERE id IS NOT NULL AND title IS NOT NULL GROUP BY id), ids AS (SELECT title, max(id) AS id FROM titles GROUP BY title)"
_DAYS = "days AS (SELECT min(corpus) AS a, max(corpus) AS b FROM page_snapshots WHERE id <> 0), old AS (SELECT id, title FROM page_snapshots, days WHERE id <> 0 AND corpus = a), new AS (SELECT id, title FROM page_snapshots, days WHERE id <> 0 AND corpus = b)"
_CODE = r"upper(regexp_replace(property, '^\s*([A-Za-z]+\s*:)?\s*|\s+$', '', 'g'))"
_PARENTS = "p AS (SELECT DISTINCT id, unnest(categories) AS parent FROM page_categories), e AS (SELECT id AS src, parent AS dst FROM p WHERE id IS NOT NULL AND parent IS NOT NULL)"


def _walk(steps: int, damping: float, start: str, restart: str, dead: bool, distinct: bool, self_links: bool, source: str = "SELECT l_partkey AS src, l_suppkey AS dst FROM lineitem", tag: str = "") -> str:
    """Common table expressions of a walk over links; the last is ``w<steps>``."""
    loops = "" if self_links else "WHERE src <> dst"
    parts = [
        f"raw{tag} AS ({source})",
        f"e{tag} AS (SELECT src, dst, {'1' if distinct else 'count(*)'} AS t FROM raw{tag} {loops} GROUP BY src, dst)",
        f"n{tag} AS (SELECT src AS id FROM raw{tag} UNION SELECT dst FROM raw{tag})",
        f"c{tag} AS (SELECT count(*) AS c FROM n{tag})",
        f"deg{tag} AS (SELECT src, sum(t) AS d FROM e{tag} GROUP BY src)",
        f"w{tag}0 AS (SELECT n.id, cast({start} AS double) AS w FROM n{tag} n, c{tag})",
    ]
    for k in range(1, steps + 1):
        lost = f" + {damping} * (SELECT coalesce(sum(w), 0) FROM w{tag}{k - 1} x WHERE NOT EXISTS (FROM deg{tag} g WHERE g.src = x.id)) / c" if dead else ""
        parts.append(f"m{tag}{k} AS (SELECT e.dst AS id, sum(w.w * e.t / g.d) AS m FROM w{tag}{k - 1} w JOIN e{tag} e ON e.src = w.id JOIN deg{tag} g ON g.src = e.src GROUP BY e.dst)")
        parts.append(f"w{tag}{k} AS (SELECT n.id, {damping} * coalesce(m, 0) + {restart}{lost} AS w FROM n{tag} n CROSS JOIN c{tag} LEFT JOIN m{tag}{k} m ON m.id = n.id)")
    return ", ".join(parts)


_RANK = _walk(STEPS, 0.85, "1", "0.15", True, False, True)
_CHOSEN = "CASE WHEN n.id IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#11') THEN {} ELSE 0 END"
_BFS = f"WITH RECURSIVE {_PARENTS}, d AS (SELECT max(src) AS id, 0 AS steps FROM e UNION SELECT e.dst, d.steps + 1 FROM d JOIN e ON e.src = d.id AND e.src <> e.dst WHERE d.steps < 60), best AS (SELECT id, min(steps) AS steps FROM d GROUP BY id)"
_NB = """
WITH bags AS (SELECT DISTINCT id, words FROM page_word_bags),
w AS (SELECT id, u.word, u.count FROM bags, unnest(words) AS t(u) WHERE u.word > 0 AND u.count > 0),
labels AS (SELECT id, min(classification) AS c FROM classified_articles WHERE classification > 0 GROUP BY id),
counts AS (SELECT word, c, sum(count) AS n FROM w JOIN labels USING (id) GROUP BY word, c),
totals AS (SELECT c, sum(n) AS t FROM counts GROUP BY c),
grid AS (SELECT ordinal AS word, c FROM word_dictionary, range(0, 20) AS r(c)),
l AS (SELECT g.word, g.c, ln((coalesce(n, 0) + 5) / (5 * (SELECT count(*) FROM word_dictionary) + coalesce(t, 0))) AS l
  FROM grid g LEFT JOIN counts k ON k.word = g.word AND k.c = g.c LEFT JOIN totals t ON t.c = g.c),
model AS (SELECT word, c, CASE WHEN word < 55 THEN 0.0 ELSE l - max(l) OVER (PARTITION BY word) END AS logp FROM l)
"""
_SNAK = "CASE WHEN trim(v) LIKE '{%' THEN coalesce(json_extract_string(v, '$.id'), json_extract_string(v, '$.time')) WHEN trim(v) LIKE '\"%' THEN json_extract_string(v, '$') END"

SQL = {
    "word_count": _DOC_WORDS,
    "word_min_count": f"SELECT * FROM ({_DOC_WORDS}) WHERE count >= 40",
    "normalize_text": "SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(lower(text), '\\b\\d+(,\\d{3})*(\\.\\d+)?\\b', '_num_', 'g'), '_num_%', '_percent_', 'g'), '(?i)\\b(_num_ ((january|february|march|april|may|june|july|august|september|october|november|december),? )?_num_|(january|february|march|april|may|june|july|august|september|october|november|december) _num_,? _num_)\\b', '_date_', 'g') AS text FROM documents",
    "normal_words": f"SELECT trim(lower(word), '''') AS word, cast(sum(count) AS bigint) AS count FROM ({_DOC_WORDS}) GROUP BY 1",
    "xml_tag_count": "SELECT word, count(*) AS count FROM (SELECT unnest(regexp_extract_all(text, '<[a-z][a-z0-9]+')) AS word FROM page_texts) GROUP BY word",
    "bigram_count": f"WITH t AS (SELECT {_TOKENS} AS w FROM documents), p AS (SELECT w[i] || ' ' || w[i + 1] AS word FROM t, unnest(range(1, len(w))) AS r(i)) SELECT word, count(*) AS count FROM p GROUP BY word HAVING count(*) >= 10",
    "ngram_prefixes": "WITH t AS (SELECT string_split(title, ' ') AS w FROM page_texts WHERE title IS NOT NULL) SELECT DISTINCT array_to_string(w[1:i], ' ') AS word FROM t, unnest(range(1, len(w) + 1)) AS r(i)",
    "word_ordinality": f"SELECT word, cast(row_number() OVER (ORDER BY count DESC, word) AS int) AS ordinal FROM ({_DOC_WORDS}) WHERE count >= 20",
    "word_bag": f"WITH t AS (SELECT doc_id AS id, unnest({_TOKENS}) AS word FROM documents), c AS (SELECT id, d.ordinal, count(*) AS n FROM t JOIN word_dictionary d USING (word) GROUP BY id, d.ordinal) SELECT id, string_agg(ordinal || ':' || n, ' ' ORDER BY ordinal) AS words FROM c GROUP BY id",
    "ngram_discovery": f"WITH lines AS (SELECT unnest(string_split(text, chr(10))) AS text FROM documents), t AS (SELECT {_TOKENS} AS w FROM lines), c AS (SELECT word, count(*) AS count FROM (SELECT unnest(w) AS word FROM t) GROUP BY word HAVING count(*) >= 40), p AS (SELECT w[i] AS a, w[i + 1] AS b FROM t, unnest(range(1, len(w))) AS r(i)), g AS (SELECT a || ' ' || b AS word, count(*) AS count FROM p WHERE a IN (SELECT word FROM c) AND b IN (SELECT word FROM c) GROUP BY 1 HAVING count(*) >= 40) SELECT * FROM c UNION ALL SELECT * FROM g",
    "frequency_union": " UNION ALL ".join(_WORDS.format(text="text", source=f"(SELECT text FROM documents WHERE lower(lang) = '{x}')") for x in ("de", "fr")),
    "title_index": f"WITH {_TITLES} SELECT id, title FROM titles",
    "view_by_ids": f"SELECT doc_id AS id, title, text FROM documents WHERE doc_id IN ({', '.join(map(str, VIEWED))})",
    "shard_counts": "SELECT cast(doc_id % 100 AS int) AS shard, count(*) AS pages FROM documents GROUP BY 1",
    "upsert_pages": "SELECT id, max(loaded_at) AS loaded_at FROM page_snapshots WHERE id <> 0 GROUP BY id",
    "printed_pages": "SELECT '{\"classification\":' || classification || ',\"class_name\":\"' || replace(class_name, ' ', '') || '\"}' AS value FROM class_names",
    "redirect_resolve": f"""WITH RECURSIVE {_TITLES}, last AS (SELECT title, redirect FROM redirects WHERE title IS NOT NULL AND redirect IS NOT NULL QUALIFY row_number() OVER (PARTITION BY title ORDER BY seen_at DESC, redirect DESC) = 1),
      moves AS (SELECT title, redirect FROM last WHERE title <> redirect AND title NOT IN (SELECT title FROM titles)),
      walk AS (SELECT title, title AS cur, 0 AS hops FROM last UNION ALL SELECT w.title, m.redirect, w.hops + 1 FROM walk w JOIN moves m ON m.title = w.cur WHERE w.hops < 500),
      ends AS (SELECT title, cur, hops FROM walk WHERE cur NOT IN (SELECT title FROM moves))
      SELECT l.title, e.cur AS destination, cast(e.hops AS bigint) AS hops FROM last l LEFT JOIN ends e ON e.title = l.title""",
    "regex_links": r"SELECT string_split(regexp_replace(l, '^\[\[|\]\]$', '', 'g'), '|')[1] AS target, count(*) AS links FROM (SELECT unnest(regexp_extract_all(text, '\[\[[^\]]+\]\]')) AS l FROM page_texts) GROUP BY 1",
    "first_page_links": r"SELECT id, count(*) AS links FROM (SELECT id, unnest(regexp_extract_all(text, '\[\[[^\]]+\]\]')[1:2]) AS l FROM page_texts) GROUP BY id",
    "links_resolved": f"WITH {_TITLES}, r AS (SELECT t.id, i.id AS link FROM titles t JOIN ids i ON i.title = upper(left(t.title, 1)) || substr(t.title, 2)) SELECT id, 0 AS pos, '' AS section, link FROM r UNION ALL SELECT id, 2, 'Notes', link FROM r",
    "link_lists": f"WITH {_TITLES} SELECT t.id, cast(count(i.id) AS int) AS links FROM titles t LEFT JOIN ids i ON i.title = upper(left(t.title, 1)) || substr(t.title, 2) GROUP BY t.id",
    "clean_restricted": f"WITH {_TITLES} SELECT id, 'See it and Nowhere.' || chr(10) || 'Life' || chr(10) || title AS text FROM titles",
    "infobox_filter": f"SELECT DISTINCT id FROM page_texts WHERE regexp_matches(lower(text), 'infobox ({'|'.join(BOXES)})' || chr(10))",
    "page_categories_named": "SELECT c_custkey AS id, 0 AS pos, 'category:' || (1000 + c_custkey % 1000) || ' in ' || lower(c_mktsegment) AS name FROM customer UNION ALL SELECT c_custkey, 1, 'category:customers' FROM customer",
    "page_categories_joined": "SELECT cast(n_nationkey AS bigint) AS id, 0 AS pos, cast(n_nationkey + 100 AS bigint) AS category FROM nation",
    "renamed_articles": f"""WITH {_DAYS}, o AS (SELECT id, max(title) AS title FROM (SELECT title, max(id) AS id FROM old GROUP BY title) GROUP BY id), n AS (SELECT id, max(title) AS title FROM (SELECT title, max(id) AS id FROM new GROUP BY title) GROUP BY id),
      k AS (SELECT count(*) AS before, (SELECT count(*) FROM n) AS after, count(*) FILTER (n.id IS NOT NULL AND n.title <> o.title) AS renamed, count(*) FILTER (n.id IS NULL) AS deleted FROM o LEFT JOIN n ON n.id = o.id)
      SELECT before, after, renamed, deleted, (after - before) / after AS added_share, deleted / before AS deleted_share, renamed / (before - deleted) AS renamed_share FROM k""",
    "kept_ids": f"WITH {_DAYS} SELECT id FROM old INTERSECT SELECT id FROM new",
    "deleted_ids": f"WITH {_DAYS} SELECT id FROM old EXCEPT SELECT id FROM new",
    "out_degree": "WITH n AS (SELECT l_partkey AS id FROM lineitem UNION SELECT l_suppkey FROM lineitem) SELECT n.id, count(l_partkey) AS degree FROM n LEFT JOIN lineitem ON l_partkey = n.id GROUP BY n.id",
    "in_degree": "WITH n AS (SELECT l_partkey AS id FROM lineitem UNION SELECT l_suppkey FROM lineitem) SELECT n.id, count(l_suppkey) AS degree FROM n LEFT JOIN lineitem ON l_suppkey = n.id AND l_partkey <> l_suppkey GROUP BY n.id",
    "link_counts": "WITH n AS (SELECT l_partkey AS id FROM lineitem UNION SELECT l_suppkey FROM lineitem), k AS (SELECT n.id, count(l_partkey) AS degree FROM n LEFT JOIN lineitem ON l_partkey = n.id GROUP BY n.id) SELECT cast(sum(degree) AS bigint) AS links, count(*) FILTER (degree = 0) AS singletons, count(*) AS nodes FROM k",
    "two_hop_topics": "WITH e AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_partkey <> l_suppkey), a AS (SELECT src AS root, dst AS topic FROM e WHERE src IN (SELECT p_partkey FROM part WHERE p_size <= 5)), b AS (SELECT root, topic FROM a UNION SELECT a.root, e.dst FROM a JOIN e ON e.src = a.topic) SELECT topic, count(*) AS roots FROM b WHERE root <> topic GROUP BY topic",
    "class_matrix": "WITH r AS (SELECT coalesce(a.p_brand, 'other') AS from_class, coalesce(b.p_brand, 'other') AS to_class, count(*) AS links FROM lineitem LEFT JOIN part a ON a.p_partkey = l_partkey LEFT JOIN part b ON b.p_partkey = l_suppkey GROUP BY 1, 2) SELECT *, round(links / sum(links) OVER (PARTITION BY from_class), 6) AS share FROM r",
    "pagerank_k": f"WITH {_RANK} SELECT id, round(w, 6) AS pagerank FROM w{STEPS}",
    "pagerank_filtered_k": f"WITH {_walk(STEPS, 0.85, _CHOSEN.format(1), _CHOSEN.format(0.15), True, False, True)} SELECT id, round(w, 6) AS pagerank FROM w{STEPS}",
    "pagerank_uniform_k": f"WITH {_walk(STEPS, 0.99, '1.0 / c', '0.01 / c', True, True, False)} SELECT id, round(w * 1000, 6) AS weight FROM w{STEPS}",
    "markov_k": f"WITH {_walk(STEPS, 1.0, '1', '0', False, True, True)} SELECT id, round(w, 6) AS weight FROM w{STEPS}",
    "pagerank_top": f"WITH {_RANK}, r AS (SELECT id, round(w, 6) AS pagerank FROM w{STEPS}), b AS (SELECT cast(row_number() OVER (ORDER BY pagerank DESC, id) AS int) AS rank, id, pagerank FROM r) SELECT rank, id, p_brand AS gender, pagerank FROM b JOIN part ON p_partkey = id WHERE rank <= 100",
    "pagerank_compare": f"WITH {_walk(2, 0.85, '1', '0.15', True, False, True, 'SELECT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_linenumber <= 3', 'x')}, {_walk(2, 0.85, '1', '0.15', True, False, True)}, a AS (SELECT p_brand AS gender, sum(w) AS before FROM wx2 JOIN part ON p_partkey = id GROUP BY 1), b AS (SELECT p_brand AS gender, sum(w) AS after FROM w2 JOIN part ON p_partkey = id GROUP BY 1) SELECT gender, round(before, 4) AS before, round(coalesce(after, 0), 4) AS after FROM a LEFT JOIN b USING (gender)",
    "class_weights": f"WITH {_walk(2, 0.99, '1.0 / c', '0.01 / c', True, True, False)} SELECT p_brand AS gender, round(sum(w) * 1000, 4) AS weight FROM w2 JOIN part ON p_partkey = id GROUP BY 1",
    "shortest_path_len": f"{_BFS} SELECT id, steps FROM best",
    "closeness_harmonic": f"{_BFS}, n AS (SELECT src AS id FROM e UNION SELECT dst FROM e) SELECT round((SELECT count(*) - 1 FROM n) / sum(steps), 6) AS closeness, round(sum(1 / steps) / (SELECT count(*) - 1 FROM n), 6) AS harmonic FROM best WHERE steps > 0",
    "category_closure": f"WITH RECURSIVE {_PARENTS}, up AS (SELECT src, dst FROM e UNION SELECT up.src, e.dst FROM up JOIN e ON e.src = up.dst), pairs AS (SELECT src AS id, dst AS up FROM up UNION SELECT src, src FROM e) SELECT id, string_agg(c, ',' ORDER BY cast(c AS int)) AS classes FROM (SELECT DISTINCT pairs.id, cast(up % 20 AS varchar) AS c FROM pairs JOIN (SELECT DISTINCT id FROM page_categories) k ON k.id = pairs.up) GROUP BY id",
    "category_sets": "SELECT id, string_agg(cast(parent AS varchar), ',' ORDER BY parent) AS categories FROM (SELECT DISTINCT id, unnest(categories) AS parent FROM page_categories) WHERE parent IS NOT NULL GROUP BY id",
    "gender_infer": rf"""WITH r AS (SELECT id, 'Q' || nullif(regexp_extract(CASE WHEN trim(claim_value) LIKE '{{%' THEN json_extract_string(claim_value, '$.id') ELSE trim(claim_value) END, '^\s*([A-Za-z]+:|https?://\S+/)?[Qq]([1-9][0-9]*)\s*$', 2), '') AS value, lower(regexp_replace(coalesce(claim_rank, ''), '^\s+|\s+$', '', 'g')) AS rank FROM claims WHERE id <> 0 AND {_CODE} = 'P21'),
      c AS (SELECT *, CASE value WHEN 'Q96000630' THEN 'Q48270' WHEN 'Q2449503' THEN 'Q6581097' WHEN 'Q1052281' THEN 'Q6581072' WHEN 'Q104717073' THEN 'Q1097630' ELSE value END AS same, rank <> 'deprecated' AS live FROM r WHERE value IS NOT NULL)
      SELECT id, CASE WHEN count(*) FILTER (live) = 0 THEN 'NO CLAIMS' WHEN count(*) FILTER (live) = 1 THEN max(value) FILTER (live) WHEN count(*) FILTER (rank = 'preferred') = 1 THEN max(value) FILTER (rank = 'preferred')
        WHEN count(DISTINCT same) FILTER (live) = 1 THEN max(same) FILTER (live) ELSE 'CONFLICTING CLAIMS' END AS gender FROM c GROUP BY id""",
    "gender_frequency": "SELECT p_brand AS gender, count(*) AS count FROM part GROUP BY 1",
    "gender_link_targets": "WITH a AS (SELECT p_brand AS gender, count(DISTINCT l_partkey) AS linking FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1), b AS (SELECT p_brand AS gender, count(*) AS linked FROM lineitem JOIN part ON p_partkey = l_suppkey GROUP BY 1) SELECT coalesce(a.gender, b.gender) AS gender, coalesce(linking, 0) AS linking, coalesce(linked, 0) AS linked FROM a FULL JOIN b USING (gender)",
    "gender_section_share": "WITH r AS (SELECT c_mktsegment AS gender, event_type AS section, count(*) AS links FROM events JOIN customer ON c_custkey = user_id GROUP BY 1, 2) SELECT gender, section, links, round(100.0 * links / sum(links) OVER (PARTITION BY gender), 6) AS percent FROM r",
    "claims_parse": f"""WITH l AS (SELECT id, u.key AS property, u.value AS list FROM raw_entities, unnest(map_entries(claims)) AS t(u)), c AS (SELECT id, property, list[i] AS c FROM l, unnest(range(1, len(list) + 1)) AS r(i)),
      v AS (SELECT id AS wikidata_id, property, c.mainsnak.datavalue.value AS v, coalesce(c.rank, 'normal') AS rank FROM c WHERE c IS NOT NULL AND property IN ('P21', 'P31', 'P569', 'P9008'))
      SELECT wikidata_id, property, {_SNAK} AS value, rank FROM v WHERE {_SNAK} IS NOT NULL""",
    "nb_train": _NB + "SELECT word, cast(c AS int) AS classification, round(logp, 6) AS logp FROM model",
    "nb_classify": _NB
    + """, one AS (SELECT id, max(words) AS words FROM bags GROUP BY id), x AS (SELECT id, u.word, u.count FROM one, unnest(words) AS t(u) WHERE u.word > 0 AND u.count > 0),
      s AS (SELECT id, c, sum(count * logp) AS s FROM x JOIN model USING (word) WHERE c > 0 GROUP BY id, c), b AS (SELECT *, max(s) OVER (PARTITION BY id) AS best FROM s), p AS (SELECT id, c, exp(s - best) / sum(exp(s - best)) OVER (PARTITION BY id) AS p FROM b)
      SELECT id, cast(c AS int) AS classification, round(p, 4) AS p FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY p DESC, c) = 1""",
    "softmax": "WITH e AS (SELECT vec_id, cast(embedding AS double[]) AS e FROM embeddings), x AS (SELECT vec_id, list_transform(e, lambda v: exp(v - list_max(e))) AS x FROM e) SELECT vec_id, round(list_max(x) / list_sum(x), 8) AS top, round(x[1] / list_sum(x), 8) AS first FROM x",
    "dist_normalize": "WITH e AS (SELECT vec_id, list_transform(cast(embedding AS double[]), lambda v: abs(v)) AS e FROM embeddings) SELECT vec_id, round(list_max(e) / list_sum(e), 8) AS top, round(2 * ln(list_max(e) / list_sum(e)), 6) AS log_top FROM e",
    "log_bins": "WITH RECURSIVE b AS (SELECT cast(10 AS double) AS x UNION ALL SELECT x * pow(10.0, 1.0 / 3.0) FROM b WHERE x * pow(10.0, 1.0 / 3.0) <= 10000000) SELECT cast(round(x) AS bigint) AS bin FROM b",
    "tag_title_year": "SELECT c_custkey, 'Category:' || (100 + c_custkey % 2000) || ' in Norway' AS category FROM customer",
    "tag_century": "WITH y AS (SELECT c_custkey, (100 + c_custkey % 2000 + 99) // 100 AS c FROM customer) SELECT c_custkey, c || CASE WHEN (c % 100) // 10 = 1 THEN 'th' WHEN c % 10 = 1 THEN 'st' WHEN c % 10 = 2 THEN 'nd' WHEN c % 10 = 3 THEN 'rd' ELSE 'th' END || '-century events' AS category FROM y",
    "tag_expression": "SELECT c_custkey, (110 + c_custkey % 2000) || ' and ' || (99 + c_custkey % 2000) || ' of Events Norway' AS category FROM customer",
    "entity_articles": f"WITH {_TITLES}, l AS (SELECT id, sitelinks['enwiki'].title AS title, u.key AS property, u.value AS list FROM raw_entities, unnest(map_entries(claims)) AS t(u)), c AS (SELECT line, id, title, property, list[i].mainsnak.datavalue.value AS v FROM (SELECT row_number() OVER () AS line, * FROM l), unnest(range(1, len(list) + 1)) AS r(i)) SELECT DISTINCT ids.id, c.id AS wikidata_id, ids.title FROM c JOIN ids ON ids.title = c.title WHERE property IN ('P21', 'P31') AND {_SNAK} IS NOT NULL",
}
