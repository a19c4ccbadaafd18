"""Named jobs and workflows over the tables of a corpus.

A configuration names jobs, each with a command and settings, and workflows, each a list of jobs that run one after
another and stop at the first error. Tables lie at ``workspace/corpus/<path>``."""

from __future__ import annotations

import argparse
import cProfile
import contextlib
import json
import logging
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tesselark.functions import nlp
from tesselark.operators import entities, graph, pages, words
from tesselark.runtime import cut
from tesselark.sources import dumps, tables

log = logging.getLogger(__name__)


@dataclass
class Job:
    command: str
    settings: dict = field(default_factory=dict)


@dataclass
class Config:
    jobs: dict[str, Job] = field(default_factory=dict)
    workflows: dict[str, list[str]] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> Config:
        """From a YAML or JSON file."""
        text = Path(path).read_text()
        if path.endswith(".json"):
            raw = json.loads(text)
        else:
            import yaml

            raw = yaml.safe_load(text)
        jobs = {name: Job(j.get("subCommand", j.get("command", name)), j.get("settings") or {}) for name, j in (raw.get("jobs") or {}).items()}
        return cls(jobs, raw.get("workflows") or {})


class Corpus:
    """The tables of one corpus."""

    def __init__(self, spark: SparkSession, workspace: str, name: str):
        self.spark, self.folder = spark, f"{workspace}/{name}"
        #: Counters of what has been read and written, by table.
        self.counters: dict[str, dict] = {}

    def read(self, path: str) -> DataFrame:
        return tables.read(self.spark, f"{self.folder}/{path}")

    def write(self, rows: DataFrame, path: str) -> DataFrame:
        """Write a table and read it back; how many rows were written is counted on the way."""
        seen = Observation()
        tables.write(rows.observe(seen, F.count("*").alias("rows")), f"{self.folder}/{path}")
        self.report(path, seen.get)
        return self.read(path)

    def report(self, what: str, counters: dict) -> None:
        self.counters.setdefault(what, {}).update(counters)
        log.info("%s: %s", what, ", ".join(f"{v} {k}" for k, v in counters.items()))


def _edges(links: DataFrame) -> DataFrame:
    return links.select(F.col("id").alias("src"), F.explode("links").alias("dst"))


def ingest(c: Corpus, s: dict, articles: str, index: str | None = None) -> DataFrame:
    spaces = s.get("namespaces", [0])
    if index is not None:
        dumps.corpus_of(articles, index)  # of one dump
    dump = cut(dumps.read_dump(c.spark, articles).where(F.col("ns").isin(list(spaces))), "dump")  # read and parsed once
    c.write(dumps.dump_redirects(dump, spaces), s.get("outRedirects", "redirects"))
    out = f"{c.folder}/{s.get('out', 'articles')}"
    tables.write_sharded(dumps.articles(dump, spaces), out)
    return c.read(s.get("out", "articles"))


def clean(c: Corpus, s: dict) -> DataFrame:
    return c.write(pages.clean(c.read(s["in"])), s["out"])


def title_index(c: Corpus, s: dict) -> DataFrame:
    return c.write(pages.title_index(c.read(s["in"])), s["out"])


def links(c: Corpus, s: dict) -> DataFrame:
    articles, titles = c.read(s["in"]), c.read(s["index"])
    ends = pages.resolve_redirects(pages.redirect_targets(c.read(s["redirects"])), titles) if s.get("redirects") else None
    found = pages.resolved_links(pages.page_links(articles), titles, ends, s.get("ignoredSections", []), s.get("ignoreCategories", False))
    return c.write(pages.link_lists(articles, found), s["out"])


def ingest_wikidata(c: Corpus, s: dict, dump: str) -> DataFrame:
    raw, seen = dumps.read_entities_counted(c.spark, dump)
    out = c.write(entities.parse_entities(raw, c.read(s["index"]), s["claims"], s.get("instanceOf", []), s.get("requireArticle", [])), s["out"])
    c.report("ingest-wikidata", seen.get)
    return out


def gender_index(c: Corpus, s: dict) -> DataFrame:
    return c.write(entities.gender_index(c.read(s["wikidata"])), s["out"])


def gender_frequency(c: Corpus, s: dict) -> DataFrame:
    return entities.frequency(c.read(s.get("genderIndex", s.get("in")))).withColumn("gender", entities.gender_label(F.col("gender")))


def gender_comparison(c: Corpus, s: dict, after: Corpus | None = None) -> DataFrame:
    """Articles and links by gender; with ``articles`` the shares of sections instead; with a second corpus both, one beside the other."""

    def one(corpus: Corpus) -> DataFrame:
        index = corpus.read(s["genderIndex"])
        if s.get("articles"):
            rows = corpus.read(s["articles"])
            found = pages.page_links(rows).select("id", F.trim("section").alias("section"))
            return entities.section_shares(found, index, s.get("top", 20))
        return entities.link_comparison(_edges(corpus.read(s["links"])), index)

    if after is None:
        return one(c)
    keys = ["gender", "section"] if s.get("articles") else ["gender"]
    values = ["links", "percent"] if s.get("articles") else ["linking", "linked"]
    sides = [one(x).select(*keys, *(F.col(v).alias(f"{v}_{name}") for v in values)) for x, name in ((c, "before"), (after, "after"))]
    return sides[0].join(sides[1], keys, "full")


def pagerank(c: Corpus, s: dict) -> DataFrame:
    nodes, chosen = c.read(s["index"]).select("id"), None
    if s.get("genderFilter"):
        nodes = nodes.join(c.read(s["genderIndex"]), "id", "left")
        chosen = F.col("gender") == s["genderFilter"]
    ranks = c.write(graph.pagerank(_edges(c.read(s["links"])), nodes, s.get("steps"), chosen=chosen), s["out"])
    if s.get("outReport"):
        c.write(graph.rank_report(ranks, c.read(s["index"]), s.get("top", 100)), s["outReport"])
    return ranks


def pagerank_compare(c: Corpus, s: dict, after: Corpus) -> DataFrame:
    rows = entities.compare_ranks(c.read(s["pageRanks"]), c.read(s["genderIndex"]), after.read(s["pageRanks"]), after.read(s["genderIndex"]))
    return rows.orderBy(F.desc("before"))


def renamed_articles(c: Corpus, s: dict, after: Corpus) -> DataFrame:
    return pages.compare_titles(c.read(s["index"]), after.read(s["index"]))


def view(c: Corpus, s: dict) -> DataFrame:
    return pages.view(c.read(s["in"]), s.get("ids"), s.get("titles"))


def ngrams(c: Corpus, s: dict) -> DataFrame:
    rows = c.read(s["in"])
    if s.get("subsample", 1.0) < 1.0:
        rows = rows.sample(s["subsample"], s.get("seed", 0))
    found = words.discover_ngrams(rows, nlp.words(nlp.normal_article(F.col("text"))), s.get("minCount", words.NGRAM_COUNT))
    return words.report_order(c.write(found, s["out"]))


def normalize(c: Corpus, s: dict) -> DataFrame:
    return c.write(c.read(s["in"]).withColumn("text", nlp.normal_article(F.col("text"))), s["out"])


def _raw_edges(c: Corpus, s: dict, first: int | None = None) -> DataFrame:
    rows = c.read(s["in"])
    found = pages.raw_links(rows, first).join(pages.by_title(rows).withColumnRenamed("title", "target").withColumnRenamed("id", "dst"), "target")
    return found.select(F.col("id").alias("src"), "dst")


def first_links(c: Corpus, s: dict) -> DataFrame:
    rows = c.read(s["in"])
    people = rows.where(pages.is_person(F.col("text"))).select("id")
    topics = graph.two_hop_topics(_raw_edges(c, s, s.get("first", 20)), people)
    return topics.join(pages.title_index(rows).withColumnRenamed("id", "topic"), "topic").orderBy(F.desc("roots"), "topic").limit(s.get("top", 1000))


def _classes(c: Corpus, s: dict) -> DataFrame:
    item = F.col("gender")
    name = F.when(item == entities.WOMAN, "female").when(item == entities.MAN, "male").when(item.isin(entities.NON_BINARY, entities.CONFLICT), "non-biography").otherwise("unknown")
    return c.read(s["in"]).select("id").join(c.read(s["genderIndex"]), "id", "left").select("id", name.alias("class"))


def reference_network(c: Corpus, s: dict) -> DataFrame:
    """Links between classes; with ``outTotals`` also how many pages each class has, and how many links and pages without any there are."""
    classes = _classes(c, s)
    if s.get("outTotals"):
        edges = _raw_edges(c, s)
        degree = graph.out_degree(edges, c.read(s["in"]).select("id").distinct())
        sizes = classes.groupBy("class").agg(F.count("*").alias("n")).select(F.concat(F.lit("class "), "class").alias("name"), "n")
        totals = degree.agg(F.sum("degree").alias("links"), F.count_if(F.col("degree") == 0).alias("singletons"))
        c.write(sizes.unionByName(totals.select(F.explode(F.create_map(F.lit("links"), "links", F.lit("singletons"), "singletons")).alias("name", "n"))), s["outTotals"])
    return entities.class_matrix(_raw_edges(c, s), classes, "non-biography")


def reference_network_2(c: Corpus, s: dict) -> DataFrame:
    ranks = graph.uniform_rank(_raw_edges(c, s), c.read(s["in"]).select("id"))
    return ranks.join(_classes(c, s), "id").groupBy("class").agg(F.sum("weight").alias("weight"))


COMMANDS: dict[str, Callable] = {
    "ingest": ingest, "clean": clean, "title-index": title_index, "links": links, "ingest-wikidata": ingest_wikidata, "gender-index": gender_index,
    "gender-frequency": gender_frequency, "gender-comparison": gender_comparison, "pagerank": pagerank, "pagerank-compare": pagerank_compare,
    "renamed-articles": renamed_articles, "view": view, "ngrams": ngrams, "normalize": normalize, "first-links": first_links,
    "reference-network": reference_network, "reference-network-2": reference_network_2,
}
#: Commands that take dump files instead of further corpora.
FILE_COMMANDS = {"ingest", "ingest-wikidata"}
#: Settings of each command; others are errors.
SETTINGS: dict[str, set[str]] = {
    "ingest": {"namespaces", "out", "outRedirects"}, "clean": {"in", "out"}, "title-index": {"in", "out"}, "links": {"in", "index", "redirects", "out", "ignoredSections", "ignoreCategories"},
    "ingest-wikidata": {"index", "claims", "instanceOf", "requireArticle", "out"}, "gender-index": {"wikidata", "out"}, "gender-frequency": {"genderIndex", "in"},
    "gender-comparison": {"links", "genderIndex", "articles", "top"}, "pagerank": {"index", "links", "genderIndex", "genderFilter", "steps", "out", "outReport", "top"},
    "pagerank-compare": {"pageRanks", "genderIndex"}, "renamed-articles": {"index"}, "view": {"in", "ids", "titles"}, "ngrams": {"in", "out", "minCount", "subsample", "seed"},
    "normalize": {"in", "out"}, "first-links": {"in", "first", "top"}, "reference-network": {"in", "genderIndex", "outTotals"}, "reference-network-2": {"in", "genderIndex"},
}


def command(name: str, settings: set[str] | None = None, files: bool = False) -> Callable[[Callable], Callable]:
    """Add a command of one's own: a function of a corpus, its settings and further corpora (or ``files``), that reads, maps and writes
    as it likes. Without ``settings`` any setting is allowed."""

    def add(function: Callable) -> Callable:
        COMMANDS[name] = function
        if settings is not None:
            SETTINGS[name] = set(settings)
        if files:
            FILE_COMMANDS.add(name)
        return function

    return add


def run_job(spark: SparkSession, config: Config, name: str, workspace: str, *corpora: str, files: list[str] = ()) -> DataFrame:
    if name not in config.jobs:
        raise KeyError(f"no job is called {name!r}")
    job = config.jobs[name]
    if job.command not in COMMANDS:
        raise KeyError(f"no command is called {job.command!r}")
    if wrong := sorted(set(job.settings) - SETTINGS.get(job.command, set(job.settings))):
        raise KeyError(f"the job {name!r} has no setting {wrong[0]!r}")
    first, *rest = (Corpus(spark, workspace, c) for c in corpora)
    more = files if job.command in FILE_COMMANDS else rest
    return COMMANDS[job.command](first, job.settings, *more)


def run(spark: SparkSession, config: Config, name: str, workspace: str, *corpora: str, files: list[str] = ()) -> DataFrame:
    """A workflow, or else a job, by name; the result of the last job."""
    result = None
    for step in config.workflows.get(name, [name]):
        result = run_job(spark, config, step, workspace, *corpora, files=list(files))
    return result


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tesselark", description="Run a job or workflow over corpora.")
    p.add_argument("name")
    p.add_argument("corpora", nargs="+")
    p.add_argument("--config", required=True)
    p.add_argument("--workspace", default=".")
    p.add_argument("--file", action="append", default=[], help="dump file of an ingest job")
    p.add_argument("--parallel", type=int, help="cores to use")
    p.add_argument("--profile", help="file for a profile of the driver")
    a = p.parse_args(args)
    builder = SparkSession.builder.appName(f"tesselark {a.name}")
    spark = (builder.master(f"local[{a.parallel}]") if a.parallel else builder).getOrCreate()
    with cProfile.Profile() if a.profile else contextlib.nullcontext() as profile:
        run(spark, Config.load(a.config), a.name, a.workspace, *a.corpora, files=a.file).show(100, truncate=False)
    if profile:
        profile.dump_stats(a.profile)
