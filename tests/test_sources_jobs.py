import bz2
import json
import random

import pytest
from pyspark.sql import functions as F

from tesselark.plans import jobs
from tesselark.sources import dumps, tables
from tesselark.streaming import ingest

from .conftest import rows


def page(i, title, text, ns=0, redirect=None):
    r = f'<redirect title="{redirect}" />' if redirect else ""
    return f'  <page>\n    <title>{title}</title>\n    <ns>{ns}</ns>\n    <id>{i}</id>\n    {r}\n    <revision>\n      <id>9</id>\n      <text xml:space="preserve">{text}</text>\n    </revision>\n  </page>\n'


PAGES = [
    page(1, "Oak", "  An [[acorn]] &amp; &lt;ref&gt;x&lt;/ref&gt; tree.\n\n== Notes ==\n[[Elm]] "),
    page(2, "Acorn", "The [[oak]] has [[Old elm]]."),
    page(3, "Elm", "{{Infobox writer\n|x=y}} [[Oak]]"),
    page(4, "Old elm", "#REDIRECT [[Elm]]", redirect="Elm"),
    page(5, "Talk:Oak", "chat", ns=1),
]


@pytest.fixture
def dump(tmp_path):
    """Three compressed streams one after another: the head of the site, pages, and the tail."""
    path = tmp_path / "testwiki-20230101-pages-articles-multistream.xml.bz2"
    streams = ["<mediawiki>\n  <siteinfo><sitename>x</sitename></siteinfo>\n", "".join(PAGES[:3]), "".join(PAGES[3:]), "</mediawiki>\n"]
    path.write_bytes(b"".join(bz2.compress(s.encode()) for s in streams))
    index = tmp_path / "testwiki-20230101-pages-articles-multistream-index.txt"
    index.write_text("55:1:Oak\n55:2:Acorn\n55:3:Elm: a tree\n99:4:Old elm\n")
    return str(path), str(index)


def test_dump(spark, dump):
    d = dumps.read_dump(spark, dump[0])
    assert rows(dumps.articles(d).select("id", "title")) == [(1, "Oak"), (2, "Acorn"), (3, "Elm")]
    assert dumps.articles(d).where("id = 1").first().text == "  An [[acorn]] & <ref>x</ref> tree.\n\n== Notes ==\n[[Elm]] "
    assert rows(dumps.dump_redirects(d)) == [("Old elm", "Elm")]
    assert rows(dumps.articles(d, [1]).select("id")) == [(5,)]
    assert rows(dumps.read_index(spark, dump[1])) == [(55, 1, "Oak"), (55, 2, "Acorn"), (55, 3, "Elm: a tree"), (99, 4, "Old elm")]
    assert rows(dumps.stream_offsets(dumps.read_index(spark, dump[1]))) == [(55,), (99,)]


def test_names():
    assert dumps.corpus_of("enwiki-20230101-pages-articles-multistream1.xml-p1p41242.bz2", "enwiki-20230101-pages-articles-multistream-index1.txt-p1p41242.bz2") == "20230101.1"
    assert dumps.corpus_of("enwiki-20230101-pages-articles-multistream.xml.bz2") == "20230101"
    assert dumps.entity_corpus("wikidata-20230109-all.json.bz2") == "20230101"
    with pytest.raises(ValueError):
        dumps.corpus_of("enwiki-20230101-pages-articles-multistream.xml.bz2", "enwiki-20230102-pages-articles-multistream-index.txt.bz2")
    with pytest.raises(ValueError):
        dumps.corpus_of("x.xml")


def test_entities(spark, tmp_path):
    lines = [
        {"id": "Q1", "sitelinks": {"enwiki": {"site": "enwiki", "title": "Oak"}}, "claims": {"P31": [{"mainsnak": {"property": "P31", "datavalue": {"value": {"id": "Q5"}, "type": "x"}}, "rank": "normal"}]}},
        {"id": "Q2", "sitelinks": {}, "claims": []},
    ]
    path = tmp_path / "x-20230109-all.json"
    path.write_text("[\n" + ",\n".join(json.dumps(x) for x in lines) + "\n]\n")
    got = dumps.read_entities(spark, str(path)).orderBy("id").collect()
    assert [r.id for r in got] == ["Q1", "Q2"] and not got[1].claims
    assert json.loads(got[0].claims["P31"][0].mainsnak.datavalue.value) == {"id": "Q5"}


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(250)], "id long, title string")
    tables.write_sharded(df, f"{tmp_path}/sharded")
    assert rows(tables.read(spark, f"{tmp_path}/sharded").where("shard = 7").select("id")) == [(107,), (207,), (7,)]
    with pytest.raises(Exception, match="exist"):
        tables.write_new(df, f"{tmp_path}/sharded")
    assert rows(tables.lookup(df, [3])) == [(3, "t3")]
    with pytest.raises(KeyError):
        tables.lookup(df, [3, 999])
    new = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "id long, title string, t int")
    old = spark.createDataFrame([(1, "z", 9), (2, "y", 1)], "id long, title string, t int")
    assert rows(tables.upsert(old, new, "id", "t")) == [(1, "b", 2), (2, "y", 1)]
    (tmp_path / "f.yaml").write_text("- word: oak\n  count: 3\n- word: elm\n  count: 1\n")
    (tmp_path / "one.json").write_text('{"a": 1}')
    assert rows(tables.read_frequency_tables(spark, str(tmp_path / "f.yaml"), str(tmp_path / "f.yaml"))) == [("elm", 1), ("elm", 1), ("oak", 3), ("oak", 3)]
    tables.write_frequency_table(tables.read_frequency_tables(spark, str(tmp_path / "f.yaml")), f"{tmp_path}/f.json")
    assert rows(tables.read_frequency_tables(spark, f"{tmp_path}/f.json")) == [("elm", 1), ("oak", 3)]
    assert tables.read_dictionary(spark, None).columns == ["ordinal", "word"] and tables.read_one(str(tmp_path / "one.json")) == {"a": 1}
    with pytest.raises(ValueError):
        tables.read_one("x.pb")
    assert rows(tables.from_map(spark, {"a": 1})) == [("a", 1)] and rows(tables.from_rows(spark, [(1,)], "x int")) == [(1,)]
    assert json.loads(tables.printable(df).where("value like '%t9\"%'").first()[0]) == {"id": 9, "title": "t9"}


CONFIG = """
workflows:
  all: [ingest, title-index, links, ranks]
jobs:
  ingest: {subCommand: ingest, settings: {namespaces: [0], out: articles, outRedirects: redirects}}
  clean: {subCommand: clean, settings: {in: articles, out: clean}}
  title-index: {subCommand: title-index, settings: {in: articles, out: titles}}
  links: {subCommand: links, settings: {in: articles, index: titles, redirects: redirects, out: links, ignoredSections: [Notes], ignoreCategories: true}}
  ranks: {subCommand: pagerank, settings: {index: titles, links: links, out: ranks, steps: 3}}
  compare: {subCommand: pagerank-compare, settings: {pageRanks: ranks, genderIndex: genders}}
  genders: {subCommand: gender-frequency, settings: {genderIndex: genders}}
  both: {subCommand: gender-comparison, settings: {genderIndex: genders, links: links}}
  renamed: {subCommand: renamed-articles, settings: {index: titles}}
  view: {subCommand: view, settings: {in: articles, ids: [2]}}
  normalize: {subCommand: normalize, settings: {in: articles, out: normal}}
  ngrams: {subCommand: ngrams, settings: {in: articles, out: ngrams, minCount: 1}}
  first: {subCommand: first-links, settings: {in: articles}}
  matrix: {subCommand: reference-network, settings: {in: articles, genderIndex: genders}}
  weights: {subCommand: reference-network-2, settings: {in: articles, genderIndex: genders}}
  bad: {subCommand: nothing}
"""


@pytest.mark.parametrize("bound", [1_000_000, 8, 1])
def test_locate_shard(spark, monkeypatch, bound):
    """Shards looked through by each worker, and in pieces; against a search one by one."""
    monkeypatch.setattr(tables, "MAX_SHARDS", bound)
    rng = random.Random(bound)
    shards = [(f"s{i}", rng.choice([-(2**62) - 1, 2**53 + 1, *range(-300, 300)])) for i in range(90)] + [("open", None), ("s", 2**53), ("b", 7), ("a", 7)]
    keys = [None, None, 6, 7, 7, 2**53 - 1, 2**53, 2**53 + 1, 2**63 - 1, -(2**63), *(rng.randrange(-400, 400) for _ in range(300))]
    ends = sorted((m, p) for p, m in shards if m is not None)
    want = [(k, None if k is None else next((p for m, p in ends if m > k), None)) for k in keys]
    found = tables.locate_shard(spark.createDataFrame(shards, "path string, max long"), spark.createDataFrame([(k,) for k in keys], "k long"), "k")
    assert found.dtypes == [("k", "bigint"), ("path", "string")]
    assert rows(found) == sorted(want, key=repr)
    few = tables.locate_shard(spark.createDataFrame(shards, "path string, max long"), spark.range(5).select(F.col("id").cast("int")))
    assert few.dtypes == [("id", "int"), ("path", "string")] and few.count() == 5
    assert rows(tables.locate_shard(spark.createDataFrame([], "path string, max long"), spark.range(2))) == [(0, None), (1, None)]


def test_locate_shard_many(spark):
    """The plan does not grow with the shards, which a key is not compared with one by one."""
    keys, size = spark.range(0, 1_440_000, 3), {}
    for n in (10, 2000, 120_000):
        shards = spark.range(n).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("path"), (F.col("id") * 11).alias("max"))
        found = tables.locate_shard(shards, keys)
        size[n] = len(found._jdf.queryExecution().analyzed().toJSON())
        assert size[n] < 2 * size[10]
    want = F.when(F.col("id") < 11 * (n - 1), F.concat(F.lit("s"), (F.floor(F.col("id") / 11) + 1).cast("string")))
    assert found.where(~F.col("path").eqNullSafe(want)).count() == 0
    assert found.count() == 480_000


def test_jobs(spark, dump, tmp_path):
    (tmp_path / "config.yaml").write_text(CONFIG)
    config = jobs.Config.load(str(tmp_path / "config.yaml"))
    run = lambda name, *corpora, files=(): jobs.run(spark, config, name, str(tmp_path / "w"), *(corpora or ("c",)), files=list(files))
    ranks = run("all", files=[dump[0]])
    assert sum(r.pagerank for r in ranks.collect()) == pytest.approx(3)
    c = jobs.Corpus(spark, str(tmp_path / "w"), "c")
    assert rows(c.read("links")) == [(1, [2]), (2, [1, 3]), (3, [1])]
    c.write(spark.createDataFrame([(1, "Q6581072"), (3, "Q6581097")], "id long, gender string"), "genders")
    assert rows(run("genders")) == [("man", 1), ("woman", 1)]
    assert rows(run("both")) == [("Q6581072", 1, 2), ("Q6581097", 1, 1)]
    assert [r[0] for r in run("compare", "c", "c").collect()] and run("renamed", "c", "c").first().renamed == 0
    assert run("view").first().title == "Acorn" and run("clean").where("id = 2").first().text == "The oak has Old elm."
    assert run("normalize").where("id = 2").first().text.startswith("the [[oak]]") and run("ngrams").count() > 5
    assert rows(run("first").select("topic", "title")) == [(1, "Oak")]
    assert {r.from_class for r in run("matrix").collect()} >= {"male"} and sum(r.weight for r in run("weights").collect()) == pytest.approx(1)
    with pytest.raises(KeyError):
        run("none")
    with pytest.raises(KeyError):
        run("bad")


def test_streaming_ingest(spark, dump, tmp_path):
    folder, out, mark = tmp_path / "in", f"{tmp_path}/out", f"{tmp_path}/mark"
    folder.mkdir()
    (folder / "a.xml").write_text("<mediawiki>" + "".join(PAGES[:2]) + "</mediawiki>")
    ingest.ingest_new(spark, str(folder), out, mark).awaitTermination()
    (folder / "b.xml").write_text("<mediawiki>" + "".join(PAGES[2:]) + "</mediawiki>")
    ingest.ingest_new(spark, str(folder), out, mark).awaitTermination()
    assert rows(spark.read.parquet(out).select("id")) == [(1,), (2,), (3,)]
    assert spark.read.parquet(out).select(F.max(F.length("text"))).first()[0] > 10
