import pytest

import __spark_entry__
from tesselark.plans import registry

from . import oracle

pytestmark = pytest.mark.skipif(not oracle.available(), reason="no test tables here")


#: Rules have tests of their own; of their queries one of each sort is compared here.
COMPARED = [n for n in sorted(registry.SQL) if not n.startswith(("wikitext_", "tags_")) or n in ("wikitext_links", "tags_years", "wikitext_link_rules")]


@pytest.mark.parametrize("name", COMPARED)
def test_query_equals_its_sql(spark, name):
    oracle.compare(spark, registry.QUERIES[name], registry.SQL[name])


@pytest.mark.parametrize("name", ["clean_text", "wikitext_sections", "ngram_tokens", "gender_infer_nested", "topic_titles", "page_sample"])
def test_other_queries_run(spark, name):
    assert registry.QUERIES[name](spark, oracle.FOLDER).collect() is not None


def test_entry(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.queries()["word_count"](spark, oracle.FOLDER).columns == ["word", "count"]


def test_wide_tables_are_joined_without_moving_rows(spark):
    plan = registry.QUERIES["p1_found"](spark, oracle.FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Exchange" not in plan and "ReusedExchange" not in plan
