import pytest

import __spark_entry__
from tesselark.llm import queries

from .. import oracle

pytestmark = pytest.mark.skipif(not oracle.available(), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    oracle.compare(spark, queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name, columns", [("p3_found", "id markup_kind"), ("p3_clean", "id text"), ("p4_found", "id classification"), ("p4_composition", "classification class_name pages share"), ("p8_ids", "doc_id ids"), ("p9_found", "doc_id item_id"), ("p10_found", "doc_id kind"), ("p10_redacted", "doc_id text")])
def test_columns(spark, name, columns):
    got = __spark_entry__.queries()[name](spark, oracle.FOLDER)
    assert got.columns == columns.split() and got.collect() is not None
