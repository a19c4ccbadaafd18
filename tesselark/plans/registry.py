"""All queries of the core library and their SQL."""

from __future__ import annotations

from tesselark.plans import analyses, reshaping, sourced

QUERIES = {**reshaping.QUERIES, **analyses.QUERIES, **sourced.QUERIES}
SQL = {**reshaping.SQL, **analyses.SQL, **sourced.SQL}
