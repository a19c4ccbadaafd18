"""Titles under wiki conventions."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType


@arrow_udf(StringType())
def _nfc(titles: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in titles.to_pylist()], pa.string())


def wiki_title(title: Column | str) -> Column:
    """One spelling per title: no section anchor, single spaces for underscores and spaces, trimmed, first letter
    capital, NFC. Null, blank and anchor-only titles give null. Only NFC leaves the JVM, and only for titles that are
    not plain ASCII.
    """
    c = F.col(title) if isinstance(title, str) else title
    c = F.when(c.rlike(r"[^\x00-\x7F]"), _nfc(c)).otherwise(c)
    c = F.substring_index(c, "#", 1)
    c = F.regexp_replace(c, r"[\x{200E}\x{200F}\x{202A}-\x{202E}]", "")  # marks of writing direction
    c = F.trim(F.regexp_replace(c, r"[\s_\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+", " "))
    c = F.concat(F.upper(F.substring(c, 1, 1)), c.substr(F.lit(2), F.length(c)))
    return F.when(c != "", c)
