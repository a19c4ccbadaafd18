"""Attribute-value rows to wide tables.

Rows are cut by attribute into typed narrow tables, at most one row per entity and attribute: the winning value in a column
of its own type, and the statement it comes from. They are written once, side by side in one set of files: bucketed by
entity, and sorted by attribute within each bucket, so that a narrow table is a range of pages of each file that the scan
finds by their statistics. They are combined by balanced multiway outer joins: attributes in groups of about the square
root of their number, each group written in the same buckets, then the groups. No join moves a row, and a task holds
the hash tables of one group only. Outer joins run against the spine of entities that occur in the group: this equals a
full outer join of the narrow tables, but keeps the hash partitioning, which Spark loses across a full outer join.

Defined results: rows without entity (null or 0), attributes that are not listed, deprecated statements and values that
cannot be read give no cell; a null or blank rank is normal; a statement delivered again counts as its latest delivery
(ties: the largest remaining columns); equal candidates for a cell are settled by the larger statement id; rows without
a statement id are never deliveries of each other and lose ties; an empty table gives an empty wide table with all
columns; further columns of the input are ignored. Hot entities are pre-aggregated before each shuffle: an entity
crosses the last shuffle with at most one row per attribute.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselark.runtime import bounded_collect, bucketed, shuffle_partitions

#: The typed column that holds the values of each datatype; a datatype that is not listed is kept as text.
COLUMN_OF = {"item": "text", "date": "day", "quantity": "number", "text": "text"}
#: Groups that are joined at the same time.
AT_ONCE = 4
#: English month names.
MONTHS = "January February March April May June July August September October November December".split()
#: An attribute is a column of the result, so their number must be bounded. Beyond it a wide table has no meaning for Spark.
MAX_ATTRIBUTES = 2000


@dataclass(frozen=True)
class Attribute:
    name: str
    datatype: str

    @property
    def claim_column(self) -> str:
        return f"{self.name}__claim_id"


def attribute_code(code: Column) -> Column:
    """One spelling per attribute code: no namespace prefix such as ``wdt:``, no spaces, upper case."""
    return F.upper(F.regexp_replace(code, r"^\s*(?:[A-Za-z]+\s*:)?\s*|\s+$", ""))


def rank_code(rank: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(rank, F.lit("")), r"^\s+|\s+$", ""))


def _json_field(value: Column, field: str) -> Column:
    """The field of a JSON object, or the value itself if it is none."""
    return F.when(value.startswith("{"), F.get_json_object(value, f"$.{field}")).otherwise(value)


def read_item(value: Column) -> Column:
    code = F.regexp_extract(_json_field(value, "id"), r"^\s*(?:[A-Za-z]+:|https?://\S+/)?[Qq]([1-9][0-9]*)\s*$", 1)
    return F.when(code != "", F.concat(F.lit("Q"), code))


def read_date(value: Column) -> Column:
    text = F.trim(_json_field(value, "time"))
    iso = F.regexp_extract(text, r"^\+?(\d{4}-\d{2}-\d{2})(?:T00:00:00Z?)?$", 1)
    day_first = r"^(\d{1,2})\.? ([A-Za-z]+),? (\d{4})$"
    month_first = r"^([A-Za-z]+) (\d{1,2}),? (\d{4})$"
    d1, m1, y1 = (F.regexp_extract(text, day_first, i) for i in (1, 2, 3))
    m2, d2, y2 = (F.regexp_extract(text, month_first, i) for i in (1, 2, 3))
    day, month, year = (F.when(y1 != "", a).otherwise(b) for a, b in ((d1, d2), (m1, m2), (y1, y2)))
    numbers = F.create_map(*(F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m.lower(), f"{i:02d}")))
    named = F.concat_ws("-", year, F.try_element_at(numbers, F.lower(month)), F.lpad(day, 2, "0"))
    # a precision below 11 means that the day is not known
    precise = F.coalesce(F.get_json_object(F.when(value.startswith("{"), value), "$.precision").try_cast("int"), F.lit(11))
    return F.when(precise >= 11, F.when(iso != "", iso).when(F.length(named) == 10, named).try_cast("date"))


def read_quantity(value: Column) -> Column:
    text = F.trim(_json_field(value, "amount"))
    plain = text.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d{1,3})?$")
    grouped = text.rlike(r"^[+-]?\d{1,3}(,\d{3})+(\.\d+)?$")
    return F.when(plain | grouped, F.replace(text, F.lit(","), F.lit("")).try_cast("double"))


def read_text(value: Column) -> Column:
    text = F.regexp_replace(F.coalesce(F.when(value.startswith("{"), F.get_json_object(value, "$.text")), value), r"^\s+|\s+$", "")
    return F.when(text != "", text)


READERS = {"item": read_item, "date": read_date, "quantity": read_quantity, "text": read_text}


def listed_attributes(properties: DataFrame) -> list[Attribute]:
    """The attributes in order, each once: codes that are the same in one spelling are one attribute, with the first
    spelling and datatype in order; a missing datatype is text and comes last."""
    rows = bounded_collect(properties.select("property", "datatype").where("property is not null").distinct(), MAX_ATTRIBUTES, "the list of attributes")
    out: dict[str, Attribute] = {}
    for name, datatype in sorted(rows, key=lambda r: (r[0], r[1] is None, r[1] or "")):
        out.setdefault(name.strip().upper(), Attribute(name, (datatype or "text").strip().lower()))
    return list(out.values())


def cells(claims: DataFrame, attributes: list[Attribute]) -> DataFrame:
    """``id, slot, claim_id, text, day, number``: the winning statement of each cell, its value in the column of its type."""
    codes = claims.sparkSession.createDataFrame([(a.name, i) for i, a in enumerate(attributes)] or [("", -1)], "name string, slot int")
    codes = codes.select(attribute_code(F.col("name")).alias("code"), "slot")
    rank = rank_code(F.col("claim_rank"))
    rows = claims.select(
        "claim_id", "id", attribute_code(F.col("property")).alias("code"), F.trim("claim_value").alias("value"),
        F.when(rank == "deprecated", -1).when(rank == "preferred", 1).otherwise(0).alias("rank"),
        F.coalesce(F.unix_micros(F.col("recorded_at").cast("timestamp")), F.lit(-(1 << 62))).alias("at"),
    )
    rows = rows.join(F.broadcast(codes), "code", "left")  # one row per attribute: bounded by MAX_ATTRIBUTES
    row = F.struct("at", "id", "slot", "rank", "value")
    latest = rows.where("claim_id is not null").groupBy("claim_id").agg(F.max(row).alias("row"))
    nameless = rows.where("claim_id is null").select("claim_id", row.alias("row"))
    kept = latest.unionByName(nameless).select("claim_id", "row.*").where("id <> 0 and rank >= 0 and slot is not null")
    by_type: dict[str, list[int]] = {}
    for i, a in enumerate(attributes):
        by_type.setdefault(a.datatype if a.datatype in READERS else "text", []).append(i)
    typed = {"text": F.lit(None).cast("string"), "day": F.lit(None).cast("date"), "number": F.lit(None).cast("double")}
    for datatype, slots in by_type.items():
        column = COLUMN_OF[datatype]
        typed[column] = F.when(F.col("slot").isin(slots), READERS[datatype](F.col("value"))).otherwise(typed[column])
    kept = kept.select("id", "slot", "rank", "at", "claim_id", *(c.alias(name) for name, c in typed.items())).where("text is not null or day is not null or number is not null")
    best = kept.groupBy("id", "slot").agg(F.max(F.struct("rank", "at", "claim_id", "text", "day", "number")).alias("best"))
    return best.select("id", "slot", *(F.col("best")[x].alias(x) for x in ("claim_id", "text", "day", "number")))


class NarrowTables:
    """The typed narrow tables of a claims table, written once to the shared folder and bucketed by entity."""

    def __init__(self, claims: DataFrame, properties: DataFrame, buckets: int | None = None):
        self.attributes = listed_attributes(properties)
        self.buckets = buckets or shuffle_partitions(claims.sparkSession)
        self.rows = bucketed(cells(claims, self.attributes), "id", self.buckets, ("slot", "id"), "narrow")

    def narrow(self, slot: int) -> DataFrame:
        """One attribute: ``id``, its typed value under its name, and the statement that fills it."""
        a = self.attributes[slot]
        value = F.col(COLUMN_OF.get(a.datatype, "text"))
        return self.rows.where(F.col("slot") == slot).select("id", value.alias(a.name), F.col("claim_id").alias(a.claim_column))

    def _group(self, slots: range) -> DataFrame:
        """The attributes of a group side by side, one row per entity that has any of them."""
        out = self.rows.where(F.col("slot").between(slots.start, slots.stop - 1)).select("id").distinct()
        for slot in slots:
            out = out.join(self.narrow(slot).hint("shuffle_hash"), "id", "left")
        return out

    def wide(self) -> DataFrame:
        """One row per entity that has a cell: ``id``, then for each attribute its value and the filling statement."""
        n = len(self.attributes)
        fan = max(1, math.ceil(math.sqrt(n)))
        groups = [range(start, min(n, start + fan)) for start in range(0, n, fan)]
        out = self.rows.select("id").distinct()
        if len(groups) == 1:
            return self._group(groups[0])
        with ThreadPoolExecutor(AT_ONCE) as pool:
            written = list(pool.map(lambda slots: bucketed(self._group(slots), "id", self.buckets, label="group"), groups))
        for group in written:
            out = out.join(group.hint("shuffle_hash"), "id", "left")
        return out


def wide_table(claims: DataFrame, properties: DataFrame) -> DataFrame:
    return NarrowTables(claims, properties).wide()


def filled_cells(claims: DataFrame, properties: DataFrame) -> DataFrame:
    """``id, property, claim_id``: the filled cells of the wide table, those whose typed value is there."""
    tables = NarrowTables(claims, properties)
    if not tables.attributes:
        return claims.sparkSession.createDataFrame([], "id long, property string, claim_id long")
    pairs = F.array(*(F.when(F.col(a.name).isNotNull(), F.struct(F.lit(a.name).alias("property"), F.col(a.claim_column).alias("claim_id"))) for a in tables.attributes))
    return tables.wide().select("id", F.inline(F.array_compact(pairs)))
