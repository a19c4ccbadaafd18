"""What changed between consecutive full snapshots.

Snapshots are kept: each row once per key, range-partitioned by key and sorted by key and snapshot, in one file per range.
A snapshot that comes later is kept in the same ranges, so that nothing that is there is moved again. Changes are found by a
merge join of each snapshot with the one before, range by range: two pointers move over two sorted streams, a key on one
side only was added or removed, and the columns of a key on both sides are compared. The join moves no row and stays in the
JVM; it holds one key at a time.

How a join knows that both sides lie in the same ranges: a range is written as one bucket of Spark, by a label whose hash
leads to that bucket alone (:func:`range_labels`), and label, key and snapshot are the keys of the join.

Defined results: several rows of one key in one snapshot count as the one loaded last (ties: the largest columns); this
is aggregated before the shuffle, so a hot key crosses it with one row per task and snapshot. Keys that are null or 0
are no records; null columns compare as values; rows without a snapshot name are ignored; the first snapshot adds
nothing and the last one removes nothing; empty tables and single snapshots give no rows; further columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tesselark.functions.titles import wiki_title
from tesselark.runtime import bounded_collect, scratch_path, shuffle_partitions, sibling

#: Snapshots are deliveries over time; their names are held by the driver. Beyond the bound they are given in several parts.
MAX_SNAPSHOTS = 10_000


def range_labels(spark: SparkSession, buckets: int) -> list[int]:
    """For each bucket the smallest number whose hash leads to it."""
    found: dict[int, int] = {}
    size = 32 * buckets
    while len(found) < buckets:
        rows = spark.range(size, numPartitions=1).select(F.col("id").cast("int").alias("v"))
        got = rows.groupBy(F.pmod(F.hash("v"), F.lit(buckets)).alias("b")).agg(F.min("v").alias("v")).collect()  # one row per bucket
        found, size = {r["b"]: r["v"] for r in got}, size * 4
    return [found[b] for b in range(buckets)]


class KeptSnapshots:
    """Snapshots at rest, range-partitioned and sorted by key; the ranges are set by the first rows that are kept."""

    def __init__(self, spark: SparkSession, snapshot: str, key: str, compared: list[str], loaded: str, ranges: int | None = None):
        # both sides of a merge lie in the same ranges: label, a part of the join's keys, is enough to know that
        self.spark = sibling(spark, spark__sql__requireAllClusterKeysForCoPartition="false", spark__sql__adaptive__enabled="false")
        self.snapshot, self.key, self.compared, self.loaded = snapshot, key, compared, loaded
        self.ranges = ranges or shuffle_partitions(spark)
        self.labels = range_labels(spark, self.ranges)
        self.parts: list[tuple[list[str], DataFrame]] = []

    def _latest(self, rows: DataFrame, names: list[str]) -> DataFrame:
        """``__key, __n, <columns>``: the row of each key and snapshot that counts; snapshots by number from 1."""
        number = F.array_position(F.array(*(F.lit(x) for x in names)) if names else F.array().cast("array<string>"), F.col(self.snapshot))
        row = F.struct(F.col(self.loaded).alias("__loaded"), *self.compared)
        last = rows.where(F.col(self.snapshot).isNotNull() & (F.col(self.key) != 0)).groupBy(F.col(self.snapshot), F.col(self.key)).agg(F.max(row).alias("__last"))
        return last.select(F.col(self.key).alias("__key"), number.cast("int").alias("__n"), *(F.col("__last")[c].alias(c) for c in self.compared))

    def _write(self, rows: DataFrame) -> DataFrame:
        name = f"snapshots_{uuid.uuid4().hex}"
        writer = rows.write.format("parquet").bucketBy(self.ranges, "__label").sortBy("__key", "__n")
        writer.option("path", scratch_path(self.spark, "snapshots")).saveAsTable(name)
        kept = self.spark.table(name)
        kept.schema  # noqa: B018 - the plan is made here; the catalog need not know the table any longer
        self.spark.sql(f"DROP TABLE {name}")
        return kept

    def _range_of(self, key: Column) -> Column:
        """The label of the range of a key, by the last key of each range that is kept."""
        ends = sorted((r[1], r[0]) for _, part in self.parts for r in part.groupBy("__label").agg(F.max("__key")).collect())  # one row per range
        edges, labels = np.array([e for e, _ in ends]), np.array([v for _, v in ends] or self.labels[:1], np.int32)

        @arrow_udf("int")
        def label(keys: pa.Array) -> pa.Array:
            at = np.searchsorted(edges, keys.to_numpy(zero_copy_only=False), "left") if len(edges) else np.zeros(len(keys), int)
            return pa.array(labels[np.minimum(at, len(labels) - 1)])

        return label(key)

    def add(self, rows: DataFrame) -> None:
        """Keep the snapshots of ``rows``, all later than those that are kept."""
        names = sorted(r[0] for r in bounded_collect(rows.select(self.snapshot).where(F.col(self.snapshot).isNotNull()).distinct(), MAX_SNAPSHOTS, "the list of snapshots"))
        if not names:
            return
        latest = self._latest(rows, names)
        if self.parts:
            ranged = latest.withColumn("__label", self._range_of(F.col("__key"))).repartition(self.ranges, "__label")
        else:
            number = F.element_at(F.array(*(F.lit(x) for x in self.labels)), F.spark_partition_id() + 1)
            ranged = latest.repartitionByRange(self.ranges, "__key").withColumn("__label", number.cast("int"))
        self.parts.append((names, self._write(ranged.sortWithinPartitions("__label", "__key", "__n"))))

    def _merge(self, old: DataFrame, new: DataFrame) -> DataFrame:
        """``__key, __n, __kind`` and each column before and after, where the two sides differ."""
        a = old.select("__label", "__key", "__n", F.lit(True).alias("__was"), *(F.col(c).alias(f"{c}_before") for c in self.compared))
        b = new.select("__label", "__key", "__n", F.lit(True).alias("__is"), *(F.col(c).alias(f"{c}_after") for c in self.compared))
        both = a.join(b.hint("merge"), ["__label", "__key", "__n"], "full")
        differs = F.lit(False)
        for c in self.compared:
            differs = differs | ~F.col(f"{c}_before").eqNullSafe(F.col(f"{c}_after"))
        kind = F.when(F.col("__was").isNull(), "added").when(F.col("__is").isNull(), "removed").when(differs, "changed")
        return both.withColumn("__kind", kind).where("__kind is not null")

    def changes(self) -> DataFrame:
        """``snapshot, key, change_kind, <column>_before, <column>_after, changed_columns`` of each change."""
        out: DataFrame | None = None
        for i, (names, part) in enumerate(self.parts):
            pairs = [(part.where(F.col("__n") < len(names)).withColumn("__n", F.col("__n") + 1), part.where("__n > 1"))] if len(names) > 1 else []
            if i:
                before, last = self.parts[i - 1][1], len(self.parts[i - 1][0])
                pairs.append((before.where(F.col("__n") == last).withColumn("__n", F.lit(1)), part.where("__n = 1")))
            name = F.element_at(F.array(*(F.lit(x) for x in names)), F.col("__n"))
            for old, new in pairs:
                found = self._merge(old, new)
                columns = [c for x in self.compared for c in (f"{x}_before", f"{x}_after")]
                changed = F.array_compact(F.array(*(F.when((F.col("__kind") == "changed") & ~F.col(f"{x}_before").eqNullSafe(F.col(f"{x}_after")), F.lit(x)) for x in self.compared)))
                rows = found.select(name.alias(self.snapshot), F.col("__key").alias(self.key), F.col("__kind").alias("change_kind"), *columns, changed.alias("changed_columns"))
                out = rows if out is None else out.unionByName(rows)
        return out


def changes(rows: DataFrame, snapshot: str, key: str, compared: list[str], loaded: str) -> DataFrame:
    """``snapshot, key, change_kind, <column>_before, <column>_after, changed_columns`` of each change."""
    kept = KeptSnapshots(rows.sparkSession, snapshot, key, compared, loaded)
    kept.add(rows)
    found = kept.changes()
    if found is None:  # no two snapshots
        types = {f.name: f.dataType.simpleString() for f in rows.schema}
        columns = ", ".join(f"`{x}_{side}` {types[x]}" for x in compared for side in ("before", "after"))
        found = rows.sparkSession.createDataFrame([], f"`{snapshot}` {types[snapshot]}, `{key}` {types[key]}, change_kind string, {columns}, changed_columns array<string>")
    return found


def page_changes(snapshots: DataFrame) -> DataFrame:
    """Changes of pages between dumps; titles compare under wiki conventions."""
    rows = snapshots.select("corpus", "id", wiki_title("title").alias("title"), "loaded_at")
    return changes(rows, "corpus", "id", ["title"], "loaded_at")
