"""Tables at rest: Parquet, sharded folders, single objects, frequency tables, dictionaries, rows in memory."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from tesselark.operators.pages import SHARDS, with_shard
from tesselark.runtime import bounded_collect, cut
from tesselark.schemas import DICTIONARY, WORD_COUNT

#: Ends of shards that a worker looks through (more are searched in pieces); rows of a frequency table in YAML (larger ones are JSON lines).
MAX_SHARDS, MAX_YAML = 1_000_000, 1_000_000


def read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A table or a folder of them; with the schema given, nothing is looked at before the scan."""
    reader = spark.read
    return (reader.schema(schema) if schema else reader).parquet(path)


def write(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def write_new(rows: DataFrame, path: str) -> None:
    """Write once: a folder that exists is an error."""
    rows.write.mode("errorifexists").parquet(path)


def write_sharded(rows: DataFrame, path: str, key: str = "id", shards: int = SHARDS) -> None:
    """One folder per shard, by the key modulo ``shards``; rows are clustered so that a shard is one file per task range."""
    with_shard(rows, key, shards).repartition("shard", F.pmod(F.xxhash64(key), F.lit(8))).write.mode("errorifexists").partitionBy("shard").parquet(path)


def upsert(old: DataFrame | None, new: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """The last row of each key: of ``new`` (by ``order`` within it) before ``old``."""
    columns = new.columns
    rows = new.withColumn("__new", F.lit(1))
    if old is not None:
        rows = rows.unionByName(old.withColumn("__new", F.lit(0)))
    rank = [F.col("__new"), *([F.col(order)] if order else [])]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*rank)).alias("row"))
    return last.select("row.*")


def read_one(path: str) -> dict:
    """A single object, from JSON, YAML or a Parquet file of one row."""
    if path.endswith(".json"):
        return json.loads(Path(path).read_text())
    if path.endswith((".yaml", ".yml")):
        import yaml

        return yaml.safe_load(Path(path).read_text())
    if path.endswith(".parquet"):
        rows = SparkSession.active().read.parquet(path).limit(2).collect()
        if len(rows) != 1:
            raise ValueError(f"{path} does not hold a single object")
        return rows[0].asDict(recursive=True)
    raise ValueError(f"{path}: objects are read from .json, .yaml and .parquet")


def locate_shard(shards: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """``key, path``: the shard that holds each key, which is the first whose ``max`` is above the key; none if there is no such shard, or no key.
    Of shards (``path, max``) that end alike the first by path counts; one without an end holds nothing. Keys and ends are whole numbers.

    The ends are searched by halving in each worker, and no key moves. If there are more than MAX_SHARDS, that is done with a share of them: these
    cut keys and ends into pieces, and each piece is sorted downwards, so that a key has the end last seen before it."""
    ends = shards.select("max", "path").where("max is not null")
    listed = ends.limit(MAX_SHARDS + 1).toArrow()
    if listed.num_rows <= MAX_SHARDS:
        return _first_end(keys.select(key), key, listed, "path", ends.schema["path"].dataType)
    ends = cut(ends.groupBy("max").agg(F.min("path").alias("path")), "ends")
    count, last = ends.agg(F.count("*"), F.max("max")).first()
    chosen = (F.pmod(F.xxhash64("max"), F.lit(-(-4 * count // MAX_SHARDS))) == 0) | (F.col("max") == last)  # the last, so that keys without a piece have no shard
    cuts = ends.where(chosen).select("max", F.col("max").alias("path")).toArrow()
    kind = ends.schema["max"].dataType
    asked = _first_end(keys.select(F.col(key).alias("at")), "at", cuts, "piece", kind).withColumn("end", F.lit(None).cast(StructType([ends.schema["path"]])))
    given = _first_end(ends.select(F.col("max").alias("at"), F.struct("path").alias("end")), "at", cuts, "piece", kind, "left").select("at", "piece", "end")
    spread = F.when(F.col("piece").isNull(), F.xxhash64("at"))
    down = Window.partitionBy("piece", spread).orderBy(F.desc("at"), F.col("end").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = asked.unionByName(given).withColumn("seen", F.last("end", ignorenulls=True).over(down))
    return found.where("end is null").select(F.col("at").cast(keys.schema[key].dataType).alias(key), "seen.path")


def _first_end(rows: DataFrame, value: str, ends: pa.Table, name: str, kind: DataType, side: str = "right") -> DataFrame:
    """``rows`` with ``name``: the ``path`` of the first of the ends above ``value`` (with ``side`` left: at it or above)."""
    order = ends.sort_by([("max", "ascending"), ("path", "ascending")])
    shared, column = rows.sparkSession.sparkContext.broadcast((order["max"].cast("int64").to_numpy(), order["path"].combine_chunks())), rows.columns.index(value)

    def run(batches):
        tops, paths = shared.value
        for b in batches:
            values = b.column(column)
            first = np.searchsorted(tops, values.cast("int64").fill_null(0).to_numpy(zero_copy_only=False), side)
            none = (first == len(tops)) | values.is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*b.columns, paths.take(pa.array(first, mask=none))], names=[*b.schema.names, name])

    return rows.mapInArrow(run, StructType([*rows.schema, StructField(name, kind)]))


def counted(rows: DataFrame, readable: Column) -> tuple[DataFrame, Observation]:
    """Rows of which those that are not readable are skipped and counted: the rows left, and the counters ``rows`` and ``failed``, which are
    known once the rows have been written or counted. Counting costs no pass of its own."""
    seen = Observation()
    ok = F.coalesce(readable, F.lit(False))
    return rows.observe(seen, F.count("*").alias("rows"), F.count_if(~ok).alias("failed")).where(ok), seen


def lookup(rows: DataFrame, keys: list, key: str = "id") -> DataFrame:
    """Rows by key; a key without a row is an error. Keys prune row groups by their statistics."""
    found = rows.where(F.col(key).isin(list(keys)))
    have = {r[0] for r in found.select(key).distinct().collect()}  # as many as asked for
    if missing := [k for k in keys if k not in have]:
        raise KeyError(f"no row has the {key} {missing[0]!r}")
    return found


def from_map(spark: SparkSession, values: Mapping, key: str = "key", value: str = "value", schema: str | None = None) -> DataFrame:
    return spark.createDataFrame(list(values.items()), schema or [key, value])


def from_rows(spark: SparkSession, values: Iterable, schema: str) -> DataFrame:
    return spark.createDataFrame(list(values), schema)


def read_frequency_tables(spark: SparkSession, *paths: str) -> DataFrame:
    """Frequency tables one after another: YAML lists of ``word`` and ``count``, JSON lines or Parquet by their names."""
    parts = []
    for path in paths:
        if path.endswith((".yaml", ".yml")):
            import yaml

            parts.append(spark.createDataFrame([(x["word"], int(x["count"])) for x in yaml.safe_load(Path(path).read_text()) or []], WORD_COUNT))
        else:
            parts.append(spark.read.schema(WORD_COUNT).json(path) if path.endswith(".json") else read(spark, path, WORD_COUNT))
    out = parts[0] if parts else spark.createDataFrame([], WORD_COUNT)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_frequency_table(table: DataFrame, path: str) -> None:
    """``word`` and ``count``, the most frequent first: one YAML list, for tables meant to be read by people, or JSON lines."""
    if path.endswith((".yaml", ".yml")):
        import yaml

        rows = bounded_collect(table.select("word", F.col("count").cast("long")).orderBy(F.desc("count"), "word"), MAX_YAML, "a frequency table in YAML")
        Path(path).write_text(yaml.safe_dump([{"word": w, "count": n} for w, n in rows], allow_unicode=True, sort_keys=False))
        return
    table.select("word", "count").orderBy(F.desc("count"), "word").write.mode("overwrite").json(path)


def read_dictionary(spark: SparkSession, path: str | None) -> DataFrame:
    """``ordinal, word``; without a path the dictionary is empty."""
    return read(spark, path, DICTIONARY) if path else spark.createDataFrame([], DICTIONARY)


def printable(rows: DataFrame) -> DataFrame:
    """Each row as one JSON text."""
    return rows.select(F.to_json(F.struct("*")).alias("value"))
