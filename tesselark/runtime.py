"""Session helpers: the shared folder, cutting lineage, sizes of what is broadcast."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_KEY = "spark.checkpoint.dir"
_local_folders: dict[str, str] = {}
#: Scratch tables of this process, each with the session that made it.
_scratch: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where the cluster names none (as in local tests) a temporary folder is made, once per application.
    """
    named = spark.sparkContext.getConf().get(_KEY) or spark.conf.get(_KEY, None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError(f"{_KEY} must name a folder that all executors share")
        _local_folders[app] = tempfile.mkdtemp(prefix="tesselark-")
    return _local_folders[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the process ends (or by :func:`free`)."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _scratch[path] = spark
    return path


def free(*paths: str) -> None:
    """Remove scratch tables that nothing reads any more. What cannot be removed is left to whoever owns the folder."""
    for path in paths:
        spark = _scratch.pop(path, None)
        scheme, _, rest = path.rpartition("://") if "://" in path else ("", "", path.removeprefix("file:"))
        if scheme in ("", "file"):
            shutil.rmtree(rest, ignore_errors=True)
        elif spark is not None:
            try:
                where = spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
            except Exception:  # the session may be gone
                continue


@atexit.register
def _free_all() -> None:
    free(*list(_scratch))
    for folder in _local_folders.values():
        shutil.rmtree(folder, ignore_errors=True)


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Cut lineage: write to the shared folder and read back, so that a lost executor costs no recomputation.

    A written table is compressed, columnar and pruned on read, and it is computed once.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int, sort: tuple[str, ...] = (), label: str = "buckets", placed: bool = False) -> DataFrame:
    """Like :func:`cut`, with the rows in ``buckets`` by ``key``, one sorted file each: joins and aggregates on the key then
    move no row. Rows that are ``placed`` are in that many partitions by the key already. The catalog knows the table only
    until its plan is made; ``scratch`` of the result is its path, for :func:`free`."""
    spark, name = df.sparkSession, f"{label}_{uuid.uuid4().hex}"
    path = scratch_path(spark, label)
    rows = df if placed else df.repartition(buckets, key)
    rows.write.format("parquet").bucketBy(buckets, key).sortBy(*(sort or (key,))).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out.schema  # noqa: B018 - the plan is made here
    spark.sql(f"DROP TABLE {name}")  # an external table: its files stay
    out.scratch = path
    return out


def sibling(spark: SparkSession, **settings: str) -> SparkSession:
    """A session of the same application with its own settings: those of ``spark``, and ``settings`` (with ``__`` for dots)."""
    other = spark.newSession()
    for key, value in {**spark.conf.getAll, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        if spark.conf.isModifiable(key):
            other.conf.set(key, value)
    return other


class Latest:
    """The newest version of a table that a loop replaces: the version before is removed once the next is written."""

    def __init__(self, first: DataFrame, label: str = "latest"):
        self.spark, self.label, self.path = first.sparkSession, label, ""
        self.replace(first)

    def replace(self, rows: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, self.label)
        rows.write.parquet(path)
        if self.path:
            free(self.path)
        self.path = path
        self.df = self.spark.read.schema(rows.schema).parquet(path)
        return self.df


class Rounds:
    """A table that a loop adds to: each round's rows are written once, beside those of the rounds before."""

    def __init__(self, first: DataFrame, label: str = "rounds"):
        self.spark, self.schema, self.path, self.count = first.sparkSession, first.schema, scratch_path(first.sparkSession, label), 0
        self.last = self.add(first)

    def add(self, rows: DataFrame) -> DataFrame:
        path = f"{self.path}/part-{self.count}"
        rows.write.parquet(path)
        self.count += 1
        self.last = self.spark.read.schema(self.schema).parquet(path)
        return self.last

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/part-{k}" for k in range(self.count)))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def bounded_collect(df: DataFrame, bound: int, what: str) -> list:
    """Collect a dimension whose size is bounded; beyond the bound this raises instead of overloading the driver."""
    rows = df.limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"{what} has more than {bound} rows; it is meant to be a bounded dimension")
    return rows


#: Bytes of rows that may be broadcast: what Spark's own statistics of the optimised plan say, not a count of rows.
BROADCAST_BYTES = 64 << 20


def plan_bytes(df: DataFrame) -> int:
    """The size of ``df`` by the statistics of its optimised plan; without statistics this is huge. No job is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, bound: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` if its plan proves it to be small, else leave the join to Catalyst, which shuffles both sides."""
    return F.broadcast(df) if plan_bytes(df) <= bound else df
