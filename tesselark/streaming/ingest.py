"""New shards of a dump as they arrive, once each.

This goes beyond batch ingest: the folder of dump shards is read as a stream of files with ``availableNow``, so that each
run takes what is new and ends. Rows are the same as those of batch ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tesselark.schemas import DUMP_PAGE
from tesselark.sources.dumps import articles


def stream_dump(spark: SparkSession, folder: str, files_per_batch: int = 8) -> DataFrame:
    """Pages of the dump shards in a folder, as a stream of :data:`DUMP_PAGE`."""
    lines = spark.readStream.option("lineSep", "</page>").option("maxFilesPerTrigger", files_per_batch).text(folder)
    pages = lines.where(F.instr("value", "<page>") > 0).select(F.concat(F.expr("substring(value, instr(value, '<page>'))"), F.lit("</page>")).alias("value"))
    rows = pages.select(F.from_xml("value", DUMP_PAGE, {"ignoreSurroundingSpaces": "false", "rowTag": "page"}).alias("p")).select("p.*")
    return rows.withColumn("title", F.trim("title"))


def ingest_new(spark: SparkSession, folder: str, out: str, checkpoint: str, namespaces: list[int] = (0,)) -> StreamingQuery:
    """Append the articles of shards not seen before to ``out``; ends when none is left."""
    rows = articles(stream_dump(spark, folder), namespaces)
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
