"""Incremental ingest as a stream: new files of a folder of JSON or Parquet documents are chunked and merged by micro-batch.

A micro-batch writes one segment of its own rows and tombstones for the paths that it replaces; nothing else is rewritten
until the index compacts its segments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import chunks
from ..plans.index import ALL, TABLES, Index, segment, tombstones

SCHEMA = "path string, text string, version bigint"


def documents_stream(spark: SparkSession, folder: str, schema: str = SCHEMA, fmt: str = "parquet", files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_trigger).load(folder)


def merge(index: Index, batch: DataFrame) -> None:
    """Of each path the row with the largest version (ties and rows without one: the largest text) replaces what the index holds.

    Rows without a path are left out; applying a batch twice changes nothing that a reader sees.
    """
    version = F.col("version") if "version" in batch.columns else F.lit(None).cast("bigint")
    latest = F.max(F.struct(F.coalesce(version, F.lit(-(1 << 63))).alias("version"), F.coalesce("text", F.lit("")).alias("text")))
    rows = batch.filter("path is not null").groupBy("path").agg(latest.alias("x")).select("path", F.col("x.text").alias("text")).persist()
    new_chunks = chunks(rows).persist()
    try:
        files = rows.select("path", F.lit(0).cast("bigint").alias("mtime"), F.octet_length("text").cast("bigint").alias("size"), F.xxhash64("text").cast("string").alias("hash"))
        old = index.table("files") if index.exists() else index.spark.createDataFrame([], TABLES["files"])
        replaced = rows.select("path").join(old.select("path"), "path", "left_semi")
        with index.locked():
            index.commit(segment(files, new_chunks), tombstones(replaced, ALL), {})
    finally:
        rows.unpersist()
        new_chunks.unpersist()


def run(index: Index, stream: DataFrame, checkpoint: str):
    """Everything that is there now, then stop; the checkpoint remembers what was taken."""
    return stream.writeStream.foreachBatch(lambda df, _: merge(index, df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
