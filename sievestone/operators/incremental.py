"""Freshness: what to do with each file, how disk and index differ, and the index's own rows after a change."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ancestors
from .filters import subtree


def decide(db_hash: Column, db_mtime: Column, db_size: Column, mtime: Column, size: Column, hash_: Column | None = None, backfill: bool = False) -> Column:
    """skip, touch or reindex; with no hash to compare, a differing file is read. Backfill reindexes what it would keep."""
    same = (db_mtime == mtime) & (db_size == size)
    keep, touch = ("reindex", "reindex") if backfill else ("skip", "touch")
    out = F.when(db_hash.isNull(), "reindex").when(same, keep)
    return (out.when(db_hash == hash_, touch) if hash_ is not None else out).otherwise("reindex")


def compare(scan: DataFrame, files: DataFrame, excluded: DataFrame | None = None, by_hash: bool = False) -> DataFrame:
    """path, status (unindexed, changed, missing, excluded, current) of disk against index; both have path, mtime, size (and hash).

    excluded (path, reason): a missing file at or below one of these is excluded rather than missing, with the reason of
    its nearest ancestor.
    """
    cols = ["mtime", "size", *(["hash"] if by_hash else [])]
    a = scan.select("path", *(F.col(c).alias(f"d_{c}") for c in cols), F.lit(True).alias("on_disk"))
    b = files.select("path", *(F.col(c).alias(f"i_{c}") for c in cols), F.lit(True).alias("indexed"))
    differs = reduce(lambda x, y: x | y, (F.col(f"d_{c}") != F.col(f"i_{c}") for c in ("mtime", "size")))
    if by_hash:
        differs = differs & (F.col("d_hash") != F.col("i_hash"))
    status = F.when(F.col("indexed").isNull(), "unindexed").when(F.col("on_disk").isNull(), "missing").when(differs, "changed").otherwise("current")
    rows = a.join(b, "path", "full_outer").select("path", status.alias("status"))
    if excluded is None:
        return rows.withColumn("reason", F.lit(None).cast("string"))
    gone = rows.filter(F.col("status") == "missing").select("path", F.explode(ancestors(F.col("path"))).alias("dir"))
    nearest = gone.join(excluded.select(F.col("path").alias("dir"), "reason"), "dir").groupBy("path").agg(F.max_by("reason", F.length("dir")).alias("reason"))
    rows = rows.join(nearest, "path", "left")
    return rows.withColumn("status", F.when(F.col("reason").isNotNull(), "excluded").otherwise(F.col("status")))


STATUS_ORDER = ("changed", "missing", "excluded", "unindexed")


def check_list(compared: DataFrame, limit: int = 0) -> DataFrame:
    """The stale files in order of status, then path; limit 0 is all."""
    place = reduce(lambda w, s: w.when(F.col("status") == s[1], s[0]), enumerate(STATUS_ORDER), F.when(F.lit(False), -1))
    rows = compared.filter(F.col("status") != "current").orderBy(place, "path")
    return rows.limit(limit) if limit else rows


def counts_by(rows: DataFrame, code: str) -> DataFrame:
    """One row with a map from code to count."""
    return rows.groupBy(code).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(code, "n")))).alias("by_code"))


def replace_rows(old: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """old without the keys that new has, and new."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def touch(files: DataFrame, touched: DataFrame) -> DataFrame:
    """files with mtime and size of the touched paths (path, mtime, size)."""
    t = touched.select("path", F.col("mtime").alias("t_mtime"), F.col("size").alias("t_size"))
    return files.join(t, "path", "left").withColumn("mtime", F.coalesce("t_mtime", "mtime")).withColumn("size", F.coalesce("t_size", "size")).select(*files.columns)


def prune(files: DataFrame, scan: DataFrame, under: Column) -> DataFrame:
    """Indexed files under a root that are no longer on disk."""
    return files.filter(under).join(scan.select("path"), "path", "left_anti")


def without(rows: DataFrame, paths: list[str]) -> DataFrame:
    """rows whose path is neither one of these nor below one."""
    return rows.filter(~reduce(lambda a, b: a | b, (subtree(F.col("path"), p) for p in paths), F.lit(False)))


def totals(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: files and chunks, counted apart."""
    return files.agg(F.count("*").alias("files")).crossJoin(F.broadcast(chunks.agg(F.count("*").alias("chunks"))))  # a row each
