"""The persistent index: immutable segments of Parquet tables, tombstones, and a manifest that is swapped last.

A commit writes one segment, seg=N/, with the rows of the files that it indexed (files, chunks, postings, lengths and,
with an embedder, vectors), and tombstones, dead=N/: paths whose rows in earlier segments no longer hold, all of them or
only the row in files. Nothing that is there is rewritten, so a run or micro-batch costs what it changes. Readers see it
when manifest.json, renamed into place, names it. Past MOST_SEGMENTS segments a commit writes all live rows as one.

Postings are sorted by term and carry their chunk's length, so a query reads its terms' row groups and nothing else;
chunks are sorted by path. The corpus statistics are kept in the manifest and updated from the files that come and go.
"""

from __future__ import annotations

import json
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import idents, stems, tokens
from ..operators.chunking import OVERLAP, SIZE, chunks
from ..operators.incremental import decide, replace_rows
from ..operators.lexical import postings
from ..sources.embed import Embedder, embed
from ..sources.reading import read
from .store import Store

TABLES = {
    "files": "path string, mtime bigint, size bigint, hash string, chunks bigint, dl bigint",
    "chunks": "path string, seq int, text string, line_start int, line_end int",
    "postings": "term string, col string, path string, seq int, positions array<int>, dl bigint",
    "lengths": "path string, seq int, dl bigint",
    "vectors": "path string, seq int, embedding array<float>",
}
ORDER = {"postings": ("term", "col", "path", "seq"), "chunks": ("path", "seq"), "files": ("path",)}
ALL, FILE = "all", "file"  # what a tombstone ends: every row of the path, or its row in files
SCHEMA_VERSION, MOST_SEGMENTS = 2, 8
EMPTY = {"version": 0, "meta": {}, "roots": [], "segments": {}, "dead": [], "old": [], "stats": {"files": 0, "chunks": 0, "dl": 0}}


class IndexError_(RuntimeError):
    """An index problem with a code: no_index, no_vectors, locked, usage, internal."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


class Index:
    """One index folder on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base, self.store = spark, base, Store(spark, base)

    def exists(self) -> bool:
        return self.store.exists("manifest.json")

    def manifest(self) -> dict:
        if not self.exists():
            raise IndexError_("no_index", f"no index in {self.base}")
        m = json.loads(self.store.read("manifest.json"))
        if m.get("schema_version") != SCHEMA_VERSION:
            raise IndexError_("internal", f"index schema {m.get('schema_version')}, expected {SCHEMA_VERSION}")
        return m

    def _rows(self, m: dict, name: str) -> DataFrame:
        """All rows of a table with the number of their segment, dead ones too."""
        paths = [f"{self.store.base}/seg={int(n):06d}/{name}" for n, names in m["segments"].items() if name in names]
        if not paths:
            return self.spark.createDataFrame([], TABLES[name] + ", seg int")
        return self.spark.read.option("basePath", self.store.base).schema(TABLES[name] + ", seg int").parquet(*paths)

    def _live(self, m: dict, name: str) -> DataFrame:
        rows = self._rows(m, name)
        if not m["dead"]:
            return rows.drop("seg")
        paths = [f"{self.store.base}/dead={n:06d}" for n in m["dead"]]
        dead = self.spark.read.option("basePath", self.store.base).schema("path string, what string, dead int").parquet(*paths)
        ended = (dead if name == "files" else dead.filter(F.col("what") == ALL)).groupBy("path").agg(F.max("dead").alias("dead"))
        return rows.join(ended, "path", "left").filter(F.col("dead").isNull() | (F.col("seg") >= F.col("dead"))).drop("seg", "dead")

    def table(self, name: str) -> DataFrame:
        return self._live(self.manifest(), name)

    def has_vectors(self) -> bool:
        return self.exists() and any("vectors" in names for names in self.manifest()["segments"].values())

    def corpus(self) -> tuple[int, float]:
        """The number of chunks and their mean length."""
        s = self.manifest()["stats"]
        return s["chunks"], s["dl"] / s["chunks"] if s["chunks"] else 0.0

    def _write(self, version: int, tables: dict[str, DataFrame]) -> list[str]:
        for name, df in tables.items():
            if name in ORDER:
                df = df.repartitionByRange(ORDER[name][0]).sortWithinPartitions(*ORDER[name])
            df.select(*(c.split()[0] for c in TABLES[name].split(", "))).write.mode("overwrite").parquet(f"{self.store.base}/seg={version:06d}/{name}")
        return sorted(tables)

    def commit(self, tables: dict[str, DataFrame], gone: DataFrame | None, meta: dict) -> dict:
        """A segment of new rows, and tombstones gone (path, what) for the rows before; then the manifest."""
        m = self.manifest() if self.exists() else json.loads(json.dumps(EMPTY))
        version, stats = m["version"] + 1, m["stats"]
        if gone is not None:
            where = f"{self.store.base}/dead={version:06d}"
            gone.write.mode("overwrite").parquet(where)
            gone = self.spark.read.schema("path string, what string").parquet(where)
            ended = self._live(m, "files").join(gone.select("path").distinct(), "path", "left_semi")
            lost = ended.agg(F.count("*"), F.sum("chunks"), F.sum("dl")).first()
            stats = {k: v - int(x or 0) for (k, v), x in zip(stats.items(), lost, strict=True)}
            m["dead"] = [*m["dead"], version]
        names = self._write(version, tables)
        if "files" in names:
            new = self.spark.read.schema(TABLES["files"]).parquet(f"{self.store.base}/seg={version:06d}/files").agg(F.count("*"), F.sum("chunks"), F.sum("dl")).first()
            stats = {k: v + int(x or 0) for (k, v), x in zip(stats.items(), new, strict=True)}
        segments = m["segments"] | ({str(version): names} if names else {})
        new = m | {"schema_version": SCHEMA_VERSION, "version": version, "segments": segments, "stats": stats, "roots": meta.pop("roots", m["roots"]), "meta": m["meta"] | meta, "old": []}
        if len(segments) > MOST_SEGMENTS:
            new = self._compacted(new)
        self.swap(new)
        for name in m["old"]:  # what the version before the last needed
            self.store.remove(name)
        return new

    def _compacted(self, m: dict) -> dict:
        """The manifest of a further version whose one segment has all live rows."""
        version = m["version"] + 1
        names = sorted({n for names in m["segments"].values() for n in names})
        self._write(version, {n: self._live(m, n) for n in names})
        old = [*(f"seg={int(n):06d}" for n in m["segments"]), *(f"dead={n:06d}" for n in m["dead"])]
        return m | {"version": version, "segments": {str(version): names}, "dead": [], "old": old}

    def swap(self, manifest: dict) -> None:
        if not self.store.exists(".gitignore"):
            self.store.write(".gitignore", "*\n")
        self.store.write("manifest.json", json.dumps(manifest))

    def locked(self):
        """A context in which no other writer commits."""
        return self.store.locked(IndexError_("locked", f"another writer holds {self.base}"))

    def bytes(self) -> int:
        m = self.manifest()
        return sum(self.store.size(f"seg={int(n):06d}") for n in m["segments"]) + sum(self.store.size(f"dead={n:06d}") for n in m["dead"])


def analysed(chunk_rows: DataFrame) -> DataFrame:
    """path, seq and the stemmed arrays body, path_terms, ids of chunks."""
    path_words = F.concat(tokens(F.col("path")), idents(F.col("path")))
    return chunk_rows.select("path", "seq", stems(tokens(F.col("text"))).alias("body"), stems(path_words).alias("path_terms"), stems(idents(F.col("text"))).alias("ids"))


def lexical_tables(chunk_rows: DataFrame) -> dict[str, DataFrame]:
    """postings and lengths of chunks."""
    rows = analysed(chunk_rows)
    posts = postings(rows.withColumn("key", F.struct("path", "seq")), "key", {"body": "body", "path_terms": "path", "ids": "ids"})
    lengths = rows.select("path", "seq", (F.size("body") + F.size("path_terms") + F.size("ids")).cast("bigint").alias("dl"))
    return {"postings": posts.select("term", "col", "key.path", "key.seq", "positions", F.col("dl").cast("bigint").alias("dl")), "lengths": lengths}


def segment(files: DataFrame, chunk_rows: DataFrame) -> dict[str, DataFrame]:
    """The tables of a segment, from files (path, mtime, size, hash) and their chunks (kept by the caller)."""
    lexical = lexical_tables(chunk_rows)
    sums = lexical["lengths"].groupBy("path").agg(F.count("*").alias("chunks"), F.sum("dl").alias("dl"))
    counted = files.select("path", "mtime", "size", "hash").join(sums, "path", "left").na.fill(0, ["chunks", "dl"])
    return {"files": counted, "chunks": chunk_rows} | lexical


def tombstones(paths: DataFrame, what: str) -> DataFrame:
    return paths.select("path", F.lit(what).alias("what"))


def update(index: Index, listed: DataFrame, gone, max_size: int, embedder: Embedder | None = None, model: str = "", doc_prefix: str = "", size: int = SIZE, overlap: int = OVERLAP, structured: bool = True, meta: dict | None = None, prune: bool = True, concurrency: int | None = None, stop=lambda: False) -> dict:
    """One run: list, decide, read only what may have changed, chunk, analyse, write a segment. Gives the run's counts.

    listed: (path, size, mtime) on disk. gone: a predicate on index paths not to be kept unless listed (with prune).
    stop: asked before anything is written; if it says so, what was read is committed without prune and stamp.
    """
    spark, exists = index.spark, index.exists()
    old = {t: index.table(t) if exists else spark.createDataFrame([], TABLES[t]) for t in TABLES}
    backfill = bool(embedder and exists and not index.has_vectors())
    known = old["files"].select("path", F.col("mtime").alias("i_mtime"), F.col("size").alias("i_size"), F.col("hash").alias("i_hash"), F.col("chunks").alias("i_chunks"), F.col("dl").alias("i_dl"))
    seen = listed.join(known, "path", "left")
    first = seen.withColumn("todo", decide(F.col("i_hash"), F.col("i_mtime"), F.col("i_size"), F.col("mtime"), F.col("size"), backfill=backfill))
    texts = read(first.filter("todo = 'reindex'"), max_size).join(known, "path", "left")
    final = F.when(F.col("code").isNotNull(), F.lit("none")).otherwise(decide(F.col("i_hash"), F.col("i_mtime"), F.col("i_size"), F.col("mtime"), F.col("size"), F.col("hash"), backfill))
    texts = texts.withColumn("todo", final).persist()
    fresh = texts.filter("todo = 'reindex'")
    new_chunks = chunks(fresh, size, overlap, structured).persist()
    missing = old["files"].filter(gone).join(listed.select("path"), "path", "left_anti").select("path").persist()
    try:
        tables = segment(fresh, new_chunks)
        touched = texts.filter("todo = 'touch'").select("path", "mtime", "size", F.col("i_hash").alias("hash"), F.col("i_chunks").alias("chunks"), F.col("i_dl").alias("dl"))
        tables["files"] = tables["files"].unionByName(touched)
        refused = texts.filter("code is not null and code <> 'vanished' and i_hash is not null").select("path")
        own = {r["todo"]: r["n"] for r in texts.groupBy("todo").agg(F.count("*").alias("n")).collect()}
        codes = {r["code"]: r["n"] for r in texts.filter("code is not null").groupBy("code").agg(F.count("*").alias("n")).collect()}
        bad = [tuple(r) for r in texts.filter(F.col("code").isin("read_failed", "extract_failed")).select("path", "code", "message").orderBy("path").collect()]
        updated = fresh.filter("i_hash is not null").count()
        stopped = bool(stop())
        prune = prune and not stopped
        ended = tombstones(fresh.filter("i_hash is not null").unionByName(texts.join(refused, "path", "left_semi")), ALL).unionByName(tombstones(touched, FILE))
        ended = ended.unionByName(tombstones(missing, ALL)) if prune else ended
        if embedder:
            kept = old["chunks"].join(ended.filter(F.col("what") == ALL), "path", "left_anti").join(old["vectors"].select("path", "seq"), ["path", "seq"], "left_anti")
            tables["vectors"] = embed(new_chunks.unionByName(kept), embedder, doc_prefix, concurrency=concurrency)
        report = {
            "scanned": listed.count(), "indexed": own.get("reindex", 0) - updated, "updated": updated,
            "unchanged": first.filter("todo = 'skip'").count() + own.get("touch", 0), "deleted": missing.count() if prune else 0,
            "chunks": new_chunks.count(), "skipped_by_code": {k: v for k, v in codes.items() if not k.endswith("_failed")}, "failed": bad, "interrupted": stopped,
        }
        stamp = {"indexed_at": datetime.now(timezone.utc).isoformat(timespec="seconds")} if not stopped else {}
        stamp |= {"chunk_size": size, "overlap": overlap, "chunker": "auto" if structured else "text"}
        nothing = not own.get("reindex") and not own.get("touch") and not embedder
        with index.locked():
            index.commit({} if nothing else tables, None if ended.isEmpty() else ended, (meta or {}) | stamp | ({"model": model} if embedder else {}))
        return report
    finally:
        for df in (texts, new_chunks, missing):
            df.unpersist()


def delete(index: Index, under) -> int:
    """Tombstones for files by a predicate on path; the count of files that went."""
    found = index.table("files").filter(under).select("path").persist()
    try:
        n = found.count()
        if n:
            with index.locked():
                index.commit({}, tombstones(found, ALL), {})
        return n
    finally:
        found.unpersist()


__all__ = ["Index", "IndexError_", "delete", "replace_rows", "segment", "tombstones", "update"]
