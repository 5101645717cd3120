"""The engine's surface: index, search, show, status, check and rm over one index folder."""

from __future__ import annotations

import inspect
import json
import os
import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import filters, fusion, incremental, knn, lexical, postprocess
from .operators.chunking import OVERLAP, SIZE
from .operators.parsing import parse_query, to_match
from .plans.index import Index, IndexError_, delete, update
from .session import ship
from .sources.embed import Embedder, unit
from .sources.listing import FAILED, INDEX_DIR, Rules, scan

ANSWER_SCHEMA = 2
KINDS = {"lexical": "bm25", "semantic": "cosine", "hybrid": "rrf"}


def find(start: str, explicit: str | None = None) -> str | None:
    """The index folder: an explicit one, SIEVESTONE_DB, or the nearest above start."""
    if explicit or os.environ.get("SIEVESTONE_DB"):
        return explicit or os.environ["SIEVESTONE_DB"]
    here = os.path.abspath(start)
    while True:
        if os.path.exists(os.path.join(here, INDEX_DIR, "manifest.json")):
            return os.path.join(here, INDEX_DIR)
        if here == os.path.dirname(here):
            return None
        here = os.path.dirname(here)


def _unlisted(listed: DataFrame) -> list[tuple]:
    return [tuple(r) for r in listed.filter(F.col("reason") == FAILED).select("path", "reason", "message").orderBy("path").collect()]


class Engine:
    """All operations on one index folder."""

    def __init__(self, spark: SparkSession, base: str, embedder: Embedder | None = None, model: str = "", query_prefix: str = "", doc_prefix: str = ""):
        self.spark, self.ix = ship(spark), Index(spark, base)
        self.embedder, self.model, self.query_prefix, self.doc_prefix = embedder, model, query_prefix, doc_prefix

    # index -----------------------------------------------------------------------------------------------------
    def index(self, root: str, rules: Rules | None = None, size: int | None = None, overlap: int | None = None, structured: bool | None = None, with_vectors: bool = False, strict: bool = False, prune: bool = True, concurrency: int | None = None, stop=lambda: False) -> dict:
        """Index a tree, incrementally; the report has the counts of the run.

        prune: drop what is no longer on disk. concurrency: most embedding requests at a time. stop: see update().
        """
        began, root, rules = time.time(), os.path.realpath(root), rules or Rules()
        meta = self.ix.manifest()["meta"] if self.ix.exists() else {}
        given = {"chunk_size": size, "overlap": overlap, "chunker": None if structured is None else "auto" if structured else "text"}
        stored = {k: meta.get(k) for k in given}
        differing = [k for k, v in given.items() if v is not None and stored[k] is not None and v != stored[k]]
        if differing:
            raise IndexError_("usage", f"the index was built with other {', '.join(differing)}")
        if with_vectors and meta.get("model") not in (None, self.model):
            raise IndexError_("usage", f"the index was built with model {meta['model']}")
        listed = scan(self.spark, root, rules).persist()
        try:
            roots = self.ix.manifest()["roots"] if self.ix.exists() else []
            if not any(root == r or root.startswith(r + "/") for r in roots):
                roots = [r for r in roots if not r.startswith(root + "/")] + [root]
            size = size or stored["chunk_size"] or SIZE
            overlap = overlap if overlap is not None else stored["overlap"] if stored["overlap"] is not None else OVERLAP
            auto = structured if structured is not None else stored["chunker"] != "text"
            report = update(
                self.ix, listed.filter("reason is null and not is_dir").select("path", "size", "mtime"), filters.subtree(F.col("path"), root), rules.max_size,
                self.embedder if with_vectors else None, self.model, self.doc_prefix, size, overlap, auto, {"roots": roots, "selection": vars(rules), "query_prefix": self.query_prefix, "doc_prefix": self.doc_prefix}, prune, concurrency, stop,
            )
            failed = _unlisted(listed)
            reasons = listed.filter(F.col("reason").isNotNull() & (F.col("reason") != FAILED)).groupBy("reason").agg(F.count("*").alias("n")).collect()
        finally:
            listed.unpersist()
        report["excluded_by_reason"] = {r["reason"]: r["n"] for r in reasons}
        report["failed"] = sorted(report["failed"] + failed)
        report["duration_ms"] = int(1000 * (time.time() - began))
        report["exit_code"] = 1 if strict and report["failed"] else 0
        return report

    def rm(self, *paths: str) -> int:
        """Delete files and subtrees; roots at or below them go too."""
        under = reduce(lambda a, b: a | b, (filters.subtree(F.col("path"), os.path.abspath(p)) for p in paths))
        n = delete(self.ix, under)
        m = self.ix.manifest()
        kept = [r for r in m["roots"] if not any(r == p or r.startswith(p + "/") for p in map(os.path.abspath, paths))]
        if kept != m["roots"]:
            with self.ix.locked():
                self.ix.swap(self.ix.manifest() | {"roots": kept})
        return n

    # search ----------------------------------------------------------------------------------------------------
    def _hits(self, scored: DataFrame, pool: int) -> DataFrame:
        """The pool's rows with their chunks. The pool, cut to its bound, comes to the driver, so that only row groups that may hold its paths are read."""
        best = lexical.top(scored, pool, "path", "seq").collect()
        rows = self.spark.createDataFrame(best, "path string, seq int, score double")
        wanted = self.ix.table("chunks").filter(F.col("path").isin(sorted({r["path"] for r in best})))
        return wanted.join(F.broadcast(rows), ["path", "seq"]).select("path", "seq", "text", "line_start", "line_end", "score")

    def lexical(self, query: str, pool: int) -> DataFrame:
        posts = self.ix.table("postings").withColumn("key", F.struct("path", "seq"))
        got = lexical.search(posts, self.ix.corpus(), parse_query(query), "key", lexical.WEIGHTS)
        return self._hits(got.select("key.path", "key.seq", "score"), pool)

    def semantic(self, query: str, pool: int, where=None) -> DataFrame:
        if not self.ix.has_vectors():
            raise IndexError_("no_vectors", "the index has no vectors")
        if self.embedder is None:
            raise IndexError_("embed_failed", "no embedder")
        import unicodedata

        vector = unit(self.embedder([unicodedata.normalize("NFC", self.query_prefix + query)])[0])
        near = knn.knn(self.ix.table("vectors"), vector, pool, where=where, order=("path", "seq"))
        return self._hits(near.select("path", "seq", (1 - F.col("distance")).alias("score")), pool)

    def search(self, query: str, k: int = 10, mode: str = "lexical", root: str | None = None, exts=(), exclude=(), include=(), dedupe: bool = False, max_per_file: int = 0, snippet: int = 500) -> DataFrame:
        """rank, path, seq, lines, score, text and labels of the k best chunks."""
        if k <= 0 or mode not in KINDS or snippet < 0:
            raise IndexError_("usage", "k must be over 0, mode lexical, semantic or hybrid, snippet not negative")
        roots = self.ix.manifest()["roots"]
        filtered = bool(root or exts or exclude or include)
        pool = fusion.pool_size(k, filtered or dedupe or max_per_file > 0, mode == "hybrid")
        keep = filters.result_filter(F.col("path"), root, exts, exclude, include, roots) if filtered else F.lit(True)
        order = [F.desc("score"), "path", "seq"]
        if mode == "hybrid":
            lists = [fusion.ranked(x.filter(keep), order) for x in (self.lexical(query, pool), self.semantic(query, pool))]
            hits = fusion.rrf([x.drop("score") for x in lists], ["path", "seq"], pool)
        else:
            hits = (self.lexical if mode == "lexical" else self.semantic)(query, pool).filter(keep)
        hits = fusion.ranked(hits, order)
        if dedupe:
            hits = postprocess.dedupe(hits)
        if max_per_file:
            hits = postprocess.max_per_key(hits, "path", max_per_file, "rank")
        hits = fusion.ranked(hits.drop("rank"), order).filter(F.col("rank") <= k)
        return postprocess.shape(postprocess.snippets(hits, query, snippet), KINDS[mode]).orderBy("rank")

    def search_json(self, query: str, **options) -> str:
        """The answer as one JSON object: schema number, query and effective parameters, results, a warning for each stale path."""
        rows = [r.asDict() for r in self.search(query, **options).collect()]  # at most k
        warnings = [{"path": p, "code": c} for p, c in self.stale(list(dict.fromkeys(r["path"] for r in rows)))]
        given = {n: p.default for n, p in inspect.signature(self.search).parameters.items() if n != "query"} | options
        filtered = bool(given["root"] or given["exts"] or given["exclude"] or given["include"] or given["dedupe"] or given["max_per_file"] > 0)
        parameters = given | {"pool": fusion.pool_size(given["k"], filtered, given["mode"] == "hybrid")}
        context = {"text": query, "terms": [list(p.terms) for p in parse_query(query)], "match": to_match(parse_query(query)), "index": self.ix.base}
        answer = {"schema": ANSWER_SCHEMA, "query": context, "parameters": parameters, "score_kind": KINDS[given["mode"]], "count": len(rows), "results": rows, "warnings": warnings}
        return json.dumps(answer, ensure_ascii=False, default=list)

    def stale(self, paths: list[str]) -> list[tuple[str, str]]:
        """(path, missing or modified) of indexed paths that differ on disk; one stat for each."""
        known = {r["path"]: r for r in self.ix.table("files").filter(F.col("path").isin(paths)).collect()} if paths else {}
        out = []
        for p in paths:
            try:
                s = os.stat(p)
                if p in known and (s.st_mtime_ns, s.st_size) != (known[p]["mtime"], known[p]["size"]):
                    out.append((p, "modified"))
            except OSError:
                out.append((p, "missing"))
        return out

    # show, status, check ---------------------------------------------------------------------------------------
    def show(self, ref: str, before: int = 0, after: int = 0) -> DataFrame:
        path, _, n = ref.rpartition("#")
        if not path or not n.isdigit():
            raise IndexError_("usage", f"{ref} is not path#n")
        rows = filters.chunk_range(self.ix.table("chunks"), path, int(n) - before, int(n) + after)
        if rows.filter(F.col("seq") == int(n)).isEmpty():
            span = self.ix.table("chunks").filter(F.col("path") == path).agg(F.min("seq"), F.max("seq")).first()
            raise IndexError_("usage", f"{path} is not indexed" if span[0] is None else f"{path} has chunks {span[0]} to {span[1]}")
        return rows

    def show_json(self, ref: str, before: int = 0, after: int = 0) -> str:
        """show() as one JSON object, with a warning if the file differs on disk."""
        rows = [r.asDict() for r in self.show(ref, before, after).collect()]
        stale = [{"path": p, "code": c} for p, c in self.stale([ref.rpartition("#")[0]])]
        return json.dumps({"schema": ANSWER_SCHEMA, "ref": ref, "before": before, "after": after, "chunks": rows, "warnings": stale}, ensure_ascii=False)

    def status(self) -> dict:
        m = self.ix.manifest()
        counts = m["stats"] | {"lengths": m["stats"]["chunks"], "vectors": self.ix.table("vectors").count()}
        per_root = filters.best_root(self.ix.table("files"), m["roots"]).groupBy("root").count().collect()
        size = self.ix.bytes()
        return m["meta"] | {"roots": m["roots"], "files": counts["files"], "chunks": counts["chunks"], "lexical_rows": counts["lengths"], "vectors": counts["vectors"], "files_by_root": {r["root"]: r["count"] for r in per_root}, "segments": len(m["segments"]), "bytes": size}

    def check(self, root: str | None = None, by_hash: bool = False, limit: int = 0, with_vectors: bool = False) -> dict:
        """Disk against index: counts by status, issues, the stale files in order; exit code 3 if anything is stale.

        with_vectors: whether a semantic search with this model and these prefixes could use the index, too.
        """
        if not self.ix.exists():
            return {"issues": ["no_index"], "counts": {}, "files": [], "stale": True, "exit_code": 3}
        from .sources.reading import read

        m = self.ix.manifest()
        rules = Rules(**m["meta"].get("selection", {}))
        roots = [os.path.realpath(root)] if root else m["roots"]
        disk = reduce(DataFrame.unionByName, (scan(self.spark, r, rules) for r in roots)).dropDuplicates(["path"]).persist()
        under = reduce(lambda a, b: a | b, (filters.subtree(F.col("path"), r) for r in roots))
        files = self.ix.table("files").filter(under)
        listed = disk.filter("reason is null and not is_dir").select("path", "size", "mtime")
        if by_hash:
            differing = listed.join(files.select("path", F.col("mtime").alias("m"), F.col("size").alias("s"), "hash"), "path").filter((F.col("m") != F.col("mtime")) | (F.col("s") != F.col("size")))
            again = read(differing.select("path", "size", "mtime"), rules.max_size).select("path", F.coalesce("hash", "code").alias("hash"))
            listed = listed.join(again, "path", "left").withColumn("hash", F.coalesce("hash", F.lit("")))
        compared = incremental.compare(listed, files, disk.filter(F.col("reason").isNotNull() & (F.col("reason") != FAILED)).select("path", "reason"), by_hash).persist()
        counts = {r["status"]: r["n"] for r in compared.groupBy("status").agg(F.count("*").alias("n")).collect()}
        issues = ["vectors_missing"] if (m["meta"].get("model") or with_vectors) and not self.ix.has_vectors() else []
        if with_vectors and self.ix.has_vectors() and any(m["meta"].get(k, "") != v for k, v in (("query_prefix", self.query_prefix), ("doc_prefix", self.doc_prefix))):
            issues.append("prefix_mismatch")
        if self.model and m["meta"].get("model") not in (None, self.model):
            issues.append("model_mismatch")
        rows = [(r["path"], r["status"], r["reason"]) for r in incremental.check_list(compared, limit).collect()]
        failed = _unlisted(disk)
        stale = bool(issues) or any(counts.get(s) for s in incremental.STATUS_ORDER)
        total = sum(counts.get(s, 0) for s in incremental.STATUS_ORDER)
        for df in (disk, compared):
            df.unpersist()
        return {"issues": issues, "counts": counts, "files": rows, "files_truncated": len(rows) < total, "failed": failed, "stale": stale, "exit_code": 3 if stale else 0}


__all__ = ["Engine", "find"]
