"""What happens to a ranked pool: greedy overlap removal, caps for each file, shaping."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _overlaps(a: Column, b: Column) -> Column:
    """Inclusive line ranges meet, or, where either has no lines, neighbouring chunks."""
    lined = (a.getField("line_start") > 0) & (b.getField("line_start") > 0)
    return F.when(lined, (a.getField("line_start") <= b.getField("line_end")) & (b.getField("line_start") <= a.getField("line_end"))).otherwise(F.abs(a.getField("seq") - b.getField("seq")) <= 1)


def dedupe(hits: DataFrame) -> DataFrame:
    """Greedy in rank order within each path: a hit that overlaps an accepted one goes.

    hits (path, seq, line_start, line_end, rank, ...) is a pool of bounded size; the result has its columns.
    """
    names = hits.columns
    first = ["rank", *[c for c in names if c not in ("rank", "path")]]
    rows = hits.groupBy("path").agg(F.sort_array(F.collect_list(F.struct(*first))).alias("rows"))
    empty = F.filter(F.col("rows"), lambda x: F.lit(False))
    kept = F.aggregate("rows", empty, lambda acc, x: F.when(F.exists(acc, lambda y: _overlaps(x, y)), acc).otherwise(F.array_append(acc, x)))
    return rows.select("path", F.inline(kept)).select(*names)


def max_per_key(hits: DataFrame, key: str, n: int, *order) -> DataFrame:
    """The first n hits of each key in the given order.

    Partial ranks within a split of the key (by hash of all columns) come first, so a hot key isn't sorted in one task.
    """
    if n <= 0:
        return hits
    split = F.pmod(F.xxhash64(*hits.columns), F.lit(32))
    part = hits.withColumn("__r", F.row_number().over(Window.partitionBy(key, split).orderBy(*order))).filter(F.col("__r") <= n)
    return part.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("__r") <= n).drop("__r")


def unique_paths(hits: DataFrame) -> DataFrame:
    """path, rank: distinct paths in the order of their first hit."""
    return hits.groupBy("path").agg(F.min("rank").alias("rank")).orderBy("rank")


def snippet_at(text: Column, at: Column, size: int) -> Column:
    """size characters with the match (position from 0, or null) a third in; cut sides get an ellipsis."""
    n = F.char_length(text)
    start = F.greatest(F.lit(0), F.least(at - size // 3, n - size))
    cut = F.concat(F.when(start > 0, "...").otherwise(""), F.substring(text, start + 1, F.lit(size)), F.when(start + size < n, "...").otherwise(""))
    return F.when(n <= size, text).when(at.isNull(), F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(cut)


def trim_lines(text: Column) -> Column:
    """Lines without trailing blanks, no empty lines at either end."""
    return F.regexp_replace(F.regexp_replace(text, "[ \\t]+(?=\\n|$)", ""), "^\\n+|\\n+$", "")


def match_position(query: str):
    """A column function: where the first word that the query matches begins, or null."""
    import regex
    from pyspark.sql.functions import arrow_udf

    from ..functions.stemming import stem
    from ..functions.text import py_fold
    from ..session import by_pieces

    exact, prefixes = set(), []
    for w in regex.findall(r"[\p{L}\p{Nd}*]+", py_fold(query)):
        if w.endswith("*"):
            prefixes += [w[:-1]] if w != "*" else []
        else:
            exact.add(stem(w))
    starts = tuple(prefixes)

    def found(texts: pa.Array) -> pa.Array:
        known: dict[str, bool] = {}  # of the words of these texts

        def matches(word: str) -> bool:
            if word not in known:
                w = py_fold(word)
                known[word] = stem(w) in exact or bool(starts) and w.startswith(starts)
            return known[word]

        words = regex.compile(r"[\p{L}\p{Nd}]+")
        return pa.array([next((m.start() for m in words.finditer(t or "") if matches(m[0])), None) for t in texts.to_pylist()], pa.int32())

    @arrow_udf("int")
    def position(texts: pa.Array) -> pa.Array:
        return by_pieces(found)(texts)

    return position


def snippets(hits: DataFrame, query: str, size: int = 500) -> DataFrame:
    """hits with text cut to a window around the query's first match, and truncated."""
    if size <= 0:
        return hits.withColumn("truncated", F.lit(False))
    clean = hits.withColumn("__clean", trim_lines(F.col("text")))
    clean = clean.withColumn("__at", match_position(query)(F.col("__clean")))
    short = snippet_at(F.col("__clean"), F.col("__at"), size)
    return clean.withColumn("__short", short).withColumn("truncated", F.col("__short") != F.col("text")).withColumn("text", F.col("__short")).drop("__clean", "__at", "__short")


EXTRACTED = (".docx", ".odt", ".ods", ".odp", ".xlsx", ".pptx", ".rtf", ".fb2", ".ipynb", ".epub")


def shape(hits: DataFrame, kind: str) -> DataFrame:
    """Result columns: rank, ref, source_type and score_kind beside the hit's own."""
    from ..functions.text import extension

    source = F.when(extension(F.col("path")).isin(*EXTRACTED), "extracted").otherwise("text")
    return hits.withColumn("ref", F.concat("path", F.lit("#"), F.col("seq").cast("string"))).withColumn("source_type", source).withColumn("score_kind", F.lit(kind))


def header(hits: DataFrame) -> Column:
    """path#seq  start-end  score line of a text listing."""
    return F.format_string("%s#%d  %d-%d  %.3f", "path", "seq", "line_start", "line_end", "score")
