"""Path predicates: subtrees, globs, extensions, roots."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import extension


def subtree(path: Column, prefix: str | Column) -> Column:
    """The path itself or anything below it; case matters, and names with wildcard characters are literal."""
    if isinstance(prefix, Column):
        return (path == prefix) | path.startswith(F.concat(F.rtrim(prefix, F.lit("/")), F.lit("/")))
    p = prefix.rstrip("/") or "/"
    return (path == p) | path.startswith(p if p == "/" else p + "/")


def glob_regex(pattern: str) -> str | None:
    """A Java and Python pattern for a glob with *, ?, [], {} and **; None for an invalid glob, which matches nothing."""
    out, i, depth, n = [], 0, 0, len(pattern)
    while i < n:
        c = pattern[i]
        if pattern.startswith("**", i) and (i == 0 or pattern[i - 1] == "/") and (i + 2 == n or pattern[i + 2] == "/"):
            if i + 2 == n:
                if out and out[-1] == "/":
                    out[-1] = "(?:/.*)?"
                else:
                    out.append(".*")
                i += 2
            else:
                out.append("(?:.*/)?")
                i += 3
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            j = pattern.find("]", i + 2)
            if j < 0:
                return None
            body = pattern[i + 1 : j]
            body = "^" + body[1:] if body[0] in "!^" else body
            out.append("[" + body.replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&") + "]")
            i = j
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "\\":
            if i + 1 == n:
                return None
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append(re.escape(c) if c != "/" else "/")
        i += 1
    return None if depth else "^" + "".join(out) + "$"


def matches_any(value: Column, patterns: list[str]) -> Column:
    compiled = [r for r in map(glob_regex, patterns) if r]
    return reduce(lambda a, b: a | b, (F.regexp_like(value, F.lit(r)) for r in compiled), F.lit(False))


def relative_to(path: Column, root: str) -> Column:
    """The path below a root, or null."""
    r = root.rstrip("/") + "/"
    return F.when(path.startswith(r), F.substring(path, len(r) + 1, 1 << 30))


def path_glob(path: Column, patterns: list[str], roots: list[str]) -> Column:
    """Whether a glob matches the absolute path or the path relative to an indexed root."""
    forms = [path, *(relative_to(path, r) for r in roots)]
    return reduce(lambda a, b: a | b, (F.coalesce(matches_any(f, patterns), F.lit(False)) for f in forms))


def normalize_exts(exts: list[str]) -> list[str]:
    return ["." + e.strip().lower().lstrip(".") for e in exts if e.strip().lstrip(".")]


def ext_filter(path: Column, exts: list[str]) -> Column:
    own = normalize_exts(exts)
    return extension(path).isin(*own) if own else F.lit(True)


def result_filter(path: Column, root: str | None = None, exts: list[str] = (), exclude: list[str] = (), include: list[str] = (), roots: list[str] = ()) -> Column:
    """Root, extension, exclusion and path globs together; a root must be one of the indexed ones."""
    if root is not None and root.rstrip("/") not in [r.rstrip("/") for r in roots]:
        raise ValueError(f"{root} is not an indexed root")
    out = subtree(path, root) if root is not None else F.lit(True)
    out = out & ext_filter(path, list(exts))
    if exclude:
        out = out & ~path_glob(path, list(exclude), list(roots))
    return out & path_glob(path, list(include), list(roots)) if include else out


def best_root(rows: DataFrame, roots: list[str], name: str = "root") -> DataFrame:
    """rows with the most specific root of their path, else (other)."""
    found = F.lit("(other)")
    for r in sorted(roots, key=len):
        found = F.when(subtree(F.col("path"), r), F.lit(r)).otherwise(found)
    return rows.withColumn(name, found)


def add_root(roots: Column, new: str | Column) -> Column:
    """roots with a new one, unless covered; roots inside it are absorbed."""
    own = F.lit(new) if isinstance(new, str) else new
    return F.when(F.exists(roots, lambda r: subtree(own, r)), roots).otherwise(F.array_append(F.filter(roots, lambda r: ~subtree(r, own)), own))


def remove_root(roots: Column, prefix: str) -> Column:
    """roots without those at or inside a prefix; wider ones stay."""
    return F.filter(roots, lambda r: ~subtree(r, prefix))


def parse_ref(ref: Column) -> Column:
    """struct(path, seq) of path#n, cut at the last #; null if it isn't one."""
    ok = F.regexp_like(ref, F.lit("^.+#\\d+$"))
    return F.when(ok, F.struct(F.regexp_extract(ref, "^(.+)#(\\d+)$", 1).alias("path"), F.regexp_extract(ref, "^(.+)#(\\d+)$", 2).try_cast("int").alias("seq")))


def chunk_range(chunks: DataFrame, path: str, first: int, last: int) -> DataFrame:
    return chunks.filter((F.col("path") == path) & F.col("seq").between(first, last)).orderBy("seq")


def spans(chunks: DataFrame, key: str = "path", seq: str = "seq") -> DataFrame:
    """key, first_seq, last_seq of each file's chunks."""
    return chunks.groupBy(key).agg(F.min(seq).alias("first_seq"), F.max(seq).alias("last_seq"))


def around(chunks: DataFrame, hits: DataFrame, before: int, after: int, key: str = "path", seq: str = "seq") -> DataFrame:
    """For each hit (key, seq): the chunks from `before` ahead of it to `after` behind it that exist, their number in near."""
    wanted = hits.select(key, seq, F.explode(F.sequence(F.col(seq) - before, F.col(seq) + after)).alias("near"))
    return wanted.join(chunks.withColumnRenamed(seq, "near"), [key, "near"])
