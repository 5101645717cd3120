"""What files of a tree are to be indexed, and why the others aren't.

Spark's own sources drop names that start with _ or . and cut times to milliseconds, so folders are listed here: the
upper ones by the driver, level by level, until there are enough to share out; what is below them by executors, which
must see the tree at the same place. Reading and decoding is the executors' work too.
"""

from __future__ import annotations

import os
import re
import stat
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..operators.filters import glob_regex
from ..session import map_arrow

#: Names that are never, or not by default, indexed; all compared in lower case.
INDEX_DIR = ".sievestone"
HARD_EXCLUDED = (".git", INDEX_DIR)
VENDOR = ("node_modules", "vendor")
NOISY = "*.lock *-lock.json *.min.js *.min.css *.map *.svg".split()
SECRETS = (
    ".env .env.* *.env *.pem *.key *.p12 *.pfx *.jks *.keystore *.ppk id_rsa id_dsa id_ecdsa id_ed25519 "
    ".netrc .pgpass .npmrc .htpasswd .git-credentials credentials credentials.json secrets.json secrets.yaml secrets.yml"
).split()
MAX_SIZE = 10 << 20


@dataclass
class Rules:
    """How a tree is selected; empty ext admits all, empty noisy finds nothing noisy."""

    ext: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    include_hidden: list[str] = field(default_factory=list)
    noisy: list[str] = field(default_factory=lambda: list(NOISY))
    hidden: bool = False
    vendor: bool = False
    gitignore: bool = True
    max_size: int = MAX_SIZE
    include_noisy: list[str] = field(default_factory=list)


def _any(patterns: list[str], *values: str) -> bool:
    return any(r and re.fullmatch(r.strip("^$"), v) for r in map(glob_regex, patterns) for v in values)


class Ignore:
    """One .gitignore: of its lines the last that matches decides."""

    def __init__(self, text: str):
        self.rules: list[tuple[re.Pattern, bool, bool]] = []
        for line in text.splitlines():
            line = re.sub(r"(?<!\\)\s+$", "", line)
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            line = line[keep:].removeprefix("\\")
            folder, line = line.endswith("/"), line.rstrip("/")
            anchored = "/" in line
            body = glob_regex(line.lstrip("/") if anchored else "**/" + line)
            if body:
                self.rules.append((re.compile(body), keep, folder))

    def ignores(self, rel: str, is_dir: bool) -> bool:
        out = False
        for pattern, keep, folder in self.rules:
            if (is_dir or not folder) and pattern.match(rel):
                out = not keep
        return out


def may_hold(patterns: list[str], rel: str, name: str) -> bool:
    """Whether a folder matches, or something below it may match, one of the globs."""
    if _any(patterns, rel, name):
        return True
    for p in patterns:
        segments, here = p.split("/"), rel.split("/")
        ok = True
        for i, x in enumerate(here):
            if i >= len(segments):
                ok = segments[-1] == "**"
                break
            if segments[i] == "**":
                break
            if not _any([segments[i]], x):
                ok = False
                break
        if ok:
            return True
    return False


class Lister:
    """Decides about the entries of one folder at a time."""

    def __init__(self, root: str, rules: Rules | None = None):
        self.root, self.rules = os.path.realpath(root), rules or Rules()
        self.exts = {"." + e.strip().lower().lstrip(".") for e in self.rules.ext}

    def dir_reason(self, rel: str, name: str, ignored: bool) -> str | None:
        low, rules = name.lower(), self.rules
        if low in HARD_EXCLUDED:
            return "hard_excluded"
        if low in VENDOR and not rules.vendor:
            return "vendor"
        if name.startswith(".") and not rules.hidden and not may_hold(rules.include_hidden, rel, name):
            return "hidden"
        return "gitignore" if ignored else "exclude_glob" if _any(rules.exclude, rel, name) else None

    def file_reason(self, rel: str, name: str, size: int, ignored: bool) -> str | None:
        low, rules = name.lower(), self.rules
        if ignored:
            return "gitignore"
        if _any(rules.exclude, rel, name):
            return "exclude_glob"
        if _any(rules.noisy, low) and not _any(rules.include_noisy, rel, name):
            return "noisy"
        if not _any(rules.include_hidden, rel, name):
            if name.startswith(".") and not rules.hidden:
                return "hidden"
            if _any(SECRETS, low):
                return "secret"
        if self.exts and os.path.splitext(low)[1] not in self.exts:
            return "ext"
        return "empty" if size == 0 else "too_large" if size > rules.max_size else None

    def ignores(self, folder: str) -> list[tuple[str, Ignore]]:
        """The .gitignore files from the root down to a folder, itself included."""
        rel = os.path.relpath(folder, self.root)
        names = [] if rel == "." else rel.split(os.sep)
        out = []
        for k in range(len(names) + 1) if self.rules.gitignore else ():
            at = os.path.join(self.root, *names[:k])
            try:
                with open(os.path.join(at, ".gitignore"), encoding="utf-8", errors="replace") as f:
                    out.append((at, Ignore(f.read())))
            except OSError:
                pass
        return out

    def folder(self, folder: str) -> tuple[list[tuple], list[str]]:
        """Rows of a folder's entries (as SCAN), and the folders below it that are to be listed."""
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError as e:
            return [(folder, os.path.relpath(folder, self.root), 0, 0, True, FAILED, str(e))], []
        above, rows, below = self.ignores(folder), [], []
        for e in entries:
            path, rel = e.path, os.path.relpath(e.path, self.root).replace(os.sep, "/")
            try:
                info = e.stat(follow_symlinks=False)
            except OSError as err:
                rows.append((path, rel, 0, 0, False, FAILED, str(err)))
                continue
            is_dir = stat.S_ISDIR(info.st_mode)
            ignored = any(g.ignores(os.path.relpath(path, at).replace(os.sep, "/"), is_dir) for at, g in above)
            if stat.S_ISLNK(info.st_mode):
                reason = "symlink"
            elif is_dir:
                reason = self.dir_reason(rel, e.name, ignored)
                if reason is None:
                    below.append(path)
                    continue
            elif stat.S_ISREG(info.st_mode):
                reason = self.file_reason(rel, e.name, info.st_size, ignored)
            else:
                continue
            rows.append((path, rel, info.st_size, info.st_mtime_ns, is_dir, reason, None))
        return rows, below

    def below(self, folder: str) -> Iterator[tuple]:
        """Rows of a folder and of all below it."""
        todo = [folder]
        while todo:
            rows, more = self.folder(todo.pop())
            yield from rows
            todo += reversed(more)


FAILED = "walk_failed"  # the reason of what could not be listed
SCAN = "path string, rel string, size bigint, mtime bigint, is_dir boolean, reason string, message string"


def walk(root: str, rules: Rules | None = None) -> Iterator[tuple[str, str, int, int, bool, str | None, str | None]]:
    """(path, rel, size, mtime in ns, is_dir, reason, message) of each candidate file (reason None) and each exclusion."""
    lister = Lister(root, rules)
    return lister.below(lister.root)


def _normal(rows: Iterator[tuple]) -> Iterator[tuple]:
    return ((unicodedata.normalize("NFC", p), unicodedata.normalize("NFC", r), *rest) for p, r, *rest in rows)


def scan(spark: SparkSession, root: str, rules: Rules | None = None, share: int = 256) -> DataFrame:
    """walk() as rows with NFC paths; candidates have no reason. From `share` folders of one level on, executors go on from there."""
    lister = Lister(root, rules)
    rows, level = [], [lister.root]
    while level and len(level) < share:
        found = [lister.folder(f) for f in level]
        rows += [r for own, _ in found for r in own]
        level = [f for _, more in found for f in more]
    top = spark.createDataFrame(list(_normal(rows)), SCAN)
    if not level:
        return top

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for folder in (f for batch in batches for f in batch.column("folder").to_pylist()):
            held = _normal(lister.below(folder))
            while part := list(islice(held, 10_000)):
                cols = list(zip(*part, strict=True))
                kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [x.split()[0] for x in SCAN.split(", ")])

    folders = spark.createDataFrame([(f,) for f in level], "folder string").repartition(min(len(level), 4 * spark.sparkContext.defaultParallelism))
    return top.unionByName(map_arrow(folders, run, SCAN))
