"""Structure-aware chunks of files, with overlap and line ranges.

A file is cut at structural starts (headings, declarations, top-level keys), each block into paragraphs, paragraphs that
are too long into lines, lines that are too long into runs of `size` characters; the units are packed greedily. Each
file is its own task's work: an Arrow batch in, one row for each chunk out, nothing shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..session import by_pieces, map_arrow, pieces

SIZE, OVERLAP = 1200, 150

#: Line beginnings that start a block, and those that belong to the block below them, by language.
DECLARATIONS = {
    "go": (False, ("func ", "type ", "const ", "var ", "func(", "//go:"), ("//",)),
    "py": (True, ("def ", "class ", "async def "), ("#", "@")),
    "js": (False, ("function ", "function*", "async function", "class ", "export ", "module.exports", "describe(", "it(", "test("), ("//", "/*", "*", "@")),
}
LANGUAGES = {"md": "md markdown", "go": "go", "py": "py pyi", "js": "js mjs cjs jsx ts tsx mts cts", "yaml": "yaml yml", "json": "json"}
_LANGUAGE = {"." + ext: name for name, exts in LANGUAGES.items() for ext in exts.split()}
_HEADING = re.compile(r"#{1,6}[ \t]")


@dataclass
class Unit:
    text: str
    sep: str
    at: int
    opens: bool = False


def language(path: str) -> str | None:
    name = path.rsplit("/", 1)[-1]
    return _LANGUAGE.get("." + name.rsplit(".", 1)[1].lower()) if "." in name else None


def _markdown(lines: list[str]) -> Iterator[int]:
    fence = None
    for i, line in enumerate(x.strip() for x in lines):
        if fence:
            fence = None if line.startswith(fence) else fence
        elif line.startswith(("```", "~~~")):
            fence = line[:3]
        elif _HEADING.match(line):
            yield i


def _yaml(lines: list[str]) -> Iterator[int]:
    return (i for i, x in enumerate(lines) if x and x[0] not in " \t#" and (x.startswith(("---", "- ")) or ":" in x))


def _json(lines: list[str]) -> Iterator[int]:
    depth, quoted = 0, False
    for i, line in enumerate(lines):
        body = line.lstrip(" \t")
        if depth == 1 and not quoted and body and body[0] not in "}]":
            yield i
        skip = False
        for c in line:
            if skip:
                skip = False
            elif quoted:
                skip, quoted = c == "\\", c != '"'
            elif c == '"':
                quoted = True
            else:
                depth += (c in "{[") - (c in "}]")


def starts(path: str, text: str) -> list[int]:
    """Where the structural blocks after the first begin, as character offsets in rising order."""
    kind = language(path)
    lines = text.split("\n")
    if lines[-1] == "" and len(lines) > 1:
        lines.pop()
    if kind is None or len(lines) < 2:
        return []
    if kind in DECLARATIONS:
        indented, heads, attached = DECLARATIONS[kind]
        found = [i for i, x in enumerate(lines) if (x.lstrip(" \t") if indented else x).startswith(heads)]
    else:
        found, attached = list({"md": _markdown, "yaml": _yaml, "json": _json}[kind](lines)), ("#",) if kind == "yaml" else ()
    offsets, total = [], 0
    for x in lines:
        offsets.append(total)
        total += len(x) + 1
    out: list[int] = []
    for i in found:
        while i and attached and lines[i - 1].lstrip(" \t").startswith(attached):
            i -= 1
        if i and (not out or offsets[i] > out[-1]):
            out.append(offsets[i])
    return out


def _units(text: str, size: int, base: int) -> Iterator[Unit]:
    at = base
    for n, para in enumerate(text.split("\n\n")):
        here, at, sep = at, at + len(para) + 2, "\n\n" if n else ""
        if not para.strip():
            continue
        if len(para) <= size:
            yield Unit(para, sep, here)
            continue
        for line in para.split("\n"):
            if len(line) <= size:
                yield Unit(line, sep, here)
            else:
                for k in range(0, len(line), size):
                    yield Unit(line[k : k + size], "" if k else sep, here + k)
            here, sep = here + len(line) + 1, "\n"


def _blocks(text: str, size: int, bounds: list[int]) -> Iterator[Unit]:
    """Units; the first of each later block that has any opens it, after a line break."""
    owed = False
    for a, b in zip([0, *bounds], [*bounds, len(text)], strict=True):
        for k, unit in enumerate(_units(text[a:b], size, a)):
            if not k:
                if owed:
                    unit.sep, unit.opens = "\n", True
                owed = True
            yield unit


def _packed(units: Iterator[Unit], size: int) -> list[tuple[str, int, int]]:
    """(text, start, end) of greedily joined units; a unit that opens a block closes a chunk at least half full."""
    out, parts, length, start, end = [], [], 0, 0, 0
    for u in units:
        full = length and (length + len(u.sep) + len(u.text) > size or u.opens and length >= size // 2)
        if full:
            out.append(("".join(parts), start, end))
            parts, length = [], 0
        sep = u.sep if length else ""
        if not length:
            start = u.at
        parts += [sep, u.text]
        length, end = length + len(sep) + len(u.text), u.at + len(u.text)
    out.append(("".join(parts), start, end))
    return [x for x in out if x[0].strip()]


def tail(text: str, n: int) -> str:
    """The last n characters, from the next word on if the cut word is in the first half (in bytes)."""
    if len(text) <= n:
        return text.strip()
    out = text[len(text) - n :]
    gap = re.search("[ \t\n]", out)
    if gap and 0 < len(out[: gap.start()].encode()) < len(out.encode()) // 2:
        out = out[gap.end() :]
    return out.strip()


def split(path: str, text: str, size: int = SIZE, overlap: int = OVERLAP, structured: bool = True) -> list[tuple[str, int, int]]:
    """(text, first line, last line) of each chunk; lines from 1. Overlap comes on top of size."""
    if size <= 0:
        return []
    overlap = size // 2 if overlap >= size else max(0, overlap)
    spans = _packed(_blocks(text, size, starts(path, text) if structured else []), size)
    breaks = [m.start() for m in re.finditer("\n", text)]
    out = []
    for k, (body, a, b) in enumerate(spans):
        before = tail(spans[k - 1][0], overlap - 1) if k and overlap >= 2 else ""
        if before:
            found = spans[k - 1][0].rfind(before)
            a, body = (spans[k - 1][1] + found if found >= 0 else a), before + "\n" + body
        out.append((body, bisect_left(breaks, a) + 1, bisect_left(breaks, max(a, b - 1)) + 1))
    return out


def chunks(files: DataFrame, size: int = SIZE, overlap: int = OVERLAP, structured: bool = True) -> DataFrame:
    """path, seq, text, line_start, line_end of the chunks of files (path, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in pieces(b)):
            rows = [(p, k, *c) for p, t in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True) for k, c in enumerate(split(p, t or "", size, overlap, structured))]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["path", "seq", "text", "line_start", "line_end"])

    return map_arrow(files.select("path", "text"), run, "path string, seq int, text string, line_start int, line_end int")


def overlap_before(rows: DataFrame, key: str, seq: str, n: int) -> DataFrame:
    """rows (with text) and overlap: the tail of at most n characters of the chunk before; empty for a file's first chunk."""

    @arrow_udf("string")
    def tails(texts: pa.Array) -> pa.Array:
        return by_pieces(lambda x: pa.array([tail(t or "", n) for t in x.to_pylist()], pa.string()))(texts)

    before = F.lag("text").over(Window.partitionBy(key).orderBy(seq))
    return rows.withColumn("overlap", before).withColumn("overlap", tails("overlap"))
