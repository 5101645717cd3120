"""What the operators share: bytes of texts out of Arrow, bounded word caches, column names, and tables by name.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r, which is what bytes.split() finds; a null text is
empty everywhere.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievestone.session import cut, held, map_arrow, shared_dir, ship, spread  # noqa: F401

WORD_SPLIT = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def fold_of(doc_id: str, folds: int):
    """crc32 of the id's decimal text modulo folds, as a column; null ids are in no fold."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of df has it (case ignored)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def scratch(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, removed when the driver's JVM ends."""
    parent = f"{shared_dir(spark).rstrip('/')}/sievestone-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(parent)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return f"{parent}/{name}"


class Known(dict):
    """A cache by word; it starts anew when it passes a number of words or of bytes, so a text's own words bound the rest."""

    def __init__(self, most: int, most_bytes: int = 48 << 20):
        super().__init__()
        self.most, self.most_bytes, self.bytes = most, most_bytes, 0

    def of(self, words: Sequence, compute: Callable[[Iterable], Iterable]) -> list:
        """The value of each word; compute gives those of the words that are not known yet, in their order."""
        try:
            return list(map(self.__getitem__, words))
        except KeyError:
            new = [w for w in set(words) if w not in self]
            size = sum(map(len, new))
            if len(self) + len(new) > self.most or self.bytes + size > self.most_bytes:
                self.clear()
                new = list(set(words))
                self.bytes, size = 0, sum(map(len, new))
            self.bytes += size
            self.update(zip(new, compute(new), strict=True))
            return list(map(self.__getitem__, words))


def with_group(rows: DataFrame, groups: DataFrame, key: str, total: int, most: int = 10_000) -> DataFrame:
    """rows joined with the group of their key; groups: checkpointed, with how many of the `total` rows each has in n.

    Groups with over 1 / most of the rows are fewer than `most`; they go to every task, so that no task gets all rows
    of a hot key. The others meet their rows in a shuffle.
    """
    hot = groups.filter(F.col("n") * most > total)
    if hot.isEmpty():
        return rows.join(groups.drop("n"), key)
    few = rows.join(F.broadcast(hot.drop("n")), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups.filter(F.col("n") * most <= total).drop("n"), key)
    return few.unionByName(rest)


def filesystem(uri: str):
    """The Arrow file system and path of a URI (a bare path is a local one)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if re.match(r"\w+:", uri) else f"file://{uri}")


def dealt(notes: DataFrame, part: str, where: str) -> None:
    """Notes written so that noted() finds those of one part (a bigint column) without a look at others."""
    notes.repartition(part).sortWithinPartitions(part).write.partitionBy(part).parquet(where)


def noted(where: str, part: str, value: int) -> pa.Table | None:
    """What dealt() wrote for a part, or None."""
    import pyarrow.parquet as pq

    fs, path = filesystem(f"{where}/{part}={value}")
    info = fs.get_file_info(path)
    return pq.ParquetDataset(path, filesystem=fs, partitioning=None).read() if info.is_file or info.type.name == "Directory" else None
