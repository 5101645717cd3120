"""Session helpers: where scratch data lives, and how Python workers find this package."""

from __future__ import annotations

import ctypes
import os
import re
import sys
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def local_session(cpus: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> SparkSession:
    """Put this checkout on the Python path of the workers that start from now on (clusters without it use --py-files)."""
    env = spark.sparkContext.environment
    parts = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, parts)])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only on one machine may it be unset; then it is a temporary one."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="sievestone-")
        spark.conf.set("spark.checkpoint.dir", where)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(where)
    return where


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where it is read in fewer parts than there are: one row group of a small file is one task otherwise.

    Large inputs have more parts than cores and stay as they are; nothing but the plan depends on this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder; its partitions stay as they are."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: What the tasks of one stage share in a worker process, and that stage.
_HELD: dict = {}
_STAGE: list = [None]


def held(key, make: Callable):
    """What make() gave in this worker under the key; it is dropped when the worker starts on another stage."""
    if key not in _HELD:
        _HELD[key] = make()
    return _HELD[key]


def begin_task() -> None:
    """Drop what an earlier stage held: workers are used again, also by other operators, and their memory is an executor's."""
    stage = TaskContext.get().stageId() if TaskContext.get() else None
    if stage != _STAGE[0]:
        _STAGE[0] = stage
        if _HELD:
            _HELD.clear()
            give_back()


def give_back() -> None:
    """Return memory that the allocators of this process keep but do not use."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)


def map_arrow(df: DataFrame, fn: Callable[[Iterator], Iterator], schema: str | StructType) -> DataFrame:
    """mapInArrow whose workers can import this package; Spark bounds batches in rows and bytes (arrow.maxBytesPerBatch, 64 MB).

    A worker gives memory back after each task, and what it held for a stage with the next one.
    """
    ship(df.sparkSession)

    def run(batches: Iterator) -> Iterator:
        begin_task()
        try:
            yield from fn(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def pieces(rows, size: int = 1 << 21) -> Iterator:
    """Slices of a batch or array of at most so many bytes, or of one row.

    A batch has up to 64 MB, and as Python objects several times that in each worker of an executor; of slices, only one is
    objects at a time.
    """
    if len(rows) < 2 or rows.nbytes <= size:
        yield rows
    else:
        half = len(rows) // 2
        yield from pieces(rows.slice(0, half), size)
        yield from pieces(rows.slice(half), size)


def by_pieces(fn: Callable[[pa.Array], pa.Array]) -> Callable[[pa.Array], pa.Array]:
    """fn, from an array to one of the same length, over slices; what it leaves free is given back."""

    def run(rows: pa.Array) -> pa.Array:
        out = [fn(x) for x in pieces(rows)]
        got = out[0] if len(out) == 1 else pa.concat_arrays(out)
        del out
        give_back()
        return got

    return run


def arrow_filesystem(uri: str):
    """The Arrow file system and path of a URI (a bare path is a local one)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if re.match(r"\w+:", uri) else f"file://{os.path.abspath(uri)}")
