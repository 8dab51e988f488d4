"""What the training-data operators share: table access, column names, lineage cuts."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six white-space characters that separate words: space, tab to carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, by whatever file system its path names."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row.

    The optimizer may copy an expression into each place that uses it, a lambda
    included, where it would run once an element; a lambda variable can't be copied.
    """
    return F.transform(F.array(value), body)[0]


#: What the operators' Python code remembers in a worker process: owner -> (function that forgets it), and whose turn it is.
_MEMORIES: dict[str, Callable[[], object]] = {}
_TURN = [""]


def remember(owner: str, forget: Callable[[], object]) -> None:
    """To be called where a module's memo tables are made."""
    _MEMORIES[owner] = forget


def only(owner: str) -> None:
    """Spark reuses workers from one operator to the next: the tables of all others are emptied, and their memory is given back."""
    if _TURN[0] == owner:
        return
    _TURN[0] = owner
    for name, forget in _MEMORIES.items():
        if name != owner:
            forget()
    _give_back()


def rest(owner: str) -> None:
    """To be called where a task ends: a worker that waits while the JVM works holds no memo tables."""
    _MEMORIES[owner]()
    _give_back()


def _give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library can't, memory is reused all the same
        ctypes.CDLL("libc.so.6").malloc_trim(0)


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, rows: int):
    """Batches of so many rows go to Python for the jobs that run inside: rows with whole sets or texts are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else (``lower`` also maps other scripts)."""
    return F.translate(text, UPPER, LOWER)


#: Ids are broadcast up to this many (some ten MB); more are joined by shuffle.
BROADCAST_IDS = 500_000


def small(ids: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """``ids``, to be broadcast if its rows, which are counted, are few."""
    return F.broadcast(ids) if ids.count() <= most else ids


def without(docs: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id is not in ``gone`` (a written table of the column ``key``); null ids stay."""
    return docs.join(small(gone.select(key).distinct()), key, "left_anti").select(docs.columns)


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir, or, where Spark runs in one process, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="murmur-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root


#: Folders of written tables of this driver, which go when it ends.
_BASES: list[tuple[SparkSession, str]] = []


def _folder(spark: SparkSession, path: str):
    """(file system, path) of a folder, as Hadoop objects."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _remove_all() -> None:
    for spark, base in _BASES:
        with contextlib.suppress(Exception):  # a session that has been stopped can't remove anything any more
            files, at = _folder(spark, base)
            files.delete(at, True)


class Tables:
    """Written intermediate tables of one operator call, in the shared folder.

    A written table cuts lineage, outlives executors and is read as often as wanted.
    ``keep`` removes what no later step reads; what is left, which the result may still
    read, goes when the driver's Python ends.
    """

    def __init__(self, spark: SparkSession, owner: str):
        self.spark, self.base = spark, f"{checkpoint_root(spark)}/{owner}-{uuid.uuid4().hex}"
        if not _BASES:
            atexit.register(_remove_all)
        _BASES.append((spark, self.base))

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.read(name, df.schema)

    def read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Removes these tables: no later step reads them."""
        for name in names:
            files, at = _folder(self.spark, self.path(name))
            files.delete(at, True)

    def keep(self, *names: str) -> None:
        """Removes all tables but these: what no later step reads."""
        files, base = _folder(self.spark, self.base)
        for status in files.listStatus(base):
            if status.getPath().getName() not in names:
                files.delete(status.getPath(), True)
