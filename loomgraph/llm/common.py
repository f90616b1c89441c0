"""What the operators of this subpackage share: text primitives, and tables written to cut lineage."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The whitespace that separates words; exactly what ``bytes.split()`` splits at.
WHITESPACE = b" \t\n\x0b\x0c\r"
#: The same as a Java regular expression for the words between.
WORD_REGEX = r"[^\x20\x09-\x0D]+"
_STAGED: list[str] = []
_HELD: dict[tuple, object] = {}
_ASKED: list[tuple] = []
_TO_SPACE = bytes(32 if c in WHITESPACE else c for c in range(256))


def squeeze(raw: bytes) -> bytes:
    """Replace each run of whitespace by one space; ends keep theirs."""
    raw = raw.translate(_TO_SPACE)
    while b"  " in raw:
        raw = raw.replace(b"  ", b" ")
    return raw


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else one made here (local runs and tests)."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if (set_by_context := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        return set_by_context.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + os.path.join(tempfile.gettempdir(), f"loomgraph-{uuid.uuid4().hex}")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    This cuts lineage, keeps iterations from recomputing, and survives the loss of any executor.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGED.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_folder(spark: SparkSession, tag: str) -> str:
    """The name of a new folder under the shared one, which ``release`` deletes with what is staged."""
    path = f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    _STAGED.append(path)
    return path if "://" in path else f"file://{path.removeprefix('file:')}"


def staged_so_far() -> int:
    return len(_STAGED)


def release(spark: SparkSession, since: int = 0, but: int = 0) -> None:
    """Delete what this session has staged after the first ``since`` tables, except the last ``but`` ones; what reads
    them must have been written before."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for name in _STAGED[since : len(_STAGED) - but]:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
    del _STAGED[since : len(_STAGED) - but]


def spread(df: DataFrame, factor: int = 4) -> int:
    """A number of partitions for compute-bound steps: follows the cluster, and at least its shuffle partitions."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), factor * spark.sparkContext.defaultParallelism)


def trimmed(run: Callable) -> Callable:
    """A function of batches that gives a task's freed memory back to the system at its end.

    Workers live on from task to task; what their allocators hold on to would add up with the executor's own memory. So
    would what another operator's tasks had ``held``: it goes with the first task that doesn't ask for it.
    """

    def whole(batches: Iterator) -> Iterator:
        _ASKED.clear()
        yield from run(batches)
        if not _ASKED:
            _HELD.clear()
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return whole


def held(make: Callable, *args):
    """What ``make`` makes of ``args``, kept in a worker from task to task until another operator asks for its own."""
    key = (make, args)
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make(*args)
    _ASKED.append(key)
    return _HELD[key]


def word_count(text: str):
    """Number of words of a text column; null counts as none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_REGEX)), F.lit(0)).cast("long")
