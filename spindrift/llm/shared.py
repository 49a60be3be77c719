"""The folder that driver and executors share, and tables written to it.

``spark.checkpoint.dir`` names the folder. A run on one machine without that
setting (tests) gets a temporary folder; on a cluster a missing setting is an
error, since a machine-local folder would lose data with its machine.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import logging
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder, without a trailing slash."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = sc._jsc.sc().getCheckpointDir()
        base = base.get() if base.isDefined() else None
        if base is None:
            base = "file://" + tempfile.mkdtemp(prefix="shared-")
            logging.getLogger(__name__).warning("spark.checkpoint.dir is not set: this machine's %s is used", base)
            sc.setCheckpointDir(base)
    elif not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """URI of a folder of this call alone; removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(remove_all)
    _made.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage ends there."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def file_folder(spark: SparkSession, name: str) -> str:
    """URI of a new, existing folder for files that tasks write themselves, as
    pyarrow names it: the JVM's file system resolves mounts to what is behind."""
    at = spark._jvm.org.apache.hadoop.fs.Path(new_folder(spark, name))
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    uri = re.sub("^file:/+", "file:///", str(fs.resolvePath(at).toString()))
    uri = re.sub("^s3[an]://", "s3://", uri)
    try:
        file_system(uri)
    except Exception as e:
        raise ValueError(f"tasks cannot write files of their own to {uri}: {e}") from e
    return uri


def release(df: DataFrame) -> None:
    """Removes a table of ``written`` that nothing reads any more."""
    path = getattr(df, "_written_to", None)
    if path is not None:
        _removed(df.sparkSession, path)
        _made[:] = [x for x in _made if x[1] != path]


def _removed(spark: SparkSession, path: str) -> bool:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception as e:  # the session has ended, or the store refused: the files stay with the folder's owner
        logging.getLogger(__name__).warning("%s could not be removed: %s", path, e)
        return False


def input_bytes(df: DataFrame) -> int | None:
    """Size by the optimizer's statistics; None where it has none (it then says
    as much as a long holds, or products of such sizes)."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 50 else None


def tasks_for(df: DataFrame, task_bytes: int = 32 << 20) -> int:
    """Shuffle partitions for rows that grow with ``df``: the session's number
    at least, more where the statistics ask for it."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(1 << 20, -(-(input_bytes(df) or 0) // task_bytes)))


def unused(columns: list[str], name: str) -> str:
    """A column name that is not taken (Spark does not tell cases apart)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def unique_ids(df: DataFrame, id_col: str) -> bool:
    """Whether every row has an id of its own."""
    ids = df.select(F.col(id_col).cast("long").alias("id"))
    n = ids.agg(F.count(F.lit(1)).alias("rows"), F.count("id").alias("known")).first()
    return n.rows == n.known and not ids.groupBy("id").count().where("count > 1").limit(1).count()


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings for the jobs inside; ``__`` stands for a dot."""
    names = {"spark.sql." + k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Lets the optimizer put a Bloom filter of the join keys (of bounded size, 8 MB)
#: before the shuffle of texts of which a join keeps a part.
KEEP_FEW = {
    "optimizer__runtime__bloomFilter__applicationSideScanSizeThreshold": "1MB",
    "optimizer__runtime__bloomFilter__creationSideThreshold": "100GB",
    "optimizer__runtime__bloomFilter__expectedNumItems": "4000000",
    "optimizer__runtime__bloomFilter__numBits": "67108864",
}


def remove_all() -> None:
    """Removes what ``new_folder`` has given out."""
    while _made:
        _removed(*_made.pop())


def hand_back() -> None:
    """Returns this process's freed memory to the system."""
    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        return  # another C library: nothing to hand back


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task function that hands freed memory back when it ends: workers are
    reused, and what one step has freed would count against the next."""

    def task(batches: Iterator) -> Iterator:
        yield from run(batches)
        hand_back()

    return task


def file_system(uri: str):
    """A pyarrow file system and the path in it, for files written by executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
