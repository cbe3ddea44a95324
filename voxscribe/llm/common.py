"""What the corpus operators share: the shared work folder, written intermediate tables, table reading, folds."""

from __future__ import annotations

import atexit
import ctypes
import functools
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxscribe import shipping

__all__ = ["columns", "dropped", "fold", "frugal", "id_text", "lasting", "shared_dir", "ship", "table", "written"]
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, and bounds what goes to a Python worker at once by its bytes, unless the session has another bound than Spark's 64 MB."""
    shipping.ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A worker's function over batches that gives freed memory back to the system when it ends; workers stay for later tasks."""

    @functools.wraps(run)
    def thrifty(batches: Iterator) -> Iterator:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return thrifty


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of a data folder; any path that Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; a folder of this machine only where that is unset (local runs)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="voxscribe-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


_scopes: list[list[str]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet into the shared folder and read again: lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/voxscribe-{name}-{uuid.uuid4().hex}"
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, None)
    spark.conf.set(cleanup, "true")  # once the table stands, nothing reads the shuffles that made it
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(cleanup) if before is None else spark.conf.set(cleanup, before)
    if _scopes:
        _scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def lasting(name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The result of make() as written() gives it; the tables that make() wrote on the way are deleted."""
    _scopes.append([])
    try:
        df = make()
    except BaseException:
        _scopes.pop()
        raise
    paths = _scopes.pop()
    out = written(df, name)
    for path in paths:
        _delete(df.sparkSession, path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table made by written() that no later plan reads."""
    for parent in {os.path.dirname(f) for f in df.inputFiles()}:
        if "voxscribe-" in parent:
            _delete(df.sparkSession, parent)


def columns(df: DataFrame, of: str = "") -> list[Column]:
    """All columns of df by their quoted names, or the fields of that name of a struct column `of`."""
    quoted = ["`" + c.replace("`", "``") + "`" for c in df.columns]
    return [F.col(f"{of}.{q}" if of else q).alias(c) for q, c in zip(quoted, df.columns)]


def id_text(column: str = "doc_id") -> Column:
    """An id as text; the empty text for a null id."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`. A null id counts as the empty text, whose crc32 is 0."""
    return F.crc32(id_text(column).cast("binary")) % F.lit(folds)
