"""Helpers shared by the training-data operators: scratch tables, word patterns, null-safe keys."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; a word is a maximal run of anything else.
SPACE = r"[\x20\x09-\x0D]+"
#: Stands for a null id wherever ids are ordered: nulls come last.
NULL_ID = (1 << 63) - 1
#: Most bytes of an Arrow batch: executors hold a few per task, in the JVM and in Python.
ARROW_BYTES = str(8 << 20)
FILE_ROWS = 50_000
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a local master gets one of its own (tests); a cluster has no folder that may be guessed.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not (spark.sparkContext.master or "").startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: it must name a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(f"{tempfile.gettempdir()}/lodestone")
    return spark.sparkContext.getCheckpointDir()


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Plans that are run inside exchange batches of at most ARROW_BYTES with Python (or one row, if that is larger)."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, ARROW_BYTES)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release_memory() -> None:
    """Give memory that is no longer used back to the system: Python workers live on beyond their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def scratch(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors.

    rows: a bound of the number of rows, if it is known; a table is not written to more files than one per FILE_ROWS of
    them, so that small ones do not become a file for every shuffle partition. Unlike Dataset.checkpoint() it runs the
    plan once and is stored compressed and by column.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lodestone-{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        (df if rows is None else df.coalesce(1 + rows // FILE_ROWS)).write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_scratch(spark: SparkSession) -> int:
    """Delete the tables that scratch() wrote in this process; only for use when no result that reads them is needed."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text):
    """Array of the words of a string column; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def quoted(name: str) -> Column:
    """A column by its name, whatever characters that holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(df: DataFrame) -> Column:
    """All columns of a row as one struct, so that no column added beside it can clash with them."""
    return F.struct(*map(quoted, df.columns))


def join_counted(big: DataFrame, small: DataFrame, keys: list[str], n: str = "n", how: str = "inner") -> DataFrame:
    """big joined with small on keys, without one key filling a task. how: inner or left.

    small has one row per key and in column n the number of big's rows with that key, which the result does not have.
    Both sides are read several times, so they should be written tables. Keys with more rows than a quarter of an even
    share of the shuffle partitions are joined by broadcast: there are at most four times as many as there are
    partitions, whatever the data. The rest is joined by shuffle.
    """
    spark = big.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total, most = small.agg(F.sum(n), F.max(n)).first()
    share = max(16, (total or 0) // (4 * partitions))
    if (most or 0) <= share:
        return big.join(small.drop(n), keys, how)
    hot, cold = small.where(F.col(n) > share).drop(n), small.where(F.col(n) <= share).drop(n)
    many = big.join(F.broadcast(hot), keys)
    rest = big.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, how)
    return many.unionByName(rest)
