"""Shared helpers: tables, the shared work folder, words and label folds."""

from __future__ import annotations

import ctypes
import gc
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space characters.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[str]:
    """Words of a text; null and blank texts have none."""
    return WORD.findall(text) if text else []


def ascii_lower(text: str) -> str:
    """Lower-cases A-Z and nothing else."""
    return text.translate(_ASCII_LOWER) if not text.isascii() else text.lower()


#: Rows and bytes of whole texts that a Python worker gets at once.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of whole texts small, however long the texts are; smaller settings stay."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        size = re.fullmatch(r"(\d+)([kmg]?)b?", spark.conf.get(f"spark.sql.execution.arrow.{key}").strip().lower())
        number = int(size[1]) << 10 * " kmg".index(size[2] or " ") if size else 0
        if not 0 < number <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


#: Bytes of input for each part that a shuffle deals to.
PART_BYTES = 64 << 20


def parts_for(rows: DataFrame, least: int) -> int:
    """Parts for a shuffle of rows: at least as many as the session's, and one for each PART_BYTES that they are read from."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    own = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, own, size // PART_BYTES if size < 1 << 60 else 0)  # sources of unknown size report the largest number


def dealt(rows: DataFrame, parts: int, column: str = "part") -> DataFrame:
    """rows by part number, each part in a partition of its own: numbers are exchanged for keys that hash to different
    partitions."""
    tried = 20 * parts + 1000
    spots = rows.sparkSession.range(tried).select(F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts)).alias("spot"), F.col("id").cast("int").alias("id")).groupBy("spot").agg(F.min("id").alias("id"))
    keys = [r["id"] for r in spots.collect()]
    if len(keys) < parts:
        return rows.repartition(parts, column)
    return rows.repartition(parts, F.element_at(F.array(*[F.lit(k) for k in keys]), F.col(column) + 1))


def release_memory() -> None:
    """Hands memory that Python has freed back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, after which a Python worker that waits for its next task holds little memory."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        release_memory()

    return whole


def fold(doc_id: Column | str) -> Column:
    """crc32 of doc_id as text, mod 5; null ids have fold null."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(5)).cast("int")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where it is unset, one below the warehouse."""
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        known = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(conf).deleteOnExit(hpath)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(conf).delete(hpath, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written to the shared folder and read back: lost executors cost no more than their tasks."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes stored tables that nothing reads any more."""
    for df in tables:
        remove_path(df.sparkSession, df.stored_at)
