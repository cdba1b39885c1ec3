"""Helpers that the corpus operators share: tables in the shared folder, and Python code on executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ledgerloom.session import ship


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a local one only where that setting is missing and all runs on this machine (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.gettempdir() + "/ledgerloom-checkpoints"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/ledgerloom-{uuid.uuid4().hex}"


def _folder(spark: SparkSession, path: str):
    """The folder and its file system, as the driver's JVM has them."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again.

    Later stages then start from files that survive a lost executor, and nothing above is run twice. The files go when the
    driver ends, as a result may be read until then; ``discard`` deletes them before.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.option("compression", "zstd").parquet(path)
    folder, files = _folder(spark, path)
    files.deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of ``written`` tables from which nothing is read any more."""
    for table in tables:
        for path in {f.rpartition("/")[0] for f in table.inputFiles()}:
            folder, files = _folder(table.sparkSession, path)
            files.delete(folder, True)


def for_python(spark: SparkSession) -> None:
    """Before Python code runs on executors: send it there. Spark bounds the bytes of the batches that it gets."""
    ship(spark)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in parts of ``rows`` rows at most, so that few texts at a time become Python objects."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def partitions(spark: SparkSession) -> int:
    """The number of partitions that the session's shuffles are dealt to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
