"""Tables that streams keep up to date: one row for each key, in buckets of files that are replaced bucket by bucket.

A batch reads and writes the buckets that its keys fall into, and no others. What it wrote becomes the table's by one
small file, put in its place at the end; it names the version of each bucket, and the batch. So a batch that is run
again, after a stream was killed, finds itself done and changes nothing, and readers never see half of one.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: How many versions of the table stay readable.
VERSIONS = 2


class Snapshot:
    """The table at ``path``. ``schema`` and ``key`` are those of its rows; ``buckets`` never changes.

    ``merge`` makes one row of each key out of rows old and new, which have a column ``_new`` beside their own. One writer
    at a time. Of buckets, choose so many that one's files are worth rewriting for a few rows; the list of them is all
    that the driver holds.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], merge: Callable[[DataFrame], DataFrame], buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.merge, self.buckets = spark, path.rstrip("/"), schema, key, merge, buckets
        self._jvm = spark._jvm
        self._fs = self._path(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _commits(self) -> list[int]:
        folder = self._path(f"{self.path}/commits")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n) for n in names if n.isdigit())

    def _versions(self, commit: int | None = None) -> tuple[int, dict[int, int]]:
        """The last batch, and by which batch each bucket was written last."""
        commits = self._commits()
        if not commits:
            return -1, {}
        n = commits[-1] if commit is None else commit
        stream = self._fs.open(self._path(f"{self.path}/commits/{n}"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return n, {int(b): v for b, v in json.loads(text).items()}

    def _commit(self, n: int, versions: dict[int, int]) -> None:
        draft, final = self._path(f"{self.path}/commits/.{n}"), self._path(f"{self.path}/commits/{n}")
        out = self._fs.create(draft, True)
        try:
            out.write(bytearray(json.dumps(versions).encode()))
        finally:
            out.close()
        if not self._fs.rename(draft, final):
            raise OSError(f"batch {n} could not be committed at {self.path}")

    def _rows(self, versions: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/rows/batch={v}/bucket={b}" for b, v in versions.items()]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """The table after the last batch."""
        return self._rows(self._versions()[1])

    def put(self, batch: DataFrame, n: int) -> None:
        """Merge batch number ``n`` into the table, unless that was done before."""
        last, versions = self._versions()
        if n <= last:
            return
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
        own = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self._rows({}).schema]
        new = batch.select(*own, F.lit(True).alias("_new"))
        touched = [r["bucket"] for r in new.select(bucket.alias("bucket")).distinct().collect()]
        old = self._rows({b: versions[b] for b in touched if b in versions}).select(*own, F.lit(False).alias("_new"))
        merged = self.merge(old.unionByName(new)).select(*own, bucket.alias("bucket"))
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/batch={n}")
        # A merge may leave a bucket without rows; it then has no folder.
        left = [b for b in touched if self._fs.exists(self._path(f"{self.path}/rows/batch={n}/bucket={b}"))]
        self._commit(n, {b: v for b, v in versions.items() if b not in touched} | dict.fromkeys(left, n))
        self._forget()

    def _forget(self) -> None:
        """Delete what none of the last versions reads."""
        commits = self._commits()
        kept = {(b, v) for c in commits[-VERSIONS:] for b, v in self._versions(c)[1].items()}
        for c in commits[:-VERSIONS]:
            for b, v in self._versions(c)[1].items():
                if (b, v) not in kept:
                    self._fs.delete(self._path(f"{self.path}/rows/batch={v}/bucket={b}"), True)
            self._fs.delete(self._path(f"{self.path}/commits/{c}"), True)


def last_by(key: list[str], seq: str, keep: tuple[str, ...] = ()) -> Callable[[DataFrame], DataFrame]:
    """The merge of an upsert: the last row of each key by ``seq``, newer batches before older ones; ``keep`` holds the columns of which what came first stays."""

    def merge(rows: DataFrame) -> DataFrame:
        w = Window.partitionBy(*key)
        for c in keep:
            rows = rows.withColumn(c, F.first(c).over(w.orderBy("_new", seq).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        return rows.withColumn("_nth", F.row_number().over(w.orderBy(F.col(seq).desc(), F.col("_new").desc()))).filter("_nth = 1")

    return merge


def summed(key: list[str], **sums: Column | str) -> Callable[[DataFrame], DataFrame]:
    """The merge of totals: the sum of each column over a key's old row and its new ones."""
    return lambda rows: rows.groupBy(*key).agg(*[F.sum(c).alias(n) for n, c in sums.items()])


def upserted(stream: DataFrame, table: Snapshot, progress: str) -> StreamingQuery:
    """Start a stream into ``table``, over all that is there; progress is kept at ``progress``."""
    return stream.writeStream.foreachBatch(table.put).option("checkpointLocation", progress).trigger(availableNow=True).start()


class Arrivals(Snapshot):
    """A table of things that come once: the first row of each key stays, and each batch says which of its rows were there before."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], seq: str, buckets: int = 64):
        def first(rows: DataFrame) -> DataFrame:
            nth = F.row_number().over(Window.partitionBy(*key).orderBy("_new", seq))
            return rows.withColumn("_nth", nth).filter("_nth = 1")

        super().__init__(spark, path, schema, key, first, buckets)
        self.seq = seq

    def put(self, batch: DataFrame, n: int) -> None:
        last, versions = self._versions()
        if n <= last:
            return
        # Before the table changes: told again from the same table if the batch is run again.
        nth = F.row_number().over(Window.partitionBy(*self.key).orderBy(self.seq))
        new = batch.select(*[f.name for f in self._rows({}).schema]).withColumn("_nth", nth)
        known = self._rows(versions).select(*[F.col(c).alias(f"_{c}") for c in self.key], F.lit(True).alias("_known"))
        same = F.lit(True)
        for c in self.key:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        told = new.join(known, same, "left").select(*self.key, self.seq, (F.coalesce("_known", F.lit(False)) | (F.col("_nth") > 1)).alias("existed"))
        told.write.mode("overwrite").parquet(f"{self.path}/told/batch={n}")
        super().put(batch, n)

    def told(self) -> DataFrame:
        """Of every row of every batch, by key and ``seq``, whether its key was there before."""
        return self.spark.read.parquet(f"{self.path}/told")
