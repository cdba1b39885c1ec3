"""The ledger's rules as structured streams, on event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import scratch


def messages_once(messages: DataFrame, key: str = "wa_message_id", time: str = "received_at", late: str = "1 day") -> DataFrame:
    """Each message once: redeliveries within the watermark are dropped."""
    return messages.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def daily_totals(payments: DataFrame, time: str = "ts", amount: str = "amount", late: str = "2 days") -> DataFrame:
    """Count and sum of each day and kind."""
    days = payments.withWatermark(time, late).groupBy(F.window(time, "1 day"), "kind")
    return days.agg(F.count("*").alias("cnt"), F.sum(amount).cast("double").alias("total")).select(F.col("window.start").alias("day"), "kind", "cnt", "total")


def forwarded(messages: DataFrame, rules: DataFrame) -> DataFrame:
    """A stream of messages against the static rules: one synthetic message for each target but the own group."""
    pairs = messages.join(rules, "source").filter("target_jid <> grp")
    return pairs.select(F.concat_ws("-fwd-", "wa_message_id", F.split_part("target_jid", F.lit("@"), F.lit(1))).alias("wa_message_id"), F.col("target_jid").alias("grp"))


def with_a_last_beat(stream: DataFrame, key: str) -> DataFrame:
    """``stream`` and one event long after all others, under a key of its own, as a live feed's next events are: the watermark passes all there is.

    Columns other than ts, the key and id (-1) are null.
    """
    spark = stream.sparkSession
    path = scratch(spark)
    values = {key: F.lit("beat"), "id": F.lit(-1), "ts": F.lit("2100-01-01").cast("timestamp")}
    beat = spark.range(1).select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in stream.schema])
    beat.write.parquet(path)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(path))


def with_rocks(spark: SparkSession) -> None:
    """Have the session keep streams' state in RocksDB, as state variables and timers need it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, into Parquet files in the shared folder; a batch that is run again replaces its own."""
    spark = stream.sparkSession
    path = scratch(spark)

    def land(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={n}")

    query = stream.writeStream.foreachBatch(land).outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(path)


def posted(stream: DataFrame, post: Callable[[DataFrame, int], None], path: str):
    """Start a stream that hands each batch, with its number, to ``post``, which sends it to another program; progress is kept at ``path``."""
    return stream.writeStream.foreachBatch(post).option("checkpointLocation", path).start()


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's events as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
