"""Keyed message logs: batch reads from the first to the last offset, streams, and keyed writes.

A log is a folder of parquet files (key, value, topic, partition, offset, timestamp), with the columns of a Kafka source; with the Kafka
connector on the class path the same functions read and write topics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.shared import cut

LOG = "key string, value string, topic string, partition int, offset long, timestamp timestamp"
PARTITIONS = 6


def read_all(spark: SparkSession, path: str | None = None, topic: str | None = None, servers: str | None = None) -> DataFrame:
    """A bounded read of a whole log."""
    if servers:
        rows = spark.read.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").option("endingOffsets", "latest").load()
        return rows.withColumns({c: F.col(c).cast("string") for c in ("key", "value")})
    rows = spark.read.schema(LOG).option("recursiveFileLookup", True).parquet(path)
    return rows.where(F.col("topic") == topic) if topic else rows


def stream(spark: SparkSession, path: str | None = None, topic: str | None = None, servers: str | None = None, files_a_batch: int = 1) -> DataFrame:
    """A stream of a log, from its start; the query's checkpoint holds the offsets, so delivery is at least once."""
    if servers:
        rows = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").load()
        return rows.withColumns({c: F.col(c).cast("string") for c in ("key", "value")})
    rows = spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_a_batch).option("recursiveFileLookup", True).parquet(path)
    return rows.where(F.col("topic") == topic) if topic else rows


def records(messages: DataFrame, topic: str, now, partitions: int = PARTITIONS, first: DataFrame | None = None) -> DataFrame:
    """Log rows of messages (key, value): a key's messages stay in one partition, numbered in the order of the messages (their
    place in the input: monotonically_increasing_id, or a column `arrival` where there is one) after `first` (partition, next)."""
    arrival = F.col("arrival") if "arrival" in messages.columns else F.monotonically_increasing_id()
    rows = messages.select("key", "value", arrival.alias("arrival"), F.lit(topic).alias("topic"), F.pmod(F.xxhash64("key"), F.lit(partitions)).cast("int").alias("partition"), now.alias("timestamp"))
    order = ("arrival", "key", "value")
    # numbered by ranges of the order: a part's rows by themselves, after what the parts before it have of each partition
    parts = max(1, int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = cut(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    before = F.sum("count").over(Window.partitionBy("partition").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = rows.groupBy("part", "partition").count().select("part", "partition", F.coalesce(before, F.lit(0)).alias("before"))  # a row a part and partition
    place = F.row_number().over(Window.partitionBy("part", "partition").orderBy(*order))
    rows = rows.withColumn("offset", place.cast("long") - 1).join(F.broadcast(starts), ["part", "partition"]).withColumn("offset", F.col("offset") + F.col("before"))
    if first is not None:
        rows = rows.join(F.broadcast(first), "partition", "left").withColumn("offset", F.col("offset") + F.coalesce("next", F.lit(0))).drop("next")  # a row a partition
    return rows.select("key", "value", "topic", "partition", "offset", "timestamp")


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def append_batch(rows: DataFrame, path: str, writer: str, batch: int) -> bool:
    """Adds a batch of a writer (a query's name) once: its files are staged by Spark's committer in a folder of its own, which counts when
    it is whole; a batch that is run again after that adds nothing, one that broke off before is written over. Whether it was written.
    read_all and stream find the batches of all writers."""
    spark = rows.sparkSession
    folder = f"{path.rstrip('/')}/writer={writer}/batch={batch}"
    whole = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    if whole.getFileSystem(spark._jsc.hadoopConfiguration()).exists(whole):
        return False
    rows.select(*[x.split()[0] for x in LOG.split(", ")]).write.mode("overwrite").parquet(folder)
    return True


def produce(messages: DataFrame, path: str, topic: str, writer: str, checkpoint: str, now, partitions: int = PARTITIONS):
    """A stream of (key, value) into a log: each micro-batch is added once, numbered after what the log holds of each partition."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        exists = spark._jvm.org.apache.hadoop.fs.Path(path)
        first = None
        if exists.getFileSystem(spark._jsc.hadoopConfiguration()).exists(exists):
            first = spark.read.schema(LOG).option("recursiveFileLookup", True).parquet(path).where(F.col("topic") == topic).groupBy("partition").agg((F.max("offset") + 1).alias("next"))
        append_batch(records(batch, topic, now, partitions, first), path, writer, batch_id)

    return messages.select("key", "value").writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
