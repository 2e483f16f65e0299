"""Incremental import of batch files, and windows over event streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Parts of a table by the hash of its keys; a batch reads the parts that its own keys fall in.
PARTS = 256


def follow(spark: SparkSession, inbox: str, schema: str, checkpoint: str, publish: Callable[[DataFrame, int], None], fmt: str = "json", options: dict[str, str] | None = None) -> StreamingQuery:
    """Hands every new file of the inbox to publish once, in micro-batches, and ends; the checkpoint remembers them.

    options are those of the file source, such as cleanSource to move files that are done.
    """
    stream = spark.readStream.schema(schema).options(**(options or {})).format(fmt).load(inbox)
    return stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def publish_new(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """Appends the rows whose keys the table at path doesn't hold, so a batch that comes again adds nothing.

    The table is partitioned by a hash of the keys (_part); of the parts that a batch touches only the files and row groups
    are read whose first keys lie between the batch's least and greatest, so one that comes in the order of its keys reads
    little however many it has.
    """

    def publish(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        batch = batch.dropDuplicates(keys).withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(PARTS)).cast("int"))
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            span = batch.agg(F.collect_set("_part").alias("parts"), F.min(keys[0]).alias("low"), F.max(keys[0]).alias("high")).first()
            held = spark.read.schema(batch.schema).parquet(path).filter(F.col("_part").isin(*span["parts"]))
            if span["low"] is not None and batch.filter(F.col(keys[0]).isNull()).isEmpty():
                held = held.filter(F.col(keys[0]).between(span["low"], span["high"]))
            batch = batch.join(held.select("_part", *keys), ["_part", *keys], "left_anti")
        batch = batch.sortWithinPartitions("_part", *keys)
        batch.write.mode("append").partitionBy("_part").parquet(path)

    return publish


def windowed_counts(events: DataFrame, time: str, key: str, width: str, late: str | None = None) -> DataFrame:
    """Counts per window and key; late is the watermark of a stream."""
    events = events.withWatermark(time, late) if late else events
    return events.groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")
