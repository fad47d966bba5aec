"""Decision logs as streams: the latest decision of each key, and sessions of work. An extension: batch gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from crosswalk.operators.decide import latest


def sessions(events: DataFrame, key: str, time: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each key, ended by ``gap`` without an event; events later than ``late`` are left out."""
    t = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    s = t.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return s.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def keep_latest(log: DataFrame, key: str, order: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Keeps the latest row of each key: each batch is merged with the version before into a new folder below ``path``. A batch that runs twice gives the same version."""
    schema = log.schema

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema(schema).parquet(f"{path}/v{number - 1}") if number else spark.createDataFrame([], schema)
        latest(before.unionByName(batch), key, order).write.mode("overwrite").parquet(f"{path}/v{number}")
        if number > 1:  # a batch that runs again reads the version before; older ones go
            old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/v{number - 2}")
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    return log.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
