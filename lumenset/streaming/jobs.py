"""Incremental indexing and job progress with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SAMPLES = 24


def eta(samples: DataFrame, total: float) -> DataFrame:
    """Seconds left at each sample, from the rate over the last 24 samples of the job; null without progress."""
    last = W.partitionBy("job_id").orderBy("t", "event_id").rowsBetween(-(SAMPLES - 1), 0)
    rows = samples.withColumns({"d0": F.first("done").over(last), "t0": F.first("t").over(last)})
    rate = (F.col("done") - F.col("d0")) / (F.col("t") - F.col("t0"))
    left = F.when((F.col("t") > F.col("t0")) & (F.col("done") > F.col("d0")), (F.lit(float(total)) - F.col("done")) / rate)
    return rows.select("job_id", "event_id", left.alias("eta"), F.least(F.lit(100.0), F.bround(100 * F.col("done") / F.lit(float(total)))).cast("long").alias("pct"))


def index_new(spark: SparkSession, source: str, schema, target: str, checkpoint: str, step) -> None:
    """Runs ``step`` over the files of ``source`` that earlier runs did not see, and appends to ``target``, once each.

    Every micro-batch has its own folder, written over if it is run again, so a lost driver repeats no row.
    """

    def write(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(write)
    stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their values by time window and type; works on tables and, with a watermark, on streams."""
    own = events.withColumn("ts", F.col("ts").cast("timestamp"))
    own = own.withWatermark("ts", late) if events.isStreaming else own
    out = own.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "value")
