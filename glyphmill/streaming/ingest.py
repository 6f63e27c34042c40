"""Resumable ingest: a file stream drained to a checkpoint, its results kept as a state table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def drain(spark: SparkSession, source: str, fmt: str, schema: str, transform, sink: str, checkpoint: str) -> None:
    """Process every new file of ``source`` once and append to the Parquet table ``sink``; a second call continues after the first."""
    stream = spark.readStream.schema(schema).format(fmt).load(source)
    transform(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(sink).awaitTermination()


def attempts(events: DataFrame) -> DataFrame:
    """(id, at, status, error) of ingest attempts: events of type 'error' have failed."""
    failed = F.col("event_type") == "error"
    return events.select(F.col("event_id").alias("id"), F.col("ts").alias("at"), F.when(failed, "failed").otherwise("done").alias("status"), F.when(failed, F.col("props")).alias("error"))


def state(log: DataFrame) -> DataFrame:
    """(id, status, error): one row per id: done if any attempt was, else the latest failure."""
    last = F.max_by("error", "at")
    return log.groupBy("id").agg(F.when(F.count_if(F.col("status") == "done") > 0, "done").otherwise("failed").alias("status"), F.when(F.count_if(F.col("status") == "done") == 0, last).alias("error"))


def pending(docs: DataFrame, st: DataFrame, key: str = "id") -> DataFrame:
    """Documents not done yet; failed ones are tried again."""
    return docs.join(st.filter("status = 'done'").select(key), key, "left_anti")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n) per time window; works on streams and tables."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
