"""Keyed screens over streams: an extension, the screens themselves are batch queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.numbers import terminal_digit
from quillon.session import scratch_path, table


def digit_windows(events: DataFrame, every: str = "1 day", late: str | None = None) -> DataFrame:
    """(start, event_type, n, zero_or_five) per window of event time; works on streams and on tables.

    ``late`` is how long late rows are waited for; a stream without it keeps all windows' state. Rows without a time are left out.
    """
    rows = events.where("ts is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    if late:
        rows = rows.withWatermark("ts", late)
    digit = terminal_digit(F.col("value").cast("decimal(18,2)").cast("string"))
    g = rows.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.count_if(digit.isin("0", "5")).alias("zero_or_five"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "zero_or_five")


def distinct_events(events: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """Each key once, as far as its repeats come within ``late``."""
    return events.where("ts is not null").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def run_to_end(stream: DataFrame, label: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that is there now and returns the last state (complete) or all rows (append) from the shared folder."""
    spark = stream.sparkSession
    out, at = scratch_path(spark, label), scratch_path(spark, f"{label}-state")

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def st_digit_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(shape).parquet(f"{sf_dir}/events.parque[t]")
    return run_to_end(digit_windows(stream), "digit-windows").withColumn("start", F.date_format("start", "yyyy-MM-dd"))
