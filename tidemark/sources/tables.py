"""Series made from the relational test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import unix_seconds
from ..operators.reshape import binned, row_numbers
from ..operators.scans import numbered
from ..operators.selection import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_label() -> F.Column:
    return F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "signup", -1).otherwise(0)


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One irregular series a user: ``series_id, row_idx, timestamp, channel, value, label, event_type, event_id``."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("series_id"), unix_seconds("ts").alias("timestamp"), "event_id", "event_type", "value", event_label().alias("label"), F.lit(0).alias("channel"))
    return row_numbers(dealt(events, ("series_id",)), "series_id", "timestamp", "event_id")


def hourly_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly means and counts by event type: ``series_id`` (0), ``channel`` (0-4 by type name), ``bin, value, n``."""
    kinds = ["click", "error", "purchase", "signup", "view"]
    channel = F.array_position(F.array(*map(F.lit, kinds)), F.col("event_type")).cast("int") - 1
    events = table(spark, sf_dir, "events").select(channel.alias("channel"), binned(unix_seconds("ts"), 3600.0).alias("bin"), "value")
    return events.groupBy(F.lit(0).alias("series_id"), "channel", "bin").agg(F.avg("value").alias("value"), F.count("*").alias("n"))


def embedding_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as a row of 64 channels: ``series_id`` (its label), ``row_idx`` (its id), ``channel, value``."""
    wide = table(spark, sf_dir, "embeddings")
    return wide.select(F.col("label").alias("series_id"), F.col("vec_id").alias("row_idx"), F.posexplode("embedding").alias("channel", "v")).select("series_id", "row_idx", "channel", F.col("v").cast("double").alias("value"))


def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily quantity of line items by return flag: ``series_id, row_idx, timestamp, channel, value, label``."""
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("series_id"), binned(unix_seconds("l_shipdate"), 86400.0).alias("timestamp")).agg(F.sum("l_quantity").alias("value"), F.count("*").alias("n"))
    days = row_numbers(items, "series_id", "timestamp").withColumn("channel", F.lit(0))
    return days.withColumn("label", F.when(F.col("n") % 7 == 0, 1).when(F.col("n") % 5 == 0, -1).otherwise(0))


def one_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as a single series in order of time: ``series_id`` (0), ``row_idx, timestamp, channel, value, label, event_id``."""
    events = table(spark, sf_dir, "events").select(F.lit(0).alias("series_id"), "ts", "event_id", unix_seconds("ts").alias("timestamp"), F.lit(0).alias("channel"), "value", event_label().alias("label"))
    return numbered(events, ("series_id",), ["ts", "event_id"]).drop("ts")
