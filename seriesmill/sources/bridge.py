"""Series and samples of the test tables.

series(series_id, metric_name, labels, ls_key) is a small dimension; samples(series_id, ts_ms, value) is
the fact, whose series_id is computed from its own row, so that no shuffle is needed to get it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labelset import canonical


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(ts: Column | str) -> Column:
    """Milliseconds of a zone-less timestamp since 1970, cut off."""
    return F.timestamp_diff("MILLISECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts)


def event_labels() -> Column:
    user = F.col("user_id")
    return F.create_map(
        F.lit("__name__"), F.col("event_type"),
        F.lit("user"), user.cast("string"),
        F.lit("instance"), F.concat(F.lit("i"), (user % 10).cast("string")),
        F.lit("job"), F.concat(F.lit("job"), (user % 3).cast("string")),
        F.lit("cluster"), F.concat(F.lit("c"), (user % 2).cast("string")),
    )


def event_id() -> Column:
    return F.xxhash64("event_type", "user_id")


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "events").select("event_type", "user_id").distinct()
    return keys.select(event_id().alias("series_id"), F.col("event_type").alias("metric_name"), event_labels().alias("labels")).withColumn("ls_key", canonical(F.col("labels")))


def event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(event_id().alias("series_id"), millis("ts").alias("ts_ms"), "value")


def line_labels() -> Column:
    supplier = F.col("l_suppkey")
    return F.create_map(F.lit("__name__"), F.lit("line_price"), F.lit("flag"), F.col("l_returnflag"), F.lit("status"), F.col("l_linestatus"), F.lit("supplier"), supplier.cast("string"), F.lit("shard"), (supplier % 16).cast("string"))


def line_id() -> Column:
    return F.xxhash64("l_returnflag", "l_linestatus", "l_suppkey")


def line_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_suppkey").distinct()
    return keys.select(line_id().alias("series_id"), F.lit("line_price").alias("metric_name"), line_labels().alias("labels")).withColumn("ls_key", canonical(F.col("labels")))


def line_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(line_id().alias("series_id"), millis("l_shipdate").alias("ts_ms"), F.col("l_extendedprice").alias("value"))
