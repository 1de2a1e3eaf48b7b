"""Cardinality reports over a head's series and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top(counts: DataFrame, limit: int, *names: str) -> DataFrame:
    """The `limit` greatest by n, ties by name: one partial top-k in each task, merged once."""
    return counts.orderBy(F.desc("n"), *names).limit(limit)


def pairs(series: DataFrame) -> DataFrame:
    return series.select("series_id", F.explode("labels").alias("name", "value"))


def values_by_label(series: DataFrame, limit: int = 10) -> DataFrame:
    """(name, n): distinct values of each label."""
    return top(pairs(series).groupBy("name").agg(F.countDistinct("value").alias("n")), limit, "name")


def series_by_metric(series: DataFrame, limit: int = 10) -> DataFrame:
    return top(series.groupBy(F.col("metric_name").alias("name")).agg(F.count("*").alias("n")), limit, "name")


def bytes_by_label(series: DataFrame, limit: int = 10) -> DataFrame:
    """(name, n): bytes of a label's values, counted in every series that holds it."""
    return top(pairs(series).groupBy("name").agg(F.sum(F.octet_length("value")).cast("long").alias("n")), limit, "name")


def series_by_pair(series: DataFrame, limit: int = 10) -> DataFrame:
    return top(pairs(series).groupBy("name", "value").agg(F.count("*").alias("n")), limit, "name", "value")


def time_interval(samples: DataFrame) -> DataFrame:
    return samples.agg(F.min("ts_ms").alias("min_ts"), F.max("ts_ms").alias("max_ts"))


def totals(series: DataFrame, samples: DataFrame, chunk: int = 240) -> DataFrame:
    """(num_series, num_label_pairs, chunk_count, min_ts, max_ts), one row of aggregates that are each partial first."""
    n = series.agg(F.count("*").alias("num_series"))
    p = pairs(series).select("name", "value").distinct().agg(F.count("*").alias("num_label_pairs"))
    per = samples.groupBy("series_id").agg(F.count("*").alias("n"), F.min("ts_ms").alias("low"), F.max("ts_ms").alias("high"))
    c = per.agg(F.coalesce(F.sum(F.ceil(F.col("n") / chunk)), F.lit(0)).cast("long").alias("chunk_count"), F.min("low").alias("min_ts"), F.max("high").alias("max_ts"))
    return n.join(p, F.lit(True)).join(c, F.lit(True))  # single rows


def queried_series(log: DataFrame) -> DataFrame:
    """(source, n): distinct series that queries of each source have touched, from log(source, series_id)."""
    return log.groupBy("source").agg(F.countDistinct("series_id").alias("n"))


def segment_stats(samples: DataFrame) -> DataFrame:
    """(samples, series, earliest, latest) of a batch."""
    per = samples.groupBy("series_id").agg(F.count("*").alias("n"), F.min("ts_ms").alias("low"), F.max("ts_ms").alias("high"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("samples"), F.count("*").alias("series"), F.min("low").alias("earliest"), F.max("high").alias("latest"))
