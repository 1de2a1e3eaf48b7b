"""Limits of incoming batches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    """Zero is no limit."""

    name_length: int = 4096
    value_length: int = 65536
    labels: int = 320
    series: int = 0
    samples: int = 0


def _over(size: Column, most: int) -> Column:
    return size > most if most else F.lit(False)


def violations(labels: Column, limits: Limits) -> Column:
    """The first limit that a series breaks, or null."""
    long_name = F.exists(F.map_keys(labels), lambda k: _over(F.octet_length(k), limits.name_length))
    long_value = F.exists(F.map_values(labels), lambda v: _over(F.octet_length(v), limits.value_length))
    return F.when(long_name, "label name length").when(long_value, "label value length").when(_over(F.size(labels), limits.labels), "labels per series")


def check(batches: DataFrame, limits: Limits) -> DataFrame:
    """(batch_id, series, error) of batches(batch_id, labels[, samples]): a batch with any violation is rejected as a whole.

    samples is the number of a series' samples, 1 where there is no such column.
    """
    samples = F.sum("samples") if "samples" in batches.columns else F.count("*")
    got = batches.withColumn("why", violations(F.col("labels"), limits)).groupBy("batch_id").agg(F.count("*").alias("series"), samples.alias("all_samples"), F.min("why").alias("why"))
    counts = F.when(_over(F.col("series"), limits.series), "series per batch").when(_over(F.col("all_samples"), limits.samples), "samples per batch")
    return got.select("batch_id", "series", F.coalesce("why", counts).alias("error"))


def accepted(batches: DataFrame, limits: Limits) -> DataFrame:
    bad = check(batches, limits).where("error is not null").select("batch_id")
    return batches.join(bad, "batch_id", "left_anti")
