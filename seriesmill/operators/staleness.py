"""Stale markers and default timestamps of scraped batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_timestamps(ts: Column, default: Column, honor: bool) -> Column:
    """A sample's time on the scrape path: its own if it is honoured and there is one, else the batch's."""
    return F.coalesce(ts, default) if honor else default


def tracked(scrapes: DataFrame, track_timestamps: bool) -> DataFrame:
    """The rows of scrapes(..., explicit) whose going stale is tracked: series with times of their own only on request."""
    return scrapes if track_timestamps else scrapes.where(~F.col("explicit"))


def stale_markers(scrapes: DataFrame) -> DataFrame:
    """(target, scrape_ts, ls_key): series that were in the target's previous scrape and are not in this one.

    scrapes(target, scrape_ts, ls_key). Each gets one marker, at the time of the scrape that lacks it. The
    number of the scrape within its target comes from the small table of distinct scrapes, so the fact is
    only joined, never ordered.
    """
    seen = scrapes.select("target", "scrape_ts", "ls_key").distinct()
    ticks = seen.select("target", "scrape_ts").distinct()
    following = ticks.withColumn("next_ts", F.lead("scrape_ts").over(Window.partitionBy("target").orderBy("scrape_ts"))).where("next_ts is not null")
    due = seen.join(following, ["target", "scrape_ts"]).select("target", F.col("next_ts").alias("scrape_ts"), "ls_key")
    return due.join(seen, ["target", "scrape_ts", "ls_key"], "left_anti")


def final_markers(scrapes: DataFrame, at: Column) -> DataFrame:
    """Markers for every series of each target's last scrape, when the target goes away."""
    last = scrapes.groupBy("target").agg(F.max("scrape_ts").alias("scrape_ts"))
    return scrapes.join(last, ["target", "scrape_ts"]).select("target", at.alias("scrape_ts"), "ls_key").distinct()


def as_samples(markers: DataFrame) -> DataFrame:
    """Markers as samples: NaN with a flag, since the bits of a NaN are not kept."""
    return markers.select("ls_key", F.col("scrape_ts").alias("ts_ms"), F.lit(float("nan")).alias("value"), F.lit(True).alias("is_stale"))
