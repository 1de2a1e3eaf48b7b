"""Selection of series and samples, names and values of labels, and unions of heads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .matchers import Matcher, all_of


def match_series(series: DataFrame, matchers: list[Matcher], need_positive: bool = True) -> DataFrame:
    return series.where(all_of(matchers, F.col("labels"), F.col("metric_name"), need_positive))


def select(series: DataFrame, samples: DataFrame, matchers: list[Matcher], mint: int, maxt: int) -> DataFrame:
    """(series_id, ls_key, ts_ms, value) of matching series with mint <= ts_ms <= maxt.

    The time range is a plain predicate on the fact and reaches its scan. Matched series are joined on
    series_id; the planner broadcasts them only if its size estimates allow. A series without a sample
    in the range is absent.
    """
    found = match_series(series, matchers).select("series_id", "ls_key")
    inside = samples.where(F.col("ts_ms").between(mint, maxt))
    return inside.join(found, "series_id").select("series_id", "ls_key", "ts_ms", "value")


def ordered(selected: DataFrame) -> DataFrame:
    """In order of label set and time, the order in which a reader iterates."""
    return selected.orderBy("ls_key", "ts_ms")


def latest_wins(samples: DataFrame, order: str) -> DataFrame:
    """One sample for each series and time: of several, the one of greatest order."""
    return samples.groupBy("series_id", "ts_ms").agg(F.max_by("value", order).alias("value"))


def seek(samples: DataFrame, t: int) -> DataFrame:
    """(series_id, ts_ms, value): each series' first sample at t or later."""
    later = samples.where(F.col("ts_ms") >= t)
    return later.groupBy("series_id").agg(F.min(F.struct("ts_ms", "value")).alias("s")).select("series_id", "s.ts_ms", "s.value")


def label_names(series: DataFrame, matchers: list[Matcher] | None = None) -> DataFrame:
    """Distinct names in order; without matchers, of all series. Time plays no part."""
    found = match_series(series, matchers, need_positive=False) if matchers else series
    return found.select(F.explode(F.map_keys("labels")).alias("name")).distinct().orderBy("name")


def label_values(series: DataFrame, name: str, matchers: list[Matcher] | None = None) -> DataFrame:
    found = match_series(series, matchers, need_positive=False) if matchers else series
    return found.select(F.try_element_at("labels", F.lit(name)).alias("value")).where("value is not null").distinct().orderBy("value")


def label_pairs(series: DataFrame) -> DataFrame:
    return series.select("series_id", "ls_key", F.explode("labels").alias("name", "value"))


def postings(series: DataFrame, key: str = "series_id") -> DataFrame:
    """The inverted index: (name, value, ids), ids in order. A list is as long as its pair is common."""
    return series.select(F.col(key).alias("id"), F.explode("labels").alias("name", "value")).groupBy("name", "value").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def symbols(series: DataFrame) -> DataFrame:
    return series.select(F.explode(F.concat(F.map_keys("labels"), F.map_values("labels"))).alias("symbol")).distinct()


def label_indices(series: DataFrame) -> DataFrame:
    """(name, place, value): the values of each name in order, a row each, so no list grows with a name's values."""
    values = label_pairs(series).select("name", "value").distinct()
    return values.select("name", (F.row_number().over(Window.partitionBy("name").orderBy("value")) - 1).alias("place"), "value")


def union_heads(heads: list[DataFrame]) -> DataFrame:
    """(ls_key, ts_ms, value) of several heads; at the same label set and time the first head's sample stays."""
    tagged = [h.select("ls_key", "ts_ms", "value").withColumn("head", F.lit(k)) for k, h in enumerate(heads)]
    all_heads = reduce(DataFrame.unionByName, tagged)
    return all_heads.groupBy("ls_key", "ts_ms").agg(F.min_by("value", "head").alias("value"))


def distinct_strings(frames: list[DataFrame]) -> DataFrame:
    """Names or values of several heads, once each, in order."""
    both = reduce(DataFrame.union, frames)
    return both.distinct().orderBy(*both.columns)


def chunked(samples: DataFrame, size: int = 240) -> DataFrame:
    """With the number of the chunk of `size` consecutive samples that each falls in."""
    place = F.row_number().over(Window.partitionBy("series_id").orderBy("ts_ms"))
    return samples.withColumn("chunk", F.floor((place - 1) / size).cast("long"))
