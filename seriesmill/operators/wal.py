"""The write-ahead log of a head as a table: encoding, commits, replay, and reading segment by segment.

segments(head, shard, segment, samples, crc, payload): a row for each segment of a shard, numbered from 0. A
payload is a remote-write body; open-head batching bounds it, so a row is small however long the log is. Parquet
keeps the rows; the checksum tells a damaged payload from a whole one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labelset import canonical
from ..sources.remote_write import bodies_of, decode_chunks, samples_of

KEY = ("head", "shard", "segment")


def encode_segments(rows: DataFrame) -> DataFrame:
    """segments of rows(head, shard, segment, labels, ls_key, ts_ms, value); stale markers are rows like others."""
    return bodies_of(rows, [*KEY]).select(*KEY, "samples", F.crc32("body").alias("crc"), F.col("body").alias("payload"))


def damaged() -> Column:
    return F.col("payload").isNull() | (F.crc32("payload") != F.col("crc"))


def limit_exhausted(segments: DataFrame, most: int) -> DataFrame:
    """(head, shard, segment, exhausted): whether a segment is so full that it must be committed; 0 is no limit."""
    return segments.select(*KEY, ((F.col("samples") >= most) if most else F.lit(False)).alias("exhausted"))


def commit_ticks(rows: DataFrame, interval_ms: int, rotations: DataFrame | None = None) -> DataFrame:
    """rows(shard, ts_ms, ...) with `tick`: which commit, every interval from the last rotation(shard, at_ms) on, writes them; the first is 0.

    Rotations of a shard are few, so they are a list beside its rows.
    """
    if rotations is None:
        return rows.withColumns({"since": F.lit(None).cast("long"), "tick": F.floor(F.col("ts_ms") / interval_ms)})
    lists = rotations.groupBy("shard").agg(F.array_sort(F.collect_set("at_ms")).alias("at"))
    since = F.array_max(F.filter("at", lambda a: a <= F.col("ts_ms")))
    return rows.join(lists, "shard", "left").withColumn("since", since).withColumn("tick", F.floor((F.col("ts_ms") - F.coalesce("since", F.lit(0))) / interval_ms)).drop("at")


def flushed(statuses: DataFrame) -> DataFrame:
    """(shard, flushed): the last segment up to which all were written, of statuses(shard, segment, ok); -1 if the first one wasn't.

    Segments are flushed in order: one that failed holds back those after it.
    """
    bad = F.min(F.when(~F.col("ok"), F.col("segment")))
    return statuses.groupBy("shard").agg(F.coalesce(bad - 1, F.max("segment")).alias("flushed"))


def notified(shards: DataFrame) -> DataFrame:
    """(segment): what readers may rely on, the least segment that is flushed on every shard."""
    return shards.agg(F.min("flushed").alias("segment"))


def decode_segments(segments: DataFrame) -> DataFrame:
    """(head, shard, segment, labels, ls_key, ts_ms, value) of whole segments; damaged ones give nothing."""
    whole = segments.where(~damaged()).select(F.struct(*KEY).alias("payload_id"), F.col("payload").alias("body"))
    rows = samples_of(decode_chunks(whole))
    return rows.select("payload_id.*", "labels", canonical(F.col("labels")).alias("ls_key"), "ts_ms", "value")


def valid_lengths(segments: DataFrame) -> DataFrame:
    """(head, shard, segments, corrupted): how many segments of each shard can be replayed, and whether one after them can't.

    Replay ends at the first segment that is damaged or missing.
    """
    place = F.row_number().over(Window.partitionBy("head", "shard").orderBy("segment")) - 1
    checked = segments.select(*KEY, damaged().alias("bad"))  # payloads end here, before rows are dealt by shard
    marked = checked.withColumn("place", place).withColumn("bad", F.col("bad") | (F.col("place") != F.col("segment")))
    good = F.min(F.when(F.col("bad"), F.col("place")))
    return marked.groupBy("head", "shard").agg(F.coalesce(good, F.count("*")).cast("long").alias("segments"), good.isNotNull().alias("corrupted"))


def replayable(segments: DataFrame) -> DataFrame:
    """The segments of each shard before the first that is damaged or missing; shards are few, so their lengths are a small side."""
    lengths = valid_lengths(segments).select("head", "shard", F.col("segments").alias("length"))
    return segments.join(lengths, ["head", "shard"]).where("segment < length").drop("length")


@dataclass(frozen=True)
class Head:
    """series(series_id, metric_name, labels, ls_key), samples(series_id, ts_ms, value) and a report by shard."""

    series: DataFrame
    samples: DataFrame
    report: DataFrame


def load_head(segments: DataFrame) -> Head:
    """A head rebuilt from its log. Series ids are hashes of label sets, so shards load on their own."""
    rows = decode_segments(replayable(segments)).withColumn("series_id", F.xxhash64("ls_key"))
    series = rows.groupBy("series_id", "ls_key").agg(F.first("labels").alias("labels"))
    series = series.select("series_id", F.coalesce(F.try_element_at("labels", F.lit("__name__")), F.lit("")).alias("metric_name"), "labels", "ls_key")
    return Head(series, rows.select("series_id", "ts_ms", "value"), valid_lengths(segments))


def shard_states(segments: DataFrame, n: int) -> DataFrame:
    """(head, shard, state) of reading segment n: ok, corrupted (it or one before it is damaged) or wait (it is not there yet)."""
    got = valid_lengths(segments)
    last = segments.groupBy("head", "shard").agg(F.max("segment").alias("last"))
    state = F.when(F.col("segments") > n, "ok").when(F.col("corrupted") & (F.col("last") >= F.col("segments")), "corrupted").otherwise("wait")
    return got.join(last, ["head", "shard"]).select("head", "shard", state.alias("state"))


def end_of_block(states: DataFrame) -> DataFrame:
    """(head, ended): a bad shard is skipped; if all are bad, the head ends."""
    return states.groupBy("head").agg(F.bool_and(F.col("state") == "corrupted").alias("ended"))


def read_segment(segments: DataFrame, n: int, lower: int | None = None) -> DataFrame:
    """Samples of segment n of every shard that can be read that far, without those before `lower`."""
    ok = shard_states(segments.where(F.col("segment") <= n), n).where("state = 'ok'").select("head", "shard")
    rows = decode_segments(segments.where(F.col("segment") == n).join(ok, ["head", "shard"]))
    return rows if lower is None else rows.where(F.col("ts_ms") >= lower)


def inject(rows: DataFrame, extra: list[tuple[dict[str, str], float]], ts_ms: int) -> DataFrame:
    """rows(head, shard, segment, labels, ls_key, ts_ms, value) with the caller's own series added to each segment, at one time."""
    added = F.array(*(F.struct(F.create_map(*(F.lit(x) for kv in sorted(labels.items()) for x in kv)).alias("labels"), F.lit(float(value)).alias("value")) for labels, value in extra))
    keys = rows.select(*KEY).distinct().select(*KEY, F.explode(added).alias("e")).select(*KEY, "e.labels", canonical(F.col("e.labels")).alias("ls_key"), F.lit(ts_ms).cast("long").alias("ts_ms"), "e.value")
    return rows.unionByName(keys)


def usable_states(states: DataFrame, configs: DataFrame) -> DataFrame:
    """(dest, state): a reader's stored state(dest, config_crc, state), null where it was stored under another config(dest, config)."""
    own = states.join(configs.select("dest", F.crc32(F.col("config").cast("binary")).alias("now")), "dest", "right")
    return own.select("dest", F.when(F.col("config_crc") == F.col("now"), F.col("state")).alias("state"))
