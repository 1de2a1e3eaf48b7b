"""Forwarding: what is due, what is acknowledged, how it is batched and over how many shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.remote_write import bodies_of
from .folds import ordered_fold


#: Segments of a range that are counted out at once.
RUN = 65_536


def age_filter(samples: DataFrame, lower: int) -> DataFrame:
    return samples.where(F.col("ts_ms") >= lower)


def age_stats(samples: DataFrame, lower: int) -> DataFrame:
    """(kept, outdated, max_ts) of an age limit; max_ts of what is kept, 0 if nothing is."""
    kept = F.col("ts_ms") >= lower
    return samples.agg(F.count_if(kept).alias("kept"), F.count_if(~kept).alias("outdated"), F.coalesce(F.max(F.when(kept, F.col("ts_ms"))), F.lit(0)).cast("long").alias("max_ts"))


def clamp_shards(value: Column, least: int, most: int) -> Column:
    """The whole number of shards at or above value, within bounds."""
    if least <= 0 or least > most:
        raise ValueError(f"bad bounds of shards: {least}, {most}")
    return F.least(F.greatest(F.ceil(value), F.lit(least)), F.lit(most)).cast("int")


def desired_shards(samples: Column, per_shard: int, shards: Column, deadline_reached: Column, interval_ms: int, read_ms: Column) -> Column:
    """By what was read if the deadline came first, else by how fast it was read."""
    return F.ceil(F.when(deadline_reached, samples / per_shard * shards).otherwise(F.lit(interval_ms) / read_ms * shards)).cast("long")


def shard_power(current: Column, block_bytes: Column, elapsed_s: Column, desired_bytes: int = 64 << 20, desired_s: int = 7200, threshold: int = 10) -> Column:
    """The exponent of the number of shards of the next block.

    Up by one for each halving of the time that a full block took below half of the desired one, and
    down likewise by the size that a block reached in full time; at most by 5, and within a byte.
    """

    def steps(ratio: Column, top: float) -> Column:
        return sum((F.when(ratio <= top / 2**k, 1).otherwise(0) for k in range(5)), F.lit(0))

    up = steps(elapsed_s / desired_s, 1.0)
    down = steps(F.floor(block_bytes * (100 + threshold) / 100) / desired_bytes, 0.5)
    return F.when(block_bytes > desired_bytes, F.least(current + up, F.lit(255))).when(elapsed_s >= desired_s, F.greatest(current - down, F.lit(0))).otherwise(current).cast("int")


def pending_segments(acked: DataFrame, written: DataFrame, rejects: DataFrame, finished: DataFrame) -> DataFrame:
    """(dest, shard, segment) still to be sent: after the last acknowledged one up to the last written one, and rejected ones; not for what is finished.

    acked(dest, shard, last_segment; null: none yet), written(shard, max_segment), rejects(dest, shard, segment), finished(dest, shard).

    What is due of a shard is one range, whose runs of RUN segments are dealt to tasks and counted out there; only
    rejects are made distinct, and those within a range are in it already.
    """
    first = F.coalesce(F.col("last_segment") + 1, F.lit(0))
    done = finished.select("dest", "shard").distinct()
    ranges = acked.join(written, "shard").where(first <= F.col("max_segment")).groupBy("dest", "shard").agg(F.min(first).alias("first"), F.max("max_segment").alias("last")).join(done, ["dest", "shard"], "left_anti")
    runs = ranges.select("dest", "shard", "last", F.explode(F.sequence("first", "last", F.lit(RUN))).alias("low"))
    tasks = int(acked.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number of its own: runs are small rows, which would be put into one task
    due = runs.repartition(tasks, "dest", "shard", "low").select("dest", "shard", F.explode(F.sequence("low", F.least(F.col("low") + RUN - 1, "last"))).alias("segment"))
    others = rejects.select("dest", "shard", "segment").distinct().join(done, ["dest", "shard"], "left_anti").join(ranges, ["dest", "shard"], "left")
    within = F.coalesce(F.col("segment").between(F.col("first"), F.col("last")), F.lit(False))
    return due.unionByName(others.where(~within).select("dest", "shard", "segment"))


def ack_status(acked: DataFrame) -> DataFrame:
    """(shard, acked_by_all): the last segment that every destination has acknowledged; null if one has none."""
    has = F.count_if(F.col("last_segment").isNull()) == 0
    return acked.groupBy("shard").agg(F.when(has, F.min("last_segment")).alias("acked_by_all"))


def acked_segments(segments: DataFrame, acked: DataFrame) -> DataFrame:
    """segments(shard, segment) with `acked`: whether every destination has acknowledged it or a later one."""
    per = acked.groupBy("shard").agg(F.min(F.coalesce("last_segment", F.lit(-1))).alias("least"))
    return segments.join(per, "shard", "left").select("shard", "segment", F.coalesce(F.col("least") >= F.col("segment"), F.lit(True)).alias("acked"))


def refill_due(exchange: DataFrame, now_ms: int) -> DataFrame:
    """(shard, segment) of exchange(shard, segment, resolved, rejected, expires_ms) that go to the refill table.

    Segments that are there and were rejected or have expired; once a shard has a rejected segment, all of
    its segments go.
    """
    shards = exchange.groupBy("shard").agg(F.bool_or("rejected").alias("any_rejected"))
    due = F.col("rejected") | (F.col("expires_ms") < now_ms) | F.col("any_rejected")
    return exchange.where("resolved").join(shards, "shard").where(due).select("shard", "segment")


def segment_state(segments: DataFrame, heads: DataFrame) -> DataFrame:
    """segments(head, segment) as ready, out of range or wait, by heads(head, status, last_appended)."""
    ready = F.coalesce(F.col("last_appended") >= F.col("segment"), F.lit(False))
    state = F.when(ready, "ready").when(~F.col("status").isin("new", "active"), "out of range").otherwise("wait")
    return segments.join(heads, "head").select("head", "segment", state.alias("state"))


def promise_status(statuses: DataFrame) -> DataFrame:
    """(segment, done, delivered) of statuses(segment, shard, status: ack, refill or null): delivered only if each shard acknowledged."""
    return statuses.groupBy("segment").agg(F.bool_and(F.col("status").isNotNull()).alias("done"), F.bool_and(F.coalesce(F.col("status") == "ack", F.lit(False))).alias("delivered"))


def post_accounting(messages: DataFrame) -> DataFrame:
    """(sent, failed, retried, max_ts) of messages(samples, delivered, attempts, max_ts)."""
    return messages.agg(
        F.coalesce(F.sum(F.when(F.col("delivered"), F.col("samples"))), F.lit(0)).alias("sent"),
        F.coalesce(F.sum(F.when(~F.col("delivered"), F.col("samples"))), F.lit(0)).alias("failed"),
        F.coalesce(F.sum(F.when(F.col("attempts") > 1, F.col("samples"))), F.lit(0)).alias("retried"),
        F.max(F.when(F.col("delivered"), F.col("max_ts"))).alias("max_ts"),
    )


def encode_shards(samples: DataFrame, shards: int) -> DataFrame:
    """(batch, shard, samples, series, max_ts, body): the body that each output shard sends for each batch.

    samples(batch, labels, ls_key, ts_ms, value). A series always goes to one shard; send batching bounds a body.
    """
    return bodies_of(samples.withColumn("shard", shard_of(F.col("ls_key"), shards)), ["batch", "shard"])


def worth_sending(messages: DataFrame, lower: int | None = None) -> DataFrame:
    """messages(body, samples, max_ts): those with samples of which, while they waited, not all have become too old."""
    full = messages.where((F.col("samples") > 0) & (F.octet_length("body") > 0))
    return full if lower is None else full.where(F.col("max_ts") >= lower)


def shard_of(key: Column, shards: int) -> Column:
    return (F.conv(F.substring(F.md5(key), 17, 16), 16, 10).cast("decimal(20,0)") % shards).cast("int")


def open_head_batches(rows: DataFrame, most: int = 40_000, age_ms: int = 5_000, idle_ms: int = 300) -> DataFrame:
    """rows(row_id, shard, ts_ms) with the number of the segment that each joins, from 0 within its shard.

    A segment closes before a row that comes age_ms after its first one or idle_ms after its last one,
    and before one for which it has no room.
    """

    def step(state: tuple | None, v: tuple) -> tuple[tuple, tuple[int]]:
        ts = int(v[0])
        if state is None:
            return (0, ts, ts, 1), (0,)
        segment, first, last, n = state
        if ts - first >= age_ms or ts - last >= idle_ms or n >= most:
            return (segment + 1, ts, ts, 1), (segment + 1,)
        return (segment, first, ts, n + 1), (segment,)

    return ordered_fold(rows.select("row_id", "shard", "ts_ms"), "shard", ["ts_ms", "row_id"], lambda: None, step, ["ts_ms"], ["segment"], "row_id long, shard long, ts_ms long, segment long")


def send_batches(segments: DataFrame, per_send: int, deadline_ms: int) -> DataFrame:
    """segments(dest, segment, shards, samples, read_ms) with `batch`, from 0 within each destination.

    A batch takes segments in order until it holds more than shards x per_send samples or a segment is read
    deadline_ms after its first one; that segment is its last.
    """

    def step(state: tuple | None, v: tuple) -> tuple[tuple, tuple[int]]:
        shards, samples, at = map(int, v)
        batch, first, held = state or (0, at, 0)
        first = at if first is None else first
        held += samples
        if held > shards * per_send or at - first >= deadline_ms:
            return (batch + 1, None, 0), (batch,)
        return (batch, first, held), (batch,)

    rows = segments.select("dest", "segment", F.col("shards").cast("long").alias("shards"), F.col("samples").cast("long").alias("samples"), "read_ms")
    return ordered_fold(rows, "dest", ["segment"], lambda: None, step, ["shards", "samples", "read_ms"], ["batch"], "dest string, segment long, shards long, samples long, read_ms long, batch long")


def apply_responses(acked: DataFrame, responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(acked, rejects) after responses(dest, shard, segment, ok): an ack moves the last segment forward only."""
    moved = responses.where("ok").select("dest", "shard", F.col("segment").alias("last_segment"))
    after = acked.select("dest", "shard", "last_segment").unionByName(moved).groupBy("dest", "shard").agg(F.max("last_segment").alias("last_segment"))
    return after, responses.where("not ok").select("dest", "shard", "segment").distinct()


def rejects_in_order(rejects: DataFrame) -> DataFrame:
    return rejects.orderBy("shard", "segment")


def exchange_state(events: DataFrame, now_ms: int, ttl_ms: int) -> DataFrame:
    """(shard, segment, state) of events(shard, segment, kind: put, ack or reject, at_ms): acked, rejected, expired or waiting.

    A rejected segment rejects all later ones of its shard that are not acknowledged.
    """
    per = events.groupBy("shard", "segment").agg(F.min(F.when(F.col("kind") == "put", F.col("at_ms"))).alias("put"), F.bool_or(F.col("kind") == "ack").alias("acked"), F.bool_or(F.col("kind") == "reject").alias("rejected"))
    first = per.where("rejected").groupBy("shard").agg(F.min("segment").alias("first"))
    late = F.coalesce(F.col("segment") >= F.col("first"), F.lit(False))
    state = F.when(F.col("acked"), "acked").when(late, "rejected").when(F.col("put") + ttl_ms < now_ms, "expired").otherwise("waiting")
    return per.where("put is not null").join(first, "shard", "left").select("shard", "segment", state.alias("state"))


def write_refill(due: DataFrame, segments: DataFrame, path: str) -> None:
    """Appends due segments(head, shard, segment) with their payloads to the refill table, in files by shard."""
    rows = segments.join(due.select("head", "shard", "segment").distinct(), ["head", "shard", "segment"], "left_semi")
    rows.write.mode("append").partitionBy("head", "shard").parquet(path)


def read_refill(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """The segments of the refill table that keys(head, shard, segment) name; one that was written twice comes once."""
    table = spark.read.schema("segment long, samples long, crc long, payload binary, head string, shard int").parquet(path)
    return table.join(keys.select("head", "shard", "segment").distinct(), ["head", "shard", "segment"], "left_semi").dropDuplicates(["head", "shard", "segment"])


def config_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(dest, change) of old and new (dest, config): stop, start or restart."""
    both = old.select("dest", F.col("config").alias("was")).join(new.select("dest", F.col("config").alias("now")), "dest", "full_outer")
    change = F.when(F.col("now").isNull(), "stop").when(F.col("was").isNull(), "start").when(F.col("was") != F.col("now"), "restart")
    return both.select("dest", change.alias("change")).where("change is not null")
