"""The write-ahead log, output relabeling, sending, refilling and persisting over the events and orders bridges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labelset as ls
from ..functions.labelset import canonical, get
from ..operators import blocks, catalog, delivery, relabel, select, staleness, wal
from ..operators.relabel import Destination, Rule
from ..sources import bridge, frames, remote_write, text
from ..sources.limits import Limits, check
from ..sources.scratch import folder
from ..streaming import stateful
from .registry import AS_KEY, EVENTS, PAIRS, SERIES, query

DAY = 86_400_000
START = 1_704_067_200_000


def _rows(spark: SparkSession, d: str) -> DataFrame:
    """Events as rows of a head's log: 4 shards, a segment for each of 30 days."""
    ts = bridge.millis("ts")
    e = bridge.table(spark, d, "events").where(ts.between(START, START + 30 * DAY - 1))
    return e.select(F.lit("h").alias("head"), (F.col("user_id") % 4).cast("int").alias("shard"), F.floor((ts - START) / DAY).cast("long").alias("segment"), bridge.event_labels().alias("labels"), ts.alias("ts_ms"), "value").withColumn("ls_key", canonical(F.col("labels")))


ROWS = f"{EVENTS}, rows AS (SELECT (user_id % 4)::INTEGER AS shard, (ts_ms - {START}) // {DAY} AS segment, ls_key, ts_ms, value, event_type, user_id FROM ev WHERE ts_ms BETWEEN {START} AND {START + 30 * DAY - 1})"


def _log(spark: SparkSession, d: str, broken: bool = True) -> DataFrame:
    """The log of these rows, numbered without gaps; shard 1 is damaged from segment 12 on, shard 2 lacks segment 20."""
    log = wal.encode_segments(_rows(spark, d))
    if not broken:
        return log
    bad = (F.col("shard") == 1) & (F.col("segment") == 12)
    return log.where("not (shard = 2 and segment = 20)").withColumn("crc", F.when(bad, F.col("crc") + 1).otherwise(F.col("crc")))


def _stored(spark: SparkSession, log: DataFrame) -> DataFrame:
    """A log written as Parquet and read again, for queries that look at it more than once."""
    path = folder(spark, "log")
    log.write.parquet(path)
    return spark.read.schema(log.schema).parquet(path)


#: How far each shard can be replayed.
VALID = "valid AS (SELECT shard, CASE shard WHEN 1 THEN 12 WHEN 2 THEN 20 ELSE (SELECT max(segment) + 1 FROM rows r WHERE r.shard = s.shard) END AS segments, shard IN (1, 2) AS corrupted FROM (SELECT DISTINCT shard FROM rows) s)"


@query(f"WITH {ROWS} SELECT shard, segment, count(*) AS samples, count(*) >= 80 AS exhausted FROM rows GROUP BY shard, segment")
def wal_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments written as Parquet and read again, with the limit of their size."""
    path = folder(spark, "wal")
    _log(spark, d, broken=False).write.partitionBy("head", "shard").parquet(path)
    log = spark.read.parquet(path)
    return log.join(wal.limit_exhausted(log, 80), ["head", "shard", "segment"]).select("shard", "segment", "samples", "exhausted")


@query(f"WITH {ROWS} SELECT shard, segment, ls_key, ts_ms, value FROM rows WHERE shard <> 1 OR segment <> 12")
def wal_decode(spark: SparkSession, d: str) -> DataFrame:
    return wal.decode_segments(_log(spark, d, broken=False).withColumn("crc", F.when(F.expr("shard = 1 and segment = 12"), F.col("crc") + 1).otherwise(F.col("crc")))).select("shard", "segment", "ls_key", "ts_ms", "value")


@query(f"WITH {ROWS}, {VALID} SELECT shard, segments::BIGINT AS segments, corrupted FROM valid")
def wal_replay_report(spark: SparkSession, d: str) -> DataFrame:
    return wal.load_head(_log(spark, d)).report.drop("head")


@query(f"WITH {ROWS}, {VALID} SELECT event_type AS metric_name, rows.ls_key, ts_ms, value FROM rows JOIN valid USING (shard) WHERE segment < segments")
def wal_load_head(spark: SparkSession, d: str) -> DataFrame:
    head = wal.load_head(_stored(spark, _log(spark, d)))
    return head.samples.join(head.series, "series_id").select("metric_name", "ls_key", "ts_ms", "value")


@query(f"WITH {ROWS} SELECT shard, ls_key, ts_ms, value FROM rows WHERE segment = 15 AND shard <> 1 AND ts_ms >= {START + 15 * DAY + DAY // 2}")
def wal_read_segment(spark: SparkSession, d: str) -> DataFrame:
    """One segment of every shard; a damaged shard is skipped."""
    return wal.read_segment(_stored(spark, _log(spark, d)), 15, START + 15 * DAY + DAY // 2).select("shard", "ls_key", "ts_ms", "value")


@query(f"WITH {ROWS}, {VALID}, n AS (SELECT unnest([5, 15, 25, 40]) AS n), last AS (SELECT shard, max(segment) AS last FROM rows GROUP BY shard) SELECT n, shard, CASE WHEN segments > n THEN 'ok' WHEN corrupted THEN 'corrupted' ELSE 'wait' END AS state FROM n, valid")
def wal_shard_states(spark: SparkSession, d: str) -> DataFrame:
    log = _stored(spark, _log(spark, d))
    out = [wal.shard_states(log, n).select(F.lit(n).alias("n"), "shard", "state") for n in (5, 15, 25, 40)]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("SELECT c_custkey % 50 AS head, bool_and(c_nationkey % 3 <> 0) AS ended FROM customer GROUP BY 1")
def wal_end_of_block(spark: SparkSession, d: str) -> DataFrame:
    states = bridge.table(spark, d, "customer").select((F.col("c_custkey") % 50).alias("head"), F.when(F.col("c_nationkey") % 3 == 0, "ok").otherwise("corrupted").alias("state"))
    return wal.end_of_block(states)


@query(f"WITH {ROWS} SELECT shard, segment, count(*) + 2 AS samples, max(greatest(ts_ms, 7)) AS max_ts, sum(CASE WHEN value > 0 THEN 1 ELSE 0 END)::BIGINT + 2 AS positive FROM rows GROUP BY shard, segment")
def wal_inject(spark: SparkSession, d: str) -> DataFrame:
    """Two series of the caller's in each segment."""
    rows = wal.inject(_rows(spark, d), [({"__name__": "sender_up"}, 1.0), ({"__name__": "sender_lag", "unit": "s"}, 2.5)], 7)
    return rows.groupBy("shard", "segment").agg(F.count("*").alias("samples"), F.max("ts_ms").alias("max_ts"), F.count_if(F.col("value") > 0).alias("positive"))


@query("WITH s AS (SELECT o_orderkey % 16 AS shard, o_orderkey // 16 AS segment, o_custkey % 211 <> 0 AS ok FROM orders), f AS (SELECT shard, coalesce(min(segment) FILTER (NOT ok) - 1, max(segment)) AS flushed FROM s GROUP BY shard) SELECT shard, flushed, (SELECT min(flushed) FROM f) AS notified FROM f")
def flush_status(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    done = wal.flushed(bridge.table(spark, d, "orders").select((k % 16).alias("shard"), F.floor(k / 16).cast("long").alias("segment"), (F.col("o_custkey") % 211 != 0).alias("ok")))
    return done.join(wal.notified(done).select(F.col("segment").alias("notified")), F.lit(True))


@query(f"WITH {ROWS}, turns AS (SELECT unnest([{START + 5 * DAY + 1234}, {START + 11 * DAY + 77}]) AS at_ms), x AS (SELECT *, CASE WHEN shard < 2 THEN (SELECT max(at_ms) FROM turns WHERE at_ms <= ts_ms) END AS since FROM rows) SELECT shard, ls_key, ts_ms, since, (ts_ms - coalesce(since, 0)) // 5000 AS tick FROM x")
def commit_ticks(spark: SparkSession, d: str) -> DataFrame:
    turns = spark.createDataFrame([(s, START + at) for s in (0, 1) for at in (5 * DAY + 1234, 11 * DAY + 77)], "shard int, at_ms long")
    return wal.commit_ticks(_rows(spark, d).select("shard", "ls_key", "ts_ms"), 5000, turns)


@query("WITH c AS (SELECT c_custkey % 97 AS dest, max(c_name) AS config FROM customer GROUP BY 1) SELECT dest, CASE WHEN dest % 3 = 0 THEN 'state' END AS state FROM c")
def decoder_states(spark: SparkSession, d: str) -> DataFrame:
    """A reader's state is only used under the configuration that it was stored with."""
    configs = bridge.table(spark, d, "customer").groupBy((F.col("c_custkey") % 97).alias("dest")).agg(F.max("c_name").alias("config"))
    stored = configs.where("dest % 3 < 2").select("dest", F.crc32(F.when(F.col("dest") % 3 == 0, F.col("config")).otherwise("older").cast("binary")).alias("config_crc"), F.lit("state").alias("state"))
    return wal.usable_states(stored, configs)


# Output


DESTINATIONS = [
    Destination("plain", rules=(Rule(("job",), regex="job0", action="drop"),)),
    Destination("west", (("region", "west"), ("job", "never")), (Rule(("region", "instance"), separator="/", target_label="place"), Rule(regex="user", action="labeldrop"))),
    Destination("all"),
]
WEST = f"SELECT ls_key AS old_key, name, value FROM pairs WHERE name <> 'user' UNION ALL SELECT ls_key, unnest(['region', 'place']), unnest(['west', 'west/i' || (user_id % 10)]) FROM series"


@query(f"WITH {SERIES}, {PAIRS} SELECT 'plain' AS dest, ls_key AS old_key, ls_key FROM series WHERE user_id % 3 <> 0 UNION ALL SELECT 'west', old_key, {AS_KEY} FROM ({WEST}) GROUP BY old_key UNION ALL SELECT 'all', ls_key, ls_key FROM series")
def output_relabel(spark: SparkSession, d: str) -> DataFrame:
    series = bridge.event_series(spark, d)
    return relabel.output_relabel(series, DESTINATIONS).join(series.select("series_id", F.col("ls_key").alias("old_key")), "series_id").select("dest", "old_key", "ls_key")


CACHED = [Rule(("job",), regex="job0", action="drop"), Rule(("instance",), regex="i(.)", replacement="$1", target_label="n")]


@query(f"WITH {SERIES}, {PAIRS}, m AS (SELECT old_key, {AS_KEY} AS target_key FROM (SELECT ls_key AS old_key, name, value FROM pairs UNION ALL SELECT ls_key, 'n', (user_id % 10)::VARCHAR FROM series) GROUP BY old_key) SELECT ls_key, CASE WHEN user_id % 3 <> 0 THEN target_key END AS target_key, user_id % 2 = 1 AS fresh FROM series JOIN m ON old_key = ls_key")
def relabel_cache(spark: SparkSession, d: str) -> DataFrame:
    """The mapping of series of which half are in a stored one."""
    series = bridge.event_series(spark, d)
    path = folder(spark, "cache")
    relabel.mapping(series.where("cast(labels['user'] as long) % 2 = 0"), CACHED).write.parquet(path)
    mapped, fresh = relabel.cached_mapping(series, spark.read.parquet(path), CACHED)
    return mapped.join(fresh.select("ls_key", F.lit(True).alias("fresh")), "ls_key", "left").select("ls_key", "target_key", F.coalesce("fresh", F.lit(False)).alias("fresh"))


@query(f"WITH {EVENTS}, x AS (SELECT replace(ls_key, ';job:', ';job:') AS k, user_id, ts_ms, value FROM ev WHERE user_id % 3 <> 0), y AS (SELECT replace(k, ';user:', ';n:' || (user_id % 10) || ';user:') AS ls_key, ts_ms, value FROM x) SELECT (('0x' || substr(md5(ls_key), 17, 16))::UBIGINT % 8)::INTEGER AS shard, ls_key, ts_ms, value FROM y")
def input_relabel(spark: SparkSession, d: str) -> DataFrame:
    """Samples under target labels, on the shard of their target series."""
    series = bridge.event_series(spark, d)
    samples = bridge.table(spark, d, "events").select(canonical(bridge.event_labels()).alias("ls_key"), bridge.millis("ts").alias("ts_ms"), "value")
    return relabel.input_relabel(samples, relabel.mapping(series, CACHED), 8).drop("labels")


def _sent(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d).select((F.col("segment") % 5).alias("batch"), "labels", "ls_key", "ts_ms", "value")
    return delivery.encode_shards(rows, 3)


@query(f"WITH {ROWS}, s AS (SELECT *, segment % 5 AS batch, (('0x' || substr(md5(ls_key), 17, 16))::UBIGINT % 3)::INTEGER AS shard2 FROM rows) SELECT batch, shard2 AS shard, count(*) AS samples, count(DISTINCT ls_key) AS series, max(ts_ms) AS max_ts FROM s GROUP BY 1, 2")
def remote_write_encode(spark: SparkSession, d: str) -> DataFrame:
    return _sent(spark, d).drop("body")


@query(f"WITH {ROWS} SELECT segment % 5 AS batch, (('0x' || substr(md5(ls_key), 17, 16))::UBIGINT % 3)::INTEGER AS shard, ls_key, ts_ms, value FROM rows")
def remote_write_bodies(spark: SparkSession, d: str) -> DataFrame:
    """The bodies that output shards send, read again."""
    sent = delivery.worth_sending(_sent(spark, d)).select(F.struct("batch", "shard").alias("payload_id"), "body")
    return remote_write.samples_of(remote_write.decode_chunks(sent)).select("payload_id.*", canonical(F.col("labels")).alias("ls_key"), "ts_ms", "value")


@query(f"WITH {ROWS}, s AS (SELECT segment % 5 AS batch, (('0x' || substr(md5(ls_key), 17, 16))::UBIGINT % 3)::INTEGER AS shard, max(ts_ms) AS max_ts FROM rows WHERE user_id < 40 GROUP BY 1, 2) SELECT batch, shard FROM s WHERE max_ts >= {START + 29 * DAY}")
def obsolete_messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages that became too old while they waited are not sent."""
    rows = _rows(spark, d).where("cast(labels['user'] as long) < 40").select((F.col("segment") % 5).alias("batch"), "labels", "ls_key", "ts_ms", "value")
    return delivery.worth_sending(delivery.encode_shards(rows, 3), START + 29 * DAY).select("batch", "shard")


SEGMENTS = "s AS (SELECT 'd' || (o_orderkey % 4) AS dest, o_orderkey // 4 AS segment, 1 + o_orderkey % 4 AS shards, o_custkey % 40 AS samples, (o_orderkey // 4) * (1 + o_orderkey % 4) * 100 AS read_ms FROM orders WHERE o_orderkey < 2400)"


@query(f"""WITH RECURSIVE {SEGMENTS}, o AS (SELECT *, row_number() OVER (PARTITION BY dest ORDER BY segment) AS k FROM s),
f AS (SELECT dest, k, segment, 0 AS batch, read_ms AS first, samples AS held, samples > shards * 50 AS closes FROM o WHERE k = 1
 UNION ALL SELECT o.dest, o.k, o.segment, f.batch + f.closes::INTEGER, CASE WHEN f.closes THEN o.read_ms ELSE f.first END, CASE WHEN f.closes THEN 0 ELSE f.held END + o.samples,
 CASE WHEN f.closes THEN 0 ELSE f.held END + o.samples > o.shards * 50 OR o.read_ms - CASE WHEN f.closes THEN o.read_ms ELSE f.first END >= 1000 FROM f JOIN o ON o.dest = f.dest AND o.k = f.k + 1)
SELECT dest, segment, batch::BIGINT AS batch FROM f""")
def send_batches(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    n = F.floor(k / 4).cast("long")
    rows = bridge.table(spark, d, "orders").where("o_orderkey < 2400").select(F.concat(F.lit("d"), (k % 4).cast("string")).alias("dest"), n.alias("segment"), (1 + k % 4).alias("shards"), (F.col("o_custkey") % 40).alias("samples"), (n * (1 + k % 4) * 100).alias("read_ms"))
    return delivery.send_batches(rows, 50, 1000).select("dest", "segment", "batch")


RESPONSES = "r AS (SELECT 'd' || (o_custkey % 3) AS dest, o_orderkey % 4 AS shard, o_orderkey // 4 AS segment, o_orderstatus <> 'P' AS ok FROM orders)"


def _responses(spark: SparkSession, d: str) -> DataFrame:
    return bridge.table(spark, d, "orders").select(F.concat(F.lit("d"), (F.col("o_custkey") % 3).cast("string")).alias("dest"), (F.col("o_orderkey") % 4).alias("shard"), F.floor(F.col("o_orderkey") / 4).cast("long").alias("segment"), (F.col("o_orderstatus") != "P").alias("ok"))


@query(f"WITH {RESPONSES}, held AS (SELECT DISTINCT dest, shard, 1000000 AS s FROM r WHERE shard = 3 AND dest = 'd1' UNION ALL SELECT DISTINCT dest, shard, NULL FROM r WHERE shard = 2) SELECT dest, shard, max(s)::BIGINT AS last_segment FROM (SELECT dest, shard, segment AS s FROM r WHERE ok UNION ALL SELECT * FROM held) GROUP BY 1, 2")
def ack_responses(spark: SparkSession, d: str) -> DataFrame:
    r = _responses(spark, d)
    held = r.where("shard = 3 and dest = 'd1'").select("dest", "shard", F.lit(1_000_000).cast("long").alias("last_segment")).union(r.where("shard = 2").select("dest", "shard", F.lit(None).cast("long"))).distinct()
    return delivery.apply_responses(held, r)[0]


@query(f"WITH {RESPONSES} SELECT dest, shard, segment FROM (SELECT DISTINCT dest, shard, segment FROM r WHERE NOT ok)")
def rejects_in_order(spark: SparkSession, d: str) -> DataFrame:
    r = _responses(spark, d)
    return delivery.rejects_in_order(delivery.apply_responses(r.select("dest", "shard", F.lit(0).cast("long").alias("last_segment")), r)[1])


@query("""WITH e AS (SELECT o_orderkey % 512 AS shard, o_orderkey // 512 AS segment, o_orderstatus, o_custkey % 97 = 0 AS rejected, epoch_us(o_orderdate) // 1000 AS put_ms FROM orders), f AS (SELECT shard, min(segment) AS first FROM e WHERE rejected GROUP BY shard)
SELECT shard, segment, CASE WHEN o_orderstatus = 'F' THEN 'acked' WHEN segment >= first THEN 'rejected' WHEN put_ms + 1000 < 800000000000 THEN 'expired' ELSE 'waiting' END AS state FROM e LEFT JOIN f USING (shard)""")
def exchange_state(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    base = bridge.table(spark, d, "orders").select((k % 512).alias("shard"), F.floor(k / 512).cast("long").alias("segment"), bridge.millis("o_orderdate").alias("at_ms"), "o_orderstatus", (F.col("o_custkey") % 97 == 0).alias("bad"))
    kinds = F.filter(F.array(F.lit("put"), F.when(F.col("o_orderstatus") == "F", "ack"), F.when(F.col("bad"), "reject")), lambda x: x.isNotNull())
    return delivery.exchange_state(base.select("shard", "segment", "at_ms", F.explode(kinds).alias("kind")), 800_000_000_000, 1000)


@query(f"WITH {ROWS} SELECT shard, segment, ls_key, ts_ms, value FROM rows WHERE (shard * 7 + segment) % 5 = 0 AND segment % 2 = 0")
def refill_table(spark: SparkSession, d: str) -> DataFrame:
    """Undelivered segments written to the refill table, looked up there by their keys, and decoded."""
    log, path = _stored(spark, _log(spark, d, broken=False)), folder(spark, "refill")
    keys = log.select("head", "shard", "segment")
    delivery.write_refill(keys.where("(shard * 7 + segment) % 5 = 0"), log, path)
    delivery.write_refill(keys.where("segment = 10"), log, path)
    wanted = keys.where("(shard * 7 + segment) % 5 = 0 and segment % 2 = 0")
    return wal.decode_segments(delivery.read_refill(spark, path, wanted)).select("shard", "segment", "ls_key", "ts_ms", "value")


def _received(spark: SparkSession, d: str) -> DataFrame:
    """Frames of a log as a receiver gets them, in pieces of a day; those of shard 3 arrive damaged."""
    sent = frames.encode_frames(_log(spark, d, broken=False))
    damaged = F.concat(F.expr("substring(frame, 1, length(frame) - 1)"), F.unhex(F.lit("00")))
    sent = sent.withColumn("frame", F.when(F.expr("shard = 3 and hex(substring(frame, -1, 1)) <> '00'"), damaged).otherwise(F.col("frame")))
    return frames.decode_frames(sent.groupBy(F.col("segment").alias("source")).agg(F.expr("listagg(frame) WITHIN GROUP (ORDER BY shard)").alias("bytes")))


@query(f"WITH {ROWS} SELECT shard, segment, ls_key, ts_ms, value FROM rows WHERE shard < 3")
def frames_received(spark: SparkSession, d: str) -> DataFrame:
    """Segments that arrived whole, decoded."""
    return wal.decode_segments(frames.received_segments(_received(spark, d)).where("shard < 3")).select("shard", "segment", "ls_key", "ts_ms", "value")


@query(f"WITH {ROWS} SELECT shard, max(segment) AS last_segment FROM rows WHERE shard < 3 GROUP BY shard")
def frames_acknowledged(spark: SparkSession, d: str) -> DataFrame:
    """What the sender knows after the receiver's answers."""
    answers = frames.responses(_received(spark, d).where("shard < 3"), "d")
    none = spark.createDataFrame([], "dest string, shard int, last_segment long")
    return delivery.apply_responses(none, answers)[0].select("shard", "last_segment")


# Catalogue and blocks


def _heads(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey")
    kinds = F.array(*map(F.lit, ("new", "rotated", "persisted", "active")))
    return bridge.table(spark, d, "customer").select(c.alias("id"), (c * 10).alias("created_at"), F.get(kinds, (c % 4).cast("int")).alias("status"), F.when(c % 9 == 0, 1).otherwise(0).cast("long").alias("deleted_at"), F.lit(False).alias("corrupted"), (c * 997 % 5000).alias("max_ts"), F.when(c % 3 == 0, c % 100).alias("tried_ms"), F.when(c % 4 == 2, c * 3 % 5000).alias("persisted_ms"))


HEADS = "heads AS (SELECT c_custkey AS id, c_custkey * 10 AS created_at, ['new', 'rotated', 'persisted', 'active'][c_custkey % 4 + 1] AS status, c_custkey % 9 = 0 AS deleted, c_custkey * 997 % 5000 AS max_ts, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 100 END AS tried, CASE WHEN c_custkey % 4 = 2 THEN c_custkey * 3 % 5000 END AS persisted FROM customer)"


@query(f"WITH {HEADS} SELECT id, CASE WHEN status = 'persisted' THEN CASE WHEN 5000 - persisted > 3000 THEN 'shrink' ELSE 'wait' END WHEN 5000 - max_ts > 3000 THEN 'discard' WHEN 5000 - tried < 4950 THEN 'wait' ELSE 'write' END AS action FROM heads WHERE status IN ('rotated', 'persisted')")
def persist_plan(spark: SparkSession, d: str) -> DataFrame:
    return catalog.persist_plan(_heads(spark, d), 5000, 3000, 4950)


@query(f"WITH {EVENTS}, {HEADS}, due AS (SELECT id FROM heads WHERE status = 'rotated' AND 5000 - max_ts <= 3000 AND NOT coalesce(5000 - tried < 4950, false)) SELECT user_id, ts_ms, value, ts_ms // {DAY} * {DAY} AS block_start FROM ev WHERE user_id IN (SELECT id FROM due)")
def persisted_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Heads that the plan says to write, as blocks on disk."""
    path = folder(spark, "persisted")
    samples = bridge.table(spark, d, "events").select(F.col("user_id").alias("head"), F.col("user_id").alias("series_id"), bridge.millis("ts").alias("ts_ms"), "value")
    blocks.persist(samples, catalog.persist_plan(_heads(spark, d), 5000, 3000, 4950), path, DAY)
    return spark.read.schema("series_id long, ts_ms long, value double, block_start long").parquet(path).select(F.col("series_id").alias("user_id"), "ts_ms", "value", "block_start")


@query(f"WITH {HEADS} SELECT id, status FROM heads WHERE NOT deleted AND status <> 'persisted' AND max_ts > 1000")
def catalog_listed(spark: SparkSession, d: str) -> DataFrame:
    return catalog.listed(_heads(spark, d), "status <> 'persisted' and max_ts > 1000", ["created_at"]).select("id", "status")


@query(f"WITH {HEADS} SELECT id, created_at FROM heads WHERE NOT deleted AND id >= 100 AND id >= 100")
def catalog_chain(spark: SparkSession, d: str) -> DataFrame:
    return catalog.chain_from(_heads(spark, d), 100)


@query("""WITH log AS (SELECT o_orderkey % 300 AS id, o_orderkey AS seq, epoch_us(o_orderdate) // 1000 AS updated_at, CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END AS deleted_at, ['new', 'rotated', 'corrupted', 'persisted', 'active'][o_custkey % 5 + 1] AS status FROM orders)
SELECT id, seq, updated_at, CASE WHEN status = 'corrupted' THEN 'rotated' ELSE status END AS status, status = 'corrupted' AS corrupted FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, seq DESC) AS k FROM log) WHERE k = 1 AND deleted_at = 0""")
def catalog_compacted(spark: SparkSession, d: str) -> DataFrame:
    """A log that was appended to twice, compacted."""
    k = F.col("o_orderkey")
    status = F.get(F.array(*map(F.lit, catalog.STATUSES)), (F.col("o_custkey") % 5).cast("int"))
    log = bridge.table(spark, d, "orders").select((k % 300).alias("id"), k.alias("seq"), bridge.millis("o_orderdate").alias("updated_at"), F.when(k % 17 == 0, 1).otherwise(0).cast("long").alias("deleted_at"), F.lit(False).alias("corrupted"), status.alias("status"))
    path = folder(spark, "catalog")
    catalog.append(log.where("seq % 2 = 0"), path)
    catalog.append(log.where("seq % 2 = 1"), path)
    return catalog.compact(spark.read.parquet(path)).drop("deleted_at")


@query(f"WITH {HEADS} SELECT id, 5000 - max_ts > 3000 AS outdated FROM heads")
def outdated_heads(spark: SparkSession, d: str) -> DataFrame:
    return _heads(spark, d).select("id", blocks.outdated(5000, F.col("max_ts"), 3000).alias("outdated"))


@query(f"WITH {SERIES}, {PAIRS}, v AS (SELECT DISTINCT name, value FROM pairs) SELECT name, (row_number() OVER (PARTITION BY name ORDER BY value) - 1)::INTEGER AS place, value FROM v")
def label_indices(spark: SparkSession, d: str) -> DataFrame:
    return select.label_indices(bridge.event_series(spark, d))


@query(f"WITH {EVENTS}, h AS (SELECT ls_key, ts_ms // {DAY} AS t, value, event_id FROM ev) SELECT ls_key, t AS ts_ms, first(value ORDER BY event_id DESC) AS value FROM h GROUP BY ls_key, t")
def out_of_order_merge(spark: SparkSession, d: str) -> DataFrame:
    """Of samples at one time the last one that arrived stays."""
    rows = bridge.table(spark, d, "events").select(bridge.event_id().alias("series_id"), canonical(bridge.event_labels()).alias("ls_key"), F.floor(bridge.millis("ts") / DAY).cast("long").alias("ts_ms"), "value", "event_id")
    merged = select.latest_wins(rows, "event_id")
    return merged.join(bridge.event_series(spark, d).select("series_id", "ls_key"), "series_id").select("ls_key", "ts_ms", "value")


# Ingestion


@query("""SELECT event_id AS payload_id, event_type AS metric, user_id::VARCHAR AS user, value, CASE WHEN event_id % 3 = 0 THEN NULL ELSE epoch_us(ts) // 1000 END AS ts_ms FROM events WHERE event_id % 50 <> 7""")
def open_metrics_parse(spark: SparkSession, d: str) -> DataFrame:
    """Seconds, exemplars, units and lines after the end mark."""
    e = bridge.table(spark, d, "events")
    ms = bridge.millis("ts")
    seconds = F.concat((ms / 1000).cast("long").cast("string"), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))
    stamp = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit(" "), seconds))
    exemplar = F.when(F.col("event_id") % 4 == 0, F.lit(' # {trace="x y",n="1"} 5 1.5')).otherwise("")
    line = F.concat("event_type", F.lit('{user="'), F.col("user_id").cast("string"), F.lit('"} '), F.col("value").cast("string"), stamp, exemplar)
    body = F.when(F.col("event_id") % 50 == 7, F.array(F.lit("# EOF"), line)).otherwise(F.array(F.concat(F.lit("# UNIT "), F.col("event_type"), F.lit(" seconds")), line, F.lit("# EOF"), F.lit("after 1")))
    rows = e.select(F.col("event_id").alias("payload_id"), F.array_join(body, "\n").alias("body"))
    got = text.accepted(text.parse_samples(text.lines_of(rows), open_metrics=True))
    return got.select("payload_id", get(F.col("labels"), "__name__").alias("metric"), get(F.col("labels"), "user").alias("user"), "value", "ts_ms")


@query(f"WITH {EVENTS} SELECT event_id % 100 AS payload_id, ls_key, ts_ms, value FROM ev")
def struct_samples(spark: SparkSession, d: str) -> DataFrame:
    """Batches of structs, as requests, as rows."""
    pairs = F.transform(ls.sorted_entries(bridge.event_labels()), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")))
    rows = bridge.table(spark, d, "events").select((F.col("event_id") % 100).alias("payload_id"), pairs.alias("labels"), bridge.millis("ts").alias("ts_ms"), "value")
    return remote_write.samples_of(remote_write.requests_of_structs(rows)).select("payload_id", canonical(F.col("labels")).alias("ls_key"), "ts_ms", "value")


@query(f"WITH {SERIES}, n AS (SELECT user_id % 10 AS batch_id, count(*) AS series, sum(user_id % 4) AS samples FROM series GROUP BY 1) SELECT batch_id, series, CASE WHEN samples > 90 THEN 'samples per batch' END AS error FROM n")
def sample_limit(spark: SparkSession, d: str) -> DataFrame:
    user = F.col("labels")["user"].cast("long")
    return check(bridge.event_series(spark, d).select((user % 10).alias("batch_id"), "labels", (user % 4).alias("samples")), Limits(samples=90))


@query(f"""WITH {EVENTS}, s AS (SELECT DISTINCT event_type AS target, ts_ms // {DAY} * {DAY} AS scrape_ts, ls_key FROM ev WHERE user_id % 4 <> 0), t AS (SELECT DISTINCT target, scrape_ts FROM s), n AS (SELECT target, scrape_ts, lead(scrape_ts) OVER (PARTITION BY target ORDER BY scrape_ts) AS next_ts FROM t)
SELECT target, next_ts AS scrape_ts, ls_key FROM s JOIN n USING (target, scrape_ts) WHERE next_ts IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s z WHERE z.target = s.target AND z.scrape_ts = next_ts AND z.ls_key = s.ls_key)""")
def stale_tracked(spark: SparkSession, d: str) -> DataFrame:
    """Series with times of their own (a quarter) are exempt."""
    e = bridge.table(spark, d, "events").select(F.col("event_type").alias("target"), (F.floor(bridge.millis("ts") / DAY) * DAY).cast("long").alias("scrape_ts"), canonical(bridge.event_labels()).alias("ls_key"), (F.col("user_id") % 4 == 0).alias("explicit"))
    return staleness.stale_markers(staleness.tracked(e, False))


@query(f"WITH {SERIES}, {PAIRS} SELECT ls_key, name || '=' || value AS pair FROM pairs")
def labelset_yaml_read(spark: SparkSession, d: str) -> DataFrame:
    series = bridge.event_series(spark, d)
    back = series.select("ls_key", F.explode(ls.from_yaml(ls.to_yaml(F.col("labels")))).alias("name", "value"))
    return back.select("ls_key", F.concat_ws("=", "name", "value").alias("pair"))


@query(f"WITH {ROWS} SELECT shard, segment, ls_key, ts_ms, value FROM rows WHERE segment < 12")
def stream_segments(spark: SparkSession, d: str) -> DataFrame:
    """A log that grows, read as a stream of segments; what was read is not read again after a restart."""
    path, out, mark = folder(spark, "log"), folder(spark, "read"), folder(spark, "mark")
    for low, high in ((0, 4), (4, 8), (8, 12)):
        wal.encode_segments(_rows(spark, d).where(F.col("segment").between(low, high - 1))).write.mode("append").parquet(path)
        query = stateful.read_log(spark, path).writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(out).select("shard", "segment", "ls_key", "ts_ms", "value")
