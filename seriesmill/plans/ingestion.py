"""Ingestion, blocks, staleness, delivery, catalogue and streams over the test tables."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labelset import canonical, get
from ..operators import blocks, catalog, delivery, replicas, staleness
from ..sources import bridge, remote_write, text
from ..streaming import stateful
from .registry import EVENTS, query

HOUR = 3_600_000


def _events(spark: SparkSession, d: str) -> DataFrame:
    return bridge.table(spark, d, "events").select("event_id", bridge.event_id().alias("series_id"), bridge.millis("ts").alias("ts_ms"), "event_type", "user_id", "value")


def _keyed(spark: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    """With label text, joined after aggregation."""
    return rows.join(bridge.event_series(spark, d).select("series_id", "ls_key"), "series_id").drop("series_id")


# Blocks

_DAY = 24 * HOUR


@query(f"WITH {EVENTS} SELECT (ts_ms // {blocks.TWO_HOURS}) * {blocks.TWO_HOURS} AS block_start, count(*) AS n FROM ev GROUP BY 1")
def block_windows(spark: SparkSession, d: str) -> DataFrame:
    return blocks.with_block(_events(spark, d)).groupBy("block_start").agg(F.count("*").alias("n"))


@query(f"WITH {EVENTS}, per AS (SELECT (ts_ms // {_DAY}) * {_DAY} AS block_start, ls_key, count(*) AS n, min(ts_ms) AS low, max(ts_ms) AS high FROM ev GROUP BY 1, 2) SELECT block_start, min(low) AS min_time, max(high) + 1 AS max_time, sum(n)::BIGINT AS num_samples, count(*) AS num_series, sum(ceil(n / 3.0))::BIGINT AS num_chunks FROM per GROUP BY 1")
def block_meta(spark: SparkSession, d: str) -> DataFrame:
    return blocks.block_meta(_events(spark, d), _DAY, 3)


@query(f"WITH {EVENTS}, per AS (SELECT (ts_ms // {_DAY}) * {_DAY} AS block_start, ls_key, count(*) AS n, min(ts_ms) AS low, max(ts_ms) AS high FROM ev GROUP BY 1, 2) SELECT block_start, '{{\"minTime\":' || min(low) || ',\"maxTime\":' || (max(high) + 1) || ',\"stats\":{{\"numSamples\":' || sum(n)::BIGINT || ',\"numSeries\":' || count(*) || ',\"numChunks\":' || sum(ceil(n / 240.0))::BIGINT || '}},\"version\":1}}' AS json FROM per GROUP BY 1")
def block_meta_json(spark: SparkSession, d: str) -> DataFrame:
    return blocks.meta_json(blocks.block_meta(_events(spark, d), _DAY))


@query(f"WITH {EVENTS}, r AS (SELECT ls_key, ts_ms, (row_number() OVER (PARTITION BY ls_key ORDER BY ts_ms) - 1) // 5 AS chunk, count(*) OVER (PARTITION BY ls_key) AS total FROM ev) SELECT ls_key, chunk, min(ts_ms) AS min_ts, max(ts_ms) AS max_ts, count(*) AS samples, chunk < (max(total) - 1) // 5 AS has_more FROM r GROUP BY ls_key, chunk")
def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    return _keyed(spark, d, blocks.chunk_stats(_events(spark, d), 5))


@query(f"WITH {EVENTS} SELECT event_id, CASE WHEN ts_ms % {blocks.TWO_HOURS} < (event_id % 10) * 720000 THEN (ts_ms // {blocks.TWO_HOURS}) * {blocks.TWO_HOURS} ELSE (ts_ms // {blocks.TWO_HOURS} + 1) * {blocks.TWO_HOURS} END + (event_id % 10) * 720000 AS next_ms FROM ev")
def next_rotation(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select("event_id", blocks.next_rotation(F.col("ts_ms"), (F.col("event_id") % 10) / 10).alias("next_ms"))


@query(f"WITH {EVENTS} SELECT ls_key, ts_ms, value FROM ev WHERE ts_ms BETWEEN 1704500000000 AND 1704900000000")
def blocks_written_and_read(spark: SparkSession, d: str) -> DataFrame:
    """A round trip through block folders; the time range prunes them."""
    from ..sources.scratch import folder

    path = folder(spark, "blocks")
    blocks.write_blocks(_events(spark, d).select("series_id", "ts_ms", "value"), path, _DAY)
    return _keyed(spark, d, blocks.read_blocks(spark, path, 1_704_500_000_000, 1_704_900_000_000, _DAY)).select("ls_key", "ts_ms", "value")


# Staleness


def _scrapes(spark: SparkSession, d: str) -> DataFrame:
    tick = (F.floor(F.col("ts_ms") / (6 * HOUR)) * (6 * HOUR)).cast("long")
    return bridge.table(spark, d, "events").select(bridge.millis("ts").alias("ts_ms"), F.concat(F.lit("i"), (F.col("user_id") % 10).cast("string")).alias("target"), canonical(bridge.event_labels()).alias("ls_key")).select("target", tick.alias("scrape_ts"), "ls_key").distinct()


SCRAPES = f"{EVENTS}, sc AS (SELECT DISTINCT 'i' || (user_id % 10) AS target, (ts_ms // {6 * HOUR}) * {6 * HOUR} AS scrape_ts, ls_key FROM ev)"
STALE = f"""WITH {SCRAPES}, t AS (SELECT target, scrape_ts, lead(scrape_ts) OVER (PARTITION BY target ORDER BY scrape_ts) AS next_ts FROM (SELECT DISTINCT target, scrape_ts FROM sc))
SELECT sc.target, t.next_ts AS scrape_ts, sc.ls_key FROM sc JOIN t USING (target, scrape_ts) WHERE t.next_ts IS NOT NULL AND NOT EXISTS (SELECT 1 FROM sc s WHERE s.target = sc.target AND s.scrape_ts = t.next_ts AND s.ls_key = sc.ls_key)"""


@query(STALE)
def stale_markers(spark: SparkSession, d: str) -> DataFrame:
    return staleness.stale_markers(_scrapes(spark, d))


@query(f"WITH {SCRAPES} SELECT target, scrape_ts + 1 AS scrape_ts, ls_key FROM sc s WHERE scrape_ts = (SELECT max(scrape_ts) FROM sc x WHERE x.target = s.target)")
def stale_final(spark: SparkSession, d: str) -> DataFrame:
    return staleness.final_markers(_scrapes(spark, d), F.col("scrape_ts") + 1)


@query(f"WITH {EVENTS} SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 5 ELSE ts_ms END AS honoured, 5::BIGINT AS forced FROM ev")
def timestamp_default(spark: SparkSession, d: str) -> DataFrame:
    ts = F.when(F.col("event_id") % 3 != 0, F.col("ts_ms"))
    default = F.lit(5).cast("long")
    return _events(spark, d).select("event_id", staleness.with_timestamps(ts, default, True).alias("honoured"), staleness.with_timestamps(ts, default, False).alias("forced"))


# Replicas and open segments


def _replica_batches(rows: DataFrame) -> DataFrame:
    cluster, replica = F.concat(F.lit("c"), (F.col("user_id") % 64).cast("string")), F.concat(F.lit("r"), (F.col("event_id") % 2).cast("string"))
    return rows.select(F.col("event_id").alias("batch_id"), cluster.alias("cluster"), F.when(F.col("event_id") % 11 == 0, "").otherwise(replica).alias("replica"), F.floor(F.col("ts_ms") / 100_000).cast("long").alias("now_s"))


HA = f"""WITH RECURSIVE {EVENTS}, b AS (SELECT event_id AS batch_id, 'c' || (user_id % 64) AS cluster, CASE WHEN event_id % 11 = 0 THEN '' ELSE 'r' || (event_id % 2) END AS replica, ts_ms // 100000 AS now_s FROM ev),
o AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY now_s, batch_id) AS k FROM b),
f AS (SELECT cluster, 0::BIGINT AS k, NULL::VARCHAR AS who, 0::BIGINT AS since, NULL::BIGINT AS batch_id, NULL::VARCHAR AS replica, 0::BIGINT AS now_s, false AS dropped FROM (SELECT DISTINCT cluster FROM b)
UNION ALL SELECT cluster, k, CASE WHEN replica = '' THEN who WHEN held IS NULL OR held = replica OR now_s - since >= 30 THEN replica ELSE held END,
  CASE WHEN replica = '' THEN since WHEN held IS NULL OR held = replica OR now_s - since >= 30 THEN now_s ELSE since END, batch_id, replica, now_s,
  replica <> '' AND held IS NOT NULL AND held <> replica
  FROM (SELECT o.cluster, o.k, f.who, CASE WHEN (o.now_s // 600) * 600 - f.since >= 600 THEN NULL ELSE f.who END AS held, f.since, o.batch_id, o.replica, o.now_s FROM f JOIN o ON o.cluster = f.cluster AND o.k = f.k + 1))
SELECT batch_id, cluster, replica, now_s, dropped FROM f WHERE k > 0"""


@query(HA)
def ha_dedup(spark: SparkSession, d: str) -> DataFrame:
    return replicas.deduplicate(_replica_batches(_events(spark, d)))


OPEN = f"""WITH RECURSIVE {EVENTS}, o AS (SELECT event_id AS row_id, user_id % 64 AS shard, ts_ms, row_number() OVER (PARTITION BY user_id % 64 ORDER BY ts_ms, event_id) AS k FROM ev),
f AS (SELECT row_id, shard, ts_ms, k, 0::BIGINT AS segment, ts_ms AS first, 1::BIGINT AS n FROM o WHERE k = 1
UNION ALL SELECT row_id, shard, ts_ms, k, CASE WHEN cut THEN segment + 1 ELSE segment END, CASE WHEN cut THEN ts_ms ELSE first END, CASE WHEN cut THEN 1 ELSE n + 1 END
  FROM (SELECT o.row_id, o.shard, o.ts_ms, o.k, f.segment, f.first, f.n, o.ts_ms - f.first >= {60 * HOUR} OR o.ts_ms - f.ts_ms >= {12 * HOUR} OR f.n >= 6 AS cut FROM f JOIN o ON o.shard = f.shard AND o.k = f.k + 1))
SELECT row_id, shard, ts_ms, segment FROM f"""


@query(OPEN)
def open_head_batches(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).select(F.col("event_id").alias("row_id"), (F.col("user_id") % 64).alias("shard"), "ts_ms")
    return delivery.open_head_batches(rows, most=6, age_ms=60 * HOUR, idle_ms=12 * HOUR)


# Delivery

LOWER = 1_705_000_000_000


@query(f"WITH {EVENTS} SELECT event_id, ts_ms FROM ev WHERE ts_ms >= {LOWER}")
def age_filter(spark: SparkSession, d: str) -> DataFrame:
    return delivery.age_filter(_events(spark, d).select("event_id", "ts_ms"), LOWER)


@query(f"WITH {EVENTS} SELECT count(*) FILTER (ts_ms >= {LOWER}) AS kept, count(*) FILTER (ts_ms < {LOWER}) AS outdated, max(ts_ms) AS max_ts FROM ev")
def age_filter_stats(spark: SparkSession, d: str) -> DataFrame:
    return delivery.age_stats(_events(spark, d), LOWER)


@query("SELECT event_id, least(greatest(ceil(value), 3), 12)::INTEGER AS shards, ceil(CASE WHEN event_id % 2 = 0 THEN value / 10 * 4 ELSE 5000.0 / (event_id % 7 + 1) * 4 END)::BIGINT AS desired FROM events")
def output_shards(spark: SparkSession, d: str) -> DataFrame:
    v, i = F.col("value"), F.col("event_id")
    return _events(spark, d).select("event_id", delivery.clamp_shards(v, 3, 12).alias("shards"), delivery.desired_shards(v, 10, F.lit(4), i % 2 == 0, 5000, i % 7 + 1).alias("desired"))


@query("""WITH x AS (SELECT event_id, (event_id % 9)::INTEGER AS power, (value * 4000000)::BIGINT AS bytes, (event_id * 13 % 9000)::BIGINT AS s FROM events), y AS (SELECT *, s / 7200.0 AS t, floor(bytes * 110 / 100) / 67108864.0 AS z FROM x)
SELECT event_id, (CASE WHEN bytes > 67108864 THEN least(255, power + CASE WHEN t > 1 THEN 0 WHEN t > 0.5 THEN 1 WHEN t > 0.25 THEN 2 WHEN t > 0.125 THEN 3 WHEN t > 0.0625 THEN 4 ELSE 5 END)
 WHEN s >= 7200 THEN greatest(0, power - CASE WHEN z > 0.5 THEN 0 WHEN z > 0.25 THEN 1 WHEN z > 0.125 THEN 2 WHEN z > 0.0625 THEN 3 WHEN z > 0.03125 THEN 4 ELSE 5 END) ELSE power END)::INTEGER AS power FROM y""")
def autoshard_power(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    return _events(spark, d).select("event_id", delivery.shard_power((i % 9).cast("int"), F.round(F.col("value") * 4_000_000).cast("long"), i * 13 % 9000).alias("power"))


def _acks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    o = bridge.table(spark, d, "orders").select((F.col("o_orderkey") % 4).alias("shard"), F.concat(F.lit("d"), (F.col("o_custkey") % 3).cast("string")).alias("dest"), F.floor(F.col("o_orderkey") / 4).cast("long").alias("segment"), "o_orderstatus")
    written = o.groupBy("shard").agg(F.max("segment").alias("max_segment"))
    acked = o.groupBy("dest", "shard").agg(F.max(F.when((F.col("segment") < F.col("shard") * 100 + 50) & (F.col("shard") > 0), F.col("segment"))).alias("last_segment"))
    rejects = o.where("segment < 40 and o_orderstatus = 'P'").select("dest", "shard", "segment").distinct()
    finished = o.where("dest = 'd2' and shard = 3").select("dest", "shard").distinct()
    return acked, written, rejects, finished


ACKS = """o AS (SELECT o_orderkey % 4 AS shard, 'd' || (o_custkey % 3) AS dest, o_orderkey // 4 AS segment, o_orderstatus FROM orders),
written AS (SELECT shard, max(segment) AS m FROM o GROUP BY shard),
acked AS (SELECT dest, shard, max(segment) FILTER (segment < shard * 100 + 50 AND shard > 0) AS last_segment FROM o GROUP BY dest, shard)"""


@query(f"WITH {ACKS}, due AS (SELECT dest, shard, unnest(range(coalesce(last_segment + 1, 0), m + 1)) AS segment FROM acked JOIN written USING (shard) UNION SELECT dest, shard, segment FROM o WHERE segment < 40 AND o_orderstatus = 'P') SELECT dest, shard, segment FROM due WHERE NOT (dest = 'd2' AND shard = 3)")
def pending_segments(spark: SparkSession, d: str) -> DataFrame:
    return delivery.pending_segments(*_acks(spark, d))


@query(f"WITH {ACKS} SELECT shard, CASE WHEN count(*) = count(last_segment) THEN min(last_segment) END AS acked_by_all FROM acked GROUP BY shard")
def ack_status(spark: SparkSession, d: str) -> DataFrame:
    return delivery.ack_status(_acks(spark, d)[0])


@query(f"WITH {ACKS}, low AS (SELECT shard, min(coalesce(last_segment, -1)) AS least FROM acked GROUP BY shard) SELECT DISTINCT shard, segment, segment <= least AS acked FROM o JOIN low USING (shard)")
def acked_segments(spark: SparkSession, d: str) -> DataFrame:
    segments = bridge.table(spark, d, "orders").select((F.col("o_orderkey") % 4).alias("shard"), F.floor(F.col("o_orderkey") / 4).cast("long").alias("segment")).distinct()
    return delivery.acked_segments(segments, _acks(spark, d)[0])


@query("WITH e AS (SELECT o_orderkey % 512 AS shard, o_orderkey // 512 AS segment, o_orderstatus <> 'O' AS resolved, o_custkey % 97 = 0 AS rejected, epoch_us(o_orderdate) // 1000 AS expires FROM orders) SELECT shard, segment FROM e WHERE resolved AND (rejected OR expires < 800000000000 OR shard IN (SELECT shard FROM e WHERE rejected))")
def refill_due(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = bridge.table(spark, d, "orders").select((k % 512).alias("shard"), F.floor(k / 512).cast("long").alias("segment"), (F.col("o_orderstatus") != "O").alias("resolved"), (F.col("o_custkey") % 97 == 0).alias("rejected"), bridge.millis("o_orderdate").alias("expires_ms"))
    return delivery.refill_due(rows, 800_000_000_000)


@query("WITH h AS (SELECT c_custkey AS head, ['new', 'rotated', 'active', 'persisted'][c_custkey % 4 + 1] AS status, CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 40 END AS last_appended FROM customer) SELECT o_custkey AS head, o_orderkey % 50 AS segment, CASE WHEN last_appended >= o_orderkey % 50 THEN 'ready' WHEN status IN ('rotated', 'persisted') THEN 'out of range' ELSE 'wait' END AS state FROM orders JOIN h ON h.head = o_custkey")
def segment_state(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey")
    heads = bridge.table(spark, d, "customer").select(c.alias("head"), F.get(F.array(*map(F.lit, ("new", "rotated", "active", "persisted"))), (c % 4).cast("int")).alias("status"), F.when(c % 5 > 0, c % 40).alias("last_appended"))
    return delivery.segment_state(bridge.table(spark, d, "orders").select(F.col("o_custkey").alias("head"), (F.col("o_orderkey") % 50).alias("segment")), heads)


@query("WITH s AS (SELECT o_orderkey // 4 AS segment, o_orderkey % 4 AS shard, CASE o_orderstatus WHEN 'F' THEN 'ack' WHEN 'O' THEN 'refill' WHEN 'P' THEN CASE WHEN o_custkey % 2 = 0 THEN 'ack' END END AS status FROM orders) SELECT segment, bool_and(status IS NOT NULL) AS done, bool_and(coalesce(status = 'ack', false)) AS delivered FROM s GROUP BY segment")
def promise_status(spark: SparkSession, d: str) -> DataFrame:
    status: Column = F.when(F.col("o_orderstatus") == "F", "ack").when(F.col("o_orderstatus") == "O", "refill").when((F.col("o_orderstatus") == "P") & (F.col("o_custkey") % 2 == 0), "ack")
    rows = bridge.table(spark, d, "orders").select(F.floor(F.col("o_orderkey") / 4).cast("long").alias("segment"), (F.col("o_orderkey") % 4).alias("shard"), status.alias("status"))
    return delivery.promise_status(rows)


@query("SELECT sum(o_custkey) FILTER (o_orderstatus = 'F')::BIGINT AS sent, sum(o_custkey) FILTER (o_orderstatus <> 'F')::BIGINT AS failed, sum(o_custkey) FILTER (o_orderkey % 3 > 0)::BIGINT AS retried, max(epoch_us(o_orderdate) // 1000) FILTER (o_orderstatus = 'F') AS max_ts FROM orders")
def post_accounting(spark: SparkSession, d: str) -> DataFrame:
    rows = bridge.table(spark, d, "orders").select(F.col("o_custkey").alias("samples"), (F.col("o_orderstatus") == "F").alias("delivered"), (F.col("o_orderkey") % 3 + 1).alias("attempts"), bridge.millis("o_orderdate").alias("max_ts"))
    return delivery.post_accounting(rows)


@query("WITH old AS (SELECT c_custkey % 300 AS dest, max(c_nationkey) AS config FROM customer WHERE c_custkey % 7 > 0 GROUP BY 1), new AS (SELECT c_custkey % 300 AS dest, max(c_nationkey) FILTER (c_custkey % 5 > 0) AS config FROM customer WHERE c_custkey % 11 > 0 GROUP BY 1 HAVING count(*) FILTER (c_custkey % 5 > 0) > 0) SELECT dest, CASE WHEN new.config IS NULL THEN 'stop' WHEN old.config IS NULL THEN 'start' ELSE 'restart' END AS change FROM old FULL JOIN new USING (dest) WHERE old.config IS DISTINCT FROM new.config")
def config_changes(spark: SparkSession, d: str) -> DataFrame:
    c = bridge.table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 300).alias("dest"), "c_nationkey")
    old, new = c.where("c_custkey % 7 > 0"), c.where("c_custkey % 11 > 0 and c_custkey % 5 > 0")
    return delivery.config_changes(*(x.groupBy("dest").agg(F.max("c_nationkey").alias("config")) for x in (old, new)))


# Catalogue


def _log(spark: SparkSession, d: str) -> DataFrame:
    """Orders as records of 500 heads."""
    k, day = F.col("o_orderkey"), bridge.millis("o_orderdate")
    status = F.get(F.array(*map(F.lit, catalog.STATUSES)), (F.col("o_custkey") % 5).cast("int"))
    return bridge.table(spark, d, "orders").select((k % 500).alias("id"), k.alias("seq"), (k % 500 * 1000).alias("created_at"), day.alias("updated_at"), F.when(k % 17 == 0, 1).otherwise(0).cast("long").alias("deleted_at"), (F.col("o_custkey") % 13 == 0).alias("corrupted"), status.alias("status"), F.when(k % 500 >= 400, k % 3).otherwise(0).alias("refs"))


LOG = """log AS (SELECT o_orderkey % 500 AS id, o_orderkey AS seq, o_orderkey % 500 * 1000 AS created_at, epoch_us(o_orderdate) // 1000 AS updated_at, CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END AS deleted_at, o_custkey % 13 = 0 AS corrupted, ['new', 'rotated', 'corrupted', 'persisted', 'active'][o_custkey % 5 + 1] AS status, CASE WHEN o_orderkey % 500 >= 400 THEN o_orderkey % 3 ELSE 0 END AS refs FROM orders),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, seq DESC) AS k FROM log) WHERE k = 1),
rec AS (SELECT id, created_at, deleted_at, corrupted OR status = 'corrupted' AS corrupted, CASE WHEN status = 'corrupted' THEN 'rotated' ELSE status END AS status, refs FROM last)"""


@query(f"WITH {LOG} SELECT id, created_at, deleted_at::BIGINT AS deleted_at, corrupted, status FROM rec")
def catalog_latest(spark: SparkSession, d: str) -> DataFrame:
    return catalog.latest(_log(spark, d)).select("id", "created_at", "deleted_at", "corrupted", "status")


@query(f"WITH {LOG}, h AS (SELECT * FROM rec WHERE deleted_at = 0 AND status <> 'persisted') SELECT id, CASE WHEN id = (SELECT max(id) FROM h) AND status IN ('new', 'active') AND NOT corrupted AND 500000 - created_at < 7200000 THEN 'active' ELSE 'rotated' END AS new_status FROM h")
def catalog_active(spark: SparkSession, d: str) -> DataFrame:
    return catalog.restored(catalog.latest(_log(spark, d)), 500_000, blocks.TWO_HOURS)


@query(f"WITH {LOG}, h AS (SELECT * FROM rec WHERE deleted_at = 0) SELECT id FROM h WHERE NOT corrupted AND created_at < coalesce((SELECT min(created_at) FROM h WHERE refs > 0), 9e18)")
def catalog_gc(spark: SparkSession, d: str) -> DataFrame:
    return catalog.collectable(catalog.latest(_log(spark, d)))


@query(f"WITH {LOG}, h AS (SELECT * FROM rec WHERE deleted_at = 0) SELECT coalesce((SELECT max(id) FROM h WHERE id % 7 = 3), (SELECT max(id) FROM h)) AS id")
def catalog_resume(spark: SparkSession, d: str) -> DataFrame:
    records = catalog.latest(_log(spark, d))
    return catalog.head_to_resume(records, records.where("id % 7 = 3").select("id"))


# Text


def _exposition(spark: SparkSession, d: str) -> DataFrame:
    e = bridge.table(spark, d, "events")
    odd = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit('say "'), F.col("event_type"), F.lit('"\\ or\n'))).otherwise(F.col("event_type"))
    labels = F.create_map(F.lit("__name__"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string"), F.lit("note"), odd)
    rows = e.select("event_id", labels.alias("labels"), "value", bridge.millis("ts").alias("ts_ms"))
    return rows.select(F.col("event_id").alias("payload_id"), F.lit(0).alias("line_no"), text.render(rows).alias("line"))


@query("""SELECT event_id AS payload_id, event_type AS metric, user_id::VARCHAR AS user, CASE WHEN event_id % 5 = 0 THEN 'say "' || event_type || '"\\ or' || chr(10) ELSE event_type END AS note, value, epoch_us(ts) // 1000 AS ts_ms FROM events""")
def scrape_parse(spark: SparkSession, d: str) -> DataFrame:
    got = text.accepted(text.parse_samples(_exposition(spark, d)))
    m = F.col("labels")
    return got.select("payload_id", get(m, "__name__").alias("metric"), get(m, "user").alias("user"), get(m, "note").alias("note"), "value", "ts_ms")


@query("SELECT event_id AS payload_id, event_type AS metric_name, ['help', 'type', 'unit'][event_id % 3 + 1] AS kind, 'text of ' || user_id AS text FROM events")
def scrape_metadata(spark: SparkSession, d: str) -> DataFrame:
    e = bridge.table(spark, d, "events")
    kind = F.get(F.array(*map(F.lit, ("HELP", "TYPE", "UNIT"))), (F.col("event_id") % 3).cast("int"))
    line = F.concat(F.lit("# "), kind, F.lit(" \t"), F.col("event_type"), F.lit(" text of "), F.col("user_id").cast("string"))
    return text.parse_metadata(e.select(F.col("event_id").alias("payload_id"), F.lit(0).alias("line_no"), line.alias("line"))).drop("line_no")


@query("SELECT event_id AS payload_id, CASE WHEN event_id % 6 = 0 THEN 1 ELSE 0 END::BIGINT AS scraped, CASE WHEN event_id % 6 = 0 THEN NULL ELSE [1, 2, 1, 4, 5][event_id % 6] END::INTEGER AS error FROM events")
def scrape_errors(spark: SparkSession, d: str) -> DataFrame:
    bad = ["a{b='c'} 1", '{b="c"} 1', 'a{b="c" 1', 'a{b="c"} v', 'a{b="c"} 1 9223372036854775808']
    e = bridge.table(spark, d, "events")
    line = F.get(F.array(*map(F.lit, ['a{b="c"} 1', *bad])), (F.col("event_id") % 6).cast("int"))
    return text.payload_errors(text.parse_samples(e.select(F.col("event_id").alias("payload_id"), F.lit(0).alias("line_no"), line.alias("line"))))


# Remote write


@query(f"WITH {EVENTS} SELECT ls_key, ts_ms, value FROM ev")
def remote_write_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Samples to snappy protobuf requests and back."""
    rows = _events(spark, d).join(bridge.event_series(spark, d).select("series_id", "labels", "ls_key"), "series_id")
    back = remote_write.decode_chunks(remote_write.encode_payloads(remote_write.requests_of(rows, 100)))
    return remote_write.samples_of(back).select(canonical(F.col("labels")).alias("ls_key"), "ts_ms", "value")


# Streams


def _stream(spark: SparkSession, d: str, ordered: DataFrame, name: str) -> DataFrame:
    """A stream over rows in order, in four files that come one after another."""
    from ..sources.scratch import folder

    path = folder(spark, name)
    for k in range(4):
        ordered.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(path)
    return stateful.read(spark, path, ordered.drop("part").schema)


def _name(prefix: str) -> str:
    import uuid

    return f"{prefix}_{uuid.uuid4().hex}"


def _quarter(column: str) -> Column:
    """0 to 3 by time within January 2024."""
    return F.least(F.lit(3), F.greatest(F.lit(0), F.floor((F.col(column) - 1_704_067_200_000) / (8 * _DAY)).cast("int")))


@query(f"WITH {EVENTS} SELECT (ts_ms // {_DAY}) * {_DAY} AS block_start, count(*) AS num_samples, min(ts_ms) AS min_time, max(ts_ms) + 1 AS max_time FROM ev GROUP BY 1")
def stream_blocks(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).select("series_id", "ts_ms", "value", _quarter("ts_ms").alias("part"))
    return stateful.run_to_end(stateful.block_counts(_stream(spark, d, rows, "blocks"), _DAY), _name("blocks"), "complete")


@query(STALE)
def stream_stale(spark: SparkSession, d: str) -> DataFrame:
    rows = _scrapes(spark, d).withColumn("part", _quarter("scrape_ts"))
    return stateful.run_to_end(stateful.stale(_stream(spark, d, rows, "scrapes")), _name("stale"))


@query(HA)
def stream_ha(spark: SparkSession, d: str) -> DataFrame:
    rows = _replica_batches(_events(spark, d)).withColumn("part", F.least(F.lit(3), F.floor((F.col("now_s") - 17_040_672) / 6912).cast("int")))
    return stateful.run_to_end(stateful.replicas(_stream(spark, d, rows, "replicas")), _name("replicas"))
