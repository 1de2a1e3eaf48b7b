"""Selection, label queries, label-set functions and cardinality reports over the events bridge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labelset as ls
from ..operators import select as sel
from ..operators import status
from ..operators.matchers import Matcher, query_status
from ..sources import bridge
from .registry import AS_KEY, EVENTS, PAIRS, SERIES, query

MINT, MAXT = 1_704_500_000_000, 1_706_000_000_000
RANGE = f"ts_ms BETWEEN {MINT} AND {MAXT}"


def _select(spark: SparkSession, d: str, *matchers: tuple[str, str, str]) -> DataFrame:
    got = sel.select(bridge.event_series(spark, d), bridge.event_samples(spark, d), [Matcher(*m) for m in matchers], MINT, MAXT)
    return got.select("ls_key", "ts_ms", "value")


def _register_select(name: str, where: str, *matchers: tuple[str, str, str]) -> None:
    query(f"WITH {EVENTS} SELECT ls_key, ts_ms, value FROM ev WHERE {RANGE} AND {where}", name)(lambda s, d: _select(s, d, *matchers))


_register_select("select_eq", "event_type = 'click'", ("__name__", "=", "click"))
_register_select("select_neq", "event_type = 'click' AND user_id % 2 <> 0", ("__name__", "=", "click"), ("cluster", "!=", "c0"))
_register_select("select_regex", "event_type = 'click' AND regexp_full_match(user_id::VARCHAR, '1.*')", ("__name__", "=", "click"), ("user", "=~", "1.*"))
_register_select("select_nregex", "event_type = 'view' AND NOT regexp_full_match('i' || (user_id % 10), 'i[0-4]')", ("__name__", "=", "view"), ("instance", "!~", "i[0-4]"))
_register_select("select_conj", "regexp_full_match(event_type, 'click|view') AND user_id % 3 = 1 AND user_id % 10 <> 3 AND NOT regexp_full_match(user_id::VARCHAR, '.*7')", ("__name__", "=~", "click|view"), ("job", "=", "job1"), ("instance", "!=", "i3"), ("user", "!~", ".*7"))
_register_select("select_empty_matcher", "user_id % 2 = 1", ("cluster", "=", "c1"), ("no_such_label", "=", ""), ("other", "!~", ".+"))
_register_select("select_no_match", "false", ("__name__", "=", "no such metric"))


@query(f"WITH {EVENTS} SELECT ls_key, ts_ms, value FROM ev WHERE event_type = 'purchase' AND {RANGE} ORDER BY ls_key, ts_ms")
def select_ordered(spark: SparkSession, d: str) -> DataFrame:
    return sel.ordered(_select(spark, d, ("__name__", "=", "purchase")))


@query(f"""WITH {EVENTS}, heads AS (
  SELECT 0 AS head, ls_key, ts_ms, value FROM ev WHERE ts_ms < {MAXT} UNION ALL SELECT 1, ls_key, ts_ms, value + 1000 FROM ev WHERE ts_ms >= {MINT}
), r AS (SELECT *, row_number() OVER (PARTITION BY ls_key, ts_ms ORDER BY head, value) AS k FROM heads)
SELECT ls_key, ts_ms, value FROM r WHERE k = 1""")
def select_multi_head(spark: SparkSession, d: str) -> DataFrame:
    series = bridge.event_series(spark, d).select("series_id", "ls_key")
    samples = bridge.event_samples(spark, d).join(series, "series_id")
    first = samples.where(F.col("ts_ms") < MAXT)
    second = samples.where(F.col("ts_ms") >= MINT).withColumn("value", F.col("value") + 1000)
    return sel.union_heads([first.groupBy("ls_key", "ts_ms").agg(F.min("value").alias("value")), second.groupBy("ls_key", "ts_ms").agg(F.min("value").alias("value"))])


@query(f"WITH {EVENTS} SELECT ls_key, min(ts_ms) AS ts_ms, first(value ORDER BY ts_ms, value) AS value FROM ev WHERE ts_ms >= 1705200000000 GROUP BY ls_key")
def seek_first_after(spark: SparkSession, d: str) -> DataFrame:
    got = sel.seek(bridge.event_samples(spark, d), 1_705_200_000_000)
    return got.join(bridge.event_series(spark, d), "series_id").select("ls_key", "ts_ms", "value")


@query(f"WITH {SERIES}, {PAIRS} SELECT DISTINCT name FROM pairs")
def label_names(spark: SparkSession, d: str) -> DataFrame:
    return sel.label_names(bridge.event_series(spark, d))


@query(f"WITH {SERIES}, {PAIRS} SELECT DISTINCT name FROM pairs WHERE ls_key IN (SELECT ls_key FROM series WHERE event_type = 'click')")
def label_names_matched(spark: SparkSession, d: str) -> DataFrame:
    return sel.label_names(bridge.event_series(spark, d), [Matcher("__name__", "=", "click")])


@query(f"WITH {SERIES}, {PAIRS} SELECT DISTINCT value FROM pairs WHERE name = 'instance'")
def label_values(spark: SparkSession, d: str) -> DataFrame:
    return sel.label_values(bridge.event_series(spark, d), "instance")


@query(f"WITH {SERIES}, {PAIRS} SELECT DISTINCT value FROM pairs WHERE name = 'user' AND ls_key IN (SELECT ls_key FROM series WHERE user_id % 3 = 2 AND event_type <> 'view')")
def label_values_matched(spark: SparkSession, d: str) -> DataFrame:
    return sel.label_values(bridge.event_series(spark, d), "user", [Matcher("job", "=", "job2"), Matcher("__name__", "!=", "view")])


@query(f"WITH {SERIES}, {PAIRS} SELECT DISTINCT value FROM pairs WHERE name IN ('job', 'cluster')")
def label_values_of_heads(spark: SparkSession, d: str) -> DataFrame:
    series = bridge.event_series(spark, d)
    return sel.distinct_strings([sel.label_values(series, "job"), sel.label_values(series, "cluster"), sel.label_values(series, "job")])


@query(f"WITH {SERIES}, {PAIRS} SELECT name, value, string_agg(ls_key, '|' ORDER BY ls_key) AS ids, count(*) AS n FROM pairs WHERE name <> 'user' GROUP BY name, value")
def postings(spark: SparkSession, d: str) -> DataFrame:
    got = sel.postings(bridge.event_series(spark, d), "ls_key").where("name <> 'user'")
    return got.select("name", "value", F.array_join("ids", "|").alias("ids"), F.size("ids").cast("long").alias("n"))


@query(f"WITH {SERIES}, {PAIRS} SELECT DISTINCT unnest([name, value]) AS symbol FROM pairs")
def symbols(spark: SparkSession, d: str) -> DataFrame:
    return sel.symbols(bridge.event_series(spark, d))


@query("SELECT * FROM (VALUES ('positive', 'Match'), ('negative', 'NoPositiveMatchers'), ('none', 'NoMatch'), ('broken', 'RegexpError')) t(kind, status)")
def match_status(spark: SparkSession, d: str) -> DataFrame:
    series = bridge.event_series(spark, d)
    cases = {"positive": ("__name__", "=", "click"), "negative": ("__name__", "!=", "click"), "none": ("__name__", "=", "nothing"), "broken": ("__name__", "=~", '.["')}
    rows = []
    for kind, m in cases.items():
        status_ = query_status(0, [m])
        if status_ == "NoMatch":
            status_ = query_status(sel.match_series(series, [Matcher(*m)]).limit(1).count(), [m])
        rows.append((kind, status_))
    return spark.createDataFrame(rows, "kind string, status string")


# Label sets


def _sets(spark: SparkSession, d: str) -> DataFrame:
    return bridge.event_series(spark, d)


def _labelset(name: str, sql: str, **columns) -> None:  # noqa: ANN003
    query(f"WITH {SERIES}, {PAIRS} {sql}", name)(lambda s, d: _sets(s, d).select("ls_key", *(f(F.col("labels")).alias(k) for k, f in columns.items())))


_labelset("labelset_canonical", f"SELECT ls_key, {AS_KEY} AS text, count(*)::INTEGER AS n, min(name) AS first_name, first(value ORDER BY name) AS first_value FROM pairs GROUP BY ls_key", text=lambda L: ls.canonical(L), n=lambda L: ls.length(L), first_name=lambda L: ls.name_at(L, 0), first_value=lambda L: ls.value_at(L, 0))
_labelset("labelset_get", "SELECT ls_key, 'job' || (user_id % 3) AS job, 'none' AS missing, true AS has_job, false AS has_zone FROM series", job=lambda L: ls.get(L, "job"), missing=lambda L: ls.get(L, "zone", "none"), has_job=lambda L: ls.has(L, "job"), has_zone=lambda L: ls.has(L, "zone"))
_labelset("labelset_with", f"SELECT ls_key, {AS_KEY} AS text FROM (SELECT ls_key, name, CASE WHEN name = 'job' THEN 'new' ELSE value END AS value FROM pairs UNION ALL SELECT ls_key, 'zone', 'z1' FROM series) GROUP BY ls_key", text=lambda L: ls.canonical(ls.with_label(ls.with_label(L, "zone", "z1"), "job", "new")))
_labelset("labelset_merge", f"SELECT ls_key, {AS_KEY} AS text FROM (SELECT ls_key, name, CASE WHEN name = 'instance' THEN 'x' ELSE value END AS value FROM pairs UNION ALL SELECT ls_key, 'az', 'a' FROM series) GROUP BY ls_key", text=lambda L: ls.canonical(ls.merge(L, F.create_map(F.lit("az"), F.lit("a"), F.lit("instance"), F.lit("x")))))
_labelset("labelset_without", f"SELECT ls_key, {AS_KEY} AS text FROM pairs WHERE name NOT IN ('user', 'cluster') GROUP BY ls_key", text=lambda L: ls.canonical(ls.without(L, ["user", "cluster", "zone"])))
_TAKEN = AS_KEY + " FILTER (name IN ('job', 'user'))"
_REST = AS_KEY + " FILTER (name NOT IN ('job', 'user'))"
_labelset("labelset_split", f"SELECT ls_key, {_TAKEN} AS taken, {_REST} AS rest FROM pairs GROUP BY ls_key", taken=lambda L: ls.canonical(ls.split_by(L, ["job", "user"])[0]), rest=lambda L: ls.canonical(ls.split_by(L, ["job", "user"])[1]))
_labelset("labelset_json", "SELECT ls_key, '{' || string_agg('\"' || name || '\":\"' || value || '\"', ',' ORDER BY name) || '}' AS json, ls_key AS again FROM pairs GROUP BY ls_key", json=lambda L: ls.to_json(L), again=lambda L: ls.canonical(ls.from_json(ls.to_json(L))))
_labelset("labelset_yaml", "SELECT ls_key, string_agg('\"' || name || '\": \"' || value || '\"' || chr(10), '' ORDER BY name) AS yaml FROM pairs GROUP BY ls_key", yaml=lambda L: ls.to_yaml(L))


@query(f"""WITH p AS (SELECT event_id, unnest(['b', 'a', 'b', 'user']) AS name, unnest([event_type, 'x', 'last', '']) AS value, unnest([1, 2, 3, 4]) AS k FROM events),
f AS (SELECT event_id, name, arg_max(value, k) AS value FROM p GROUP BY event_id, name)
SELECT event_id, {AS_KEY} AS text, true AS duplicated FROM f WHERE value <> '' GROUP BY event_id""")
def labelset_builder(spark: SparkSession, d: str) -> DataFrame:
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    entries = F.array(pair("b", F.col("event_type")), pair("a", F.lit("x")), pair("b", F.lit("last")), pair("user", F.lit("")))
    rows = bridge.table(spark, d, "events").select("event_id", entries.alias("e"))
    return rows.select("event_id", ls.canonical(ls.without_empty(ls.from_pairs(F.col("e")))).alias("text"), ls.has_duplicate_names(F.transform("e", lambda x: x["name"])).alias("duplicated"))


@query("SELECT event_id, (props::JSON ->> 'k') AS k FROM events")
def labels_of_props(spark: SparkSession, d: str) -> DataFrame:
    return bridge.table(spark, d, "events").select("event_id", ls.get(ls.from_json(F.col("props")), "k").alias("k"))


# Reports

_TOP = "ORDER BY n DESC, name LIMIT 10"


@query(f"WITH {SERIES} SELECT event_type AS name, count(*) AS n FROM series GROUP BY event_type {_TOP}")
def status_series_by_metric(spark: SparkSession, d: str) -> DataFrame:
    return status.series_by_metric(_sets(spark, d))


@query(f"WITH {SERIES}, {PAIRS} SELECT name, count(DISTINCT value) AS n FROM pairs GROUP BY name {_TOP}")
def status_values_by_label(spark: SparkSession, d: str) -> DataFrame:
    return status.values_by_label(_sets(spark, d))


@query(f"WITH {SERIES}, {PAIRS} SELECT name, sum(strlen(value))::BIGINT AS n FROM pairs GROUP BY name {_TOP}")
def status_bytes_by_label(spark: SparkSession, d: str) -> DataFrame:
    return status.bytes_by_label(_sets(spark, d))


@query(f"WITH {SERIES}, {PAIRS} SELECT name, value, count(*) AS n FROM pairs GROUP BY name, value ORDER BY n DESC, name, value LIMIT 10")
def status_series_by_pair(spark: SparkSession, d: str) -> DataFrame:
    return status.series_by_pair(_sets(spark, d))


@query(f"WITH {EVENTS}, {SERIES}, {PAIRS}, per AS (SELECT ls_key, count(*) AS n FROM ev GROUP BY ls_key) SELECT (SELECT count(*) FROM series) AS num_series, (SELECT count(*) FROM (SELECT DISTINCT name, value FROM pairs)) AS num_label_pairs, (SELECT sum(ceil(n / 240.0))::BIGINT FROM per) AS chunk_count, (SELECT min(ts_ms) FROM ev) AS min_ts, (SELECT max(ts_ms) FROM ev) AS max_ts")
def status_totals(spark: SparkSession, d: str) -> DataFrame:
    return status.totals(_sets(spark, d), bridge.event_samples(spark, d))


@query(f"WITH {EVENTS} SELECT CASE WHEN user_id % 3 = 0 THEN 'rule' WHEN user_id % 3 = 1 THEN 'federate' ELSE 'other' END AS source, count(DISTINCT ls_key) AS n FROM ev GROUP BY 1")
def status_queried_series(spark: SparkSession, d: str) -> DataFrame:
    user = F.col("user_id") % 3
    log = bridge.table(spark, d, "events").select(F.when(user == 0, "rule").when(user == 1, "federate").otherwise("other").alias("source"), bridge.event_id().alias("series_id"))
    return status.queried_series(log)


@query(f"WITH {EVENTS} SELECT count(*) AS samples, count(DISTINCT ls_key) AS series, min(ts_ms) AS earliest, max(ts_ms) AS latest FROM ev")
def segment_stats(spark: SparkSession, d: str) -> DataFrame:
    return status.segment_stats(bridge.event_samples(spark, d))


@query("SELECT l_returnflag || '/' || l_linestatus || '/' || (l_suppkey % 16) AS grp, count(*) AS n, count(DISTINCT l_suppkey) AS series, min(epoch_us(l_shipdate) // 1000) AS low, max(epoch_us(l_shipdate) // 1000) AS high FROM lineitem WHERE epoch_us(l_shipdate) // 1000 BETWEEN 800000000000 AND 900000000000 AND l_returnflag = 'R' GROUP BY 1")
def lines_selected(spark: SparkSession, d: str) -> DataFrame:
    """A larger fact: selection by matchers and time, counted by labels."""
    got = sel.select(bridge.line_series(spark, d), bridge.line_samples(spark, d), [Matcher("__name__", "=", "line_price"), Matcher("flag", "=", "R")], 800_000_000_000, 900_000_000_000)
    per = got.groupBy("series_id").agg(F.count("*").alias("n"), F.min("ts_ms").alias("low"), F.max("ts_ms").alias("high")).join(bridge.line_series(spark, d), "series_id")
    grp = F.concat_ws("/", ls.get(F.col("labels"), "flag"), ls.get(F.col("labels"), "status"), ls.get(F.col("labels"), "shard"))
    return per.groupBy(grp.alias("grp")).agg(F.sum("n").alias("n"), F.count("*").alias("series"), F.min("low").alias("low"), F.max("high").alias("high"))
