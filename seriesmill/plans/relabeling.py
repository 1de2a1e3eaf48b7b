"""Relabeling over the events bridge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labelset import canonical
from ..operators import relabel as rel
from ..operators.relabel import Rule
from ..sources import bridge
from ..sources.limits import Limits, accepted, check
from .registry import AS_KEY, EVENTS, PAIRS, SERIES, query


def _register(name: str, sql: str, *rules: Rule) -> None:
    """Queries return old and new label text of the series that the rules keep."""
    query(f"WITH {SERIES}, {PAIRS} {sql}", name)(lambda s, d: rel.relabel(bridge.event_series(s, d).withColumn("old_key", F.col("ls_key")), list(rules)).select("old_key", "ls_key"))


KEPT = "SELECT ls_key AS old_key, ls_key FROM series WHERE"


def changed(pairs: str) -> str:
    return f"SELECT old_key, {AS_KEY} AS ls_key FROM ({pairs}) WHERE value <> '' GROUP BY old_key"


OLD = "SELECT ls_key AS old_key, name, value FROM pairs"
_register("relabel_drop", f"{KEPT} NOT (user_id % 3 = 0)", Rule(("job",), regex="job0", action="drop"))
_register("relabel_keep", f"{KEPT} regexp_full_match(event_type || ';' || 'c' || (user_id % 2), '(click|view);c1')", Rule(("__name__", "cluster"), regex="(click|view);c1", action="keep"))
_register("relabel_dropequal", f"{KEPT} NOT ('c' || (user_id % 2) = 'c0')", Rule(("cluster",), regex="c(.)", replacement="c0", target_label="want"), Rule(("cluster",), target_label="want", action="dropequal"), Rule(regex="want", action="labeldrop"))
_register("relabel_keepequal", f"{KEPT} user_id % 2 = 0", Rule(("cluster",), regex="c(.)", replacement="c0", target_label="want"), Rule(("cluster",), target_label="want", action="keepequal"), Rule(regex="want", action="labeldrop"))
_register("relabel_replace", changed(f"{OLD} WHERE name <> 'place' UNION ALL SELECT ls_key, 'place', 'i' || (user_id % 10) || '-at-' || (user_id % 2) FROM series"), Rule(("instance", "cluster"), separator="@", regex="(i[0-9])@c([0-9])", replacement="${1}-at-$2", target_label="place"))
_register("relabel_replace_constant", changed(f"{OLD} UNION ALL SELECT ls_key, 'env', 'prod' FROM series"), Rule(replacement="prod", target_label="env"))
_register("relabel_replace_delete", changed(f"{OLD} WHERE name <> 'user'"), Rule(("user",), regex=".*", replacement="", target_label="user"))
_register("relabel_replace_dyn_target", changed(f"{OLD} UNION ALL SELECT ls_key, 'job_' || (user_id % 3), 'yes' FROM series WHERE user_id % 3 < 2"), Rule(("job",), regex="job([01])", replacement="yes", target_label="job_${1}"))
_register("relabel_lowercase", changed("SELECT ls_key AS old_key, name, CASE WHEN name = 'job' THEN lower(value) ELSE value END AS value FROM pairs"), Rule(("job",), target_label="job", action="uppercase"), Rule(("job",), target_label="job", action="lowercase"))
_register("relabel_uppercase", changed(f"{OLD} UNION ALL SELECT ls_key, 'kind', upper(event_type) FROM series"), Rule(("__name__",), target_label="kind", action="uppercase"))
_register("relabel_hashmod", changed(f"{OLD} UNION ALL SELECT ls_key, 'shard', ((('0x' || substr(md5('i' || (user_id % 10) || ';' || user_id), 17, 16))::UBIGINT) % 7)::VARCHAR FROM series"), Rule(("instance", "user"), modulus=7, target_label="shard", action="hashmod"))
_register("relabel_labelmap", changed(f"{OLD} UNION ALL SELECT ls_key, 'meta_' || name, value FROM pairs WHERE name IN ('job', 'user')"), Rule(regex="(job|user)", replacement="meta_$1", action="labelmap"))
_register("relabel_labeldrop", changed(f"{OLD} WHERE NOT regexp_full_match(name, 'user|inst.*')"), Rule(regex="user|inst.*", action="labeldrop"))
_register("relabel_labelkeep", f"SELECT s.ls_key AS old_key, '__name__:' || event_type || ';job:job' || (user_id % 3) || ';' AS ls_key FROM series s", Rule(regex="__name__|job", action="labelkeep"))
_register(
    "relabel_chain",
    changed("SELECT p.ls_key AS old_key, name, CASE WHEN name = 'cluster' THEN 'C' || (user_id % 2) ELSE value END AS value FROM pairs p JOIN series s USING (ls_key) WHERE user_id % 3 <> 2 AND name <> 'instance' UNION ALL SELECT ls_key, 'zone', 'c' || (user_id % 2) || '/' || event_type FROM series WHERE user_id % 3 <> 2"),
    Rule(("job",), regex="job2", action="drop"),
    Rule(("cluster", "__name__"), separator="/", regex="(.+)", target_label="zone"),
    Rule(("cluster",), target_label="cluster", action="uppercase"),
    Rule(regex="instance", action="labeldrop"),
)


LONG = [Rule(("job",), regex="(job.)", replacement=f"$1-{k}", target_label=f"step{k:02d}") for k in range(40)] + [Rule(regex=f"step{k:02d}", action="labeldrop") for k in range(0, 40, 2)]
_register("relabel_long_chain", changed(f"{OLD} UNION ALL SELECT ls_key, 'step' || lpad(k::VARCHAR, 2, '0'), 'job' || (user_id % 3) || '-' || k FROM series, range(1, 40, 2) t(k)"), *LONG)


@query(f"WITH {SERIES} SELECT ls_key AS old_key, user_id % 3 = 0 AS dropped FROM series")
def relabel_dropped(spark: SparkSession, d: str) -> DataFrame:
    series = bridge.event_series(spark, d)
    return rel.with_dropped(series, [Rule(("job",), regex="job0", action="drop")]).select(F.col("ls_key").alias("old_key"), "dropped")


@query(f"WITH {SERIES} SELECT count(*) FILTER (user_id % 3 = 0) AS dropped, count(*) FILTER (user_id % 3 <> 0) AS kept FROM series")
def relabel_dropped_count(spark: SparkSession, d: str) -> DataFrame:
    return rel.dropped_count(bridge.event_series(spark, d), [Rule(("job",), regex="job0", action="drop")])


@query(f"WITH {EVENTS} SELECT replace(ls_key, 'job:job' || (user_id % 3) || ';', 'job:J' || (user_id % 3) || ';') AS ls_key, ts_ms, value FROM ev WHERE user_id % 3 <> 0")
def relabel_samples(spark: SparkSession, d: str) -> DataFrame:
    """Samples under new labels."""
    rules = [Rule(("job",), regex="job0", action="drop"), Rule(("job",), regex="job(.)", replacement="J$1", target_label="job")]
    return rel.relabel_samples(bridge.event_series(spark, d), bridge.event_samples(spark, d), rules)


def _with(name: str, sql: str, column) -> None:  # noqa: ANN001
    query(f"WITH {SERIES}, {PAIRS} {sql}", name)(lambda s, d: bridge.event_series(s, d).select(F.col("ls_key").alias("old_key"), canonical(column()).alias("ls_key")))


ADDED = {"job": "target", "zname": "z"}
_with("external_labels", changed(f"{OLD} UNION ALL SELECT ls_key, 'zname', 'z' FROM series"), lambda: rel.external_labels(F.col("labels"), ADDED))
_with("target_labels", changed("SELECT ls_key AS old_key, CASE WHEN name = 'job' THEN 'exported_job' ELSE name END AS name, value FROM pairs UNION ALL SELECT ls_key, unnest(['job', 'zname']), unnest(['target', 'z']) FROM series"), lambda: rel.target_labels(F.col("labels"), ADDED))
_with("target_labels_honor", changed(f"{OLD} UNION ALL SELECT ls_key, 'zname', 'z' FROM series"), lambda: rel.target_labels(F.col("labels"), ADDED, honor=True))


@query(f"WITH {EVENTS}, old AS (SELECT DISTINCT ls_key FROM ev WHERE event_id % 2 = 0), new AS (SELECT ls_key FROM ev WHERE event_id % 2 = 1) SELECT (SELECT count(*) FROM new) AS samples_added, (SELECT count(DISTINCT ls_key) FROM new WHERE ls_key NOT IN (SELECT ls_key FROM old)) AS series_added")
def relabel_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = bridge.table(spark, d, "events").select("event_id", canonical(bridge.event_labels()).alias("ls_key"))
    return rel.relabel_stats(rows.where("event_id % 2 = 1"), rows.where("event_id % 2 = 0"))


LIMITS = Limits(name_length=8, value_length=7, labels=5, series=400)
BATCHES = f"{SERIES}, {PAIRS}, b AS (SELECT user_id % 10 AS batch_id, ls_key, event_type FROM series), per AS (SELECT batch_id, count(*) AS series, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS long FROM b GROUP BY batch_id)"


def _batches(spark: SparkSession, d: str) -> DataFrame:
    return bridge.event_series(spark, d).select(F.pmod(F.element_at("labels", F.lit("user")).cast("long"), F.lit(10)).alias("batch_id"), "ls_key", F.when(F.col("metric_name") == "purchase", F.col("labels")).otherwise(F.map_filter("labels", lambda k, _: k != "instance")).alias("labels"))


@query(f"WITH {BATCHES} SELECT batch_id, series, CASE WHEN long = 1 THEN 'label value length' WHEN series > 400 THEN 'series per batch' END AS error FROM per")
def limits_violations(spark: SparkSession, d: str) -> DataFrame:
    return check(_batches(spark, d), LIMITS)


@query(f"WITH {BATCHES} SELECT b.batch_id, count(*) AS series FROM b JOIN per USING (batch_id) WHERE per.series <= 75 GROUP BY b.batch_id")
def limits_accepted(spark: SparkSession, d: str) -> DataFrame:
    return accepted(_batches(spark, d), Limits(series=75)).groupBy("batch_id").agg(F.count("*").alias("series"))
