"""Relabeling: rules compiled to columns over the label map.

Rules run in order, each on the labels that the one before it left. They run on distinct series, and
samples follow by a join on series_id.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns
from ..functions.bind import bind, once
from ..functions.labelset import canonical, empty, get, merge, put, set_label, sorted_entries

ACTIONS = ("drop", "keep", "dropequal", "keepequal", "replace", "lowercase", "uppercase", "hashmod", "labelmap", "labeldrop", "labelkeep")
#: Rules in one expression.
STEPS = 6
FILTERS = ("drop", "keep", "dropequal", "keepequal")
TARGETED = ("replace", "lowercase", "uppercase", "hashmod", "keepequal", "dropequal")
REFERENCE = re.compile(r"\$(?:\$|\{(\w+)\}|(\w+))")
LABEL_NAME = re.compile(r"[a-zA-Z_]\w*", re.A)
TARGET = re.compile(r"(?:[a-zA-Z_]|\$\w+|\$\{\w+\})(?:\w|\$\w+|\$\{\w+\})*", re.A)


@dataclass(frozen=True)
class Rule:
    source_labels: tuple[str, ...] = ()
    separator: str = ";"
    regex: str = "(.*)"
    modulus: int = 0
    target_label: str = ""
    replacement: str = "$1"
    action: str = "replace"

    @classmethod
    def of(cls, config: dict) -> Rule:
        """From a decoded YAML mapping; actions are read in any case."""
        known = {k: v for k, v in config.items() if k in cls.__dataclass_fields__}
        known["source_labels"] = tuple(known.get("source_labels", ()))
        if "action" in known:
            known["action"] = str(known["action"]).lower()
        return cls(**known)

    def validate(self) -> Rule:
        """This rule, or a ValueError that says what is wrong."""
        if self.action not in ACTIONS:
            raise ValueError(f"no such relabel action: {self.action!r}" if self.action else "a relabel rule names no action")
        try:
            patterns.read(self.regex)
        except patterns.PatternError as e:
            raise ValueError(f"relabel regex: {e}") from e
        if self.action == "hashmod" and self.modulus <= 0:
            raise ValueError("hashmod needs a modulus above 0")
        if self.action in TARGETED:
            if not self.target_label:
                raise ValueError(f"a {self.action} rule has no target label")
            if not (TARGET if self.action == "replace" else LABEL_NAME).fullmatch(self.target_label):
                raise ValueError(f"a {self.action} rule can't write to label {self.target_label!r}")
        if self.action == "labelmap" and not TARGET.fullmatch(self.replacement):
            raise ValueError(f"a labelmap rule can't make names of {self.replacement!r}")
        return self


def config_hash(rules: list[Rule]) -> str:
    """The identity of a chain of rules, under which a mapping made by it may be kept."""
    return hashlib.sha256(json.dumps([asdict(r) for r in rules], sort_keys=True).encode()).hexdigest()


def expand(template: str, regex: str, text: Column) -> Column:
    """The template with its references to groups of regex, matched on the whole text; unknown ones are empty."""
    groups = patterns.read(regex)
    parts, at = [], 0
    for m in REFERENCE.finditer(template):
        parts.append(F.lit(template[at : m.start()]))
        at = m.end()
        name = m[1] or m[2]
        if name is None:
            parts.append(F.lit("$"))
            continue
        n = int(name) if name.isdecimal() else groups.index.get(name, -1)
        if 0 <= n <= groups.groups:
            parts.append(F.coalesce(F.regexp_extract(text, patterns.whole(regex), n), F.lit("")))
    parts.append(F.lit(template[at:]))
    return F.concat(*parts)


def low_md5(text: Column) -> Column:
    """The last 8 bytes of the MD5 as an unsigned number."""
    return F.conv(F.substring(F.md5(text), 17, 16), 16, 10).cast("decimal(20,0)")


def _source(rule: Rule, labels: Column) -> Column:
    return F.concat_ws(rule.separator, *(get(labels, s) for s in rule.source_labels)) if rule.source_labels else F.lit("")


def _keeps(rule: Rule, labels: Column) -> Column:
    source = _source(rule, labels)
    match rule.action:
        case "keep":
            return source.rlike(patterns.whole(rule.regex))
        case "drop":
            return ~source.rlike(patterns.whole(rule.regex))
        case "keepequal":
            return source == get(labels, rule.target_label)
        case _:
            return source != get(labels, rule.target_label)


def _rewrite(rule: Rule, labels: Column) -> Column:
    pattern = patterns.whole(rule.regex)
    target = F.lit(rule.target_label)
    match rule.action:
        case "replace":

            def replaced(source: Column) -> Column:
                given = F.struct(expand(rule.target_label, rule.regex, source).alias("name"), expand(rule.replacement, rule.regex, source).alias("value"))
                fits = lambda g: F.when(g["name"].rlike(r"^[a-zA-Z_][a-zA-Z0-9_]*\z"), set_label(labels, g["name"], g["value"])).otherwise(labels)
                return F.when(source.rlike(pattern), bind(given, fits)).otherwise(labels)

            return bind(_source(rule, labels), replaced)
        case "lowercase":
            return set_label(labels, target, F.lower(_source(rule, labels)))
        case "uppercase":
            return set_label(labels, target, F.upper(_source(rule, labels)))
        case "hashmod":
            return put(labels, target, (low_md5(_source(rule, labels)) % rule.modulus).cast("string"))
        case "labelmap":
            mapped = F.transform(F.filter(sorted_entries(labels), lambda e: e["key"].rlike(pattern)), lambda e: F.struct(expand(rule.replacement, rule.regex, e["key"]).alias("name"), e["value"].alias("value")))
            return F.aggregate(mapped, labels, lambda m, e: set_label(m, e["name"], e["value"]))
        case "labeldrop":
            return F.map_filter(labels, lambda k, _: ~k.rlike(pattern))
        case _:
            return F.map_filter(labels, lambda k, _: k.rlike(pattern))


def relabeled(series: DataFrame, name: str, rules: list[Rule]) -> DataFrame:
    """series with the labels after the rules as column `name`: null if a rule drops the series, empty if no label is left.

    Each rule is a function of one lambda variable that is bound to what the rule before it left, so the plan
    grows with the number of rules. STEPS rules are one expression, so that its depth stays bounded, too.
    """
    labels = F.col("labels")
    for k in range(0, max(1, len(rules)), STEPS):
        for rule in rules[k : k + STEPS]:
            labels = bind(labels, partial(_step, rule.validate()))
        series = once(series, name, labels)
        labels = F.col(name)
    return series


def _step(rule: Rule, m: Column) -> Column:
    if rule.action in FILTERS:
        return F.when(m.isNotNull() & _keeps(rule, m), m)
    return F.when(m.isNotNull(), _rewrite(rule, m))


def only_filters(rules: list[Rule]) -> bool:
    """Whether a chain leaves labels as they are, so that series keep their identity."""
    return all(r.action in FILTERS for r in rules)


def relabel(series: DataFrame, rules: list[Rule]) -> DataFrame:
    """series whose labels went through the rules; dropped ones are gone, and so are those left without labels."""
    out = relabeled(series, "labels", rules)
    out = out.where(F.col("labels").isNotNull() if only_filters(rules) else F.col("labels").isNotNull() & (F.size("labels") > 0))
    if only_filters(rules):
        return out.select(series.columns)
    out = out.withColumn("ls_key", canonical(F.col("labels")))
    if "metric_name" in series.columns:
        out = out.withColumn("metric_name", get(F.col("labels"), "__name__"))
    return out.select([*series.columns, *(["ls_key"] if "ls_key" not in series.columns else [])])


def with_dropped(series: DataFrame, rules: list[Rule]) -> DataFrame:
    """series as they are, with `dropped`: whether the rules drop them or leave no label; one pass."""
    out = F.col("_relabeled")
    gone = out.isNull() if only_filters(rules) else out.isNull() | (F.size(out) == 0)
    return relabeled(series, "_relabeled", rules).withColumn("dropped", gone).drop("_relabeled")


def dropped_by(series: DataFrame, rules: list[Rule]) -> DataFrame:
    """Series that the rules drop, or leave without labels, as they were."""
    return with_dropped(series, rules).where("dropped").drop("dropped")


def dropped_count(series: DataFrame, rules: list[Rule]) -> DataFrame:
    """(dropped, kept): how many series the rules drop and keep."""
    return with_dropped(series, rules).agg(F.count_if("dropped").alias("dropped"), F.count_if(~F.col("dropped")).alias("kept"))


def relabel_samples(series: DataFrame, samples: DataFrame, rules: list[Rule]) -> DataFrame:
    """(ls_key, ts_ms, value) of samples under the labels that the rules leave; those of dropped series are gone.

    Rules run on the series; the fact is joined once, on series_id.
    """
    return samples.join(relabel(series, rules).select("series_id", "ls_key"), "series_id").select("ls_key", "ts_ms", "value")


def external_labels(labels: Column, added: dict[str, str]) -> Column:
    """A destination's labels; a series' own ones win."""
    extra = F.create_map(*(F.lit(x) for kv in sorted(added.items()) for x in kv)) if added else empty()
    return merge(extra, labels)


def target_labels(labels: Column, added: dict[str, str], honor: bool = False) -> Column:
    """A scrape target's labels. On conflict the series' own label moves to exported_<name>, or with honor it stays."""
    if not added:
        return labels
    if honor:
        return external_labels(labels, added)
    for name, value in sorted(added.items()):
        old, kept = get(labels, name), "exported_" + name
        while kept in added:
            kept = "exported_" + kept
        moved = F.when((old != "") & (get(labels, kept) == ""), put(labels, F.lit(kept), old)).when(old != "", put(labels, F.lit("exported_" + kept), old)).otherwise(labels)
        labels = put(moved, F.lit(name), F.lit(value))
    return labels


@dataclass(frozen=True)
class Destination:
    """Where series go: external labels are added, then the rules run."""

    name: str
    external: tuple[tuple[str, str], ...] = ()
    rules: tuple[Rule, ...] = ()

    @property
    def shrinkable(self) -> bool:
        """Whether series keep their labels, so that no mapping is needed."""
        return not self.external and only_filters(list(self.rules))


def output_relabel(series: DataFrame, destinations: list[Destination]) -> DataFrame:
    """(dest, series_id, labels, ls_key): what each destination gets of series(series_id, labels, ls_key).

    Destinations are a configuration, so a branch for each is a short plan; series are the small dimension.
    """
    outs = []
    for d in destinations:
        rows = series.select("series_id", "labels", "ls_key")
        if d.external:
            rows = rows.withColumn("labels", external_labels(F.col("labels"), dict(d.external)))
        rows = relabel(rows, list(d.rules)).withColumn("ls_key", canonical(F.col("labels")))
        outs.append(rows.select(F.lit(d.name).alias("dest"), "series_id", "labels", "ls_key"))
    return reduce(DataFrame.unionByName, outs)


def mapping(series: DataFrame, rules: list[Rule]) -> DataFrame:
    """(config, ls_key, target_labels, target_key) of series(labels, ls_key): nulls where the rules drop a series."""
    rows = relabeled(series.select("ls_key", "labels"), "target_labels", rules).select("ls_key", "target_labels")
    kept = F.when(F.size("target_labels") > 0, F.col("target_labels"))
    return rows.select(F.lit(config_hash(rules)).alias("config"), "ls_key", kept.alias("target_labels"), F.when(kept.isNotNull(), canonical(kept)).alias("target_key"))


def cached_mapping(series: DataFrame, cache: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """(mapping of all series, what of it the cache lacked): rules only run on series that cache, a stored mapping, lacks under them."""
    held = cache.where(F.col("config") == config_hash(rules)).join(series.select("ls_key"), "ls_key", "left_semi").select(cache.columns)
    fresh = mapping(series.join(held.select("ls_key"), "ls_key", "left_anti"), rules)
    return held.unionByName(fresh), fresh


def input_relabel(samples: DataFrame, mapped: DataFrame, shards: int) -> DataFrame:
    """(shard, ls_key, labels, ts_ms, value): samples(ls_key, ts_ms, value) under their target labels, on their target's shard."""
    kept = mapped.where("target_key is not null").select("ls_key", "target_key", "target_labels")
    rows = samples.select("ls_key", "ts_ms", "value").join(kept, "ls_key")
    return rows.select((low_md5(F.col("target_key")) % shards).cast("int").alias("shard"), F.col("target_key").alias("ls_key"), F.col("target_labels").alias("labels"), "ts_ms", "value")


def relabel_stats(samples: DataFrame, known: DataFrame) -> DataFrame:
    """(samples_added, series_added) of a batch (ls_key, ...): series count if known(ls_key) lacks them."""
    per = samples.groupBy("ls_key").agg(F.count("*").alias("n")).join(known.select("ls_key").distinct().withColumn("old", F.lit(1)), "ls_key", "left")
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("samples_added"), F.count_if(F.col("old").isNull()).alias("series_added"))
