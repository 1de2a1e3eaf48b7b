"""Incremental secret scanning over content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its text. A ledger says which blob was
scanned under which version of which rule. Only pairs that it lacks are scanned, each blob once
however many paths hold it, and findings are joined back to all paths. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Copies of each finding in the join with paths, so that one blob's paths spread over so many tasks.
SALTS = 16


@dataclass(frozen=True)
class Rule:
    """A pattern that both Java's and RE2's engines read alike, and the least length of one of its groups."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}/{self.version}"


#: Fixed values. A bare run of a class needs no filter afterwards: where a run is too short, no part of it is longer.
BASE = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: Spans beside the base ones: headers of private keys and prefixed access tokens.
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("prefixed", r"gh[pousr]_[A-Za-z0-9]{36,}"),
)


@dataclass(frozen=True)
class Scan:
    """blobs: (path columns, blob_id); findings: a row for each span, of new pairs only; ledger: the new pairs."""

    blobs: DataFrame
    findings: DataFrame
    ledger: DataFrame


def _hit(rule: Rule, unseen: Column) -> Column:
    text, pattern = F.col("text"), F.lit(rule.pattern)
    found = F.struct(
        F.lit(rule.kind).alias("kind"),
        F.lit(rule.version).alias("rule_version"),
        F.transform(F.split(text, rule.pattern, -1), F.length).alias("gaps"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length).alias("sizes"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length).alias("groups"),
    )
    return F.when(unseen & text.rlike(rule.pattern), found)


def scan(versions: DataFrame, paths: list[str], rules: tuple[Rule, ...] = BASE + ADDED, ledger: DataFrame | None = None) -> Scan:
    """Scans the texts of versions(*paths, text) for what the ledger(blob_id, kind, rule_version) lacks.

    findings: blob_id, kind, rule_version, start, end (code points, end exclusive) of the leftmost
    matches of each rule that do not overlap and whose group is long enough. Null text is empty text.
    An empty text has no finding. Repeated rows are paths of one blob. Null paths are kept.
    """
    addressed = versions.select(*paths, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("blob_id", F.sha2("text", 256))
    texts = addressed.groupBy("blob_id").agg(F.first("text").alias("text"))
    if ledger is None:
        texts = texts.withColumn("seen", F.array().cast("array<string>"))
    else:
        known = ledger.groupBy("blob_id").agg(F.collect_set(F.concat_ws("/", "kind", "rule_version")).alias("seen"))
        texts = texts.join(known, "blob_id", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
    unseen = {r: ~F.array_contains("seen", r.key) for r in rules}
    hits = texts.select("blob_id", F.explode(F.array_compact(F.array(*(_hit(r, unseen[r]) for r in rules)))).alias("hit"))
    each = hits.select("blob_id", "hit.kind", "hit.rule_version", F.posexplode(F.arrays_zip("hit.gaps", "hit.sizes", "hit.groups")).alias("k", "m")).where("m.sizes is not null")
    so_far = Window.partitionBy("blob_id", "kind").orderBy("k")
    least = reduce(lambda c, r: c.when(F.col("kind") == r.kind, r.least), rules, F).otherwise(1)
    findings = (
        each.select("blob_id", "kind", "rule_version", F.sum(F.col("m.gaps") + F.col("m.sizes")).over(so_far).alias("end"), F.col("m.sizes").alias("size"), F.col("m.groups").alias("group_size"))
        .where(F.col("group_size") >= least)
        .select("blob_id", "kind", "rule_version", (F.col("end") - F.col("size")).alias("start"), "end")
    )
    pairs = texts.select("blob_id", F.explode(F.array_compact(F.array(*(F.when(unseen[r], F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("rule_version"))) for r in rules)))).alias("p"))
    return Scan(addressed.select(*paths, "blob_id"), findings, pairs.select("blob_id", "p.kind", "p.rule_version"))


def by_path(blobs: DataFrame, per_blob: DataFrame, spread: str) -> DataFrame:
    """blobs left-joined with per_blob on blob_id; a blob that very many paths hold spreads over SALTS tasks."""
    salted = per_blob.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return blobs.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(salted, ["blob_id", "salt"], "left").drop("salt")


def digests(findings: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """(blob_id, n_<kind> of each base rule, base_sha256, spans) of blobs with findings."""
    kinds = [r.kind for r in rules]
    own = [r.kind for r in base]
    order = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))

    def joined(spans: Column) -> Column:
        return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))

    rows = findings.select("blob_id", "kind", F.struct("start", order.alias("order"), "kind", "end").alias("span"))
    grouped = rows.groupBy("blob_id").agg(*(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in own), F.collect_list("span").alias("all"))
    mine = F.filter("all", lambda s: s["kind"].isin(own))
    return grouped.select("blob_id", *(f"n_{k}" for k in own), F.sha2(joined(mine), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"))


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def scan_into(store: str, versions: DataFrame, paths: list[str], rules: tuple[Rule, ...] = BASE + ADDED) -> Scan:
    """As scan, with ledger and findings kept in the folder `store`: only what it lacks is scanned.

    findings are old and new ones under these rules. They are written before the ledger, so a run that
    breaks off between the two scans again; findings that come twice count once. One run at a time.
    """
    spark = versions.sparkSession
    ledger = _stored(spark, f"{store}/ledger", "blob_id string, kind string, rule_version int")
    done = scan(versions, paths, rules, ledger)
    done.findings.write.mode("append").parquet(f"{store}/findings")
    done.ledger.write.mode("append").parquet(f"{store}/ledger")
    kept = _stored(spark, f"{store}/findings", "blob_id string, kind string, rule_version int, start long, end long")
    ours = reduce(lambda c, r: c | ((F.col("kind") == r.kind) & (F.col("rule_version") == r.version)), rules, F.lit(False))
    return Scan(done.blobs, kept.where(ours).distinct(), done.ledger)


def secrets_by_document(documents: DataFrame, store: str | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans), a row for each row of documents(doc_id, text).

    With a store, blobs that it has are not scanned again and keep their findings.
    """
    done = scan(documents, ["doc_id"]) if store is None else scan_into(store, documents, ["doc_id"])
    out = by_path(done.blobs, digests(done.findings), "doc_id")
    zero = [F.coalesce(f"n_{r.kind}", F.lit(0)).cast("long").alias(f"n_{r.kind}") for r in BASE]
    return out.select("doc_id", *zero, F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def sql(rules: tuple[Rule, ...] = BASE + ADDED) -> str:
    """DuckDB's form of secrets_by_document."""

    def part(k: int, r: Rule) -> str:
        p = r.pattern.replace("'", "''")
        return f"SELECT doc_id, {k} AS o, '{r.kind}' AS kind, {r.least} AS least, unnest(range(1, len(regexp_extract_all(t, '{p}')) + 1)) AS k, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}') AS ms, regexp_extract_all(t, '{p}', {r.group}) AS gs FROM docs"

    return (
        "WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), hits AS ("
        + " UNION ALL ".join(part(k, r) for k, r in enumerate(rules))
        + """), ends AS (SELECT doc_id, o, kind, least, length(gs[k]) AS g, length(ms[k]) AS n, sum(length(gaps[k]) + length(ms[k])) OVER (PARTITION BY doc_id, kind ORDER BY k) AS e FROM hits
), spans AS (SELECT doc_id, o, kind, (e - n)::BIGINT AS s, kind || ':' || (e - n)::BIGINT || ':' || e::BIGINT AS x FROM ends WHERE g >= least
), per AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  coalesce(string_agg(x, ',' ORDER BY s, o) FILTER (o < 3), '') AS base, string_agg(x, ',' ORDER BY s, o) AS spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs d LEFT JOIN per USING (doc_id)"""
    )
