"""The catalogue of heads: an append-only log of records, of which the last one of each head counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATUSES = ("new", "rotated", "corrupted", "persisted", "active")


def latest(log: DataFrame) -> DataFrame:
    """The last record of each id by updated_at, then by seq; an old corrupted status becomes a flag and rotated."""
    names = [c for c in log.columns if c != "id"]
    last = log.groupBy("id").agg(F.max_by(F.struct(*names), F.struct("updated_at", "seq")).alias("r")).select("id", "r.*")
    broken = F.col("status") == "corrupted"
    return last.withColumns({"corrupted": F.col("corrupted") | broken, "status": F.when(broken, "rotated").otherwise(F.col("status"))})


def live(records: DataFrame) -> DataFrame:
    return records.where(F.coalesce("deleted_at", F.lit(0)) == 0)


def restored(records: DataFrame, now_ms: int, block_ms: int) -> DataFrame:
    """(id, new_status) of live heads that are not persisted: the newest stays active if it is whole, new or active, and within its block; others are rotated."""
    heads = live(records).where("status <> 'persisted'")
    newest = heads.agg(F.max(F.struct("created_at", "id")).alias("last"))
    marked = heads.join(newest, F.lit(True))  # one row
    good = (F.struct("created_at", "id") == F.col("last")) & F.col("status").isin("new", "active") & ~F.col("corrupted") & (F.lit(now_ms) - F.col("created_at") < block_ms)
    return marked.select("id", F.when(good, "active").otherwise("rotated").alias("new_status"))


def collectable(records: DataFrame) -> DataFrame:
    """(id) that may be deleted: from the oldest on up to the first that is still referenced; corrupted ones stay.

    The first referenced head is one aggregate, so no global order is needed.
    """
    heads = live(records)
    first = heads.where("refs > 0").agg(F.min(F.struct("created_at", "id")).alias("first"))
    before = F.col("first").isNull() | (F.struct("created_at", "id") < F.col("first"))
    return heads.join(first, F.lit(True)).where(before & ~F.col("corrupted")).select("id")


def mismatched(last_appended: str, loaded: str):
    """Whether the number of loaded segments differs from what the record says was appended."""
    return F.when(F.col(last_appended).isNull(), F.col(loaded) != 0).otherwise(F.col(last_appended) + 1 != F.col(loaded))


def append(records: DataFrame, path: str) -> None:
    """Adds records to the log; the log is only ever appended to."""
    records.write.mode("append").parquet(path)


def compact(log: DataFrame) -> DataFrame:
    """The log without what it no longer needs: the last record of each head that is not deleted, in today's form."""
    return live(latest(log)).select(log.columns)


def listed(records: DataFrame, where: str, order: list[str]) -> DataFrame:
    """Live heads that a condition holds for, in an order, which the id makes total."""
    return live(records).where(where).orderBy(*order, "id")


def chain_from(records: DataFrame, head: int) -> DataFrame:
    """(id, created_at) of a head and all that were created after it, in order: what a reader that resumes there goes through."""
    heads = live(records)
    start = heads.where(F.col("id") == head).agg(F.min(F.struct("created_at", "id")).alias("start"))
    return heads.join(start, F.lit(True)).where(F.struct("created_at", "id") >= F.col("start")).select("id", "created_at").orderBy("created_at", "id")


def persist_plan(heads: DataFrame, now_ms: int, retention_ms: int, retry_ms: int) -> DataFrame:
    """(id, action) of rotated heads(id, status, corrupted, max_ts, tried_ms, persisted_ms): discard, write, wait or shrink.

    A head whose samples are all older than the retention is discarded unwritten; one whose last attempt is
    less than retry_ms ago waits; a persisted one is kept until the retention after it was written, then shrunk.
    """
    old = F.lit(now_ms) - F.col("max_ts") > retention_ms
    waits = F.coalesce(F.lit(now_ms) - F.col("tried_ms") < retry_ms, F.lit(False))
    persisted = F.col("status") == "persisted"
    shrink = F.coalesce(F.lit(now_ms) - F.col("persisted_ms") > retention_ms, F.lit(False))
    action = F.when(persisted, F.when(shrink, "shrink").otherwise("wait")).when(old, "discard").when(waits, "wait").otherwise("write")
    return heads.where("status in ('rotated', 'persisted')").select("id", action.alias("action"))


def head_to_resume(records: DataFrame, cursors: DataFrame) -> DataFrame:
    """(id): the newest head that holds a cursor(id), or else the newest head."""
    with_cursor = live(records).join(cursors.select("id").withColumn("held", F.lit(1)), "id", "left")
    return with_cursor.agg(F.max(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "created_at", "id")).alias("best")).select("best.id").where("id is not null")
