"""Blocks, stale markers, replica election and open segments under Structured Streaming.

Keys with state are targets, clusters and shards. State is what the next batch needs and no more: the
series of the last scrape, the elected replica, the open segment.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.blocks import with_block
from ..operators.replicas import Elected, decide
from ..operators.wal import decode_segments
from ..sources.scratch import folder


def read(spark: SparkSession, path: str, schema: Any, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_to_end(df: DataFrame, name: str, mode: str = "append", timeout_s: int = 300) -> DataFrame:
    """All that is there now, as a table in the shared folder; a batch that is repeated after a failure replaces itself."""
    path = folder(df.sparkSession, name)

    def keep(batch: DataFrame, batch_id: int) -> None:
        target = f"{path}/batch={batch_id if mode == 'append' else 0}"
        batch.write.mode("overwrite").parquet(target)

    query = df.writeStream.foreachBatch(keep).option("checkpointLocation", folder(df.sparkSession, f"{name}-mark")).outputMode(mode).trigger(availableNow=True).start()
    try:
        if not query.awaitTermination(timeout_s):
            raise TimeoutError(f"{name} did not end within {timeout_s} s")
    finally:
        query.stop()
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/batch=*")


def read_log(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A head's log as it grows: samples of the segments that are new. The checkpoint is the cursor; it moves on after a batch is written."""
    return decode_segments(read(spark, path, "head string, shard int, segment long, samples long, crc long, payload binary", files_per_batch))


def write_blocks(samples: DataFrame, path: str, checkpoint: str, duration: int) -> Any:
    """An exactly-once append of each micro-batch to the folders of its blocks."""
    return with_block(samples, duration).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("block_start").trigger(availableNow=True).start()


def block_counts(samples: DataFrame, duration: int) -> DataFrame:
    """Running (block_start, num_samples, min_time, max_time)."""
    return with_block(samples, duration).groupBy("block_start").agg(F.count("*").alias("num_samples"), F.min("ts_ms").alias("min_time"), (F.max("ts_ms") + 1).alias("max_time"))


def stale(scrapes: DataFrame) -> DataFrame:
    """Markers of scrapes(target, scrape_ts, ls_key): scrapes of a target must come in order, each whole in one micro-batch."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last: set[str] = set(state.get[0]) if state.exists else set()
        rows = pd.concat(list(frames))
        out = []
        for ts, group in sorted(rows.groupby("scrape_ts")["ls_key"]):
            now = set(group)
            out += [(key[0], int(ts), k) for k in sorted(last - now)]
            last = now
        state.update((sorted(last),))
        yield pd.DataFrame(out, columns=["target", "scrape_ts", "ls_key"]).astype({"scrape_ts": "int64"})

    return scrapes.groupBy("target").applyInPandasWithState(fold, "target string, scrape_ts long, ls_key string", "active array<string>", "append", GroupStateTimeout.NoTimeout)


def replicas(batches: DataFrame) -> DataFrame:
    """batches(batch_id, cluster, replica, now_s) with `dropped`."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = Elected(*state.get) if state.exists else Elected()
        rows = pd.concat(list(frames)).sort_values(["now_s", "batch_id"])
        dropped = []
        for replica, at in zip(rows["replica"].tolist(), rows["now_s"].tolist(), strict=True):
            now, drop = decide(now, replica, int(at))
            dropped.append(drop)
        state.update((now.replica, now.at))
        yield rows[["batch_id", "cluster", "replica", "now_s"]].assign(dropped=dropped)

    return batches.groupBy("cluster").applyInPandasWithState(fold, "batch_id long, cluster string, replica string, now_s long, dropped boolean", "replica string, at long", "append", GroupStateTimeout.NoTimeout)


def deliver(batch: DataFrame, batch_id: int, send: Any, attempts: int = 5, wait_s: float = 0.1) -> None:
    """For foreachBatch: sends a micro-batch until it is delivered, at least once; gives up with the last error.

    `send(rows, batch_id)` is called on the driver with a DataFrame and should write it in parallel. A
    ConnectionError or TimeoutError is tried again after a wait that doubles. The checkpoint moves on only
    after this returns.
    """
    import time

    for k in range(attempts):
        try:
            send(batch, batch_id)
            return
        except (ConnectionError, TimeoutError):
            if k == attempts - 1:
                raise
            time.sleep(wait_s * 2**k)
