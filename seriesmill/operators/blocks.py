"""Time-aligned blocks, their metadata, and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .select import chunked

TWO_HOURS = 2 * 3600 * 1000


def block_start(ts_ms: Column | str, duration: int = TWO_HOURS) -> Column:
    ts = F.col(ts_ms) if isinstance(ts_ms, str) else ts_ms
    return (F.floor(ts / duration) * duration).cast("long")


def with_block(samples: DataFrame, duration: int = TWO_HOURS) -> DataFrame:
    return samples.withColumn("block_start", block_start("ts_ms", duration))


def write_blocks(samples: DataFrame, path: str, duration: int = TWO_HOURS, rows_per_file: int = 5_000_000) -> None:
    """Parquet in a folder for each block, sorted by series and time inside a file.

    Rows go to tasks by block and a part of the series, so that a block that holds most rows is still
    written by many tasks.
    """
    dealt = with_block(samples, duration).withColumn("part", F.pmod(F.xxhash64("series_id"), F.lit(32)))
    ordered = dealt.repartition("block_start", "part").drop("part").sortWithinPartitions("block_start", "series_id", "ts_ms")
    ordered.write.mode("append").option("maxRecordsPerFile", rows_per_file).partitionBy("block_start").parquet(path)


def read_blocks(spark: SparkSession, path: str, mint: int, maxt: int, duration: int = TWO_HOURS) -> DataFrame:
    """Samples of the blocks that [mint, maxt] touches: other folders are pruned."""
    low = mint // duration * duration
    return spark.read.parquet(path).where(F.col("block_start").between(low, maxt) & F.col("ts_ms").between(mint, maxt))


def chunk_stats(samples: DataFrame, size: int = 240) -> DataFrame:
    """(series_id, chunk, min_ts, max_ts, samples, has_more) of each chunk of `size` samples."""
    got = chunked(samples, size).groupBy("series_id", "chunk").agg(F.min("ts_ms").alias("min_ts"), F.max("ts_ms").alias("max_ts"), F.count("*").alias("samples"))
    last = samples.groupBy("series_id").agg(F.floor((F.count("*") - 1) / size).cast("long").alias("last"))
    return got.join(last, "series_id").select("series_id", "chunk", "min_ts", "max_ts", "samples", (F.col("chunk") < F.col("last")).alias("has_more"))


def block_meta(samples: DataFrame, duration: int = TWO_HOURS, chunk: int = 240) -> DataFrame:
    """(block_start, min_time, max_time (exclusive), num_samples, num_series, num_chunks) of each block."""
    per = with_block(samples, duration).groupBy("block_start", "series_id").agg(F.count("*").alias("n"), F.min("ts_ms").alias("low"), F.max("ts_ms").alias("high"))
    return per.groupBy("block_start").agg(
        F.min("low").alias("min_time"),
        (F.max("high") + 1).alias("max_time"),
        F.sum("n").alias("num_samples"),
        F.count("*").alias("num_series"),
        F.sum(F.ceil(F.col("n") / chunk)).cast("long").alias("num_chunks"),
    )


def meta_json(meta: DataFrame, written_ms: int | None = None) -> DataFrame:
    """(block_start, json): a description of each block, as block_meta gives it; with the time of writing also the block's id."""
    stats = F.struct(F.col("num_samples").alias("numSamples"), F.col("num_series").alias("numSeries"), F.col("num_chunks").alias("numChunks"))
    parts = [F.col("min_time").alias("minTime"), F.col("max_time").alias("maxTime"), stats.alias("stats"), F.lit(1).alias("version")]
    if written_ms is not None:
        seed = F.concat_ws("/", "block_start", "min_time", "max_time", "num_samples", "num_series")
        parts.insert(0, block_id(F.lit(written_ms), seed).alias("ulid"))
    return meta.select("block_start", F.to_json(F.struct(*parts)).alias("json"))


def outdated(now_ms: int, max_ts: Column, retention_ms: int) -> Column:
    """Whether a head is so old that it is discarded unwritten."""
    return F.lit(now_ms) - max_ts > retention_ms


def next_rotation(now_ms: Column, phase: Column, duration: int = TWO_HOURS) -> Column:
    """The first time after now that lies `phase` (0 to 1) into a block."""
    shift = F.floor(phase * duration)
    at = F.floor((now_ms - shift) / duration) * duration + shift
    return (at + duration).cast("long")


def persist(samples: DataFrame, plan: DataFrame, path: str, duration: int = TWO_HOURS) -> DataFrame:
    """Writes the samples(head, series_id, ts_ms, value) of heads that plan(id, action) says to write; returns (id, status) after it.

    Heads in one call go together; a failure raises and leaves their records as they are, so the next round
    writes them again, and readers take one of equal samples.
    """
    due = plan.where("action = 'write'").select(F.col("id").alias("head"))
    write_blocks(samples.join(due, "head", "left_semi").drop("head"), path, duration)
    return plan.where("action in ('write', 'discard')").select("id", F.lit("persisted").alias("status"))


#: Fixed value: the digits of block ids.
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def block_id(at_ms: Column, seed: Column) -> Column:
    """A sortable id of 26 digits: 48 bits of time and 80 bits that a hash of seed gives."""

    def digits(bits: Column, n: int) -> Column:
        return F.lpad(F.translate(F.upper(bits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", CROCKFORD), n, "0")

    noise = F.md5(seed)
    return F.concat(digits(F.conv(at_ms.cast("string"), 10, 32), 10), digits(F.conv(F.substring(noise, 1, 10), 16, 32), 8), digits(F.conv(F.substring(noise, 11, 10), 16, 32), 8))
