"""Tables that survive lost executors, in the folder that the whole cluster shares, and bounds of memory."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of text that an operator works on at once. Spark bounds an Arrow batch by bytes, too,
#: but a numpy working set is many times as large as its text.
TEXT_ROWS, TEXT_BYTES = 256, 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in spark.checkpoint.dir; where a session on one machine names none, a new one that it then names."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='seriesmill-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Deletes this application's tables in the shared folder; results not yet read are lost."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text", rows: int = TEXT_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches cut into parts of at most so many rows and TEXT_BYTES of text (or one row)."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        sizes = np.zeros(len(texts), np.int64) if not len(texts) else pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + TEXT_BYTES, side="right"))))
            yield batch.slice(at, stop - at)
            at = stop


@contextmanager
def split_hot_keys(spark: SparkSession) -> Iterator[None]:
    """Inside, adaptive execution may split a hot key of a join even where that costs another shuffle."""
    key = "spark.sql.adaptive.forceOptimizeSkewedJoin"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)
