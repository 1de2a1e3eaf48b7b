"""A corpus pipeline: from documents to packed training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmill.llm.decontaminate import contamination
from seriesmill.llm.filters import BROADCAST_IDS, LEAST_ID, without_rows
from seriesmill.llm.jaccard_join import jaccard_join
from seriesmill.llm.packing import best_fit_pack
from seriesmill.llm.queries import byte_bpe, table
from seriesmill.llm.scratch import written
from seriesmill.llm.secret_scan import scan
from seriesmill.llm.toxicity import not_toxic, train


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model does not reject; it is fitted on the labelled ones among them."""
    return not_toxic(docs, train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of smallest doc_id, or, where none has an id, of one text.

    Rows that repeat a doc_id or, without one, a text are one document, of which one row stays.
    """
    named, nameless = docs.where("doc_id is not null"), docs.where("doc_id is null").dropDuplicates(["text"])
    ids = named.agg(F.count("*"), F.countDistinct("doc_id")).first()
    if ids[0] != ids[1]:
        named = named.dropDuplicates(["doc_id"])

    def copies(rows: DataFrame) -> DataFrame:
        # An id that stands for a text is below all true ones; where a class has a true one, the least true one stays.
        found = written(jaccard_join(rows), "classes")
        true = written(found.where((F.col("class_id") < LEAST_ID) & (F.col("doc_id") >= LEAST_ID)).groupBy("class_id").agg(F.min("doc_id").alias("stays")), "stays")
        few = true.count() <= BROADCAST_IDS
        return found.join(F.broadcast(true) if few else true, "class_id", "left").where(F.col("doc_id") != F.coalesce("stays", "class_id"))

    return without_rows(named.unionByName(nameless), copies)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return without_rows(docs, lambda rows: contamination(rows, table(spark, sf_dir, "benchmark")))


def drop_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a secret."""

    def holders(rows: DataFrame) -> DataFrame:
        done = scan(rows, ["doc_id"])
        return done.blobs.join(done.findings.select("blob_id").distinct(), "blob_id")

    return without_rows(docs, holders)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, packed into sequences."""
    return best_fit_pack(docs, byte_bpe())


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secret scan", drop_secrets),
    ("best-fit packing", pack),
]

#: The toxicity stage is a fitted model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after another, each on all that its predecessor kept, written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
