"""Exact deduplication by stateful streaming, in DataFrame operations only.

A stream over the documents' files keeps, for each digest of the normalised text, keyed state without expiry in the
disk-backed (RocksDB) store: how many rows had it, and the stable identifier and content locator (file and row) of the
row that stays.  Rows that hit a digest are then compared with the kept row's full text, fetched by the locator; texts
that only share a digest are grouped by their bytes instead.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, join_salted, join_to_unique, only_slots_of, scratch_path, write_table

#: Fixed value: the characters that normalisation deletes.
DELETED = r"[\x20\x09-\x0D]"
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _keyed(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    norm = F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), DELETED, "")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.char_length(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("chars"),
        F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("place"),
        norm.alias("norm"),
    ).withColumns({"sha": F.sha2("norm", 256), "digest": digest(F.col("norm"))})


#: The greatest of a group stays: most code points, then least doc_id (null last), then first place.
def _rank() -> Column:
    return F.struct(F.col("chars"), (-F.col("doc_id")).alias("less"), F.col("doc_id"), F.col("place"))


def _literal(path: str) -> str:
    """A path that Spark would read as a pattern, escaped."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _stream_path(spark: SparkSession, path: str) -> str:
    """A stream takes a folder or a pattern: a single file becomes a pattern that only it matches."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    single = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile()
    return f"{_literal(path[:-1])}[{path[-1]}]" if single else _literal(path)


def stream_state(spark: SparkSession, path: str, digest: Callable[[Column], Column], files_per_trigger: int | None = None) -> DataFrame:
    """(digest, best, n) of each digest after the stream has read every file below ``path``."""
    schema = spark.read.parquet(_literal(path)).schema
    ledger, checkpoint = scratch_path(spark, "ledger"), scratch_path(spark, "stream")
    if _literal(path) != path:  # Spark reads a batch of files below an escaped path once for each file
        files_per_trigger = 1
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader.option("maxBytesPerTrigger", str(64 << 30))
    state = _keyed(reader.parquet(_stream_path(spark, path)), digest).groupBy("digest").agg(F.max(_rank()).alias("best"), F.count("*").alias("n"))

    def keep(batch: DataFrame, number: int) -> None:  # runs in the driver; a repeated batch overwrites itself
        batch.write.mode("overwrite").parquet(f"{ledger}/batch={number}")

    with settings(spark, STATE_STORE):
        query = state.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start()
        query.awaitTermination()
    empty = spark.createDataFrame([], state.schema).withColumn("batch", F.lit(0))
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return empty.drop("batch")
    updates = spark.read.schema(empty.schema).parquet(ledger)
    return updates.groupBy("digest").agg(F.max_by(F.struct("best", "n"), "batch").alias("s")).select("digest", "s.best", "s.n")


def exact_dedup(spark: SparkSession, path: str, digest: Callable[[Column], Column] | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of the Parquet file or folder ``path``.

    Texts are equal when identical without the characters of ``DELETED``; a null text counts as empty.  Of equal texts
    the row with the most code points stays, then the least doc_id (null last), then the first in the files: of
    repeated rows one is kept.  A text of any length goes as its digest through the state; only texts of a shared digest
    are compared whole.  Other columns aren't read; an empty table gives an empty result.
    """
    digest = digest or (lambda norm: F.unhex(F.sha2(norm, 256)))
    state = write_table(stream_state(spark, path, digest, files_per_trigger), "state")
    several = state.where("n > 1")
    docs = _keyed(spark.read.parquet(_literal(path)), digest)
    total = state.agg(F.sum("n")).first()[0] or 0

    texts = write_table(only_slots_of(docs, "digest", several, "digest"), "texts")
    kept_text = texts.join(several.select("digest", F.col("best.place").alias("place"), "n"), ["digest", "place"]).select("digest", F.col("norm").alias("kept_norm"), "n")
    other = join_salted(texts, kept_text, "digest", total, "place").where("norm <> kept_norm").select("digest").distinct()
    other = write_table(other, "collisions")

    rows = docs.select("doc_id", "sha", "digest", "place")
    if other.isEmpty():
        discard(texts)
        grouped = join_to_unique(rows, state, "digest", total)
    else:  # digests that different texts share: their rows are grouped by the bytes
        shared = texts.join(other, "digest", "left_semi")
        exact = shared.groupBy("digest", "norm").agg(F.max(_rank()).alias("best"), F.count("*").alias("n"))
        alone = join_to_unique(rows, state.join(other, "digest", "left_anti"), "digest", total)
        columns = ["digest", "doc_id", "sha", "place", "best", "n"]
        grouped = alone.select(columns).unionByName(shared.join(exact, ["digest", "norm"]).select(columns))
    return grouped.select("doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("place") == F.col("best.place")).alias("kept"), F.col("sha").alias("text_sha256"))
