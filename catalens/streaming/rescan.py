"""Reconciliation triggered by new files: a file stream whose micro-batches become changes of the catalogue.

Optional: a batch re-scan gives the same state. Deletions are not seen by a file stream and stay with the batch scan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from catalens import schemas as S
from catalens.sources.classify import CLASSIFIED, classify_batches


def arrivals(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """New files of a tree as a stream: path, size_bytes, mtime, sha256 and what they are."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", "true")
    rows = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)
    rows = rows.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").cast("timestamp_ntz").alias("mtime"), F.sha2("content", 256).alias("sha256"), F.substring("content", 1, S.HEADER_BYTES).alias("header"))

    def label(batches):
        for pdf in batches:
            head = pdf[["path", "header"]]
            done = next(classify_batches(iter([head])))
            yield pdf.drop(columns=["header"]).reset_index(drop=True).join(done.drop(columns=["path"]))

    return rows.mapInPandas(label, f"path string, size_bytes long, mtime timestamp_ntz, sha256 string, {CLASSIFIED}")


def follow(stream: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Calls ``on_batch`` for each micro-batch; the batch's number makes repeated deliveries recognisable."""
    writer = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def event_windows(events: DataFrame, minutes: int = 5, late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events by type in windows, with late events kept up to the watermark."""
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", f"{minutes} minutes").alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )
