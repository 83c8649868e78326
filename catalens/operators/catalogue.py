"""The catalogue as one consistent set of tables, from deliveries with repeats, older states and late rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalens import schemas as S
from catalens.session import table


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the newest; ties are settled by all columns, so the choice is the same in every run."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    w = Window.partitionBy(*keys).orderBy(*(F.col(c).desc_nulls_last() for c in order), *(F.col(c).cast("string").asc_nulls_last() for c in rest))
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


@dataclass
class Catalogue:
    """The eleven tables. Optional tables are empty frames of the right type."""

    files: DataFrame
    images: DataFrame
    documents: DataFrame
    videos: DataFrame
    archives: DataFrame
    video_frames: DataFrame
    ocr: DataFrame
    tags: DataFrame
    analyses: DataFrame
    llm_models: DataFrame
    jobs: DataFrame

    def child(self, name: str) -> DataFrame:
        return getattr(self, name)


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], S.SCHEMAS[name])


def archives_of(files: DataFrame) -> DataFrame:
    """Compression and format by name, for catalogues that were delivered without the archives table."""
    name = F.lower("file_name")
    ext = F.regexp_extract(name, r"\.([^.]+)$", 1)
    compression = F.create_map(*(F.lit(x) for kv in {"gz": "gzip", "tgz": "gzip", "bz2": "bzip2", "tbz2": "bzip2", "tbz": "bzip2", "xz": "xz", "txz": "xz", "zst": "zstd", "tzst": "zstd", "lz4": "lz4", "lz": "lzip", "z": "compress", "zip": "zip", "7z": "7z", "rar": "rar", "tar": "none"}.items() for x in kv))
    suffix = F.create_map(*(F.lit(x) for kv in {"gzip": "gz", "bzip2": "bz2", "zstd": "zst", "compress": "Z", "lzip": "lz", "xz": "xz", "lz4": "lz4"}.items() for x in kv))
    tar = name.contains(".tar.") | name.rlike(r"\.(tgz|tbz2?|txz|tzst)$")
    kind = F.coalesce(compression[ext], F.lit("none"))
    return files.filter("kind = 'archive'").select(
        F.col("id").alias("file_id"), kind.alias("compression"),
        F.when(kind == "none", F.lit("tar")).when(kind.isin("zip", "7z", "rar"), kind).when(tar, F.concat(F.lit("tar."), suffix[kind])).otherwise(suffix[kind]).alias("format"),
    )


def frames_of(documents: DataFrame) -> DataFrame:
    """(file_id, ts_secs, description): the "[hh:mm:ss] text" lines of frame notes."""
    lines = documents.filter("doc_kind = 'frames' and file_id is not null").select("file_id", F.explode(F.split("text", "\n")).alias("line"))
    part = lambda i: F.regexp_extract("line", r"^\s*\[(\d+):(\d\d):(\d\d)\]\s*(.*)$", i)
    return (
        lines.filter(F.col("line").rlike(r"^\s*\[\d+:\d\d:\d\d\]"))
        .select("file_id", (part(1).cast("int") * 3600 + part(2).cast("int") * 60 + part(3).cast("int")).cast("double").alias("ts_secs"), part(4).alias("description"))
        .groupBy("file_id", "ts_secs").agg(F.max("description").alias("description"))
    )


def videos_of(frames: DataFrame) -> DataFrame:
    """A videos table from frame notes: only the duration up to the last described frame is known."""
    null = lambda t: F.lit(None).cast(t)
    return frames.groupBy("file_id").agg(F.max("ts_secs").alias("duration_secs")).select(
        "file_id", "duration_secs", null("int").alias("width"), null("int").alias("height"), null("string").alias("video_codec"), null("string").alias("audio_codec"), null("double").alias("fps"), null("string").alias("container"), null("bigint").alias("bitrate")
    )


def jobs_of(orders: DataFrame) -> DataFrame:
    """A job log from an order book: status and kind from the order's flags, counters from its price."""
    n = F.floor("o_totalprice").cast("bigint")
    return orders.select(
        F.concat(F.lit("job-"), F.col("o_orderkey")).alias("id"), F.when(F.col("o_orderpriority") <= "3", "index").otherwise("import_media").alias("kind"), F.lit(None).cast("string").alias("params"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("paused").alias("status"),
        (n % 1000).alias("found"), (n % 700).alias("processed"), (n % 13).alias("failed"), (n % 90).alias("skipped"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("started_at"), F.lit(None).cast("timestamp_ntz").alias("finished_at"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("recent_errors"), (n % 5).alias("removed"), (n % 17).alias("updated"),
    )


def load(spark: SparkSession, sf_dir: str) -> Catalogue:
    """The catalogue of a delivery: repeats dropped, the newest state of each file, one satellite row each."""
    files = latest(S.upgrade(table(spark, sf_dir, "files"), "files"), ["id"], ["indexed_at"])
    frames = frames_of(table(spark, sf_dir, "documents"))
    # copies of a satellite row are equal, so any of them will do and no wide column is compared
    once = lambda name, source: S.upgrade(table(spark, sf_dir, source), name).dropDuplicates(list(S.KEYS[name]))
    return Catalogue(
        files=files, images=once("images", "images"), documents=once("documents", "document_meta"), videos=videos_of(frames), archives=archives_of(files), video_frames=frames,
        ocr=once("ocr", "ocr"), tags=table(spark, sf_dir, "tags").filter("tag is not null").dropDuplicates(["file_id", "tag"]).select("file_id", "tag", "source"),
        analyses=once("analyses", "analyses"), llm_models=S.upgrade(table(spark, sf_dir, "llm_models"), "llm_models"), jobs=jobs_of(table(spark, sf_dir, "orders")),
    )
