"""Jobs, deletion previews, work estimates and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalens import schemas as S
from catalens.functions import paths, text
from catalens.plans.request import InvalidRequest

# ---------------------------------------------------------------- jobs


def job_list(jobs: DataFrame, live: DataFrame | None = None, rows: int = S.JOB_ROWS) -> DataFrame:
    """The newest jobs; the counters of running ones come from the live table, where they are newer than what is stored."""
    if live is not None:
        over = live.select("id", *(F.col(c).alias(f"_{c}") for c in jobs.columns if c != "id"))
        jobs = jobs.join(over, "id", "left").select("id", *(F.coalesce(f"_{c}", c).alias(c) for c in jobs.columns if c != "id"))
    jobs = jobs.withColumn("removed", F.coalesce("removed", F.lit(0).cast("bigint"))).withColumn("updated", F.coalesce("updated", F.lit(0).cast("bigint")))
    return jobs.orderBy(F.col("started_at").desc_nulls_last(), "id").limit(rows)


def progress(jobs: DataFrame) -> DataFrame:
    """(id, status, percent): settled files of those found, at most 100."""
    done = F.col("processed") + F.col("failed") + F.col("skipped")
    return jobs.select("id", "status", F.when(F.col("found") > 0, F.round(F.least(F.lit(100.0), 100.0 * done / F.col("found")), 4)).otherwise(0.0).alias("percent"))


def recent_errors(jobs: DataFrame) -> DataFrame:
    """(id, path, error): the stored error lists as rows."""
    return jobs.select("id", F.explode(F.from_json("recent_errors", "array<struct<path:string,error:string>>")).alias("e")).select("id", "e.path", "e.error")


def interrupt_running(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("status", F.when(F.col("status") == "running", "interrupted").otherwise(F.col("status")))


# ---------------------------------------------------------------- deletion


def select_for_deletion(files: DataFrame, ids: list[str] | None = None, prefix: tuple[str, str] | None = None) -> DataFrame:
    """Files by id, by (root, relative prefix), or both; each file once."""
    if not ids and prefix is None:
        raise InvalidRequest("ids or a path prefix is needed")
    if ids and len(ids) > S.MAX_DELETE_IDS:
        raise InvalidRequest(f"at most {S.MAX_DELETE_IDS} ids")
    wanted = F.col("id").isin(*ids) if ids else F.lit(False)
    if prefix is not None:
        root, rel = prefix
        wanted = wanted | (F.col("root") == root) & paths.within(F.col("rel_path"), rel)
    return files.filter(wanted).dropDuplicates(["id"])


def deletion_preview(selected: DataFrame) -> DataFrame:
    """(kind, files, bytes) with a total in the row of kind null."""
    return selected.rollup("kind").agg(F.count("*").alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))


def deletion_sample(selected: DataFrame, rows: int = S.SAMPLE_ROWS) -> DataFrame:
    return selected.orderBy("id").limit(rows).select("id", "rel_path")


# ---------------------------------------------------------------- estimate

#: Categories by file extension.
CATEGORIES = {
    "image": "jpg jpeg png gif webp bmp tif tiff",
    "video": "mp4 m4v mov mkv webm avi ogv wmv mpg mpeg flv",
    "pdf": "pdf",
    "archive": "gz tgz bz2 tbz tbz2 xz txz zst tzst lz4 lz z zip 7z rar tar",
    "text": "md markdown txt text log csv tsv rst adoc org srt vtt",
}


def category(name: Column, code: list[str], code_names: list[str]) -> Column:
    """``code``: extensions and ``code_names``: whole names that are source code."""
    lower = F.lower(name)
    ext = F.regexp_extract(lower, r"\.([^.]*)$", 1)
    out = F.when(lower.isin(*code_names), "code").when(lower.rlike(r"\.tar\.(gz|bz2|xz|zst)$"), "archive")
    for cat, exts in CATEGORIES.items():
        out = out.when(ext.isin(*exts.split()), cat)
    return out.when(ext.isin(*code), "code").otherwise("other")


def _code() -> tuple[list[str], list[str]]:
    from catalens.sources.classify import LANGUAGES, NAMES

    return [e for exts in LANGUAGES.values() for e in exts.split()], list(NAMES)


def estimate(files: DataFrame, max_file_bytes: int = 10_000_000_000) -> DataFrame:
    """(category, files, bytes, too_large, calls_min, calls_max): the calls that describing all files would take, without
    videos; a picture may need a second call for its text."""
    cat = category(F.col("file_name"), *_code())
    large = F.col("size_bytes") > max_file_bytes
    rows = files.withColumn("category", cat).groupBy("category").agg(
        F.count("*").alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.when(large & (F.col("category") != "other"), 1)), F.lit(0)).alias("too_large"))
    able = F.col("files") - F.col("too_large")
    least = F.when(F.col("category").isin("image", "pdf", "text", "code"), able).otherwise(0)
    return rows.select("category", "files", "bytes", "too_large", least.alias("calls_min"), (least + F.when(F.col("category") == "image", able).otherwise(0)).alias("calls_max"))


def other_extensions(files: DataFrame, rows: int = 15) -> DataFrame:
    """The most frequent extensions of files in no category; equal counts by name."""
    other = files.filter(category(F.col("file_name"), *_code()) == "other")
    ext = F.when(F.instr("file_name", ".") > 0, F.lower(F.regexp_extract("file_name", r"\.([^.]*)$", 1))).otherwise("(none)")
    return other.groupBy(ext.alias("extension")).agg(F.count("*").alias("files")).orderBy(F.desc("files"), "extension").limit(rows)


def video_estimate(videos: DataFrame, interval: int = 60, most: int = 120) -> DataFrame:
    """One row: videos, seconds, unknown durations, frames and calls (frames and one merge for each video)."""
    known = F.coalesce(F.col("duration_secs") > 0, F.lit(False))
    frames = F.when(known, text.estimated_frames(F.col("duration_secs"), interval, most))
    return videos.agg(
        F.count("*").alias("videos"), F.coalesce(F.sum(F.when(known, F.col("duration_secs"))), F.lit(0.0)).alias("seconds"), F.sum((~known).cast("int")).alias("unknown"),
        F.coalesce(F.sum(frames), F.lit(0)).alias("frames"), F.coalesce(F.sum(frames + 1), F.lit(0)).alias("calls"))


# ---------------------------------------------------------------- audit


def prompt_audit(analyses: DataFrame) -> DataFrame:
    """(prompt_version, answers, avg_latency, errors)."""
    return analyses.groupBy("prompt_version").agg(F.count("*").alias("answers"), F.round(F.avg("latency_ms"), 6).alias("avg_latency"), F.count("error").alias("errors"))
