"""Incremental reconciliation of a scan with the stored state.

A scan has one row for each file found: root, rel_path, the stat columns and, for files that had to be read, what the
classifier found and the content hash. ``plan`` decides in one join what happens to each file; ``apply`` turns the old
tables into the new ones. Everything is a function of (scan, state): a repeated or lost task gives the same rows.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalens import schemas as S
from catalens.functions import paths
from catalens.operators.catalogue import Catalogue

STAT = ("size_bytes", "mode", "mode_str", "uid", "gid", "mtime", "created")
ACTIONS = ("unchanged", "refresh", "reclassified", "unsupported", "metadata_only", "too_large", "touch", "replace", "insert", "failed", "delete")


def needs_reading(scan: DataFrame, files: DataFrame, metadata_only: Column | None = None) -> DataFrame:
    """The scan rows whose content must be read: all that the stat columns alone do not settle. Listing and comparing
    come first, so that unchanged files are never opened."""
    only = metadata_only if metadata_only is not None else F.lit(False)
    old = files.select("root", "rel_path", F.col("size_bytes").alias("_size"), F.col("mtime").alias("_mtime"), F.col("meta_version").alias("_version"))
    same = (F.col("_size") == F.col("size_bytes")) & F.col("_mtime").eqNullSafe(F.col("mtime")) & (F.coalesce("_version", F.lit(1)) >= S.META_VERSION)
    return scan.join(old, ["root", "rel_path"], "left").filter(~F.coalesce(same, F.lit(False)) & ~only).drop("_size", "_mtime", "_version")


def plan(scan: DataFrame, files: DataFrame, scope_root: str | None = None, scope: str = "", recursive: bool = True, complete: bool = True, max_file_bytes: int = 10_000_000_000, metadata_only: Column | None = None) -> DataFrame:
    """(root, rel_path, action, id, new_id, and the scan's columns as they came): what to do with each file.

    scan: root, rel_path, STAT columns, kind (null if the classifier knows no such file), sha256, error.
    Stored files in the scope that the scan did not see are deleted, if the scan was complete."""
    only = metadata_only if metadata_only is not None else F.lit(False)
    old = files.select("root", "rel_path", *(F.col(c).alias(f"old_{c}") for c in ("id", "size_bytes", "mtime", "sha256", "kind", "summary_status", "meta_version")))
    seen = scan.withColumn("seen", F.lit(True)).withColumn("is_only", only)
    both = seen.join(old, ["root", "rel_path"], "full_outer")
    exists = F.col("old_id").isNotNull()
    version = F.coalesce("old_meta_version", F.lit(1))
    same = exists & (F.col("old_size_bytes") == F.col("size_bytes")) & F.col("old_mtime").eqNullSafe(F.col("mtime"))
    root_ok = F.lit(True) if scope_root is None else F.col("root") == scope_root
    gone = root_ok & paths.in_scope(F.col("rel_path"), scope, recursive) & F.lit(complete)
    action = (
        F.when(F.col("seen").isNull(), F.when(gone, "delete"))
        .when(F.col("error").isNotNull(), "failed")
        .when(F.col("is_only") & same & (version >= S.META_VERSION) & (F.col("old_summary_status") == "skipped"), "unchanged")
        .when(~F.col("is_only") & same & (version >= S.META_VERSION), "unchanged")
        .when(F.col("kind").isNull(), "unsupported")
        .when(~F.col("is_only") & same & (F.col("kind") == F.col("old_kind")), "refresh")
        .when(F.col("is_only"), "metadata_only")
        .when(F.col("size_bytes") > max_file_bytes, "too_large")
        .when(~F.col("is_only") & same, "reclassified")
        .when(exists & (F.col("old_sha256") == F.col("sha256")), "touch")
        .when(exists, "replace")
        .otherwise("insert")
    )
    fresh = F.sha2(F.concat_ws("\0", "root", "rel_path", F.coalesce("sha256", F.lit("")), F.col("size_bytes").cast("string"), F.col("mtime").cast("string")), 256)
    return both.withColumn("action", action).filter("action is not null").withColumn("new_id", F.when(F.col("action").isin("insert", "replace", "metadata_only", "too_large", "reclassified"), fresh)).withColumnRenamed("old_id", "id").drop("seen", "is_only")


def counters(planned: DataFrame) -> DataFrame:
    """One row: found, processed, failed, skipped, updated, removed. From the actions, so retries never count twice."""
    n = lambda *names: F.coalesce(F.sum(F.when(F.col("action").isin(*names), 1)), F.lit(0)).cast("bigint")
    removed = F.coalesce(F.sum(F.when((F.col("action") == "delete") | (F.col("action") == "unsupported") & F.col("id").isNotNull(), 1)), F.lit(0)).cast("bigint")
    return planned.agg(
        n("unchanged", "refresh", "reclassified", "metadata_only", "too_large", "touch", "replace", "insert", "failed").alias("found"),
        n("insert", "replace", "reclassified", "metadata_only").alias("processed"), n("failed").alias("failed"), n("unchanged", "too_large").alias("skipped"), n("touch", "refresh").alias("updated"), removed.alias("removed"),
    )


def unseen(files: DataFrame, seen: DataFrame, root: str, scope: str = "", recursive: bool = True) -> DataFrame:
    """Stored files in the scope that the scan did not see."""
    return files.filter((F.col("root") == root) & paths.in_scope(F.col("rel_path"), scope, recursive)).join(seen.select("root", "rel_path"), ["root", "rel_path"], "left_anti")


def cascade(c: Catalogue, gone: DataFrame) -> Catalogue:
    """The tables without the given files (id) and without their rows in all child tables."""
    ids = gone.select(F.col("id").alias("file_id")).distinct()
    children = {name: c.child(name).join(ids, "file_id", "left_anti") for name in S.CHILDREN}
    return replace(c, files=c.files.join(ids.withColumnRenamed("file_id", "id"), "id", "left_anti"), **children)


def replace_rows(old: DataFrame, new: DataFrame, key: str = "file_id") -> DataFrame:
    """Rows of the new frame instead of the old rows of the same keys."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new.select(*old.columns))


def apply(c: Catalogue, planned: DataFrame, run_ts: str, images: DataFrame | None = None, documents: DataFrame | None = None, archives: DataFrame | None = None) -> Catalogue:
    """The catalogue after a plan. New satellites come keyed by file_id = new_id (or the kept id of refreshed files)."""
    now = F.lit(run_ts).cast("timestamp_ntz")
    dropped = planned.filter("id is not null and action in ('delete', 'unsupported', 'replace', 'metadata_only', 'too_large', 'reclassified')").select("id")
    out = cascade(c, dropped)
    change = planned.filter("action in ('touch', 'refresh')").select("id", "action", *(F.col(x).alias(f"new_{x}") for x in STAT))
    merged = out.files.join(change, "id", "left")
    touched, any_change = F.col("action") == "touch", F.col("action").isNotNull()
    columns = []
    for name in out.files.columns:
        value = F.col(name)
        if name in STAT:
            # a refresh keeps size and mtime, which are equal anyway
            value = F.when(touched if name in ("size_bytes", "mtime") else any_change, F.col(f"new_{name}")).otherwise(value)
        elif name == "meta_version":
            value = F.when(any_change, F.lit(S.META_VERSION)).otherwise(value)
        elif name == "indexed_at":
            value = F.when(any_change, now).otherwise(value)
        columns.append(value.alias(name))
    kept = merged.select(*columns)
    added = planned.filter("new_id is not null")
    status = F.when(F.col("action").isin("metadata_only", "too_large") | (F.col("kind") == "archive"), "skipped").otherwise("pending")
    given = {"id": F.col("new_id"), "indexed_at": now, "meta_version": F.lit(S.META_VERSION), "summary": F.lit(""), "summary_status": status, "file_name": paths.file_name(F.col("rel_path")), "extension": paths.extension(paths.file_name(F.col("rel_path"))),
             "mode_str": paths.mode_string(F.col("mode")), "sha256": F.when(~F.col("action").isin("metadata_only", "too_large"), F.col("sha256"))}
    fresh = added.select(*(given.get(f.name, F.col(f.name) if f.name in added.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in S.SCHEMAS["files"].fields))
    out = replace(out, files=kept.unionByName(fresh.select(*kept.columns)))
    for name, rows in (("images", images), ("documents", documents), ("archives", archives)):
        if rows is not None:
            out = replace(out, **{name: replace_rows(out.child(name), rows)})
    return out


def hash_donors(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, donor_id): for each wanted file (id, sha256) the newest analysed file with the same content."""
    donors = files.filter("summary_status = 'done' and sha256 is not null").select("sha256", F.struct("indexed_at", F.col("id").alias("donor_id")).alias("d"))
    # the two newest donors of a hash suffice, since a file is never its own donor; a popular hash stays one row
    best = _two_newest(donors)
    pairs = wanted.filter("sha256 is not null").join(best, "sha256")
    own = F.col("first.donor_id") == F.col("id")
    return pairs.select("id", F.when(own, F.col("second.donor_id")).otherwise(F.col("first.donor_id")).alias("donor_id")).filter("donor_id is not null")


def _two_newest(donors: DataFrame) -> DataFrame:
    first = donors.groupBy("sha256").agg(F.max("d").alias("first"))
    second = donors.join(first, "sha256").filter(F.col("d.donor_id") != F.col("first.donor_id")).groupBy("sha256").agg(F.max("d").alias("second"))
    return first.join(second, "sha256", "left")


def reuse(c: Catalogue, pairs: DataFrame, mark: bool = False) -> Catalogue:
    """Copies summary, states, models, recognised text and frames of a donor to each (id, donor_id).

    ``mark`` notes the donor in reused_from, as near-duplicates do and exact copies do not."""
    donor = c.files.select(F.col("id").alias("donor_id"), *(F.col(x).alias(f"d_{x}") for x in ("summary", "ocr_status", "summary_model", "ocr_model")))
    got = pairs.join(donor, "donor_id")
    merged = c.files.join(got, "id", "left")
    hit = F.col("donor_id").isNotNull()
    columns = []
    for name in c.files.columns:
        value = F.col(name)
        if name in ("summary", "ocr_status", "summary_model", "ocr_model"):
            value = F.when(hit, F.col(f"d_{name}")).otherwise(value)
        elif name == "summary_status":
            value = F.when(hit, F.lit("done")).otherwise(value)
        elif name == "reused_from" and mark:
            value = F.when(hit, F.col("donor_id")).otherwise(value)
        columns.append(value.alias(name))
    out = replace(c, files=merged.select(*columns))
    for name in ("ocr", "video_frames"):
        rows = c.child(name)
        copied = rows.withColumnRenamed("file_id", "donor_id").join(pairs, "donor_id").withColumnRenamed("id", "file_id").select(*rows.columns)
        out = replace(out, **{name: replace_rows(rows, copied)})
    return out
