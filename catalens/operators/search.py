"""Search: filters over the catalogue, text scores, totals, pages and hits with their parts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalens import schemas as S
from catalens.functions import paths
from catalens.operators import textindex
from catalens.operators.catalogue import Catalogue
from catalens.plans.request import Plan, compile_request

SATELLITES = ("images", "documents", "videos", "archives")


def _satellite(c: Catalogue, name: str, columns: list[str] | None = None) -> DataFrame:
    rows = c.child(name)
    columns = columns or [x for x in rows.columns if x not in ("file_id", "content")]
    return rows.select(F.col("file_id").alias("id"), *(F.col(x).alias(f"{name}_{x}") for x in columns))


def matches(c: Catalogue, plan: Plan, index: textindex.TextIndex | None = None) -> DataFrame:
    """(id, abs_path, score): all files that fulfil the request, narrow, before any wide column is read.

    Only the satellites that a predicate needs are joined; tags are a semi join; a text without an index is searched
    in the bodies."""
    base = c.files
    for name in SATELLITES:
        if name in plan.tables:
            base = base.join(_satellite(c, name), "id", "left")
    found = base.filter(plan.predicate).select("id", "abs_path")
    if plan.tags:
        tagged = c.tags.filter(F.lower("tag").isin(*(F.lower(F.lit(t)) for t in plan.tags))).select(F.col("file_id").alias("id")).distinct()
        found = found.join(tagged, "id", "left_semi")
    if plan.text is None:
        return found.withColumn("score", F.lit(None).cast("double"))
    if index is not None:
        return found.join(textindex.bm25(index, plan.text).withColumnRenamed("file_id", "id"), "id")
    body = textindex.bodies(c).select(F.col("file_id").alias("id"), textindex.substring_score(F.col("body"), plan.terms).alias("score"))
    return found.join(body.filter("score > 0"), "id")


def page(found: DataFrame, plan: Plan) -> DataFrame:
    order = ([F.col("score").desc_nulls_last()] if plan.text is not None else []) + [F.col("abs_path").asc_nulls_last(), F.col("id").asc()]
    return found.orderBy(*order).offset(plan.offset).limit(plan.limit)


def ocr_texts(c: Catalogue, chars: int = S.OCR_CHARS) -> DataFrame:
    """(id, ocr_text): pages in order, a line end between them, cut to ``chars`` characters."""
    return textindex.joined_text(c.ocr, "text", "page", "\n", "t").select(F.col("file_id").alias("id"), F.left("t", F.lit(chars)).alias("ocr_text"))


def rows(c: Catalogue, ids: DataFrame) -> DataFrame:
    """The wide rows of a page: contents and recognised text are read for its ids only."""
    ids = F.broadcast(ids)  # a page: at most MAX_LIMIT rows
    wide = ids.join(c.files.drop("abs_path"), "id")
    docs = c.documents.join(ids.select(F.col("id").alias("file_id")), "file_id", "left_semi")
    docs = docs.select(F.col("file_id").alias("id"), "doc_type", "page_count", F.left("content", F.lit(S.SNIPPET_CHARS)).alias("snippet"), "language", "encoding")
    ocr = ocr_texts(Catalogue(**{**c.__dict__, "ocr": c.ocr.join(ids.select(F.col("id").alias("file_id")), "file_id", "left_semi")}))
    wide = wide.join(docs, "id", "left").join(ocr, "id", "left")
    for name in ("images", "videos", "archives"):
        wide = wide.join(_satellite(c, name), "id", "left")
    return wide


def matched_frames(c: Catalogue, ids: DataFrame, terms: list[str], most: int = S.FRAMES_PER_HIT) -> DataFrame:
    """(file_id, ts_secs, description): the first frames of each file that contain one of the terms.

    Terms are patterns here: % and _ in them are wildcards, a backslash stands for itself."""
    any_term = F.lit(False)
    for t in terms:
        any_term = any_term | F.col("description").ilike("%" + t.replace("\\", "\\\\") + "%")
    hit = c.video_frames.join(F.broadcast(ids.select(F.col("id").alias("file_id"))), "file_id", "left_semi").filter(any_term)
    rank = F.row_number().over(Window.partitionBy("file_id").orderBy("ts_secs"))
    return hit.withColumn("_r", rank).filter(F.col("_r") <= most).select("file_id", "ts_secs", "description")


def hits(wide: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """The nested form of a page: image, video and archive by kind, document where there is one, frames of text hits."""
    pick = lambda name, columns: F.struct(*(F.col(f"{name}_{x}").alias(x) for x in columns))
    if frames is not None:
        lists = frames.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("ts_secs", "description"))).alias("matched_frames"))
        wide = wide.join(lists.withColumnRenamed("file_id", "id"), "id", "left")
    else:
        wide = wide.withColumn("matched_frames", F.lit(None).cast("array<struct<ts_secs:double,description:string>>"))
    plain = ["id", "root", "rel_path", "abs_path", "file_name", "extension", "kind", "mime", "size_bytes", "mode_str", "uid", "gid", "mtime", "created", "sha256", "summary", "summary_status", "ocr_status", "ocr_text", "summary_model", "ocr_model", "indexed_at", "score"]
    return wide.select(
        *plain, paths.mode_octal(F.col("mode")).alias("mode"),
        F.when(F.col("kind") == "image", pick("images", ["format", "width", "height"])).alias("image"),
        F.when(F.col("doc_type").isNotNull(), F.struct("doc_type", "page_count", "snippet", "language", "encoding")).alias("document"),
        F.when(F.col("kind") == "video", pick("videos", ["duration_secs", "width", "height", "video_codec", "audio_codec", "fps", "container", "bitrate"])).alias("video"),
        F.when(F.col("kind") == "archive", pick("archives", ["compression", "format"])).alias("archive"), "matched_frames",
    )


@dataclass
class Result:
    total: int
    hits: DataFrame
    limit: int
    offset: int
    text_mode: str | None


def search(c: Catalogue, request: dict, index: textindex.TextIndex | None = None) -> Result:
    """Answers a request. The total is that of all matches, also for a page beyond the end."""
    plan = compile_request(request)
    found = matches(c, plan, index).cache()
    try:
        total = found.count()
        ids = page(found, plan)
        kept = c.files.sparkSession.createDataFrame(ids.collect(), ids.schema)  # one page
    finally:
        found.unpersist()
    frames = matched_frames(c, kept, plan.terms) if plan.text is not None else None
    order = ([F.col("score").desc_nulls_last()] if plan.text is not None else []) + [F.col("abs_path").asc_nulls_last(), F.col("id").asc()]
    mode = None if plan.text is None else "fts" if index is not None else "substring"
    return Result(total, hits(rows(c, kept), frames).orderBy(*order), plan.limit, plan.offset, mode)


def by_id(c: Catalogue, file_id: str) -> DataFrame:
    return c.files.filter(F.col("id") == file_id).select("id", "root", "rel_path", "abs_path", "file_name", "kind", "mime", "size_bytes", "mtime", "sha256", "summary", "summary_status", "indexed_at")


def document_texts(c: Catalogue) -> DataFrame:
    """(id, file_name, doc_type, content) of the documents, for summaries."""
    docs = c.documents.select(F.col("file_id").alias("id"), "doc_type", F.coalesce("content", F.lit("")).alias("content"))
    return c.files.select("id", "file_name").join(docs, "id")
