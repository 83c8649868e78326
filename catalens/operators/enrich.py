"""Enrichment: what is to be described or recognised, the calls, and what their answers change."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalens import schemas as S
from catalens.functions import answers, paths, text
from catalens.operators.catalogue import Catalogue
from catalens.plans.request import InvalidRequest

ENRICHED = ("image", "video", "document")
OCR_MODES = ("auto", "always", "never")


def check_request(kinds: list[str] | None = None) -> list[str]:
    kinds = list(kinds) if kinds else list(ENRICHED)
    for k in kinds:
        if k not in ENRICHED:
            raise InvalidRequest(f"kind {k!r} cannot be enriched; allowed: {', '.join(ENRICHED)}")
    return kinds


def candidates(c: Catalogue, kinds: list[str] | None = None, prefix: str | None = None, ids: list[str] | None = None, force: bool = False, ocr_images: str = "auto", ocr_documents: bool = True) -> DataFrame:
    """(id, abs_path, kind, doc_type, do_describe, do_ocr, ...) of the files with work to do.

    Described is what is pending or failed (all if forced). A picture's text is recognised with its description, in
    mode "always" also when that is done; a scanned document's pages when they were not yet, whatever its description."""
    kinds = check_request(kinds)
    f = c.files.filter(F.col("kind").isin(*kinds) & (F.col("summary_status") != "running"))
    if prefix is not None:
        f = f.filter(paths.starts_raw(F.col("abs_path"), prefix))
    if ids is not None:
        f = f.filter(F.col("id").isin(*ids))
    docs = c.documents.select(F.col("file_id").alias("id"), "doc_type", "page_count", F.coalesce("needs_ocr", F.lit(False)).alias("needs_ocr"))
    videos = c.videos.select(F.col("file_id").alias("id"), "duration_secs")
    describe = F.lit(True) if force else F.col("summary_status").isin("pending", "failed")
    open_ocr = F.lit(True) if force else F.col("ocr_status").isNull() | (F.col("ocr_status") == "failed")
    picture = (F.col("kind") == "image") & open_ocr & (F.lit(ocr_images != "never")) & (F.lit(force) | (F.col("summary_status") == "done") | describe)
    pages = (F.col("kind") == "document") & (F.col("doc_type") == "pdf") & F.col("needs_ocr") & open_ocr & F.lit(ocr_documents)
    return (
        f.join(videos, "id", "left").join(docs, "id", "left")
        .select("id", "abs_path", "kind", "doc_type", "page_count", "duration_secs", describe.alias("do_describe"), F.coalesce(picture | pages, F.lit(False)).alias("do_ocr"))
        .filter("do_describe or do_ocr")
    )


def in_path_order(work: DataFrame, limit: int | None = None) -> DataFrame:
    ordered = work.orderBy(F.col("abs_path").asc_nulls_last(), "id")
    return ordered.limit(limit) if limit else ordered


def latest_visible_text(analyses: DataFrame) -> DataFrame:
    """(file_id, visible_text): of the newest picture description of each file that has an object."""
    rows = analyses.filter("prompt_version like 'img-%' and ts_secs is null and parsed is not null and error is null")
    newest = F.max_by(F.get_json_object("parsed", "$.visible_text"), F.struct("created_at", "id"))
    return rows.groupBy("file_id").agg(newest.alias("visible_text"))


def wants_ocr(mode: str, visible_text: Column) -> Column:
    """Whether a picture's text is to be recognised, given what its description saw."""
    if mode not in OCR_MODES:
        raise InvalidRequest(f"ocr mode {mode!r}; allowed: {', '.join(OCR_MODES)}")
    return {"always": F.lit(True), "never": F.lit(False), "auto": F.trim(F.coalesce(visible_text, F.lit(""))) != ""}[mode]


def steps(work: DataFrame, ocr_images: str = "always") -> DataFrame:
    """(id, step, page, ts_secs): one row for each call that the work needs, before any answer is known."""
    none = lambda t: F.lit(None).cast(t)
    row = lambda step, page=None, ts=None: F.struct(F.lit(step).alias("step"), (page if page is not None else none("int")).alias("page"), (ts if ts is not None else none("double")).alias("ts_secs"))
    empty = F.array().cast("array<struct<step:string,page:int,ts_secs:double>>")
    n_pages = F.greatest(F.lit(1), F.least(F.coalesce("page_count", F.lit(1)), F.lit(S.MAX_PDF_PAGES)))
    describe = (
        F.when(F.col("kind") == "image", F.array(row("describe")))
        .when(F.col("kind") == "video", F.concat(F.transform(text.sample_times(F.col("duration_secs")), lambda t: row("frame", ts=t)), F.array(row("merge"))))
        .when(F.col("doc_type") == "pdf", F.array(row("first_page", page=F.lit(1)))).otherwise(F.array(row("summary")))
    )
    recognise = F.when(F.col("kind") == "image", F.array(row("ocr", page=F.lit(1)))).otherwise(F.transform(F.sequence(F.lit(1), n_pages), lambda p: row("ocr", page=p)))
    asked = F.col("do_ocr") & (F.lit(ocr_images != "never") | (F.col("kind") != "image"))
    return work.select("id", F.explode(F.concat(F.when(F.col("do_describe"), describe).otherwise(empty), F.when(asked, recognise).otherwise(empty))).alias("s")).select("id", "s.*")


def call_model(prompts: DataFrame, client: Callable[[dict], dict], model: str, run_ts: str, parallel: int = 1) -> DataFrame:
    """Analyses rows, one for each prompt (id, file_id, prompt_version, prompt, ts_secs). ``client`` takes a row and returns
    content, prompt_tokens, completion_tokens, latency_ms, truncated; an exception becomes the row's error.

    ``parallel`` tasks call at once. Write the result once before using it twice: calls are side effects."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                try:
                    a = client(r)
                    content = a.get("content") or ""
                    error = f"output truncated at max_tokens={a['max_tokens']}" if a.get("truncated") else None if content.strip() else "empty response"
                    out.append((content, a.get("latency_ms"), a.get("prompt_tokens"), a.get("completion_tokens"), error))
                except Exception as e:  # noqa: BLE001 - any failure of a call is the row's result
                    out.append((None, None, None, None, str(e)[:500]))
            done = pd.DataFrame(out, columns=["raw_response", "latency_ms", "prompt_tokens", "completion_tokens", "error"])
            yield pd.concat([pdf[["id", "file_id", "prompt_version", "ts_secs"]].reset_index(drop=True), done], axis=1)

    called = prompts.repartition(parallel).mapInPandas(run, "id string, file_id string, prompt_version string, ts_secs double, raw_response string, latency_ms long, prompt_tokens int, completion_tokens int, error string")
    rows = called.withColumn("model", F.lit(model)).withColumn("created_at", F.lit(run_ts).cast("timestamp_ntz")).withColumn("n_ctx", F.lit(None).cast("int")).withColumn("parsed", answers.answer_object(text.strip_think(F.col("raw_response"))))
    return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in S.SCHEMAS["analyses"].fields))


def page_outcome(pages: DataFrame) -> DataFrame:
    """(file_id, ocr_status, pages, failed) from recognised pages (file_id, page, text, error): done if a page has text,
    none if all are empty, failed if every page failed; single failures are tolerated."""
    ok, bad = F.col("error").isNull(), F.col("error").isNotNull()
    return pages.groupBy("file_id").agg(
        F.when(F.sum(ok.cast("int")) == 0, "failed").when(F.max(F.when(ok, F.length(F.trim("text"))).otherwise(0)) > 0, "done").otherwise("none").alias("ocr_status"),
        F.count("*").alias("pages"), F.sum(bad.cast("int")).alias("failed"),
    )


def set_ocr(c: Catalogue, pages: DataFrame, status: DataFrame, model: str) -> Catalogue:
    """New page texts (file_id, page, text) instead of the old ones; empty pages are not kept."""
    done = status.select("file_id", F.col("ocr_status").alias("new_status"))
    old = c.ocr.join(done, "file_id", "left_anti")
    rows = old.unionByName(pages.filter("text <> ''").select(*c.ocr.columns))
    files = c.files.join(done.withColumnRenamed("file_id", "id"), "id", "left")
    hit = F.col("new_status").isNotNull()
    given = {"ocr_status": F.coalesce("new_status", "ocr_status"), "ocr_model": F.when(F.col("new_status") == "skipped", None).when(hit, F.lit(model)).otherwise(F.col("ocr_model"))}
    return replace(c, ocr=rows, files=files.select(*(given.get(x, F.col(x)).alias(x) for x in c.files.columns)))


def set_summaries(c: Catalogue, outcome: DataFrame, model: str) -> Catalogue:
    """outcome: file_id, summary, error. A summary makes done, an empty one skipped, an error failed."""
    o = outcome.select(F.col("file_id").alias("id"), F.col("summary").alias("new_summary"), F.col("error").alias("new_error"), F.lit(True).alias("hit"))
    files = c.files.join(o, "id", "left")
    good = F.col("hit") & F.col("new_error").isNull() & (F.trim(F.coalesce("new_summary", F.lit(""))) != "")
    state = F.when(F.col("hit").isNull(), F.col("summary_status")).when(F.col("new_error").isNotNull(), "failed").when(good, "done").otherwise("skipped")
    given = {"summary": F.when(good, F.col("new_summary")).otherwise(F.col("summary")), "summary_status": state, "summary_model": F.when(good, F.lit(model)).otherwise(F.col("summary_model"))}
    return replace(c, files=files.select(*(given.get(x, F.col(x)).alias(x) for x in c.files.columns)))


def replace_frames(c: Catalogue, frames: DataFrame) -> Catalogue:
    ids = frames.select("file_id").distinct()
    return replace(c, video_frames=c.video_frames.join(ids, "file_id", "left_anti").unionByName(frames.select(*c.video_frames.columns)))


def merge_inputs(frames: DataFrame) -> DataFrame:
    """(file_id, frames): the described frames in order, each cut to what the merging prompt takes."""
    cut = F.struct("ts_secs", F.left("description", F.lit(S.FRAME_MERGE_CHARS)).alias("description"))
    return frames.groupBy("file_id").agg(F.array_sort(F.collect_list(cut)).alias("frames"))


def record_models(models: DataFrame, seen: DataFrame) -> DataFrame:
    """Upsert by (model, n_ctx): the first sight is kept, everything else is the newest; a null n_ctx is 0."""
    both = models.select(*models.columns).unionByName(seen.select(*models.columns)).withColumn("n_ctx", F.coalesce("n_ctx", F.lit(0))).filter("model is not null")
    rest = [x for x in models.columns if x not in ("model", "n_ctx", "first_seen", "last_seen")]
    newest = F.max_by(F.struct(*rest), F.struct("last_seen", *rest))
    return both.groupBy("model", "n_ctx").agg(newest.alias("r"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")).select("model", "n_ctx", *(f"r.{x}" for x in rest), "first_seen", "last_seen")


def requeue(files: DataFrame) -> DataFrame:
    """What was left running when a process ended is pending again."""
    return files.withColumn("summary_status", F.when(F.col("summary_status") == "running", "pending").otherwise(F.col("summary_status")))


def backfill_models(files: DataFrame, analyses: DataFrame) -> DataFrame:
    """(id, summary_model, ocr_model): the models of the newest good analyses of each file; a reused file has its donor's."""
    good = analyses.filter("error is null")
    key = F.struct("created_at", "id")
    is_ocr = F.col("prompt_version").like("ocr-%")
    own = good.groupBy("file_id").agg(F.max_by(F.when(~is_ocr, F.col("model")), F.when(~is_ocr, key)).alias("s"), F.max_by(F.when(is_ocr, F.col("model")), F.when(is_ocr, key)).alias("o"))
    mine = files.select("id", "reused_from").join(own.withColumnRenamed("file_id", "id"), "id", "left")
    donor = mine.select(F.col("id").alias("reused_from"), F.col("s").alias("ds"), F.col("o").alias("do"), F.lit(True).alias("found"))
    both = mine.join(donor, "reused_from", "left")
    return both.select("id", F.when(F.col("found"), F.col("ds")).otherwise(F.col("s")).alias("summary_model"), F.when(F.col("found"), F.col("do")).otherwise(F.col("o")).alias("ocr_model"))
