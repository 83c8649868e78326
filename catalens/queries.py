"""The queries of the catalogue operators by name, and the SQL that states the same results.

Both read the whole tables of a delivery. Results that SQL cannot state (stemming, greedy passes, parsing of answers)
have no SQL and are tested against fixtures.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalens import schemas as S
from catalens.functions import answers, paths, text
from catalens.operators import catalogue, dedup, enrich, reconcile, reports, search, textindex
from catalens.plans.request import compile_request
from catalens.session import table
from catalens.sources import classify

Query = Callable[[SparkSession, str], DataFrame]
load = catalogue.load

# ---------------------------------------------------------------- search

REQUESTS: dict[str, dict] = {
    "search_exact_range": {"q": {"kind": "Document", "doc_type": ["code", "Markdown"], "size_bytes": {"gte": 1000}}},
    "search_contains_escaped": {"q": {"name": "_1", "path": "A"}, "limit": 200},
    "search_number_coalesce": {"q": {"width": {"gte": 1000, "lt": 3000}, "height": {"gt": "10"}}, "limit": 50},
    "search_time_day": {"q": {"mtime": "2025-01-22"}},
    "search_time_range": {"q": {"indexed_at": {"gte": "2025-03-01", "lt": "2025-05-01T02:00:00+02:00"}}, "limit": 100},
    "search_mode_octal": {"q": {"mode": "0o644"}},
    "search_tag_semi": {"q": {"tag": ["ARCH", "barge"]}, "limit": 100},
    "search_list_any": {"q": {"extension": ["JPG", "pdf"], "root": "photo-share"}, "limit": 30},
    "search_page_total": {"q": {"kind": "image"}, "limit": 50, "offset": 40},
    "search_substring_score": {"q": {"text": "ferry brücke 17"}, "limit": 100},
}
WHERE = {
    "search_exact_range": "lower(kind) in ('document') and lower(doc_type) in ('code', 'markdown') and size_bytes >= 1000",
    "search_contains_escaped": r"file_name ilike '%\_1%' escape '\' and abs_path ilike '%a%'",
    "search_number_coalesce": "coalesce(i.width, v.width) >= 1000 and coalesce(i.width, v.width) < 3000 and coalesce(i.height, v.height) > 10",
    "search_time_day": "mtime >= timestamp '2025-01-22' and mtime < timestamp '2025-01-23'",
    "search_time_range": "indexed_at >= timestamp '2025-03-01' and indexed_at < timestamp '2025-05-01'",
    "search_mode_octal": "mode = 420",
    "search_tag_semi": "exists (select 1 from t where t.file_id = f.id and lower(t.tag) in ('arch', 'barge'))",
    "search_list_any": "lower(extension) in ('jpg', 'pdf') and lower(root) = 'photo-share'",
    "search_page_total": "kind = 'image'",
}


def _page(spark: SparkSession, sf_dir: str, request: dict, index=None) -> DataFrame:
    c, plan = load(spark, sf_dir), compile_request(request)
    found = search.matches(c, plan, index(c) if index else None)
    total = found.agg(F.count("*").alias("total"))
    return search.page(found, plan).join(F.broadcast(total)).select("id", "abs_path", F.round("score", 6).alias("score"), "total")


def _index(c, stem: bool):
    return textindex.build(textindex.bodies(c), stem=stem, stop_words=textindex.stemming.STOP_WORDS if stem else frozenset())


def _bm25(spark: SparkSession, sf_dir: str, stem: bool, query: str) -> DataFrame:
    return textindex.bm25(_index(load(spark, sf_dir), stem), query).select("file_id", F.round("score", 6).alias("score"))


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(load(spark, sf_dir), False)
    return index.postings.groupBy("term").agg(F.count("*").alias("files"), F.sum("tf").alias("uses"))


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir)
    return search.matched_frames(c, c.files.select("id"), ["ferry", "br_cke"])


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, plan = load(spark, sf_dir), compile_request({"q": {"text": "ferry", "size_bytes": {"gte": 1}}, "limit": 200})
    ids = search.page(search.matches(c, plan), plan)
    h = search.hits(search.rows(c, ids), search.matched_frames(c, ids, plan.terms))
    return h.select("id", "mode", F.col("image.width").alias("image_width"), F.col("document.doc_type").alias("doc_type"), F.col("document.snippet").alias("snippet"), F.col("archive.format").alias("archive_format"), F.col("video.duration_secs").alias("video_secs"), F.size("matched_frames").alias("frames"), "ocr_text", "score")


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir)
    out = c.files.select("id", "kind")
    for name, columns in (("images", ["format", "width"]), ("documents", ["doc_type", "page_count"]), ("videos", ["duration_secs"]), ("archives", ["compression", "format"])):
        out = out.join(search._satellite(c, name, columns), "id", "left")
    return out


# ---------------------------------------------------------------- reconciliation


def _rescan(spark: SparkSession, sf_dir: str) -> tuple[catalogue.Catalogue, DataFrame, DataFrame]:
    """(stored catalogue, scan, plan): the newest states of the delivery as a scan of what an older run stored.

    Stored are the oldest states without a few extensions; the scan lacks others, so that files come, change and go."""
    raw = S.upgrade(table(spark, sf_dir, "files"), "files")
    w = catalogue.Window.partitionBy("id").orderBy("indexed_at", "size_bytes")
    stored = raw.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r").filter("coalesce(extension, '') not in ('png', 'sh')")
    scan = catalogue.latest(raw, ["id"], ["indexed_at"]).filter("coalesce(extension, '') not in ('gif', 'tf')")
    scan = scan.select("root", "rel_path", "abs_path", *reconcile.STAT, F.when(F.col("extension") != "php", F.col("kind")).alias("kind"), "mime", "sha256", F.when(F.col("extension") == "go", "unreadable").alias("error"))
    c = load(spark, sf_dir)
    c = catalogue.Catalogue(**{**c.__dict__, "files": stored})
    only = paths.Excludes(["*.cfg"]).column(F.col("rel_path"))
    return c, scan, reconcile.plan(scan, stored, max_file_bytes=1_000_000_000, metadata_only=only)


STATE_SQL = f"""
    stored as (select * from (select *, row_number() over (partition by id order by indexed_at, size_bytes) r from files) where r = 1 and coalesce(extension, '') not in ('png', 'sh')),
    scan as (select root, rel_path, size_bytes, mode, mtime, created, sha256, case when extension <> 'php' then kind end as kind, case when extension = 'go' then 'unreadable' end as error,
             rel_path like '%.cfg' as is_only from f where coalesce(extension, '') not in ('gif', 'tf')),
    plan as (select coalesce(n.root, s.root) as root, coalesce(n.rel_path, s.rel_path) as rel_path, s.id, n.size_bytes, n.mtime, n.mode,
      case when n.root is null then 'delete' when n.error is not null then 'failed'
           when n.is_only and s.id is not null and n.size_bytes = s.size_bytes and n.mtime is not distinct from s.mtime and coalesce(s.meta_version, 1) >= {S.META_VERSION} and s.summary_status = 'skipped' then 'unchanged'
           when not n.is_only and s.id is not null and n.size_bytes = s.size_bytes and n.mtime is not distinct from s.mtime and coalesce(s.meta_version, 1) >= {S.META_VERSION} then 'unchanged'
           when n.kind is null then 'unsupported'
           when not n.is_only and s.id is not null and n.size_bytes = s.size_bytes and n.mtime is not distinct from s.mtime and n.kind = s.kind then 'refresh'
           when n.is_only then 'metadata_only' when n.size_bytes > 1000000000 then 'too_large'
           when s.id is not null and n.size_bytes = s.size_bytes and n.mtime is not distinct from s.mtime then 'reclassified'
           when s.id is not null and s.sha256 = n.sha256 then 'touch' when s.id is not null then 'replace' else 'insert' end as action
      from scan n full join stored s on n.root = s.root and n.rel_path = s.rel_path)
"""


def _applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, _, planned = _rescan(spark, sf_dir)
    files = reconcile.apply(c, planned, "2026-03-01 00:00:00").files
    return files.groupBy("root", "summary_status", "meta_version").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"), F.sum((F.col("indexed_at") == F.lit("2026-03-01 00:00:00").cast("timestamp_ntz")).cast("int")).alias("written"))


def _cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir)
    left = reconcile.cascade(c, c.files.filter("root = 'club-nas'"))
    parts = [left.child(n).agg(F.lit(n).alias("table_name"), F.count("*").alias("rows")) for n in ("files", "images", "documents", "ocr", "tags", "analyses")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir)
    seen = c.files.filter("extension in ('jpg', 'mp4')")
    return reconcile.unseen(c.files, seen, "photo-share", "exhibition", True).select("id", "rel_path")


def _touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, planned = _rescan(spark, sf_dir)
    return planned.filter("action in ('touch', 'refresh')").select("id", "action", "size_bytes", "mtime", "mode")


def _replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir)
    new = c.images.filter("width > 2000").select("file_id", F.lit("webp").alias("format"), F.col("width"), F.col("height"), F.col("phash"))
    return reconcile.replace_rows(c.images, new).withColumn("phash", F.col("phash").cast("string"))


def _reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir)
    return reconcile.hash_donors(c.files, c.files.filter("summary_status in ('pending', 'failed')"))


def _reused(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir)
    after = reconcile.reuse(c, reconcile.hash_donors(c.files, c.files.filter("summary_status in ('pending', 'failed')")))
    return after.ocr.groupBy("file_id").agg(F.count("*").alias("pages"), F.sum(F.length("text")).alias("chars"))


# ---------------------------------------------------------------- pictures


def _hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.hash_pairs(load(spark, sf_dir).images, 8)


def _donors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir)
    return dedup.near_donors(c.files, c.images, c.files.filter("kind = 'image' and summary_status in ('pending', 'failed')"), 8)


def _pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir)
    return c.files.select(F.col("id").alias("file_id"), F.col("abs_path").alias("path")).join(c.images, "file_id").select("path", "phash", (F.col("width") >= F.col("height")).alias("landscape"))


# ---------------------------------------------------------------- enrichment


def _candidates(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return enrich.candidates(load(spark, sf_dir), **options).select("id", "kind", "do_describe", "do_ocr")


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.steps(enrich.candidates(load(spark, sf_dir))).groupBy("step").agg(F.count("*").alias("calls"), F.count_distinct("id").alias("files"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir)
    return enrich.page_outcome(c.ocr.withColumn("error", F.when(F.col("page") % 7 == 0, "timeout")))


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = load(spark, sf_dir).analyses.filter("raw_response <> ''")
    answer = text.strip_think(F.col("raw_response"))
    return a.select("id", answers.describe(answer).alias("description"), F.when(F.col("prompt_version").like("ocr-%"), answers.recognised_text(answer)).alias("ocr_text"))


def _think(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = load(spark, sf_dir).analyses.filter("raw_response <> ''")
    return a.select("id", F.md5(text.strip_think(F.col("raw_response"))).alias("answer"))


def _merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = enrich.merge_inputs(load(spark, sf_dir).video_frames)
    return m.select("file_id", F.size("frames").alias("frames"), F.array_join(F.col("frames.description"), "|").alias("texts"))


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir)
    heads = c.files.select(F.col("id").alias("file_id"), "file_name").join(c.documents.filter("doc_type <> 'pdf'"), "file_id")
    heads = heads.select(F.concat_ws("/", "file_id", "file_name").alias("path"), F.encode(F.left("content", F.lit(S.HEADER_BYTES)), "UTF-8").alias("header"))
    return heads.mapInPandas(classify.classify_batches, f"path string, {classify.CLASSIFIED}")


def _decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir).documents.filter("content is not null")
    done = d.select("file_id", "content", text.decode_text(F.encode("content", "UTF-8")).alias("x"))
    return done.select("file_id", F.col("x.encoding").alias("encoding"), (F.col("x.text") == F.col("content")).alias("same"))


def _globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = paths.Excludes(["IMG_*", "scans/*/harbour_*", "family/", "**/old/*.jp?g", "*.m?v"])
    return load(spark, sf_dir).files.filter(rules.column(F.col("rel_path"))).select("id", "rel_path")


def _deletion(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = load(spark, sf_dir).files
    return reports.select_for_deletion(files, prefix=("photo-share", "exhibition"))


def queries() -> dict[str, Query]:
    c = load
    out: dict[str, Query] = {name: (lambda s, d, r=request: _page(s, d, r)) for name, request in REQUESTS.items()}
    out |= {
        "search_text_ranked": lambda s, d: _page(s, d, {"q": {"text": "snowy ferries", "size_bytes": {"gt": 0}}, "limit": 100}, lambda x: _index(x, True)),
        "search_hits": _hits,
        "file_by_id_columns": lambda s, d: search.by_id(c(s, d), "009e5d80-97f3-4888-845e-0aa099c35b03"),
        "catalogue_wide": _wide,
        "body_text": lambda s, d: textindex.bodies(c(s, d)).select("file_id", F.md5("body").alias("body"), F.length("body").alias("chars")),
        "ocr_text_1000": lambda s, d: search.ocr_texts(c(s, d)),
        "document_texts": lambda s, d: search.document_texts(c(s, d)).select("id", "doc_type", F.length("content").alias("chars"), F.length(text.doc_head(F.col("content"), 500)).alias("head"), text.worth_summarising(F.col("content")).alias("worth")),
        "token_stats": _tokens,
        "bm25_unstemmed": lambda s, d: _bm25(s, d, False, "harbour crane brücke"),
        "bm25_porter": lambda s, d: _bm25(s, d, True, "painting of the harbours"),
        "matched_frames_top10": _frames,
        "reconcile_actions": lambda s, d: _rescan(s, d)[2].select("root", "rel_path", "id", "action"),
        "reconcile_counters": lambda s, d: reconcile.counters(_rescan(s, d)[2]),
        "reconcile_applied": _applied,
        "needs_reading": lambda s, d: reconcile.needs_reading(_rescan(s, d)[1], _rescan(s, d)[0].files).select("root", "rel_path"),
        "touch_merge": _touch,
        "replace_anti_union": _replaced,
        "delete_unseen_scope": _unseen,
        "cascade_delete": _cascade,
        "reuse_sha256": _reuse,
        "reuse_copied_pages": _reused,
        "backfill_models": lambda s, d: enrich.backfill_models(c(s, d).files, c(s, d).analyses),
        "model_upsert": lambda s, d: enrich.record_models(c(s, d).llm_models, c(s, d).llm_models.filter("model is not null").withColumn("last_seen", F.col("last_seen") + F.expr("interval 1 day")).withColumn("first_seen", F.col("first_seen") + F.expr("interval 2 day"))).select("model", "n_ctx", "n_params", "quantization", "first_seen", "last_seen"),
        "requeue_running": lambda s, d: enrich.requeue(c(s, d).files).groupBy("summary_status").agg(F.count("*").alias("files")),
        "hamming_pairs": _hamming,
        "phash_donor_top1": _donors,
        "phash_repeat_counts": lambda s, d: dedup.repeat_counts(c(s, d).images),
        "phash_sample_bands": lambda s, d: dedup.sample_near(c(s, d).images, 8),
        "phash_sample_bands_16": lambda s, d: dedup.sample_near(c(s, d).images, max(dedup.THRESHOLDS)),
        "phash_greedy_report": lambda s, d: dedup.threshold_report(_pictures(s, d), seconds_per_call=50.0),
        "candidates": lambda s, d: _candidates(s, d),
        "candidates_force": lambda s, d: _candidates(s, d, force=True, kinds=["image", "document"], prefix="/mnt/c"),
        "candidates_path_order": lambda s, d: enrich.in_path_order(enrich.candidates(c(s, d)), 50).select("id", "abs_path"),
        "enrichment_steps": _steps,
        "latest_visible_text": lambda s, d: enrich.latest_visible_text(c(s, d).analyses),
        "ocr_auto_decision": lambda s, d: enrich.latest_visible_text(c(s, d).analyses).select("file_id", enrich.wants_ocr("auto", F.col("visible_text")).alias("wanted")),
        "ocr_status_reduce": _pages,
        "frame_merge_inputs": _merge,
        "answer_flatten": _flat,
        "strip_think": _think,
        "audit_prompt_versions": lambda s, d: reports.prompt_audit(c(s, d).analyses),
        "frame_times": lambda s, d: c(s, d).videos.select("file_id", F.array_join(F.transform(text.sample_times(F.col("duration_secs")), lambda t: F.round(t, 3).cast("decimal(12,3)").cast("string")), ",").alias("times")),
        "parse_rate": lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(text.parse_rate(F.concat_ws("/", F.col("l_quantity").cast("int").cast("string"), (F.col("l_linenumber") - 1).cast("string"))), 6).alias("rate")),
        "text_layer_check": lambda s, d: c(s, d).documents.select("file_id", text.lacks_text_layer(F.col("content"), F.col("page_count")).alias("lacks")),
        "mode_string": lambda s, d: c(s, d).files.select("id", paths.mode_string(F.col("mode")).alias("letters"), paths.mode_octal(F.col("mode")).alias("octal")),
        "path_parts": lambda s, d: c(s, d).files.select("id", paths.file_name(F.col("rel_path")).alias("name"), paths.extension(F.col("file_name")).alias("ext"), paths.parent(F.col("rel_path")).alias("folder")),
        "exclude_glob": _globs,
        "classify_header": _classified,
        "decode_text": _decoded,
        "archive_formats": lambda s, d: c(s, d).archives,
        "key_duplicates": lambda s, d: S.duplicates(table(s, d, "files"), "files"),
        "delete_preview": lambda s, d: reports.deletion_preview(_deletion(s, d)),
        "delete_sample": lambda s, d: reports.deletion_sample(_deletion(s, d)),
        "job_list_top100": lambda s, d: reports.job_list(c(s, d).jobs).select("id", "kind", "status", "found", "processed", "started_at"),
        "job_live_overlay": lambda s, d: reports.job_list(c(s, d).jobs, c(s, d).jobs.filter("status = 'running'").withColumn("processed", F.col("processed") + 1), 50).select("id", "status", "processed"),
        "job_progress": lambda s, d: reports.progress(c(s, d).jobs),
        "jobs_interrupted": lambda s, d: reports.interrupt_running(c(s, d).jobs).groupBy("status").agg(F.count("*").alias("jobs")),
        "estimate_by_category": lambda s, d: reports.estimate(c(s, d).files, 1_000_000_000),
        "estimate_top_ext": lambda s, d: reports.other_extensions(c(s, d).files),
        "estimate_videos": lambda s, d: reports.video_estimate(c(s, d).videos, 20, 5),
    }
    return out


# ---------------------------------------------------------------- the same in SQL

BASE = r"""with f as (select * exclude (r) from (select *, row_number() over (partition by id order by indexed_at desc) r from files) where r = 1),
    i as (select distinct * from images), d as (select distinct * from document_meta), o as (select distinct * from ocr), t as (select distinct file_id, tag from tags where tag is not null),
    a as (select distinct * from analyses),
    lines as (select file_id, unnest(string_split(text, chr(10))) as line from documents where doc_kind = 'frames' and file_id is not null),
    fr as (select file_id, cast(cast(regexp_extract(line, '^\s*\[(\d+):(\d\d):(\d\d)\]\s*(.*)$', 1) as int) * 3600 + cast(regexp_extract(line, '^\s*\[(\d+):(\d\d):(\d\d)\]\s*(.*)$', 2) as int) * 60 + cast(regexp_extract(line, '^\s*\[(\d+):(\d\d):(\d\d)\]\s*(.*)$', 3) as int) as double) as ts_secs,
             max(regexp_extract(line, '^\s*\[(\d+):(\d\d):(\d\d)\]\s*(.*)$', 4)) as description from lines where regexp_matches(line, '^\s*\[\d+:\d\d:\d\d\]') group by 1, 2),
    v as (select file_id, max(ts_secs) as duration_secs, cast(null as int) as width, cast(null as int) as height from fr group by 1),
    body as (select f.id as file_id, concat_ws(' ', file_name, replace(rel_path, '/', ' '), summary, content, ft, tt, ot) as body from f left join d on d.file_id = f.id
             left join (select file_id, string_agg(description, ' ' order by ts_secs) ft from fr group by 1) x on x.file_id = f.id left join (select file_id, string_agg(tag, ' ' order by tag) tt from t group by 1) y on y.file_id = f.id
             left join (select file_id, string_agg(text, ' ' order by page) ot from o group by 1) z on z.file_id = f.id),
    toks as (select file_id, unnest(list_filter(regexp_split_to_array(lower(strip_accents(body)), '[^a-z0-9]+'), lambda w: w <> '')) as term from body)
"""
ARCHIVES = r"""ar as (select id as file_id, lower(file_name) as n, case regexp_extract(lower(file_name), '\.([^.]+)$', 1) when 'gz' then 'gzip' when 'tgz' then 'gzip' when 'bz2' then 'bzip2' when 'tbz2' then 'bzip2' when 'tbz' then 'bzip2' when 'xz' then 'xz' when 'txz' then 'xz' when 'zst' then 'zstd' when 'tzst' then 'zstd' when 'lz4' then 'lz4' when 'lz' then 'lzip' when 'z' then 'compress' when 'zip' then 'zip' when '7z' then '7z' when 'rar' then 'rar' else 'none' end as compression from f where kind = 'archive'),
    ar2 as (select file_id, compression, case when compression = 'none' then 'tar' when compression in ('zip', '7z', 'rar') then compression else case when n like '%.tar.%' or regexp_matches(n, '\.(tgz|tbz2?|txz|tzst)$') then 'tar.' else '' end || case compression when 'gzip' then 'gz' when 'bzip2' then 'bz2' when 'zstd' then 'zst' when 'compress' then 'Z' when 'lzip' then 'lz' else compression end end as format from ar)
"""
JOBS = """j as (select 'job-' || o_orderkey as id, case when o_orderpriority <= '3' then 'index' else 'import_media' end as kind, case o_orderstatus when 'F' then 'completed' when 'O' then 'running' else 'paused' end as status,
    cast(floor(o_totalprice) as bigint) % 1000 as found, cast(floor(o_totalprice) as bigint) % 700 as processed, cast(floor(o_totalprice) as bigint) % 13 as failed, cast(floor(o_totalprice) as bigint) % 90 as skipped, o_orderdate as started_at from orders)"""
DESCRIBE = "summary_status in ('pending', 'failed')"
OPEN = "(ocr_status is null or ocr_status = 'failed')"
DO_OCR = f"coalesce((kind = 'image' and {OPEN} and (summary_status = 'done' or {DESCRIBE})) or (kind = 'document' and doc_type = 'pdf' and coalesce(needs_ocr, false) and {OPEN}), false)"
CANDIDATES = f"cand as (select f.id, f.abs_path, kind, doc_type, d.page_count, duration_secs, {DESCRIBE} as do_describe, {DO_OCR} as do_ocr from f left join v on v.file_id = f.id left join d on d.file_id = f.id where kind in ('image', 'video', 'document') and summary_status <> 'running')"
CHOSEN = "sel as (select * from f where root = 'photo-share' and (rel_path = 'exhibition' or rel_path like 'exhibition/%'))"
PAIRS = "h as (select distinct phash from i where phash is not null), pairs as (select x.phash as a, y.phash as b, cast(bit_count(xor(x.phash, y.phash)) as int) as dist from h x join h y on x.phash < y.phash and bit_count(xor(x.phash, y.phash)) <= 8)"


def _search_sql(name: str) -> str:
    request = REQUESTS[name]
    return f"""{BASE} select f.id, f.abs_path, cast(null as double) as score, count(*) over () as total from f left join i on i.file_id = f.id left join d on d.file_id = f.id left join v on v.file_id = f.id
        where {WHERE[name]} order by f.abs_path nulls last, f.id limit {request.get('limit', 20)} offset {request.get('offset', 0)}"""


def _category_sql(code: list[str], names: list[str]) -> str:
    quoted = lambda xs: ", ".join(f"'{x}'" for x in xs)
    whens = " ".join(f"when regexp_extract(lower(file_name), '\\.([^.]*)$', 1) in ({quoted(x.split())}) then '{cat}'" for cat, x in reports.CATEGORIES.items())
    return f"case when lower(file_name) in ({quoted(names)}) then 'code' when regexp_matches(lower(file_name), '\\.tar\\.(gz|bz2|xz|zst)$') then 'archive' {whens} when regexp_extract(lower(file_name), '\\.([^.]*)$', 1) in ({quoted(code)}) then 'code' else 'other' end"


def oracle_sql() -> dict[str, str]:
    cat = _category_sql(*reports._code())
    mode = "||".join(f"case when mode & {1 << (8 - n)} <> 0 then '{'rwx'[n % 3]}' else '-' end" for n in range(9))
    out = {name: _search_sql(name) for name in WHERE}
    out |= {
        "search_substring_score": f"""{BASE}, s as (select file_id, cast((body ilike '%ferry%')::int + (body ilike '%brücke%')::int + (body ilike '%17%')::int as double) as score from body)
            select f.id, f.abs_path, round(score, 6) as score, count(*) over () as total from f join s on s.file_id = f.id where score > 0 order by s.score desc, f.abs_path nulls last, f.id limit 100""",
        "search_hits": f"""{BASE}, {ARCHIVES}, p as (select f.id, s.score, f.abs_path from f join (select file_id, cast((body ilike '%ferry%')::int as double) as score from body) s on s.file_id = f.id where score > 0 and size_bytes >= 1 order by score desc, abs_path nulls last, id limit 200),
            mf as (select file_id, least(count(*), 10) as frames from fr where description ilike '%ferry%' group by 1)
            select f.id, case when length(to_base(mode, 8)) < 4 then lpad(to_base(mode, 8), 4, '0') else to_base(mode, 8) end as mode, case when kind = 'image' then i.width end as image_width, doc_type, case when doc_type is not null then left(content, 300) end as snippet,
              case when kind = 'archive' then ar2.format end as archive_format, case when kind = 'video' then v.duration_secs end as video_secs, cast(mf.frames as int) as frames, left(q.ocr, 1000) as ocr_text, p.score
            from p join f on f.id = p.id left join i on i.file_id = f.id left join d on d.file_id = f.id left join v on v.file_id = f.id left join ar2 on ar2.file_id = f.id left join mf on mf.file_id = f.id
              left join (select file_id, string_agg(text, chr(10) order by page) ocr from o group by 1) q on q.file_id = f.id""",
        "file_by_id_columns": f"{BASE} select id, root, rel_path, abs_path, file_name, kind, mime, size_bytes, mtime, sha256, summary, summary_status, indexed_at from f where id = '009e5d80-97f3-4888-845e-0aa099c35b03'",
        "catalogue_wide": f"""{BASE}, {ARCHIVES} select f.id, f.kind, i.format as images_format, i.width as images_width, d.doc_type as documents_doc_type, d.page_count as documents_page_count, v.duration_secs as videos_duration_secs, ar2.compression as archives_compression, ar2.format as archives_format
            from f left join i on i.file_id = f.id left join d on d.file_id = f.id left join v on v.file_id = f.id left join ar2 on ar2.file_id = f.id""",
        "body_text": f"{BASE} select file_id, md5(body) as body, cast(length(body) as int) as chars from body",
        "ocr_text_1000": f"{BASE} select file_id as id, left(string_agg(text, chr(10) order by page), 1000) as ocr_text from o group by 1",
        "document_texts": rf"{BASE} select f.id, doc_type, cast(length(coalesce(content, '')) as int) as chars, cast(length(left(coalesce(content, ''), 500)) as int) as head, length(regexp_replace(coalesce(content, ''), '[\s\p{{Z}}\x{{85}}]', '', 'g')) >= 20 as worth from f join d on d.file_id = f.id",
        "token_stats": f"{BASE} select term, count(distinct file_id) as files, count(*) as uses from toks group by 1",
        "bm25_unstemmed": f"""{BASE}, tf as (select term, file_id, count(*) as tf from toks group by 1, 2), l as (select file_id, sum(tf) as len from tf group by 1), n as (select (select count(*) from body) as docs, (select sum(len) from l) / (select count(*) from body) as avgdl),
            hit as (select * from tf where term in ('harbour', 'crane', 'brucke')), df as (select term, count(*) as df from hit group by 1)
            select file_id, round(sum(log10((docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))), 6) as score from hit join df using (term) join l using (file_id) cross join n group by 1""",
        "matched_frames_top10": f"{BASE} select file_id, ts_secs, description from (select *, row_number() over (partition by file_id order by ts_secs) r from fr where (description ilike '%ferry%' or description ilike '%br_cke%') and file_id in (select id from f)) where r <= 10",
        "reconcile_actions": f"{BASE}, {STATE_SQL} select root, rel_path, id, action from plan",
        "reconcile_counters": f"""{BASE}, {STATE_SQL} select cast(coalesce(sum((action not in ('delete', 'unsupported'))::int), 0) as bigint) as found, cast(coalesce(sum((action in ('insert', 'replace', 'reclassified', 'metadata_only'))::int), 0) as bigint) as processed, cast(coalesce(sum((action = 'failed')::int), 0) as bigint) as failed,
            cast(coalesce(sum((action in ('unchanged', 'too_large'))::int), 0) as bigint) as skipped, cast(coalesce(sum((action in ('touch', 'refresh'))::int), 0) as bigint) as updated, cast(coalesce(sum((action = 'delete' or action = 'unsupported' and id is not null)::int), 0) as bigint) as removed from plan""",
        "reconcile_applied": f"""{BASE}, {STATE_SQL}, after as (
              select s.root, s.summary_status, case when p.action in ('touch', 'refresh') then {S.META_VERSION} else coalesce(s.meta_version, 1) end as meta_version, case when p.action = 'touch' then p.size_bytes else s.size_bytes end as size_bytes, case when p.action in ('touch', 'refresh') then 1 else 0 end as written
              from stored s join plan p on p.id = s.id where p.action in ('unchanged', 'touch', 'refresh', 'failed')
              union all select p.root, case when p.action in ('metadata_only', 'too_large') or n.kind = 'archive' then 'skipped' else 'pending' end, {S.META_VERSION}, p.size_bytes, 1 from plan p join scan n on n.root = p.root and n.rel_path = p.rel_path where p.action in ('insert', 'replace', 'metadata_only', 'too_large', 'reclassified'))
            select root, summary_status, meta_version, count(*) as files, cast(sum(size_bytes) as bigint) as bytes, cast(sum(written) as bigint) as written from after group by 1, 2, 3""",
        "needs_reading": f"{BASE}, {STATE_SQL} select n.root, n.rel_path from scan n left join stored s on n.root = s.root and n.rel_path = s.rel_path where not coalesce(n.size_bytes = s.size_bytes and n.mtime is not distinct from s.mtime and coalesce(s.meta_version, 1) >= {S.META_VERSION}, false)",
        "touch_merge": f"{BASE}, {STATE_SQL} select id, action, size_bytes, mtime, mode from plan where action in ('touch', 'refresh')",
        "replace_anti_union": f"{BASE} select file_id, case when width > 2000 then 'webp' else format end as format, width, height, cast(phash as varchar) as phash from i",
        "delete_unseen_scope": f"{BASE} select id, rel_path from f where root = 'photo-share' and rel_path like 'exhibition/%' and coalesce(extension, '') not in ('jpg', 'mp4')",
        "cascade_delete": f"""{BASE}, g as (select id from f where root = 'club-nas') select 'files' as table_name, count(*) as rows from f where id not in (select id from g) union all select 'images', count(*) from i where file_id not in (select id from g)
            union all select 'documents', count(*) from d where file_id not in (select id from g) union all select 'ocr', count(*) from o where file_id not in (select id from g) union all select 'tags', count(*) from t where file_id not in (select id from g) union all select 'analyses', count(*) from a where file_id not in (select id from g)""",
        "reuse_sha256": f"{BASE} select id, donor_id from (select w.id, s.id as donor_id, row_number() over (partition by w.id order by s.indexed_at desc, s.id desc) r from f w join f s on s.sha256 = w.sha256 and s.id <> w.id and s.summary_status = 'done' where w.summary_status in ('pending', 'failed')) where r = 1",
        "reuse_copied_pages": f"""{BASE}, p as (select id, donor_id from (select w.id, s.id as donor_id, row_number() over (partition by w.id order by s.indexed_at desc, s.id desc) r from f w join f s on s.sha256 = w.sha256 and s.id <> w.id and s.summary_status = 'done' where w.summary_status in ('pending', 'failed')) where r = 1),
            c as (select p.id as file_id, page, text from o join p on p.donor_id = o.file_id), n as (select * from o where file_id not in (select file_id from c) union all select * from c) select file_id, count(*) as pages, cast(sum(length(text)) as bigint) as chars from n group by 1""",
        "backfill_models": f"""{BASE}, g as (select * from a where error is null), own as (select file_id, arg_max(model, struct_pack(c := created_at, i := id)) filter (prompt_version not like 'ocr-%' and model is not null) as s, arg_max(model, struct_pack(c := created_at, i := id)) filter (prompt_version like 'ocr-%' and model is not null) as o from g group by 1),
            s2 as (select file_id, model as s from (select *, row_number() over (partition by file_id order by created_at desc, id desc) r from g where prompt_version not like 'ocr-%') where r = 1), o2 as (select file_id, model as o from (select *, row_number() over (partition by file_id order by created_at desc, id desc) r from g where prompt_version like 'ocr-%') where r = 1),
            mine as (select f.id, f.reused_from, s2.s, o2.o from f left join s2 on s2.file_id = f.id left join o2 on o2.file_id = f.id)
            select m.id, case when k.id is not null then k.s else m.s end as summary_model, case when k.id is not null then k.o else m.o end as ocr_model from mine m left join mine k on k.id = m.reused_from""",
        "model_upsert": "select model, coalesce(n_ctx, 0) as n_ctx, arg_max(n_params, last_seen) as n_params, arg_max(quantization, last_seen) as quantization, min(first_seen) as first_seen, max(last_seen) + interval 1 day as last_seen from llm_models where model is not null group by 1, 2",
        "requeue_running": f"{BASE} select case when summary_status = 'running' then 'pending' else summary_status end as summary_status, count(*) as files from f group by 1",
        "hamming_pairs": f"{BASE}, {PAIRS} select a, b, dist from pairs",
        "phash_donor_top1": f"""{BASE} select id, donor_id, dist from (select w.id, s.id as donor_id, cast(bit_count(xor(iw.phash, si.phash)) as int) as dist, row_number() over (partition by w.id order by bit_count(xor(iw.phash, si.phash)), s.indexed_at desc, s.id) r
            from f w join i iw on iw.file_id = w.id and iw.phash <> 0 join i si on bit_count(xor(iw.phash, si.phash)) <= 8 join f s on s.id = si.file_id and s.id <> w.id and s.summary_status = 'done' and s.reused_from is null and s.ocr_status is not null where w.kind = 'image' and w.summary_status in ('pending', 'failed')) where r = 1""",
        "phash_repeat_counts": f"{BASE} select count(phash) as hashed, cast(sum((phash is null)::int) as bigint) as unreadable, cast(sum((phash = 0)::int) as bigint) as flat, count(phash) - count(distinct phash) as repeats from i",
        "phash_sample_bands": f"{BASE}, {PAIRS} select band, a, b, dist from (select case when dist <= 2 then '0-2' when dist <= 6 then '3-6' else '7-10' end as band, a, b, dist, row_number() over (partition by case when dist <= 2 then '0-2' when dist <= 6 then '3-6' else '7-10' end order by md5(a || ':' || b)) r from pairs) where r <= 10",
        "candidates": f"{BASE}, {CANDIDATES} select id, kind, do_describe, do_ocr from cand where do_describe or do_ocr",
        "candidates_force": f"{BASE} select f.id, kind, true as do_describe, coalesce(kind = 'image' or (kind = 'document' and doc_type = 'pdf' and coalesce(needs_ocr, false)), false) as do_ocr from f left join d on d.file_id = f.id where kind in ('image', 'document') and summary_status <> 'running' and abs_path like '/mnt/c%'",
        "candidates_path_order": f"{BASE}, {CANDIDATES} select id, abs_path from cand where do_describe or do_ocr order by abs_path nulls last, id limit 50",
        "enrichment_steps": f"""{BASE}, {CANDIDATES}, s as (select id, unnest(case when not do_describe then [] when kind = 'image' then ['describe'] when kind = 'video' then case when duration_secs is null or duration_secs < 2 then ['frame', 'merge'] when duration_secs < 4 then ['frame', 'frame', 'merge'] else ['frame', 'frame', 'frame', 'merge'] end when doc_type = 'pdf' then ['first_page'] else ['summary'] end
              || case when not do_ocr then [] when kind = 'image' then ['ocr'] else list_transform(range(0, greatest(1, least(coalesce(page_count, 1), 20))), lambda x: 'ocr') end) as step from cand where do_describe or do_ocr) select step, count(*) as calls, count(distinct id) as files from s group by 1""",
        "latest_visible_text": f"{BASE} select file_id, visible_text from (select file_id, parsed::json ->> '$.visible_text' as visible_text, row_number() over (partition by file_id order by created_at desc, id desc) r from a where prompt_version like 'img-%' and ts_secs is null and parsed is not null and error is null) where r = 1",
        "ocr_auto_decision": f"{BASE} select file_id, trim(coalesce(visible_text, '')) <> '' as wanted from (select file_id, parsed::json ->> '$.visible_text' as visible_text, row_number() over (partition by file_id order by created_at desc, id desc) r from a where prompt_version like 'img-%' and ts_secs is null and parsed is not null and error is null) where r = 1",
        "ocr_status_reduce": f"{BASE} select file_id, case when sum((page % 7 <> 0)::int) = 0 then 'failed' when max(case when page % 7 <> 0 then length(trim(text)) else 0 end) > 0 then 'done' else 'none' end as ocr_status, count(*) as pages, cast(sum((page % 7 = 0)::int) as bigint) as failed from o group by 1",
        "frame_merge_inputs": f"{BASE} select file_id, cast(count(*) as int) as frames, string_agg(left(description, 600), '|' order by ts_secs) as texts from fr group by 1",
        "strip_think": rf"{BASE} select id, md5(trim(case when raw_response like '%</think>%' then regexp_replace(raw_response, '^.*</think>', '', 's') else regexp_replace(raw_response, '<think>.*$', '', 's') end, E' \n\r\t')) as answer from a where raw_response <> ''",
        "audit_prompt_versions": f"{BASE} select prompt_version, count(*) as answers, round(avg(latency_ms), 6) as avg_latency, count(error) as errors from a group by 1",
        "frame_times": f"{BASE} select file_id, case when duration_secs < 2 then '0.000' when duration_secs < 4 then '0.000,' || cast(cast(duration_secs as decimal(12, 3)) as varchar) else '0.000,' || cast(cast(duration_secs / 2 as decimal(12, 3)) as varchar) || ',' || cast(cast(duration_secs as decimal(12, 3)) as varchar) end as times from v",
        "parse_rate": "select l_orderkey, l_linenumber, case when cast(l_quantity as int) > 0 and l_linenumber > 1 then round(cast(l_quantity as int)::double / (l_linenumber - 1), 6) end as rate from lineitem",
        "text_layer_check": rf"{BASE} select file_id, length(regexp_replace(coalesce(content, ''), '[\s\p{{Z}}\x{{85}}]', '', 'g')) < 20 * greatest(coalesce(page_count, 1), 1) as lacks from d",
        "mode_string": f"{BASE} select id, {mode} as letters, case when length(to_base(mode, 8)) < 4 then lpad(to_base(mode, 8), 4, '0') else to_base(mode, 8) end as octal from f",
        "path_parts": r"%s select id, string_split(rel_path, '/')[-1] as name, nullif(lower(regexp_extract(file_name, '^.+\.([^.]+)$', 1)), '') as ext, regexp_replace(rel_path, '/?[^/]*$', '') as folder from f" % BASE,
        "exclude_glob": r"%s select id, rel_path from f where regexp_matches(file_name, '^IMG_[^/]*$') or regexp_matches(rel_path, '^scans/[^/]*/harbour_[^/]*$') or regexp_matches(rel_path, '(^|/)IMG_[^/]*/') or regexp_matches(rel_path, '^scans/[^/]*/harbour_[^/]*/') or regexp_matches(rel_path, '(^|/)family/') or regexp_matches(rel_path, '^.*/old/[^/]*\.jp[^/]g(/|$)') or regexp_matches(file_name, '^[^/]*\.m[^/]v$') or regexp_matches(rel_path, '(^|/)[^/]*\.m[^/]v/')" % BASE,
        "archive_formats": f"{BASE}, {ARCHIVES} select file_id, compression, format from ar2",
        "key_duplicates": "select id, count(*) as rows from files group by 1 having count(*) > 1",
        "delete_preview": f"{BASE}, {CHOSEN} select kind, count(*) as files, cast(coalesce(sum(size_bytes), 0) as bigint) as bytes from sel group by rollup (kind)",
        "delete_sample": f"{BASE}, {CHOSEN} select id, rel_path from sel order by id limit 20",
        "job_list_top100": f"with {JOBS} select id, kind, status, found, processed, started_at from j order by started_at desc, id limit 100",
        "job_live_overlay": f"with {JOBS} select id, status, case when status = 'running' then processed + 1 else processed end as processed from j order by started_at desc, id limit 50",
        "job_progress": f"with {JOBS} select id, status, case when found > 0 then round(least(100.0, 100.0::double * (processed + failed + skipped) / found), 4) else 0.0 end as percent from j",
        "jobs_interrupted": f"with {JOBS} select case when status = 'running' then 'interrupted' else status end as status, count(*) as jobs from j group by 1",
        "estimate_by_category": f"""{BASE}, k as (select {cat} as category, size_bytes from f), g as (select category, count(*) as files, cast(coalesce(sum(size_bytes), 0) as bigint) as bytes, cast(coalesce(sum((size_bytes > 1000000000 and category <> 'other')::int), 0) as bigint) as too_large from k group by 1)
            select category, files, bytes, too_large, case when category in ('image', 'pdf', 'text', 'code') then files - too_large else 0 end as calls_min, case when category in ('image', 'pdf', 'text', 'code') then files - too_large else 0 end + case when category = 'image' then files - too_large else 0 end as calls_max from g""",
        "estimate_top_ext": f"{BASE} select case when contains(file_name, '.') then lower(regexp_extract(file_name, '\\.([^.]*)$', 1)) else '(none)' end as extension, count(*) as files from f where {cat} = 'other' group by 1 order by 2 desc, 1 limit 15",
        "estimate_videos": f"""{BASE}, n as (select duration_secs, greatest(20.0, duration_secs / 5) as step from v), r as (select duration_secs, step, least(floor(duration_secs / step) + 1, 4) as regular from n), k as (select duration_secs, duration_secs > 0 as known, regular + (duration_secs - (regular - 1) * step >= 2.0)::int as frames from r)
            select count(*) as videos, coalesce(sum(case when known then duration_secs end), 0.0) as seconds, cast(sum((not known)::int) as bigint) as unknown, cast(coalesce(sum(case when known then frames end), 0) as bigint) as frames, cast(coalesce(sum(case when known then frames + 1 end), 0) as bigint) as calls from k""",
    }
    return out
