"""Tables of the catalogue: types, keys, states and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Version of the extractors; rows of an older version are refreshed by the next scan.
META_VERSION = 6
#: Version of the table layout, written with every snapshot.
LAYOUT_VERSION = 9

KINDS = ("image", "document", "video", "archive")
DOC_TYPES = ("text", "markdown", "pdf", "code")
SUMMARY_STATES = ("pending", "running", "done", "failed", "skipped")
OCR_STATES = ("done", "none", "failed", "skipped")
JOB_STATES = ("running", "completed", "failed", "cancelled", "paused", "interrupted")

# Fixed values of the search and enrichment interfaces.
DEFAULT_LIMIT, MAX_LIMIT, MAX_TERMS, FRAMES_PER_HIT = 20, 200, 32, 10
SNIPPET_CHARS, OCR_CHARS, FRAME_MERGE_CHARS, DOC_HEAD_CHARS = 300, 1000, 600, 12_000
HEADER_BYTES, TEXT_CAP_BYTES, CHARS_PER_PAGE, MIN_DOC_CHARS = 8192, 5 * 1024 * 1024, 20, 20
MAX_PDF_PAGES, FRAME_GAP_SECS, MAX_HASH_PIXELS = 20, 2.0, 120_000_000
MAX_DELETE_IDS, SAMPLE_ROWS, JOB_ROWS, ERROR_ROWS = 10_000, 20, 100, 50
PROMPT_VERSIONS = {"image": "img-v2", "video": "video-merge-v2", "ocr": "ocr-v1", "document": "doc-v1"}


TYPES = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp_ntz": T.TimestampNTZType()}


def _struct(spec: str) -> T.StructType:
    """From "name type, ...", without a session, so that Python workers can import this module."""
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in (x.split() for x in spec.split(", "))])


SCHEMAS: dict[str, T.StructType] = {
    "files": _struct(
        "id string, root string, rel_path string, abs_path string, file_name string, extension string, kind string, mime string, size_bytes bigint, mode int, mode_str string, uid int, gid int, mtime timestamp_ntz, sha256 string, summary string, summary_status string, indexed_at timestamp_ntz, created timestamp_ntz, meta_version int, ocr_status string, reused_from string, summary_model string, ocr_model string"
    ),
    "images": _struct("file_id string, format string, width int, height int, phash bigint"),
    "documents": _struct("file_id string, doc_type string, page_count int, content string, language string, encoding string, needs_ocr boolean"),
    "videos": _struct("file_id string, duration_secs double, width int, height int, video_codec string, audio_codec string, fps double, container string, bitrate bigint"),
    "archives": _struct("file_id string, compression string, format string"),
    "video_frames": _struct("file_id string, ts_secs double, description string"),
    "ocr": _struct("file_id string, page int, text string"),
    "tags": _struct("file_id string, tag string, source string"),
    "analyses": _struct(
        "id string, file_id string, model string, prompt_version string, raw_response string, parsed string, latency_ms bigint, prompt_tokens int, completion_tokens int, created_at timestamp_ntz, error string, ts_secs double, n_ctx int"
    ),
    "llm_models": _struct("model string, n_ctx int, n_ctx_train int, n_params bigint, size_bytes bigint, quantization string, build_info string, first_seen timestamp_ntz, last_seen timestamp_ntz"),
    "jobs": _struct(
        "id string, kind string, params string, status string, found bigint, processed bigint, failed bigint, skipped bigint, started_at timestamp_ntz, finished_at timestamp_ntz, error string, recent_errors string, removed bigint, updated bigint"
    ),
}
KEYS: dict[str, tuple[str, ...]] = {
    "files": ("id",), "images": ("file_id",), "documents": ("file_id",), "videos": ("file_id",), "archives": ("file_id",), "video_frames": ("file_id", "ts_secs"),
    "ocr": ("file_id", "page"), "tags": ("file_id", "tag"), "analyses": ("id",), "llm_models": ("model", "n_ctx"), "jobs": ("id",),
}
#: Tables whose rows go when their file goes.
CHILDREN = ("images", "documents", "videos", "archives", "video_frames", "ocr", "tags", "analyses")
#: Values of columns that older layouts lack.
DEFAULTS = {"summary": "", "summary_status": "pending", "meta_version": 1, "needs_ocr": False, "found": 0, "processed": 0, "failed": 0, "skipped": 0, "removed": 0, "updated": 0}


def upgrade(df: DataFrame, name: str) -> DataFrame:
    """Brings rows of an older layout to the present one: missing columns get their default, others are cast."""
    have = set(df.columns)
    out = []
    for field in SCHEMAS[name].fields:
        column = F.col(field.name) if field.name in have else F.lit(None)
        if field.name in DEFAULTS:
            column = F.coalesce(column, F.lit(DEFAULTS[field.name]))
        out.append(column.cast(field.dataType).alias(field.name))
    return df.select(*out)


def duplicates(df: DataFrame, name: str) -> DataFrame:
    """Keys that occur more than once, with their number of rows: Spark enforces no keys."""
    return df.groupBy(*KEYS[name]).agg(F.count("*").alias("rows")).filter("rows > 1")
