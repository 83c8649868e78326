"""Sources: directory trees, file contents, hash caches, external tools, models, configuration."""

from __future__ import annotations

import datetime as dt
import hashlib
import os
import stat
import subprocess
import tomllib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalens import schemas as S
from catalens.functions.paths import Excludes
from catalens.sources.classify import CLASSIFIED, classify

# ---------------------------------------------------------------- trees


def walk(root: str, target: str | None = None, traverse: bool = True, excludes: Excludes | None = None) -> tuple[list[str], bool]:
    """(paths relative to root, complete) of the regular files below target: no links, nothing hidden or excluded."""
    excludes = excludes or Excludes([])
    found, complete = [], True
    start = target or root
    if os.path.isfile(start):
        return [os.path.relpath(start, root)], True
    stack = [start]
    while stack:
        folder = stack.pop()
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            complete = False
            continue
        below = []
        for e in entries:
            rel = os.path.relpath(e.path, root)
            if e.name.startswith("."):
                continue
            try:
                if e.is_symlink():
                    continue
                if e.is_dir(follow_symlinks=False):
                    if traverse and not excludes.matches(rel, True):
                        below.append(e.path)
                elif e.is_file(follow_symlinks=False) and not excludes.matches(rel, False):
                    found.append(rel)
            except OSError:
                complete = False
        stack += reversed(below)
    return found, complete


def micros(seconds: float, nanos: int | None = None) -> dt.datetime:
    n = nanos if nanos is not None else int(seconds * 1e9)
    return dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=n // 1000)


def _stat(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for root, base, rel in zip(pdf["root"], pdf["base"], pdf["rel_path"]):
            path = os.path.join(base, rel)
            try:
                s = os.lstat(path)
                birth = getattr(s, "st_birthtime", None)
                rows.append((root, rel, path, s.st_size, stat.S_IMODE(s.st_mode), s.st_uid, s.st_gid, micros(0, s.st_mtime_ns), micros(birth) if birth else None, None))
            except OSError as e:
                rows.append((root, rel, path, None, None, None, None, None, None, str(e)))
        yield pd.DataFrame(rows, columns=["root", "rel_path", "abs_path", "size_bytes", "mode", "uid", "gid", "mtime", "created", "error"]).astype({"size_bytes": "Int64", "mode": "Int32", "uid": "Int32", "gid": "Int32"})


def stat_scan(spark: SparkSession, root: str, base: str, rel_paths: list[str], parts: int | None = None) -> DataFrame:
    """The stat columns of listed files, taken by the executors (which see the same file system)."""
    rows = spark.createDataFrame([(root, base, p) for p in rel_paths], "root string, base string, rel_path string")
    rows = rows.repartition(parts or max(1, min(spark.sparkContext.defaultParallelism, len(rel_paths) // 100 + 1)))
    return rows.mapInPandas(_stat, "root string, rel_path string, abs_path string, size_bytes long, mode int, uid int, gid int, mtime timestamp_ntz, created timestamp_ntz, error string")


def _read(max_bytes: int):
    names = [x.split()[0] for x in CLASSIFIED.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, size in zip(pdf["abs_path"], pdf["size_bytes"]):
                try:
                    with open(path, "rb") as f:
                        head = f.read(S.HEADER_BYTES)
                        found = classify(os.path.basename(path), head)
                        sha = None
                        if found and size <= max_bytes:
                            h = hashlib.sha256(head)
                            while block := f.read(1 << 20):
                                h.update(block)
                            sha = h.hexdigest()
                    rows.append([*(found.get(n) if found else None for n in names), sha, None])
                except OSError as e:
                    rows.append([*[None] * len(names), None, str(e)])
            done = pd.DataFrame(rows, columns=[*names, "sha256", "read_error"])
            yield pd.concat([pdf.drop(columns=["error"]).reset_index(drop=True), done.rename(columns={"read_error": "error"})], axis=1)

    return run


def read_scan(stats: DataFrame, max_bytes: int = 10_000_000_000) -> DataFrame:
    """Classification by header and SHA-256 by stream for files that must be read; no copy is made, unsupported and too
    large files are not read beyond their header."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stats.schema if f.name != "error")
    return stats.mapInPandas(_read(max_bytes), f"{fields}, {CLASSIFIED}, sha256 string, error string")


def contents(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, size_bytes, content, sha256) of whole files through Spark's own reader."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    rows = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)
    return rows.select("path", F.col("length").alias("size_bytes"), "content", F.sha2("content", 256).alias("sha256"))


# ---------------------------------------------------------------- hash caches


CACHE = "p string, h string, w int, ht int, t double, err string"


def read_cache(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """(pictures, errors) of JSON-lines hash caches: the last entry of a path counts, in the order of files and lines."""
    rows = spark.read.schema(CACHE).json(list(paths)).select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
    rank = F.row_number().over(Window.partitionBy("p").orderBy(F.desc("_f"), F.desc("_b"), F.desc("_i")))
    good = rows.filter("err is null and p is not null").withColumn("_r", rank).filter("_r = 1")
    signed = F.conv("h", 16, -10).cast("long")
    return good.select(F.col("p").alias("path"), signed.alias("phash"), (F.col("w") >= F.col("ht")).alias("landscape")), rows.filter("err is not null").select(F.col("p").alias("path"), F.col("err").alias("error"))


def not_cached(paths: DataFrame, cache: DataFrame) -> DataFrame:
    return paths.join(cache.select("path").distinct(), "path", "left_anti")


def append_cache(hashes: DataFrame, path: str) -> None:
    """hashes: path, phash, width, height."""
    unsigned = F.lpad(F.hex("phash"), 16, "0")
    hashes.select(F.col("path").alias("p"), F.lower(unsigned).alias("h"), F.col("width").alias("w"), F.col("height").alias("ht")).write.mode("append").json(path)


# ---------------------------------------------------------------- tools


TIMEOUTS = {"pdftotext": 120, "pdfinfo": 60, "ffprobe": 60, "ffmpeg": 600, "pdftoppm": 300}


def run_tool(program: str, args: list[str], timeout: float | None = None) -> bytes:
    """Output of an external program called with an argument list, never through a shell."""
    try:
        done = subprocess.run([program, *args], capture_output=True, timeout=timeout or TIMEOUTS.get(program, 60), check=False)
    except FileNotFoundError:
        raise RuntimeError(f"{program} is not installed") from None
    except subprocess.TimeoutExpired:
        raise RuntimeError(f"{program} took too long") from None
    if done.returncode:
        raise RuntimeError(f"{program} failed: {done.stderr.decode('utf-8', 'replace')[:500]}")
    return done.stdout


PROBE = "streams array<struct<codec_type:string,codec_name:string,width:int,height:int,avg_frame_rate:string,r_frame_rate:string,duration:string>>, format struct<format_name:string,duration:string,bit_rate:string>"


def parse_probe(rows: DataFrame, column: str = "probe") -> DataFrame:
    """The videos columns from probe JSON: the first video and audio stream, the container's duration before the stream's."""
    from catalens.functions.text import parse_rate

    p = rows.withColumn("_p", F.from_json(column, PROBE))
    stream = lambda kind: F.try_element_at(F.filter("_p.streams", lambda s: s["codec_type"] == kind), F.lit(1))
    p = p.withColumn("_v", stream("video")).withColumn("_a", stream("audio"))
    return p.select(
        *[c for c in rows.columns if c != column],
        F.coalesce(F.col("_p.format.duration").try_cast("double"), F.col("_v.duration").try_cast("double")).alias("duration_secs"), F.col("_v.width").alias("width"), F.col("_v.height").alias("height"),
        F.col("_v.codec_name").alias("video_codec"), F.col("_a.codec_name").alias("audio_codec"), F.coalesce(parse_rate(F.col("_v.avg_frame_rate")), parse_rate(F.col("_v.r_frame_rate"))).alias("fps"),
        F.col("_p.format.format_name").alias("container"), F.col("_p.format.bit_rate").try_cast("bigint").alias("bitrate"),
    )


# ---------------------------------------------------------------- models and configuration


@dataclass
class ModelChoice:
    """The model in use: the configured one, else the only one the server offers; a switch is followed and told once."""

    fetch: Callable[[], list[dict]]
    configured: str | None = None
    name: str | None = None
    told: set = field(default_factory=set)

    def refresh(self) -> str:
        offered = {m["id"]: m for m in self.fetch()}
        if self.configured:
            self.name = self.configured
        elif len(offered) == 1:
            self.name = next(iter(offered))
        elif self.name not in offered:
            raise RuntimeError(f"the server offers {len(offered)} models; one must be configured")
        return self.name

    def unrecorded(self) -> str | None:
        if self.name is None or self.name in self.told:
            return None
        self.told.add(self.name)
        return self.name


@dataclass
class Config:
    roots: dict[str, str]
    exclude: list[str] = field(default_factory=lambda: ["duplicity-*"])
    metadata_only: list[str] = field(default_factory=list)
    max_file_bytes: int = 10_000_000_000
    near_duplicate_distance: int = 8
    ocr_images: str = "auto"
    workers: int = 1
    model: str | None = None


def load_config(path: str, environ: dict[str, str] | None = None) -> Config:
    """A TOML file, with CATALENS_MODEL, CATALENS_WORKERS and CATALENS_OCR_IMAGES from the environment over it."""
    env = os.environ if environ is None else environ
    with open(path, "rb") as f:
        raw = tomllib.load(f)
    known = {k: raw[k] for k in Config.__dataclass_fields__ if k in raw}
    unknown = set(raw) - set(known)
    if unknown:
        raise ValueError(f"unknown setting {sorted(unknown)[0]!r}")
    for key, cast in (("model", str), ("workers", int), ("ocr_images", str)):
        if value := env.get(f"CATALENS_{key.upper()}"):
            known[key] = cast(value)
    config = Config(**known)
    if not config.roots or not all(os.path.isabs(p) for p in config.roots.values()):
        raise ValueError("roots: absolute paths are needed")
    if config.ocr_images not in ("auto", "always", "never") or config.workers < 1 or not 0 <= config.near_duplicate_distance <= 64:
        raise ValueError("ocr_images, workers or near_duplicate_distance is out of range")
    return config


# ---------------------------------------------------------------- extraction with tools


def document_info(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(path) -> (path, content, page_count, error) of PDF files, for mapInPandas; a missing tool is the row's error."""
    import re

    for pdf in batches:
        rows = []
        for path in pdf["path"]:
            try:
                info = run_tool("pdfinfo", ["--", path]).decode("utf-8", "replace")
                found = re.search(r"(?m)^Pages:\s*(\d+)", info)
                text = run_tool("pdftotext", ["-layout", "-enc", "UTF-8", "--", path, "-"]).decode("utf-8", "replace")
                rows.append((path, text, int(found.group(1)) if found else None, None))
            except (RuntimeError, OSError) as e:
                rows.append((path, None, None, str(e)))
        yield pd.DataFrame(rows, columns=["path", "content", "page_count", "error"]).astype({"page_count": "Int32"})


def probe_videos(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(path) -> (path, probe, error): the probe's JSON for ``parse_probe``."""
    for pdf in batches:
        rows = []
        for path in pdf["path"]:
            try:
                rows.append((path, run_tool("ffprobe", ["-v", "error", "-print_format", "json", "-show_format", "-show_streams", path]).decode("utf-8", "replace"), None))
            except (RuntimeError, OSError) as e:
                rows.append((path, None, str(e)))
        yield pd.DataFrame(rows, columns=["path", "probe", "error"])


def frame_images(batches: Iterator[pd.DataFrame], edge: int = 1024) -> Iterator[pd.DataFrame]:
    """(path, ts_secs) -> (path, ts_secs, jpeg, error): one frame of a video, its longer edge at most ``edge``."""
    for pdf in batches:
        rows = []
        for path, ts in zip(pdf["path"], pdf["ts_secs"]):
            scale = f"scale='min({edge},iw)':'min({edge},ih)':force_original_aspect_ratio=decrease"
            try:
                rows.append((path, ts, run_tool("ffmpeg", ["-v", "error", "-ss", f"{ts:.3f}", "-i", path, "-frames:v", "1", "-vf", scale, "-f", "mjpeg", "-q:v", "3", "-"]), None))
            except (RuntimeError, OSError) as e:
                rows.append((path, ts, None, str(e)))
        yield pd.DataFrame(rows, columns=["path", "ts_secs", "jpeg", "error"])


def page_images(batches: Iterator[pd.DataFrame], dpi: int = 150, edge: int = 1600) -> Iterator[pd.DataFrame]:
    """(path, page) -> (path, page, jpeg, error): one page of a PDF file as a picture."""
    for pdf in batches:
        rows = []
        for path, page in zip(pdf["path"], pdf["page"]):
            try:
                rows.append((path, page, run_tool("pdftoppm", ["-jpeg", "-r", str(dpi), "-scale-to", str(edge), "-f", str(page), "-l", str(page), "-singlefile", path]), None))
            except (RuntimeError, OSError) as e:
                rows.append((path, page, None, str(e)))
        yield pd.DataFrame(rows, columns=["path", "page", "jpeg", "error"])


# ---------------------------------------------------------------- removal


def remove_sources(root: str, rel_paths: list[str], dry_run: bool = True) -> tuple[list[str], list[tuple[str, str]]]:
    """(removed, errors): deletes source files below root and the folders that this empties, up to the root itself.

    Nothing is touched in a dry run; what lies outside the root, or is a link, is refused."""
    base, removed, errors = os.path.realpath(root), [], []
    for rel in rel_paths:
        path = os.path.join(base, rel)
        if not os.path.realpath(path).startswith(base.rstrip("/") + "/") or os.path.islink(path):
            errors.append((rel, "outside the root or a link"))
            continue
        try:
            if not dry_run:
                os.remove(path)
                folder = os.path.dirname(path)
                while folder != base and not os.listdir(folder):
                    os.rmdir(folder)
                    folder = os.path.dirname(folder)
            removed.append(rel)
        except OSError as e:
            errors.append((rel, str(e)))
    return removed, errors
