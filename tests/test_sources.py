import gzip
import io
import os
import tarfile

import pytest

from catalens import schemas as S
from catalens import state
from catalens.functions.paths import Excludes
from catalens.operators import reconcile
from catalens.operators.catalogue import Catalogue, empty
from catalens.sources import classify, scan
from catalens.streaming import rescan
from tests.test_search import file, rows

PNG = b"\x89PNG\r\n\x1a\n" + bytes(30)


def tar_bytes():
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        t.addfile(tarfile.TarInfo("x"), io.BytesIO(b""))
    return out.getvalue()


@pytest.mark.parametrize(
    "name, data, expected",
    [
        ("app.py", b"print(1)", ("document", "code", "python", None)), ("site.css", b"a{}", ("document", "code", "css", None)), ("index.html", b"<html>", ("document", "code", "html", None)), ("deploy", b"#!/bin/bash\nls", ("document", "code", "shell", None)), ("run", b"#!/usr/bin/env -S python3 -x", ("document", "code", "python", None)),
        ("brief.txt", b"Gr\xfc\xdfe aus K\xf6ln", ("document", "text", None, None)), ("readme.md", b"# x", ("document", "markdown", None, None)), ("mislabeled.jpg", PNG, ("image", None, None, None)), ("no_extension", PNG, ("image", None, None, None)), ("x.7z", b"7z\xbc\xaf\x27\x1c" + bytes(8), ("archive", None, None, "7z")),
        ("x", tar_bytes(), ("archive", None, None, "tar")), ("x.tbz2", b"BZh91AY" + bytes(8), ("archive", None, None, "tar.bz2")), ("backup.gz", gzip.compress(tar_bytes()), ("archive", None, None, "tar.gz")), ("notes.gz", gzip.compress(b"text"), ("archive", None, None, "gz")), ("bundle.zip", b"PK\x03\x04" + bytes(40), ("archive", None, None, "zip")),
        ("export.csv", b"\xff\xfea\0,\0", ("document", "text", None, None)), ("a.pdf", b"%PDF-1.4", ("document", "pdf", None, None)), ("v.mp4", b"\0\0\0\x18ftypisom", ("video", None, None, None)), ("v.ogv", b"OggS" + bytes(9), ("video", None, None, None)), ("Dockerfile", b"FROM x", ("document", "code", "dockerfile", None)), ("cut.txt", "ü".encode() * 10 + b"\xc3", ("document", "text", None, None)),
    ],
)
def test_classify(name, data, expected):
    got = classify.classify(name, data)
    assert (got["kind"], got["doc_type"], got["language"], got["format"]) == expected


@pytest.mark.parametrize("name, data", [("talk.odp", b"PK\x03\x04" + bytes(22) + b"\x08\0\0\0mimetypeapplication/vnd.oasis.opendocument.presentationPK"), ("random.bin", bytes(range(256))), ("x.exe", b"MZ" + bytes(20)), ("empty", b""), ("song.mp3", b"ID3" + bytes(9)), ("sound.ogg", b"OggS" + bytes(9)), ("pic.heic", b"\0\0\0\x18ftypheic")])
def test_unsupported(name, data):
    assert classify.classify(name, data) is None


@pytest.fixture
def tree(tmp_path):
    for rel, data in {"a.png": PNG, "sub/b.png": PNG + b"1", ".hidden/c.png": PNG, "notes.txt": b"hello", "readme.md": b"# x", "ignored.xyz": b"\0\1\2 binary", "cache/x.txt": b"x", "y.tmp": b"y"}.items():
        (tmp_path / rel).parent.mkdir(exist_ok=True)
        (tmp_path / rel).write_bytes(data)
    os.symlink(tmp_path / "a.png", tmp_path / "link.png")
    return str(tmp_path)


def test_walk(tree):
    found, complete = scan.walk(tree, excludes=Excludes(["cache/", "*.tmp"]))
    assert complete and sorted(found) == ["a.png", "ignored.xyz", "notes.txt", "readme.md", "sub/b.png"]
    assert sorted(scan.walk(tree, traverse=False)[0]) == ["a.png", "ignored.xyz", "notes.txt", "readme.md", "y.tmp"] and scan.walk(tree + "/nowhere") == ([], False) and scan.walk(tree, tree + "/a.png") == (["a.png"], True)


def test_scan_and_reconcile(spark, tree):
    c = Catalogue(**{name: empty(spark, name) for name in S.SCHEMAS})
    paths, _ = scan.walk(tree, excludes=Excludes(["cache/", "*.tmp"]))
    stats = scan.stat_scan(spark, "r", tree, [*paths, "missing.png"])
    read = scan.read_scan(reconcile.needs_reading(stats.filter("error is null"), c.files)).withColumn("mode_str", classify_mode())
    first = reconcile.plan(read, c.files)
    assert reconcile.counters(first).first()["processed"] == 4 and stats.filter("error is not null").count() == 1
    got = {r["rel_path"]: r for r in read.collect()}
    assert got["notes.txt"]["sha256"] == "2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824" and got["ignored.xyz"]["kind"] is None and got["a.png"]["mtime"].microsecond is not None
    after = reconcile.apply(c, first, "2024-01-01 00:00:00")
    assert after.files.count() == 4 and reconcile.needs_reading(stats.filter("error is null"), after.files).count() == 1  # only the unsupported file
    body = scan.contents(spark, tree, "*.txt").filter("path like '%notes.txt'").first()
    assert body["sha256"] == got["notes.txt"]["sha256"]


def classify_mode():
    from pyspark.sql import functions as F

    from catalens.functions.paths import mode_string

    return mode_string(F.col("mode"))


def test_cache(spark, tmp_path):
    (tmp_path / "1.jsonl").write_text('{"p": "a", "h": "ffffffffffffffff", "w": 2, "ht": 1}\n{"p": "b", "err": "bad"}\n{"p": "a", "h": "0000000000000001", "w": 1, "ht": 2}\n')
    pictures, errors = scan.read_cache(spark, str(tmp_path / "1.jsonl"))
    assert [tuple(r) for r in pictures.collect()] == [("a", 1, False)] and errors.count() == 1
    assert [r[0] for r in scan.not_cached(spark.createDataFrame([("a",), ("z",)], "path string"), pictures).collect()] == ["z"]
    scan.append_cache(spark.createDataFrame([("n", -1, 3, 2)], "path string, phash bigint, width int, height int"), str(tmp_path / "out"))
    again, _ = scan.read_cache(spark, str(tmp_path / "out"))
    assert [tuple(r) for r in again.collect()] == [("n", -1, True)]


def test_probe(spark):
    probe = '{"streams": [{"codec_type": "audio", "codec_name": "aac"}, {"codec_type": "video", "codec_name": "h264", "width": 1920, "height": 1080, "avg_frame_rate": "0/0", "r_frame_rate": "30000/1001", "duration": "9"}], "format": {"format_name": "mov", "duration": "30.5", "bit_rate": "100"}}'
    got = scan.parse_probe(spark.createDataFrame([("v", probe), ("x", "{}")], "file_id string, probe string")).collect()
    assert (got[0]["duration_secs"], got[0]["video_codec"], got[0]["audio_codec"], round(got[0]["fps"], 2), got[0]["bitrate"]) == (30.5, "h264", "aac", 29.97, 100) and got[1]["duration_secs"] is None


def test_tools_models_config(tmp_path):
    with pytest.raises(RuntimeError, match="not installed"):
        scan.run_tool("no-such-program", [])
    with pytest.raises(RuntimeError, match="failed"):
        scan.run_tool("python", ["-c", "raise SystemExit(3)"])
    offered = [{"id": "a"}]
    m = scan.ModelChoice(lambda: offered)
    assert m.refresh() == "a" and m.unrecorded() == "a" and m.unrecorded() is None
    offered.append({"id": "b"})
    assert m.refresh() == "a"
    with pytest.raises(RuntimeError):
        scan.ModelChoice(lambda: offered).refresh()
    path = tmp_path / "c.toml"
    path.write_text('workers = 2\n[roots]\nr = "/data"\n')
    got = scan.load_config(str(path), {"CATALENS_WORKERS": "3"})
    assert got.workers == 3 and got.exclude == ["duplicity-*"]
    for bad in ('[roots]\nr = "data"\n', 'nope = 1\n[roots]\nr = "/d"\n', 'ocr_images = "maybe"\n[roots]\nr = "/d"\n'):
        path.write_text(bad)
        with pytest.raises(ValueError):
            scan.load_config(str(path), {})


def test_snapshots(spark, tmp_path):
    base = str(tmp_path / "store")
    assert state.read(spark, base).files.count() == 0
    c = Catalogue(**{name: empty(spark, name) for name in S.SCHEMAS})
    one = Catalogue(**{**c.__dict__, "files": rows(spark, "files", [file("a", "a.png")])})
    assert state.write(one, base) == 1 and state.write(c, base, expected=1) == 2 and state.current(spark, base) == 2
    assert state.read(spark, base).files.count() == 0 and state.read(spark, base, 1).files.first()["id"] == "a"
    with pytest.raises(RuntimeError):
        state.write(c, base, expected=1)
    state.append_analyses(c.analyses, base)


def test_stream(spark, tree, tmp_path_factory):
    out = tmp_path_factory.mktemp("stream")
    seen = []
    q = rescan.follow(rescan.arrivals(spark, tree, "*.{png,txt}"), lambda df, n: seen.extend((r["path"].rsplit("/", 1)[-1], r["kind"]) for r in df.collect()), str(out / "cp"))
    q.awaitTermination(60)
    assert {("a.png", "image"), ("notes.txt", "document"), ("b.png", "image")} <= set(seen)
    q = rescan.follow(rescan.arrivals(spark, tree, "*.{png,txt}"), lambda df, n: seen.append(("again", df.count())), str(out / "cp"))
    q.awaitTermination(60)
    assert ("again", 0) in seen or not any(s[0] == "again" for s in seen)
