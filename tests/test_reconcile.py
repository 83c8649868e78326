import datetime as dt
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from catalens import schemas as S
from catalens.operators import reconcile
from catalens.operators.catalogue import Catalogue, empty
from tests.test_search import file, rows

T0, T1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
SCAN = "root string, rel_path string, abs_path string, size_bytes bigint, mode int, mode_str string, uid int, gid int, mtime timestamp_ntz, created timestamp_ntz, kind string, mime string, sha256 string, error string"


def scanned(path, size=10, mtime=T0, kind="image", sha="s", error=None, mode=0o644):
    return ("r", path, f"/x/{path}", size, mode, "rw-r--r--", 1, 1, mtime, None, kind, None, sha, error)


@pytest.fixture(scope="module")
def state(spark):
    base = {"kind": "image", "mtime": T0, "sha256": "s"}
    parts = {name: empty(spark, name) for name in S.SCHEMAS}
    parts["files"] = rows(spark, "files", [
        file("same", "same.png", **base), file("old", "old.png", **base | {"meta_version": 3}), file("touched", "touched.png", **base), file("changed", "changed.png", **base), file("gone", "gone.png", **base), file("deep", "sub/deep.png", **base), file("other", "other.bin", **base),
        file("null", "null.png", **base | {"mtime": None}), file("kind", "kind.png", **base | {"meta_version": 2, "kind": "document"}), file("only", "only.csv", "document", summary_status="skipped", mtime=T0),
    ])
    parts["images"] = rows(spark, "images", [{"file_id": i, "format": "png"} for i in ("same", "changed", "gone", "deep")])
    parts["tags"] = rows(spark, "tags", [{"file_id": "gone", "tag": "x"}])
    return Catalogue(**parts)


@pytest.fixture(scope="module")
def scan(spark):
    return spark.createDataFrame([
        scanned("same.png"), scanned("old.png"), scanned("touched.png", mtime=T1), scanned("changed.png", size=11, mtime=T1, sha="s2"), scanned("new.png"), scanned("bad.png", error="denied"), scanned("other.bin", size=12, kind=None), scanned("big.png", size=10**12),
        scanned("null.png", mtime=None), scanned("kind.png"), scanned("only.csv", kind="document"), scanned("plain.csv", kind="document"), scanned("skip.xyz", kind=None),
    ], SCAN)


def actions(planned):
    return {r["rel_path"]: r["action"] for r in planned.collect()}


def plan(scan, state, **more):
    return reconcile.plan(scan, state.files, max_file_bytes=10**9, metadata_only=F.col("rel_path").endswith(".csv"), **more)


def test_actions(scan, state):
    assert actions(plan(scan, state)) == {
        "same.png": "unchanged", "old.png": "refresh", "touched.png": "touch", "changed.png": "replace", "new.png": "insert", "bad.png": "failed", "other.bin": "unsupported", "big.png": "too_large", "null.png": "unchanged", "kind.png": "reclassified", "only.csv": "unchanged",
        "plain.csv": "metadata_only", "skip.xyz": "unsupported", "gone.png": "delete", "sub/deep.png": "delete",
    }


def test_scope(scan, state):
    assert actions(plan(scan, state, recursive=False)).get("sub/deep.png") is None and actions(plan(scan, state, complete=False)).get("gone.png") is None
    assert actions(plan(scan, state, scope_root="elsewhere")).get("gone.png") is None
    assert {r["id"] for r in reconcile.unseen(state.files, scan, "r", "sub").collect()} == {"deep"}


def test_counters(scan, state):
    assert reconcile.counters(plan(scan, state)).first().asDict() == {"found": 11, "processed": 4, "failed": 1, "skipped": 4, "updated": 2, "removed": 3}


def test_apply(scan, state):
    after = reconcile.apply(state, plan(scan, state), "2024-06-01 00:00:00")
    got = {r["rel_path"]: r for r in after.files.collect()}
    assert set(got) == {"same.png", "old.png", "touched.png", "changed.png", "new.png", "big.png", "null.png", "kind.png", "only.csv", "plain.csv"}
    assert got["touched.png"]["id"] == "touched" and got["touched.png"]["mtime"] == T1 and got["old.png"]["meta_version"] == 6 and got["old.png"]["mtime"] == T0
    assert got["changed.png"]["id"] not in ("changed", None) and got["changed.png"]["summary_status"] == "pending" and got["big.png"]["summary_status"] == "skipped" and got["big.png"]["sha256"] is None
    assert {r["file_id"] for r in after.images.collect()} == {"same"} and after.tags.count() == 0


def test_same_scan_again_changes_nothing(spark, scan, state):
    good = scan.filter("error is null and kind is not null and size_bytes < 1000")
    once = reconcile.apply(state, plan(good, state), "2024-06-01 00:00:00")
    again = actions(plan(good, once))
    assert set(again.values()) == {"unchanged"}


def test_reads_only_what_changed(scan, state):
    need = {r["rel_path"] for r in reconcile.needs_reading(scan, state.files).collect()}
    assert "same.png" not in need and "null.png" not in need and {"old.png", "touched.png", "new.png"} <= need


def test_reuse(spark, state):
    files = rows(spark, "files", [file("d1", "d1.png", sha256="h", summary="old", summary_status="done", indexed_at=T0), file("d2", "d2.png", sha256="h", summary="new", summary_status="done", indexed_at=T1, ocr_status="done"), file("w", "w.png", sha256="h"), file("n", "n.png", sha256=None), file("x", "x.png", sha256="h2")])
    c = replace(state, files=files, ocr=rows(spark, "ocr", [{"file_id": "d2", "page": 1, "text": "t"}, {"file_id": "w", "page": 9, "text": "stale"}]))
    pairs = reconcile.hash_donors(files, files)
    assert {tuple(r) for r in pairs.collect()} == {("w", "d2"), ("d1", "d2"), ("d2", "d1")}
    after = reconcile.reuse(c, pairs.filter("id = 'w'"), mark=True)
    w = after.files.filter("id = 'w'").first()
    assert (w["summary"], w["summary_status"], w["ocr_status"], w["reused_from"]) == ("new", "done", "done", "d2")
    assert {(r["file_id"], r["page"]) for r in after.ocr.collect()} == {("d2", 1), ("w", 1)}
