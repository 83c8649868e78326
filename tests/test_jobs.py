import os
import time

import pytest

from catalens.operators import reports
from catalens.operators.jobs import Registry
from catalens.sources import scan


def test_lifecycle(spark):
    reg = Registry(spark)

    def good(job):
        job.add(found=3, processed=2)
        job.fail("a/b", "broken")

    done = reg.wait(reg.start("index", {"path": "/x"}, good).id, 30)
    assert done.status == "completed" and done.counts["failed"] == 1 and done.finished_at is not None
    bad = reg.wait(reg.start("index", {}, lambda job: 1 / 0).id, 30)
    assert bad.status == "failed" and "zero" in bad.error
    rows = reports.job_list(reg.table())
    assert {r["status"] for r in rows.collect()} == {"completed", "failed"} and reports.recent_errors(reg.table()).first()["path"] == "a/b"


def test_pause_cancel_resume(spark):
    reg = Registry(spark)

    def endless(job):
        for _ in range(3000):
            job.check()
            time.sleep(0.01)

    job = reg.start("import_media", {"p": 1}, endless)
    assert reg.pause(job.id) and reg.wait(job.id, 30).status == "paused" and not reg.cancel(job.id)
    again = reg.resume(job.id, endless)
    with pytest.raises(ValueError, match="equal"):
        reg.resume(job.id, endless)
    assert reg.cancel(again.id) and reg.wait(again.id, 30).status == "cancelled"
    with pytest.raises(ValueError, match="completed"):
        reg.resume(reg.wait(reg.start("x", {}, lambda j: None).id, 30).id, endless)


def test_errors_are_a_ring(spark):
    reg = Registry(spark)
    job = reg.wait(reg.start("x", {}, lambda j: [j.fail(str(i), "e") for i in range(80)]).id, 30)
    assert len(job.errors) == 50 and job.errors[0]["path"] == "30" and job.counts["failed"] == 80


def test_remove_sources(tmp_path):
    root = tmp_path / "r"
    for rel in ("old/data/b.png", "old/d.png", "keep/a.png"):
        (root / rel).parent.mkdir(parents=True, exist_ok=True)
        (root / rel).write_text("x")
    (root / "link").symlink_to(tmp_path)
    assert scan.remove_sources(str(root), ["old/d.png"])[0] == ["old/d.png"] and (root / "old/d.png").exists()
    removed, errors = scan.remove_sources(str(root), ["old/data/b.png", "old/d.png", "../x", "link", "none"], dry_run=False)
    assert removed == ["old/data/b.png", "old/d.png"] and [e[0] for e in errors] == ["../x", "link", "none"]
    assert sorted(os.listdir(root)) == ["keep", "link"]


def test_missing_tools_are_errors_of_rows(spark):
    df = spark.createDataFrame([("/nowhere.pdf",)], "path string")
    assert df.mapInPandas(scan.document_info, "path string, content string, page_count int, error string").first()["error"]
    assert df.mapInPandas(scan.probe_videos, "path string, probe string, error string").first()["error"]
    frames = spark.createDataFrame([("/nowhere.mp4", 1.0)], "path string, ts_secs double")
    assert frames.mapInPandas(scan.frame_images, "path string, ts_secs double, jpeg binary, error string").first()["error"]
    pages = spark.createDataFrame([("/nowhere.pdf", 1)], "path string, page int")
    assert pages.mapInPandas(scan.page_images, "path string, page int, jpeg binary, error string").first()["error"]
