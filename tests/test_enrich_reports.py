import datetime as dt

import pytest
from pyspark.sql import functions as F

from catalens import schemas as S
from catalens.operators import enrich, reports
from catalens.operators.catalogue import Catalogue, empty
from catalens.plans.request import InvalidRequest
from tests.test_search import file, rows

T = [dt.datetime(2024, 1, i) for i in range(1, 10)]


@pytest.fixture(scope="module")
def c(spark):
    parts = {name: empty(spark, name) for name in S.SCHEMAS}
    parts["files"] = rows(spark, "files", [
        file("new", "new.png", "image"), file("done", "done.png", "image", summary_status="done", ocr_status="done", summary_model="m0", ocr_model="m0"), file("run", "run.png", "image", summary_status="running"), file("scan", "scan.pdf", summary_status="done"),
        file("vid", "vid.mp4", "video"), file("arc", "arc.zip", "archive"), file("copy", "copy.png", "image", summary_status="done", reused_from="done"), file("txt", "notes/txt.txt", summary_status="failed"),
    ])
    parts["documents"] = rows(spark, "documents", [{"file_id": "scan", "doc_type": "pdf", "page_count": 30, "needs_ocr": True}, {"file_id": "txt", "doc_type": "text", "content": "short"}])
    parts["videos"] = rows(spark, "videos", [{"file_id": "vid", "duration_secs": 9.0}])
    parts["analyses"] = rows(spark, "analyses", [
        {"id": "1", "file_id": "done", "model": "a", "prompt_version": "img-v2", "parsed": '{"visible_text": "OLD"}', "created_at": T[0], "latency_ms": 10}, {"id": "2", "file_id": "done", "model": "b", "prompt_version": "img-v2", "parsed": '{"visible_text": " STOP"}', "created_at": T[1], "latency_ms": 20},
        {"id": "3", "file_id": "done", "model": "o", "prompt_version": "ocr-v1", "created_at": T[2], "latency_ms": None}, {"id": "4", "file_id": "done", "model": "x", "prompt_version": "img-v2", "created_at": T[3], "error": "bad", "latency_ms": 30}, {"id": "5", "file_id": "new", "model": "f", "prompt_version": "img-v2", "parsed": '{"visible_text": null}', "created_at": T[0], "ts_secs": 1.0},
    ])
    return Catalogue(**parts)


def test_candidates(c):
    got = {r["id"]: (r["do_describe"], r["do_ocr"]) for r in enrich.candidates(c).collect()}
    assert got == {"new": (True, True), "scan": (False, True), "vid": (True, False), "txt": (True, False), "copy": (False, True)}
    assert {r["id"] for r in enrich.candidates(c, ["document"], prefix="/x/no").collect()} == {"txt"} and "run" not in {r["id"] for r in enrich.candidates(c, force=True).collect()}
    assert {r["id"] for r in enrich.candidates(c, ids=["vid", "done"]).collect()} == {"vid"}
    assert [r["id"] for r in enrich.in_path_order(enrich.candidates(c), 2).collect()] == ["copy", "new"]
    with pytest.raises(InvalidRequest):
        enrich.candidates(c, ["archive"])


def test_steps(c):
    got = {}
    for r in enrich.steps(enrich.candidates(c)).collect():
        got.setdefault(r["id"], []).append((r["step"], r["page"], r["ts_secs"]))
    assert got["vid"] == [("frame", None, 0.0), ("frame", None, 4.5), ("frame", None, 9.0), ("merge", None, None)] and len(got["scan"]) == 20 and got["scan"][0] == ("ocr", 1, None) and [s[0] for s in got["new"]] == ["describe", "ocr"] and got["txt"][0][0] == "summary"


def test_visible_text_and_decision(c, spark):
    got = enrich.latest_visible_text(c.analyses)
    assert {tuple(r) for r in got.collect()} == {("done", " STOP")}
    assert got.select(enrich.wants_ocr("auto", F.col("visible_text"))).first()[0] and not got.select(enrich.wants_ocr("never", F.col("visible_text"))).first()[0]


def test_calls_and_outcomes(spark, c):
    prompts = spark.createDataFrame([("1", "new", "img-v2", "describe", None), ("2", "txt", "doc-v1", "fail", None), ("3", "vid", "img-v2", "cut", 1.0)], "id string, file_id string, prompt_version string, prompt string, ts_secs double")

    def client(row):
        if row["prompt"] == "fail":
            raise RuntimeError("no answer")
        if row["prompt"] == "cut":
            return {"content": '{"summary": "cu', "truncated": True, "max_tokens": 5}
        return {"content": '<think>{"x": 1}</think>{"summary": "ok"}', "prompt_tokens": 3, "completion_tokens": 4, "latency_ms": 5}

    got = {r["id"]: r for r in enrich.call_model(prompts, client, "m", "2024-01-01 00:00:00").collect()}
    assert got["1"]["parsed"] == '{"summary": "ok"}' and got["1"]["completion_tokens"] == 4 and got["2"]["error"] == "no answer" and got["2"]["raw_response"] is None and got["3"]["error"] == "output truncated at max_tokens=5" and got["3"]["parsed"] is None
    out = spark.createDataFrame([("new", "A dog", None), ("txt", " ", None), ("vid", None, "bad")], "file_id string, summary string, error string")
    f = {r["id"]: r for r in enrich.set_summaries(c, out, "m").files.collect()}
    assert (f["new"]["summary_status"], f["txt"]["summary_status"], f["vid"]["summary_status"], f["done"]["summary_status"]) == ("done", "skipped", "failed", "done") and f["new"]["summary_model"] == "m"
    pages = spark.createDataFrame([("scan", 1, "text", None), ("scan", 2, "", None), ("scan", 3, None, "timeout"), ("e", 1, "", None), ("f", 1, None, "x")], "file_id string, page int, text string, error string")
    status = enrich.page_outcome(pages)
    assert {(r["file_id"], r["ocr_status"], r["failed"]) for r in status.collect()} == {("scan", "done", 1), ("e", "none", 0), ("f", "failed", 1)}
    after = enrich.set_ocr(c, pages, status, "m")
    assert [tuple(r) for r in after.ocr.collect()] == [("scan", 1, "text")] and after.files.filter("id = 'scan'").first()["ocr_status"] == "done"


def test_models(spark, c):
    cols = "model string, n_ctx int, n_ctx_train int, n_params bigint, size_bytes bigint, quantization string, build_info string, first_seen timestamp, last_seen timestamp"
    old = spark.createDataFrame([("m", 8, 1, 1, 1, "q", "b", T[1], T[1])], cols)
    new = spark.createDataFrame([("m", 8, 2, 2, 2, None, "c", T[3], T[3]), ("n", None, 1, 1, 1, "q", "b", T[2], T[2])], cols)
    got = {r["model"]: r for r in enrich.record_models(old, new).collect()}
    assert got["m"]["first_seen"] == T[1] and got["m"]["n_params"] == 2 and got["m"]["quantization"] is None and got["n"]["n_ctx"] == 0
    back = {r["id"]: (r["summary_model"], r["ocr_model"]) for r in enrich.backfill_models(c.files, c.analyses).collect()}
    assert back["done"] == ("b", "o") and back["copy"] == ("b", "o") and back["arc"] == (None, None)
    assert enrich.requeue(c.files).filter("id = 'run'").first()["summary_status"] == "pending"


def test_deletion(c):
    sel = reports.select_for_deletion(c.files, ids=["new"], prefix=("r", "notes"))
    assert {r["id"] for r in sel.collect()} == {"new", "txt"}
    assert {(r["kind"], r["files"], r["bytes"]) for r in reports.deletion_preview(sel).collect()} == {("image", 1, 10), ("document", 1, 10), (None, 2, 20)}
    assert [r["id"] for r in reports.deletion_sample(sel).collect()] == ["new", "txt"]
    for bad in ({}, {"ids": ["x"] * 10_001}):
        with pytest.raises(InvalidRequest):
            reports.select_for_deletion(c.files, **bad)


def test_jobs(spark):
    row = lambda i, s, t, n: {"id": i, "kind": "index", "status": s, "found": 4, "processed": n, "failed": 0, "skipped": 0, "started_at": t}
    jobs = rows(spark, "jobs", [row("a", "completed", T[0], 4), row("b", "running", T[1], 1), row("c", "failed", None, 9) | {"recent_errors": '[{"path": "p", "error": "e"}]'}])
    live = rows(spark, "jobs", [row("b", "running", T[1], 3)])
    assert [(r["id"], r["processed"], r["removed"]) for r in reports.job_list(jobs, live).collect()] == [("b", 3, 0), ("a", 4, 0), ("c", 9, 0)]
    assert {r["id"]: r["percent"] for r in reports.progress(jobs).collect()} == {"a": 100.0, "b": 25.0, "c": 100.0}
    assert reports.recent_errors(jobs).first().asDict() == {"id": "c", "path": "p", "error": "e"} and reports.interrupt_running(jobs).filter("status = 'interrupted'").count() == 1


def test_estimate_and_audit(spark, c):
    names = ["a.jpg", "b.PDF", "Makefile", "x.tar.gz", "n.md", "s.py", "q.weird", "noext", "v.mkv", "big.png"]
    files = rows(spark, "files", [file(n, n, size_bytes=100 if n == "big.png" else 10) for n in names])
    got = {r["category"]: r for r in reports.estimate(files, 50).collect()}
    assert got["image"]["files"] == 2 and got["image"]["too_large"] == 1 and got["image"]["calls_max"] == 2 and got["code"]["files"] == 2 and got["archive"]["files"] == 1 and got["other"]["files"] == 2
    assert [tuple(r) for r in reports.other_extensions(files).collect()] == [("(none)", 1), ("weird", 1)]
    assert reports.video_estimate(c.videos).first().asDict() == {"videos": 1, "seconds": 9.0, "unknown": 0, "frames": 2, "calls": 3}
    audit = {r["prompt_version"]: r for r in reports.prompt_audit(c.analyses).collect()}
    assert audit["img-v2"]["answers"] == 4 and audit["img-v2"]["errors"] == 1 and audit["img-v2"]["avg_latency"] == 20.0
