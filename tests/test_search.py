import datetime as dt

import pytest
from pyspark.sql import functions as F

from catalens import schemas as S
from catalens.operators import search, textindex
from catalens.operators.catalogue import Catalogue, archives_of, empty, latest
from catalens.plans.request import InvalidRequest, compile_request


def rows(spark, name, dicts):
    fields = [f.name for f in S.SCHEMAS[name].fields]
    return spark.createDataFrame([tuple(d.get(f) for f in fields) for d in dicts], S.SCHEMAS[name])


def file(i, path, kind="document", **more):
    name = path.rsplit("/", 1)[-1]
    return {"id": i, "root": "r", "rel_path": path, "abs_path": f"/x/{path}", "file_name": name, "kind": kind, "size_bytes": 10, "mode": 0o644, "summary": "", "summary_status": "pending", "indexed_at": dt.datetime(2024, 5, 1, 12), "mtime": dt.datetime(2024, 5, 1, 12), "meta_version": 6} | more


@pytest.fixture(scope="module")
def corpus(spark):
    parts = {name: empty(spark, name) for name in S.SCHEMAS}
    parts["files"] = rows(spark, "files", [file("a", "a.png", "image"), file("b", "vacation/b.png", "image", mode=0o600, mtime=dt.datetime(2024, 5, 2)), file("n", "notes.txt"), file("m", "readme.md"), file("p", "100%_x.pdf", size_bytes=5000), file("v", "clip.mp4", "video"), file("z", "pack.tar.gz", "archive")])
    parts["images"] = rows(spark, "images", [{"file_id": "a", "format": "png", "width": 32, "height": 16}, {"file_id": "b", "format": "png", "width": 8, "height": 300}])
    parts["documents"] = rows(spark, "documents", [{"file_id": "n", "doc_type": "text", "content": "the quick brown fox jumps"}, {"file_id": "m", "doc_type": "markdown", "content": "# Holiday plans\nbeach and sun"}, {"file_id": "p", "doc_type": "pdf", "content": "Invoice Number 4711", "page_count": 1}])
    parts["videos"] = rows(spark, "videos", [{"file_id": "v", "duration_secs": 30.0, "width": 1920, "height": 1080, "video_codec": "h264"}])
    parts["video_frames"] = rows(spark, "video_frames", [{"file_id": "v", "ts_secs": t, "description": d} for t, d in ((0.0, "empty street"), (10.0, "a man riding a bicycle"), (20.0, "bicycle parked at a wall"))])
    parts["tags"] = rows(spark, "tags", [{"file_id": "a", "tag": "Sun"}, {"file_id": "a", "tag": "sun"}, {"file_id": "n", "tag": "x"}])
    parts["ocr"] = rows(spark, "ocr", [{"file_id": "p", "page": 2, "text": "two"}, {"file_id": "p", "page": 1, "text": "one"}])
    parts["archives"] = archives_of(parts["files"])
    return Catalogue(**parts)


@pytest.fixture(scope="module")
def index(corpus):
    return textindex.build(textindex.bodies(corpus))


def ids(result):
    return [r["id"] for r in result.hits.collect()]


@pytest.mark.parametrize(
    "q, expected",
    [
        ({"kind": "IMAGE", "width": {"gte": 30}}, ["a"]), ({"height": "300"}, ["b"]), ({"path": "VACATION/"}, ["b"]), ({"tag": ["SUN", "none"]}, ["a"]), ({"mode": "600"}, ["b"]), ({"name": "100%_"}, ["p"]), ({"name": "_"}, ["p"]),
        ({"mtime": "2024-05-02"}, ["b"]), ({"mtime": {"gt": "2024-05-01T14:00:00+02:00"}}, ["b"]), ({"mtime": {"eq": "2024-05-02"}}, ["b"]), ({"modified": {"lt": "2024-05-02", "gte": "2024-05-01"}, "kind": "image"}, ["a"]), ({"video_codec": "H264"}, ["v"]), ({"archive_format": "tar.gz"}, ["z"]), ({"id": ["n", "m"]}, ["n", "m"]), ({"page_count": 1}, ["p"]), ({"width": 1920}, ["v"]),
    ],
)
def test_filters(corpus, q, expected):
    assert ids(search.search(corpus, {"q": q})) == expected


def test_text(corpus, index):
    found = search.search(corpus, {"q": {"text": "quick foxes"}}, index)
    assert ids(found) == ["n"] and found.text_mode == "fts" and found.hits.first()["score"] > 0
    assert ids(search.search(corpus, {"q": {"text": "holiday"}}, index)) == ["m"] and ids(search.search(corpus, {"q": {"text": "4711"}}, index)) == ["p"]
    assert search.search(corpus, {"q": {"text": "fox", "kind": "image"}}, index).total == 0
    hit = search.search(corpus, {"q": {"text": "bicycle"}}, index).hits.first()
    assert hit["id"] == "v" and [f["ts_secs"] for f in hit["matched_frames"]] == [10.0, 20.0] and hit["video"]["duration_secs"] == 30.0 and hit["image"] is None


def test_substring_fallback(corpus):
    found = search.search(corpus, {"q": {"text": "FOX fox quick 100%"}})
    assert found.text_mode == "substring" and [(r["id"], r["score"]) for r in found.hits.collect()] == [("n", 3.0), ("p", 1.0)]


def test_paging(corpus):
    assert search.search(corpus, {"q": {"kind": "image"}, "limit": 1}).total == 2
    late = search.search(corpus, {"q": {"kind": "image"}, "offset": 5})
    assert late.total == 2 and ids(late) == []
    assert compile_request({"q": {}, "limit": 1000}).limit == 200 and compile_request({"q": {}, "limit": 0}).limit == 1 and compile_request({}).limit == 20


def test_hit_shape(corpus):
    hits = {r["id"]: r for r in search.search(corpus, {"q": {}}).hits.collect()}
    assert hits["a"]["mode"] == "0644" and hits["a"]["image"]["width"] == 32 and hits["a"]["document"] is None
    assert hits["p"]["ocr_text"] == "one\ntwo" and hits["p"]["document"]["snippet"] == "Invoice Number 4711" and hits["z"]["archive"]["compression"] == "gzip"


@pytest.mark.parametrize(
    "request_",
    [{"q": {"nope": 1}}, {"q": {"height": "tall"}}, {"q": {"height": {"between": 1}}}, {"q": {"height": {}}}, {"q": {"text": "  "}}, {"q": {"text": ["a"]}}, {"q": {"mtime": "last week"}}, {"q": {"kind": []}}, {"q": {"kind": {"a": 1}}}, {"q": {"mode": "9"}}, {"q": {"size_bytes": "nan"}}, {"extra": 1}, {"q": {}, "limit": -1}, {"q": {"mtime": "9999-12-31"}}],
)
def test_invalid(request_):
    with pytest.raises(InvalidRequest):
        compile_request(request_)


def test_index_refresh(spark, corpus, index):
    changed = spark.createDataFrame([("n", "quiet harbour"), ("new", "harbour fox")], "file_id string, body string")
    gone = spark.createDataFrame([("m",)], "file_id string")
    after = textindex.refresh(index, changed, gone)
    assert {r[0] for r in textindex.bm25(after, "harbour").collect()} == {"n", "new"} and {r[0] for r in textindex.bm25(after, "fox").collect()} == {"new"}
    assert textindex.bm25(after, "holiday").count() == 0 and textindex.bm25(after, "the").count() == 0
    assert {r[0] for r in textindex.bm25(after, "harbour fox", conjunctive=True).collect()} == {"new"}


def test_latest(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("a", 2, "y"), ("b", None, "z")], "k string, t int, v string")
    assert {tuple(r) for r in latest(df, ["k"], ["t"]).collect()} == {("a", 2, "y"), ("b", None, "z")}


def test_upgrade_and_duplicates(spark):
    old = spark.createDataFrame([("a", "r"), ("a", "r")], "id string, root string")
    new = S.upgrade(old, "files")
    assert new.schema == S.SCHEMAS["files"] or [f.name for f in new.schema] == [f.name for f in S.SCHEMAS["files"]]
    assert new.first()["meta_version"] == 1 and S.duplicates(new, "files").first()["rows"] == 2
    assert F is not None
