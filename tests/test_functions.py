import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from catalens.functions import answers, paths, stemming, text


def glob_by_recursion(p: str, t: str) -> bool:
    """The definition of the patterns, position by position."""
    if not p:
        return not t
    if p.startswith("**"):
        return any(glob_by_recursion(p[2:], t[i:]) for i in range(len(t) + 1))
    if p[0] == "*":
        return any(glob_by_recursion(p[1:], t[i:]) for i in range(len(t) + 1) if "/" not in t[:i])
    return bool(t) and (p[0] == t[0] or p[0] == "?" and t[0] != "/") and glob_by_recursion(p[1:], t[1:])


@settings(max_examples=300, deadline=None)
@given(st.text("ab/*?.", max_size=7), st.text("ab/.", max_size=8))
def test_glob_regex_equals_definition(pattern, subject):
    assert bool(re.match(paths.glob_regex(pattern).replace(r"\z", r"\Z"), subject)) == glob_by_recursion(pattern, subject)


@pytest.mark.parametrize(
    "rules, path, is_dir, expected",
    [
        (["duplicity-*"], "a/duplicity-full.gz", False, True), (["*.tmp"], "x/y.tmp", False, True), (["*.tmp"], "y.tmpx", False, False), (["/backup/old/"], "backup/old", True, True), (["/backup/old/"], "backup/old", False, False),
        (["cache/"], "a/cache", True, True), (["photos/*/raw"], "photos/x/raw", True, True), (["photos/*/raw"], "photos/x/y/raw", True, False), (["**/Thumbs.db"], "a/b/Thumbs.db", False, True), (["**/Thumbs.db"], "Thumbs.db", False, False), (["", "/"], "a", False, False),
    ],
)
def test_excludes(rules, path, is_dir, expected):
    assert paths.Excludes(rules).matches(path, is_dir) is expected


def test_exclude_column_prunes_folders(spark):
    rules = paths.Excludes(["cache/", "*.tmp", "old/*/x"])
    names = ["cache/a", "b/cache/c/d", "cache", "a.tmp", "d.tmp/e", "old/1/x", "old/1/x/y", "old/1/2/x", "ok"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    got = {r[0] for r in df.filter(rules.column(F.col("p"))).collect()}
    assert got == {n for n in names if rules.prunes(n)} == {"cache/a", "b/cache/c/d", "a.tmp", "d.tmp/e", "old/1/x", "old/1/x/y"}


def test_path_columns(spark):
    rows = [("a/b/X.Tar.GZ", 0o644), (".bashrc", 0o4755), ("noext", 0), (None, None)]
    df = spark.createDataFrame(rows, "p string, m int").select(paths.extension(paths.file_name(F.col("p"))), paths.parent(F.col("p")), paths.mode_string(F.col("m")), paths.mode_octal(F.col("m")))
    assert [tuple(r) for r in df.collect()] == [("gz", "a/b", "rw-r--r--", "0644"), (None, "", "rwxr-xr-x", "4755"), (None, "", "---------", "0000"), (None, None, None, None)]


def test_confinement(tmp_path):
    root = tmp_path / "root"
    (root / "in").mkdir(parents=True)
    (root / "out").symlink_to(tmp_path)
    roots = {"r": str(root)}
    assert paths.resolve(roots, f"{root}/in") == ("r", str((root / "in").resolve()))
    for bad, error in (("in", ValueError), (f"{root}/../x", paths.OutsideRoots), (f"{root}/out", paths.OutsideRoots)):
        with pytest.raises(error):
            paths.resolve(roots, bad)
    assert paths.split_prefix({"r": "/data"}, "/data//old/") == ("r", "old")
    for bad in ("old", "/data", "/data/../x", "/other/x"):
        with pytest.raises((ValueError, paths.OutsideRoots)):
            paths.split_prefix({"r": "/data"}, bad)


@pytest.mark.parametrize(
    "data, expected",
    [
        (b"plain", ("plain", "ascii")), ("Grüße".encode(), ("Grüße", "utf-8")), ("Grüße".encode()[:-2], ("Grü", "utf-8")), (b"Gr\xfc\xdfe", ("Grüße", "windows-1252")), (b"\xef\xbb\xbfx", ("x", "utf-8")),
        (b"\xff\xfea\0b\0", ("ab", "utf-16le")), (b"\xfe\xff\0a", ("a", "utf-16be")), (b"", ("", "ascii")), (b"\x81\xfc x", ("\x81ü x", "windows-1252")), (None, None),
    ],
)
def test_decode(data, expected):
    assert text.decode_bytes(data) == expected


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=40), st.integers(0, 60))
def test_cap_bytes(s, n):
    cut = text.cap_bytes(s, n)
    assert len(cut.encode("utf-8", "surrogatepass")) <= n or cut == s
    assert s.startswith(cut)


def test_text_columns(spark):
    df = spark.createDataFrame([("30000/1001", 1.5), ("25", 3.0), ("0/0", 10.0), ("x", None)], "r string, d double")
    got = [tuple(r) for r in df.select(F.round(text.parse_rate(F.col("r")), 3), text.sample_times(F.col("d")), text.estimated_frames(F.col("d"), 60, 120), text.clock(F.col("d"))).collect()]
    assert got[0] == (29.97, [0.0], 1, "00:00:02") and got[1] == (25.0, [0.0, 3.0], 2, "00:00:03") and got[2] == (None, [0.0, 5.0, 10.0], 2, "00:00:10") and got[3][:2] == (None, [0.0])
    think = spark.createDataFrame([("<think>a</think> b",), ("x <think>cut",), ("plain ",), ("<think>a</think><think>b</think>c",)], "t string")
    assert [r[0] for r in think.select(text.strip_think(F.col("t"))).collect()] == ["b", "x", "plain", "c"]
    info = spark.createDataFrame([("Title: x\nPages:   12\n",), ("none",)], "t string")
    assert [r[0] for r in info.select(text.page_count(F.col("t"))).collect()] == [12, None]


def test_answers():
    assert answers.parse_object('x {"a": 1} y') == {"a": 1}
    assert answers.parse_object("[1]") is None and answers.parse_object("no") is None and answers.parse_object(None) is None
    assert answers.salvage('{"summary": "A dog", "tags": ["x', "summary") == "A dog"
    assert answers.salvage('{"text": "cut of', "text") is None and answers.salvage('{"text": "cut \\n of\\', "text", partial=True) == "cut \n of"
    assert answers.ocr_text('{"text": " STOP\\nHauptstraße 42 "}') == "STOP\nHauptstraße 42" and answers.ocr_text('{"text": ""}') == "" and answers.ocr_text("prose") is None
    value = {"summary": " A street. ", "people_count": 1, "people": [{"apparent_age": "adult", "gender_presentation": "woman", "clothing": "coat", "hair_colour": "red", "zeal": "", "action": "walks"}, "a child", {}], "objects": ["bike", 3], "tags": [], "scene": " town ", "visible_text": "STOP"}
    assert answers.searchable(value) == "A street.\nPeople visible: 1\nPerson 1: adult, woman; clothing: coat; action: walks; hair colour: red\nPerson 2: a child\nObjects: bike.\nScene: town\nText: STOP"
    assert answers.description('{"summary": "kept", "tags": ["a') == "kept" and answers.description(" prose ") == "prose"


@pytest.mark.parametrize(
    "word, stem",
    [("caresses", "caress"), ("ponies", "poni"), ("ties", "ti"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"),
     ("relational", "relat"), ("conditional", "condit"), ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("electrical", "electr"), ("goodness", "good"), ("revival", "reviv"), ("adjustment", "adjust"), ("adoption", "adopt"), ("effective", "effect"), ("probate", "probat"), ("rate", "rate"), ("controll", "control"), ("roll", "roll"), ("by", "by")],
)
def test_porter(word, stem):
    assert stemming.porter(word) == stem
