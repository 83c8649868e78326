import pytest

from catalens.llm import truncation

SCHEMA = "id string, model string, prompt_version string, raw_response string, completion_tokens int, error string, word string, prefix string"
FULL = "The courier moves the lamp post. The lamp post is green. The camera tripod stands beside the old mill."


def frame(spark, answers):
    base = [(f"b{i}", "m", "p", t, 40, None, "x", None) for i, t in enumerate([FULL, FULL + " Keywords: lamp post, old mill, camera tripod", "Tags: old mill, lamp post, ferry", 'Sure. {"text": "a"}\nLet me know', 'Sure. {"text": "b"}\nLet me know', 'Sure. {"text": "c"}\nLet me know'])]
    return spark.createDataFrame(base + [(f"q{i}", "m", "p", *((a, None, None) if isinstance(a, (str, type(None))) else a), None, None) for i, a in enumerate(answers)], SCHEMA)


CASES = [
    ('{"summary": "The lamp', True), ('{"summary": "The lamp post."}', False), ('```json\n{"a": 1}\n```', False), ('```json\n{"a": 1}', True), ("<think>hm", True), ("<think>hm</think>", True), ("<think>hm</think>{\"a\": [1, 2]}", False), ('{"text": "stops sho"}\nLet me know', False), ('{"a": 1}\nLet me', True),
    ("The courier moves the lam", True), ("The courier moves the lamp", True), (FULL + " Keywords: lamp post, old mi", True), (FULL + " Keywords: lamp post, old", True), (FULL + " Keywords: old mill, lamp post", False), (FULL + " Keywords:", True), ("Sure.", True), (None, False), ("", False), ("  \n", False), ('{"a": "bad \\q escape"}', False), ('{"a": "line\nbreak"}', False),
    ((FULL, 128, "output truncated at max_tokens=128"), False), ("x" * 50_000 + ".", False), ('{"a": "' + "y" * 50_000, True),
]


def test_cases(spark):
    got = {r["id"] for r in truncation.truncated(frame(spark, [c[0] for c in CASES])).collect()}
    assert {i for i in got if i.startswith("b")} == set()
    assert [f"q{i}" in got for i in range(len(CASES))] == [c[1] for c in CASES]


def test_evidence(spark):
    """The trie speaks before the length, and both before the form; formulas and words of any length are read whole."""
    long = "Let me know whether " + "this long closing line is what you had in mind, " * 8
    extra = ['{"text": "stands beside the old mi', '{"text": "stands beside the', '{"text": "the old mill', f'{{"a": 1}}\n{long}', f'{{"a": 2}}\n{long}', f'{{"a": 3}}\n{long}', f'{{"a": 4}}\n{long[:300].rpartition(" ")[0]}', '{"a": 1}\nI moved the lam', '{"a": 1}\nAs asked', "w" * 300 + " is it. Here stands " + "w" * 200]
    df = frame(spark, [(t, 64 if i == 1 else 31 + i, "output truncated at max_tokens=64" if i == 1 else None) for i, t in enumerate(extra)])
    got = {r["id"]: r["cause"] for r in truncation.truncated(df).collect()}
    assert got == {"q0": "word", "q1": "length", "q2": "form", "q6": "formula", "q7": "word", "q9": "word"}


def test_piles(spark):
    tokens = [t for t in range(90, 110) for _ in range(20)] + [100] * 80 + [None, 512] + [768] * 6
    assert [r[0] for r in truncation.piled_up(spark.createDataFrame([(t,) for t in tokens], "tokens int")).orderBy("tokens").collect()] == [100, 768]


def test_share_and_repeats(spark):
    df = frame(spark, ['{"a": "x', '{"a": 1}', None])
    got = truncation.truncation_share(df.union(df)).collect()
    assert [(r["answers"], r["truncated"]) for r in got] == [(8, 1)]


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert truncation.truncated(empty).count() == 0 and truncation.truncation_share(empty).count() == 0
    assert truncation.truncated(spark.createDataFrame([(None, None, None, "{", None, None, None, None)], SCHEMA)).count() == 0


def test_trie(spark):
    words = spark.createDataFrame([("lamp", 5), ("lamps", 1), ("lantern", 2)], "word string, n bigint")
    wanted = spark.createDataFrame([("la",), ("lamp",), ("lantern",), ("x",)], "prefix string")
    assert {tuple(r) for r in truncation.trie_nodes(words, wanted).collect()} == {("la", 8, 0), ("lamp", 1, 5), ("lantern", 0, 2)}


@pytest.mark.parametrize("text, state", [("{}", "closed"), ('{"a": {"b": [1]}} x', "closed"), ('{"a": "}"', "open"), ("a { b", "open"), ("plain", "prose"), (" ", "none")])
def test_form(text, state):
    assert truncation.form_of(text)[0] == state
