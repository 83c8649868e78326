import numpy as np
import pytest

from catalens.llm import leakage

DOCS = "doc_id bigint, text string, item string, words string"
ITEMS = "item_id bigint, text string, doc string"
W = [f"w{i}x" for i in range(200)]
ITEM = " ".join(W[:40])
BOILER = "read the passage with care and answer the question in one short sentence without adding anything else at all please"


def run(spark, docs, items=None):
    items = items or [(1, ITEM, None), (2, " ".join(W[50:90]), None), (3, f"{BOILER} {' '.join(W[100:130])}", None), (4, f"{BOILER} {' '.join(W[130:160])}", None), (5, f"{BOILER} {' '.join(W[160:190])}", None), (6, None, None), (7, "too short", None)]
    df = spark.createDataFrame([(i, t, None, "x") for i, t in enumerate(docs)], DOCS)
    return {(r["doc_id"], r["item_id"]) for r in leakage.leaks(df, spark.createDataFrame(items, ITEMS)).collect()}


def changed(words, every):
    return [w if i % every else "other" for i, w in enumerate(words, 1)]


def test_found_and_not(spark):
    docs = [
        "before " + ITEM + " after", "x " + " ".join(W[5:23]) + " y", "x " + " ".join(W[5:22]) + " y", " ".join(changed(W[:40], 9)), " ".join(changed(W[:40], 4)), " ".join(reversed(W[:40])),
        " ".join(w.upper() + ("," if i % 3 else " —") for i, w in enumerate(W[:30])), "<b>" + "</b> **".join(W[50:80]) + "**", " ".join(W[50:60]) + " w6-\n0x " + " ".join(W[61:80]), "> " + "\n> ".join(W[50:75]), BOILER, f"{BOILER} {W[100]}", None, "", " ".join(W[0:10] + W[50:60]),
        ITEM + " filler " + ITEM + " " + " ".join(W[50:90]),
    ]
    assert run(spark, docs) == {(0, 1), (1, 1), (3, 1), (6, 1), (7, 2), (8, 2), (9, 2), (15, 1), (15, 2)}


def test_long_documents_and_repeats(spark):
    long = "noise " * 50_000 + ITEM + " noise" * 1000
    df = spark.createDataFrame([(1, long, None, None), (1, long, None, None)], DOCS)
    got = leakage.leaks(df, spark.createDataFrame([(9, ITEM, None), (9, ITEM, None)], ITEMS)).collect()
    assert [(r["doc_id"], r["item_id"], r["at"], r["words"]) for r in got] == [(1, 9, 50_000, 40)]


def test_words_put_in_and_left_out(spark):
    docs = [
        " ".join(W[:12] + ["extra"] + W[12:24]), " ".join(W[:12] + W[13:26]), " ".join(W[:9] + ["extra", "words", "here", "and", "there"] + W[9:18]), " ".join(W[:12] + ["w12", "x"] + W[13:26]),
        " ".join(W[:4] + ["a"] + W[4:8] + ["b"] + W[8:12] + ["c"] + W[12:16] + ["d"] + W[16:20]), " ".join(W[0:9] + ["mid"] + W[59:68]),
    ]
    assert run(spark, docs) == {(0, 1), (1, 1), (3, 1)}


def test_without_broadcast(spark):
    df = spark.createDataFrame([(1, "x " + ITEM, None, None), (2, "nothing of it", None, None)], DOCS)
    got = leakage.leaks(df, spark.createDataFrame([(9, ITEM, None)], ITEMS), broadcast_terms=0).collect()
    assert [tuple(r) for r in got] == [(1, 9, 1, 40)]


def test_block_size():
    assert leakage.block_size(18, 8) == 4 and leakage.block_size(40, 8) == 5
    with pytest.raises(ValueError):
        leakage.block_size(8, 2)


def test_empty(spark):
    assert run(spark, []) == set()
    assert leakage.leaks(spark.createDataFrame([(1, ITEM, None, None)], DOCS), spark.createDataFrame([], ITEMS)).count() == 0


def test_best_run_equals_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        same, shared = rng.random(n) < 0.85, rng.random(n) < 0.1
        best = 0
        for a in range(n):
            for b in range(a + 1, n + 1):
                if same[a] and same[b - 1] and (~same[a:b]).sum() * 8 <= b - a and (~shared[a:b]).sum() >= 18:
                    best = max(best, b - a)
        got = leakage.best_run(same, shared, 18, 8)
        assert (got[1] - got[0] if got else 0) == best


def test_markup_of_any_kind_makes_no_words(spark):
    long = "<a href='" + "x/" * 200 + "'>"
    texts = ["one &mdash; two&nbsp;caf&eacute; &#8212; don&#x2019;t", f"One {long}two</a> caf\u00e9 don't", "[one](https://a.example/b_(c) 'some title') two [caf\u00e9][ref] don&rsquo;t", "one <!-- a > b --> two caf&#233; don&#146;t", "one two caf\u00e9 &#0; don't"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = [r["w"] for r in df.orderBy("i").select(leakage.words_of("text").alias("w")).collect()]
    assert got == [["one", "two", "caf\u00e9", "dont"]] * 5
    odd = spark.createDataFrame([("a & b; x &foo; y &#xD800; z &#9999999; AT&T [note](see the page)",)], "text string").select(leakage.words_of("text").alias("w")).first()["w"]
    assert odd == ["a", "b", "x", "foo", "y", "z", "at", "t", "note", "see", "the", "page"]
