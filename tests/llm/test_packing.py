import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from catalens.llm import packing


def check(hist, capacity, made):
    used = np.zeros_like(hist)
    for pattern, repeats, _ in made:
        assert repeats > 0 and sum(s * m for s, m in pattern.items()) <= capacity
        for s, m in pattern.items():
            used[s] += m * repeats
    assert (used[1:] == hist[1:]).all()
    return sum(r for _, r, _ in made)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 64), st.integers(1, 500)), max_size=30))
def test_plan_places_everything(sizes):
    hist = np.zeros(65, np.int64)
    for s, n in sizes:
        hist[s] += n
    bins = check(hist, 64, packing.plan(hist, 64))
    need = -(-int((hist * np.arange(65)).sum()) // 64)
    assert bins >= need and bins <= 2 * need  # two containers always hold more than one


def test_fills_well():
    rng = np.random.default_rng(2)
    hist = np.bincount(np.minimum(np.maximum(rng.lognormal(5.5, 0.9, 50_000).astype(int), 1), 2048), minlength=2049).astype(np.int64)
    need = int((hist * np.arange(2049)).sum()) / 2048
    made = packing.plan(hist, 2048)
    bins = check(hist, 2048, made)
    assert bins <= 1.002 * need + 1 and sum(r for _, r, how in made if how == "fitted") > 0.95 * bins


def test_least_squares_never_negative():
    hist = np.zeros(11, np.int64)
    hist[[3, 7, 10]] = [100, 100, 5]
    x = packing.fit_counts([{3: 1, 7: 1}, {10: 1}, {3: 3}], hist)
    assert (x >= 0).all() and abs(x[0] - 100) < 2 and abs(x[1] - 5) < 1


SCHEMA = "doc_id bigint, text string, size string, container string, how string"


@pytest.fixture(scope="module")
def packed(spark):
    rows = [(1, "word " * 5000, None, "x", None), (2, "", None, None, None), (3, None, None, None, None), (4, "short", "s", None, "h"), (4, "short", "s", None, "h"), (None, "lost", None, None, None)] + [(10 + i, "same text here", None, None, None) for i in range(400)]
    return packing.packed(spark.createDataFrame(rows, SCHEMA), capacity=100, per_salt=50).toPandas()


def test_every_piece_once(packed):
    assert not packed.duplicated(["doc_id", "part"]).any() and set(packed["doc_id"]) == {1, 2, 3, 4, *range(10, 410)}
    assert packed.loc[packed["doc_id"].isin([2, 3]), "container"].isna().all()
    placed = packed.dropna(subset=["container"])
    assert (placed.groupby("container")["tokens"].sum() <= 100).all()
    assert all(sorted(g) == list(range(len(g))) for _, g in placed.groupby("container")["position"])
    one = placed[placed["doc_id"] == 1].sort_values("part")
    assert list(one["part"]) == list(range(len(one))) and (one["tokens"].iloc[:-1] == 100).all()
    assert (placed[placed["doc_id"] != 1].groupby("doc_id").size() == 1).all()


def test_empty_and_report(spark):
    empty = packing.packed(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and packing.fill_report(empty).first()["containers"] == 0
