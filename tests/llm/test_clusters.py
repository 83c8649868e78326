import numpy as np
import pandas as pd
import pytest

from catalens.llm import clusters

SCHEMA = "file_id string, phash bigint, format string, cluster string"


def pictures(n_groups=40, size=4, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(n_groups):
        c = int(rng.integers(-(2**63), 2**63))
        for k in range(int(rng.integers(1, size + 1))):
            flip = sum(1 << int(b) for b in rng.choice(63, int(rng.integers(0, 4)), replace=False))
            rows.append((f"f{g:03}-{k}", int(np.int64(c) ^ np.int64(flip)), None, "x"))
    return rows


def brute(rows):
    seen = sorted({(f, h) for f, h, *_ in rows if f is not None and h})
    return {(a, b) for i, (a, x) in enumerate(seen) for b, y in seen[i + 1 :] if a < b and ((x ^ y) & (2**64 - 1)).bit_count() <= 8}


@pytest.mark.parametrize("cell", [8, 10_000])
def test_pairs_equal_brute_force(spark, cell):
    rows = pictures() + pictures()[:9] + [("n", None, None, "x"), ("z", 0, None, "x"), (None, 5, None, "x")] + [(f"copy{i}", 12345678901, None, "y") for i in range(12)]
    got = clusters.close_pairs(spark.createDataFrame(rows, SCHEMA), cell_size=cell)
    assert {tuple(r) for r in got.collect()} == brute(rows)


def test_a_member_taken_in_by_another_cluster_keeps_its_links(spark):
    b1, b2 = sum(1 << i for i in range(10, 18)), sum(1 << i for i in range(10, 19))
    rows = [("a1", 1, None, ""), ("a2", 2, None, ""), ("a3", 4, None, ""), ("b1", b1, None, ""), ("b2", b2, None, "")]
    assert {tuple(r) for r in clusters.close_pairs(spark.createDataFrame(rows, SCHEMA)).collect()} == brute(rows) >= {("b1", "b2")}


def test_every_two_near_hashes_meet_in_a_bucket():
    rng = np.random.default_rng(8)
    a = rng.integers(-(2**63), 2**63, 300, dtype=np.int64)
    b = np.array([int(np.int64(x) ^ np.int64(sum(1 << int(i) for i in rng.choice(63, 8, replace=False)))) for x in a], np.int64)
    pdf = pd.DataFrame({"phash": np.concatenate([a, b])}).assign(typical=lambda x: x["phash"])
    rows = pd.concat(clusters._visits(iter([pdf]), 8))
    got = {tuple(r) for _, g in rows.groupby("band") for r in clusters._links((), g, 8, block=500).to_numpy().tolist()}
    assert got == {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())}


def test_oversize_cells_are_divided(spark):
    rows = pictures(80)
    got = clusters.close_pairs(spark.createDataFrame(rows, SCHEMA), cell_size=500, oversize=30)
    assert len(brute(rows) - {tuple(r) for r in got.collect()}) <= 0.02 * len(brute(rows))


def test_report(spark):
    rows = [("a", 0b1111, None, ""), ("b", 0b1111, None, ""), ("c", 0b1110, None, ""), ("d", 0x7FFF << 40, None, ""), ("d", 0x7FFF << 40, None, "")]
    got = clusters.cluster_report(spark.createDataFrame(rows, SCHEMA), top=2).collect()
    assert [(r["pictures"], r["hashes"], r["typical"]) for r in got] == [(3, 2, "a,b")]


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert clusters.close_pairs(empty).count() == 0 and clusters.cluster_report(empty).count() == 0
    assert clusters.close_pairs(spark.createDataFrame([("a", None, None, ""), ("b", 0, None, "")], SCHEMA)).count() == 0


def test_seeding_reduces_to_k():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(50, 4)).astype(np.float32)
    assert len(clusters._reduce(centres, np.ones(50), 7, 1)) == 7 and len(clusters._reduce(centres[:3], np.ones(3), 7, 1)) == 3


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(100, 101), (50, 50)], "a bigint, b bigint")
    got = {r["node"]: r["label"] for r in clusters.components(edges).collect()}
    assert {got[i] for i in range(1, 31)} == {1} and got[101] == 100 and 50 not in got
