"""Groups of similar records by distributed k-means (problem 1: pictures by perceptual hash).

Method. Each distinct hash is a record; its bits become hashed features, weighted by how rare the bit's value is.
k-means with parallel oversampled seeding (a few rounds that draw many seeds at once by their distance, weighted and
reduced to k on the driver, whose input is bounded by rounds x oversampling x k) divides the records into cells of
about ``cell_size``. In each cell tight clusters of radius ``radius`` are grown around seeds and re-centred. Clusters that a
cell border or the growth parted are joined again by an exact check: every hash visits the buckets of its bands of bits,
chosen so that any two hashes within ``radius`` meet in one, and clusters with members so near become one (components by
label propagation, distributed). Cells that stay too large are divided again by the same k-means.

Exact copies are one record until the end, so a hash that a third of all rows share costs nothing.

Defined results: null and 0 hashes take no part; repeated rows count once; an empty table gives an empty result;
ties in typicality are settled by file_id; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalens.session import checkpoint, spread

BITS = 64


# ---------------------------------------------------------------- features


def feature_matrix(weights: np.ndarray, dims: int, seed: int = 7) -> np.ndarray:
    """(128, dims): row b*64+i is the hashed feature "bit i has value b", signed and weighted."""
    rng = np.random.default_rng(seed)  # a hash of (i, b), the same on every machine
    bucket, sign = rng.integers(0, dims, 2 * BITS), rng.choice([-1.0, 1.0], 2 * BITS)
    m = np.zeros((2 * BITS, dims), np.float32)
    m[np.arange(2 * BITS), bucket] = sign * weights
    return m


def bits_of(hashes: np.ndarray) -> np.ndarray:
    u = hashes.astype(np.int64).view(np.uint64)
    return ((u[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)


def vectors(hashes: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    b = bits_of(hashes)
    return (1 - b) @ matrix[:BITS] + b @ matrix[BITS:]


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :], 0)


def _blocks(batches: Iterator[pd.DataFrame], rows: int = 4096) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for at in range(0, len(pdf), rows):
            yield pdf.iloc[at : at + rows]


# ---------------------------------------------------------------- k-means


def _seed(points: DataFrame, n: int, k: int, matrix: np.ndarray, rounds: int, oversampling: float, seed: int) -> np.ndarray:
    """Parallel oversampled seeding. Draws are functions of (hash, round), so a lost task draws the same again."""
    first = np.array([r[0] for r in points.orderBy(F.xxhash64("phash", F.lit(seed))).limit(1).collect()], np.int64)
    centres = vectors(first, matrix)
    for r in range(rounds):

        def nearest(batches: Iterator[pd.DataFrame], centres=centres) -> Iterator[pd.DataFrame]:
            for pdf in _blocks(batches):
                d = _distances(vectors(pdf["phash"].to_numpy(), matrix), centres).min(1) if len(pdf) else []
                yield pd.DataFrame({"phash": pdf["phash"], "d": np.asarray(d, float)})

        far = points.mapInPandas(nearest, "phash long, d double")
        total = far.agg(F.sum("d")).first()[0] or 0.0
        if total <= 0:
            break
        draw = (F.pmod(F.xxhash64("phash", F.lit(seed * 1000 + r)), F.lit(1 << 30)) / float(1 << 30))
        rows = far.filter(draw < F.col("d") * (oversampling * k / total)).select("phash").collect()  # about oversampling x k
        if rows:
            centres = np.vstack([centres, vectors(np.array([x[0] for x in rows], np.int64), matrix)])

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _blocks(batches):
            a = _distances(vectors(pdf["phash"].to_numpy(), matrix), centres).argmin(1)
            u, c = np.unique(a, return_counts=True)
            yield pd.DataFrame({"c": u.astype(np.int64), "n": c.astype(np.int64)})

    weight = np.zeros(len(centres))
    for c, w in points.mapInPandas(weigh, "c long, n long").groupBy("c").agg(F.sum("n")).collect():
        weight[c] = w
    return _reduce(centres, weight, k, seed)


def _reduce(centres: np.ndarray, weight: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Weighted k-means++ over the drawn seeds."""
    if len(centres) <= k:
        return centres
    rng = np.random.default_rng(seed)
    chosen = [int(weight.argmax())]
    d = _distances(centres, centres[chosen])[:, 0]
    while len(chosen) < k and (p := d * weight).sum() > 0:
        chosen.append(int(rng.choice(len(centres), p=p / p.sum())))
        d = np.minimum(d, _distances(centres, centres[chosen[-1:]])[:, 0])
    return centres[chosen]


def kmeans(points: DataFrame, n: int, k: int, matrix: np.ndarray, rounds: int = 3, iterations: int = 4, oversampling: float = 1.0, seed: int = 11) -> np.ndarray:
    """Centres of the k-means over the column phash. Sums per centre are combined in each task before the shuffle."""
    centres = _seed(points, n, k, matrix, rounds, oversampling, seed)
    dims = matrix.shape[1]
    for _ in range(iterations):

        def sums(batches: Iterator[pd.DataFrame], centres=centres) -> Iterator[pd.DataFrame]:
            total, count = np.zeros((len(centres), dims)), np.zeros(len(centres), np.int64)
            for pdf in _blocks(batches):
                x = vectors(pdf["phash"].to_numpy(), matrix)
                a = _distances(x, centres).argmin(1)
                np.add.at(total, a, x)
                count += np.bincount(a, minlength=len(centres))
            used = np.flatnonzero(count)
            yield pd.DataFrame({"c": used, "n": count[used], "s": pd.Series(list(total[used]), dtype=object)})

        new = centres.astype(np.float64).copy()
        got = points.mapInPandas(sums, "c long, n long, s array<double>").groupBy("c").agg(
            F.sum("n").alias("n"), *(F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(dims))
        )
        for row in got.collect():  # one row for each centre
            new[row[0]] = np.array(row[2:]) / row[1]
        moved = float(((new - centres) ** 2).sum(1).max())
        centres = new.astype(np.float32)
        if moved < 1e-3:
            break
    return centres


# ---------------------------------------------------------------- clusters in cells


def _grow(hashes: np.ndarray, radius: int) -> np.ndarray:
    """Index of the most typical member for each hash: clusters grown around seeds, re-centred once on their majority."""
    u = hashes.astype(np.int64).view(np.uint64)
    label = np.full(len(u), -1)
    rest = np.arange(len(u))
    while len(rest):
        near = np.bitwise_count(u[rest] ^ u[rest[0]]) <= radius
        own = rest[near]
        if len(own) > 2:
            middle = (bits_of(u[own].view(np.int64)).mean(0) > 0.5).astype(np.uint64)
            centre = np.bitwise_or.reduce(middle << np.arange(BITS, dtype=np.uint64))
            near = (np.bitwise_count(u[rest] ^ centre) <= radius) | near
            own = rest[near]
            typical = own[np.lexsort((u[own], np.bitwise_count(u[own] ^ centre)))[0]]
        else:
            typical = own[np.argmin(u[own])]
        label[own] = typical
        rest = rest[~near]
    return label


def _visits(batches: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """The buckets of each hash: the value of each band of bits, at home, and as a guest all values with a further bit set.

    radius // 2 + 1 bands: two hashes within the radius differ by at most one bit in one of them, and there they are equal or
    the one without the bit visits the other."""
    n = radius // 2 + 1
    cuts = [BITS * i // n for i in range(n + 1)]
    for pdf in _blocks(batches):
        h, c = pdf["phash"].to_numpy(np.int64), pdf["typical"].to_numpy(np.int64)
        u = h.view(np.uint64)
        for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            own = (u >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)
            rows, cells = [np.arange(len(h))], [own]
            for bit in range(hi - lo):
                rows.append(np.flatnonzero((own >> np.uint64(bit)) & np.uint64(1) == 0))
                cells.append(own[rows[-1]] | np.uint64(1 << bit))
            at = np.concatenate(rows)
            yield pd.DataFrame({"phash": h[at], "typical": c[at], "band": i, "cell": np.concatenate(cells).view(np.int64), "home": np.arange(len(at)) < len(h)})


def _links(key: tuple, pdf: pd.DataFrame, radius: int, block: int = 1 << 21) -> pd.DataFrame:
    """Pairs of clusters of which two members within the radius meet in one bucket, in blocks."""
    pdf = pdf.sort_values(["cell", "phash"])
    h, c = pdf["phash"].to_numpy(np.int64).view(np.uint64), pdf["typical"].to_numpy(np.int64)
    cell, at_home = pdf["cell"].to_numpy(np.int64), np.flatnonzero(pdf["home"].to_numpy(bool))
    lo, hi = (np.searchsorted(cell[at_home], cell, side) for side in ("left", "right"))
    n = hi - lo
    ends = np.cumsum(n)
    out = [np.zeros((0, 2), np.int64)]
    x = 0
    while x < len(h):
        y = max(x + 1, int(np.searchsorted(ends, (ends[x - 1] if x else 0) + block, "right")))
        i = np.repeat(np.arange(x, y), n[x:y])
        j = at_home[np.arange(len(i)) - np.repeat(ends[x:y] - n[x:y] - (ends[x - 1] if x else 0), n[x:y]) + np.repeat(lo[x:y], n[x:y])]
        near = (np.bitwise_count(h[i] ^ h[j]) <= radius) & (c[i] != c[j])
        out.append(np.unique(np.sort(np.stack([c[i[near]], c[j[near]]], 1), axis=1), axis=0))
        x = y
    out = np.unique(np.concatenate(out), axis=0)
    return pd.DataFrame({"a": out[:, 0], "b": out[:, 1]})


def components(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """(node, label): the least node of each node's component, by label propagation with pointer jumping. Distributed."""
    edges = checkpoint(edges.select("a", "b").filter("a <> b").distinct())
    both = edges.union(edges.select("b", "a")).distinct()
    label = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label"))
    for _ in range(rounds):
        near = both.join(label, both["b"] == label["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = label.join(near, "node", "left").select("node", F.least("label", F.coalesce("near", "label")).alias("new"), "label")
        jump = step.select(F.col("node").alias("new"), F.col("new").alias("far"))
        step = step.join(jump, "new", "left").select("node", F.least("new", F.coalesce("far", "new")).alias("next"), "label")
        step = checkpoint(step)
        changed = step.filter("next <> label").limit(1).count()
        label = step.select("node", F.col("next").alias("label"))
        if not changed:
            break
    return label


def hash_clusters(images: DataFrame, hash_col: str = "phash", radius: int = 8, cell_size: int = 512, k_max: int = 2048, dims: int = 96, oversize: int = 20_000) -> DataFrame:
    """(phash, cluster): every distinct hash with the typical hash of its cluster.

    Two hashes within the radius are always in one cluster: whatever cells and growth parted is joined by an exact check of
    all members. ``k_max`` bounds what is broadcast and collected (k_max x dims floats); beyond k_max x cell_size hashes cells grow,
    and cells over ``oversize`` are divided by a further k-means of their own members."""
    points = images.select(F.col(hash_col).cast("long").alias("phash")).filter("phash is not null and phash <> 0").distinct()
    points = checkpoint(points)
    bit = lambda i: F.sum(F.shiftrightunsigned("phash", i).bitwiseAND(F.lit(1)))
    n, *ones = points.agg(F.count("*"), *(bit(i) for i in range(BITS))).first()
    if not n:
        return points.select("phash", F.col("phash").alias("cluster"))
    ones = np.array([x or 0 for x in ones], float)
    weights = np.sqrt(np.log1p((n + 1) / (np.concatenate([n - ones, ones]) + 1)))
    matrix = feature_matrix(weights, dims)
    points = spread(points)
    k = max(1, min(k_max, -(-n // cell_size)))
    centres = kmeans(points, n, k, matrix)

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _blocks(batches):
            d = _distances(vectors(pdf["phash"].to_numpy(), matrix), centres)
            yield pd.DataFrame({"phash": pdf["phash"].to_numpy(), "cell": d.argmin(1).astype(np.int64)})

    celled = checkpoint(points.mapInPandas(cells, "phash long, cell long"))
    for level in range(1, 5):
        large = [r[0] for r in celled.groupBy("cell").count().filter(F.col("count") > oversize).limit(k_max).select("cell").collect()]
        if not large:
            break
        part = celled.filter(F.col("cell").isin(large))
        m = part.count()
        own = kmeans(part.select("phash"), m, max(2, min(k_max, -(-m // cell_size))), matrix, seed=11 + level)

        def again(batches: Iterator[pd.DataFrame], own=own, level=level) -> Iterator[pd.DataFrame]:
            for pdf in _blocks(batches):
                d = _distances(vectors(pdf["phash"].to_numpy(), matrix), own)
                yield pd.DataFrame({"phash": pdf["phash"].to_numpy(), "cell": d.argmin(1).astype(np.int64) + (level << 32)})

        celled = checkpoint(celled.filter(~F.col("cell").isin(large)).union(part.select("phash").mapInPandas(again, "phash long, cell long")))

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        h = np.sort(pdf["phash"].to_numpy(np.int64))
        return pd.DataFrame({"phash": h, "typical": h[_grow(h, radius)]})

    grown = checkpoint(celled.groupBy("cell").applyInPandas(grow, "phash long, typical long"))

    # what a cell border or the growth parted: all members meet in the buckets of their bands
    guests = spread(grown).mapInPandas(lambda batches: _visits(batches, radius), "phash long, typical long, band int, cell long, home boolean")
    parts = max(16, n // 1024)  # buckets are many and small: some share a task's call
    pairs = guests.groupBy("band", F.pmod("cell", F.lit(parts)).alias("part")).applyInPandas(lambda key, pdf: _links(key, pdf, radius), "a long, b long")
    label = components(pairs)
    return grown.join(label, grown["typical"] == label["node"], "left").select("phash", F.coalesce("label", "typical").alias("cluster"))


def image_clusters(images: DataFrame, file_id: str = "file_id", hash_col: str = "phash", **options) -> DataFrame:
    """(file_id, phash, cluster): every picture with a usable hash."""
    rows = images.select(F.col(file_id).alias("file_id"), F.col(hash_col).alias("phash")).filter("phash is not null and phash <> 0 and file_id is not null").distinct()
    return rows.join(hash_clusters(images, hash_col, **options), "phash").select("file_id", "phash", "cluster")


def cluster_report(images: DataFrame, top: int = 3, file_id: str = "file_id", hash_col: str = "phash", **options) -> DataFrame:
    """(cluster, pictures, hashes, widest, typical): clusters of two pictures or more with their most typical members.

    The centroid is the mean of each bit, summed in each task before the shuffle; ``typical`` lists the ``top`` files
    nearest to it and ``widest`` is the largest distance of a member from the majority bits."""
    rows = checkpoint(image_clusters(images, file_id, hash_col, **options))
    means = rows.groupBy("cluster").agg(
        F.count("*").alias("pictures"),
        F.count_distinct("phash").alias("hashes"),
        F.array(*(F.avg(F.shiftrightunsigned("phash", i).bitwiseAND(F.lit(1))) for i in range(BITS))).alias("mean"),
    ).filter("pictures > 1")
    bit = lambda i: F.shiftrightunsigned("phash", i).bitwiseAND(F.lit(1))
    far = sum((F.abs(bit(i) - F.col("mean")[i]) for i in range(BITS)), F.lit(0.0))
    off = sum((F.abs(bit(i) - (F.col("mean")[i] > 0.5).cast("int")) for i in range(BITS)), F.lit(0))
    # `far` is the same for equal hashes: rank distinct hashes with their least files first
    member = rows.join(means, "cluster").select("cluster", "pictures", "hashes", "file_id", F.round(far, 6).alias("far"), off.alias("off"))
    widest = member.groupBy("cluster").agg(F.max("off").cast("int").alias("widest"))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy("far", "file_id"))
    typical = (
        member.withColumn("rank", rank).filter(F.col("rank") <= top).groupBy("cluster", "pictures", "hashes")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "file_id"))).alias("t"))
    )
    return typical.join(widest, "cluster").select("cluster", "pictures", "hashes", "widest", F.concat_ws(",", "t.file_id").alias("typical"))


def close_pairs(images: DataFrame, radius: int = 8, file_id: str = "file_id", hash_col: str = "phash", **options) -> DataFrame:
    """(file_id_a, file_id_b), a < b: the pairs of pictures of one cluster, each checked to differ in at most ``radius`` bits."""
    rows = image_clusters(images, file_id, hash_col, radius=radius, **options)
    many = rows.groupBy("cluster").agg(F.count("*").alias("n")).filter("n > 1").select("cluster")
    rows = checkpoint(rows.join(many, "cluster"))
    a, b = (rows.select("cluster", F.col("file_id").alias(f"file_id_{x}"), F.col("phash").alias(f"h_{x}")) for x in "ab")
    return (
        a.join(b, "cluster")
        .filter((F.col("file_id_a") < F.col("file_id_b")) & (F.bit_count(F.col("h_a").bitwiseXOR(F.col("h_b"))) <= radius))
        .select("file_id_a", "file_id_b")
        .distinct()
    )
