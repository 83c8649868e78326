"""Filling containers of fixed capacity with texts (problem 6), by patterns and non-negative least squares.

Method. Sizes are tokens of a public tokenizer. Texts longer than the capacity are cut into full pieces and a rest; no
other text is split. Only the histogram of sizes (at most ``capacity`` rows) comes to the driver. There patterns of a
few sizes that fill a container (nearly) to the last token are enumerated, and their repeat counts are fitted to the
histogram by non-negative least squares with a penalty on unused room. Counts are rounded down and then by largest remainder,
as far as pieces last, and the patterns of what is left are enumerated and fitted again, until a pass places nothing. Only
what no good pattern takes is packed best-fit-decreasing. The plan has at most a few thousand patterns, whatever the
number of texts. Each piece then finds its place by its rank among the pieces of its size: ranks are counted within
hash salts, more of them the more texts there are, and shifted by the salts' totals, so a size that a third of all texts
share is not ranked in one task.

Defined results: null texts and texts without tokens take no place and give null container and position; repeated rows
of an id count once (the least text is taken); ties in size are ordered by salt and id; the plan is deterministic.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalens.session import checkpoint, spread

TOKENIZERS = "/opt/tokenizers"
#: The public splitting pattern of the byte-level vocabulary.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_loaded: dict[str, object] = {}


def tokenizer(path: str):
    """The encoding of a vocabulary file of ranks, loaded once in each worker."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def token_counts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc, tokens) for every row; null and empty texts have 0 tokens."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokenizer(vocabulary).encode_ordinary
        for pdf in batches:
            yield pd.DataFrame({"doc": pdf["doc"], "tokens": [len(encode(t)) if t else 0 for t in pdf["text"]]})

    docs = documents.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).filter("doc is not null")
    return spread(docs).mapInPandas(count, f"doc {docs.schema['doc'].dataType.simpleString()}, tokens long")


# ---------------------------------------------------------------- the plan


def enumerate_patterns(hist: np.ndarray, capacity: int, per_size: int = 12) -> list[dict[int, int]]:
    """Patterns that the pieces of ``hist`` suffice for: each size with some common sizes and some spread over all, completed
    by one or two sizes that fill the rest exactly where there are such, else by the largest that fit."""
    have = hist > 0
    have[0] = False
    sizes = np.flatnonzero(have)
    out: dict[tuple, dict[int, int]] = {}

    def complete(parts: list[int]) -> None:
        room = capacity - sum(parts)
        while room > 0 and len(fit := sizes[: np.searchsorted(sizes, room, "right")]):
            if have[room]:
                parts = [*parts, room]
                break
            low = fit[: np.searchsorted(fit, room // 2, "right")]
            low = low[have[room - low]]
            parts = [*parts, int(low[-1]), room - int(low[-1])] if len(low) else [*parts, int(fit[-1])]
            room = capacity - sum(parts)
        key = tuple(sorted(map(int, parts)))
        count = Counter(key)
        if all(m <= hist[x] for x, m in count.items()):
            out.setdefault(key, dict(count))

    common = sizes[np.argsort(-hist[sizes], kind="stable")]
    for s in map(int, sizes):
        complete([s])
        fit = sizes[: np.searchsorted(sizes, min(capacity - s, s), "right")]
        if len(fit):
            second = [int(x) for x in common[common <= fit[-1]][: per_size // 2]] + [int(fit[i]) for i in np.linspace(0, len(fit) - 1, per_size // 2).astype(int)]
            for t in dict.fromkeys(second):
                complete([s, t])
                if s == t:
                    complete([s] * int(min(capacity // s, hist[s])))
    return list(out.values())


def fit_counts(patterns: list[dict[int, int]], hist: np.ndarray, penalty: np.ndarray | float = 0.0, tolerance: float = 5e-4) -> np.ndarray:
    """min |A x - hist|^2 + 2 penalty x over x >= 0; a column of A holds the sizes of one pattern. Multiplicative steps, which keep x
    from below 0 and never raise the sum, until a step gains less than ``tolerance`` of it."""
    row = np.array([s for p in patterns for s in p], np.int64)
    of = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    times = np.array([m for p in patterns for m in p.values()], float)
    want = np.bincount(of, times * hist[row], len(patterns))
    x = want / np.maximum(np.bincount(of, times * np.bincount(row, times, len(hist))[row], len(patterns)), 1e-12)
    before = np.inf
    while True:
        made = np.bincount(row, times * x[of], len(hist))
        error = float(((made - hist) ** 2).sum() + 2 * (penalty * x).sum())
        if not error < before * (1 - tolerance):
            return x
        before = error
        x = x * want / np.maximum(np.bincount(of, times * made[row], len(patterns)) + penalty, 1e-12)


def plan(hist: np.ndarray, capacity: int, unused: int | None = None) -> list[tuple[dict[int, int], int, str]]:
    """(pattern, repeats, how): a packing of the whole histogram; how is fitted or residual. Fitted patterns leave at most
    ``unused`` tokens free."""
    unused = capacity // 128 if unused is None else unused
    left = hist.astype(np.int64).copy()
    left[0] = 0
    out: list[tuple[dict[int, int], int, str]] = []

    def take(pattern: dict[int, int], repeats: int, how: str) -> int:
        repeats = min(int(repeats), *(int(left[s]) // m for s, m in pattern.items()))
        if repeats > 0:
            for s, m in pattern.items():
                left[s] -= m * repeats
            out.append((pattern, repeats, how))
        return max(repeats, 0)

    while True:
        patterns = enumerate_patterns(left, capacity)
        waste = np.array([capacity - sum(s * m for s, m in p.items()) for p in patterns], float)
        good = np.flatnonzero(waste <= unused)
        if not len(good):
            break
        patterns, waste = [patterns[j] for j in good], waste[good]
        x = fit_counts(patterns, left, waste)
        placed = sum(take(patterns[j], int(x[j]), "fitted") for j in np.lexsort((-x, waste)))
        part = x - np.floor(x)
        placed += sum(take(patterns[j], 1, "fitted") for j in np.lexsort((waste, -part)) if part[j] >= 0.5 * part.max())
        if not placed:
            break
    while left.any():  # best fit decreasing, many equal containers at once; each round uses up a size
        pattern: dict[int, int] = {}
        room, avail = capacity, left.copy()
        at = capacity
        while room > 0:
            fit = np.flatnonzero(avail[1 : min(room, at) + 1])
            if not len(fit):
                break
            at = int(fit[-1]) + 1
            m = int(min(room // at, avail[at]))
            pattern[at] = m
            avail[at] -= m
            room -= at * m
            at -= 1
        take(pattern, left.sum(), "residual")
    return out


# ---------------------------------------------------------------- the assignment


def packed(documents: DataFrame, capacity: int = 2048, doc_id: str = "doc_id", text: str = "text", per_salt: int = 250_000, **options) -> DataFrame:
    """(doc_id, part, tokens, container, position, how): every piece of every document in its place.

    Containers are numbered from 0, positions within a container from 0; ``part`` counts the pieces of a text; ``how`` says
    whether the container's pattern was fitted or residual. ``per_salt``: so many pieces of one size are ranked in one task."""
    counts = token_counts(documents, doc_id, text, **options).groupBy("doc").agg(F.min("tokens").alias("tokens"))
    counts = checkpoint(counts)
    salts = 1 + (counts.groupBy("tokens").count().agg(F.max("count")).first()[0] or 0) // per_salt  # the most frequent size decides
    pieces = counts.filter("tokens > 0").select(
        "doc", F.col("tokens").alias("total"), F.explode(F.sequence(F.lit(0), F.expr(f"int((tokens - 1) div {capacity})"))).alias("part")
    ).select("doc", "part", F.least(F.lit(capacity), F.col("total") - F.col("part").cast("long") * capacity).cast("int").alias("size"), F.pmod(F.xxhash64("doc", "part"), F.lit(salts)).cast("int").alias("salt"))
    hist, offset = np.zeros(capacity + 1, np.int64), {}
    for size, salt, n in sorted(map(tuple, pieces.groupBy("size", "salt").count().collect())):  # capacity x salts rows at most
        offset[size, salt] = int(hist[size])
        hist[size] += n
    slots: dict[int, list[tuple[int, int, int, int, bool]]] = {}  # size -> (first rank, repeats, first container, first position, fitted)
    used, base = np.zeros(capacity + 1, np.int64), 0
    for pattern, repeats, how in plan(hist, capacity):
        position = 0
        for size in sorted(pattern, reverse=True):
            slots.setdefault(size, []).append((int(used[size]), repeats, base, position, how == "fitted"))
            used[size] += pattern[size] * repeats
            position += pattern[size]
        base += repeats
    table = {s: tuple(np.array(c, np.int64) for c in zip(*v)) for s, v in slots.items()}

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            size, salt = pdf["size"].to_numpy(), pdf["salt"].to_numpy()
            rank = pdf["rank"].to_numpy().astype(np.int64) - 1
            container, position, by = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64), np.zeros(len(pdf), bool)
            for s in np.unique(size):
                first, repeats, start, slot, fitted = table[int(s)]
                own = np.flatnonzero(size == s)
                r = rank[own] + np.array([offset[int(s), int(x)] for x in salt[own]], np.int64)
                i = np.searchsorted(first, r, "right") - 1
                k = r - first[i]
                container[own], position[own], by[own] = start[i] + k % repeats[i], slot[i] + k // repeats[i], fitted[i]
            yield pd.DataFrame({"doc": pdf["doc"], "part": pdf["part"], "tokens": size.astype(np.int64), "container": container, "position": position.astype(np.int32), "how": np.where(by, "fitted", "residual")})

    ranked = pieces.withColumn("rank", F.row_number().over(Window.partitionBy("size", "salt").orderBy("doc", "part")))
    kind = counts.schema["doc"].dataType.simpleString()
    placed = ranked.mapInPandas(place, f"doc {kind}, part int, tokens long, container long, position int, how string")
    empty = counts.filter("tokens = 0").select("doc", F.lit(0).alias("part"), "tokens", F.lit(None).cast("long").alias("container"), F.lit(None).cast("int").alias("position"), F.lit(None).cast("string").alias("how"))
    return placed.unionByName(empty).withColumnRenamed("doc", doc_id)


def fill_report(packing: DataFrame, capacity: int = 2048) -> DataFrame:
    """(pieces, tokens, containers, least, fill, fitted): ``least`` is the number of containers that the tokens need at best,
    ``fitted`` the share of containers whose pattern the least squares gave."""
    per = packing.filter("container is not null").groupBy("container").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"), F.max(F.col("how") == "fitted").alias("fitted"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pieces"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"), F.count("*").alias("containers"), F.count_if("fitted").alias("by_fit")).select(
        "pieces", "tokens", "containers", F.ceil(F.col("tokens") / capacity).alias("least"), F.round(F.try_divide(F.col("tokens"), F.col("containers") * capacity), 6).alias("fill"),
        F.round(F.try_divide(F.col("by_fit"), F.col("containers")), 6).alias("fitted"),
    )
