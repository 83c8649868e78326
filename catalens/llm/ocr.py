"""Noise in text from scanned pages (problem 2): hyphens at line ends, misread signs, running headers, page numbers.

Method.
* Vectors: co-occurrence counts of all words within ``window`` words are summed over the cluster; skip-gram vectors with
  negative sampling are learned from them, each task on its share of the pairs, averaged after every epoch. Words are
  hashed into ``BUCKETS`` rows, which bounds the model.
* Misread words: plausible glyph edits (``GLYPHS``) of frequent words are hash-joined with the corpus' rare words; where a
  rare word has several frequent neighbours, the vectors choose the one that fits its context, and a neighbour that is
  not much more frequent must fit its context better than words do on average.
* Hyphens: a line end is a split word if the joined form is a word, and none if only the hyphenated form is one.
* Furniture: a line at a page's edge that recurs on other pages of the file, compared by letters that survive misreading;
  numbers at the edge (also roman, "3/7", "page 3 of 7") that keep one distance to the page's number.
* Reflow: furniture goes, words are joined and corrected, lines of a paragraph become one.

Vocabulary, recurrences and corrections are joined, not collected; only the vectors are broadcast.

Defined results: null and empty texts give no row; repeated rows count once; pages whose copies differ are judged for
each copy and reported once; a file may have any number of pages, its pages are never gathered in one task.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalens.session import checkpoint, spread

#: What a scanner reads for what is printed.
GLYPHS = (
    ("e", "c"), ("a", "o"), ("t", "f"), ("i", "!"), ("o", "0"), ("n", "ri"), ("i", "l"), ("s", "5"), ("l", "1"), ("h", "b"), ("d", "cl"), ("g", "9"), ("u", "ii"), ("m", "rn"), ("w", "vv"), ("r", "i~"), ("li", "h"),
    ("ü", "ii"), ("é", "6"), ("ö", "6"), ("ó", "6"), ("ä", '"a'), ("ü", '"u'), ("ö", '"o'), ("ñ", "fi"), ("ß", "b"), ("ß", "B"), ("l", "i"), ("i", "1"), ("l", "!"), ("l", "|"), ("i", "|"), ("b", "h"), ("c", "e"), ("o", "a"), ("f", "t"), ("rn", "m"), ("cl", "d"), ("ri", "n"), ("ii", "u"), ("vv", "w"),
    ("b", "6"), ("z", "2"), ("q", "9"), ("á", "ó"), ("à", "ò"), ("í", "l"), ("é", "ê"), ("è", "é"), ("u", "n"), ("n", "u"), ("y", "v"), ("v", "y"), ("k", "lc"), ("h", "li"), ("e", "o"),
)
HYPHENS = "-‐‑­¬"
WINDOW, BUCKETS, DIMS, SKIPPED = 3, 1 << 15, 32, 20_000
WORD_EDGE = ".,;:()[]{}|·“”„«»‹›?…'’‘*_<>–—=#+/\\"
PAGE_WORD = r"(?:page|pages|seite|página|pagina|pág|pag|blatt|folio|hoja|feuille|p|s|pg)"
ROMAN = r"(?:x{0,3}(?:ix|iv|v?i{1,3}|v)|x{1,3})"
NUMBER = re.compile(rf"^[\s\-–—~|·.\[(<]*(?:{PAGE_WORD}\.?\s*)?(\d{{1,4}}|{ROMAN})\s*(?:(?:/|of|von|de|sur|out of)\s*(\d{{1,4}}|{ROMAN}))?[\s\-–—~|·.\])>]*$", re.I)
PARTS = re.compile(r"\s*[|·•]\s*|\t+|\s{2,}|\s+[–—-]\s+")


# ---------------------------------------------------------------- words


def keys_of(token: str) -> tuple[str, str]:
    """(word, raw): the token in lower case without signs around it; raw keeps the signs that misreading produces."""
    raw = token.strip(WORD_EDGE).lower()
    return raw.strip('!~"'), raw


def is_word(w: str) -> bool:
    return len(w) >= 2 and any(c.isalpha() for c in w)


def misreadings(word: str) -> set[str]:
    """All forms with one plausible glyph edit, and with the same edit everywhere."""
    out = set()
    for a, b in GLYPHS:
        at = word.find(a)
        n = 0
        while at >= 0:
            out.add(word[:at] + b + word[at + len(a) :])
            at, n = word.find(a, at + 1), n + 1
        if n > 1:
            out.add(word.replace(a, b))
    out.discard(word)
    return out


def skeleton(line: str) -> str:
    """Letters of a line in classes that misreading does not leave; digits go."""
    t = line.lower()
    for a, b in (("rn", "m"), ("vv", "w"), ("i~", "r"), ("ii", "u"), ("cl", "d"), ("ri", "n"), ('"', ""), ("li", "h"), ("fi", "ñ")):
        t = t.replace(a, b)
    table = {"c": "e", "o": "a", "0": "a", "t": "f", "!": "i", "l": "i", "1": "i", "|": "i", "5": "s", "b": "h", "9": "g", "ü": "u", "ö": "a", "ä": "a", "é": "e", "6": "e", "ó": "a", "á": "a", "í": "i", "ñ": "n", "ß": "h"}
    return "".join(table.get(c, c) for c in t if c.isalpha() or c in "!|01569")


# ---------------------------------------------------------------- lines


def split_lines(text: str) -> list[str]:
    return [x.rstrip("\r") for x in text.split("\n")]


def edge_lines(lines: list[str], depth: int = 2) -> list[tuple[int, str]]:
    """(line, zone) of the first and last ``depth`` lines that are not blank, each from the edge inwards."""
    full = [i for i, x in enumerate(lines) if x.strip()]
    top = full[:depth]
    return [(i, "top") for i in top] + [(i, "bottom") for i in full[-depth:][::-1] if i not in top]


def roman(s: str) -> int | None:
    if s.isdigit():
        return int(s)
    values = {"i": 1, "v": 5, "x": 10}
    t, out = s.lower(), 0
    for a, b in zip(t, t[1:] + " "):
        v = values.get(a)
        if v is None:
            return None
        out += -v if values.get(b, 0) > v else v
    return out


def numbers_of(line: str) -> tuple[list[tuple[str, int, int | None]], str]:
    """([(style, number, of)], rest): the parts of an edge line that may count pages, and what remains of it."""
    text = line.strip()
    whole = bool(NUMBER.match(text))
    parts = [text] if whole else [p for p in PARTS.split(text) if p]
    found, rest = [], []
    for i, part in enumerate(parts):
        m = NUMBER.match(part) if whole or len(parts) > 1 and i in (0, 1, len(parts) - 2, len(parts) - 1) else None
        if m and (n := roman(m.group(1))) is not None:
            style = re.sub(r"\d+", "9", re.sub(rf"\b{ROMAN}\b", "9", part.lower()))
            found.append((("" if whole else "part ") + re.sub(r"\s+", " ", style), n, roman(m.group(2)) if m.group(2) else None))
        else:
            rest.append(part)
    # dashes of "- 3 -" may have been taken for separators
    if not whole and (m := re.search(r"(?:^|\s)([-–—]\s*(\d{1,4})\s*[-–—])(?:\s|$)", text)):
        found.append(("part - 9 -", int(m.group(2)), None))
    return found, "  ".join(rest)


def _edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for f, page, h, text in zip(pdf["file_id"], pdf["page"], pdf["h"], pdf["text"]):
            lines, outer = split_lines(text), {"top": True, "bottom": True}
            for i, zone in edge_lines(lines):
                line = lines[i].strip()
                found, rest = numbers_of(line)
                key = skeleton(rest)
                # the second line from the edge can be a header only beyond a line that is a number alone
                if len(key) < 3 or (not found and re.search(r"[.!?,;:]$", rest)) or len(line) > 90 or not outer[zone]:
                    key = ""
                outer[zone] = bool(found) and not rest
                for style, n, of in found or [("", None, None)]:
                    rows.append((f, page, h, i, zone, key, style, n, of))
        yield pd.DataFrame(rows, columns=["file_id", "page", "h", "line", "zone", "key", "style", "number", "of"]).astype({"number": "Int32", "of": "Int32"})


def furniture(pages: DataFrame, similar: int = 2) -> DataFrame:
    """(file_id, page, h, line, noise): header and page_number lines. Counts are by (file, key), so that a file with very
    many pages is spread over the cluster; a line that stands alone may differ from a recurring one by ``similar`` edits."""
    kind = pages.schema["file_id"].dataType.simpleString()
    edges = checkpoint(spread(pages).mapInPandas(_edges, f"file_id {kind}, page int, h long, line int, zone string, key string, style string, number int, of int"))
    keyed = edges.filter("key <> ''")
    counts = keyed.groupBy("file_id", "key").agg(F.count_distinct("page").alias("pages"))
    recur = counts.filter("pages > 1").select("file_id", "key")
    alone = counts.filter("pages = 1").select("file_id", "key")
    near = alone.join(recur.withColumnRenamed("key", "other"), "file_id").filter(
        (F.abs(F.length("key") - F.length("other")) <= similar) & (F.length("other") >= 8) & (F.levenshtein("key", "other") <= similar)
    ).select("file_id", "key").distinct()
    header = keyed.join(recur.union(near), ["file_id", "key"], "left_semi").select("file_id", "page", "h", "line", F.lit("header").alias("noise"))
    numbers = edges.filter("number is not null").withColumn("offset", F.col("number") - F.col("page"))
    steady = numbers.groupBy("file_id", "zone", "style", "offset").agg(F.count_distinct("page").alias("pages")).filter("pages > 1")
    last = pages.groupBy("file_id").agg(F.max("page").alias("last"))
    counted = numbers.join(steady, ["file_id", "zone", "style", "offset"], "left_semi")
    sure = numbers.filter("of >= number or (style <> '9' and style not like 'part%')").unionByName(  # "page 3", "- 3 -", "3/7"
        numbers.join(last, "file_id").filter("offset = 0 and last > 1").drop("last"))
    number = counted.unionByName(sure).select("file_id", "page", "h", "line", F.lit("page_number").alias("noise"))
    return header.unionByName(number).distinct()


# ---------------------------------------------------------------- vocabulary and hyphens


def _body(lines: list[str], drop: set[int]) -> list[int]:
    return [i for i, x in enumerate(lines) if x.strip() and i not in drop]


def hyphen_ends(lines: list[str], drop: set[int]) -> list[tuple[int, int, str, str, str]]:
    """(line, next line, left part, sign, right part) of every line that ends with a hyphen after a letter."""
    body, out = _body(lines, drop), []
    for i, j in zip(body, body[1:]):
        a = lines[i].rstrip()
        if len(a) > 1 and a[-1] in HYPHENS and a[-2].isalpha():
            left, right = a[:-1].split()[-1], lines[j].split()[0]
            if right[:1].isalnum() or right[:1] in '!|"':
                out.append((i, j, left.lstrip(WORD_EDGE), a[-1], right))
    return out


def _tokens(lines: list[str], joins: dict[int, tuple[int, str]] | None = None) -> list[tuple[int, str]]:
    """(line, token) in order; the two halves at a hyphenated line end are left out, or joined as ``joins`` says."""
    out: list[tuple[int, str]] = []
    skip: dict[int, int] = {}
    for i, line in enumerate(lines):
        toks = line.split()
        if i in skip and toks:
            toks = toks[1:]
        a = line.rstrip()
        if toks and len(a) > 1 and a[-1] in HYPHENS and a[-2].isalpha():
            j = next((k for k in range(i + 1, len(lines)) if lines[k].strip()), None)
            if joins is None or i not in joins:
                toks = toks[:-1]
                if j is not None:
                    skip[j] = 1
            else:
                j, word = joins[i]
                toks = toks[:-1] + [word]
                skip[j] = 1
        out += [(i, t) for t in toks]
    return out


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        c: Counter = Counter()
        for text in pdf["text"]:
            for _, t in _tokens(split_lines(text)):
                word, raw = keys_of(t)
                if is_word(word):
                    c[word] += 1
                    if raw != word:
                        c[raw] += 0  # known as a form, not counted as a word
        yield pd.DataFrame({"word": list(c), "n": np.fromiter(c.values(), np.int64, len(c))})


def vocabulary(pages: DataFrame) -> DataFrame:
    """(word, n) over all pages, counted within each task first."""
    return spread(pages).mapInPandas(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _hyphens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for f, page, h, text, drop in zip(pdf["file_id"], pdf["page"], pdf["h"], pdf["text"], pdf["drop"]):
            lines = split_lines(text)
            for i, j, a, sign, b in hyphen_ends(lines, set(drop if drop is not None else ())):
                right = keys_of(b)[0]
                rows.append((f, page, h, i, j, a, sign, b, keys_of(a)[0] + right, keys_of(a)[0] + "-" + right))
        yield pd.DataFrame(rows, columns=["file_id", "page", "h", "line", "next", "left", "sign", "right", "joined", "compound"])


def with_drops(pages: DataFrame, lines: DataFrame) -> DataFrame:
    drops = lines.groupBy("file_id", "page", "h").agg(F.collect_set("line").alias("drop"))
    return pages.join(drops, ["file_id", "page", "h"], "left")


def split_words(dropped: DataFrame, words: DataFrame) -> DataFrame:
    """(file_id, page, h, line, next, left, right, split): line ends with a hyphen; split is false for broken compounds."""
    kind = dropped.schema["file_id"].dataType.simpleString()
    ends = spread(dropped).mapInPandas(_hyphens, f"file_id {kind}, page int, h long, line int, next int, left string, sign string, right string, joined string, compound string")
    a = words.select(F.col("word").alias("joined"), F.col("n").alias("n_joined"))
    b = words.select(F.col("word").alias("compound"), F.col("n").alias("n_compound"))
    known = ends.join(a, "joined", "left").join(b, "compound", "left")
    # a form that is itself a misread word is rare: the more frequent of both forms decides, a split if neither is known
    return known.select("file_id", "page", "h", "line", "next", "left", "right", "joined",
                        (F.coalesce("n_joined", F.lit(0)) >= F.coalesce("n_compound", F.lit(0))).alias("split"))


# ---------------------------------------------------------------- skip-gram vectors


def bucket(word: str) -> int:
    return zlib.crc32(word.encode()) % BUCKETS


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        keys = []
        for text in pdf["text"]:
            ids = np.array([bucket(w) for w, _ in (keys_of(t) for _, t in _tokens(split_lines(text))) if w], np.int64)
            for d in range(1, WINDOW + 1):
                if len(ids) > d:
                    keys += [ids[:-d] * BUCKETS + ids[d:], ids[d:] * BUCKETS + ids[:-d]]
        u, n = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, np.int64),) * 2
        yield pd.DataFrame({"w": (u // BUCKETS).astype(np.int32), "c": (u % BUCKETS).astype(np.int32), "n": n.astype(np.int64)})


def _epoch(vin: np.ndarray, vout: np.ndarray, prior: np.ndarray, rate: float, negatives: int, passes: int, seed: int):
    """One task's share of an epoch: AdaGrad over pairs drawn by their counts; empty tasks give no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = vin.copy(), vout.copy()
        ga2, gb2 = np.full(BUCKETS, 1e-3, np.float32), np.full(BUCKETS, 1e-3, np.float32)
        seen_a, seen_b = np.zeros(BUCKETS), np.zeros(BUCKETS)
        rng = np.random.default_rng(seed)

        def update(table: np.ndarray, squares: np.ndarray, rows: np.ndarray, grads: np.ndarray) -> None:
            np.add.at(squares, rows, (grads * grads).mean(1))
            np.add.at(table, rows, grads * (rate / np.sqrt(squares[rows]))[:, None])

        for pdf in batches:
            w_all, c_all, n_all = pdf["w"].to_numpy(), pdf["c"].to_numpy(), pdf["n"].to_numpy()
            np.add.at(seen_a, w_all, n_all)
            np.add.at(seen_b, c_all, n_all)
            share = np.cumsum(n_all.astype(float))
            for _ in range(max(40, -(-passes * len(pdf) // 1024)) if len(pdf) else 0):  # pairs are drawn by their counts
                pick = np.searchsorted(share, rng.random(1024) * share[-1]).clip(0, len(pdf) - 1)
                w, c = w_all[pick], c_all[pick]
                neg = np.searchsorted(prior, rng.random((len(w), negatives))).clip(0, BUCKETS - 1)
                va, vb, vn = a[w], b[c], b[neg]
                gp = 1 / (1 + np.exp(np.clip((va * vb).sum(1), -10, 10)))
                gn = -1 / (1 + np.exp(-np.clip((va[:, None] * vn).sum(2), -10, 10)))
                update(a, ga2, w, gp[:, None] * vb + (gn[:, :, None] * vn).sum(1))
                update(b, gb2, np.concatenate([c, neg.reshape(-1)]), np.concatenate([gp[:, None] * va, (gn[:, :, None] * va[:, None]).reshape(-1, DIMS)]))
        used = np.flatnonzero(seen_a + seen_b)
        both = np.hstack([a[used] * seen_a[used, None], b[used] * seen_b[used, None]]).astype(np.float64)
        yield pd.DataFrame({"k": used, "wa": seen_a[used], "wb": seen_b[used], "v": pd.Series(list(both), dtype=object)})

    return run


def skip_gram(pages: DataFrame, epochs: int = 3, rate: float = 0.1, negatives: int = 4, passes: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(in, out): vectors of the hashed words. The tables have BUCKETS x DIMS numbers each, whatever the corpus."""
    pairs = spread(pages).mapInPandas(_pairs, "w int, c int, n long").groupBy("w", "c").agg(F.sum("n").alias("n"))
    pairs = checkpoint(pairs.repartition("w"))  # a word's pairs in one task, so that only context vectors are averaged
    prior = np.full(BUCKETS, 1e-9)
    for k, n in pairs.groupBy("c").agg(F.sum("n")).collect():  # BUCKETS rows at most
        prior[k] = float(n) ** 0.75
    prior = np.cumsum(prior / prior.sum())
    rng = np.random.default_rng(1)
    vin = rng.uniform(-0.5 / DIMS, 0.5 / DIMS, (BUCKETS, DIMS)).astype(np.float32)
    vout = np.zeros((BUCKETS, DIMS), np.float32)
    for e in range(epochs):
        got = pairs.mapInPandas(_epoch(vin, vout, prior, rate, negatives, passes, 17 + e), "k int, wa double, wb double, v array<double>")
        mean = got.groupBy("k").agg(F.sum("wa"), F.sum("wb"), F.array(*(F.sum(F.col("v")[i]) for i in range(2 * DIMS))))
        for k, wa, wb, v in mean.toLocalIterator():
            v = np.array(v, np.float32)
            if wa > 0:
                vin[k] = v[:DIMS] / wa
            if wb > 0:
                vout[k] = v[DIMS:] / wb
    return vin, vout


# ---------------------------------------------------------------- misread words


def _variants(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(m, v, n) for v, n in zip(pdf["word"], pdf["n"]) for m in misreadings(v)]
        yield pd.DataFrame(rows, columns=["form", "word", "n_word"])


def neighbours(words: DataFrame, frequent: int = 4, ratio: int = 6) -> DataFrame:
    """(form, cands): rare words of the corpus and their frequent neighbours by one glyph edit, most frequent first.

    ``frequent``: so often a word must occur to be a neighbour; ``ratio``: and so many times as often as the rare form."""
    forms = spread(words.filter((F.col("n") >= frequent) & (F.length("word") >= 2))).mapInPandas(_variants, "form string, word string, n_word long")
    rare = words.select(F.col("word").alias("form"), F.col("n").alias("n_form"))
    hit = forms.join(rare, "form").filter(F.col("n_word") >= ratio * F.greatest("n_form", F.lit(1)))
    return hit.groupBy("form").agg(F.sort_array(F.collect_list(F.struct((F.col("n_word") / F.greatest("n_form", F.lit(1))).alias("times"), "word")), asc=False).alias("cands"))


def _rare(skip: frozenset[str]):
    """Words with their context, without those of ``skip``; which of them are misread is settled by the join that follows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield _contexts(pdf, skip)

    return run


def _contexts(pdf: pd.DataFrame, skip: frozenset[str]) -> pd.DataFrame:
    rows = []
    for f, page, h, text, joins in zip(pdf["file_id"], pdf["page"], pdf["h"], pdf["text"], pdf["joins"]):
        by = {j["line"]: (j["next"], j["left"] + j["right"]) for j in joins} if joins is not None else {}
        toks = [keys_of(t) for _, t in _tokens(split_lines(text), by)]
        ids = [bucket(w) for w, _ in toks]
        for i, (word, raw) in enumerate(toks):
            if is_word(word) or is_word(raw):
                near = ids[max(0, i - WINDOW) : i] + ids[i + 1 : i + 1 + WINDOW]
                for form in {word, raw}:
                    if is_word(form) and form not in skip:
                        rows.append((f, page, h, form, near))
    return pd.DataFrame(rows, columns=["file_id", "page", "h", "form", "near"])


def _choose(vin: np.ndarray, vout: np.ndarray, safe: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for f, page, h, form, near, cands in zip(pdf["file_id"], pdf["page"], pdf["h"], pdf["form"], pdf["near"], pdf["cands"]):
                context = vout[np.asarray(near, int)].mean(0) if len(near) else np.zeros(DIMS, np.float32)
                fit = [(float(vin[bucket(c["word"])] @ context), c["times"], c["word"]) for c in cands]
                score, times, word = max(fit)
                if times >= safe or score > 0:
                    rows.append((f, page, h, form, word, score))
            yield pd.DataFrame(rows, columns=["file_id", "page", "h", "form", "word", "score"])

    return run


def misread_words(pages: DataFrame, joins: DataFrame, words: DataFrame, safe: float = 30.0) -> DataFrame:
    """(file_id, page, h, form, word, score): misread words and their corrections in context. Below ``safe`` times the
    form's frequency a neighbour must fit the context."""
    kind = pages.schema["file_id"].dataType.simpleString()
    linked = checkpoint(neighbours(words))
    by = joins.filter("split").groupBy("file_id", "page", "h").agg(F.collect_list(F.struct("line", "next", "left", "right")).alias("joins"))
    # the most frequent words are no misread forms; leaving them out spares most of the shuffle (SKIPPED bounds the list)
    known = words.join(linked.select(F.col("form").alias("word")), "word", "left_anti").orderBy(F.desc("n"), "word").limit(SKIPPED)
    skip = frozenset(r[0] for r in known.select("word").collect())
    tokens = spread(pages.join(by, ["file_id", "page", "h"], "left")).mapInPandas(_rare(skip), f"file_id {kind}, page int, h long, form string, near array<int>")
    hits = tokens.join(linked, "form")
    vin, vout = skip_gram(pages)
    return spread(hits).mapInPandas(_choose(vin, vout, safe), f"file_id {kind}, page int, h long, form string, word string, score double")


# ---------------------------------------------------------------- the operator


def _pages(ocr: DataFrame, file_id: str, page: str, text: str) -> DataFrame:
    rows = ocr.select(F.col(file_id).alias("file_id"), F.col(page).cast("int").alias("page"), F.col(text).alias("text"))
    return rows.filter("text <> '' and file_id is not null and page is not null").withColumn("h", F.xxhash64("text")).distinct()


def _parts(ocr: DataFrame, file_id: str, page: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    pages = checkpoint(_pages(ocr, file_id, page, text))
    lines = checkpoint(furniture(pages))
    words = checkpoint(vocabulary(pages))
    ends = checkpoint(split_words(with_drops(pages, lines), words))
    # the forms of joined halves take part as words of the corpus
    halves = ends.filter("split").groupBy(F.col("joined").alias("word")).agg(F.count("*").alias("n"))
    words = checkpoint(words.unionByName(halves).groupBy("word").agg(F.sum("n").alias("n")))
    return pages, lines, words, ends, misread_words(pages, ends, words)


def page_noise(ocr: DataFrame, file_id: str = "file_id", page: str = "page", text: str = "text") -> DataFrame:
    """(file_id, page, noise): noise is hyphen, misread, header or page_number."""
    _, lines, _, ends, wrong = _parts(ocr, file_id, page, text)
    return (
        lines.select("file_id", "page", "noise")
        .unionByName(ends.filter("split").select("file_id", "page", F.lit("hyphen").alias("noise")))
        .unionByName(wrong.select("file_id", "page", F.lit("misread").alias("noise")))
        .distinct()
    )


def reflow(text: str, drop: set[int], joins: dict[int, tuple[int, str, bool]], fixes: dict[str, str]) -> str:
    """The page as paragraphs: without furniture, halves joined, misread words corrected."""
    lines = split_lines(text)

    def fix(token: str) -> str:
        word, raw = keys_of(token)
        for form in (raw, word):
            if form in fixes and form:
                at = token.lower().find(form)
                new = fixes[form]
                old = token[at : at + len(form)]
                new = new.upper() if len(old) > 1 and old.isupper() else new.capitalize() if old[:1].isupper() else new
                return token[:at] + new + token[at + len(form) :]
        return token

    out: list[list[str]] = [[]]
    skip: set[int] = set()
    for i, line in enumerate(lines):
        if i in drop:
            continue
        toks = line.split()
        if not toks:
            if out[-1]:
                out.append([])
            continue
        if i in skip:
            toks = toks[1:]
        if i in joins and toks:
            j, right, split = joins[i]
            left = toks[-1]
            toks = toks[:-1] + [left[:-1] + right if split else left.rstrip(HYPHENS) + "-" + right]
            skip.add(j)
        out[-1] += [fix(t) for t in toks]
    return "\n\n".join(" ".join(p) for p in out if p)


def repaired_pages(ocr: DataFrame, file_id: str = "file_id", page: str = "page", text: str = "text") -> DataFrame:
    """(file_id, page, text): every page as readable paragraphs."""
    pages, lines, _, ends, wrong = _parts(ocr, file_id, page, text)
    key = ["file_id", "page", "h"]
    full = (
        pages.join(lines.groupBy(*key).agg(F.collect_set("line").alias("drop")), key, "left")
        .join(ends.groupBy(*key).agg(F.collect_list(F.struct("line", "next", "right", "split")).alias("joins")), key, "left")
        .join(wrong.groupBy(*key, "form").agg(F.max_by("word", "score").alias("word")).groupBy(*key).agg(F.collect_list(F.struct("form", "word")).alias("fixes")), key, "left")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t, drop, joins, fixes in zip(pdf["text"], pdf["drop"], pdf["joins"], pdf["fixes"]):
                out.append(reflow(
                    t, set(drop) if drop is not None else set(),
                    {j["line"]: (j["next"], j["right"], j["split"]) for j in joins} if joins is not None else {},
                    {x["form"]: x["word"] for x in fixes} if fixes is not None else {},
                ))
            yield pd.DataFrame({"file_id": pdf["file_id"], "page": pdf["page"], "text": out})

    return full.mapInPandas(run, f"file_id {pages.schema['file_id'].dataType.simpleString()}, page int, text string").distinct()
