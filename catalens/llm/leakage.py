"""Evaluation passages inside training texts (problem 7), by a positional inverted index.

Method. Both sides are read as the same sequence of words: case, punctuation, markup, quote signs, spacing and hyphens
(also those at line ends) are taken away, and every text once: its words are stored as a checkpoint of word codes. A term is
three words in a row. The postings (term, document, position) of all terms that items hold are stored as well, and answer
everything that follows. The rarest terms of the items by corpus frequency are chosen, so densely and without overlap that a
passage with the allowed changes keeps at least one. Where a document holds one, the lists of all terms of that item are
intersected after the item's offset is subtracted; documents that hold enough of them on few diagonals are candidates.
Each is then verified word by word: a run of at least ``window`` item words in which at most one in ``changed`` differs, on
one diagonal or, where words were put in or left out, across neighbouring ones. Wording of nine words or more that
stands in ``shared_items`` items or more does not count towards the length.

Items of any number are joined; only if their terms have at most ``broadcast_terms`` rows (counted first) are these broadcast.

Defined results: null and empty texts and items match nothing; repeated rows give one pair; an item shorter than
``window`` words never matches; several places of one item in a document give one pair; texts are read whole.
"""

from __future__ import annotations

import html
import html.entities
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalens.session import checkpoint, spread

WORD = r"[\p{L}\p{N}]+"
TERM = 3
#: Taken away before entities are decoded: comments, tags, targets of Markdown links (inline, by name, and the names' own lines).
MARKUP = (
    (r"(?s)<!--.*?-->", " "),
    (r"<[^<>]{1,200}>|</?[a-z][^<>]*>", " "),
    (r"\]\(\s*[^()\s]*(?:\([^()\s]*\)[^()\s]*)?(?:\s+(?:\"[^\"\n]*\"|'[^'\n]*'))?\s*\)", " "),
    (r"\]\[[^\[\]\n]*\]", " "),
    (r"(?m)^[ \t]*\[[^\[\]\n]+\]:[ \t]*(?:[a-z][a-z0-9+.\-]*:|www\.|[/#])\S*", " "),
)
#: Names of entities in lower case, and the numbers that HTML reads as signs of another code page.
ENTITIES = {k[:-1].lower(): v.lower() for k, v in sorted(html.entities.html5.items()) if k.endswith(";")} | {f"#{n}": html.unescape(f"&#{n};").lower() for n in range(128, 160)}
#: Taken away after that, in this order: hyphens inside words (with line ends), apostrophes inside words, emphasis.
STEPS = (
    (r"(?<=[\p{L}\p{N}])[-\x{2010}\x{2011}\x{00ad}\x{00ac}][ \t]*\r?\n[ \t]*(?=[\p{L}\p{N}])", ""),
    (r"(?<=[\p{L}\p{N}])[-\x{2010}\x{2011}\x{00ad}](?=[\p{L}\p{N}])", ""),
    (r"(?<=\p{L})['\x{2019}\x{2018}\x{02bc}`](?=\p{L})", ""),
    (r"[*_~]+", ""),
)


def _decoded(text: F.Column) -> F.Column:
    """The text with its named and numeric entities as signs; what is no entity stays."""
    entity = r"&(#x[0-9a-f]{1,6}|#[0-9]{1,7}|[a-z][a-z0-9]*);"
    names = F.create_map(*(F.lit(x) for pair in ENTITIES.items() for x in pair))

    def sign(e: F.Column) -> F.Column:
        code = F.when(e.startswith("#x"), F.conv(F.substring(e, 3, 6), 16, 10)).when(e.startswith("#"), F.substring(e, 2, 7)).cast("int")
        valid = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code < 0x110000))
        number = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        return F.coalesce(F.try_element_at(names, F.coalesce(F.concat(F.lit("#"), code.cast("string")), e)), number, F.when(e.startswith("#"), F.lit(" ")), F.concat(F.lit("&"), e, F.lit(";")))

    parts = F.zip_with(F.split(text, entity, -1), F.regexp_extract_all(text, F.lit(entity), 1), lambda p, e: F.concat(p, F.when(e.isNull(), "").otherwise(sign(e))))
    return F.when(text.rlike(entity), F.lower(F.array_join(parts, ""))).otherwise(text)


def words_of(column: F.Column | str) -> F.Column:
    """The array of normalised words, computed in the JVM."""
    text = F.lower(F.col(column) if isinstance(column, str) else column)
    for pattern, to in MARKUP:
        text = F.regexp_replace(text, pattern, to)
    text = _decoded(text)
    for pattern, to in STEPS:
        text = F.regexp_replace(text, pattern, to)
    return F.regexp_extract_all(text, F.lit(WORD), 0)


def codes_of(column: F.Column | str) -> F.Column:
    """The words as numbers of 32 bits."""
    return F.transform(words_of(column), lambda w: F.hash(w))


def item_table(items: DataFrame, item_id: str, text: str, shared_items: int, shingle: int = 9) -> DataFrame:
    """(item, words, shared): shared[i] says that word i lies in a shingle of ``shared_items`` items or more."""
    rows = items.select(F.col(item_id).alias("item"), codes_of(text).alias("words")).filter("size(words) > 0 and item is not null").distinct()
    grams = rows.select("item", F.xxhash64("words").alias("h"), F.posexplode(F.transform(F.sequence(F.lit(0), F.greatest(F.size("words") - shingle, F.lit(0))), lambda i: F.xxhash64(F.slice("words", i + 1, shingle)))).alias("at", "gram"))
    # the same text under several ids counts once
    common = grams.groupBy("gram").agg(F.count_distinct("h").alias("n")).filter(F.col("n") >= shared_items)
    marked = grams.join(common, "gram", "left_semi").groupBy("item").agg(F.collect_set("at").alias("starts"))
    return rows.join(marked, "item", "left").select(
        "item", "words",
        F.expr(f"transform(sequence(0, size(words) - 1), i -> coalesce(exists(starts, s -> i >= s and i < s + {shingle}), false))").alias("shared"),
    )


def block_size(window: int, changed: int) -> int:
    """So many words share one anchor that a run of ``window`` words holds more whole blocks than it may hold changes."""
    fits = [b for b in range(TERM, window + 1) if (window - b + 1) // b > window // changed]
    if not fits:
        raise ValueError(f"window={window} with one change in {changed} leaves no unchanged terms of {TERM} words")
    return max(fits)


def anchors(terms: DataFrame, df: DataFrame, block: int) -> DataFrame:
    """(item, ipos, term): of each block of item words the rarest term that the corpus holds and that lies wholly within it."""
    within = terms.filter(f"not all_shared and ipos % {block} <= {block - TERM}").join(df, "term")
    best = within.groupBy("item", F.floor(F.col("ipos") / block).alias("block")).agg(F.min_by(F.struct("ipos", "term"), F.struct("n", "ipos")).alias("b"))
    return best.select("item", "b.ipos", "b.term")


def _verify(window: int, changed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, item, start, words, own, shared, diags in zip(pdf["doc"], pdf["item"], pdf["start"], pdf["words"], pdf["own"], pdf["shared"], pdf["diags"]):
                words, own, shared = np.asarray(words), np.asarray(own), np.asarray(shared, bool)
                diags, found, same = sorted(int(d) - start for d in diags), None, {}
                for d in diags:
                    lo, hi = max(0, -d), min(len(own), len(words) - d)
                    if hi <= lo:
                        continue
                    same[d] = (lo, own[lo:hi] == words[lo + d : hi + d])
                    best = best_run(same[d][1], shared[lo:hi], window, changed)
                    if best and (found is None or best[1] - best[0] > found[1]):
                        found = (lo + d + best[0], best[1] - best[0])
                if found is None and len(same) > 1:
                    found = best_chain(same, shared, window, changed)
                if found:
                    out.append((doc, item, int(start + found[0]), int(found[1])))
            yield pd.DataFrame(out, columns=["doc", "item", "at", "words"])

    return run


def best_chain(same: dict[int, tuple[int, np.ndarray]], shared: np.ndarray, window: int, changed: int, gap: int = 3) -> tuple[int, int] | None:
    """(place in the text, item words) of the longest run over several diagonals. Runs of equal words follow each other at
    up to ``gap`` words; what lies between counts as so many changes as the longer side has words."""
    parts = []  # (first item word, beyond the last, diagonal)
    for d, (lo, eq) in same.items():
        edge = np.flatnonzero(np.diff(np.concatenate([[0], eq.astype(np.int8), [0]])))
        parts += [(lo + int(a), lo + int(b), d) for a, b in zip(edge[::2], edge[1::2]) if b - a > 1]
    parts.sort()
    own, best = np.concatenate([[0], np.cumsum(~shared)]), None
    for i, (a, end, d) in enumerate(parts):
        cost = {i: 0}
        for j in range(i, len(parts)):
            if j not in cost:
                continue
            x, y, e = parts[j]
            if cost[j] * changed <= y - a and own[y] - own[a] >= window and (best is None or y - a > best[1]):
                best = (a + d, y - a)
            for k in range(j + 1, len(parts)):
                u, v, f = parts[k]
                if u - y > gap:
                    break
                cut = max(0, y - u, y + e - u - f)  # words that both runs claim go to the first
                left, right = u + cut - y, u + cut + f - y - e
                if v - u - cut >= 2 and 0 <= left <= gap and 0 <= right <= gap:
                    cost[k] = min(cost.get(k, 1 << 30), cost[j] + max(left, right))
    return best


def best_run(same: np.ndarray, shared: np.ndarray, window: int, changed: int) -> tuple[int, int] | None:
    """The longest [a, b) that begins and ends with equal words, has at most (b-a)//changed unequal ones and at least
    ``window`` words that are not shared."""
    n = len(same)
    bad = np.concatenate([[0], np.cumsum(~same)])
    own = np.concatenate([[0], np.cumsum(~shared)])
    best = None
    ends = np.flatnonzero(same)
    if len(ends) < window - window // changed:
        return None
    for a in ends:
        b = ends[ends >= a + window - 1] + 1
        if not len(b):
            break
        ok = ((bad[b] - bad[a]) * changed <= b - a) & (own[b] - own[a] >= window)
        if ok.any():
            end = int(b[np.flatnonzero(ok)[-1]])
            if best is None or end - a > best[1] - best[0]:
                best = (int(a), end)
    return best


def _terms(words: F.Column) -> F.Column:
    """Hashes of the terms of three words, by position."""
    n = F.size(words) - TERM
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2])))


def postings(documents: DataFrame, terms: DataFrame, broadcast_terms: int = 4_000_000) -> DataFrame:
    """(term, doc, pos) of ``documents`` (doc, words) for all of ``terms`` (term). Stored by term."""
    if terms.count() <= broadcast_terms:
        terms = F.broadcast(terms)
    return checkpoint(documents.select("doc", F.posexplode(_terms(F.col("words"))).alias("pos", "term")).join(terms, "term", "left_semi").select("term", "doc", "pos"))


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 18, changed: int = 8, shared_items: int = 3, broadcast_terms: int = 4_000_000) -> DataFrame:
    """(doc_id, item_id, at, words): the longest verified run of each leaked item in each document, from word ``at`` on."""
    docs = documents.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).filter("doc is not null and text <> ''")
    docs = checkpoint(spread(docs).select("doc", codes_of("text").alias("words")))
    item = checkpoint(item_table(items, item_id, item_text, shared_items))
    flags = F.transform(F.sequence(F.lit(0), F.greatest(F.size("words") - TERM, F.lit(0))), lambda i: F.forall(F.slice("shared", i + 1, TERM), lambda x: x))
    terms = item.filter(F.size("words") >= TERM).select("item", F.posexplode(F.arrays_zip(_terms(F.col("words")).alias("term"), flags.alias("all_shared"))).alias("ipos", "t")).select("item", "ipos", "t.term", "t.all_shared")
    index = postings(docs, terms.select("term").distinct(), broadcast_terms)

    # the rarest terms lead to (document, item); there all terms of the item are intersected
    df = index.groupBy("term").agg(F.count("*").alias("n"))
    led = index.join(anchors(terms, df, block_size(window, changed)), "term").select("doc", "item").distinct()
    hits = led.join(index, "doc").join(terms.select("item", "ipos", "term"), ["item", "term"]).select("doc", "item", "ipos", (F.col("pos") - F.col("ipos")).alias("diag"))
    least = window - TERM + 1 - TERM * (window // changed)
    cands = hits.groupBy("doc", "item").agg(F.count_distinct("ipos").alias("terms"), F.collect_set("diag").alias("diags")).filter(F.col("terms") >= max(1, least))

    start = F.greatest(F.array_min("diags") - 8, F.lit(0))
    stop = F.array_max("diags") + F.size("own") + 8
    kinds = [docs.schema["doc"].dataType.simpleString(), item.schema["item"].dataType.simpleString()]
    checked = (
        docs.join(cands.join(item.withColumnRenamed("words", "own"), "item"), "doc")
        .select("doc", "item", start.alias("start"), F.slice("words", start + 1, F.greatest(stop - start, F.lit(1))).alias("words"), "own", "shared", "diags")
        .mapInPandas(_verify(window, changed), f"doc {kinds[0]}, item {kinds[1]}, at int, words int")
    )
    return (
        checked.groupBy(F.col("doc").alias(doc_id), F.col("item").alias(item_id))
        .agg(F.max_by(F.struct("at", "words"), F.struct(F.col("words"), -F.col("at"))).alias("b"))
        .select(doc_id, item_id, "b.at", "b.words")
    )
