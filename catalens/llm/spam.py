"""Keyword-stuffed and link-list pages (problem 8).

Method. A text is cut into pieces at line ends and sentence ends. Each piece is judged by thresholds on link-text ratio,
share of hash tags, separator density, missing function words, and repetition (shares of the top word and of repeated
word pairs, duplicate lines). The threshold for function words is calibrated for each language: a share of the mean
over the texts of that language that do read as sentences. A document is spam if more than ``share`` of its characters lie in
pieces without sentences.

The language of a text or piece is the one whose function words occur most, so that null or wrong language labels and
texts in two languages do no harm.

Defined results: null, empty and blank texts are no spam; repeated rows give one row; texts are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalens.session import spread

#: Words that sentences need and that names of things do without (so "de", "of" and the like are left out).
FUNCTION_WORDS = {
    "en": "the a an is are was were be been has have had did do does not that which this these and or but although while when there it its they he she we you your his her their in on at by from into to with as after before during since",
    "fr": "le la les un une est et ou mais sont était été a ont au aux sous sur dans par pas ne qui que ce cette ces il elle ils elles nous vous son sa ses dès depuis avant après pendant très tôt n l d'une c s'il sera",
    "de": "der die das den dem des ein eine einen einem einer ist sind war waren wird wurde wurden und oder aber nicht dass es er sie wir ihr sich im am vom zum zur in an auf bei vor nach seit neben unter über für hat haben liegt genügt fehlen kam hält sollte wer uns dagegen hier zu als",
    "es": "el la los las un una es son fue era y o pero no se al del que qué más muy ha han hay lo su sus este esta estos él ella según hacia desde durante después bajo junto frente cerca por hace también nadie quién sin antes",
}
LINK = re.compile(r"<a\s[^>]*>.*?</a>|\[[^\]\n]*\]\([^)\n]*\)|(?:https?://|www\.)\S+|\b[\w-]+(?:\.[\w-]+)*\.(?:example|test|invalid|com|net|org|info|shop|store|de|fr|es)(?:/\S*)?\b|(?<=\s)/[\w/.-]+/?\d*\b|→\s*\S+", re.I)
TAG = re.compile(r"#[\w]{3,}")
ITEM = re.compile(r"\b[A-Z]{2,5}-?\d{3,}\b|\b\d+[.,]\d\d\b")
SEPARATOR = re.compile(r"[,;|•·/→»>–—#&]|\s-\s")
PIECE = re.compile(r"[^.!?…\n]+[.!?…]*[\"'”’»)\]]*\s*|\n+|[.!?…]+")
TIME = re.compile(r"^\s*\[?\d{1,2}:\d\d(?::\d\d)?\]?\s*")
LETTERS = re.compile(r"[^\W\d_]+")


def language_of(words: list[str], lists: dict[str, frozenset[str]]) -> tuple[str, float]:
    if not words:
        return "und", 0.0
    best = max(lists, key=lambda k: (sum(w in lists[k] for w in words), k))
    return best, sum(w in lists[best] for w in words) / len(words)


def _lists() -> dict[str, frozenset[str]]:
    return {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    lists = _lists()
    for pdf in batches:
        found = [language_of([w.lower() for w in LETTERS.findall(t)], lists) for t in pdf["text"]]
        yield pd.DataFrame(found, columns=["lang", "share"])


def stuffed_share(text: str, floor: dict[str, float], lists: dict[str, frozenset[str]] | None = None) -> float:
    """Share of the characters that lie in pieces made of keywords, links or product tags."""
    lists = lists or _lists()
    ways = [(lists[k], floor.get(k, 0.1)) for k in lists]

    def reads(words: list[str]) -> bool:
        """Enough function words of one language: texts may change their language within a document."""
        return any(sum(w in known for w in words) >= max(1.0, limit * len(words)) for known, limit in ways)

    lines = text.split("\n")
    repeated_lines = Counter(re.sub(r"\W+", " ", x.lower()).strip() for x in lines)
    pieces = []  # (characters, kind): kind is link, bare (no sentence), text, or free (too short to tell)
    for line in lines:
        body = TIME.sub("", line)
        chars = len(line.strip())
        if not chars:
            continue
        link = sum(m.end() - m.start() for m in LINK.finditer(body)) + sum(m.end() - m.start() for m in TAG.finditer(body))
        rest = LETTERS.findall(LINK.sub(" ", TAG.sub(" ", body)))
        if link and (link > 0.5 * chars or not reads([w.lower() for w in rest])):
            pieces.append((chars, "link", []))
            continue
        for piece in PIECE.findall(body):
            size = len(piece.strip())
            words = [w.lower() for w in LETTERS.findall(piece)]
            if not size:
                continue
            if not words:
                pieces.append((size, "free", []))
                continue
            pieces.append((size, "text" if reads(words) else "bare", words))
    total = sum(p[0] for p in pieces)
    if not total:
        return 0.0
    bare = [p for p in pieces if p[1] == "bare"]
    counts = Counter(w for p in bare for w in p[2])
    pairs = Counter(x for p in bare for x in zip(p[2], p[2][1:]))
    n, n_pairs = sum(counts.values()), sum(pairs.values())
    top = max(counts.values(), default=0) / max(n, 1)
    again = sum(c for c in pairs.values() if c > 1) / max(n_pairs, 1)
    double = sum(c - 1 for x, c in repeated_lines.items() if x and c > 1) / max(len(lines), 1)
    separators = sum(len(SEPARATOR.findall(line)) for line in lines) / max(len(LETTERS.findall(text)), 1)
    items = len(ITEM.findall(text))
    # bare pieces are keywords if they repeat themselves, are chained by separators, or make up a longer text
    repeats = (n >= 6 and (again > 0.25 or top > 0.12)) or double > 0.3
    chained = n >= 6 and (separators > 0.2 or items > 2)
    keywords = repeats or chained or n >= 25
    return sum(p[0] for p in pieces if p[1] == "link" or (keywords and p[1] in ("bare", "free"))) / total


def _judge(floor: dict[str, float]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lists = _lists()
        for pdf in batches:
            yield pd.DataFrame({"doc": pdf["doc"], "stuffed": [stuffed_share(t, floor, lists) for t in pdf["text"]]})

    return run


def stuffed_documents(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", share: float = 0.5, part: float = 0.3) -> DataFrame:
    """(doc_id, stuffed): documents of which more than ``share`` is no sentences. ``part``: so much of a language's mean
    share of function words a piece needs to count as sentences."""
    docs = documents.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).filter("text is not null and trim(text) <> '' and doc is not null")
    docs = spread(docs)
    # calibration over all documents; one row for each language comes back
    means = docs.select("text").mapInPandas(_measure, "lang string, share double").filter("share > 0.1").groupBy("lang").agg(F.avg("share")).collect()
    floor = {lang: part * mean for lang, mean in means}
    kind = docs.schema["doc"].dataType.simpleString()
    judged = docs.mapInPandas(_judge(floor), f"doc {kind}, stuffed double").filter(F.col("stuffed") > share)
    return judged.groupBy(F.col("doc").alias(doc_id)).agg(F.max("stuffed").alias("stuffed"))

