"""The text index: bodies, postings, document lengths and BM25 scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalens.functions import stemming
from catalens.operators.catalogue import Catalogue
from catalens.plans.request import like_pattern
from catalens.session import checkpoint

K1, B = 1.2, 0.75


def joined_text(rows: DataFrame, text: str, order: str, separator: str, name: str) -> DataFrame:
    """(file_id, name): the texts of a file in order."""
    return rows.groupBy("file_id").agg(F.expr(f"listagg({text}, '{separator}') within group (order by {order})").alias(name))


def bodies(c: Catalogue) -> DataFrame:
    """(file_id, body) for every file: names, path, summary, content, frames, tags and recognised text."""
    frames = joined_text(c.video_frames, "description", "ts_secs", " ", "frames_text")
    tags = joined_text(c.tags, "tag", "tag", " ", "tags_text")
    pages = joined_text(c.ocr, "text", "page", " ", "ocr_text")
    return (
        c.files.select("id", "file_name", "rel_path", "summary")
        .join(c.documents.select(F.col("file_id").alias("id"), "content"), "id", "left")
        .join(frames.withColumnRenamed("file_id", "id"), "id", "left").join(tags.withColumnRenamed("file_id", "id"), "id", "left").join(pages.withColumnRenamed("file_id", "id"), "id", "left")
        .select(F.col("id").alias("file_id"), F.concat_ws(" ", "file_name", F.replace(F.col("rel_path"), F.lit("/"), F.lit(" ")), "summary", "content", "frames_text", "tags_text", "ocr_text").alias("body"))
    )


def substring_score(body: Column, terms: list[str]) -> Column:
    """How many of the terms the body contains; a repeated term counts again."""
    return sum((F.when(body.ilike(like_pattern(t)), 1).otherwise(0) for t in terms), F.lit(0)).cast("double")


def tokens(body: Column) -> Column:
    """Words of a-z and 0-9 after accents are taken away; anything else divides words."""
    return F.filter(F.split(F.lower(stemming.unaccented(body)), "[^a-z0-9]+"), lambda w: w != "")


@dataclass
class TextIndex:
    """postings(term, file_id, tf), lengths(file_id, len); documents and average length are one row of ``totals``."""

    postings: DataFrame
    lengths: DataFrame
    totals: DataFrame
    stemmed: bool


def build(bodies: DataFrame, stem: bool = True, stop_words: frozenset[str] = stemming.STOP_WORDS, stored: bool = True) -> TextIndex:
    """Counts are combined in each task first; the stemmer runs over the distinct words, not over every token.

    ``stored`` writes the postings once (a checkpoint in the shared folder), since scores, document frequencies and
    lengths all read them."""
    words = bodies.select("file_id", F.explode(tokens(F.col("body"))).alias("word"))
    counted = words.groupBy("word", "file_id").agg(F.count("*").alias("tf"))
    if stop_words:
        counted = counted.filter(~F.col("word").isin(*sorted(stop_words)))
    if stem:
        stems = counted.select("word").distinct().withColumn("term", stemming.stem("word"))
        counted = counted.join(stems, "word").groupBy("term", "file_id").agg(F.sum("tf").alias("tf"))
    else:
        counted = counted.withColumnRenamed("word", "term")
    if stored:
        counted = checkpoint(counted)
    lengths = counted.groupBy("file_id").agg(F.sum("tf").alias("len"))
    totals = bodies.select("file_id").agg(F.count("*").alias("docs")).crossJoin(lengths.agg(F.sum("len").alias("words"))).select("docs", (F.col("words") / F.col("docs")).alias("avgdl"))
    return TextIndex(counted, lengths, totals, stem)


def query_terms(text: str, stemmed: bool, stop_words: frozenset[str] = stemming.STOP_WORDS) -> list[str]:
    import re

    words = [w for w in re.split("[^a-z0-9]+", stemming.strip_accents(text).lower()) if w and w not in stop_words]
    return sorted({stemming.porter(w) if stemmed else w for w in words})


def bm25(index: TextIndex, text: str, k: float = K1, b: float = B, conjunctive: bool = False) -> DataFrame:
    """(file_id, score) of the files that hold a term of the query (all terms if ``conjunctive``).

    The terms filter the postings scan; idf = log10((N - df + 0.5) / (df + 0.5) + 1)."""
    terms = query_terms(text, index.stemmed)
    hits = index.postings.filter(F.col("term").isin(*terms) if terms else F.lit(False))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log10((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    score = idf * F.col("tf") * (k + 1) / (F.col("tf") + k * (1 - b + b * F.col("len") / F.col("avgdl")))
    scored = (
        hits.join(F.broadcast(df), "term").join(index.lengths, "file_id").join(F.broadcast(index.totals))
        .groupBy("file_id").agg(F.sum(score).alias("score"), F.count("*").alias("n"))
    )
    return (scored.filter(F.col("n") == len(terms)) if conjunctive else scored).select("file_id", "score")


def refresh(index: TextIndex, bodies_of_changed: DataFrame, removed: DataFrame) -> TextIndex:
    """The index after some files changed or went: their postings are replaced, all others stay as they are."""
    fresh = build(bodies_of_changed, index.stemmed)
    gone = bodies_of_changed.select("file_id").union(removed.select("file_id")).distinct()
    postings = index.postings.join(gone, "file_id", "left_anti").unionByName(fresh.postings)
    lengths = index.lengths.join(gone, "file_id", "left_anti").unionByName(fresh.lengths)
    n = lengths.agg(F.count("*").alias("docs"), F.sum("len").alias("words"))
    return TextIndex(postings, lengths, n.select("docs", (F.col("words") / F.col("docs")).alias("avgdl")), index.stemmed)
