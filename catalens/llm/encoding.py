"""Garbled text from a wrong decoding (problem 5).

Method. Every distinct word of the corpus that holds a sign outside ASCII is written down in all forms it takes under
the known chains of wrong decodings (UTF-8 read as windows-1252, windows-1251 read as windows-1252, UTF-8 twice, bytes
replaced by U+FFFD, ...). The words of the corpus are hash-joined with that table; a hit names the original word.
A hit is verified: the original must be a word of the corpus itself, for chains that can be read in both directions
the original must be the more frequent form, and hits of such chains need a word of three signs, or two different words of which one has two signs, in the line.

Defined results: null or empty content gives no row; repeated rows of a file count once; a file whose copies differ is
affected if one of them is; content of any length is read whole; columns beyond (file_id, content) are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalens.session import spread

#: Code pages that occur as the wrong reading of UTF-8 bytes.
UTF8_READINGS = ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1250", "cp1251", "iso8859-2", "iso8859-15", "koi8-r", "cp866", "cp1254")
#: Pairs of single-byte code pages (written as, read as).
SINGLE_BYTE = tuple(
    (a, b)
    for a, many in {
        "cp1252": ("cp437", "cp850", "mac_roman", "cp1250", "cp1251", "iso8859-2", "koi8-r", "cp1253"),
        "mac_roman": ("cp1252", "latin-1"),
        "cp437": ("cp1252", "latin-1"),
        "cp850": ("cp1252", "latin-1"),
        "cp1250": ("cp1252", "latin-1", "iso8859-2", "cp852", "cp437", "cp850"),
        "iso8859-2": ("cp1252", "latin-1", "cp1250"),
        "cp852": ("cp1252", "latin-1"),
        "cp1251": ("cp1252", "latin-1", "koi8-r", "cp866", "mac_cyrillic"),
        "koi8-r": ("cp1252", "latin-1", "cp1251", "cp866"),
        "cp866": ("cp1252", "latin-1", "cp1251", "koi8-r"),
    }.items()
    for b in many
)
#: Pages whose bytes give U+FFFD when they are read as UTF-8.
LOSSY = ("cp1252", "mac_roman", "cp850", "cp1250", "iso8859-2", "cp1251", "koi8-r")
#: ASCII signs that are cut from both ends of a token.
EDGE = r"^[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+|[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+$"
#: A run of non-ASCII signs other than letters and digits at either end of a word, such as quotation marks.
SIGNS = r"(?:^[^\x00-\x7f\p{L}\p{N}]+)|(?:[^\x00-\x7f\p{L}\p{N}]+$)"


def _read(data: bytes, page: str) -> str | None:
    """Decodes as lenient software does: bytes that windows code pages leave undefined become control signs."""
    try:
        return data.decode(page)
    except UnicodeDecodeError:
        if not page.startswith("cp125"):
            return None
        return "".join(_one(b, page) for b in data)


def _one(byte: int, page: str) -> str:
    try:
        return bytes([byte]).decode(page)
    except UnicodeDecodeError:
        return chr(byte)


def _write(text: str, page: str) -> bytes | None:
    try:
        return text.encode(page)
    except UnicodeEncodeError:
        return None


def garbled_forms(word: str) -> dict[str, tuple[str, bool]]:
    """All garbled forms of a word: form -> (chain, sure). ``sure``: the chain cannot be read in the other direction."""
    out: dict[str, tuple[str, bool]] = {}
    if not word.strip() or any(c == "\ufffd" or "\x80" <= c <= "\x9f" for c in word):
        return out  # a blank, or itself the product of a wrong decoding

    def add(form: str | None, chain: str, sure: bool) -> None:
        if form and form != word and form not in out and any(ord(c) > 127 for c in form):
            if "U+FFFD" not in chain or "\ufffd" in form:  # else the reading was right, or a repair
                out[form] = (chain, sure)

    utf8 = word.encode("utf-8", "surrogatepass")
    once = {page: _read(utf8, page) for page in UTF8_READINGS}
    for page, form in once.items():
        add(form, f"utf-8>{page}", True)
    for page in ("cp1252", "latin-1", "mac_roman", "cp850", "cp437"):
        if form := once[page]:
            for again in ("cp1252", "latin-1", page):
                twice = _read(form.encode("utf-8"), again)
                add(twice, f"utf-8>{page}>utf-8>{again}", True)
                if twice and page in ("cp1252", "latin-1") and again == page:
                    add(_read(twice.encode("utf-8"), page), f"3 x utf-8>{page}", True)
    for page in ("cp1252", "cp1250", "cp1251"):  # undefined bytes lost or replaced
        lost = utf8.decode(page, "ignore")
        add(lost, f"utf-8>{page} with loss", True)
        add(utf8.decode(page, "replace"), f"utf-8>{page} with U+FFFD", True)
    add(utf8.decode("ascii", "replace"), "utf-8>ascii with U+FFFD", True)
    for page in LOSSY:
        data = _write(word, page)
        if data is not None:
            add(data.decode("utf-8", "replace"), f"{page}>utf-8 with U+FFFD", True)
            add("".join("�" if b > 127 else chr(b) for b in data), f"{page}>ascii with U+FFFD", True)
    for a, b in SINGLE_BYTE:
        data = _write(word, a)
        if data is not None:
            form = _read(data, b)
            add(form, f"{a}>{b}", False)
            if form:
                add(_read(form.encode("utf-8"), "cp1252"), f"{a}>{b}>utf-8>cp1252", True)
    return out


def _forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(g, w, n, chain, sure) for w, n in zip(pdf["word"], pdf["n"]) for g, (chain, sure) in garbled_forms(w).items()]
        yield pd.DataFrame(rows, columns=["garbled", "original", "n_original", "chain", "sure"])


def _tokens(lines: DataFrame) -> DataFrame:
    """(file_id, line_no, token): whole words and the runs of signs at their ends, only those with a non-ASCII sign."""
    word = F.regexp_replace("raw", EDGE, "")
    signs = F.expr(f"regexp_extract_all(word, r'{SIGNS}', 0)")
    core = F.expr(f"regexp_replace(word, r'{SIGNS}', '')")
    return (
        lines.select("file_id", "line_no", F.explode(F.split("line", r"[ \t\r\f\x0b]+")).alias("raw"))
        .filter(F.col("raw").rlike(r"[^\x00-\x7f]"))
        .select("file_id", "line_no", word.alias("word"))
        .select("file_id", "line_no", F.explode(F.array_distinct(F.concat(F.array("word", core), signs))).alias("token"))
        .filter(F.col("token").rlike(r"[^\x00-\x7f]"))
    )


def _lines(docs: DataFrame) -> DataFrame:
    """Distinct lines with a non-ASCII sign; a line garbled in one of two copies of a file counts for the file."""
    return (
        docs.select("file_id", F.posexplode(F.split("content", "\n")).alias("line_no", "line"))
        .filter(F.col("line").rlike(r"[^\x00-\x7f]"))
        .select("file_id", F.col("line_no") + 1, "line")
        .toDF("file_id", "line_no", "line")
        .distinct()
    )


def garbled_words(tokens: DataFrame) -> DataFrame:
    """(garbled, original, chain, sure): the corpus words that are a garbled form of another corpus word.

    The vocabulary is aggregated before the join, so hot words are one row; several originals of one form are
    settled by frequency, then by the word itself."""
    words = tokens.groupBy(F.col("token").alias("word")).agg(F.count("*").alias("n"))
    forms = spread(words).mapInPandas(_forms, "garbled string, original string, n_original long, chain string, sure boolean")
    hits = forms.join(words.select(F.col("word").alias("garbled"), F.col("n").alias("n_garbled")), "garbled").filter(
        F.col("sure") | (F.col("n_original") > F.col("n_garbled"))
    )
    best = F.max_by(F.struct("original", "chain", "sure", "n_original"), F.struct("sure", "n_original", "original"))
    best = hits.groupBy("garbled").agg(best.alias("b")).select("garbled", "b.original", "b.chain", "b.sure", "b.n_original")
    # an original that is garbled itself is followed once more to its own original
    root = best.filter("sure").select(F.col("garbled").alias("original"), F.col("original").alias("root"))
    return best.join(root, "original", "left").select("garbled", F.coalesce("root", "original").alias("original"), "chain", "sure", "n_original")


def garbled_tokens(documents: DataFrame, content: str = "content", file_id: str = "file_id") -> DataFrame:
    """(file_id, line_no, garbled, original, chain, sure), one row for each verified hit in a line."""
    docs = documents.select(F.col(file_id).alias("file_id"), F.col(content).alias("content")).filter("content is not null and file_id is not null")
    tokens = _tokens(_lines(docs))
    words = garbled_words(tokens)
    hits = tokens.join(words, tokens["token"] == words["garbled"]).drop("token")
    line = (
        hits.groupBy("file_id", "line_no")
        .agg(F.max("sure").alias("any_sure"), F.max(F.length("garbled")).alias("longest"), F.count_distinct("garbled").alias("k"))
        .filter("any_sure or longest >= 3 or (k >= 2 and longest >= 2)")
        .select("file_id", "line_no")
    )
    return hits.join(line, ["file_id", "line_no"], "left_semi").select("file_id", "line_no", "garbled", "original", "chain", "sure")


def garbled_files(documents: DataFrame, content: str = "content", file_id: str = "file_id") -> DataFrame:
    return garbled_tokens(documents, content, file_id).select("file_id").distinct()


def _restore(content: pd.Series, hits: pd.Series) -> pd.Series:
    out = []
    for text, found in zip(content, hits):
        lines = text.split("\n")
        by_line: dict[int, list[tuple[str, str]]] = {}
        for h in found:
            by_line.setdefault(h["line_no"], []).append((h["garbled"], h["original"]))
        for no, pairs in by_line.items():
            if no <= len(lines):
                for garbled, original in sorted(set(pairs), key=lambda p: (-len(p[0]), p)):
                    lines[no - 1] = lines[no - 1].replace(garbled, original)
        out.append("\n".join(lines))
    return pd.Series(out)


def restored_files(documents: DataFrame, content: str = "content", file_id: str = "file_id") -> DataFrame:
    """(file_id, content, lines, words, chains, lossy): the affected files with each verified hit replaced by its original.

    ``lossy``: signs were lost in the wrong decoding, so that the text was completed from the corpus' vocabulary."""
    restore = F.pandas_udf(_restore, "string")
    hits = garbled_tokens(documents, content, file_id).groupBy("file_id").agg(
        F.collect_set(F.struct("line_no", "garbled", "original")).alias("hits"),
        F.count_distinct("line_no").alias("lines"),
        F.count("*").alias("words"),
        F.array_join(F.array_sort(F.collect_set("chain")), ", ").alias("chains"),
        F.max(F.col("chain").contains("U+FFFD") | F.col("chain").contains("loss")).alias("lossy"),
    )
    docs = documents.select(F.col(file_id).alias("file_id"), F.col(content).alias("content")).filter("content is not null").distinct()
    return docs.join(hits, "file_id").select("file_id", restore("content", "hits").alias("content"), "lines", "words", "chains", "lossy")
