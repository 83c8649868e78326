"""Texts cut off by a limit or in transfer (problem 4: model answers in analyses.raw_response).

Method. The words of all answers form a trie, held as a table of its nodes (prefix, words below it, whether it is a
word itself), so that it is built and searched by joins. The final token of every answer that is not closed, be it prose,
a string within an object or text after one, is looked up: an unknown proper prefix of known words is cut (``word``), and so is
a last list item that is an unknown proper prefix of known items (``item``). Length evidence comes second: answers whose
tokens stand at a limit, one that the error names or one at which token counts pile up over all answers, and that are
not ended are cut (``length``). What ends between two words far from any limit is left to the form: an object, fence or
thought that stays open (``form``), a sentence without its end that is neither a list nor a known closing formula
(``sentence``), a closing formula that lacks its rest (``formula``). An object that closes is complete, whatever it quotes.

Defined results: null, empty and blank answers are no cases; repeated ids give one row, truncated if one copy is;
null token counts, errors and models are allowed; answers, words and formulas of any length are compared whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = re.compile(r"[.!?…。][\"'”’»)\]*_]*$")
LIST = re.compile(r"(?:^|[.!?…]\s+|\n)([^\W\d_][\w ]*):[ \t]*([^.!?\n]*)$")
FORM = "id string, state string, before bigint, after string, after_h bigint, line bigint, items array<string>, token string, tokens int, chars int, limit int"
#: Causes from the strongest evidence to the weakest.
CAUSES = ("word", "item", "length", "formula", "sentence", "form")


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _closed(text: str) -> int:
    """Position after the first object in text, -1 if it does not end. Strict parsing first, then a scan that knows only
    strings and brackets, for objects with signs that JSON forbids."""
    try:
        return json.JSONDecoder(strict=False).raw_decode(text)[1]
    except (json.JSONDecodeError, RecursionError):
        pass
    depth, at = 0, 0
    for m in re.finditer(r'"(?:[^"\\]|\\.)*"|"|[{}\[\]]', text, re.S):
        s = m.group()
        if s == '"':
            return -1
        if s in "{[":
            depth += 1
        elif s in "}]":
            depth -= 1
            if depth == 0:
                at = m.end()
                return at
    return -1


def form_of(text: str) -> tuple[str, str, str]:
    """(state, before, after): state is open, closed, prose or none."""
    body = text.strip()
    if not body:
        return "none", "", ""
    if body.startswith("<think>"):
        if "</think>" not in body:
            return "open", "", ""
        body = body.rpartition("</think>")[2].strip()
        if not body:
            return "open", "", ""
    at = body.find("{")
    if at < 0:
        return ("open" if body.count("```") % 2 else "prose"), body, ""
    end = _closed(body[at:])
    before = body[:at].replace("```json", "```")
    if end < 0:
        return "open", before, ""
    after = body[at + end :].strip()
    if before.count("```") % 2:
        if not after.startswith("```"):
            return "open", before, ""
        after = after[3:].strip()
    return "closed", before.replace("```", "").strip(), after


def _describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for i, text, tokens, error in zip(pdf["id"], pdf["raw_response"], pdf["completion_tokens"], pdf["error"]):
            state, before, after = form_of(text)
            if state == "none":
                continue
            items, token, line = None, "", text.rstrip().rpartition("\n")[2].strip()
            if state == "prose":
                if not END.search(before):
                    token = re.search(r"\S+$", before).group()
                if m := LIST.search(before):
                    items = [x.strip() for x in m.group(2).split(",")]
            elif state == "open":
                token = re.search(r"[^\W_]*(?:-[^\W_]*)*$", text.rstrip()).group()  # a sign after the last word leaves nothing to look up
            elif after and not END.search(after):
                token = re.search(r"\S+$", after).group()
            m = re.search(r"max_tokens=(\d+)", error) if isinstance(error, str) else None
            tokens = int(tokens) if tokens == tokens and tokens is not None else None
            rows.append((i, state, _hash(before), after, _hash(after), _hash(line), items, token, tokens, len(text), int(m.group(1)) if m else None))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in FORM.split(", ")]).astype({"tokens": "Int32", "limit": "Int32"})


def described(analyses: DataFrame) -> DataFrame:
    rows = analyses.select(F.col("id").cast("string").alias("id"), "raw_response", F.col("completion_tokens").cast("double").alias("completion_tokens"), "error")
    return rows.filter("raw_response <> '' and id is not null").mapInPandas(_describe, FORM)


def trie_nodes(words: DataFrame, wanted: DataFrame) -> DataFrame:
    """(prefix, below, known): the nodes of the trie over ``words`` (word, n) that ``wanted`` (prefix) asks for.

    A word gives one row for each of its prefixes, its length and hash; the search joins them, so neither the trie nor the
    list of prefixes is held in one place, and long words cost no more room than short ones."""
    node = lambda text: F.struct(F.length(text).alias("size"), F.xxhash64(text).alias("h"))
    nodes = words.select("word", "n", F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: node(F.substring(F.col("word"), F.lit(1), i)))).alias("node"))
    asked = wanted.select("prefix").filter("prefix <> ''").distinct().withColumn("node", node(F.col("prefix")))
    return (
        nodes.join(asked, "node")
        .groupBy("prefix")
        .agg(F.sum(F.when(F.col("word") != F.col("prefix"), F.col("n")).otherwise(0)).alias("below"), F.sum(F.when(F.col("word") == F.col("prefix"), F.col("n")).otherwise(0)).alias("known"))
    )


def _vocabulary(analyses: DataFrame) -> DataFrame:
    """Words that are followed by another sign: the last token of a text is no evidence for itself."""
    inner = F.regexp_replace(F.col("raw_response"), r"\S+\s*$", "")
    return analyses.filter("raw_response <> ''").select(F.explode(F.split(inner, r"[^\p{L}\p{N}-]+")).alias("word")).filter("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def piled_up(rows: DataFrame, reach: int = 2) -> DataFrame:
    """(tokens): the token counts at which answers pile up, far more often than the counts up to ``reach`` beside them."""
    hist = rows.filter("tokens is not null").groupBy("tokens").agg(F.count("*").alias("n"))
    beside = hist.select(F.explode(F.array(*(F.col("tokens") + i for i in range(-reach, reach + 1) if i))).alias("tokens"), "n").groupBy("tokens").agg((F.sum("n") / (2 * reach)).alias("usual"))
    usual = F.coalesce("usual", F.lit(0.0))
    return hist.join(beside, "tokens", "left").filter((F.col("n") >= 5) & (F.col("n") > usual * 1.2 + 5 * F.sqrt(usual + 1) - 5)).select("tokens")


def truncated(analyses: DataFrame, formula_min: int = 3) -> DataFrame:
    """(id, cause): one row for each truncated id with the strongest evidence (see ``CAUSES``).

    ``formula_min``: so often a text around objects must recur to count as an opening or closing formula."""
    from catalens.session import checkpoint

    rows = checkpoint(described(analyses))
    prose, closed = rows.filter("state = 'prose'"), rows.filter("state = 'closed'")

    # opening and closing formulas: what recurs before and after objects
    before = closed.groupBy("before").count().filter((F.col("count") >= formula_min) & (F.col("before") != _hash(""))).select("before")
    after = closed.filter("after <> ''").groupBy("after", "after_h").count().filter(F.col("count") >= formula_min).select(F.col("after").alias("word"), "after_h", F.col("count").alias("n"))

    open_end = rows.filter("token <> '' or state = 'open'").withColumn("bare", F.regexp_replace("token", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}-]+$", ""))
    words = trie_nodes(_vocabulary(analyses), open_end.select(F.col("bare").alias("prefix"))).select(
        F.col("prefix").alias("bare"), F.col("below").alias("word_below"), F.col("known").alias("word_known"))

    # lists: an item is known if another item follows it
    lists = open_end.filter("items is not null").withColumn("item", F.element_at("items", -1))
    known_items = (
        prose.filter("size(items) > 1").select(F.explode(F.slice("items", F.lit(1), F.size("items") - 1)).alias("word"))
        .filter("word <> ''").groupBy("word").agg(F.count("*").alias("n"))
    )
    items = trie_nodes(known_items, lists.select(F.col("item").alias("prefix"))).select(
        F.col("prefix").alias("item"), F.col("below").alias("item_below"), F.col("known").alias("item_known"))

    # closing formulas stand on their own line, also after prose
    judged = (
        open_end.withColumn("item", F.element_at("items", -1))
        .join(words, "bare", "left").join(items, "item", "left")
        .join(after.select(F.col("after_h").alias("line"), F.lit(True).alias("formula")).distinct(), "line", "left")
        .join(after.select("after_h", F.lit(True).alias("ending")).distinct(), "after_h", "left")
        .join(piled_up(rows).withColumn("pile", F.lit(True)), "tokens", "left")
        .select("id", F.expr("""
            case when state = 'prose' and formula or state = 'closed' and ending then null
                 when items is not null and item = '' then 'item'
                 when items is not null and coalesce(item_known, 0) > 0 then null
                 when items is not null and coalesce(item_below, 0) > 0 then 'item'
                 when coalesce(word_known, 0) = 0 and coalesce(word_below, 0) > 0 then 'word'
                 when items is not null and size(items) > 1 then null
                 when pile or tokens >= limit then 'length'
                 when state = 'open' then 'form'
                 when state = 'prose' then 'sentence' end""").alias("cause"))
        .filter("cause is not null")
    )
    tails = closed.filter("after <> ''").select("id", F.col("after").alias("prefix"))
    cut_formula = tails.join(trie_nodes(after, tails).filter("known = 0 and below > 0"), "prefix", "left_semi").select("id", F.lit("formula").alias("cause"))
    opening = prose.join(before, "before", "left_semi").select("id", F.lit("formula").alias("cause"))

    # prose with an end, but as long as the limit that the error names, and no shorter than so many tokens are
    usual = closed.filter("tokens > 20").agg(F.percentile_approx(F.col("chars") / F.col("tokens"), [0.02, 0.98], 1000).alias("p")).select(F.col("p")[0].alias("low"), F.col("p")[1].alias("high"))
    at_limit = prose.filter("token = '' and limit is not null and tokens >= limit").join(F.broadcast(usual), F.expr("chars between low * tokens * 0.9 and high * tokens"))
    found = judged.unionByName(cut_formula).unionByName(opening).unionByName(at_limit.select("id", F.lit("length").alias("cause")))
    return found.groupBy("id").agg(F.min_by("cause", F.array_position(F.lit(list(CAUSES)), F.col("cause"))).alias("cause"))


def truncation_share(analyses: DataFrame, *keys: str) -> DataFrame:
    """(keys, answers, truncated, share, by_trie, by_length) over distinct ids with an answer that is not blank; the last
    two say how many of the truncated are told by the trie and by their length."""
    keys = keys or ("model", "prompt_version")
    rows = analyses.filter("trim(raw_response) <> '' and id is not null").groupBy(F.col("id").cast("string").alias("id")).agg(*(F.max(k).alias(k) for k in keys))
    marked = rows.join(truncated(analyses), "id", "left")
    count = lambda condition: F.count(F.when(F.expr(condition), 1))
    return marked.groupBy(*keys).agg(
        F.count("*").alias("answers"), F.count("cause").alias("truncated"), F.round(F.count("cause") / F.count("*"), 6).alias("share"),
        count("cause in ('word', 'item')").alias("by_trie"), count("cause = 'length'").alias("by_length"),
    )
