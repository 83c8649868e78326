"""Text and number functions of extraction and enrichment."""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalens import schemas as S


def decode_bytes(data: bytes | None) -> tuple[str, str] | None:
    """(text, encoding): by byte-order mark, else UTF-8 (a sign cut at the end is dropped), else windows-1252."""
    if data is None:
        return None
    data = bytes(data)
    for mark, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16le"), (codecs.BOM_UTF16_BE, "utf-16be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace"), name
    try:
        return data.decode("ascii"), "ascii"
    except UnicodeDecodeError:
        pass
    decoder = codecs.getincrementaldecoder("utf-8")()
    try:
        text = decoder.decode(data)
        return text, "utf-8"
    except UnicodeDecodeError:
        return "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in data) if _undefined(data) else data.decode("cp1252"), "windows-1252"


def _undefined(data: bytes) -> bool:
    return any(b in data for b in (0x81, 0x8D, 0x8F, 0x90, 0x9D))


def cap_bytes(text: str, limit: int = S.TEXT_CAP_BYTES) -> str:
    """At most ``limit`` bytes of UTF-8, cut between characters."""
    data = text.encode("utf-8", "surrogatepass")
    return text if len(data) <= limit else data[:limit].decode("utf-8", "ignore")


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("encoding", T.StringType())]))
def decode_text(content: pd.Series) -> pd.DataFrame:
    done = [decode_bytes(x) for x in content]
    return pd.DataFrame({"text": [cap_bytes(d[0]) if d else None for d in done], "encoding": [d[1] if d else None for d in done]})


def bare_length(text: Column) -> Column:
    """Characters that are no white space (of any script)."""
    return F.length(F.regexp_replace(text, r"(?U)\s", ""))


def lacks_text_layer(content: Column, pages: Column) -> Column:
    return bare_length(F.coalesce(content, F.lit(""))) < S.CHARS_PER_PAGE * F.greatest(F.coalesce(pages, F.lit(1)), F.lit(1))


def page_count(info: Column) -> Column:
    """The number after "Pages:" in a document's information listing."""
    found = F.regexp_extract(info, r"(?m)^Pages:\s*(\d+)", 1)
    return F.when(found != "", found.cast("int"))


def doc_head(content: Column, chars: int = S.DOC_HEAD_CHARS) -> Column:
    return F.left(content, F.lit(chars))


def worth_summarising(content: Column) -> Column:
    return bare_length(F.coalesce(content, F.lit(""))) >= S.MIN_DOC_CHARS


def clock(seconds: Column) -> Column:
    """``HH:MM:SS``, rounded to the second."""
    s = F.round(F.greatest(seconds, F.lit(0.0))).cast("long")
    return F.format_string("%02d:%02d:%02d", (s / 3600).cast("long"), ((s % 3600) / 60).cast("long"), s % 60)


def document_prompt(name: Column, doc_type: Column, content: Column, chars: int = S.DOC_HEAD_CHARS) -> Column:
    cut = F.length(content) > chars
    return F.concat(
        F.lit("Summarise the following "), doc_type, F.lit(" file. Answer with a JSON object with summary, topics and tags.\nFile name: "), name,
        F.when(cut, F.lit("\nOnly the beginning of the file is shown.")).otherwise(F.lit("")), F.lit("\n\n"), doc_head(content, chars),
    )


def frames_prompt(frames: Column, duration: Column) -> Column:
    """``frames`` is an array of (ts_secs, description) in order; each description is cut before merging."""
    lines = F.transform(frames, lambda f: F.concat(F.lit("["), clock(f["ts_secs"]), F.lit("] "), F.left(f["description"], F.lit(S.FRAME_MERGE_CHARS))))
    return F.concat(F.lit("These are descriptions of frames of one video of "), clock(duration), F.lit(". Merge them into one JSON object.\n"), F.array_join(lines, "\n"))


def strip_think(answer: Column) -> Column:
    """The answer without its thought: after the last closing mark, else before an opening one."""
    closed = F.regexp_replace(answer, r"(?s)^.*</think>", "")
    return F.trim(F.when(F.instr(answer, "</think>") > 0, closed).otherwise(F.regexp_replace(answer, r"(?s)<think>.*$", "")), F.lit(" \n\r\t"))


def parse_rate(rate: Column) -> Column:
    """Frames a second of "30000/1001" or "25"; null if either part is 0 or no number."""
    a = F.element_at(F.split(rate, "/"), 1).try_cast("double")
    b = F.when(F.instr(rate, "/") > 0, F.try_element_at(F.split(rate, "/"), F.lit(2)).try_cast("double")).otherwise(F.lit(1.0))
    return F.when((a > 0) & (b > 0), a / b)


def sample_times(duration: Column) -> Column:
    """Seconds of the frames to describe: the first, the middle and the last, at least a gap apart."""
    gap = F.lit(S.FRAME_GAP_SECS)
    return (
        F.when(duration.isNull() | (duration < gap), F.array(F.lit(0.0)))
        .when(duration < 2 * gap, F.array(F.lit(0.0), duration))
        .otherwise(F.array(F.lit(0.0), duration / 2, duration))
    )


def estimated_frames(duration: Column, interval: int = 60, most: int = 120) -> Column:
    """Frames that one a ``interval`` seconds would give, with the last one, at most ``most``."""
    step = F.greatest(F.lit(float(interval)), duration / most) if most else F.lit(float(interval))
    regular = F.least(F.floor(duration / step) + 1, F.lit(max(most - 1, 1)).cast("long"))
    return regular + F.when(duration - (regular - 1) * step >= S.FRAME_GAP_SECS, 1).otherwise(0)


def human_bytes(n: float) -> str:
    for unit in ("B", "KB", "MB", "GB"):
        if n < 1000:
            return f"{int(n)} B" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1000
    return f"{n:.1f} TB"


def human_time(seconds: float) -> str:
    hours = seconds / 3600
    return f"{hours / 24:.1f} days" if hours >= 48 else f"{hours:.1f} h"
