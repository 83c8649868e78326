"""Answers of models: finding the JSON object, saving what was cut off, and flattening it to text."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

LABELS = {"appearance": "appearance", "clothing": "clothing", "action": "action", "position": "position", "seen_at": "seen at"}
HEAD = ("apparent_age", "gender_presentation")


def parse_object(text: str | None) -> dict | None:
    """The whole text as a JSON object, else what stands from its first { to its last }."""
    if text is None:
        return None
    for part in (text, text[text.find("{") : text.rfind("}") + 1] if "{" in text else ""):
        try:
            value = json.loads(part)
        except (ValueError, RecursionError):
            continue
        if isinstance(value, dict):
            return value
    return None


def _value_at(text: str, field: str) -> str | None:
    """What follows ``"field":``."""
    _, found, rest = text.partition(f'"{field}"')
    rest = rest.lstrip()
    return rest[1:].lstrip() if found and rest.startswith(":") else None


def salvage(text: str, field: str, partial: bool = False) -> str | None:
    """The string of a field in an object that may be cut off later; with ``partial`` the string itself may be."""
    rest = _value_at(text, field)
    if rest is None or not rest.startswith('"'):
        return None
    decode = json.JSONDecoder(strict=True).raw_decode
    try:
        value, _ = decode(rest)
    except ValueError:
        if not partial:
            return None
        if rest.endswith("\\") and not rest.endswith("\\\\"):
            rest = rest[:-1]
        try:
            value, _ = decode(rest + '"')
        except ValueError:
            return None
    return value.strip() or None if isinstance(value, str) else None


def ocr_text(answer: str) -> str | None:
    """The text of an answer; "" if the model found none, None if nothing can be saved."""
    if (value := parse_object(answer)) is not None:
        return value["text"].strip() if isinstance(value.get("text"), str) else None
    return salvage(answer, "text") or salvage(answer, "text", partial=True)


def _filled(value: object) -> str | None:
    return value.strip() or None if isinstance(value, str) else None


def person_text(person: object) -> str:
    if not isinstance(person, dict):
        return person.strip() if isinstance(person, str) else ""
    head = ", ".join(x for k in HEAD if (x := _filled(person.get(k))))
    named = [f"{label}: {x}" for k, label in LABELS.items() if (x := _filled(person.get(k)))]
    named += [f"{k.replace('_', ' ')}: {x}" for k in sorted(person) if k not in LABELS and k not in HEAD and (x := _filled(person[k]))]
    return "; ".join(x for x in (head, "; ".join(named)) if x)


def searchable(value: dict) -> str:
    """The object as lines of text for the summary and the index."""
    lines = []
    if isinstance(value.get("summary"), str) and value["summary"]:
        lines.append(value["summary"].strip())
    count = value.get("people_count")
    if isinstance(count, int) and not isinstance(count, bool) and count > 0:
        lines.append(f"People visible: {count}")
    people = value.get("people")
    told = [t for p in (people if isinstance(people, list) else []) if (t := person_text(p))]
    lines += [f"Person {i}: {t}" for i, t in enumerate(told, 1)]
    for key in ("topics", "objects", "tags"):
        items = [x for x in value[key] if isinstance(x, str)] if isinstance(value.get(key), list) else []
        if items:
            lines.append(f"{key.capitalize()}: {', '.join(items)}.")
    for key, label in (("scene", "Scene"), ("visible_text", "Text")):
        if t := _filled(value.get(key)):
            lines.append(f"{label}: {t}")
    return "\n".join(lines)


def description(answer: str) -> str:
    """Flattened object, else the saved summary, else the answer itself."""
    value = parse_object(answer)
    return (searchable(value) if value is not None else "") or salvage(answer, "summary") or answer.strip()


@F.pandas_udf(T.StringType())
def searchable_text(answer: pd.Series) -> pd.Series:
    return answer.map(lambda a: None if a is None else searchable(v) if (v := parse_object(a)) is not None else None)


@F.pandas_udf(T.StringType())
def describe(answer: pd.Series) -> pd.Series:
    return answer.map(lambda a: None if a is None else description(a))


@F.pandas_udf(T.StringType())
def recognised_text(answer: pd.Series) -> pd.Series:
    return answer.map(lambda a: None if a is None else ocr_text(a))


@F.pandas_udf(T.StringType())
def answer_object(answer: pd.Series) -> pd.Series:
    return answer.map(lambda a: None if (v := parse_object(a)) is None else json.dumps(v, ensure_ascii=False, sort_keys=True))
