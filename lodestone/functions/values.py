"""Small value functions: flags, bands, pages, JSON."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def tristate(number: Column) -> Column:
    """1 true, 0 false, all else unknown."""
    return F.when(number == 1, True).when(number == 0, False)


def untristate(flag: Column) -> Column:
    return flag.cast("int")


def score_band(score: Column) -> Column:
    """``score-90`` from 0.9, in tenths down to ``score-10``; below that ``score-00``."""
    band = F.lit("score-00")
    for tenth in range(1, 10):
        band = F.when(score >= tenth / 10, F.lit(f"score-{tenth}0")).otherwise(band)
    return band


def total_pages(n: Column, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / size)).cast("int")


def over_fetch(k: int) -> int:
    """How many results to fetch so that later pages need no second search."""
    return max(5 * k, 50)


def check_top_k(k: int, most: int = 100) -> int:
    if not 1 <= k <= most:
        raise ValueError(f"top_k is {k}; it must be from 1 to {most}")
    return k


def pagination_strip(current: Column, total: Column) -> Column:
    """Page numbers as strings, with ellipses: all up to seven, else the ends and what is around the current one."""
    text = lambda a: F.transform(a, lambda x: x.cast("string"))
    dots, one, last = F.array(F.lit("...")), F.array(F.lit("1")), F.array(total.cast("string"))
    i = lambda n: F.lit(n)
    return (
        F.when(total <= 7, text(F.sequence(i(1), F.greatest(total, i(1)))))
        .when(current <= 4, F.concat(text(F.sequence(i(1), i(5))), dots, last))
        .when(current >= total - 3, F.concat(one, dots, text(F.sequence(total - 4, total))))
        .otherwise(F.concat(one, dots, text(F.sequence(current - 1, current + 1)), dots, last))
    )


def progress(done: Column, percent: Column, n: Column) -> Column:
    """Whole percent, half up, of n files of which done are finished and one is at percent."""
    return F.floor((done + percent / 100) / n * 100 + 0.5).cast("int")


def json_or(text: Column, schema: str, default: Column) -> Column:
    """The decoded value; null, empty or invalid text gives the default."""
    return F.coalesce(F.from_json(F.nullif(text, F.lit("")), schema), default)


def json_field(text: Column, *path: str) -> Column:
    return F.get_json_object(text, "$." + ".".join(path))


_FENCE = re.compile(r"^\s*```[A-Za-z0-9_-]*\s*\n?(.*?)\n?\s*```\s*$", re.S)
_TRAILING = re.compile(r",\s*([}\]])")


def _attempt(text: str):
    """('json' | 'python', value) of text, or None."""
    try:
        return "json", json.loads(text)
    except ValueError:
        pass
    try:
        return "python", ast.literal_eval(text)
    except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
        return None


def parse_structured(raw: str | None, strict: bool = False) -> tuple[object, str]:
    """An object or array from what a model wrote, and how it was found."""
    text = (raw or "").strip()
    if not text:
        return None, "empty_output"
    if m := _FENCE.match(text):
        text = m[1].strip()
    names = {dict: ("json_ok", "python_literal_dict", "obj"), list: ("json_array", "python_literal_array", "array")}
    got = _attempt(text)
    if got and got[0] == "json" and isinstance(got[1], (dict, list)):
        return got[1], names[type(got[1])][0]
    if strict and not (got and got[0] == "json"):
        return None, "json_invalid"
    if got and got[0] == "python" and isinstance(got[1], (dict, list)):
        return got[1], names[type(got[1])][1]
    for pattern, kind in ((r"\{.*\}", dict), (r"\[.*\]", list)):
        if m := re.search(pattern, text, re.S):
            got = _attempt(_TRAILING.sub(r"\1", m[0]))
            if got and isinstance(got[1], kind):
                how = names[kind][2] if got[0] == "json" else {"obj": "dict", "array": "array"}[names[kind][2]]
                return got[1], f"{'json' if got[0] == 'json' else 'python'}_salvaged_{how}"
    return None, "unparseable"


def lenient_json(raw: Column, strict: bool = False) -> Column:
    """struct<value: JSON text, reason>."""

    @F.pandas_udf("value string, reason string")
    def parse(raw: pd.Series) -> pd.DataFrame:
        rows = []
        for value, reason in (parse_structured(r, strict) for r in raw):
            try:
                rows.append((None if value is None else json.dumps(value, ensure_ascii=False), reason))
            except (TypeError, ValueError):
                rows.append((None, "unparseable"))
        return pd.DataFrame(rows, columns=["value", "reason"])

    return parse(raw)


def llm_json(text: Column) -> Column:
    """The JSON object in a model's answer as a map: a fenced one, else from the first brace to the last, else the whole; {} if it does not parse."""
    fenced = F.regexp_extract(text, r"(?s)```json\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    chosen = F.coalesce(F.nullif(fenced, F.lit("")), F.nullif(braces, F.lit("")), text)
    return F.coalesce(F.from_json(chosen, "map<string,string>"), F.create_map().cast("map<string,string>"))


def overlay(old: Mapping[str, Column], new: Mapping[str, Column]) -> dict[str, Column]:
    """New values where there are any, else the old."""
    return {k: F.coalesce(new[k], c) if k in new else c for k, c in old.items()}


def overflow(found: Column, known: list[str]) -> Column:
    """The entries of a map whose keys are not fields."""
    return F.map_filter(F.coalesce(found, F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(known))


def prompt(fields: list[str], text: Column, kind: str = "document") -> Column:
    """An extraction prompt: the fields as a list, an empty JSON form, and the text."""
    listed = "\n".join(f"- {f}" for f in fields)
    form = "{" + ", ".join(f'"{f}": null' for f in fields) + "}"
    return F.concat(F.lit(f"Extract these fields of the {kind}:\n{listed}\nAnswer with JSON only:\n{form}\nText:\n"), F.coalesce(text, F.lit("")))
