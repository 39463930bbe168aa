"""Parsing of model output as JSON: a native fast path, and an Arrow UDF with repairs for what that leaves.

Layers: code fence, strict parse, stray backslashes, first balanced object, missing closers. Only objects count.
Null and blank output is 'empty'; output that ends inside a fence, string or bracket is 'truncated'.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

_FENCE = re.compile(r"\A\s*```(?:json)?[ \t]*\n(.*?)(?:\n?```\s*)?\Z", re.DOTALL | re.IGNORECASE)
_STRAY = re.compile(r'\\(?:(["\\/bfnrt]|u[0-9a-fA-F]{4})|(?=.|\Z))', re.DOTALL)
_CLOSES = {"{": "}", "[": "]"}


def without_fence(raw: str) -> str:
    m = _FENCE.match(raw)
    return (m[1] if m else raw).strip()


def fixed_escapes(text: str) -> str:
    """Backslashes that start no JSON escape are doubled."""
    return _STRAY.sub(lambda m: m[0] if m[1] else "\\\\", text)


def walk(text: str) -> tuple[list[tuple[int, str]], bool, int | None]:
    """Brackets still open at the end (place, kind), whether a string is, and where the first object ends."""
    stack: list[tuple[int, str]] = []
    quoted = skip = False
    end = None
    for i, ch in enumerate(text):
        if quoted:
            if skip:
                skip = False
            elif ch == "\\":
                skip = True
            elif ch == '"':
                quoted = False
        elif ch == '"':
            quoted = bool(stack)
        elif ch in _CLOSES:
            stack.append((i, ch))
        elif stack and ch == _CLOSES[stack[-1][1]]:
            stack.pop()
            if not stack and ch == "}":
                end = i + 1
                break
    return stack, quoted, end


def first_object(text: str) -> str | None:
    start = text.find("{")
    if start < 0:
        return None
    end = walk(text[start:])[2]
    return text[start : start + end] if end else None


def with_closers(text: str) -> str | None:
    """The text with closers put in where a closer of another kind stands, and nothing else; None inside a string."""
    start = text.find("{")
    if start < 0:
        return None
    out, stack, quoted, skip = [], [], False, False
    for ch in text[start:]:
        if quoted:
            quoted, skip = (True, False) if skip else (ch != '"', ch == "\\")
        elif ch == '"':
            quoted = True
        elif ch in _CLOSES:
            stack.append(_CLOSES[ch])
        elif ch in "}]":
            while stack and stack[-1] != ch:
                out.append(stack.pop())
            if not stack:
                break
            stack.pop()
        out.append(ch)
        if not stack and not quoted:
            break
    return None if quoted or stack else "".join(out)


def truncated(raw: str | None) -> bool:
    text = raw or ""
    if text.lstrip().startswith("```") and text.count("```") % 2:
        return True
    start = text.find("{")
    if start < 0:
        return False
    stack, quoted, end = walk(text[start:])
    return end is None and (quoted or bool(stack)) and with_closers(text) is None


def parse(raw: str | None) -> tuple[str | None, str]:
    """(object as JSON, how): strict, escapes, first_object, closers; or None with empty, truncated, not_object, invalid."""
    if raw is None or not raw.strip():
        return None, "empty"
    text = without_fence(raw)
    how = "invalid"
    for name, made in (("strict", text), ("escapes", fixed_escapes(text)), ("first_object", first_object(fixed_escapes(text))), ("closers", with_closers(fixed_escapes(text)))):
        if made is None:
            continue
        try:
            value = json.loads(made)
        except ValueError:
            continue
        if isinstance(value, dict):
            return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")), name
        how = "not_object"
    return None, "truncated" if truncated(raw) else how


@F.pandas_udf(StructType([StructField("value", StringType()), StructField("how", StringType())]))
def _parsed(raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse(x) for x in raw], columns=["value", "how"])


def parsed(c: Column) -> Column:
    """struct(value, how) of a column of model output."""
    return _parsed(c)
