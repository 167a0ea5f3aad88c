"""Verdicts out of noisy model answers: JSON objects among thoughts, fences and prose, the first that fits its schema."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

FENCE = "```"
#: A string literal (an unclosed one goes to the end), or a brace outside of one.
_TOKEN = re.compile(r'"(?:[^"\\]++|\\.|\\\Z)*+(?:"|\Z)|[{}]', re.S)


def braced(text: str) -> list[str]:
    """Outermost {...} stretches in order; braces inside string literals don't count, nor do closing ones that nothing opened, nor stretches that are never closed."""
    found, open_, depth = [], 0, 0
    for m in _TOKEN.finditer(text):
        if m[0] == "{":
            open_, depth = (m.start(), 1) if not depth else (open_, depth + 1)
        elif m[0] == "}" and depth:
            depth -= 1
            if not depth:
                found.append(text[open_ : m.end()])
    return found


def _as_json(block: str) -> str | None:
    """The block if it is a JSON object, or the same object from a literal with single quotes."""
    try:
        return block if isinstance(json.loads(block), dict) else None
    except (ValueError, RecursionError):
        pass
    try:
        value = ast.literal_eval(block)
        return json.dumps(value, ensure_ascii=False) if isinstance(value, dict) else None
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        return None


def objects_of(text: str | None) -> list[str]:
    """JSON objects of an answer, each once: those inside fences first, then all in order."""
    if not text:
        return []
    inside = [p.lstrip().removeprefix("json") if p.lstrip().startswith("json") else p for p in text.split(FENCE)[1::2]]
    blocks = [b for part in (*inside, text) for b in braced(part)]
    return [j for j in map(_as_json, dict.fromkeys(blocks)) if j is not None]


def _objects(texts: pd.Series) -> pd.Series:
    return texts.map(objects_of)


def json_objects(answer: Column) -> Column:
    """array<string> of the JSON objects in an answer, see objects_of(). Null or no object: an empty array."""
    return F.pandas_udf(_objects, ArrayType(StringType()))(answer)


def first_valid(answer: Column, schema: str, valid: Callable[[Column], Column]) -> Column:
    """The first object of an answer that `valid` accepts, as a struct of `schema`; else the first that has any field of it, so that the caller can say what is wrong with it; null without any object.

    Fields of another type than the schema's are null; `valid` says which fields must be there.
    """
    each = F.transform(json_objects(answer), lambda o: F.from_json(o, schema))
    first = lambda keep: F.get(F.filter(each, keep), F.lit(0))
    return F.coalesce(first(lambda v: F.coalesce(valid(v), F.lit(False))), first(lambda v: F.to_json(v) != "{}"), F.get(each, F.lit(0)))


def unparsed(answer: Column) -> Column:
    """Why an answer gives no object: 'unclosed' where a brace opens, else 'no object'; null if it gives one."""
    return F.when(F.size(json_objects(answer)) > 0, F.lit(None)).when(F.coalesce(answer.contains("{"), F.lit(False)), "unclosed").otherwise("no object")
