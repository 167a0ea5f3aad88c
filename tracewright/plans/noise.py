"""Noise around the verdicts of queries: the same object, said as models say it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = "```"


def dressed(body: Column, by: Column) -> Column:
    """A JSON object bare, after thoughts with braces in them, fenced behind another object, after an object without the asked fields, or among stray braces; which one depends on `by`."""
    thought, draft = F.lit("Let me see { 'x': 1 }, it needs {\"step\"}.\n"), F.lit('{"note": "draft }"}')
    shapes = [body, F.concat(thought, body), F.concat(draft, F.lit(f"\n{FENCE}json\n"), body, F.lit(f"\n{FENCE} done {{see above}}")), F.concat(draft, F.lit(" and so "), body), F.concat(F.lit("} well "), body, F.lit(" {"))]
    return F.element_at(F.array(*shapes), (F.crc32(by.cast("string").cast("binary")) % 5 + 1).cast("int"))
