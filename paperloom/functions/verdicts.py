"""Parsing of model answers: decision lines and fenced JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.text import strip

FENCE = "```"


def last_line_value(answer: Column, label: str) -> Column:
    """Text after ``label`` on the last line that starts with it; null without such a line."""
    hits = F.filter(F.split(strip(answer), "\n"), lambda line: F.startswith(line, F.lit(label)))
    return F.when(F.size(hits) > 0, strip(F.replace(F.element_at(hits, -1), F.lit(label), F.lit(""))))


def decision(answer: Column) -> Column:
    return F.coalesce(last_line_value(answer, "DECISION:"), F.lit("Uncertain"))


def is_relevant(answer: Column) -> Column:
    """Only an explicit yes counts; a missing answer is a no."""
    return F.coalesce(F.lower(decision(answer)) == "yes", F.lit(False))


def reason(answer: Column) -> Column:
    return F.coalesce(last_line_value(answer, "REASON:"), F.lit(""))


def unfenced(answer: Column) -> Column:
    """JSON text inside a code fence, its language tag removed; unfenced text as it is."""
    trimmed = strip(answer)
    inside = F.get(F.split(trimmed, FENCE), F.lit(1))
    return F.when(F.startswith(trimmed, F.lit(FENCE)), strip(F.regexp_replace(inside, "^json", ""))).otherwise(trimmed)


def fenced_json(answer: Column, schema: str) -> Column:
    """Parsed answer; malformed JSON gives null instead of an error."""
    parsed = F.from_json(unfenced(answer), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return parsed
