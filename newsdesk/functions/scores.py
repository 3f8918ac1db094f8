"""Scores on a common scale."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letter grades on a scale of 10.
GRADES = {"A+": 10.0, "A": 9.5, "A-": 9.0, "B+": 8.5, "B": 8.0, "B-": 7.5, "C+": 7.0, "C": 6.5, "C-": 6.0, "D+": 5.5, "D": 5.0, "D-": 4.5, "F": 3.0}


def normalize_score(score: Column, scale: Column, grade: Column | None = None, to: float = 10.0) -> Column:
    """score / scale on ``to``, or a letter grade; null out of range."""
    value = F.when((scale > 0) & (score >= 0) & (score <= scale), score / scale * to)
    if grade is None:
        return value
    return F.coalesce(value, F.try_element_at(F.create_map(*(F.lit(x) for pair in GRADES.items() for x in pair)), F.upper(F.trim(grade))) * (to / 10))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))
