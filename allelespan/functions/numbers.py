"""Tolerant text-to-number casts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The catalogue's own marks for "not reported" and "not significant".
NOT_REPORTED = ("NR", "NS")


def to_double(text: Column) -> Column:
    """Number, or NULL for blank, ``NR``, ``NS`` and anything that is not a number.

    The JVM also takes Java literals such as ``1d``; those are refused here.
    """
    java_literal = text.rlike(r"[0-9.][dDfF]\s*$")
    return F.when(~text.isin(*NOT_REPORTED) & ~java_literal, text.try_cast("double"))


def to_long(text: Column) -> Column:
    """Whole number or NULL."""
    return text.try_cast("bigint")


def blank_to_null(text: Column) -> Column:
    """Trimmed text, NULL when nothing is left."""
    return F.nullif(F.trim(text), F.lit(""))
