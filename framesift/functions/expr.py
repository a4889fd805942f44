"""Small helpers for column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once a row even where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)
