"""Column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once per row; a plain expression would repeat it at every use."""
    return F.transform(F.array(value), body)[0]
