"""Scalar functions: native column expressions, and Arrow scanners where text has to be read in sequence."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value written and computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)
