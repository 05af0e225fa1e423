"""Scalar functions of the query language as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_div(a: Column, b: Column) -> Column:
    """Integer division that rounds down for all signs; division by zero is an error."""
    rest = F.pmod(a, F.abs(b))  # never negative, so a - rest is a multiple of b
    whole = ((a - rest).cast("decimal(20,0)") / b.cast("decimal(20,0)")).cast("long")
    return F.when((b < 0) & (rest != 0), whole - 1).otherwise(whole)


def compare(op: str, a: Column, b: Column) -> Column:
    return {"=": a.__eq__, "<>": a.__ne__, "<": a.__lt__, "<=": a.__le__, ">": a.__gt__, ">=": a.__ge__}[op](b)
