"""Bag operations by instant. Names come from the left; types must agree one by one."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..lang.tokens import LanguageError


def union(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.unionAll(_named(left, right))


def intersect(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.intersectAll(_named(left, right))


def except_(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.exceptAll(_named(left, right))


OPERATIONS = {"UNION": union, "INTERSECT": intersect, "EXCEPT": except_}


def _named(left: DataFrame, right: DataFrame) -> DataFrame:
    a, b = ([t for _, t in x.dtypes] for x in (left, right))
    if a != b:
        raise LanguageError(f"bag operands differ in types: {a} and {b}")
    return right.toDF(*left.columns)
