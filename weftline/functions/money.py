"""Money columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _not_lost(result: Column, given: Column, message: str) -> Column:
    """``result``, or an error where it is null although ``given`` holds; the same with ANSI mode on or off."""
    return F.when(result.isNull() & given, F.raise_error(F.lit(message))).otherwise(result)


def money(name: str) -> Column:
    """Column ``name``, a double, as an exact amount with two decimals.

    The tables store amounts as doubles. Double sums depend on the order in which
    tasks finish; decimal sums do not. Further decimals are rounded half up, on the shortest decimal
    that stands for the double: 1.005 is 1.01. Null stays null. NaN, infinity and amounts of
    10**16 or more raise an error.
    """
    value = F.col(name)
    return _not_lost(value.try_cast("decimal(18,2)"), value.isNotNull(), f"{name} holds a value that is no amount")


def exact_product(a: Column, b: Column) -> Column:
    """``a * b``, null only if a or b is; an error if the product of decimals overflows."""
    return _not_lost(a * b, a.isNotNull() & b.isNotNull(), "a product of amounts overflows")


def exact_sum(amount: Column) -> Column:
    """Sum of the amounts that aren't null, null without any; an error if it overflows."""
    return _not_lost(F.sum(amount), F.count(amount) > 0, "a sum of amounts overflows")
