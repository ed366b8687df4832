"""Checksum predicates of the regulated identifiers, as expressions over digit arrays."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published weights.
TFN_8, TFN_9 = [10, 7, 8, 4, 6, 3, 5, 1], [1, 4, 3, 7, 5, 8, 6, 9, 10]
ABN = [10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19]
ACN = [8, 7, 6, 5, 4, 3, 2, 1]
MEDICARE = [1, 3, 7, 9, 1, 3, 7, 9]


_OTHER_DIGITS = [chr(c) for c in range(128, 0x20000) if unicodedata.category(chr(c)) == "Nd"]


def digits(value: Column) -> Column:
    """The digits of a value, of any script, as ASCII; null has none."""
    plain = F.translate(F.coalesce(value, F.lit("")), "".join(_OTHER_DIGITS), "".join(str(unicodedata.digit(c)) for c in _OTHER_DIGITS))
    return F.regexp_replace(plain, "[^0-9]", "")


def digit(d: Column, place: int) -> Column:
    """The digit at a place (from 1) as a number."""
    return F.substring(d, place, 1).try_cast("int")


def weighted(d: Column, weights: list[int]) -> Column:
    total = F.lit(0)
    for k, w in enumerate(weights, 1):
        total = total + F.coalesce(digit(d, k), F.lit(0)) * w
    return total


def _some(d: Column) -> Column:
    """Not all zeros."""
    return d.rlike("[1-9]")


def tfn(value: Column) -> Column:
    d = digits(value)
    return _some(d) & F.when(F.length(d) == 9, weighted(d, TFN_9) % 11 == 0).when(F.length(d) == 8, weighted(d, TFN_8) % 11 == 0).otherwise(False)


def abn(value: Column) -> Column:
    d = digits(value)
    return _some(d) & (F.length(d) == 11) & ((weighted(d, ABN) - ABN[0]) % 89 == 0)


def acn(value: Column) -> Column:
    d = digits(value)
    return _some(d) & (F.length(d) == 9) & ((10 - weighted(d, ACN) % 10) % 10 == F.coalesce(digit(d, 9), F.lit(-1)))


def medicare(value: Column) -> Column:
    d = digits(value)
    return _some(d) & F.length(d).isin(10, 11) & (weighted(d, MEDICARE) % 10 == F.coalesce(digit(d, 9), F.lit(-1)))


def bsb(value: Column) -> Column:
    return F.length(digits(value)) == 6


def passed(category: Column, value: Column) -> Column:
    """Whether the category's check holds; null where it has none."""
    out = F.when(category == "tfn", tfn(value)).when(category == "abn", abn(value)).when(category == "acn", acn(value))
    return out.when(category == "medicare", medicare(value)).when(category == "bsb_account", bsb(value))


def first_passing(value: Column) -> Column:
    """The first category whose checksum the value passes."""
    return F.when(abn(value), "abn").when(medicare(value), "medicare").when(tfn(value), "tfn").when(acn(value), "acn").when(bsb(value), "bsb_account")
