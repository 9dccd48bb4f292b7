"""Digit checksums as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The multiplication table of the dihedral group D5 and the
# position permutations of the Verhoeff scheme, flattened row by row.
VERHOEFF_D = [
    0, 1, 2, 3, 4, 5, 6, 7, 8, 9,
    1, 2, 3, 4, 0, 6, 7, 8, 9, 5,
    2, 3, 4, 0, 1, 7, 8, 9, 5, 6,
    3, 4, 0, 1, 2, 8, 9, 5, 6, 7,
    4, 0, 1, 2, 3, 9, 5, 6, 7, 8,
    5, 9, 8, 7, 6, 0, 4, 3, 2, 1,
    6, 5, 9, 8, 7, 1, 0, 4, 3, 2,
    7, 6, 5, 9, 8, 2, 1, 0, 4, 3,
    8, 7, 6, 5, 9, 3, 2, 1, 0, 4,
    9, 8, 7, 6, 5, 4, 3, 2, 1, 0,
]
VERHOEFF_P = [
    0, 1, 2, 3, 4, 5, 6, 7, 8, 9,
    1, 5, 7, 6, 2, 8, 3, 0, 9, 4,
    5, 8, 0, 3, 7, 9, 6, 1, 4, 2,
    8, 9, 1, 6, 0, 4, 3, 5, 2, 7,
    9, 4, 5, 3, 1, 2, 6, 8, 7, 0,
    4, 2, 8, 6, 5, 7, 3, 9, 0, 1,
    2, 7, 9, 3, 8, 0, 6, 4, 1, 5,
    7, 0, 4, 6, 9, 1, 3, 2, 5, 8,
]


def digits(text: Column) -> Column:
    """The ASCII digits of a text."""
    return F.regexp_replace(text, "[^0-9]", "")


def _from_right(d: Column) -> Column:
    """A digit string's digits from the right; empty for an empty string."""
    return F.filter(F.transform(F.split(F.reverse(d), ""), lambda c: c.try_cast("int")), lambda c: c.isNotNull())


def luhn(d: Column) -> Column:
    """Whether a digit string passes the Luhn check; false when empty."""
    doubled = F.transform(_from_right(d), lambda c, i: F.when(i % 2 == 0, c).when(c > 4, 2 * c - 9).otherwise(2 * c))
    return (F.length(d) > 0) & (F.aggregate(doubled, F.lit(0), lambda a, c: a + c) % 10 == 0)


def verhoeff(d: Column) -> Column:
    """Whether a digit string passes the Verhoeff check; false when empty."""
    table_d, table_p = F.array(*map(F.lit, VERHOEFF_D)), F.array(*map(F.lit, VERHOEFF_P))
    permuted = F.transform(_from_right(d), lambda c, i: F.get(table_p, (i % 8) * 10 + c))
    return (F.length(d) > 0) & (F.aggregate(permuted, F.lit(0), lambda a, c: F.get(table_d, a * 10 + c)) == 0)
