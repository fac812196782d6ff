"""Column helpers with the rounding, trimming and splitting rules of the reading library."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in Python's patterns: what ``SPACE`` is in those of the JVM.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: White space, Unicode spaces included.
SPACE = r"(?U)[\s ﻿]"


def round_half_up(x: Column) -> Column:
    """Nearest integer, halves toward plus infinity."""
    return F.floor(x + F.lit(0.5)).cast("long")


def trimmed(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, rf"^{SPACE}+", ""), rf"{SPACE}+$", "")


def split_words(s: Column) -> Column:
    """Words between white space; empty for null and blank text."""
    return F.filter(F.split(F.coalesce(s, F.lit("")), rf"{SPACE}+"), lambda w: w != "")


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def slices(batch, rows: int = 256, size: int = 8 << 20):
    """Cut an Arrow batch so that a slice has at most ``rows`` rows and about ``size`` bytes, one row at least."""
    n, at = batch.num_rows, 0
    step = int(max(1, min(rows, size // max(1, batch.nbytes // n)))) if n else 1
    while at < n:
        yield batch.slice(at, step)
        at += step
