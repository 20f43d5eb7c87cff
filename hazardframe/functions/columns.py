"""Column expressions for times, intervals and steps."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed value: prime modulus of the counter-based hash.
HASH_PRIME = 2147483647


def at_risk(start: str | Column, stop: str | Column, t) -> Column:
    """A row is at risk at ``t`` if it entered strictly before and left no earlier."""
    start, stop = (F.col(c) if isinstance(c, str) else c for c in (start, stop))
    return (start < t) & (t <= stop)


def window_exposure(start: Column, stop: Column, lo, hi) -> Column:
    """Time that a row spends in ``(lo, hi]``."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    return F.greatest(F.lit(0.0), F.least(stop, as_column(hi)) - F.greatest(start, as_column(lo)))


def days_since(ts: Column, origin: str) -> Column:
    """Whole days from ``origin`` as a double clock; for zone-free timestamps."""
    return F.datediff(ts, F.lit(origin).cast("timestamp_ntz")).cast("double")


def hash31(*parts) -> Column:
    """A reproducible number below 2^31 - 1 of integers, by arithmetic that any SQL engine repeats.

    All products stay below 2^63, so nothing overflows under ANSI rules.
    """
    p = F.lit(HASH_PRIME).cast("long")
    x = F.lit(7919).cast("long")
    for part in parts:
        part = part if isinstance(part, Column) else F.lit(part)
        x = (x * 48271 + F.pmod(part.cast("long"), p) + 1) % p
        x = x * (x % 65536 + 1) % p
    return x


def hash31_sql(*parts: str) -> str:
    """The same number in SQL text."""
    x = "cast(7919 as bigint)"
    for part in parts:
        x = f"((({x}) * 48271 + (({part}) % {HASH_PRIME}) + 1) % {HASH_PRIME})"
        x = f"(({x}) * (({x}) % 65536 + 1) % {HASH_PRIME})"
    return x


def running(by: list[str], *order) -> Window:
    """All rows of the group up to the current one."""
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


#: Sorted numbers beyond which a lookup is a binary search in Arrow batches and not an expression.
LISTED = 4096


def steps_below(ascending: list[float], value: Column, inclusive: bool = False) -> Column:
    """How many of the sorted numbers lie below ``value`` (or at it); 0 for null.

    Up to ``LISTED`` numbers are an expression that takes about twice their root's
    length of steps; more are searched in Arrow batches.
    """
    if len(ascending) > LISTED:
        return F.when(value.isNotNull(), _searched(np.asarray(ascending, dtype=float), inclusive)(value.cast("double"))).otherwise(0)
    step = math.isqrt(len(ascending)) + 1
    chunks = [ascending[i : i + step] for i in range(0, len(ascending), step)] or [[math.inf]]
    listed = lambda xs: F.array(*(F.lit(float(x)) for x in xs))
    under = (lambda b: b <= value) if inclusive else (lambda b: b < value)
    full = F.size(F.filter(listed([c[0] for c in chunks]), under))
    inside = F.size(F.filter(F.element_at(F.array(*map(listed, chunks)), F.greatest(full, F.lit(1))), under))
    return F.when(full == 0, F.lit(0)).otherwise((full - 1) * step + inside)


def _searched(ascending: np.ndarray, inclusive: bool):
    def search(values: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(ascending, values.to_numpy(float), side="right" if inclusive else "left").astype(np.int32))

    return F.pandas_udf(search, "int")


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles rounded, so that the order of summation does not show."""
    return df.select(*(F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))
