"""Sums of doubles that are a function of their terms alone: whatever the order and the partitions, the same bits.

A term of ordinary size is cut into ``LIMBS`` integers of ``BITS`` bits, each with a fixed weight, and
integers are summed. The sum of the terms is thus exact; it is rounded once, at the end. Partial
sums may be added or subtracted, in Spark or in numpy. What ordinary size leaves out (below
2**-91, from 2**72 on, infinite, NaN) is summed in floating point beside it, in the order of the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Integers of a term, bits of each, and the exponent of the first one's weight.
LIMBS, BITS, TOP = 6, 36, 36
#: Terms of ordinary size: zero, or from the first to below the second of these. All their bits have a place.
LEAST, MOST = 2.0 ** (TOP - (LIMBS - 1) * BITS + 53), 2.0 ** (TOP + BITS)
NAMES = tuple(f"__v{k}" for k in range(LIMBS))
ODD, ANY = "__vx", "__vn"


def _ordinary(x: Column) -> Column:
    return (x == 0) | (F.abs(x) >= LEAST) & (F.abs(x) < MOST)


def with_limbs(df: DataFrame, column: str = "volume") -> DataFrame:
    """``df`` with the limbs of a double column, the rest of it and whether there is a value: sum these to sum it."""
    x = F.col(column)
    left = F.when(_ordinary(x), x).otherwise(F.lit(0.0)) * F.lit(2.0**-TOP)
    limbs = []
    for _ in range(LIMBS):
        limbs.append(left.cast("long"))
        left = left % F.lit(1.0) * F.lit(2.0**BITS)
    return df.select("*", *(c.alias(n) for c, n in zip(limbs, NAMES)), F.when(~_ordinary(x), x).alias(ODD), F.when(x.isNotNull(), 1).otherwise(0).cast("long").alias(ANY))


def live(df: DataFrame) -> list[str]:
    """Which of the columns that :func:`with_limbs` adds are anything but zero or null, in one aggregation; the count always is."""
    row = with_limbs(df).agg(*(F.max(F.col(n) != 0).alias(n) for n in NAMES), (F.count(ODD) > 0).alias(ODD)).first()
    return [*(n for n in (*NAMES, ODD) if row[n]), ANY]


def sums() -> list[Column]:
    """Aggregates of what :func:`with_limbs` adds, under the same names; they are merged in the same way."""
    return [F.sum(n).alias(n) for n in (*NAMES, ODD, ANY)]


def with_total(df: DataFrame, name: str = "volume") -> DataFrame:
    """``df`` with the rounded sum in place of the summed limbs, null where nothing was summed."""
    carry, digits = F.lit(0).cast("long"), []
    for n in reversed(NAMES):
        whole = F.col(n) + carry
        carry = F.shiftright(whole, BITS)
        digits.append(whole.bitwiseAND(F.lit((1 << BITS) - 1)))
    digits = [carry, *reversed(digits)]  # all but the first of one sign, so each sum has one set of digits
    names = [f"__d{k}" for k in range(LIMBS + 1)]
    kept = [c for c in df.columns if c not in (*NAMES, ODD, ANY, name)]
    spread = df.select(*kept, ODD, ANY, *(d.alias(n) for d, n in zip(digits, names)))
    total, lost = F.lit(0.0), F.lit(0.0)
    for k, n in enumerate(names):
        term = F.col(n).cast("double") * F.lit(2.0 ** (TOP + (1 - k) * BITS))
        after = total + term
        lost = lost + (term - (after - total))
        total = after
    return spread.select(*kept, F.when(F.col(ANY) > 0, total + lost + F.coalesce(F.col(ODD), F.lit(0.0))).alias(name))


def limbs_of(x):
    """The limbs of an array as integers, a row each, and which terms are not of ordinary size."""
    import numpy as np

    size = np.abs(x)
    ordinary = (x == 0) | (size >= LEAST) & (size < MOST)
    left = np.where(ordinary, x, 0.0) * 2.0**-TOP
    out = np.zeros((LIMBS, len(x)), np.int64)
    for k in range(LIMBS):
        whole = np.trunc(left)
        out[k] = whole
        left = (left - whole) * 2.0**BITS
        if not left.any():
            break
    return out, ~ordinary


def totals(limbs):
    """The rounded sums of ``LIMBS`` arrays of summed limbs, as :func:`with_total` rounds them; None stands for zeros."""
    import numpy as np

    carry, digits = None, []
    for row in reversed(limbs):
        whole = carry if row is None else row if carry is None else row + carry
        carry = None if whole is None else whole >> BITS
        digits.append(None if whole is None else whole & ((1 << BITS) - 1))
    total = lost = None
    for k, row in enumerate([carry, *reversed(digits)]):
        if row is None:
            continue
        term = row * 2.0 ** (TOP + (1 - k) * BITS)
        if total is None:
            total, lost = term, np.zeros(len(term))
            continue
        after = total + term
        lost += term - (after - total)
        total = after
    return None if total is None else total + lost
