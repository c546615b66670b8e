"""What the tasks of :mod:`sweep` and :mod:`events` do with a chunk's candles, in numpy.

These functions travel with the tasks by value, so workers need not have this package.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

from candlespark.operators import exact

for _module in (__name__, exact.__name__):
    cloudpickle.register_pickle_by_value(sys.modules[_module])

LEAST, MOST = -(2**63), 2**63 - 1
PRICES = ("open", "high", "low", "close", "volume")


def ordered(x):
    """Doubles as integers of the same order, NaN last."""
    import numpy as np

    bits = np.where(np.isnan(x), np.nan, x).view(np.int64)
    return bits ^ ((bits >> 63) & MOST)


def plain(x):
    """The doubles that :func:`ordered` made integers of."""
    import numpy as np

    return (x ^ ((x >> 63) & MOST)).view(np.float64)


class Slots:
    """A chunk's candles by open time, one slot for each, in order.

    ``o``; ``open`` and ``close`` of the first published candle, each a (value, is there) pair; ``high`` and ``low`` as
    ordered integers; ``limbs`` of the volume (None for zeros) and ``odd``, what they leave out; ``counts`` of candles, traded
    candles and volumes. Without row numbers candles of equal open time are in the order of their values: nulls first, NaN last.
    """

    def __init__(self, rows, summed: bool) -> None:
        import numpy as np

        number = lambda c: rows[c].to_numpy()
        there = {c: rows[c].is_valid().to_numpy() for c in PRICES if c in rows.column_names}
        value = {c: number(c) for c in there}
        o = number("o")
        if summed:
            order = np.argsort(o, kind="stable")
        else:
            order = np.lexsort((number("r"), o))
            r = number("r")[order]
            same = (o[order][1:] == o[order][:-1]) & (r[1:] == r[:-1])
            if same.any():
                values = [k for c in reversed(PRICES) for k in (value[c], there[c])]
                order = np.lexsort((*values, number("r"), o))
        o = o[order]
        begin = np.flatnonzero(np.append(True, o[1:] != o[:-1])) if len(o) else np.zeros(0, np.int64)
        single = len(begin) == len(o)
        join = lambda step, x: x[order] if single else step.reduceat(x[order], begin)
        first = order[begin]
        self.o = o[begin]
        self.open, self.close = ((value[c][first], there[c][first]) for c in ("open", "close"))
        self.high = join(np.maximum, np.where(there["high"], ordered(value["high"]), LEAST))
        self.low = join(np.minimum, np.where(there["low"], ordered(value["low"]), MOST))
        if summed:
            limbs = [number(n) for n in exact.NAMES]
            odd = np.where(rows[exact.ODD].is_valid().to_numpy(), number(exact.ODD), 0.0)
            counts = [number(c) for c in ("n", "busy", exact.ANY)]
        else:
            some = there["volume"]
            volume = np.where(some, value["volume"], 0.0)
            limbs, extra = exact.limbs_of(volume)
            odd = np.where(extra, volume, 0.0)
            counts = [np.ones(len(o), np.int64), (some & (np.nan_to_num(volume, nan=0.0) > 0)).astype(np.int64), some.astype(np.int64)]
        self.limbs = [join(np.add, x) if x.any() else None for x in limbs]
        self.odd = join(np.add, odd) if odd.any() else None
        self.counts = [join(np.add, x) for x in counts]


def running(x):
    """Sums of what comes before each place, and of all."""
    import numpy as np

    return None if x is None else np.concatenate([np.zeros(1, x.dtype), np.cumsum(x)])


def between(sums, low, high):
    """Sums from ``low`` to before ``high``; of integers, so that a difference is exact."""
    return None if sums is None else sums[high] - sums[low]


def range_values(x, low, high, step, empty):
    """``step`` of x[low:high] for many ranges, from values of blocks that double: n log(longest range), no value is taken back.

    Blocks may overlap, so this suits minima and maxima.
    """
    import numpy as np

    size = high - low
    level = np.frexp(np.maximum(size, 1).astype(np.float64))[1] - 1
    out = np.full(len(low), empty, x.dtype)
    block, width = x, 1
    for k in range(int(level.max(initial=-1)) + 1):
        pick = np.flatnonzero((level == k) & (size > 0))
        if len(pick):
            out[pick] = step(block[low[pick]], block[high[pick] - width])
        block = step(block[:-width], block[width:]) if len(block) > width else block[:0]
        width *= 2
    return out


def range_sums(x, low, high):
    """Floating-point sums of x[low:high], from blocks that double and do not overlap; nothing is subtracted."""
    import numpy as np

    out, at, size = np.zeros(len(low)), low.copy(), high - low
    block, width = x, 1
    while width <= int(size.max(initial=0)):
        pick = np.flatnonzero(size & width)
        out[pick] += block[at[pick]]
        at[pick] += width
        block = block[:-width] + block[width:] if len(block) > width else block[:0]
        width *= 2
    return out


def emitted(k, ticks, keys, kinds, found, cadence, names):
    """A chunk's answer for one schedule. ``found``: (open, high, low, close, volume) as (value, is there) pairs, counts of candles and of traded ones."""
    import numpy as np
    import pyarrow as pa

    prices, many, traded = found
    size = len(ticks)
    arrays = [pa.array(np.full(size, k, np.int32)), pa.array(ticks), *(pa.array(x, mask=~ok) for x, ok in prices), pa.array(many), pa.array(traded * cadence)]
    return pa.table([*(pa.array([v] * size, kind) for v, kind in zip(keys, kinds)), *arrays], names)


def nothing(table, keys, names):
    """An answer without rows."""
    import pyarrow as pa

    kinds = [pa.int32(), pa.int64(), *[pa.float64()] * 5, pa.int64(), pa.int64()]
    return pa.table([*(pa.array([], table.schema.field(k).type) for k in keys), *(pa.array([], t) for t in kinds)], names)
