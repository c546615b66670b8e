"""Windows over candles that lie off their grid, in one shuffle whose cost does not grow with W.

Time is cut into the chunks of :mod:`sweep`, each with a halo of one longest window. In a chunk candles
are sorted by open time, and two binary searches a tick find the stretch that its window holds: open and
close stand at its ends, counts and volumes are differences of running integers, highs and lows come from
blocks that double in length. A slot is a second, so however many candles open in a chunk, at most its seconds are held
once candles of equal open times were brought together.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame

from candlespark.operators import exact, kernels
from candlespark.operators.grid import ResolvedSchedule
from candlespark.operators.sweep import FIELDS, chunk_ticks, in_chunks, plain_schedules

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Seconds of a chunk, if twice the longest window has fewer, and those of the longest window.
CHUNK_SECONDS, MAX_SECONDS = 1 << 20, 1 << 22


def _kernel(schedules: list[tuple[int, int, int, int, int]], cadence: int, width: int, keys: list[str], summed: bool):
    names, ticks_of = [*keys, *FIELDS], chunk_ticks

    def answer(table):
        import numpy as np
        import pyarrow as pa

        chunk = table["c"][0].as_py()
        own_keys, kinds = [table[k][0].as_py() for k in keys], [table.schema.field(k).type for k in keys]
        s = kernels.Slots(table.filter(table["o"].is_valid()), summed)
        count, busy, volumes = map(kernels.running, s.counts)
        limbs = [kernels.running(x) for x in s.limbs]
        found = []
        for k, w, emit, first, stop in schedules:
            ticks = ticks_of(chunk, width, w, emit, first, stop)
            if not len(ticks):
                continue
            low, high = np.searchsorted(s.o, ticks - w, "left"), np.searchsorted(s.o, ticks - cadence, "right")
            many, traded, some = (kernels.between(x, low, high) for x in (count, busy, volumes))
            volume = exact.totals([kernels.between(x, low, high) for x in limbs])
            volume = np.zeros(len(ticks)) if volume is None else volume
            if s.odd is not None:
                volume = volume + kernels.range_sums(s.odd, low, high)
            top = kernels.range_values(s.high, low, high, np.maximum, kernels.LEAST)
            bottom = kernels.range_values(s.low, low, high, np.minimum, kernels.MOST)
            full = many > 0
            i, j = np.where(full, low, 0), np.where(full, high - 1, 0)
            pick = lambda pair, x: (pair[0][x], full & pair[1][x]) if len(s.o) else (np.zeros(len(x)), full)
            prices = [pick(s.open, i), (kernels.plain(top), top != kernels.LEAST), (kernels.plain(bottom), bottom != kernels.MOST), pick(s.close, j), (volume, some > 0)]
            found.append(kernels.emitted(k, ticks, own_keys, kinds, (prices, many, traded), cadence, names))
        return pa.concat_tables(found) if found else kernels.nothing(table, keys, names)

    return answer


def search(candles: DataFrame, schedules: list[ResolvedSchedule], ranges: list[tuple[int, int]], keys: list[str], summed: bool = False) -> DataFrame:
    """What :func:`sweep` gives, for candles anywhere in time."""
    d, width = schedules[0].cadence, max(CHUNK_SECONDS, 2 * max(s.window for s in schedules))
    return in_chunks(candles, schedules, ranges, keys, width, _kernel(plain_schedules(schedules, ranges), d, width, keys, summed))
