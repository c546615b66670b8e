"""Windows of many schedules over candles on their grid, in one shuffle whose cost does not grow with W.

Time is cut into chunks. A chunk's task gets its candles and, as a halo, those of one longest
window after it, so a candle is sent 1.5 times at most. There the candles become arrays with a
slot for each cadence, and every window is the suffix of one block of W seconds and the prefix of
the next: running maxima and minima inside blocks answer all ticks of the chunk at once, in numpy
over Arrow. Volumes are exact sums of integers (:mod:`exact`), so they depend neither on chunks nor on ladders.

The same answers come from ``compute_windows(plan="blocks")`` in built-in functions alone, which
sorts 20 million rows twice where this sorts none; windows of more than ``MAX_SLOTS`` candles,
whose chunks would not fit a task, take that way.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlespark.operators import exact, kernels
from candlespark.operators.grid import ResolvedSchedule

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Slots of a chunk, if twice the longest window has fewer, and those of the longest window.
CHUNK_SLOTS, MAX_SLOTS = 1 << 16, 1 << 20

SCHEMA = "k int, t long, open double, high double, low double, close double, volume double, src_count long, traded_seconds long"
FIELDS = [c.split()[0] for c in SCHEMA.split(", ")]


def chunk_ticks(chunk: int, width: int, window: int, emit: int, first: int, stop: int):
    """The ticks from ``first`` to before ``stop`` whose windows begin in a chunk."""
    import numpy as np

    low = max(first, chunk + window + (first - chunk - window) % emit)
    return np.arange(low, min(stop, chunk + window + width), emit, dtype=np.int64)


def _kernel(schedules: list[tuple[int, int, int, int, int]], cadence: int, width: int, keys: list[str], summed: bool, unit: int):
    """What a chunk's task runs."""
    names, ticks_of = [*keys, *FIELDS], chunk_ticks

    def answer(table):
        import numpy as np
        import pyarrow as pa

        chunk = table["c"][0].as_py()
        own_keys, kinds = [table[k][0].as_py() for k in keys], [table.schema.field(k).type for k in keys]
        s = kernels.Slots(table.filter(table["o"].is_valid()), summed)
        slot = (s.o - chunk) // cadence
        slots = width // cadence + max((w for _, w, *_ in schedules), default=0) // cadence

        def spread(x, empty):
            """An array with a value for each place of the grid."""
            out = np.full(slots, empty, x.dtype)
            out[slot] = x
            return out

        count, busy, volumes = (kernels.running(spread(x, 0)) for x in s.counts)
        limbs = [None if x is None else kernels.running(spread(x, 0)) for x in s.limbs]
        odd = None if s.odd is None else spread(s.odd, 0.0)
        high, low = spread(s.high, kernels.LEAST), spread(s.low, kernels.MOST)
        # of each place, the slot of the next candle and of the last one so far
        here = np.zeros(slots + 1, np.int64)
        here[slot + 1] = 1
        before = np.cumsum(here)
        found = []
        for k, w, emit, first, stop in schedules:
            n = w // cadence
            ticks = ticks_of(chunk, width, w, emit, first, stop)
            if not len(ticks):
                continue
            q = (ticks - w - chunk) // cadence
            end = q + n
            pad = -slots % n

            def halves(x, empty, step):
                """From each place to the end of its block, and from the block's start to each place."""
                blocks = np.concatenate([x, np.full(pad, empty, x.dtype)]).reshape(-1, n)
                return step.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()[q], step.accumulate(blocks, axis=1).ravel()[end - 1]

            top, bottom = np.maximum(*halves(high, kernels.LEAST, np.maximum)), np.minimum(*halves(low, kernels.MOST, np.minimum))
            many, traded, some = (kernels.between(x, q, end) for x in (count, busy, volumes))
            volume = exact.totals([kernels.between(x, q, end) for x in limbs])
            volume = np.zeros(len(ticks)) if volume is None else volume
            if odd is not None:
                old, new = halves(odd, 0.0, np.add)
                volume = volume + np.where(q % n == 0, old, old + new)
            full = many > 0
            i, j = np.where(full, before[q], 0), np.where(full, before[end] - 1, 0)
            pick = lambda pair, x: (pair[0][x], full & pair[1][x]) if len(slot) else (np.zeros(len(x)), full)
            prices = [pick(s.open, i), (kernels.plain(top), top != kernels.LEAST), (kernels.plain(bottom), bottom != kernels.MOST), pick(s.close, j), (volume, some > 0)]
            found.append(kernels.emitted(k, ticks, own_keys, kinds, (prices, many, traded), unit, names))
        return pa.concat_tables(found) if found else kernels.nothing(table, keys, names)

    return answer


def in_chunks(candles: DataFrame, schedules: list[ResolvedSchedule], ranges: list[tuple[int, int]], keys: list[str], width: int, kernel) -> DataFrame:
    """``kernel`` over each chunk of ``width`` seconds, with the candles of the chunk and of one longest window after it."""
    spark, phase = candles.sparkSession, schedules[0].phase
    longest = max(s.window for s in schedules)
    low, high = min(a - s.window for s, (a, _) in zip(schedules, ranges)), max(b - s.window for s, (_, b) in zip(schedules, ranges))
    own = F.col("o") - F.pmod(F.col("o") - F.lit(phase), F.lit(width))
    both = F.when(F.col("o") < own + F.lit(longest), F.array(own, own - F.lit(width))).otherwise(F.array(own))
    # candles of no window are not read: the predicate reaches the scan
    rows = candles.where((F.col("o") >= low) & (F.col("o") < high + longest)).select("*", F.explode(both).alias("c"))
    first = low - (low - phase) % width
    starts = spark.range(first, max(first, high), width).select(F.col("id").alias("c"))  # so that chunks without candles have ticks too
    if keys:
        stretch = F.sequence(F.lit(first).cast("long"), F.lit(max(first, high - 1)).cast("long"), F.lit(width).cast("long"))
        starts = candles.select(*keys).distinct().select(*keys, F.explode(stretch).alias("c"))
    rows = rows.where((F.col("c") >= first) & (F.col("c") < max(first, high))).unionByName(starts, allowMissingColumns=True)
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in candles.select(*keys).schema)
    return rows.groupBy(*keys, "c").applyInArrow(kernel, kinds + SCHEMA)


def plain_schedules(schedules: list[ResolvedSchedule], ranges: list[tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(number, window, emit, first tick, end) of each."""
    return [(k, s.window, s.emit, s.first_tick_at_or_after(a), b) for k, (s, (a, b)) in enumerate(zip(schedules, ranges))]


def sweep(candles: DataFrame, schedules: list[ResolvedSchedule], ranges: list[tuple[int, int]], keys: list[str], summed: bool = False, unit: int | None = None) -> DataFrame:
    """A row for every tick of every schedule in its range: ``k`` (the schedule's number), ``t``, prices, volume, src_count, traded_seconds.

    Candles (columns o, r and prices) must lie on the grid of the schedules, which share their source. ``summed``: rows are
    many candles each, with counts and limbs; ``unit`` is then the seconds of one.
    """
    d, width = schedules[0].cadence, max(CHUNK_SLOTS * schedules[0].cadence, 2 * max(s.window for s in schedules))
    return in_chunks(candles, schedules, ranges, keys, width, _kernel(plain_schedules(schedules, ranges), d, width, keys, summed, unit or d))
