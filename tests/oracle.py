"""Plain-Python windows: every candle against every tick."""

from __future__ import annotations

import math
import random

FIELDS = ("timestamp", "open", "high", "low", "close", "volume")


def candles(seed: int, d: int, slots: int, start: int, drop=(), untraded=()) -> list[tuple]:
    rng = random.Random(seed)
    out = []
    for k in range(slots):
        o = 20_000 + rng.randrange(-2000, 2000) * 0.25
        c = o + rng.randrange(-40, 40) * 0.25
        h, low = max(o, c) + rng.randrange(40) * 0.25, min(o, c) - rng.randrange(40) * 0.25
        v = rng.randrange(400) * 0.25
        if k not in drop:
            out.append((start + k * d, o, h, low, c, 0.0 if k in untraded else v))
    return out


def windows(rows: list[tuple], d: int, w: int, e: int, a: int, start: int, end: int) -> list[tuple]:
    out = []
    t = start + (a - start) % e
    while t < end:
        inside = [r for r in rows if r[0] >= t - w and r[0] + d <= t]
        if inside:
            first, last = inside[0], inside[0]
            for r in inside[1:]:
                first = r if r[0] < first[0] else first
                last = r if r[0] > last[0] else last
            prices = (first[1], max(r[2] for r in inside), min(r[3] for r in inside), last[4], math.fsum(r[5] for r in inside))
        else:
            prices = (None,) * 5
        out.append((t - w, t, *prices, len(inside), len(inside) * d, d * sum(r[5] > 0 for r in inside)))
        t += e
    return out
