"""Runs of repeated words, found by probing a grid for each period.

A stretch of words has period p if words p apart are the same. One of three periods at least holds
two neighbouring points of any grid of step p, so for each p only the words at jp, (j + 1)p and
(j + 2)p are compared: n / p comparisons, n log n for all periods. The few grid points that pass
are probed at more places between, then extended to both sides by comparing arrays in chunks of
growing size. Inside a run that is already known, a grid point of a multiple of its period would
give that run again, so it is skipped.

Texts are taken together, the longest first, with a number of its own between any two, so that one
probe serves all texts that are long enough for the period.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from candlespark.llm.common import PIECE_BYTES, map_arrow, pieces, utf8

#: Words and periods that a run has at least.
MIN_WORDS, MIN_PERIODS = 24, 3
#: Bytes whose words are numbered in one pass.
BLOCK_BYTES = 4 * PIECE_BYTES
#: Grid points of one probe, if a period alone has fewer.
PROBES = 1 << 16
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def blank_blocks(raw: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    """``raw`` in stretches of about ``limit`` bytes that end before white space."""
    start = 0
    while start < len(raw):
        stop = start + limit
        while stop < len(raw):  # the next white space, or the end
            near = np.flatnonzero(_SPACE[raw[stop : stop + limit]])
            if len(near):
                stop += int(near[0])
                break
            stop += limit
        yield raw[start:stop]
        start = stop


def number_words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between white space of the texts ``raw[at[i]:at[i + 1]]``: (number of each word, first word of each text and their count, word of each number).

    Two words have one number exactly if they have the same bytes.
    """
    found, firsts, total = [], [np.zeros(1, np.int64)], 0
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True  # a text's end ends a word
    done = 0
    for block in blank_blocks(raw, BLOCK_BYTES):
        space = _SPACE[block]
        begins = ~space
        begins[1:] &= space[:-1] | edge[done + 1 : done + len(block)]
        start = np.flatnonzero(begins)
        letters = np.concatenate([[0], np.cumsum(~space)])
        offsets = np.append(letters[start], letters[-1])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(block[~space].tobytes())])
        found.append(words.dictionary_encode())
        inside = at[(at > done) & (at <= done + len(block))]
        firsts.append(total + np.searchsorted(start, inside - done))
        total += len(start)
        done += len(block)
    firsts.append(np.full(len(at) - sum(map(len, firsts)), total, np.int64))  # texts without bytes at the end
    first = np.concatenate(firsts)
    lead = int(np.searchsorted(at, 0, "right")) - 1  # empty texts in front
    first = np.concatenate([np.zeros(lead, np.int64), first])[: len(at)]
    if not found:
        return np.zeros(0, np.int32), first, pa.array([], pa.large_binary())
    together = pa.chunked_array(found).unify_dictionaries()
    ids = np.concatenate([c.indices.to_numpy() for c in together.chunks])
    return ids, first, together.chunk(0).dictionary


class _Runs:
    """The runs of an array so far, and for each place the longest that covers it."""

    def __init__(self, n: int) -> None:
        self.of = np.full(n, -1, np.int32)
        self.start, self.end, self.period = (np.zeros(64, np.int64) for _ in range(3))
        self.n, self.seen = 0, set()

    def add(self, s: int, e: int, p: int) -> None:
        if (s, e) in self.seen:  # with a divisor of p: the smallest period came first
            return
        self.seen.add((s, e))
        if self.n == len(self.start):
            self.start, self.end, self.period = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.end, self.period))
        self.start[self.n], self.end[self.n], self.period[self.n] = s, e, p
        over = self.of[s:e]
        shorter = (over < 0) | (self.end[over] - self.start[over] < e - s)
        over[shorter] = self.n
        self.n += 1

    def known(self, i: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Whether i and i + p lie in one run whose period divides p."""
        out = np.zeros(len(i), bool)
        if self.n:
            for r in (self.of[i], self.of[i + p]):
                out |= (r >= 0) & (p % np.maximum(1, self.period[r]) == 0) & (self.start[r] <= i) & (self.end[r] > i + p)
        return out


def _equal_to(w: np.ndarray, i: int, p: int, step: int, bound: int) -> int:
    """From i on in direction ``step``, the first place before ``bound`` whose word differs from that p further on."""
    size = 64
    while i != bound:
        stop = min(i + size, bound) if step > 0 else max(i - size, bound)
        a, b = (i, stop) if step > 0 else (stop + 1, i + 1)
        differ = w[a:b] != w[a + p : b + p]
        if differ.any():
            k = int(differ.argmax()) if step > 0 else len(differ) - 1 - int(differ[::-1].argmax())
            return a + k
        i, size = stop, min(2 * size, 1 << 16)
    return bound


def _survivors(w: np.ndarray, i: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Which of the grid points have the same words from i to i + p as p further on, as far as some more probes tell."""
    keep = np.arange(len(i))
    for eighth in (4, 2, 6, 1, 3, 5, 7):
        at = i[keep] + p[keep] * eighth // 8
        keep = keep[w[at] == w[at + p[keep]]]
    for low, high in ((0, 32), (32, 256)):
        if len(keep) < 64:
            break
        alive = np.ones(len(keep), bool)
        for a in range(0, len(keep), 4096):
            part = keep[a : a + 4096]
            at = i[part, None] + np.minimum(np.arange(low, high), p[part, None])
            alive[a : a + 4096] = (w[at] == w[at + p[part, None]]).all(1)
        keep = keep[alive]
    return keep


def runs_of(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows (text, start, length, period) of all runs of the texts ``ids[first[k]:first[k + 1]]``, ordered; starts count from a text's first word."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    order = order[size[order] >= MIN_WORDS]
    if not len(order):
        return np.zeros((0, 4), np.int64)
    ends = np.cumsum(size[order] + 1)
    begins = ends - size[order] - 1
    w = np.empty(int(ends[-1]), np.int64)
    for k, (text, b, e) in enumerate(zip(order, begins, ends)):
        w[b : e - 1] = ids[first[text] : first[text + 1]]
        w[e - 1] = -1 - k  # ends every stretch
    runs, longest = _Runs(len(w)), int(size[order[0]])
    need = size[order]

    def extend(i: np.ndarray, p: np.ndarray) -> None:
        fresh = ~runs.known(i, p)
        i, p = i[fresh], p[fresh]
        keep = _survivors(w, i, p)
        last, stop = 0, -1
        for x, q in zip(i[keep].tolist(), p[keep].tolist()):
            if q == last and x < stop or runs.known(np.array([x]), np.array([q]))[0]:
                continue
            stop = _equal_to(w, x, q, 1, len(w) - q)
            s, last = _equal_to(w, x, q, -1, -1) + 1, q
            if stop + q - s >= max(MIN_WORDS, MIN_PERIODS * q):
                runs.add(s, stop + q, q)

    p = 1
    while MIN_PERIODS * p <= longest:
        cut = int(ends[np.searchsorted(-need, -max(MIN_WORDS, MIN_PERIODS * p), "right") - 1])
        if cut >= PROBES * p // 16:
            grid = w[:cut:p]
            same = grid[1:] == grid[:-1]
            at = np.flatnonzero(same[:-1] & same[1:]) * p
            extend(at, np.full(len(at), p))
            p += 1
            continue
        many = max(1, min(longest // MIN_PERIODS + 1 - p, PROBES * p // cut))
        periods = np.arange(p, p + many)
        counts = np.maximum(0, (cut - 1) // periods - 1)
        own = np.repeat(periods, counts)
        at = (np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)) * own
        here = w[at]
        hit = np.flatnonzero(here == w[at + own])
        hit = hit[here[hit] == w[at[hit] + 2 * own[hit]]]
        extend(at[hit], own[hit])
        p += many
    start, end, period = (x[: runs.n] for x in (runs.start, runs.end, runs.period))
    where = np.searchsorted(begins, start, "right") - 1
    rows = np.stack([order[where], start - begins[where], end - start, period], 1)
    return rows[np.lexsort(rows.T[[3, 1, 0]])]


def _repeats(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which words lie in a run after its first period."""
    step = np.zeros(int(first[-1]) + 1, np.int64)
    at = first[rows[:, 0]] + rows[:, 1]
    np.add.at(step, at + rows[:, 3], 1)
    np.add.at(step, at + rows[:, 2], -1)
    return np.cumsum(step[:-1]) > 0


Rearrange = Callable[[object, int], np.ndarray | None]


def find_runs(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rearrange: Rearrange | None = None) -> DataFrame:
    """The kept columns, ``n_words``, ``runs`` (structs of start, length and period, by start, then period) and ``collapsed``, a text without its repeats.

    Words are what stands between ASCII white space, compared byte by byte and numbered from 0. A
    run has its smallest period, at least ``MIN_WORDS`` words and ``MIN_PERIODS`` periods, and no
    neighbouring word would extend it. ``collapsed`` holds the words, joined by one space, that lie in no
    run or in the first period of all theirs. ``rearrange``, called with the first kept column and the number of
    words, may give the places to take words from instead.

    A null or empty text has no words, no runs and an empty ``collapsed``. Rows are answered one
    by one: repeated rows and ids, null ids and an empty table do no harm. A kept column named like
    a result gives way to it; other columns are not read. A text of any length is one row's work:
    its words are numbered block by block, and some twenty bytes a word are held.
    """
    results = ("n_words", "runs", "collapsed")
    kept = [c for c in keep if c.lower() not in results]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        struct = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for batch in batches:
            for piece in pieces(batch, text):
                ids, first, words = number_words(*utf8(piece.column(text)))
                if rearrange is not None:
                    for k, key in enumerate(piece.column(keep[0]).to_pylist()):
                        places = rearrange(key, int(first[k + 1] - first[k]))
                        if places is not None:
                            ids[first[k] : first[k + 1]] = ids[first[k] : first[k + 1]][places]
                rows = runs_of(ids, first)
                stays = ~_repeats(rows, first)
                left = np.concatenate([[0], np.cumsum(stays)])[first]
                # 32-bit offsets suffice: a column of a batch has less than 2 GiB
                parts = pa.LargeListArray.from_arrays(pa.array(left), words.take(pa.array(ids[stays])))
                joined = pc.binary_join(parts, pa.scalar(b" ", pa.large_binary())).cast(pa.binary())
                collapsed = pa.StringArray.from_buffers(len(joined), *joined.buffers()[1:])
                bounds = np.searchsorted(rows[:, 0], np.arange(len(first)))
                spans = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T[1:]], fields=list(struct))
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), spans)
                arrays = [*(piece.column(c) for c in kept), pa.array(np.diff(first)), lists, collapsed]
                yield pa.RecordBatch.from_arrays(arrays, [*kept, *results])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*kept).schema) + "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return map_arrow(docs.select(*dict.fromkeys([*keep, text])), run, schema)
