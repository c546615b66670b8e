"""Document fingerprints by context-triggered piecewise hashing, and their likeness.

A hash rolls over the last ``CONTEXT`` bytes of a text. Where it ends in k zero bits or more, a chunk of
block size 2**k ends: boundaries depend on what stands there, not on where it stands, so an edit
changes the chunks that it touches and hardly any others. A chunk has between a quarter of the block size
and four times it (``SPREAD``), so that a text of one repeated line has chunks too, and not too many. A text's block size is the
smallest of at least 2 that, like the next one, cuts it into at most ``CHUNKS`` chunks; a signature has 12
bits of each chunk's hash, as two letters. A fingerprint is ``k:signature:signature at k + 1``.

Fingerprints compare where they share a block size: at k if both have it, else at the one's k and the
other's k + 1; others have likeness 0. Likeness is 1 less the edit distance over the longer
signature's chunks. Distances of many pairs are computed at once, a pair's state in two
words of 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlespark.llm.common import PIECE_BYTES, map_arrow, mix64, pieces, shared_path, utf8

#: Bytes that a boundary depends on, chunks of a signature at most, and the smallest exponent of a block size.
CONTEXT, CHUNKS, LEAST_LEVEL = 7, 64, 1
#: Times that a chunk may be shorter or longer than its block size.
SPREAD = 4
#: Odd bases of the two hashes, modulo 2**64.
ROLL, BASE = 0x2545F4914F6CDD1D, 0x9E3779B97F4A7C15
LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_VALUE = np.zeros(256, np.int16)
_VALUE[LETTERS] = np.arange(64)


class Signatures(NamedTuple):
    """Of many texts: exponent of the block size, and for it and the next one the chunks' hashes (-1 beyond the last) and their number."""

    level: np.ndarray
    codes: tuple[np.ndarray, np.ndarray]
    sizes: tuple[np.ndarray, np.ndarray]

    def rows(self, which: np.ndarray | slice) -> Signatures:
        return Signatures(self.level[which], tuple(c[which] for c in self.codes), tuple(s[which] for s in self.sizes))


def _power(base: int, exponent: np.ndarray) -> np.ndarray:
    """base ** exponent modulo 2**64."""
    out, square = np.ones(len(exponent), np.uint64), base
    for bit in range(int(exponent.max(initial=0)).bit_length()):
        out = np.where(exponent >> bit & 1 == 1, out * np.uint64(square), out)
        square = square * square % (1 << 64)
    return out


def boundary_levels(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each byte the number of zero bits that the hash of the bytes up to it ends in, 64 at most; a text's first bytes have what there is."""
    weight = [np.uint64(pow(ROLL, k + 1, 1 << 64)) for k in range(CONTEXT)]
    out = np.empty(len(raw), np.uint8)

    def zeros(h: np.ndarray) -> np.ndarray:
        h = mix64(h)
        return np.bitwise_count((h & (~h + np.uint64(1))) - np.uint64(1)).astype(np.uint8)

    for start in range(0, len(raw), PIECE_BYTES):
        low = max(0, start - CONTEXT + 1)
        value = raw[low : start + PIECE_BYTES].astype(np.uint64) + np.uint64(1)
        h = value * weight[0]
        for k in range(1, CONTEXT):
            h[k:] += value[:-k] * weight[k]
        out[start : start + PIECE_BYTES] = zeros(h[start - low :])
    # where a text begins the context is shorter
    spot = at[:-1, None] + np.arange(CONTEXT - 1)
    text, k = np.nonzero(spot < at[1:, None])
    spot = spot[text, k]
    h = np.zeros(len(spot), np.uint64)
    for back in range(CONTEXT - 1):
        inside = back <= k
        h[inside] += (raw[spot[inside] - back].astype(np.uint64) + np.uint64(1)) * weight[back]
    out[spot] = zeros(h)
    return out


def _prefix_sums(raw: np.ndarray, spots: np.ndarray) -> np.ndarray:
    """Polynomial hash of all bytes before each of the ascending ``spots``."""
    out = np.zeros(len(spots), np.uint64)
    power = _power(BASE, np.arange(min(PIECE_BYTES, len(raw))))
    done = np.zeros(1, np.uint64)
    for low in range(0, len(raw), PIECE_BYTES):
        value = (raw[low : low + PIECE_BYTES].astype(np.uint64) + np.uint64(1)) * power[: len(raw) - low]
        sums = np.concatenate([done, done + np.cumsum(value, dtype=np.uint64) * np.uint64(pow(BASE, low, 1 << 64))])
        first, last = np.searchsorted(spots, [low, low + len(value) + 1])
        out[first:last] = sums[spots[first:last] - low]
        done = sums[-1:]
    return out


def _cuts(spots: np.ndarray, level: int, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where chunks of texts start[i] to stop[i] end at a level whose boundaries end at ``spots``: (ends, CHUNKS columns, their number, or one more than CHUNKS)."""
    least, most = max(1, (1 << level) // SPREAD), (1 << level) * SPREAD
    ends, at = np.zeros((len(start), CHUNKS), np.int64), start
    size = np.zeros(len(start), np.int64)
    far = np.append(spots, np.iinfo(np.int64).max)
    for k in range(CHUNKS):
        on = at < stop
        if not on.any():
            break
        at = np.where(on, np.minimum(np.minimum(far[np.searchsorted(spots, at + least)], at + most), stop), at)
        ends[:, k] = at
        size += on
    return ends, np.where(at < stop, CHUNKS + 1, size)


def signatures(raw: np.ndarray, at: np.ndarray) -> Signatures:
    """Of the texts ``raw[at[i]:at[i + 1]]``; some bytes a byte of text are held, whatever its length."""
    n = len(at) - 1
    levels = boundary_levels(raw, at)

    def spots(level: int) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *(np.flatnonzero(levels[k : k + PIECE_BYTES] >= level) + k + 1 for k in range(0, len(raw), PIECE_BYTES))])

    # at the first level no chunk is longer than allowed in CHUNKS of them; a few levels on, all are long enough
    length = np.diff(at)
    level = np.maximum(LEAST_LEVEL, np.ceil(np.log2(np.maximum(1, length) / (CHUNKS * SPREAD)))).astype(np.int64)
    ends = tuple(np.zeros((n, CHUNKS), np.int64) for _ in range(2))
    sizes = tuple(np.zeros(n, np.int64) for _ in range(2))
    open_, k = np.ones(n, bool), LEAST_LEVEL
    fine = None  # of level k, from the round before
    while open_.any():
        k = max(k, int(level[open_].min()))
        fine = spots(k) if fine is None or fine[0] != k else fine[1]
        coarse = spots(k + 1)
        rows = np.flatnonzero(open_ & (level <= k))
        both = [_cuts(s, k + more, at[:-1][rows], at[1:][rows]) for more, s in ((0, fine), (1, coarse))]
        fit = (both[0][1] <= CHUNKS) & (both[1][1] <= CHUNKS)
        for more in (0, 1):
            ends[more][rows[fit]], sizes[more][rows[fit]] = both[more][0][fit], both[more][1][fit]
        level[rows[fit]], level[rows[~fit]] = k, k + 1
        open_[rows[fit]] = False
        fine, k = (k + 1, coarse), k + 1
    here = [np.arange(CHUNKS) < s[:, None] for s in sizes]
    all_spots = np.unique(np.concatenate([at, *(e[h] for e, h in zip(ends, here))]))
    sums = _prefix_sums(raw, all_spots)
    inverse, found = pow(BASE, -1, 1 << 64), []
    for end, inside in zip(ends, here):
        begin = np.concatenate([at[:-1, None], end[:, :-1]], 1)[inside]
        end = end[inside]
        total = sums[np.searchsorted(all_spots, end)] - sums[np.searchsorted(all_spots, begin)]
        code = mix64(total * _power(inverse, begin) + (end - begin).astype(np.uint64) * np.uint64(ROLL)) >> np.uint64(52)
        codes = np.full((n, CHUNKS), -1, np.int16)
        codes[inside] = code.astype(np.int16)
        found.append(codes)
    return Signatures(level, tuple(found), sizes)


def written(s: Signatures) -> list[str]:
    """Fingerprints as text."""
    both = []
    for codes, size in zip(s.codes, s.sizes):
        letters = np.stack([LETTERS[codes >> 6 & 63], LETTERS[codes & 63]], 2).reshape(len(codes), 2 * CHUNKS)
        both.append([row[: 2 * k].tobytes().decode() for row, k in zip(letters, size.tolist())])
    return [f"{k}:{a}:{b}" for k, a, b in zip(s.level.tolist(), *both)]


def read(fingerprints: list[str | None]) -> Signatures:
    """The signatures that :func:`written` wrote; a null is the fingerprint of no text."""
    parts = [(f or f"{LEAST_LEVEL}::").split(":") for f in fingerprints]
    level, found, sizes = np.array([int(p[0]) for p in parts], np.int64), [], []
    for k in (1, 2):
        raw = np.frombuffer("".join(p[k] for p in parts).encode(), np.uint8)
        value = _VALUE[raw[::2]] << 6 | _VALUE[raw[1::2]]
        size = np.array([len(p[k]) // 2 for p in parts], np.int64)
        first = np.concatenate([[0], np.cumsum(size)])
        own = np.repeat(np.arange(len(parts)), size)
        codes = np.full((len(parts), CHUNKS), -1, np.int16)
        codes[own, np.arange(len(own)) - first[own]] = value
        found.append(codes)
        sizes.append(size)
    return Signatures(level, tuple(found), tuple(sizes))


def edit_distances(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Insertions, deletions and replacements between rows of a and b, whose first n count; at most 64 of each.

    The columns of a pair's table are kept as the places where it steps up and down, a bit for each row
    (Myers' bit vectors), for all pairs together.
    """
    one = np.uint64(1)
    up, down = np.full(len(a), ~np.uint64(0)), np.zeros(len(a), np.uint64)
    last = np.where(n_a > 0, one << (np.maximum(n_a, 1) - 1).astype(np.uint64), np.uint64(0))
    distance = n_a.astype(np.int64)
    for j in range(int(n_b.max(initial=0))):
        equal = np.packbits(a == b[:, j : j + 1], axis=1, bitorder="little").view(np.uint64).ravel()
        diagonal = (((equal & up) + up) ^ up) | equal
        rises, falls = down | ~(diagonal | up), up & diagonal
        on = j < n_b
        distance += on * ((rises & last != 0).astype(np.int64) - (falls & last != 0))
        rises, falls = rises << one | one, falls << one
        moved = equal | down
        up, down = np.where(on, falls | ~(moved | rises), up), np.where(on, rises & moved, down)
    return np.where(n_a == 0, n_b, distance)


def likeness(a: Signatures, b: Signatures) -> np.ndarray:
    """Likeness of each row of a to that of b, from 0 to 1; 1 for equal fingerprints."""
    out = np.zeros(len(a.level))
    for step in (0, 1, -1):
        rows = np.flatnonzero(a.level - b.level == step)
        if len(rows):
            x, y = a.rows(rows), b.rows(rows)
            i, j = int(step == -1), int(step == 1)
            longer = np.maximum(x.sizes[i], y.sizes[j])
            out[rows] = np.where(longer > 0, 1 - edit_distances(x.codes[i], x.sizes[i], y.codes[j], y.sizes[j]) / np.maximum(1, longer), 1.0)
    return out


def _kinds(df: DataFrame) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema)


def fingerprint_documents(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and ``fingerprint``, a function of the text alone; null counts as empty.

    Rows are answered one by one: repeated rows, null ids and an empty table do no harm. A kept column
    named ``fingerprint`` gives way; others are not read. A text of any length is read whole, block by block.
    """
    kept = [c for c in keep if c.lower() != "fingerprint"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text):
                found = pa.array(written(signatures(*utf8(piece.column(text)))), pa.string())
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in kept), found], [*kept, "fingerprint"])

    return map_arrow(docs.select(*dict.fromkeys([*keep, text])), run, _kinds(docs.select(*kept)) + "fingerprint string")


def add_likeness(pairs: DataFrame, a: str, b: str, name: str = "likeness") -> DataFrame:
    """``pairs`` with the likeness of the fingerprints in columns a and b; a column of that name gives way, null is no text's fingerprint."""
    kept = [c for c in pairs.columns if c.lower() != name.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = likeness(read(batch.column(a).to_pylist()), read(batch.column(b).to_pylist()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(value)], [*kept, name])

    return map_arrow(pairs, run, _kinds(pairs.select(*kept)) + f"`{name}` double")


Chain = Callable[[np.ndarray, np.ndarray], dict[str, pa.Array]]


def map_with_next(docs: DataFrame, function: Chain, schema: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The id and what ``function`` says of each text and the next one by ascending id; the first follows the last.

    ``function`` gets the (bytes, offsets) of m + 1 texts that follow each other and answers for the first m.
    Equal ids are ordered by a hash of their texts, equal rows in any order; null ids come first, and a null
    text is empty. Texts are dealt out by ranges of (id, hash, row), so a repeated id does not meet in one task,
    and pass in order with one text held back; only where two ranges meet are both texts written and joined.
    """
    order = ["__id", "__hash", "__row"]
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select("*", F.xxhash64("text").alias("__hash"), F.monotonically_increasing_id().alias("__row"))
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("__id", "text")
    kind = ordered.schema["__id"].dataType.simpleString()
    names = [f.split()[0] for f in schema.split(", ")]

    def answered(chain: pa.Table) -> pa.Table:
        found = function(*utf8(chain["text"]))
        return pa.table({"__id": chain["__id"].slice(0, chain.num_rows - 1), **{c: found[c] for c in names}})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, kinds = TaskContext.get().partitionId(), None, None

        def edge(row: pa.Table, which: str) -> pa.RecordBatch:
            empty = {c: pa.nulls(1, kinds[c]) for c in names}
            return pa.table({"__id": row["__id"], **empty, "edge": [which], "part": pa.array([part], pa.int32()), "text": row["text"].cast(pa.string())}).combine_chunks().to_batches()[0]

        for batch in batches:
            for piece in pieces(batch, "text"):
                piece = pa.Table.from_batches([piece])
                if kinds is None and piece.num_rows:
                    found = function(*utf8(pa.array(["", ""])))
                    kinds = {c: found[c].type for c in names}
                    yield edge(piece.slice(0, 1), "first")
                chain = piece if held is None else pa.concat_tables([held, piece])
                if chain.num_rows > 1:
                    done = answered(chain)
                    n = done.num_rows
                    yield from done.append_column("edge", pa.nulls(n, pa.string())).append_column("part", pa.nulls(n, pa.int32())).append_column("text", pa.nulls(n, pa.string())).to_batches()
                held = pa.Table.from_batches(chain.slice(max(0, chain.num_rows - 1)).to_batches())
        if held is not None and held.num_rows:
            yield edge(held, "last")

    path = shared_path(docs.sparkSession, "neighbours")
    map_arrow(ordered, run, f"__id {kind}, {schema}, edge string, part int, text string").write.parquet(path)
    spark = docs.sparkSession
    out = spark.read.parquet(path)
    parts = sorted(r["part"] for r in out.where("edge = 'last'").select("part").collect())  # one a range
    follow = spark.createDataFrame(list(zip(parts, [*parts[1:], *parts[:1]])), "part int, next int")
    firsts = out.where("edge = 'first'").select(F.col("part").alias("next"), F.col("text").alias("after"))
    pairs = out.where("edge = 'last'").select("__id", "part", "text").join(follow, "part").join(firsts, "next").select("__id", "text", "after")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                both = pa.concat_arrays([row.column("text"), row.column("after")])
                yield from answered(pa.table({"__id": pa.concat_arrays([row.column("__id")] * 2), "text": both})).to_batches()

    whole = out.where("edge IS NULL").select("__id", *names).unionByName(map_arrow(pairs, meet, f"__id {kind}, {schema}"))
    return whole.withColumnRenamed("__id", id_col)


def _after_points(text: np.ndarray, points: int) -> int:
    """Bytes of the first so many code points, or of all."""
    for start in range(0, len(text), PIECE_BYTES):
        lead = text[start : start + PIECE_BYTES] & 0xC0 != 0x80
        n = int(np.count_nonzero(lead))
        if points < n:
            return start + int(np.flatnonzero(lead)[points])
        points -= n
    return len(text)


def rotated_edits(raw: np.ndarray, at: np.ndarray) -> dict[str, pa.Array]:
    """Of texts in a row: their fingerprints and those of the texts whose last quarter is replaced by the beginning of the next."""
    texts = [raw[a:b] for a, b in zip(at[:-1], at[1:])]
    points = [sum(int(np.count_nonzero(t[a : a + PIECE_BYTES] & 0xC0 != 0x80)) for a in range(0, len(t), PIECE_BYTES)) for t in texts[:-1]]
    edited = [t[: _after_points(t, n - n // 4)].tobytes() + u[: _after_points(u, n // 4)].tobytes() for t, u, n in zip(texts, texts[1:], points)]
    digests = [hashlib.sha256(e).hexdigest() for e in edited]
    sizes = np.concatenate([[0], np.cumsum([len(e) for e in edited])]).astype(np.int64)
    own, changed = signatures(raw, at), signatures(np.frombuffer(b"".join(edited), np.uint8), sizes)
    m = len(edited)
    first = own.rows(slice(0, m))
    return {
        "n_chars": pa.array(points, pa.int64()), "edited_sha256": pa.array(digests, pa.string()), "fingerprint": pa.array(written(first), pa.string()), "edited_fingerprint": pa.array(written(changed), pa.string()),
        "near_edited": pa.array(likeness(first, changed)), "near_next": pa.array(likeness(first, own.rows(slice(1, m + 1)))),
    }


ROTATED = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
