"""SimHash near-duplicates by anchor-point covering.

Fingerprint: the majority bit of the XXH64 hashes of a text's word shingles. Two fingerprints
link when at most ``RADIUS`` (4) of 64 bits differ.

Covering: 64 bits are cut into two blocks of 23 bits and one of 18. Two linked fingerprints
differ in at most one bit of the first block, or one of the second, or none of the third:
otherwise at least 2 + 2 + 1 bits would differ. The anchors of a 23-bit block are the codewords
of the binary Golay code, whose covering radius is 3: every block value has one codeword within
3, its home. A fingerprint is replicated to every anchor within covering radius plus block
threshold (3 + 1); if two blocks differ in one bit, the second lies within 4 of the first one's
home, so they meet there. The anchors of the 18-bit block are all its words (radius 0), and its
threshold is 0. No link can be missed, whatever the data; a fingerprint has 11.6 anchors on
average, of 270,336.

Unlike fingerprints meet by chance: a pair shares a Golay anchor with probability 5.3^2 / 4096 in
either block, so comparisons of a fingerprint would grow with their number. From ``LEVELS`` on a
key is an anchor with the values of 1 or 2 of the 5 or 6 parts of the other bits: two linked
fingerprints differ in at most four of those, so that many parts are equal. This takes 5 or 15
times the replicas and, measured, one in 52 or in 670 comparisons; the links are the same.

Only distinct fingerprints take part, so copies cost nothing. In each anchor's group the
linked fingerprints are found by breadth-first search over the not yet reached ones: linked
groups are left in a few passes and only a spanning tree is sent on, never all pairs. A group
of over ``BLOCK`` members is dealt out as pairs of blocks to separate tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlespark.llm.common import cut, map_arrow
from candlespark.llm.components import connected_components

RADIUS = 4
WORDS = 4
SEED = 42
BLOCK = 3000
#: Fingerprints whose replicas are made together.
REPLICATE_ROWS = 50_000
GOLAY_BITS, GOLAY_RADIUS, GENERATOR = 23, 3, 0xC75
#: (first bit, bits, threshold) of the blocks; the thresholds and 1 for each block add up to RADIUS + 1.
LAYOUT = ((0, 23, 1), (23, 23, 1), (46, 18, 0))
#: Distinct fingerprints from which a key also has so many of the parts of the other bits.
LEVELS = ((0, 0), (2_000_000, 1), (100_000_000, 2))

# XXH64: fixed values of the published hash function
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rotl(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def xxh64(data: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of ``data[start : start + size]`` for many slices at once; slices of 32 bytes and more one by one."""
    out = np.empty(len(start), np.uint64)
    long = size >= 32
    if long.any():
        raw = data.tobytes()
        digest = xxhash.xxh64_intdigest
        out[long] = [digest(raw[s : s + n], seed) for s, n in zip(start[long].tolist(), size[long].tolist())]
    short = np.flatnonzero(~long)
    at, left = start[short].astype(np.int64), size[short].astype(np.int64)
    wide = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.lib.stride_tricks.as_strided(wide[: len(wide) - 7].view(), (len(wide) - 7, 8), (1, 1))
    h = np.uint64(seed) + _P5 + left.astype(np.uint64)
    for _ in range(3):
        k = np.flatnonzero(left >= 8)
        if not len(k):
            break
        word = lanes[at[k]].view("<u8").ravel()
        h[k] = _rotl(h[k] ^ (_rotl(word * _P2, 31) * _P1), 27) * _P1 + _P4
        at[k] += 8
        left[k] -= 8
    k = np.flatnonzero(left >= 4)
    if len(k):
        word = lanes[at[k]].view("<u4")[:, 0].astype(np.uint64)
        h[k] = _rotl(h[k] ^ (word * _P1), 23) * _P2 + _P3
        at[k] += 4
        left[k] -= 4
    for _ in range(3):
        k = np.flatnonzero(left >= 1)
        if not len(k):
            break
        h[k] = _rotl(h[k] ^ (wide[at[k]].astype(np.uint64) * _P5), 11) * _P1
        at[k] += 1
        left[k] -= 1
    h ^= h >> np.uint64(33)
    h *= _P2
    h ^= h >> np.uint64(29)
    h *= _P3
    h ^= h >> np.uint64(32)
    out[short] = h
    return out


def fingerprints(texts: list[bytes], words: int = WORDS) -> np.ndarray:
    """SimHash of each text: ASCII lower case, ``words``-word shingles with repeats; no words give 0."""
    out = np.zeros(len(texts), np.uint64)
    for i, text in enumerate(texts):
        parts = text.lower().split()
        if not parts:
            continue
        counts, total = np.zeros(64, np.int64), 0
        n = max(1, len(parts) - words + 1)
        for low in range(0, n, 65536):
            some = parts[low : low + 65536 + words - 1]
            joined = np.frombuffer(b" ".join(some), np.uint8)
            ends = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)) + 1) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])
            m = max(1, len(some) - words + 1)
            last = ends[min(words, len(some)) - 1 :][:m]
            h = xxh64(joined, starts[:m], last - starts[:m])
            bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(0, dtype=np.int64)
            total += m
        out[i] = np.packbits(2 * counts > total, bitorder="little").view("<u8")[0]
    return out


def _syndrome(values: np.ndarray) -> np.ndarray:
    """Remainder by the generator polynomial of the Golay code: 0 exactly for codewords."""
    rest = values.astype(np.uint32)
    for bit in range(GOLAY_BITS - 1, 10, -1):
        rest = np.where(rest >> np.uint32(bit) & np.uint32(1), rest ^ np.uint32(GENERATOR << (bit - 11)), rest)
    return rest


@cache
def _errors(weight: int) -> tuple[np.ndarray, np.ndarray]:
    """Error patterns of at most ``weight`` bits in order of their syndrome, and where each syndrome begins."""
    patterns = np.arange(1 << GOLAY_BITS, dtype=np.uint32)
    patterns = patterns[np.bitwise_count(patterns) <= weight]
    order = np.argsort(s := _syndrome(patterns), kind="stable")
    return patterns[order], np.searchsorted(s[order], np.arange((1 << 11) + 1))


def anchors(fingerprint: np.ndarray, level: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): every anchor within covering radius plus block threshold, for each fingerprint; with ``level``, also so many of RADIUS + level parts of the other bits.

    The codewords near a word are the word less each error pattern that has its syndrome.
    """
    rows, ids = [], []
    for k, (first, bits, threshold) in enumerate(LAYOUT):
        part = (fingerprint >> np.uint64(first)).astype(np.uint32) & np.uint32((1 << bits) - 1)
        row = np.arange(len(part))
        if bits == GOLAY_BITS:
            patterns, begin = _errors(GOLAY_RADIUS + threshold)
            s = _syndrome(part)
            n = begin[s + 1] - begin[s]
            row = np.repeat(row, n)
            pick = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + begin[s][row]
            part = part[row] ^ patterns[pick]
        anchor = part.astype(np.int64) | np.int64(k << 23)
        above = fingerprint >> np.uint64(first + bits) if first + bits < 64 else np.zeros_like(fingerprint)
        other, width, pieces = above << np.uint64(first) | fingerprint & np.uint64((1 << first) - 1), 64 - bits, RADIUS + level
        edge = [width * x // pieces for x in range(pieces + 1)]
        for c, chosen in enumerate(combinations(range(pieces), level)):
            value = np.zeros(len(fingerprint), np.uint64)
            for x in chosen:
                size = edge[x + 1] - edge[x]
                value = value << np.uint64(size) | other >> np.uint64(edge[x]) & np.uint64((1 << size) - 1)
            rows.append(row)
            ids.append(anchor | np.int64(c << 25) | value.astype(np.int64)[row] << np.int64(29))
    return np.concatenate(rows), np.concatenate(ids)


def spanning_links(values: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct ``values``: breadth-first over what is not yet reached."""
    rest = values.copy()
    a, b = [], []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                found = rest[near]
                a.append(np.full(len(found), x))
                b.append(found)
                queue.extend(found)
                rest = rest[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (values[:0], values[:0])


def add_fingerprints(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The ``keep`` columns with ``fp``, the fingerprint as a signed 64-bit integer; null texts get 0."""
    source = docs.select(*dict.fromkeys([*keep, text]))
    schema = source.select(*keep).schema.add("fp", "long")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [v.as_py() or b"" for v in batch.column(text).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(fingerprints(texts).view(np.int64))], [*keep, "fp"])

    return map_arrow(source, answer, schema)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group; a group may go over several batches."""
    held: list[tuple] = []

    def flush(keys: tuple, values: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0), [True]]))
        a, b = [], []
        for s, e in zip(at[:-1], at[1:]):
            if e - s > 1:
                x, y = spanning_links(values[s:e])
                a.append(x)
                b.append(y)
        a, b = (np.concatenate(a), np.concatenate(b)) if a else (values[:0], values[:0])
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for batch in batches:
        rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "p", "q", "fp")]
        if held:
            rows = [np.concatenate([h, r]) for h, r in zip(held, rows)]
        if not len(rows[0]):
            continue
        last = np.ones(len(rows[0]), bool)
        for k in rows[:3]:
            last &= k == k[-1]
        first_of_last = len(last) - int(last.sum())
        held = [r[first_of_last:] for r in rows]
        if first_of_last:
            yield flush(tuple(r[:first_of_last] for r in rows[:3]), rows[3][:first_of_last].view(np.uint64))
    if held and len(held[0]):
        yield flush(tuple(held[:3]), held[3].view(np.uint64))


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """(a, b): a spanning set of the links between the distinct values of ``fp``."""
    distinct = fps.select("fp").distinct()
    n = distinct.count()
    level = max(level for least, level in LEVELS if n >= least)

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, REPLICATE_ROWS >> 2 * level):
                fp = batch.column("fp").slice(low, REPLICATE_ROWS >> 2 * level).to_numpy(zero_copy_only=False).view(np.uint64)
                row, anchor = anchors(fp, level)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp.view(np.int64)[row])], ["anchor", "fp"])

    spread = map_arrow(distinct, replicate, "anchor long, fp long")
    # groups over BLOCK members are cut into blocks by a hash; each pair of blocks is a task's group
    size = spread.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    wide = size.select("anchor", F.ceil(F.col("n") / BLOCK).cast("int").alias("k"))
    sized = spread.join(wide, "anchor", "left").withColumn("k", F.coalesce("k", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
    grid = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda x: F.struct(F.least(x, F.col("o")).alias("p"), F.greatest(x, F.col("o")).alias("q")))
    dealt = sized.withColumn("o", own).select("anchor", "fp", F.explode(grid).alias("g")).select("anchor", "g.p", "g.q", "fp")
    grouped = dealt.repartition("anchor", "p", "q").sortWithinPartitions("anchor", "p", "q")
    return map_arrow(grouped, _compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, ``fp`` (long) and ``component_id``, the smallest id reachable.

    Null, empty and wordless texts have fingerprint zero and link like any other. Repeated rows
    give repeated answers. Rows with a null id get a component by their fingerprint's group; a
    group of null ids only has a null component. An empty table gives an empty table.
    """
    fps = cut(add_fingerprints(docs, text, [id_col]))
    classes = fps.groupBy("fp").agg(F.min(id_col).alias("least"))
    roots = connected_components(fingerprint_links(fps))
    of_class = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # cut, so that the join has a plain shuffle on both sides and adaptive execution can split a large component
    smallest = cut(of_class.groupBy("root").agg(F.min("least").alias("component_id")))
    answer = of_class.join(smallest, "root").select("fp", "component_id")
    return fps.join(answer, "fp").select(id_col, "fp", "component_id")
