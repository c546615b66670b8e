"""Fuzzy line deduplication by MinHash, exact Jaccard verification and distributed union-find.

1. Lines (split at U+000A, stripped, A-Z lower-cased; blank ones are left alone) get a 128-bit
   id and ``ROWS * BANDS`` MinHashes of their distinct ``SHINGLE``-character shingles. With 12
   bands of 4 rows a pair of similarity 0.8 shares a band with probability 0.998, of 0.9 with
   1 - 6e-6. Copies of a line are one line from here on.
2. Band keys travel as sorted arrays, a row for each ``HELD_KEYS`` of a task and range of
   keys, never as a row each: beyond ``FAN`` ranges they go to groups of ranges first, where those of many tasks are
   brought together before they go on to their ranges, so a row has some hundred keys whatever the number of ranges. A range finds the buckets with two or more lines; a set of lines
   that shares several bands is one bucket.
3. The lines of buckets, and only those, are shuffled and compared. Within a bucket a
   breadth-first search over the lines not yet reached computes exact Jaccard similarities, so
   no link between different lines is lost and no list of pairs is made. Buckets of more than
   one block are dealt out as pairs of blocks, so no task depends on the size of a bucket.
4. Links are joined into components; each keeps the line that comes first by (id, line number).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlespark.llm.common import cut, map_arrow, mix64, pieces, screened, with_rows
from candlespark.llm.components import connected_components

SHINGLE = 7
ROWS, BANDS = 4, 12
THRESHOLD = 0.8
#: Lines of a bucket that are a block: 1 / BLOCKS of them, within these bounds. Tasks compare pairs of blocks.
LEAST_BLOCK, BLOCK, BLOCKS = 256, 16384, 16
#: Bytes of text for each range of band keys, and the least number of ranges.
RANGE_BYTES, MIN_RANGES = 8 << 20, 64
#: Band keys that a task sends together, ranges that it sends to at most, and bytes of text whose keys one task brings together between.
HELD_KEYS, FAN, GROUP_BYTES = 1 << 21, 4096, 8 << 20
#: Lines whose similarities are computed together, where buckets are smaller.
VERIFY_LINES = 2000

_MULTIPLIERS = (mix64(np.arange(1, ROWS * BANDS + 1)) | np.uint64(1)).astype(np.uint32)


def lines_of(text: bytes | None) -> Iterator[tuple[int, bytes]]:
    """(number, normalised line) of every line that is not blank."""
    for k, line in enumerate((text or b"").split(b"\n")):
        line = line.strip().lower()
        if line:
            yield k, line


def shingle_hashes(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes, offsets): shingles of consecutive code points; a shorter line is one shingle."""
    gap = b"\0" * SHINGLE
    raw = gap.join([*lines, b""])
    if raw.isascii():
        points = np.frombuffer(raw, np.uint8)
        sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    else:
        texts = [x.decode("utf-8", "replace") for x in lines]
        points = np.frombuffer("".join(x + "\0" * SHINGLE for x in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    code = np.zeros(len(points), np.uint64)
    wide = points.astype(np.uint64) + np.uint64(1)
    for k in range(SHINGLE):
        code[: len(points) - k] *= np.uint64(0x100000001B3)
        code[: len(points) - k] += wide[k:]
    many = np.maximum(1, sizes - SHINGLE + 1)
    begin = np.cumsum(sizes + SHINGLE) - (sizes + SHINGLE)
    at = np.concatenate([[0], np.cumsum(many)])
    pick = np.arange(at[-1]) + np.repeat(begin - at[:-1], many)
    return mix64(code[pick]), at


def band_keys(lines: list[bytes]) -> np.ndarray:
    """(lines, BANDS): 64-bit band keys, which differ between bands."""
    hashes, at = shingle_hashes(lines)
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    keys = np.empty((len(lines), BANDS), np.uint64)
    held = np.empty_like(low)
    for b in range(BANDS):
        key = np.full(len(lines), b, np.uint64)
        for r in range(ROWS):
            np.multiply(low, _MULTIPLIERS[b * ROWS + r], out=held)
            key = mix64(key ^ np.minimum.reduceat(held, at[:-1]).astype(np.uint64))
        keys[:, b] = key
    return keys


def jaccard_links(lines: list[bytes], threshold: float = THRESHOLD, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(x, y): a spanning forest of the links among distinct lines of one ``group``, by exact Jaccard similarity of their shingle sets.

    Breadth-first search in all groups at once: in each round every group that has lines left to
    reach compares one reached line with all of those.
    """
    group = np.zeros(len(lines), np.int64) if group is None else group
    hashes, at = shingle_hashes(lines)
    owner = np.repeat(np.arange(len(lines)), np.diff(at))
    hashes ^= mix64(group)[owner]  # no shingle is shared between groups
    order = np.argsort(hashes, kind="stable")
    new = np.concatenate([[True], np.diff(hashes[order]) != 0])
    fresh, dense = np.empty(len(order), bool), np.empty(len(order), np.int64)
    fresh[order] = new | np.concatenate([[True], np.diff(owner[order]) != 0])
    dense[order] = np.cumsum(new) - 1
    dense, owner = dense[fresh], owner[fresh]
    sizes = np.bincount(owner, minlength=len(lines))
    edge = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(int(new.sum()), bool)
    rest = np.argsort(group, kind="stable")  # not yet reached, by group
    flat, of = _parts(rest, edge, dense)
    queues: dict[int, list[int]] = {}
    found: list[tuple[np.ndarray, np.ndarray]] = []
    while len(rest):
        own = group[rest]
        begin = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        pivot = np.array([queues[g].pop() if queues.get(g) else -1 for g in own[begin].tolist()])
        seeds = begin[pivot < 0]
        pivot[pivot < 0] = rest[seeds]
        mine, _ = _parts(pivot, edge, dense)
        mark[mine] = True
        shared = np.add.reduceat(mark[flat], of[:-1], dtype=np.int64)
        mark[mine] = False
        mate = np.repeat(pivot, np.diff(np.append(begin, len(rest))))
        near = shared >= threshold * (sizes[rest] + sizes[mate] - shared)
        near[seeds] = False
        if near.any():
            found.append((mate[near], rest[near]))
            for g, y in zip(own[near].tolist(), rest[near].tolist()):
                queues.setdefault(g, []).append(y)
        near[seeds] = True
        keep = ~near
        left = np.add.reduceat(keep.astype(np.int64), begin)
        keep &= np.repeat((left > 1) | np.array([bool(queues.get(g)) for g in own[begin].tolist()]), np.diff(np.append(begin, len(rest))))  # a last line has nothing to meet
        lengths = np.diff(of)
        rest, flat, of = rest[keep], flat[np.repeat(keep, lengths)], np.concatenate([[0], np.cumsum(lengths[keep])])
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _parts(rows: np.ndarray, edge: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of ``rows`` one after the other, and where each row's begin."""
    many = edge[rows + 1] - edge[rows]
    at = np.concatenate([[0], np.cumsum(many)])
    return values[np.arange(at[-1]) + np.repeat(edge[rows] - at[:-1], many)], at


def _id(line: bytes) -> bytes:
    return hashlib.md5(line, usedforsecurity=False).digest()


def _short(ids: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(i[:8] for i in ids), "<i8") if ids else np.zeros(0, np.int64)


def _distinct(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[dict[bytes, bytes]]:
    """The distinct lines of each piece of the texts, by id."""
    for batch in batches:
        for part in pieces(batch, text):
            found: dict[bytes, bytes] = {}
            for value in part.column(text).cast(pa.large_binary()):
                for _, line in lines_of(value.as_py()):
                    found[_id(line)] = line
            if found:
                yield found


def _messages(held: list[tuple[np.ndarray, np.ndarray]], ranges: int, width: int, salt: int) -> list[pa.RecordBatch]:
    """Sorted (keys, ids) for each range, or group of ``width`` ranges, that has any."""
    if not held:
        return []
    keys, ids = (np.concatenate(x) for x in zip(*held))
    place = (keys % np.uint64(ranges)).astype(np.int64) // width
    order = np.lexsort((keys, place))
    begin = np.flatnonzero(np.diff(place[order], prepend=-1))
    rows = np.split(order, begin[1:])
    columns = [pa.array(place[order[begin]], pa.int32()), pa.array(np.full(len(rows), salt, np.int32)), pa.array([keys[r].tobytes() for r in rows], pa.binary()), pa.array([ids[r].tobytes() for r in rows], pa.binary())]
    return [pa.RecordBatch.from_arrays(columns, ["range", "salt", "keys", "ids"])]


def line_links(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(a, b): ids of linked different lines, a spanning set of all links that the bands bring together."""
    source = docs.select(text)
    n_bytes = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    ranges = max(MIN_RANGES, n_bytes // RANGE_BYTES)

    wide = ranges > FAN
    width = math.ceil(math.sqrt(ranges)) if wide else 1  # ranges of a group
    salts = max(1, n_bytes * width // (ranges * GROUP_BYTES))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId() % salts
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for found in _distinct(batches, text):
            held.append((band_keys(list(found.values())).ravel(), np.repeat(_short(list(found)), BANDS)))
            if sum(len(k) for k, _ in held) >= HELD_KEYS:
                yield from _messages(held, ranges, width, salt)
                held = []
        yield from _messages(held, ranges, width, salt)

    def pass_on(table: pa.Table) -> pa.Table:
        held = [tuple(np.frombuffer(b"".join(table[c].to_pylist()), kind) for c, kind in (("keys", np.uint64), ("ids", np.int64)))]
        return pa.Table.from_batches(_messages(held, ranges, 1, 0))

    def buckets(table: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(table["keys"].to_pylist()), np.uint64)
        ids = np.frombuffer(b"".join(table["ids"].to_pylist()), np.int64)
        order = np.lexsort((ids, keys))
        keys, ids = keys[order], ids[order]
        fresh = np.concatenate([[True], (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])])
        keys, ids = keys[fresh], ids[fresh]
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
        out = []
        for s in np.flatnonzero(np.diff(at) > 1):
            members = ids[at[s] : at[s + 1]]
            size = min(BLOCK, max(LEAST_BLOCK, -(-len(members) // BLOCKS)))
            blocks = np.array_split(members, -(-len(members) // size))
            name = int.from_bytes(hashlib.blake2b(members.tobytes(), digest_size=8).digest(), "little", signed=True)
            out += [(name, len(blocks), b, x.tobytes()) for b, x in enumerate(blocks)]
        kinds = {"bucket": pa.int64(), "blocks": pa.int32(), "block": pa.int32(), "members": pa.binary()}
        return pa.table([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * len(kinds), kinds.values())], list(kinds))

    message = "range int, salt int, keys binary, ids binary"
    sent = map_arrow(source, send, message)
    if wide:
        sent = sent.groupBy("range", "salt").applyInArrow(pass_on, message)
    # equal sets of lines are one bucket, whatever bands they share; two sets of one name would only be compared together
    found = cut(sent.groupBy("range").applyInArrow(buckets, "bucket long, blocks int, block int, members binary").distinct())
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("block"))
    # a block's own pairs are compared along with its pairs with another block
    pairs = F.transform(others, lambda x: F.struct(F.least(x, F.col("block")).alias("p"), F.greatest(x, F.col("block")).alias("q")))
    alone = F.array(F.struct(F.lit(0).alias("p"), F.lit(0).alias("q")))
    dealt = found.select("bucket", F.explode(F.when(F.col("blocks") > 1, pairs).otherwise(alone)).alias("g"), "members").select("bucket", "g.p", "g.q", "members")

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("members").to_pylist()
            ids = np.frombuffer(b"".join(raw), np.int64)
            row = np.repeat(np.arange(len(raw)), [len(m) // 8 for m in raw])
            for low in range(0, len(ids), 200_000):
                own = batch.select(["bucket", "p", "q"]).take(pa.array(row[low : low + 200_000]))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(ids[low : low + 200_000])], ["bucket", "p", "q", "short"])

    belongs = map_arrow(dealt, members, "bucket long, p int, q int, short long")

    def all_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lines in _distinct(batches, text):
            yield pa.RecordBatch.from_arrays([pa.array(_short(list(lines))), pa.array(list(lines), pa.binary()), pa.array(list(lines.values()), pa.binary())], ["short", "id", "line"])

    # lines of no bucket stay out of the shuffle; the join is exact
    suspects = map_arrow(found.select(F.col("bucket"), F.lit(0).alias("p"), F.lit(0).alias("q"), "members"), members, "bucket long, p int, q int, short long")
    n = found.agg(F.sum(F.octet_length("members") / 8)).first()[0] or 0
    candidates = screened(map_arrow(source, all_lines, "short long, id binary, line binary"), suspects, "short", int(n))
    texts = candidates.dropDuplicates(["id"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number = None, -1
        ids, lines, group = [], [], []

        def links() -> pa.RecordBatch:
            x, y = jaccard_links(lines, threshold, np.array(group))
            return pa.RecordBatch.from_arrays([pa.array([ids[k] for k in v.tolist()], pa.binary()) for v in (x, y)], ["a", "b"])

        for batch in batches:
            for *key, i, line in zip(*(batch.column(c).to_pylist() for c in ("bucket", "p", "q", "id", "line"))):
                if key != now:
                    if len(lines) >= VERIFY_LINES:
                        yield links()
                        ids, lines, group = [], [], []
                    now, number = key, number + 1
                ids.append(i)
                lines.append(line)
                group.append(number)
        if lines:
            yield links()

    where = ["bucket", "p", "q"]
    whole = belongs.join(texts, "short").select(*where, "id", "line").repartition(*where).sortWithinPartitions(*where)
    return map_arrow(whole, verify, "a binary, b binary").distinct()


def classify_lines(docs: DataFrame, text: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row per line that is not blank: id, line_no (from 0), component, n_lines, keep_id, keep_line_no, kept.

    ``component`` names the group of linked lines (hex); ``n_lines`` counts its lines, copies
    included; the kept line is the first by (id, line number), null ids first. Null and empty
    texts have no lines. Rows that repeat an id count as versions of one document: their equal
    lines of equal number are one line. An empty table gives an empty table.
    """
    source = docs.select(id_col, text)
    schema = docs.select(id_col).schema.add("line_no", "integer").add("line", "binary")

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text, 2 << 20):
                rows, numbers, ids = [], [], []
                for k, value in enumerate(part.column(text).cast(pa.large_binary())):
                    for n, line in lines_of(value.as_py()):
                        rows.append(k)
                        numbers.append(n)
                        ids.append(_id(line))
                yield pa.RecordBatch.from_arrays([part.column(id_col).take(pa.array(rows, pa.int32())), pa.array(numbers, pa.int32()), pa.array(ids, pa.binary())], [id_col, "line_no", "line"])

    roots = connected_components(line_links(docs, text, threshold)).withColumnRenamed("node", "line")
    lines = map_arrow(source, occurrences, schema).join(roots, "line", "left")
    lines = lines.select(F.col(id_col).alias("__id"), "line_no", F.coalesce("root", "line").alias("root"))
    many = lines.groupBy("root").agg(F.min(F.struct("__id", "line_no")).alias("first"), F.count("*").alias("n_lines")).where("n_lines > 1")
    # cut, so that the join has a plain shuffle on both sides and adaptive execution can split a hot line
    out = lines.join(cut(many), "root", "left")
    first = lambda c: F.when(F.col("n_lines").isNull(), F.col(c)).otherwise(F.col(f"first.{c}"))  # noqa: E731  no group: the line itself
    out = out.select("__id", "line_no", "root", F.coalesce("n_lines", F.lit(1).cast("long")).alias("n_lines"), first("__id").alias("keep_id"), first("line_no").alias("keep_line_no"))
    out = out.withColumn("kept", F.col("__id").eqNullSafe(F.col("keep_id")) & (F.col("line_no") == F.col("keep_line_no")))
    return out.select(
        F.col("__id").alias(id_col), "line_no", F.lower(F.hex("root")).alias("component"), "n_lines",
        "keep_id", "keep_line_no", "kept",
    )


def _kept_lines(text: Column, dropped: Column) -> Column:
    """The text's lines but for those numbered ``dropped``, in time linear in both."""
    numbers = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), dropped)
    kept = lambda lines: F.array_join(F.transform(numbers(lines), lambda k: F.get(lines, k)), "\n")
    return F.get(F.transform(F.array(F.split(text, "\n")), kept), 0)  # a lambda's variable, so the text is split once


def dedup_lines(docs: DataFrame, text: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """All rows and columns, the text without its dropped lines; a text that loses none is untouched, null stays null.

    A row loses only its own lines: rows of a null or repeated id are documents of their own. Of
    linked lines the first by (id, row as written, line number) stays.
    """
    rows = with_rows(docs)
    keyed = rows.select(F.struct(F.col(id_col).alias("id"), F.col("__row").alias("row")).alias("__key"), text)
    lost = classify_lines(keyed, text, "__key", threshold).where("not kept").groupBy(F.col("__key.row").alias("__row")).agg(F.collect_set("line_no").alias("__dropped"))
    joined = rows.join(lost, "__row", "left")
    return joined.withColumn(text, F.when(F.col("__dropped").isNull(), F.col(text)).otherwise(_kept_lines(F.col(text), F.col("__dropped")))).select(docs.columns)
