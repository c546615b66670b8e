"""Exact deduplication by an exchange of Golomb-coded fingerprints.

1. Every sender (a partition, or as many as have ``MESSAGE_TEXTS`` texts for each owner) hashes its normalised
   texts, cuts the hashes to fingerprints, sorts them and
   sends each owner (a range of fingerprints) its part, Golomb-Rice coded: about ``SLACK`` + 2
   bits a text instead of 64.
2. An owner merges what it got and answers every sender with a bitmap: which of the sent
   fingerprints another sender has too. Ids and hashes stay where they are: they are written bucketed by sender,
   so that the bitmaps come to them.
3. A text whose fingerprint nobody else has is unique; nothing of it is shuffled. Suspects alone are
   shuffled, as whole normalised texts, and compared byte by byte: they are grouped by the text
   itself after a map-side pre-aggregation, so a group of copies of any size arrives as one row
   from each task.

A false alarm (two texts, one fingerprint) only costs its shuffle: groups are of equal texts. Rows
find their group again by a 64-bit hash and the SHA-256 of their text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlespark.llm.common import ascii_lower, bucketed, cut, screened

#: Fingerprint bits beyond log2 of the number of texts: a unique text is a false suspect with probability 2**-SLACK at most.
SLACK = 12
#: Texts that one owner is to handle, the least number of owners, and texts that a message to one holds on average at least.
OWNER_TEXTS, MIN_OWNERS, MESSAGE_TEXTS = 1 << 22, 64, 64


def rice_encode(values: np.ndarray, low_bits: int) -> tuple[bytes, bytes]:
    """Sorted distinct values as (unary quotients, binary remainders) of their gaps."""
    gaps = np.diff(values, prepend=np.uint64(0))
    quotient = (gaps >> np.uint64(low_bits)).astype(np.int64)
    unary = np.zeros(int(quotient.sum()) + len(values), bool)
    unary[np.cumsum(quotient + 1) - 1] = True
    shifts = np.arange(low_bits, dtype=np.uint64)
    rest = (gaps[:, None] >> shifts & np.uint64(1)).astype(bool)
    return np.packbits(unary).tobytes(), np.packbits(rest).tobytes()


def rice_decode(unary: bytes, rest: bytes, n: int, low_bits: int) -> np.ndarray:
    """The values that :func:`rice_encode` got."""
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    quotient = np.diff(ends, prepend=-1) - 1
    bits = np.unpackbits(np.frombuffer(rest, np.uint8), count=n * low_bits).reshape(n, low_bits).astype(np.uint64)
    low = (bits << np.arange(low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64) if low_bits else np.zeros(n, np.uint64)
    return np.cumsum((quotient.astype(np.uint64) << np.uint64(low_bits)) + low, dtype=np.uint64)


def _layout(rows: int) -> tuple[int, int]:
    """(owner bits, fingerprint bits within an owner) for so many texts."""
    owners = max(MIN_OWNERS, -(-rows // OWNER_TEXTS))
    owner_bits = int(owners - 1).bit_length()
    return owner_bits, max(8, int(rows).bit_length() + SLACK - owner_bits)


def _senders(rows: int, parts: int, owner_bits: int) -> tuple[int, int]:
    """(partitions of a sender, senders): so many that a message has enough texts to be coded, but at least eight senders where there are partitions."""
    share = -(-((MESSAGE_TEXTS << owner_bits) * parts) // max(1, rows))
    share = max(1, min(share, parts // 8))
    return share, max(1, -(-parts // share))


def _low_bits(bits: int, n: int) -> int:
    """Remainder bits that suit ``n`` sorted values among 2**bits."""
    return max(0, bits - max(1, n).bit_length())


def _parts(hashes: np.ndarray, owner_bits: int, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(owner, sorted distinct fingerprints, how often each occurs) for a partition's hashes."""
    top = hashes.view(np.uint64) >> np.uint64(64 - owner_bits - bits)
    values, counts = np.unique(top, return_counts=True)
    owner = (values >> np.uint64(bits)).astype(np.int64)
    for o in np.unique(owner):
        s, e = np.searchsorted(owner, [o, o + 1])
        yield int(o), values[s:e] & np.uint64((1 << bits) - 1), counts[s:e]


def duplicate_classes(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after A-Z are lower-cased; null counts as empty. Of equal
    texts the row with the largest id stays; where that id repeats, all its rows are marked
    kept. A group whose ids are all null has a null keep_id and its rows count as kept. An
    empty table gives an empty table. Other columns are not read.
    """
    norm = ascii_lower(F.coalesce(F.col(text), F.lit("")))
    hashed = docs.select(F.col(id_col).alias("id"), norm.alias("norm"))
    sizes = docs.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n")).agg(F.count("*").alias("parts"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    owner_bits, bits = _layout(sizes["rows"])
    share, senders = _senders(sizes["rows"], sizes["parts"], owner_bits)
    sender = F.floor(F.spark_partition_id() / F.lit(share)).cast("int")
    narrow = bucketed(hashed.select("id", F.xxhash64("norm").alias("h"), F.unhex(F.sha2("norm", 256)).alias("sha"), sender.alias("part")), "part", senders, "fingerprints")

    # 1: senders to owners
    def send(table: pa.Table) -> pa.Table:
        rows = [(o, len(v), *rice_encode(v, _low_bits(bits, len(v)))) for o, v, _ in _parts(table["h"].to_numpy(), owner_bits, bits)]
        kinds = {"owner": pa.int32(), "n": pa.int32(), "unary": pa.binary(), "rest": pa.binary()}
        return pa.table([*(pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())), pa.repeat(table["part"][0], len(rows))], [*kinds, "part"])

    messages = narrow.select("part", "h").groupBy("part").applyInArrow(send, "owner int, n int, unary binary, rest binary, part int")

    # 2: owners to senders: a bit for each fingerprint, set where another sender has it too
    def answer(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        got = [rice_decode(r["unary"], r["rest"], r["n"], _low_bits(bits, r["n"])) for r in rows]
        values, counts = np.unique(np.concatenate(got), return_counts=True)
        shared = values[counts > 1]
        marks = [np.packbits(np.isin(g, shared, assume_unique=True)).tobytes() for g in got]
        return pa.table({"owner": table["owner"], "part": table["part"], "marks": pa.array(marks, pa.binary())})

    bitmaps = messages.groupBy("owner").applyInArrow(answer, "owner int, part int, marks binary")

    # each sender reads its bitmaps
    def mark(rows: pa.Table, maps: pa.Table) -> pa.Table:
        h = rows["h"].to_numpy()
        marks = dict(zip(maps["owner"].to_pylist(), maps["marks"].to_pylist()))
        top = h.view(np.uint64) >> np.uint64(64 - owner_bits - bits)
        suspect = np.zeros(len(h), bool)
        order = np.argsort(top, kind="stable")
        sent = list(_parts(h, owner_bits, bits))
        values = [v | np.uint64(o << bits) for o, v, _ in sent]
        flags = [np.unpackbits(np.frombuffer(marks[o], np.uint8), count=len(v)).astype(bool) | (c > 1) for o, v, c in sent]
        if values:
            suspect[order] = np.concatenate(flags)[np.searchsorted(np.concatenate(values), top[order])]
        return pa.table({"id": rows["id"], "h": rows["h"], "sha": rows["sha"], "suspect": pa.array(suspect)})

    schema = narrow.select("id", "h", "sha").schema.add("suspect", "boolean")
    marked = cut(narrow.groupBy("part").cogroup(bitmaps.groupBy("part")).applyInArrow(mark, schema))

    # 3: suspects' texts. A bitmap keeps most others out before the shuffle.
    held = marked.where("suspect").select("h")
    suspects = screened(hashed.select("norm", "id", F.xxhash64("norm").alias("h")), held, "h", held.count())
    classes = suspects.groupBy("h", "norm").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    classes = classes.select("h", F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size")
    alone = marked.where("not suspect").select("id", "sha", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    found = marked.where("suspect").join(classes, ["h", "sha"]).select("id", "sha", "keep_id", "group_size")
    both = alone.unionByName(found)
    return both.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
