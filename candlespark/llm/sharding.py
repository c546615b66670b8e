"""Sharding by a k-d tree over metadata, balanced by bytes.

The tree starts with all documents and the wanted number of shards. A node for k shards is
split at the distributed weighted median (for odd k: the k//2 : k - k//2 quantile) of bytes
along its widest metadata dimension, until every node is one shard of the target bytes.

Dimensions are scaled to 30 bits: text length (by logarithm), id, and hashes of source and
language. A split key is the coordinate with 32 bits of a hash of id and text below it, so a value that a
third of all rows share is cut inside. Where a split falls on one key that many rows have, which repeat each other, it is
refined by a hash of the row's number as written. Quantiles are found by histogram refinement: each pass
counts bytes in ``BINS`` bins of every node's open interval. What reaches the driver is bins and
bounds of nodes, bounded by the number of shards; rows are never moved to find a split.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlespark.llm.common import cut

BINS = 1024
#: A split is final when it is this share of a shard's target from the exact quantile.
TOLERANCE = 0.0005
OVERHEAD = 16
LAW = "bytes"
SCALE = 1 << 30
#: Rows of a shard that one task numbers, and the least number of such parts of a shard.
PART_ROWS, MIN_PARTS = 50_000, 64


@dataclass
class _Node:
    leaves: int
    first: int  # shard number of its first leaf
    dim: int = 0
    low: int = 0
    high: int = 0
    goal: float = 0.0
    below: int = 0
    split: int | None = None
    #: the key inside which the split lies, if one key alone is too heavy, and the first row hash that goes right there
    inside: int | None = None
    sub: int = 0


def _metadata(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """id, size, text_crc32, a 32-bit tie hash and the coordinates d0, d1, ..."""
    raw = F.coalesce(F.col(text), F.lit(""))
    has = {f.name.lower() for f in docs.schema}
    number = dict(docs.dtypes)[id_col] in ("bigint", "int", "smallint", "tinyint")
    place = F.coalesce(F.col(id_col), F.lit(0)).cast("long") if number else F.xxhash64(id_col)
    hashes = [F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")) for c in ("source", "lang") if c in has]
    return docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(raw) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(raw.cast("binary")).alias("text_crc32"),
        (F.xxhash64(F.col(id_col).cast("string"), raw).bitwiseAND(F.lit(0xFFFFFFFF))).alias("tie"),
        (F.log2(F.length(raw) + F.lit(1)) / 31 * SCALE).cast("long").alias("d0"),
        place.alias("place"),
        F.monotonically_increasing_id().alias("row"),  # read as written: the table is cut at once
        *(F.shiftright(h, 2).alias(f"d{k}") for k, h in enumerate(hashes, 2)),
    )


def _by_node(values: list[int]) -> F.Column:
    """The value of the row's node: a look-up in a constant array, one entry for each node of the level."""
    return F.get(F.lit(values), F.col("node"))


def _sub() -> F.Column:
    """A hash of the row, 62 bits, below the split key."""
    return F.shiftrightunsigned(F.xxhash64("row"), 2)


def _key(nodes: list[_Node], dims: int) -> F.Column:
    """The split key along the dimension of the row's node."""
    coordinate = F.get(F.array(*(f"d{d}" for d in range(dims))), _by_node([n.dim for n in nodes]))
    return F.shiftleft(coordinate, 32) + F.col("tie")


def kd_tree_shards(docs: DataFrame, shards: int = 40, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard (0 to shards - 1), slot (gapless from 0 in a shard), grown_shard (null).

    The law is ``bytes``: shards differ from total / shards by about the largest row along
    their splits. A null text has no bytes (size 16); null metadata is a value of its own;
    repeated rows share their split key and are parted by their numbers as written, so any number of them is cut; with fewer rows than shards some
    shards stay empty; an empty table gives an empty table. Columns source and lang are used if
    present, other columns are not read.
    """
    narrow = cut(_metadata(docs, text, id_col))
    total = narrow.agg(F.min("place"), F.max("place"), F.sum("size"), F.count("*")).first()
    span = max(1, (total[1] or 0) - (total[0] or 0))
    rows = narrow.withColumn("d1", ((F.col("place").cast("double") - (total[0] or 0)) / span * (SCALE - 1)).cast("long")).withColumn("node", F.lit(0)).drop("place")
    dims = sum(c[0] == "d" and c[1:].isdigit() for c in rows.columns)
    target = (total[2] or 0) / shards
    nodes = [_Node(shards, 0)]
    while any(n.leaves > 1 for n in nodes):
        spread = [f(f"d{d}").alias(f"{n}{d}") for d in range(dims) for n, f in (("low", F.min), ("high", F.max))]
        seen = {r["node"]: r for r in rows.groupBy("node").agg(F.sum("size").alias("bytes"), *spread).collect()}
        for k, n in enumerate(nodes):
            r = seen.get(k)
            if n.leaves == 1 or r is None:  # done, or without rows: all of nothing goes left
                n.split = 1 << 62
                continue
            n.dim = max(range(dims), key=lambda d: r[f"high{d}"] - r[f"low{d}"])
            n.low, n.high = r[f"low{n.dim}"] << 32, (r[f"high{n.dim}"] << 32) + 0xFFFFFFFF
            n.goal = r["bytes"] * (n.leaves // 2) / n.leaves
        _find_splits(rows, nodes, dims, TOLERANCE * target)
        key, at = _key(nodes, dims), _by_node([n.split for n in nodes])
        goes_right = ((key > at) | (key == at) & (_sub() >= _by_node([n.sub for n in nodes]))).cast("int")
        rows = cut(rows.withColumn("node", F.col("node") * 2 + goes_right))  # or the key expressions of all levels would nest
        nodes = [child for n in nodes for child in _children(n)]
    placed = rows.select("id", "size", "text_crc32", "tie", "row", _by_node([n.first for n in nodes]).alias("shard"))
    return _numbered(placed, shards, total[3]).select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def _children(n: _Node) -> tuple[_Node, _Node]:
    """A finished leaf goes on as its own left child; its right child gets no rows."""
    left = max(1, n.leaves // 2)
    return _Node(left, n.first), _Node(max(1, n.leaves - left), n.first + (left if n.leaves > 1 else 0))


def _find_splits(rows: DataFrame, nodes: list[_Node], dims: int, tolerance: float) -> None:
    """Give every open node its split: the first key that goes right, and of a key that is cut inside the first row hash."""
    while any(n.split is None for n in nodes):
        step = [-(-(n.high - n.low + 1) // BINS) if n.split is None else 1 for n in nodes]
        low, high = ([v if n.split is None else v2 for n, v, v2 in ((n, getattr(n, name), other) for n in nodes)] for name, other in (("low", 1), ("high", 0)))
        key, cut_inside = _key(nodes, dims), [n.inside if n.inside is not None else -1 for n in nodes]
        if max(cut_inside) >= 0:
            key = F.when(_by_node(cut_inside) < 0, key).when(key == _by_node(cut_inside), _sub())
        inside = (key >= _by_node(low)) & (key <= _by_node(high))
        bin_of = F.when(inside, F.call_function("div", key - _by_node(low), _by_node(step)))
        bins: dict[int, list] = {}
        for r in rows.groupBy("node", bin_of.alias("bin")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect():
            if r["bin"] is not None:
                bins.setdefault(r["node"], []).append((r["bin"], r["bytes"], r["rows"]))
        for k, n in enumerate(nodes):
            if n.split is not None:
                continue
            below, found = n.below, sorted(bins.get(k, []))
            if not found:
                n.split = n.low if n.inside is None else n.inside
            for b, size, count in found:
                if below + size >= n.goal or b == found[-1][0]:
                    start = n.low + b * step[k]
                    short, over = n.goal - below, below + size - n.goal
                    if min(abs(short), abs(over)) <= tolerance or step[k] == 1 and (n.inside is not None or count == 1):
                        where = start if abs(short) <= abs(over) else start + step[k]
                        n.split, n.sub = (where, 0) if n.inside is None else (n.inside, where)
                    elif step[k] == 1:  # many rows with one key, too heavy together
                        n.inside, n.low, n.high, n.below = start, 0, (1 << 62) - 1, below
                    else:
                        n.low, n.high, n.below = start, min(n.high, start + step[k] - 1), below
                    break
                below += size


def _numbered(rows: DataFrame, shards: int, count: int) -> DataFrame:
    """``slot``: a row's number in its shard. A shard is numbered in parts, which begin where the parts before them end."""
    parts = max(MIN_PARTS, count // (shards * PART_ROWS))
    cutup = rows.withColumn("part", F.pmod(F.xxhash64("tie", "row"), F.lit(parts)))
    sizes = cutup.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "part").orderBy("tie", "id", "row")
    return cutup.withColumn("rank", F.row_number().over(within) - 1).join(starts, ["shard", "part"]).withColumn("slot", (F.col("start") + F.col("rank")).cast("long"))
