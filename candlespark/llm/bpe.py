"""Byte-level BPE through a table of distinct words.

Spark splits texts into words; each distinct word is encoded once; ids come back to the words'
positions; decoding joins ids to their pieces. To keep word occurrences off the network, texts
are taken in packs of about ``PACK_BYTES``:

1. A pack splits its texts and numbers its distinct words, the most frequent first. It is written
   to the shared folder once, bucketed by pack: every text as compressed word numbers, and the
   distinct words, dealt to the buckets of their hashes. Later steps read that, so texts are
   split once, and a source that gives other rows when read again does no harm.
2. The words go to their buckets: one compressed row for each pack and bucket, never a row for
   each occurrence. No key is hot: a word, however common, is sent once by a pack. A bucket
   encodes each distinct word once and answers each pack with the words' ids.
3. A pack's texts, as word numbers, meet the answers (a cogroup by pack, for which only answers
   are shuffled): ids are joined back by position, and the decoded text is made from those ids
   alone, each joined to its piece.

Both joins of step 3 are Arrow ``take`` on tables of one pack or of the vocabulary, as a row for
each token would be many times the size of the corpus.

Splitting follows the pattern of this family of vocabularies. It tells letters, numbers,
whitespace and the rest apart; what a code point is, the vocabulary's own pre-tokeniser says,
once for each code point that occurs. Word edges are then found for a block of texts at a time.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NullType, StructType

from candlespark.llm.common import bucketed, map_arrow

PACK_BYTES = 32 << 20
#: Most buckets of packs, as Spark allows.
MAX_PACK_BUCKETS = 100_000
#: Bytes of text whose word edges are found together, and whose word numbers are one compressed block.
BLOCK_BYTES = 1 << 20
#: Documents for each bucket of words, and the least and most buckets.
BUCKET_DOCS, MIN_BUCKETS, MAX_BUCKETS = 1000, 64, 16_384

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
#: Where a long text may be cut: before a space between two visible characters, where a word begins whatever stands around it.
_CUT = re.compile(rb"[!-~](?= [!-~])")


class _Codec:
    """A vocabulary, its pieces by id, and the kinds of code points that were asked for so far."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(spec)
        added = {t.content for t in self.tok.get_added_tokens_decoder().values()}
        self.added = re.compile(b"|".join(re.escape(n.encode()) for n in sorted(added, key=len, reverse=True))) if added else None
        self.divisible = not any(" " in n for n in added)
        to_byte = {c: b for b, c in _byte_letters().items()}
        pieces = [b""] * self.tok.get_vocab_size(with_added_tokens=True)
        for piece, i in self.tok.get_vocab(with_added_tokens=True).items():
            known = piece not in added and all(c in to_byte for c in piece)
            pieces[i] = bytes(to_byte[c] for c in piece) if known else piece.encode()
        self.pieces = pa.array(pieces, pa.large_binary())
        self.kinds = np.zeros(0x110000, np.int8)

    def kinds_of(self, points: np.ndarray) -> np.ndarray:
        """LETTER, NUMBER, SPACE or OTHER for each code point."""
        found = self.kinds[points]
        if not found.all():
            split = self.tok.pre_tokenizer.pre_tokenize_str
            for p in np.unique(points[found == 0]).tolist():
                # it is of the kind of the neighbours that it makes one word with
                self.kinds[p] = next((kind for kind, x in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(split(x + chr(p) + x)) == 1), SPACE)
            found = self.kinds[points]
        return found


@lru_cache(2)
def _codec(spec: str) -> _Codec:
    return _Codec(spec)


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def require_byte_level(spec: str) -> None:
    """Refuse a vocabulary that this operator's splitting does not fit."""
    parts = json.loads(spec)
    pre = parts.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and parts.get("normalizer") is None
    strict = all(not (t["single_word"] or t["lstrip"] or t["rstrip"]) for t in parts.get("added_tokens", []))
    if not (plain and strict and parts["model"]["type"] == "BPE"):
        raise ValueError("the vocabulary must be byte-level BPE without normaliser, prefix space or stripping added tokens")


def word_begins(points: np.ndarray, kinds: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where words begin; ``first`` marks the beginnings of texts.

    A word is a run of one kind, with the single U+0020 before it if there is one; an apostrophe
    after no such space, with s, t, m, d, re, ve or ll after it; or a run of whitespace, which
    leaves its last character to itself or to the next word where one follows.
    """
    n = len(points)
    run = first.copy()
    run[1:] |= kinds[1:] != kinds[:-1]
    blank = kinds == SPACE
    before_word = np.zeros(n, bool)
    before_word[:-1] = blank[:-1] & ~blank[1:] & ~first[1:]
    joined = np.zeros(n, bool)
    joined[1:] = before_word[:-1] & (points[:-1] == 32)
    begins = run & ~joined | before_word
    mark = np.flatnonzero((points == ord("'")) & begins & run)
    if len(mark):
        wide, ends = np.concatenate([points, [0, 0]]), np.concatenate([first, [True, True]])
        a, b = wide[mark + 1], wide[mark + 2]
        one = ~ends[mark + 1] & np.isin(a, [ord(c) for c in "stmd"])
        two = ~ends[mark + 1] & ~ends[mark + 2] & np.isin(a * 256 + b, [ord(c) * 256 + ord(d) for c, d in ("re", "ve", "ll")])
        begins[mark[one | two] + 1] = False
        after = np.concatenate([mark[one] + 2, mark[two] + 3])
        begins[after[after < n]] = True
    return begins


def split_block(raw: np.ndarray, at: np.ndarray, codec: _Codec) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The words of the texts ``raw[at[i] : at[i + 1]]`` in order, and the number of words of each text."""
    body = raw.tobytes()
    points = np.frombuffer(body.decode().encode("utf-32-le"), np.uint32)
    place = np.flatnonzero((raw & 0xC0) != 0x80)
    first = np.zeros(len(points) + 1, bool)
    first[np.searchsorted(place, at[:-1])] = True  # that of an empty text is the next text's, or the end
    found = [m.span() for s, e in zip(at[:-1].tolist(), at[1:].tolist()) for m in codec.added.finditer(body, s, e)] if codec.added and codec.added.search(body) else []
    spans = np.searchsorted(place, np.array(found, np.int64).reshape(-1, 2))
    first[spans.ravel()] = True
    begins = word_begins(points, codec.kinds_of(points), first[:-1])
    for s, e in spans:
        begins[s + 1 : e] = False
    starts = place[begins]
    edges = np.append(starts, len(raw)).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(body)])
    return words, np.diff(np.searchsorted(starts, at))


def _segments(text: bytes, divisible: bool) -> Iterator[bytes]:
    """``text`` in parts of about ``BLOCK_BYTES`` that split alone as they do together."""
    at = 0
    while divisible and len(text) - at > 2 * BLOCK_BYTES and (m := _CUT.search(text, at + BLOCK_BYTES)):
        yield text[at : m.end()]
        at = m.end()
    yield text[at:]


def _words_of(texts: list[bytes], codec: _Codec) -> Iterator[tuple[pa.LargeBinaryArray, np.ndarray]]:
    """(words, words of each text) of blocks of ``texts``; a long text's later parts count for a text each, so its block is its own."""
    held: list[bytes] = []
    size = 0

    def block(parts: list[bytes]) -> tuple[pa.LargeBinaryArray, np.ndarray]:
        at = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])
        return split_block(np.frombuffer(b"".join(parts), np.uint8), at, codec)

    for text in texts:
        if len(text) > 2 * BLOCK_BYTES:
            if held:
                yield block(held)
                held, size = [], 0
            parts = [block([p]) for p in _segments(text, codec.divisible)]
            yield pa.concat_arrays([w for w, _ in parts]), np.array([sum(int(n[0]) for _, n in parts)])
            continue
        held.append(text)
        size += len(text)
        if size >= BLOCK_BYTES:
            yield block(held)
            held, size = [], 0
    if held:
        yield block(held)


def split_words(text: str, spec: str) -> list[str]:
    """The pieces that the vocabulary encodes one by one; added tokens are pieces of their own."""
    return [w.decode() for words, _ in _words_of([text.encode()], _codec(spec)) for w in words.to_pylist()]


def encode_words(words: list[str], spec: str) -> list[list[int]]:
    """Ids of each word, encoded on its own."""
    return [e.ids for e in _codec(spec).tok.encode_batch_fast(words, add_special_tokens=False)]


def _squeeze(numbers: np.ndarray) -> bytes:
    """32-bit numbers as compressed byte planes."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unsqueeze(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, 4 * n, "zstd", asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel()


def _binary(parts: list[bytes]) -> pa.LargeBinaryArray:
    return pa.array(parts, pa.large_binary())


def _bounds(array: pa.LargeBinaryArray) -> tuple[np.ndarray, memoryview]:
    """(offsets, bytes) of an array that is no slice."""
    _, offsets, data = array.buffers()
    return np.frombuffer(offsets, np.int64)[: len(array) + 1] if len(array) else np.zeros(1, np.int64), memoryview(data or b"")


def _flat(array: pa.Array | pa.ChunkedArray) -> pa.LargeBinaryArray:
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    return pa.concat_arrays([array]) if array.offset else array


def _pack_words(blocks: list[pa.LargeBinaryArray], buckets: int) -> tuple[list[np.ndarray], np.ndarray, list[dict]]:
    """(word numbers of each block, bucket of each number, the words for each bucket), numbered from the most frequent on."""
    coded = pa.chunked_array(blocks, pa.large_binary()).dictionary_encode()
    indices = [c.indices.to_numpy(zero_copy_only=False) for c in coded.chunks]
    words = coded.chunk(0).dictionary.to_pylist() if coded.num_chunks else []
    count = sum((np.bincount(i, minlength=len(words)) for i in indices), np.zeros(len(words), np.int64))
    order = np.argsort(-count, kind="stable")
    number = np.empty(len(words), np.uint32)
    number[order] = np.arange(len(words))
    words = [words[i] for i in order.tolist()]
    bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.uint16, len(words))
    order = np.argsort(bucket, kind="stable")
    some, at = np.unique(bucket[order], return_index=True)
    sent = []
    for b, s, e in zip(some.tolist(), at.tolist(), [*at[1:].tolist(), len(words)]):
        own = [words[i] for i in order[s:e].tolist()]
        body = np.fromiter(map(len, own), "<u4", len(own)).tobytes() + b"".join(own)
        sent.append({"bucket": b, "n": len(own), "size": len(body), "words": pa.compress(body, "zstd", asbytes=True)})
    return [number[i] for i in indices], bucket, sent


_SENT = pa.list_(pa.struct([("bucket", pa.int32()), ("n", pa.int32()), ("size", pa.int64()), ("words", pa.binary())]))
#: Columns of a written pack beside the kept ones. What a pack or a block has once stands in its first row.
_PACK = {"pack": ("long", pa.int64()), "block": ("int", pa.int32()), "at": ("int", pa.int32()), "n": ("long", pa.int64()), "total": ("long", pa.int64()), "numbers": ("binary", pa.binary()), "n_words": ("int", pa.int32()), "buckets": ("binary", pa.binary()), "sent": ("array<struct<bucket:int,n:int,size:bigint,words:binary>>", _SENT)}


def _split(batches: Iterator[pa.RecordBatch], kept: list[str], buckets: int, spec: str, pack_bytes: int) -> Iterator[pa.RecordBatch]:
    """The packs of a task: its rows without their texts, split."""
    codec, part, k = _codec(spec), TaskContext.get().partitionId(), 0
    rows: list[pa.RecordBatch] = []
    blocks: list[pa.LargeBinaryArray] = []
    counts: list[np.ndarray] = []
    size = 0

    def pack() -> Iterator[pa.RecordBatch]:
        numbers, bucket, sent = _pack_words(blocks, buckets)
        heads = {"n_words": len(bucket), "buckets": pa.compress(bucket.astype("<u2").tobytes(), "zstd", asbytes=True), "sent": sent}
        table = pa.Table.from_batches(rows).combine_chunks() if kept else None
        low = 0
        for b, (own, n) in enumerate(zip(numbers, counts)):
            rest = [None] * (len(n) - 1)
            columns = [*(table.slice(low, len(n)).combine_chunks().columns if kept else [])]
            values = {"pack": [part << 32 | k] * len(n), "block": [b] * len(n), "at": range(len(n)), "n": n, "total": [len(own), *rest], "numbers": [_squeeze(own), *rest]}
            values |= {c: [v if b == 0 else None, *rest] for c, v in heads.items()}
            columns += [pa.array(values[c], kind) for c, (_, kind) in _PACK.items()]
            yield from pa.Table.from_arrays(columns, [*kept, *_PACK]).to_batches()
            low += len(n)

    for batch in batches:
        low = 0
        texts = [v.as_py() or b"" for v in batch.column("text").cast(pa.large_binary())]
        for words, n in _words_of(texts, codec):
            blocks.append(words)
            counts.append(n)
            if kept:
                rows.append(batch.select(kept).slice(low, len(n)))
            low += len(n)
            size += int(_bounds(words)[0][-1])
            if size >= pack_bytes:
                yield from pack()
                k, rows, blocks, counts, size = k + 1, [], [], [], 0
    if blocks:
        yield from pack()


def _encode_buckets(batches: Iterator[pa.RecordBatch], spec: str) -> Iterator[pa.RecordBatch]:
    """Answers for rows that come sorted by bucket; the ids of words are remembered while their bucket lasts."""
    now, known = None, {}
    for batch in batches:
        out = []
        for bucket, rows in groupby(batch.to_pylist(), key=lambda r: r["bucket"]):
            rows = list(rows)
            if bucket != now:
                now, known = bucket, {}
            words = []
            for r in rows:
                body = pa.decompress(r["words"], r["size"], "zstd", asbytes=False)
                edges = np.concatenate([[4 * r["n"]], 4 * r["n"] + np.cumsum(np.frombuffer(body, "<u4", r["n"]), dtype=np.int64)])
                words.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), r["n"], [None, pa.py_buffer(edges), body]))
            coded = pa.chunked_array(words, pa.large_binary()).dictionary_encode()
            names = coded.chunk(0).dictionary.to_pylist()
            fresh = [w for w in names if w not in known]
            for w, found in zip(fresh, encode_words([w.decode() for w in fresh], spec) if fresh else []):
                known[w] = np.array(found, "<u4").tobytes()
            ids = _binary([known[w] for w in names])
            for r, c in zip(rows, coded.chunks):
                at, flat = _bounds(ids.take(c.indices))
                flat = np.frombuffer(flat, "<u4")[: at[-1] >> 2]
                out.append((r["pack"], bucket, r["n"], len(flat), _squeeze(np.diff(at) >> 2), _squeeze(flat)))
        kinds = {"pack": pa.int64(), "bucket": pa.int32(), "n": pa.int32(), "m": pa.int64(), "counts": pa.binary(), "ids": pa.binary()}
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * len(kinds), kinds.values())], list(kinds))


def _word_ids(head: dict, answers: pa.Table) -> pa.LargeBinaryArray:
    """The ids of a pack's words by their number, as bytes."""
    n_words = head["n_words"]
    bucket = np.frombuffer(pa.decompress(head["buckets"], 2 * n_words, "zstd", asbytes=True), "<u2") if n_words else np.zeros(0, "<u2")
    rows = answers.sort_by("bucket").to_pylist()
    counts = np.concatenate([np.zeros(0, np.uint32)] + [_unsqueeze(a["counts"], a["n"]) for a in rows])
    flat = np.concatenate([np.zeros(0, "<u4")] + [_unsqueeze(a["ids"], a["m"]) for a in rows]).astype("<u4")
    if len(counts) != n_words:
        raise RuntimeError(f"a pack of {n_words} words got the ids of {len(counts)}")
    edges = np.concatenate([[0], 4 * np.cumsum(counts, dtype=np.int64)])
    by_bucket = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n_words, [None, pa.py_buffer(edges), pa.py_buffer(flat)])
    place = np.empty(n_words, np.int64)
    place[np.argsort(bucket, kind="stable")] = np.arange(n_words)
    return by_bucket.take(pa.array(place))


def _join_back(rows: pa.Table, answers: pa.Table, kept: list[str], kinds: dict[str, pa.DataType], spec: str) -> pa.Table:
    """A pack's texts as ids, and as the text that those ids decode to."""
    pieces = _codec(spec).pieces
    rows = rows.sort_by([("block", "ascending"), ("at", "ascending")])
    heads = {c: [v for v in rows[c].to_pylist() if v is not None] for c in ("total", "numbers", "n_words", "buckets")}
    if not rows.num_rows:
        return pa.table({c: rows[c] for c in kept} | {k: pa.array([], t) for k, t in kinds.items()})
    word_ids = _word_ids({c: heads[c][0] for c in ("n_words", "buckets")}, answers)
    n, block = rows["n"].to_numpy(), rows["block"].to_numpy()
    first = np.flatnonzero(np.diff(block, prepend=-1))
    digests: dict[str, list[str]] = {"ids_sha256": [], "decoded_sha256": []}
    many, chunks = [], []
    for s, e, total, numbers in zip(first, np.append(first[1:], len(n)), heads["total"], heads["numbers"]):
        at, flat = _bounds(_flat(word_ids.take(pa.array(_unsqueeze(numbers, total)))))
        edges = at[np.concatenate([[0], np.cumsum(n[s:e])])]
        digests["ids_sha256"] += [hashlib.sha256(flat[a:b]).hexdigest() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
        ids = np.frombuffer(flat, "<u4")[: edges[-1] >> 2]
        spelt, text = _bounds(_flat(pieces.take(pa.array(ids))))
        words = spelt[edges >> 2]
        for a, b in zip(words[:-1].tolist(), words[1:].tolist()):
            digests["decoded_sha256"].append(hashlib.sha256(bytes(text[a:b]).decode("utf-8", "replace").encode()).hexdigest())
        many.append(np.diff(edges) >> 2)
        if "ids" in kinds:
            chunks.append(pa.ListArray.from_arrays(pa.array((edges >> 2).astype(np.int32)), pa.array(ids.astype(np.int32))))
    made = {"n_tokens": pa.array(np.concatenate(many), pa.int64())} | {k: pa.array(v, pa.string()) for k, v in digests.items()}
    if "ids" in kinds:
        made["ids"] = pa.chunked_array(chunks, kinds["ids"])
    return pa.table({c: rows[c] for c in kept} | {k: made[k] for k in kinds})


def encode(docs: DataFrame, tokenizer_path: str, text: str = "text", keep: list[str] | None = None, ids: bool = True) -> DataFrame:
    """The ``keep`` columns (default: all) with n_tokens, ids_sha256, decoded_sha256 and, if asked for, ``ids``.

    Encodes like the tokenizers library with add_special_tokens=False and decodes like its
    decode(ids, skip_special_tokens=False). A null text counts as empty: no ids. Rows are
    independent, so ties and repeated rows each get their answer; a table without rows gives
    none. A long text is split in parts of bounded size. Input columns with the names of output
    columns are replaced; other names do not matter. Splitting runs when this is called, and is
    written to the shared folder.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    require_byte_level(spec)
    spark = docs.sparkSession
    types = {"n_tokens": ("long", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())} | ({"ids": ("array<int>", pa.list_(pa.int32()))} if ids else {})
    keep = [c for c in (docs.columns if keep is None else keep) if c not in types]
    none = [c for c in keep if isinstance(docs.schema[c].dataType, NullType)]  # there are no files of them
    inner = {c: f"c{k}" for k, c in enumerate(keep) if c not in none}
    source = docs.select(*(F.col(f"`{c}`").alias(a) for c, a in inner.items()), F.col(text).alias("text"))
    kept = list(inner.values())
    n_docs, n_bytes = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    buckets = min(MAX_BUCKETS, max(MIN_BUCKETS, 1 << int(n_docs // BUCKET_DOCS).bit_length()))
    shared = spark.sparkContext.broadcast(spec)
    schema = source.select(*kept).schema
    schema = StructType([*schema, *StructType.fromDDL(", ".join(f"{name} {kind}" for name, (kind, _) in _PACK.items()))])
    split = map_arrow(source, lambda batches: _split(batches, kept, buckets, shared.value, PACK_BYTES), schema)
    packs = bucketed(split, "pack", max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MAX_PACK_BUCKETS, 2 * n_bytes // PACK_BYTES)), "bpe-packs")
    sent = packs.where("sent IS NOT NULL").select("pack", F.explode("sent").alias("s")).select("pack", "s.bucket", "s.n", "s.size", "s.words")
    sent = sent.repartition("bucket").sortWithinPartitions("bucket")
    answers = map_arrow(sent, lambda batches: _encode_buckets(batches, shared.value), "pack long, bucket int, n int, m long, counts binary, ids binary")
    result = StructType([*source.select(*kept).schema, *StructType.fromDDL(", ".join(f"{name} {kind}" for name, (kind, _) in types.items()))])
    kinds = {k: t for k, (_, t) in types.items()}
    texts = packs.drop("sent")
    out = texts.groupBy("pack").cogroup(answers.groupBy("pack")).applyInArrow(lambda a, b: _join_back(a, b, kept, kinds, shared.value), result)
    return out.select(*(F.lit(None).alias(c) if c in none else F.col(inner[c]).alias(c) for c in keep), *types)


def decode(tokens: DataFrame, tokenizer_path: str, ids: str = "ids", name: str = "text") -> DataFrame:
    """All columns with ``name``, the text of the ``ids`` array: each id is joined to its piece.

    Bytes that are no UTF-8 become U+FFFD, as the library decodes. Null arrays give null, empty
    ones the empty text; an id outside the vocabulary ends the job.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = tokens.sparkSession.sparkContext.broadcast(f.read())
    names = [c for c in tokens.columns if c != name]

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _codec(shared.value).pieces
        for batch in batches:
            column = batch.column(ids)
            flat = column.flatten()
            at, raw = _bounds(_flat(pieces.take(flat)))
            edges = at[np.concatenate([[0], np.cumsum(np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))])].tolist()
            texts = [None if missing else bytes(raw[a:b]).decode("utf-8", "replace") for a, b, missing in zip(edges[:-1], edges[1:], column.is_null().to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.string())], [*names, name])

    return map_arrow(tokens, answer, tokens.select(*names).schema.add(name, "string"))
