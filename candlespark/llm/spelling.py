"""Spelling variants: words one inserted, deleted or replaced code point apart, and the common form of each.

1. Texts are cut into letter runs and counted piece by piece in numpy; counts are summed before the
   shuffle.
2. Each word of L code points gets L + 1 keys of 64 bits: of itself, and of itself without its i-th
   code point. Prefix and suffix polynomial hashes give all of them in a few array operations.
3. Keys are dealt out by their leading bits (radix) and sorted; only keys that could make two
   words near go on. Two words differ in the code point at i if they share a key and its i; one is the
   other with one more code point if the key of the one is a deletion key of the other.
4. The rest is decided on strings, whose deletions are compared in full: a collision of hashes only
   costs its rows.

No pairs are made: of words that share a deletion all are near each other, so their number and the most
frequent one say all that a word needs to know. (If it is itself the most frequent, none of the others
has twice its count.) Forms have twice the count of what follows them at least, so chains are short, and
roots are found by pointer jumping.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlespark.llm.common import cut, map_arrow, mix64, pieces, utf8

#: Code points and occurrences that a word has at least, and how many times its count that of its form is.
MIN_POINTS, MIN_COUNT, FORM_TIMES = 5, 3, 2
#: Counted words of one task that are brought together before they leave it.
HELD_WORDS = 1 << 19
#: Keys that one radix group is to hold, and the least number of groups.
RADIX_KEYS, MIN_RADIX = 1 << 18, 512
#: Odd base of the polynomial hash and its inverse, modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Pointer jumping doubles in a round; counts double along a chain, so chains have 64 words at most.
MAX_ROUNDS = 8

Edit = Callable[[object, bytes], int]


def letter_runs(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased: (text, word number) of each, and the words."""
    lower = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    letter = (lower >= 97) & (lower <= 122) | (raw == 0xC3)
    letter[1:] |= raw[:-1] == 0xC3  # these code points are C3 and one more byte, and no other has a C3
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    begins = letter.copy()
    begins[1:] &= ~letter[:-1] | edge[1 : len(raw)]
    start = np.flatnonzero(begins)
    count = np.concatenate([[0], np.cumsum(letter)])
    offsets = np.append(count[start], count[-1])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(lower[letter].tobytes())]).dictionary_encode()
    return np.searchsorted(at, start, "right") - 1, words.indices.to_numpy().astype(np.int64), words.dictionary


def _without(word: bytes, point: int) -> bytes:
    text = word.decode()
    return (text[:point] + text[point + 1 :]).encode()


def _points(words: pa.Array) -> np.ndarray:
    """Code points of each word: its bytes that continue none."""
    raw, at = utf8(words.cast(pa.large_string()))
    count = np.concatenate([[0], np.cumsum(raw & 0xC0 != 0x80)])
    return np.diff(count[at])


def _piece_counts(piece: pa.RecordBatch, id_col: str, text: str, edit: Edit | None) -> pa.Table:
    own, which, words = letter_runs(*utf8(piece.column(text)))
    extra: list[bytes] = []
    times: list[int] = []
    if edit is None:
        counts = np.bincount(which, minlength=len(words))
    else:
        pairs, many = np.unique(own * max(1, len(words)) + which, return_counts=True)
        own, which = np.divmod(pairs, max(1, len(words)))
        keys, spelled = piece.column(id_col).to_pylist(), words.to_pylist()
        out = np.fromiter((edit(keys[d], spelled[w]) for d, w in zip(own.tolist(), which.tolist())), np.int64, len(own))
        changed = out >= 0
        extra = [_without(spelled[w], p) for w, p in zip(which[changed].tolist(), out[changed].tolist())]
        times = many[changed].tolist()
        counts = np.bincount(which[~changed], many[~changed], minlength=len(words)).astype(np.int64)
    return pa.table({"word": pa.chunked_array([words.cast(pa.large_string()), pa.array(extra, pa.large_binary()).cast(pa.large_string())]), "n": pa.array(np.concatenate([counts, np.array(times, np.int64)]).astype(np.int64))})


def count_words(docs: DataFrame, text: str = "text", id_col: str = "doc_id", edit: Edit | None = None, min_points: int = MIN_POINTS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of all words of so many code points and occurrences.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased. ``edit``, called
    with a row's id and a word of its text, may name a code point that the word loses there (else
    below 0). Null and empty texts have no words, repeated rows count again, an empty table
    gives an empty table; a text of any length is counted whole. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def together() -> Iterator[pa.RecordBatch]:
            if held:
                found = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")])
                found = found.filter(pc.greater(found["n_sum"], 0))
                found = found.filter(pa.array(_points(found["word"].combine_chunks()) >= min_points))
                yield from pa.table({"word": found["word"].cast(pa.string()), "n": found["n_sum"]}).to_batches(max_chunksize=1 << 16)

        for batch in batches:
            for piece in pieces(batch, text):
                held.append(_piece_counts(piece, id_col, text, edit))
                rows += held[-1].num_rows
                if rows > HELD_WORDS:
                    yield from together()
                    held, rows = [], 0
        yield from together()

    counted = map_arrow(docs.select(*dict.fromkeys([id_col, text])), run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, place, key, whether the code point before differs) of every deletion of every word, and with place -1 of the words themselves."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    at = np.concatenate([[0], np.cumsum(size)])
    code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    own = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(code)) - at[own]
    power = np.ones(int(size.max(initial=0)) + 1, np.uint64)
    power[1:] = np.uint64(BASE)
    power = np.multiply.accumulate(power)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum((code + np.uint64(1)) * power[place], dtype=np.uint64)])
    total = prefix[at[1:]] - prefix[at[:-1]]
    before = prefix[:-1] - prefix[at[own]]
    suffix = total[own] - (prefix[1:] - prefix[at[own]])
    deleted = before + suffix * np.uint64(INVERSE)
    salt = lambda n: n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)  # noqa: E731  words of other lengths
    key = np.concatenate([mix64(deleted + salt(size[own] - 1)), mix64(total + salt(size))]).view(np.int64)
    fresh = np.ones(len(code), bool)
    fresh[1:] = (code[1:] != code[:-1]) | (place[1:] == 0)
    n = len(words)
    return np.concatenate([own, np.arange(n)]), np.concatenate([place, np.full(n, -1)]), key, np.concatenate([fresh, np.ones(n, bool)])


def _emit_keys(batches: Iterator[pa.RecordBatch], radix: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = pc.utf8_length(batch.column("word")).to_numpy(zero_copy_only=False)
        group = np.cumsum(size) // RADIX_KEYS  # a few words at a time
        for start in np.flatnonzero(np.diff(group, prepend=-1)):
            part = batch.slice(start, int(np.searchsorted(group, group[start], "right")) - start)
            own, place, key, fresh = deletion_keys(part.column("word").to_pylist())
            slot = ((key.view(np.uint64) >> np.uint64(40)) * np.uint64(radix) >> np.uint64(24)).astype(np.int32)
            ids, n = (part.column(c).to_numpy() for c in ("wid", "n"))
            yield from pa.table({"radix": slot, "key": key, "place": place, "fresh": pa.array(fresh), "wid": ids[own], "n": n[own]}).to_batches(max_chunksize=1 << 16)


def _meetings(table: pa.Table) -> pa.Table:
    """Of one radix group, the words that may be near another: by one replaced code point (``place``), or (-1) with the word that others without one give."""
    key, place, wid, n = (table[c].to_numpy() for c in ("key", "place", "wid", "n"))
    fresh = table["fresh"].to_numpy()
    order = np.lexsort((place, key))
    key, place, wid, n, fresh = (x[order] for x in (key, place, wid, n, fresh))
    size = len(key)

    def spans(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin = np.flatnonzero(new)
        return np.cumsum(new) - 1, np.diff(np.append(begin, size))

    differs = np.append(True, key[1:] != key[:-1])
    same, many = spans(differs | np.append(True, place[1:] != place[:-1]))
    replaced = (many[same] > 1) & (place >= 0)
    same, _ = spans(differs)
    itself = place < 0
    senders = np.bincount(same, ~itself & fresh)
    owners = np.bincount(same, itself)
    inserted = (itself | fresh) & (senders[same] > 0) & (owners[same] > 0)
    parts = [pa.table({"spot": place[mask] if of else np.full(int(mask.sum()), -1), "place": place[mask], "wid": wid[mask], "n": n[mask]}) for mask, of in ((replaced, True), (inserted, False))]
    return pa.concat_tables(parts)


def _near(words: DataFrame) -> DataFrame:
    """(wid, n_near, to, form_n): ``to`` is the most frequent near word that is more frequent than the word itself, if any."""
    size = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    radix = max(MIN_RADIX, -(-size // RADIX_KEYS))
    keys = map_arrow(words, partial(_emit_keys, radix=radix), "radix int, key long, place long, fresh boolean, wid long, n long")
    met = keys.groupBy("radix").applyInArrow(_meetings, "spot long, place long, wid long, n long")
    spelled = met.join(words.select("wid", "word"), "wid")
    rest = F.when(F.col("place") < 0, F.col("word")).otherwise(F.concat(F.expr("substring(word, 1, cast(place as int))"), F.expr("substring(word, cast(place as int) + 2)")))
    group = Window.partitionBy("spot", "rest")
    sent = F.col("place") >= 0
    me = F.struct("n", (-F.col("wid")).alias("less"))  # of equal counts the first in code-point order; ids follow it
    found = spelled.withColumn("rest", rest).select(
        "wid", "n", "spot", "place", F.count_if(sent).over(group).alias("many"), F.max(F.when(sent, me)).over(group).alias("top"), F.max(F.when(~sent, me)).over(group).alias("whole")
    )
    replaced, itself = F.col("spot") >= 0, F.col("place") < 0
    near = F.when(replaced, F.col("many") - 1).when(itself, F.col("many")).otherwise(F.when(F.col("whole").isNotNull(), 1).otherwise(0))
    best = F.when(replaced | itself, F.col("top")).otherwise(F.col("whole"))
    each = found.select("wid", near.cast("long").alias("near"), F.when(best["n"] > F.col("n"), best).alias("best"))
    return each.groupBy("wid").agg(F.sum("near").alias("n_near"), F.max("best").alias("best")).select("wid", "n_near", (-F.col("best.less")).alias("to"), F.col("best.n").alias("form_n"))


def _roots(links: DataFrame) -> DataFrame:
    """(wid, root) from (wid, to): the end of each chain of links."""
    links = links.select("wid", F.col("to").alias("root"))
    for _ in range(MAX_ROUNDS):
        further = links.select(F.col("wid").alias("root"), F.col("root").alias("next"))
        links = cut(links.join(further, "root", "left").select("wid", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not links.where("moved").limit(1).count():
            break
        links = links.select("wid", "root")
    return links.select("wid", "root")


def group_variants(counted: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of (word, n).

    Near are words that differ by exactly one inserted, deleted or replaced code point; n_near counts
    them. ``form`` is the near word of largest n (of equal ones the first in code-point order) if that is at
    least ``FORM_TIMES`` times the word's own, ``root`` the end of the chain of forms, the word itself if it has no form.
    Counts of a repeated word are added; null words are left out and null counts are 0; an empty table gives an
    empty table. Other columns are not read. A word of L code points makes L + 1 keys, however long it is.
    """
    whole = counted.where("word IS NOT NULL").groupBy("word").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))
    # numbered in code-point order, which that of UTF-8 bytes is
    words = cut(whole.repartitionByRange("word").sortWithinPartitions("word").withColumn("wid", F.monotonically_increasing_id()))
    near = cut(_near(words))
    links = near.where(F.col("form_n").isNotNull()).join(words.select("wid", "n"), "wid").where(F.col("form_n") >= FORM_TIMES * F.col("n")).select("wid", "to", "form_n")
    links = cut(links)
    ends = links.join(_roots(links), "wid")
    name = lambda key, to: words.select(F.col("wid").alias(key), F.col("word").alias(to))
    named = ends.join(name("to", "form"), "to").join(name("root", "__root"), "root").select("wid", "form", F.col("__root").alias("last"), "form_n")
    out = words.join(near.select("wid", "n_near"), "wid", "left").join(named, "wid", "left")
    return out.select("word", "form", F.coalesce("last", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
