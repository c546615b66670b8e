"""Benchmark decontamination with a generalised suffix automaton over the benchmark's words.

The automaton accepts every run of consecutive words of every item. A document's words are
streamed through it; the length of the longest match that ends at each word tells which
windows of WINDOW item words occur there (an item of fewer words is one window). Words inside
an occurring window are hit; a document is contaminated where its hit words reach a share of
its words, and spans of hit words can be removed.

A benchmark of up to ``GROUP_WORDS`` words is one automaton (of about 600 bytes a word, so 120 MB),
built on the driver and broadcast; documents never leave their partition: there is no shuffle. A
larger one is cut into stretches of at most ``STRETCH_WORDS`` words that overlap by a window less one word, so
that every window lies in one; equal stretches are one, with the ids of their items. Stretches, with ``STRETCH_IDS`` ids at most,
are dealt into groups of about ``GROUP_WORDS`` words and ids, whose automata are built on the
executors and written to the shared folder. Texts are then written once and pass every group's
automaton, one group at a time; what each finds comes together by row. So neither the driver nor
a task ever holds more than one automaton, whatever the benchmark's size.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from candlespark.llm.common import cut, fresh_name, map_arrow, shared_path, with_rows

WINDOW = 13
#: Contaminated: hit words times this reach the words of the document.
SHARE = 20
#: Words and ids of items that one automaton holds, and those of one stretch of an item.
GROUP_WORDS, STRETCH_WORDS, STRETCH_IDS = 200_000, 20_000, 20_000

_WORD_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Runs of digits, letters and bytes past ASCII, A-Z lower-cased; U+007F is no word character."""
    return text.translate(_WORD_BYTES).split()


class Automaton:
    """Generalised suffix automaton of word sequences, with the items whose windows end in each state."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        """``items``: (id or frozenset of ids, words) each."""
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[int, frozenset, int]] = []
        for item, words in items:
            ids = item if isinstance(item, frozenset) else frozenset([item])
            codes = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            last = 0
            for k, c in enumerate(codes):
                last = self._extend(last, c)
                if k + 1 >= window:
                    ends.append((last, ids, window))
            if codes and len(codes) < window:
                ends.append((last, ids, len(codes)))
        self.shortest = min((n for _, _, n in ends), default=0)
        by_length = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        #: the ancestor that covers the length of a window, of each state
        holds = list(range(len(self.length)))
        for q in by_length:
            if self.length[self.link[q]] >= window:
                holds[q] = holds[self.link[q]]
        found: dict[int, dict[int, dict[frozenset, None]]] = {}
        for state, ids, n in ends:
            if n == window:
                state = holds[state]
            else:
                while self.length[self.link[state]] >= n:  # fewer than a window's words, so a short way
                    state = self.link[state]
            found.setdefault(state, {}).setdefault(n, {})[ids] = None
        self.windows: dict[int, list[tuple[int, list[frozenset]]]] = {q: [(n, list(sets)) for n, sets in sizes.items()] for q, sizes in found.items()}
        #: the next state up the links, the state itself included, that has windows; -1 if none has
        self.bearer = [-1] * len(self.length)
        for q in by_length:
            self.bearer[q] = q if q in self.windows else self.bearer[self.link[q]]

    def _extend(self, last: int, c: int) -> int:
        step, link, length = self.step, self.link, self.length
        if c in step[last]:  # this word sequence is known from another item
            q = step[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p != -1:
            q = step[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        copy = len(self.step)
        self.step.append(dict(self.step[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        while p != -1 and self.step[p].get(c) == q:
            self.step[p][c] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def matches(self, codes: list[int]) -> Iterator[tuple[int, int, int, int]]:
        """(end, length, state, number) of every occurring window, the latter two for :meth:`items`; a code below 0 is a word of no item."""
        step, link, length, windows, bearer = self.step, self.link, self.length, self.windows, self.bearer
        state, size = 0, 0
        for k, c in enumerate(codes, 1):
            while state and c not in step[state]:
                state = link[state]
                size = length[state]
            nxt = step[state].get(c)
            if nxt is None:
                continue
            state, size = nxt, size + 1
            at = bearer[state]
            while at > 0:
                for number, (n, _) in enumerate(windows[at]):
                    if n <= size:
                        yield k, n, at, number
                at = bearer[link[at]]

    def items(self, state: int, number: int) -> list[frozenset]:
        """Sets of the ids of the items that have a window."""
        return self.windows[state][number][1]


@dataclass(frozen=True)
class Groups:
    """Automata of a large benchmark, as rows (part, machine) of a table in the shared folder."""

    path: str
    count: int


Index = list[Automaton] | Groups


def build(benchmark: DataFrame, text: str = "text", item: str = "item_id", window: int = WINDOW) -> Index:
    """The automaton of the whole benchmark, or its groups. Null texts have no words."""
    rows = benchmark.where(F.col(text).isNotNull()).select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))
    # a little more than the words, as an empty part at either end counts too
    words = rows.agg(F.sum(F.size(F.split(F.col("text"), "[\\x00-/:-`{-\\x7f]+")).cast("long"))).first()[0] or 0
    if words <= GROUP_WORDS:
        return [Automaton([(r["item"], words_of(r["text"].encode("utf-8", "surrogatepass"))) for r in rows.toLocalIterator()], window)]
    path = shared_path(benchmark.sparkSession, "automata")
    size = STRETCH_WORDS

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in enumerate(batch.column("text").cast(pa.large_binary())):
                item, words = batch.column("item").slice(k, 1), words_of(text.as_py())
                for start in range(0, max(1, len(words) - window + 1) if words else 0, size - window + 1):
                    part = words[start : start + size]
                    yield pa.RecordBatch.from_arrays([item, pa.array([b" ".join(part)], pa.binary()), pa.array([len(part)], pa.int64())], ["item", "words", "n"])

    cut_up = map_arrow(rows.select("item", "text"), stretches, "item string, words binary, n long").distinct()
    cut_up = cut(cut_up.withColumn("h", F.xxhash64("words")))
    many = cut_up.groupBy("h").agg(F.count("*").alias("ids"))
    slices = F.ceil(F.col("ids") / STRETCH_IDS).cast("long")
    spread = cut_up.join(many, "h").withColumn("slice", F.pmod(F.xxhash64("item", F.lit(3)), slices))
    sets = cut(spread.groupBy("h", "slice", "words").agg(F.first("n").alias("n"), F.collect_list("item").alias("items")))
    weight = sets.agg(F.sum(F.col("n") + F.size("items"))).first()[0] or 0
    parts = max(1, -(-5 * weight // (4 * GROUP_WORDS)))

    def machine(table: pa.Table) -> pa.Table:
        items = [(frozenset(i), w.split()) for i, w in zip(table["items"].to_pylist(), table["words"].to_pylist())]
        return pa.table({"part": table["part"].slice(0, 1), "machine": pa.array([pickle.dumps(Automaton(items, window))], pa.binary())})

    dealt = sets.withColumn("part", F.pmod(F.xxhash64("h", "slice"), F.lit(parts)).cast("int")).select("part", "words", "items")
    dealt.groupBy("part").applyInArrow(machine, "part int, machine binary").write.parquet(path)
    return Groups(path, parts)


_held: dict[str, list[Automaton]] = {}


def _loaded(key: str, raw: bytes) -> list[Automaton]:
    """Automata unpickled once in a worker, which then holds no others."""
    if key not in _held:
        _held.clear()
        _held[key] = pickle.loads(raw)
    return _held[key]


def scan(text: bytes, automata: list[Automaton]) -> tuple[int, np.ndarray, set]:
    """(words, mask of hit words, items with occurring windows) of one text."""
    words = words_of(text)
    hit = np.zeros(len(words) + 1, np.int64)
    items: set = set()
    for a in automata:
        if not a.windows or len(words) < a.shortest:
            continue
        seen: set[tuple[int, int]] = set()
        codes = np.fromiter(map(a.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        known = np.flatnonzero(np.diff(np.concatenate([[0], (codes >= 0).view(np.int8), [0]])))
        for start, stop in zip(known[::2].tolist(), known[1::2].tolist()):
            if stop - start >= a.shortest:  # no window fits into a shorter run of known words
                for end, n, *where in a.matches(codes[start:stop].tolist()):
                    hit[start + end - n] += 1
                    hit[start + end] -= 1
                    seen.add(tuple(where))
        items.update(*(ids for state, number in seen for ids in a.items(state, number)))
    return len(words), np.cumsum(hit[:-1]) > 0, items


def is_contaminated(n_words: int, n_hit: int, share: int = SHARE) -> bool:
    return n_hit > 0 and share * n_hit >= n_words


_FOUND = {"n_words": pa.int64(), "n_hit": pa.int64(), "n_items": pa.int64(), "items_sha256": pa.string(), "contaminated": pa.bool_()}


def _verdict(n: int, n_hit: int, items: set, share: int) -> tuple:
    return n, n_hit, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), is_contaminated(n, n_hit, share)


def scan_contamination(docs: DataFrame, index: Index, text: str = "text", keep: list[str] | None = None, share: int = SHARE) -> DataFrame:
    """The ``keep`` columns (default: all) with n_words, n_hit, n_items, items_sha256 and contaminated.

    Null, empty and wordless texts have no words and are clean. Texts of any length are streamed
    word by word. Repeated rows each get their answer; repeated or identical items each count
    under their own id. Without items nothing is hit. Input columns with the names of output
    columns are replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in _FOUND]
    source = docs.select(*dict.fromkeys([*keep, text]))
    schema = source.select(*keep).schema
    for name, kind in zip(_FOUND, ("long", "long", "long", "string", "boolean")):
        schema = schema.add(name, kind)
    hits, key, raw = "", uuid.uuid4().hex, None
    if isinstance(index, Groups):
        source, hits = _with_hits(source, index, text)
    else:
        raw = docs.sparkSession.sparkContext.broadcast(pickle.dumps(index))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(hits).to_pylist() if hits else None
            out = []
            for k, value in enumerate(batch.column(text).cast(pa.large_binary())):
                value = value.as_py() or b""
                n, hit, items = _gathered(value, found[k]) if hits else scan(value, _loaded(key, raw.value))
                out.append(_verdict(n, int(hit.sum()), items, share))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(v, k) for v, k in zip(list(zip(*out)) or [[]] * len(_FOUND), _FOUND.values())], [*keep, *_FOUND])

    return map_arrow(source, answer, schema)



def _with_hits(docs: DataFrame, groups: Groups, text: str) -> tuple[DataFrame, str]:
    """``docs`` as written once, with a column of the spans of hit words and the items that all groups found (null: nothing), and its name."""
    spark, row, name = docs.sparkSession, fresh_name(docs.columns, "__row"), fresh_name(docs.columns, "__hits")
    rows = with_rows(docs, row)
    path = shared_path(spark, "hits")
    for part in range(groups.count):
        machine = spark.read.parquet(groups.path).where(F.col("part") == part).select("machine").first()
        if machine is None:
            continue
        key, raw = uuid.uuid4().hex, spark.sparkContext.broadcast(bytes(machine[0]))

        def found(batches: Iterator[pa.RecordBatch], key: str = key, raw=raw) -> Iterator[pa.RecordBatch]:
            if key not in _held:
                _held.clear()
                _held[key] = [pickle.loads(raw.value)]
            for batch in batches:
                out: list[list] = [[], [], [], []]
                for number, value in zip(batch.column(row).to_pylist(), batch.column(text).cast(pa.large_binary())):
                    _, hit, items = scan(value.as_py() or b"", _held[key])
                    if items:
                        edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
                        for column, x in zip(out, (number, edges[::2], edges[1::2], sorted(items))):
                            column.append(x)
                kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["row", "starts", "ends", "items"])

        map_arrow(rows.select(row, text), found, "row long, starts array<int>, ends array<int>, items array<string>").write.mode("append").parquet(path)
        raw.destroy()
    kinds = "row long, starts array<int>, ends array<int>, items array<string>"
    spark.createDataFrame([], kinds).write.mode("append").parquet(path)  # so that there is a table if no part has items
    hits = spark.read.schema(kinds).parquet(path).groupBy("row").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends", "items")))
    hits = hits.select(F.col("row").alias(row), F.struct("starts", "ends", "items").alias(name))
    return rows.join(hits, row, "left").select(*docs.columns, name), name


def _gathered(text: bytes, hits: dict | None) -> tuple[int, np.ndarray, set]:
    """As :func:`scan`, from what the groups found."""
    n = len(words_of(text))
    edges = np.zeros(n + 1, np.int64)
    if hits:
        np.add.at(edges, hits["starts"], 1)
        np.add.at(edges, hits["ends"], -1)
    return n, np.cumsum(edges[:-1]) > 0, set(hits["items"]) if hits else set()


def without_words(raw: bytes, hit: np.ndarray) -> bytes:
    """``raw`` without its hit words and what stands between neighbouring ones."""
    drop = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))).reshape(-1, 2)
    is_word = np.frombuffer(raw.translate(_WORD_BYTES), np.uint8) != 32
    marks = np.flatnonzero(np.diff(np.concatenate([[0], is_word.view(np.int8), [0]]))).reshape(-1, 2)
    kept, at = [], 0
    for first, last in drop:
        kept.append(raw[at : marks[first][0]])
        at = marks[last - 1][1]
    return b"".join([*kept, raw[at:]])


def remove_spans(text: str, automata: list[Automaton], share: int = SHARE) -> str:
    """``text`` without its hit spans if they make it contaminated, else as it is.

    A span is at least a window long (the length limit); the share of hit words is the coverage
    limit. What is left is scanned again, since taking a span out joins what stood around it.
    """
    raw = text.encode("utf-8", "surrogatepass")
    while True:
        n, hit, _ = scan(raw, automata)
        if not is_contaminated(n, int(hit.sum()), share):
            return raw.decode("utf-8", "replace")
        raw = without_words(raw, hit)


def decontaminate(docs: DataFrame, index: Index, text: str = "text", share: int = SHARE) -> DataFrame:
    """All columns, with hit spans taken out of contaminated texts; clean rows are untouched, null texts stay null.

    Rows are judged one by one, so null and repeated ids do no harm; an empty table gives an
    empty table.
    """
    if isinstance(index, Groups):
        return _decontaminated(docs, index, text, share)
    key, raw = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(pickle.dumps(index))
    names = docs.columns

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [None if v is None else remove_spans(v, _loaded(key, raw.value), share) for v in batch.column(text).to_pylist()]
            columns = [pa.array(values, batch.column(c).type) if c == text else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    return map_arrow(docs, answer, docs.schema)


def _decontaminated(docs: DataFrame, groups: Groups, text: str, share: int) -> DataFrame:
    """Rows that lose words are scanned again by all groups, until none does; the others are done."""
    names, done, left = docs.columns, [], docs
    while True:
        rows, name = _with_hits(left, groups, text)
        flag = fresh_name(names, "__again")
        schema = StructType([*left.schema, StructField(flag, BooleanType())])

        def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values, again = [], []
                for value, hits in zip(batch.column(text).cast(pa.large_binary()).to_pylist(), batch.column(name).to_pylist()):
                    n, hit, _ = _gathered(value or b"", hits)
                    again.append(is_contaminated(n, int(hit.sum()), share))
                    values.append(without_words(value, hit) if again[-1] else value)
                columns = [pa.array(values, pa.large_binary()).cast(batch.column(c).type) if c == text else batch.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(again, pa.bool_())], [*names, flag])

        told = cut(map_arrow(rows, answer, schema))
        done.append(told.where(~F.col(flag)).select(names))
        left = told.where(flag).select(names)
        if left.isEmpty():
            return reduce(DataFrame.unionByName, done)
