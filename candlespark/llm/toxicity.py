"""Toxicity: averaged subword-bag embeddings under a linear softmax, trained jointly in numpy.

A word (a run of letters and digits with a letter in it) is the bag of its byte n-grams (3 to 5 bytes, with both word ends marked), so a
misspelling that was never seen shares most vectors with its model. Inside a word a digit stands
for the letter that it looks like, and digits before or after a word that look like none are left
out; numbers and long runs with many digits are no words. A window of words is the
average of its words' averaged subword vectors; the softmax scores windows and a document's
score is that of its worst window, which keeps one insult in a long text from being averaged
away. Embeddings and softmax are learned together on document labels: after each round, only
the worst window of a toxic document counts as toxic.

After training the softmax and the embeddings fold into one number for each subword, so whole
texts of any length are scored by table look-ups in fixed memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlespark.llm.common import PIECE_BYTES, drawn, map_arrow, pieces, utf8
from candlespark.llm.periods import blank_blocks
from candlespark.llm.langid import lowered, word_bytes

ORDERS = (3, 4, 5)
_WORD_BYTES = word_bytes(digits=True)
#: Digits that stand for letters (0134578 as oieastb); 2, 6 and 9 stay as they are.
_LOOK_ALIKE = np.arange(256, dtype=np.uint8)
_LOOK_ALIKE[list(b"0134578")] = list(b"oieastb")
_UNLIKE = list(b"269")
#: A run of at least this many bytes and digits is a key, not a word.
KEY_BYTES, KEY_DIGITS = 20, 3
BITS = 17
DIM = 8
WINDOW = 5
#: Learned from about this many documents of label 0 and of label 1; of those of SAMPLE_BYTES and more, as many whole texts as LONG_BYTES hold.
SAMPLE_PER_LABEL, SAMPLE_BYTES, LONG_BYTES = (1400, 700), 20_000, 4 << 20
ROUNDS, STEPS = 3, 50
#: Slots seen in fewer documents of the sample carry no weight.
MIN_DOCUMENTS = 3
THRESHOLD = 0.7


def subwords(text: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the positions where an n-gram inside one marked word begins, and its table slots.

    ``text`` is lower-cased and every word has a space before and after it.
    """
    blank = np.concatenate([[0], np.cumsum(text == 32)])
    wide = np.concatenate([text, np.full(max(ORDERS), 32, np.uint8)]).astype(np.uint64)
    code = np.zeros(len(text), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        code = (code << np.uint64(8)) | wide[n - 1 : n - 1 + len(text)]
        if n in ORDERS and len(text) >= n:
            last = len(text) - n + 1
            inner = blank[n - 1 : n - 1 + last] - blank[1 : last + 1]  # spaces strictly inside
            at = np.flatnonzero(inner == 0)
            yield at, ((code[at] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(64 - BITS)).astype(np.int64)


def words_of(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, starts, document of each word, rank in its document): texts set apart by spaces."""
    n = len(at) - 1
    text = np.full(len(raw) + n + 1, 32, np.uint8)
    text[np.arange(len(raw)) + np.repeat(np.arange(1, n + 1), np.diff(at))] = lowered(raw, _WORD_BYTES)
    digit = (text >= 48) & (text <= 57)
    if digit.any():
        run = np.cumsum(np.concatenate([[True], (text[1:] != 32) & (text[:-1] == 32)])) - 1
        digits, size = np.bincount(run[digit], minlength=run[-1] + 1), np.bincount(run[text != 32], minlength=run[-1] + 1)
        at_digit = np.flatnonzero(digit)
        begin = np.flatnonzero(np.concatenate([[True], np.diff(at_digit) > 1]))
        many = np.diff(np.append(begin, len(at_digit)))
        affix = (text[at_digit[begin] - 1] == 32) | (text[at_digit[begin + many - 1] + 1] == 32)
        unlike = np.logical_or.reduceat(np.isin(text[at_digit], _UNLIKE), begin)
        text[at_digit[np.repeat(affix & unlike, many)]] = 32
        text[((digits == size) | (size >= KEY_BYTES) & (digits >= KEY_DIGITS))[run]] = 32
        text = _LOOK_ALIKE[text]
    starts = np.flatnonzero((text[1:] != 32) & (text[:-1] == 32)) + 1
    doc = np.searchsorted(at + np.arange(n + 1) + 1, starts, "right") - 1
    first = np.searchsorted(doc, np.arange(n))
    return text, starts, doc, np.arange(len(starts)) - first[doc] if len(starts) else starts


@dataclass(frozen=True)
class ToxicityModel:
    """Value of each subword slot and the bias, as differences of the two softmax logits, and that of a text without words."""

    slots: np.ndarray
    bias: float
    empty: float

    def scores(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Probability of the toxic label for each text; a text without words gets the prior."""
        if len(at) == 2 and len(raw) > 2 * PIECE_BYTES:
            return self._long_score(raw)
        text, starts, doc, rank = words_of(raw, at)
        out = np.full(len(at) - 1, self.empty)
        if len(starts):
            word = _word_values(text, starts, self.slots)
            window = rank // WINDOW
            new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (window[1:] != window[:-1])]))
            mean = np.add.reduceat(word, new) / np.diff(np.append(new, len(word)))
            owner = doc[new]
            begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            out[owner[begin]] = np.maximum.reduceat(mean, begin) + self.bias
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))

    def _long_score(self, raw: np.ndarray) -> np.ndarray:
        """As :meth:`scores` of one long text, in stretches that end where a word does."""
        best, left = -np.inf, np.zeros(0)
        for block in blank_blocks(raw, PIECE_BYTES):
            text, starts, _, _ = words_of(block, np.array([0, len(block)]))
            values = np.concatenate([left, _word_values(text, starts, self.slots)])
            whole = len(values) // WINDOW * WINDOW
            if whole:
                best = max(best, (np.add.reduceat(values[:whole], np.arange(0, whole, WINDOW)) / WINDOW).max())
            left = values[whole:]
        if len(left):
            best = max(best, np.add.reduceat(left, [0])[0] / len(left))
        return 1 / (1 + np.exp(-np.clip([self.empty if best == -np.inf else best + self.bias], -40, 40)))


def _word_values(text: np.ndarray, starts: np.ndarray, slots: np.ndarray) -> np.ndarray:
    total, count = np.zeros(len(starts)), np.zeros(len(starts))
    for where, ids in subwords(text):
        # an n-gram belongs to the word that begins at it or, where it begins on the space, right after
        word = np.searchsorted(starts, where + 1, "right") - 1
        total += np.bincount(word, np.take(slots, ids), len(starts))
        count += np.bincount(word, minlength=len(starts))
    return total / np.maximum(count, 1)


def fit(texts: list[str], toxic: list[int], prior: float | None = None, seed: int = 7) -> ToxicityModel:
    """Learn embeddings and softmax together from whole labelled texts; with one label only, or without any word, a constant.

    ``prior`` is the share of label 1 among all labelled documents, the score of a text without words.
    """
    share_1 = float(np.mean(toxic)) if prior is None and texts else prior or 0.0
    empty = float(np.log(np.clip(share_1, 1e-3, 0.5) / (1 - np.clip(share_1, 1e-3, 0.5))))
    raw = [t.encode("utf-8", "replace") for t in texts]
    at = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    text, starts, doc, rank = words_of(np.frombuffer(b"".join(raw), np.uint8), at)
    if len(set(toxic)) < 2 or not len(starts):
        return ToxicityModel(np.zeros(1 << BITS, np.float32), empty, empty)
    label = np.asarray(toxic)
    # distinct words, each a bag of slots
    ends = np.searchsorted(blank := np.flatnonzero(text == 32), starts)
    spans = [text[s : blank[e]].tobytes() for s, e in zip(starts, ends)]
    names: dict[bytes, int] = {}
    word = np.array([names.setdefault(s, len(names)) for s in spans], np.int64)
    vocabulary = np.frombuffer(b" " + b" ".join(names) + b" ", np.uint8)
    vocabulary_at = np.flatnonzero((vocabulary[1:] != 32) & (vocabulary[:-1] == 32)) + 1
    of_word, slot = [], []
    for where, ids in subwords(vocabulary):
        of_word.append(np.searchsorted(vocabulary_at, where + 1, "right") - 1)
        slot.append(ids)
    of_word, slot = np.concatenate(of_word), np.concatenate(slot)
    order = np.argsort(of_word, kind="stable")
    of_word, slot = of_word[order], slot[order]
    size = np.maximum(np.bincount(of_word, minlength=len(names)), 1)
    used, slot = np.unique(slot, return_inverse=True)
    seen = np.unique(doc * len(names) + word)  # (document, word)
    by_word = np.concatenate([[0], np.cumsum(np.bincount(of_word, minlength=len(names)))])
    many = np.diff(by_word)[seen % len(names)]
    pairs = np.repeat(seen // len(names), many) * len(used) + slot[np.arange(many.sum()) + np.repeat(by_word[seen % len(names)] - np.cumsum(many) + many, many)]
    rare = np.bincount(np.unique(pairs) % len(used), minlength=len(used)) < MIN_DOCUMENTS

    # rare slots carry no weight: only the others are learned
    held = ~rare[slot]
    slot, of_word, used = (np.cumsum(~rare) - 1)[slot[held]], of_word[held], used[~rare]

    window = np.cumsum(np.concatenate([[True], (doc[1:] != doc[:-1]) | (rank[1:] // WINDOW != rank[:-1] // WINDOW)])) - 1
    owner = doc[np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]]))]
    length = np.bincount(window)
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (len(used), DIM)).astype(np.float32)
    head = np.array([-1.0, 1.0])[:, None] * rng.normal(0, 0.3, DIM)
    chosen = np.ones(len(owner), bool)
    n_words = len(names)
    for _ in range(ROUNDS):
        live = chosen[window]
        number = np.cumsum(chosen) - 1
        w_word, w_window = word[live], number[window[live]]
        y = label[owner[chosen]]
        share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
        bias = np.zeros(2)
        moments = [(np.zeros_like(v), np.zeros_like(v)) for v in (table, head, bias)]
        wl = length[chosen]
        for step in range(1, STEPS + 1):
            # averages are linear, and two logits count by their difference: one number for each
            # slot goes up to the windows and one for each window comes back, whatever DIM is
            words = np.bincount(of_word, (table @ (head[1] - head[0]))[slot], n_words) / size
            gap = np.bincount(w_window, words[w_word], len(wl)) / wl + (bias[1] - bias[0])
            gap = (1 / (1 + np.exp(-np.clip(gap, -40, 40))) - y) * share
            g_words = np.bincount(w_word, (gap / wl)[w_window], n_words) / size
            g_slots = np.bincount(slot, g_words[of_word], len(used))
            sides = np.array([-1.0, 1.0])
            grads = (np.outer(g_slots, head[1] - head[0]), np.outer(sides, g_slots @ table), sides * gap.sum())
            for value, grad, rate, (m, v) in zip((table, head, bias), grads, (0.15, 0.1, 0.1), moments):
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        worth = np.bincount(of_word, (table @ (head[1] - head[0]))[slot], n_words) / size
        mean = np.bincount(window, worth[word]) / length
        # next round: of a toxic document its worst window; of the others all windows
        best = np.full(len(label), -np.inf)
        np.maximum.at(best, owner, mean)
        chosen = (label[owner] == 0) | (mean >= best[owner])
    slots = np.zeros(1 << BITS, np.float32)
    slots[used] = table @ (head[1] - head[0])
    return ToxicityModel(slots, float(bias[1] - bias[0]), empty)


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, text: str = "text", id_col: str = "doc_id", label: str = "toxic") -> ToxicityModel:
    """Fit on about SAMPLE_PER_LABEL whole texts by label, chosen by a hash of the id; of rows that repeat an id, on one.

    Texts of any length are drawn alike. Of those of SAMPLE_BYTES and more the first by that hash are learned that together have
    at most LONG_BYTES of a label, so what reaches the driver is bounded; a text longer than that alone is passed over.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull())
    if learn is not None:
        known = known.where(learn)
    known = known.groupBy(id_col).agg(F.max(label).alias("__toxic"))
    counts = {int(r[0]): r[1] for r in known.groupBy("__toxic").count().collect()}
    draw = F.xxhash64(F.col(id_col).cast("string"), F.lit(29))
    share = F.lit(False)
    for value, n in counts.items():
        share = F.when(F.col("__toxic") == value, drawn(draw, SAMPLE_PER_LABEL[value] / n)).otherwise(share)
    # ids and labels only, at most `most` rows: small enough to broadcast whatever the input
    most = 2 * sum(SAMPLE_PER_LABEL)
    sample = known.where(share).orderBy(draw, id_col).limit(most)
    found = docs.select(id_col, text).join(F.broadcast(sample), id_col)
    # one text for each id, however many rows repeat it, in an order of its own: the model does not depend on the layout
    found = found.groupBy(id_col).agg(F.min(text).alias("__text"), F.max("__toxic").alias("__label")).where("__text IS NOT NULL")
    size = F.octet_length("__text")
    long = Window.partitionBy("__label").orderBy(draw, id_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    longer = found.where((size >= SAMPLE_BYTES) & (size <= LONG_BYTES)).withColumn("__sum", F.sum(size).over(long)).where(F.col("__sum") <= LONG_BYTES)
    rows = found.where(size < SAMPLE_BYTES).unionByName(longer.drop("__sum")).select("__text", "__label").collect()
    rows.sort()
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    return fit([r[0] for r in rows], [int(r[1]) for r in rows], prior)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The ``keep`` columns (default: all) with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    Null and empty texts, and texts without a word, get the share of label 1 among the labels. Rows are
    independent, so repeated rows agree. Columns named score or predicted in the input are
    replaced. An empty table gives an empty table.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    source = docs.select(*dict.fromkeys([*keep, text]))
    schema = source.select(*keep).schema.add("score", "double").add("predicted", "integer")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in pieces(batch, text):
                score = m.scores(*utf8(part.column(text)))
                columns = [part.column(c) for c in keep] + [pa.array(score), pa.array((score >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, [*keep, "score", "predicted"])

    return map_arrow(source, answer, schema)
