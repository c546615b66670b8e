"""Language identification: a language family first, then one-versus-one linear SVMs inside it.

Features are frequencies of hashed byte n-grams (1 to 3 bytes) of the lower-cased text in
which everything but letters is a space. All classifiers are linear in those frequencies,
so a text is scored by summing table entries over its positions: no feature vector is
built and whole texts of any length are scored in fixed memory.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlespark.llm.common import PIECE_BYTES, drawn, map_arrow, pieces, segment_sums, utf8

#: Families by ISO 639 code; a language that is not listed is a family of its own.
FAMILIES: Mapping[str, str] = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "bg": "slavic", "sr": "slavic",
}
UNDETERMINED = "und"
ORDERS = (1, 2, 3)
BITS = 12
#: Labelled texts learned from: about this many of each language and in all, and the characters of each.
SAMPLE_PER_LANG, SAMPLE_TOTAL, SAMPLE_CHARS = 400, 2000, 100_000
#: No language gets fewer to make room for others.
LEAST_PER_LANG = 20
#: Languages learned, those with the most labelled texts; and characters of the whole sample.
MOST_LANGS, MOST_CHARS = 256, 200_000_000


def word_bytes(digits: bool = False) -> np.ndarray:
    """A table from bytes to what stands for them: letters in lower case, bytes past ASCII, maybe digits; else a space."""
    table = np.full(256, 32, np.uint8)
    table[ord("a") : ord("z") + 1] = table[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
    table[128:] = np.arange(128, 256)
    if digits:
        table[ord("0") : ord("9") + 1] = np.arange(ord("0"), ord("9") + 1)
    return table


_LETTERS = word_bytes()


def lowered(raw: np.ndarray, table: np.ndarray) -> np.ndarray:
    """UTF-8 bytes through ``table``, with U+00C0 to U+00DE in lower case too."""
    out = table[raw]
    if len(out) > 1:
        upper = (out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)
        out[1:][upper] += 0x20
    return out


def normalised(raw: np.ndarray) -> np.ndarray:
    """Letters in lower case, everything else in ASCII a space."""
    return lowered(raw, _LETTERS)


def gram_ids(text: np.ndarray) -> Iterator[np.ndarray]:
    """For each order n the table slot of the n bytes that end at each position."""
    padded = np.concatenate([np.full(max(ORDERS) - 1, 32, np.uint8), text]).astype(np.uint32)
    code = np.zeros(len(text), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        low = max(ORDERS) - n
        code = code | (padded[low : low + len(text)] << np.uint32(8 * (n - 1)))
        if n in ORDERS:
            yield ((code * np.uint32(2654435761) + np.uint32(n * 40503)) * np.uint32(2246822519) >> np.uint32(32 - BITS)).astype(np.int64)


@dataclass(frozen=True)
class LanguageModel:
    """Learned tables: one linear function for each family and each pair of languages of a family."""

    families: tuple[str, ...] = ()
    members: tuple[tuple[str, ...], ...] = ()
    pairs: tuple[tuple[int, int, int], ...] = ()
    #: (functions, orders, slots)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, len(ORDERS), 1 << BITS), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def margins(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(texts, functions): values of the linear functions for each text."""
        if len(at) == 2 and len(raw) > 2 * PIECE_BYTES:
            return self._long_margins(raw)
        text = normalised(raw)
        out = np.zeros((len(at) - 1, len(self.bias)))
        for k, ids in enumerate(gram_ids(text)):
            for j in range(len(self.bias)):
                out[:, j] += segment_sums(np.take(self.weights[j, k], ids), at)
        return out / np.maximum(1, np.diff(at))[:, None] + self.bias

    def _long_margins(self, raw: np.ndarray) -> np.ndarray:
        """As :meth:`margins` of one long text, in stretches that each see the three bytes before them."""
        total = np.zeros(len(self.bias))
        for start in range(0, len(raw), PIECE_BYTES):
            low = max(0, start - 3)
            for k, ids in enumerate(gram_ids(normalised(raw[low : start + PIECE_BYTES]))):
                total += [np.take(w[k], ids[start - low :]).sum(dtype=np.float64) for w in self.weights]
        return (total / len(raw) + self.bias)[None]

    def predict(self, raw: np.ndarray, at: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The language of each text and a probability-like score of it."""
        n = len(at) - 1
        if not self.families:
            return [UNDETERMINED] * n, np.zeros(n)
        m = self.margins(raw, at)
        lead = _softmax(m[:, : len(self.families)]) if len(self.families) > 1 else np.ones((n, 1))
        family = lead.argmax(1)
        names = np.empty(n, object)
        score = np.zeros(n)
        for f, langs in enumerate(self.members):
            rows = np.flatnonzero(family == f)
            votes = np.zeros((len(rows), len(langs)))
            for j, (g, a, b) in enumerate(self.pairs, len(self.families)):
                if g == f:
                    p = _sigmoid(m[rows, j])
                    votes[:, a] += p
                    votes[:, b] += 1 - p
            share = votes / np.maximum(votes.sum(1, keepdims=True), 1e-9) if len(langs) > 1 else np.ones((len(rows), 1))
            best = share.argmax(1)
            names[rows] = np.array(langs, object)[best]
            score[rows] = lead[rows, f] * share[np.arange(len(rows)), best]
        return names.tolist(), np.clip(score, 0, 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _svm(x: np.ndarray, y: np.ndarray, decay: float = 1e-3, steps: int = 120) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss, classes weighted equally, by accelerated gradient descent."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w = np.zeros(x.shape[1], np.float32)
    b = 0.0
    seen, seen_b = w, b
    rate = 1 / (2 * float((x * x).sum(1).max(initial=1)) + 2 + decay)
    for k in range(steps):
        gap = np.maximum(0, 1 - y * (x @ seen + seen_b)) * y * weight
        w2 = seen - rate * (decay * seen - 2 * (gap.astype(np.float32) @ x))
        b2 = seen_b + rate * 2 * float(gap.sum())
        pull = k / (k + 3)
        seen, seen_b, w, b = w2 + pull * (w2 - w), b2 + pull * (b2 - b), w2, b2
    return w, b


def fit(texts: list[str], langs: list[str], families: Mapping[str, str] = FAMILIES) -> LanguageModel:
    """Learn from labelled texts; without any, the model answers ``und``."""
    if not texts:
        return LanguageModel()
    raw = [np.frombuffer(t.encode("utf-8", "replace"), np.uint8) for t in texts]
    x = np.zeros((len(raw), len(ORDERS) << BITS), np.float32)
    for i, r in enumerate(raw):
        for k, ids in enumerate(gram_ids(normalised(r))):
            x[i, k << BITS : (k + 1) << BITS] = np.bincount(ids, minlength=1 << BITS) / max(1, len(r))
    scale = 1 / np.sqrt(np.maximum((x * x).mean(0), 1e-7))
    x *= scale
    x *= (norm := 8 / np.sqrt(x.shape[1]))
    y = np.array(langs, object)
    of = {lang: families.get(lang, f"only:{lang}") for lang in sorted(set(langs))}
    names = tuple(sorted(set(of.values())))
    members = tuple(tuple(lang for lang in of if of[lang] == f) for f in names)
    kin = np.array([of[lang] for lang in y], object)
    functions, pairs = [], []
    for f in names:
        functions.append(_svm(x, np.where(kin == f, 1.0, -1.0)) if len(names) > 1 else (np.zeros(x.shape[1], np.float32), 0.0))
    for f, langs_of in enumerate(members):
        for a in range(len(langs_of)):
            for b in range(a + 1, len(langs_of)):
                rows = (y == langs_of[a]) | (y == langs_of[b])
                functions.append(_svm(x[rows], np.where(y[rows] == langs_of[a], 1.0, -1.0)))
                pairs.append((f, a, b))
    sharp = 3.0  # a text on the margin (1) gets sigmoid(3)
    weights = np.stack([w * scale * norm * sharp for w, _ in functions]).reshape(-1, len(ORDERS), 1 << BITS)
    return LanguageModel(names, members, tuple(pairs), weights.astype(np.float32), np.array([b * sharp for _, b in functions]))


def train(docs: DataFrame, learn: F.Column | None = None, text: str = "text", lang: str = "lang", id_col: str = "doc_id") -> LanguageModel:
    """Fit on a bounded sample, chosen by a hash of the id (of the text where there is none).

    Each language has about SAMPLE_PER_LANG texts, or its part of SAMPLE_TOTAL where there are
    many, but LEAST_PER_LANG at least. Of a long text the first SAMPLE_CHARS are learned, or fewer
    so that the sample has MOST_CHARS. Languages beyond the MOST_LANGS with the most texts (of equal ones the first by name) are not
    learned: their texts are told to be of one of the others.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    if learn is not None:
        known = known.where(learn)
    counts = {r[0]: r[1] for r in known.groupBy(lang).agg(F.count("*").alias("__n")).orderBy(F.desc("__n"), lang).limit(MOST_LANGS).collect()}
    if not counts:
        return LanguageModel()
    draw = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.col(text)), F.lit(17))
    each = min(SAMPLE_PER_LANG, max(LEAST_PER_LANG, SAMPLE_TOTAL / len(counts)))
    share = F.lit(False)
    for name, n in counts.items():
        share = F.when(F.col(lang) == name, drawn(draw, each / n)).otherwise(share)
    # the rank only matters where many rows have one id
    chars = min(SAMPLE_CHARS, int(MOST_CHARS / (each * len(counts))))
    sample = known.where(share).select(F.substring(text, 1, chars).alias("text"), F.col(lang).alias("lang"), draw.alias("draw"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text"))
    rows = sample.withColumn("rank", rank).where(F.col("rank") <= math.ceil(2 * each)).select("text", "lang").collect()
    return fit([r[0] for r in rows], [r[1] for r in rows])


def predict_languages(docs: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (default: all) with ``lang_pred`` and ``score`` of the whole text.

    ``lang_pred`` is ``und`` with score 0 where the text is null, empty or has no letter. Rows
    are independent: repeated rows and repeated ids each get their own answer. Columns named
    lang_pred or score in the input are replaced. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    source = docs.select(*dict.fromkeys([*keep, text])).withColumn("__letter", F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    schema = source.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    shared = spark.sparkContext.broadcast(model)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in pieces(batch, text):
                raw, at = utf8(part.column(text))
                names, score = m.predict(raw, at)
                letter = part.column("__letter").to_numpy(zero_copy_only=False)
                names = [n if ok else UNDETERMINED for n, ok in zip(names, letter)]
                columns = [part.column(c) for c in keep] + [pa.array(names, pa.string()), pa.array(np.where(letter, score, 0.0))]
                yield pa.RecordBatch.from_arrays(columns, [*keep, "lang_pred", "score"])

    return map_arrow(source, answer, schema)
