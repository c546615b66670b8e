"""Spelling variants against a plain comparison of all words."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from candlespark.llm import spelling
from candlespark.llm.queries import lost_point
from tests.llm.test_queries import _spelling_rows, _word_counts


def _rows(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()))


def _words(rng, n):
    out = {}
    for _ in range(n):
        word = "".join(rng.choice("abé") for _ in range(rng.randint(1, 7)))
        out[word] = rng.choice([3, 4, 6, 8, 12, 16, 40, 100])
    return out


def test_variants_are_those_of_a_plain_comparison(spark):
    rng = random.Random(7)
    counted = _words(rng, 400) | {"x" * 3000: 5, "x" * 3001: 10, "x" * 2999 + "y": 3}
    df = spark.createDataFrame([(w, n, "mine") for w, n in counted.items()], "word string, n long, form string").repartition(3)
    assert _rows(spelling.group_variants(df)) == _spelling_rows(counted)


def test_colliding_keys_change_nothing(spark, monkeypatch):
    rng = random.Random(8)
    counted = _words(rng, 120)
    plain = spelling.mix64
    monkeypatch.setattr(spelling, "mix64", lambda x: plain(x) & np.uint64(7 << 60))  # eight keys for all
    df = spark.createDataFrame(list(counted.items()), "word string, n long")
    assert _rows(spelling.group_variants(df)) == _spelling_rows(counted)


def test_counts_and_rows(spark):
    texts = [None, "", "12 ..", "Été ÉTÉ été naïve Naïve", "words words words×words", "ŝwords wordsŝ", "A" * 50_000]
    rows = [(k, t, "mine") for k, t in enumerate(texts)] + [(None, "words words", "x"), (4, texts[4], "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string").repartition(2)
    want = _word_counts([(k, t) for k, t, _ in rows], 1, 1)
    assert {r["word"]: r["n"] for r in spelling.count_words(df, edit=lost_point, min_points=1, min_count=1).collect()} == want
    plain = Counter()
    for _, t, _ in rows:
        import re

        plain.update(re.findall("[a-zÀ-ÿ]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))
    assert {r["word"]: r["n"] for r in spelling.count_words(df, min_points=1, min_count=2).collect()} == {w: n for w, n in plain.items() if n > 1}
    assert spelling.group_variants(spelling.count_words(df.limit(0))).collect() == []


def test_repeated_and_null_words(spark):
    df = spark.createDataFrame([("stone", 2), ("stone", 2), (None, 5), ("stones", 8), ("other", None)], "word string, n long")
    assert _rows(spelling.group_variants(df)) == [("other", None, "other", 0, 0, None), ("stone", "stones", "stones", 4, 1, 8), ("stones", None, "stones", 8, 1, None)]


@pytest.mark.parametrize("word", ["", "a", "aab", "naïve", "日本語"])
def test_keys_are_those_of_the_words_left(word):
    own, place, key, _ = spelling.deletion_keys([word, "pad"])
    for o, p, k in zip(own, place, key):
        if o == 0 and p >= 0:
            left = word[:p] + word[p + 1 :]
            _, places, keys, _ = spelling.deletion_keys([left])
            assert k == keys[places < 0][0]
