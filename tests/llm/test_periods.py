"""Runs of repeated words against a plain search of every period."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from candlespark.llm import periods
from tests.llm.test_queries import _plain_runs


def _joined(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def _words(rng):
    letters = [f"w{k}" for k in range(rng.choice([1, 2, 3, 5, 50]))]
    words = [rng.choice(letters) for _ in range(rng.randint(0, 200))]
    for _ in range(rng.randint(0, 4)):
        unit = [rng.choice(letters) for _ in range(rng.randint(1, 20))]
        at = rng.randint(0, len(words))
        words[at:at] = (unit * rng.randint(2, 12))[: rng.randint(1, 150)]
    return words


@pytest.mark.parametrize(("probes", "block"), [(1 << 16, 1 << 22), (64, 50)])
def test_runs_are_those_of_a_plain_search(monkeypatch, probes, block):
    monkeypatch.setattr(periods, "PROBES", probes)
    monkeypatch.setattr(periods, "BLOCK_BYTES", block)
    rng = random.Random(5)
    for _ in range(60):
        texts = [rng.choice(["", " ", "\n"]) + rng.choice([" ", " \t", "\x0b"]).join(_words(rng)) + rng.choice(["", " "]) for _ in range(rng.randint(0, 5))]
        ids, first, words = periods.number_words(*_joined(texts))
        rows, known = periods.runs_of(ids, first), words.to_pylist()
        for k, text in enumerate(texts):
            plain = re.findall("[^\x20\x09-\x0d]+", text)
            assert [known[i].decode() for i in ids[first[k] : first[k + 1]]] == plain
            assert [tuple(r[1:]) for r in rows.tolist() if r[0] == k] == _plain_runs(plain)


def test_a_text_of_one_word_is_searched_once_for_each_period():
    ids = np.zeros(300_000, np.int32)
    assert periods.runs_of(ids, np.array([0, len(ids)])).tolist() == [[0, 0, len(ids), 1]]


def test_rows_and_clashing_names(spark):
    from pyspark.sql import functions as F

    texts = [None, "", " \n", "é " * 30, "a b c " * 20 + "a", "x " * 24 + "y", "one two"]
    rows = [(k, t, "mine", [1]) for k, t in enumerate(texts)] + [(None, "z " * 40, "mine", None), (4, texts[4], "mine", [2])]
    df = spark.createDataFrame(rows, "id long, text string, collapsed string, runs array<int>").withColumn("start", F.lit(9))
    got = periods.find_runs(df, keep=("id", "collapsed", "start")).collect()
    want = {0: ([], ""), 1: ([], ""), 2: ([], ""), 3: ([(0, 30, 1)], "é"), 4: ([(0, 61, 3)], "a b c"), 5: ([(0, 24, 1)], "x y"), 6: ([], "one two"), None: ([(0, 40, 1)], "z")}
    assert len(got) == len(rows) and all(([tuple(x) for x in r["runs"]], r["collapsed"]) == want[r["id"]] and r["start"] == 9 for r in got)
    assert periods.find_runs(df.limit(0), keep=("id",)).collect() == []
