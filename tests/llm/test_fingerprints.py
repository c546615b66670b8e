"""Fingerprints against a plain form of their definition, and distances against the usual table."""

from __future__ import annotations

import random

import numpy as np
import pytest

from candlespark.llm import fingerprints
from tests.llm.conftest import prose

M64 = (1 << 64) - 1


def _mix(x):
    x ^= x >> 33
    x = x * 0xFF51AFD7ED558CCD & M64
    x ^= x >> 29
    x = x * 0x9E3779B97F4A7C15 & M64
    return x ^ x >> 32


def plain_fingerprint(text: str) -> str:
    raw = (text or "").encode()
    zeros = []
    for i in range(len(raw)):
        h = _mix(sum((raw[i - k] + 1) * fingerprints.ROLL ** (k + 1) for k in range(fingerprints.CONTEXT) if i >= k) & M64)
        zeros.append(64 if not h else (h & -h).bit_length() - 1)

    def signature(level):
        chunks, start = [], 0
        for i, z in enumerate(zeros):
            size = i + 1 - start
            if size * 4 >= 1 << level and z >= level or size == 4 << level or i == len(raw) - 1:
                chunks.append(raw[start : i + 1])
                start = i + 1
        return chunks

    level = 1
    while level < 40 and (len(raw) > (256 << level) or any(len(signature(k)) > 64 for k in (level, level + 1))):
        level += 1
    letters = fingerprints.LETTERS.tobytes().decode()

    def code(chunk):
        h = _mix(sum((b + 1) * pow(fingerprints.BASE, k, 1 << 64) for k, b in enumerate(chunk)) + len(chunk) * fingerprints.ROLL & M64) >> 52
        return letters[h >> 6] + letters[h & 63]

    return f"{level}:" + ":".join("".join(map(code, signature(k))) for k in (level, level + 1))


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j] + 1, row[j + 1] + 1, last + (x != y))
    return row[-1]


def plain_likeness(a, b):
    (k, *x), (m, *y) = ((int(f.split(":")[0]), *f.split(":")[1:]) for f in (a, b))
    if abs(k - m) > 1:
        return 0.0
    cut = lambda s: [s[i : i + 2] for i in range(0, len(s), 2)]
    x, y = cut(x[int(m > k)]), cut(y[int(k > m)])
    return 1 - _distance(x, y) / max(len(x), len(y)) if x or y else 1.0


def _of(texts):
    raw = [t.encode() for t in texts]
    return fingerprints.signatures(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))


def _texts():
    rng = random.Random(11)
    return ["", "a", "ab", "été", "x" * 3000, "ab " * 900, *(prose(rng, n) for n in (1, 3, 10, 40, 200, 900)), "\n" * 70, "one line\n" * 60]


@pytest.mark.parametrize("block", [1 << 20, 100])
def test_fingerprints_are_those_of_the_definition(monkeypatch, block):
    monkeypatch.setattr(fingerprints, "PIECE_BYTES", block)
    texts = _texts()
    assert fingerprints.written(_of(texts)) == [plain_fingerprint(t) for t in texts]
    assert fingerprints.written(_of([])) == [] and fingerprints.written(_of(["", ""])) == ["1::", "1::"]


def test_distances_and_likeness():
    rng = random.Random(12)
    rows = [[rng.randrange(4) for _ in range(rng.choice([0, 1, 5, 63, 64]))] for _ in range(120)]
    table = np.full((120, 64), -1, np.int16)
    for k, r in enumerate(rows):
        table[k, : len(r)] = r
    n = np.array(list(map(len, rows)))
    got = fingerprints.edit_distances(table[:60], n[:60], table[60:], n[60:])
    assert got.tolist() == [_distance(a, b) for a, b in zip(rows[:60], rows[60:])]
    texts = _texts()
    s = _of(texts)
    names = fingerprints.written(s)
    for shift in range(len(texts)):
        other = np.roll(np.arange(len(texts)), shift)
        assert np.allclose(fingerprints.likeness(s, s.rows(other)), [plain_likeness(names[i], names[j]) for i, j in enumerate(other)])
    again = fingerprints.read(names)
    assert fingerprints.written(again) == names and (fingerprints.likeness(s, again) == 1).all()


def test_edits_stay_near_and_others_are_far():
    rng = random.Random(13)
    texts = [prose(rng, rng.choice([30, 100, 400, 2000])) for _ in range(60)]
    edited = [t[: len(t) // 2] + " an inserted word " + t[len(t) // 2 :] for t in texts]
    s = _of(texts)
    assert fingerprints.likeness(s, _of(edited)).min() > 0.8
    assert fingerprints.likeness(s, s.rows(np.roll(np.arange(60), 1))).max() < 0.35


def test_rows_and_clashing_names(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "one", "mine"), (1, "one", "x"), (None, None, "y"), (2, "é" * 50, "z")], "doc_id long, text string, fingerprint string")
    got = fingerprints.fingerprint_documents(df, keep=("doc_id", "fingerprint")).collect()
    assert sorted((r["doc_id"] or 0, r["fingerprint"]) for r in got) == [(0, "1::"), *[(1, plain_fingerprint("one"))] * 2, (2, plain_fingerprint("é" * 50))]
    pairs = fingerprints.fingerprint_documents(df).select("fingerprint", F.lit(None).cast("string").alias("other"), F.lit("x").alias("Likeness"))
    assert sorted(r["likeness"] for r in fingerprints.add_likeness(pairs, "fingerprint", "other").collect()) == [0.0, 0.0, 0.0, 1.0]
    assert fingerprints.fingerprint_documents(df.limit(0)).collect() == []
    whole = fingerprints.map_with_next(df.limit(0), fingerprints.rotated_edits, fingerprints.ROTATED)
    assert whole.collect() == [] and whole.columns[:2] == ["doc_id", "n_chars"]
    [alone] = fingerprints.map_with_next(df.where("doc_id = 2"), fingerprints.rotated_edits, fingerprints.ROTATED).collect()
    assert alone["n_chars"] == 50 and alone["near_next"] == 1.0
