"""Every opN query on a small folder with nulls, empty and long texts, repeated rows and clashing columns, against its contract."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from candlespark.llm import langid, linededup, toxicity
from candlespark.llm.queries import queries
from tests.llm.conftest import prose
from tests.llm.test_text_operators import _brute_hits, _line_classes, _simhash

STOCK = {"en": "the and of that with this have from", "de": "der und die nicht ist ein mit auch", "fr": "le les des une dans est pour qui"}


def _crc(i):
    return zlib.crc32(str(i).encode())


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(41)
    say = lambda lang: " ".join(rng.choice([*STOCK[lang].split(), prose(rng, 1)]) for _ in range(40))
    docs = [(k, say(lang), lang) for k in range(240) for lang in [list(STOCK)[k % 3]]]
    docs = [(k, t + (" you utter grumblefrotz" if k % 6 == 0 else ""), lang) for k, t, lang in docs]
    items = [(1, prose(rng, 30)), (2, prose(rng, 6)), (3, None), (4, "!!")]
    docs += [(300, None, "en"), (301, "", None), (302, "123 ...", "en"), (303, f"{docs[0][1]}\n{items[0][1]}", "en"), (304, docs[1][1].upper(), "de"), (305, docs[2][1], "fr"), (305, docs[2][1], "fr"), (306, prose(rng, 40_000) + " token=abcdef99", "en")]
    docs += [(307, "password: hunter22 AKIA" + "A1" * 8 + " " + "0f" * 12, "en"), (308, "Released under the MIT License.", "en"), (309, "été 日本 <|endoftext|> ok\n\nx's", None)]
    path = tmp_path_factory.mktemp("tables")
    own = [(*d, "s", len(d[1] or ""), "mine", 1) for d in docs]
    spark.createDataFrame(own, "doc_id long, text string, lang string, source string, n_chars long, score string, fp int").repartition(3).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    spark.createDataFrame([(k, 1, int(k % 6 == 0)) for k in range(240)], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path), docs, items


def _run(spark, folder, n):
    [query] = [q for name, q in queries().items() if name.startswith(f"op{n}_")]
    out = query(spark, folder[0])
    return out.columns, out.collect()


def test_op1(spark, folder):
    columns, got = _run(spark, folder, 1)
    assert columns[:4] == ["doc_id", "held_out", "lang_pred", "score"] and sorted(r["doc_id"] for r in got) == sorted(d[0] for d in folder[1])
    assert all(r["held_out"] == (_crc(r["doc_id"]) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    text = {k: t for k, t, _ in folder[1]}
    assert all((r["lang_pred"] == "und") == (re.search(r"[^\W\d_]", text[r["doc_id"]] or "") is None) for r in got)
    lang = {k: x for k, _, x in folder[1][:240]}
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in got if r["doc_id"] in lang and r["held_out"]]) > 0.9


def test_op1_learns_nothing_from_held_out_rows(spark, folder, tmp_path):
    from pyspark.sql import functions as F

    df = spark.read.parquet(folder[0] + "/documents.parquet")
    swapped = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit("xx")).otherwise(F.col("lang"))
    df.withColumn("lang", swapped).write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(map(tuple, _run(spark, (str(tmp_path),), 1)[1])) == sorted(map(tuple, _run(spark, folder, 1)[1]))


def test_op2(spark, folder):
    columns, got = _run(spark, folder, 2)
    assert columns[:7] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    want = Counter((k, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for k, t, _ in folder[1])
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots = {}
    for r in got:
        assert 0 <= r["shard"] < 40 and r["law"] == "bytes"
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op3(spark, folder):
    _, got = _run(spark, folder, 3)
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    size, keep = Counter(low(t) for _, t, _ in folder[1]), {}
    for k, t, _ in folder[1]:
        keep[low(t)] = max(k, keep.get(low(t), k))
    want = [(k, keep[low(t)], size[low(t)], k == keep[low(t)], hashlib.sha256(low(t).encode()).hexdigest()) for k, t, _ in folder[1]]
    assert sorted(map(tuple, got)) == sorted(want)


def test_op4(spark, folder):
    _, got = _run(spark, folder, 4)
    assert {(r["doc_id"], r["license"]) for r in got} == {(308, "mit/line")}


def test_op5(spark, folder):
    pytest.importorskip("public_tokenizers")
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    columns, got = _run(spark, folder, 5)
    assert columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = []
    for k, t, _ in folder[1]:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, got)) == sorted(want)


def test_op6(spark, folder):
    columns, got = _run(spark, folder, 6)
    assert columns[:3] == ["doc_id", "fingerprint", "component_id"]
    fp = {(k, f"{_simhash(t):016x}") for k, t, _ in folder[1]}
    assert {(r["doc_id"], r["fingerprint"]) for r in got} == fp and len(got) == len(folder[1])
    values = {f: int(f, 16) for _, f in fp}
    least = {f: min(k for k, g in fp if g == f) for f in values}
    for _ in values:  # smallest reachable, by relaxation
        least = {f: min(least[g] for g in values if (values[f] ^ values[g]).bit_count() <= 4) for f in values} if len(values) < 300 else least
        if all(least[f] == least[g] for f in values for g in values if (values[f] ^ values[g]).bit_count() <= 4):
            break
    assert all(r["component_id"] == least[r["fingerprint"]] for r in got)


def test_op7(spark, folder, tmp_path):
    from pyspark.sql import functions as F

    columns, got = _run(spark, folder, 7)
    assert columns[:4] == ["doc_id", "held_out", "score", "predicted"] and len(got) == len(folder[1])
    assert all(r["held_out"] == (_crc(r["doc_id"]) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 240]
    assert np.mean([r["predicted"] == (r["doc_id"] % 6 == 0) for r in held]) > 0.95
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{folder[0]}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    labels = spark.read.parquet(folder[0] + "/labels.parquet")
    flipped = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic"))
    labels.withColumn("toxic", flipped).write.parquet(str(tmp_path / "labels.parquet"))
    again = _run(spark, (str(tmp_path),), 7)[1]
    assert sorted((r["doc_id"], r["predicted"]) for r in again) == sorted((r["doc_id"], r["predicted"]) for r in got)


def test_op8(spark, folder):
    columns, got = _run(spark, folder, 8)
    assert columns[:6] == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    by = {r["doc_id"]: r for r in got}
    assert tuple(by[307])[1:4] == (1, 1, 1) and by[306]["n_assign"] == 1 and by[300]["base_sha256"] == hashlib.sha256(b"").hexdigest() and by[300]["spans"] == ""
    assert by[307]["base_sha256"] == hashlib.sha256(by[307]["spans"].encode()).hexdigest() and len(got) == len(folder[1])


def test_op9(spark, folder):
    _, got = _run(spark, folder, 9)
    small = [d for d in folder[1] if d[0] != 306]
    want = []
    for k, t, _ in small:
        n, h, found = _brute_hits(t, folder[2])
        want.append((k, n, h, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), h > 0 and 20 * h >= n))
    assert sorted(tuple(r) for r in got if r["doc_id"] != 306) == sorted(want) and len(got) == len(folder[1])


def test_op10(spark, folder):
    _, got = _run(spark, folder, 10)
    want = _line_classes([d[:2] for d in folder[1]])
    assert sorted((r["doc_id"], r["line_no"], r["keep_id"], r["keep_line_no"]) for r in got) == want and linededup.THRESHOLD == 0.8


def test_language_margins_are_those_of_dense_features():
    model = langid.fit([x for x in STOCK.values() for _ in range(3)], [k for k in STOCK for _ in range(3)])
    for text in ("The und les", "x", "Été ÀÉ 12 the", "日本 der die"):
        raw = text.encode()
        plain = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in raw)
        plain = bytearray(plain)
        for i in range(1, len(plain)):
            if raw[i - 1] == 0xC3 and 0x80 <= raw[i] <= 0x9E and raw[i] != 0x97:
                plain[i] += 0x20
        dense = np.zeros((len(langid.ORDERS), 1 << langid.BITS))
        for k, n in enumerate(langid.ORDERS):
            for i in range(len(plain)):
                code = int.from_bytes((b"  " + bytes(plain))[i + 3 - n : i + 3][::-1], "little")
                dense[k, ((code * 2654435761 + n * 40503) % 2**32 * 2246822519) % 2**32 >> (32 - langid.BITS)] += 1 / len(plain)
        want = (model.weights * dense).sum((1, 2)) + model.bias
        assert np.allclose(model.margins(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0], want, atol=1e-4)


def test_toxicity_scores_are_those_of_plain_windows():
    rng = random.Random(43)
    model = toxicity.ToxicityModel(np.random.default_rng(1).normal(0, 1, 1 << toxicity.BITS).astype(np.float32), -0.3, -2.0)
    for text in ("", "one", prose(rng, 7), "Ab, cd! " + prose(rng, 13), "été à"):
        words = re.findall("[a-z\x80-￿]+", text.lower())
        values = []
        for w in words:
            marked, slots = b" " + w.encode() + b" ", []
            for n in toxicity.ORDERS:
                for i in range(len(marked) - n + 1):
                    code = int.from_bytes(marked[i : i + n], "big")
                    slots.append(((code * 0x9E3779B97F4A7C15 + n) % 2**64 * 0xC2B2AE3D27D4EB4F) % 2**64 >> (64 - toxicity.BITS))
            values.append(np.mean(model.slots[slots]) if slots else 0.0)
        best = max((np.mean(values[k : k + toxicity.WINDOW]) for k in range(0, len(values), toxicity.WINDOW)), default=None)
        logit = model.empty if best is None else best + model.bias
        raw = text.encode()
        assert np.isclose(model.scores(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0], 1 / (1 + np.exp(-logit)), atol=1e-5)


def _plain_runs(words):
    found = {}
    for p in range(1, len(words) // 3 + 1):
        i = 0
        while i < len(words) - p:
            s = i
            while i < len(words) - p and words[i] == words[i + p]:
                i += 1
            if i + p - s >= max(24, 3 * p):
                found.setdefault((s, i + p - s), p)
            i += 1
    return sorted((s, n, p) for (s, n), p in found.items())


def _runs_row(k, text, plant=True):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n, h = len(words), _crc(k)
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = _plain_runs(words)
    dropped = {i for s, m, p in runs for i in range(s + p, s + m)}
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (k, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, sha("".join(f"{s},{m},{p}\n" for s, m, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_op11(spark, folder):
    columns, got = _run(spark, folder, 11)
    assert columns[:8] == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    order = lambda r: (r[0], r[-1])
    assert sorted((tuple(r) for r in got if r["doc_id"] != 306), key=order) == sorted((_runs_row(k, t) for k, t, _ in folder[1] if k != 306), key=order)
    assert len(got) == len(folder[1]) and sum(r["n_runs"] > 0 for r in got) > 3


def _word_counts(docs, points=5, least=3):
    n = Counter()
    for k, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{k}:{run}".encode()) if k is not None else 1
            n[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: m for w, m in n.items() if len(w) >= points and m >= least}


def _one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def _spelling_rows(n):
    near = {w: [v for v in n if _one_apart(w, v)] for w in n}
    form = {w: min(near[w], key=lambda v: (-n[v], v), default=None) for w in n}
    form = {w: v if v is not None and n[v] >= 2 * n[w] else None for w, v in form.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] is not None else None) for w in n)


def test_op13(spark, folder):
    columns, got = _run(spark, folder, 13)
    assert columns[:6] == ["word", "form", "root", "n", "n_near", "form_n"]
    counted = _word_counts([d[:2] for d in folder[1]])
    row = {r["word"]: r for r in got}
    assert {w: r["n"] for w, r in row.items()} == counted and len(got) == len(row)
    some = sorted(counted)[::40] + [w for w in counted if row[w]["form"]][:200]
    for w in some:
        near = [v for v in counted if abs(len(v) - len(w)) < 2 and _one_apart(w, v)]
        best = min(near, key=lambda v: (-counted[v], v), default=None)
        best = best if best is not None and counted[best] >= 2 * counted[w] else None
        assert (row[w]["n_near"], row[w]["form"], row[w]["form_n"]) == (len(near), best, counted.get(best))
    for w, r in row.items():
        last = w
        while row[last]["form"] is not None:
            last = row[last]["form"]
        assert r["root"] == last


def test_op12(spark, folder):
    from tests.llm.test_fingerprints import plain_fingerprint, plain_likeness

    columns, got = _run(spark, folder, 12)
    assert columns[:7] == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    docs = sorted((k, t or "") for k, t, _ in folder[1])
    want = []
    for (k, t), (_, u) in zip(docs, docs[1:] + docs[:1]):
        q = len(t) // 4
        edited = t[: len(t) - q] + u[:q]
        want.append((k, len(t), hashlib.sha256(edited.encode()).hexdigest(), t, edited, u))
    assert sorted(tuple(r)[:3] for r in got) == sorted(w[:3] for w in want)
    row = {(r["doc_id"], r["edited_sha256"]): r for r in got}
    for k, n, sha, t, edited, u in want:
        if n < 5000 and k % 7 == 0 or n < 200:
            f, e, x = map(plain_fingerprint, (t, edited, u))
            r = row[k, sha]
            assert (r["fingerprint"], r["edited_fingerprint"]) == (f, e)
            assert np.allclose((r["near_edited"], r["near_next"]), (plain_likeness(f, e), plain_likeness(f, x)))
    assert np.mean([r["near_edited"] > 0.5 for r in got if r["n_chars"] > 100]) > 0.95
