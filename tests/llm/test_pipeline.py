from __future__ import annotations

import random
import subprocess
import sys
from pathlib import Path

import pytest

import corpus_pipeline
from candlespark.llm import linededup
from candlespark.llm.queries import oracle_sql, queries
from tests.llm.conftest import prose


def test_stages_in_order(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    rng = random.Random(21)
    item = prose(rng, 25)
    texts = [(k, f"{prose(rng, 30)}\n{prose(rng, 30)}", "en", "s", 0) for k in range(20)]
    texts += [(20, texts[0][1], "en", "s", 0), (21, texts[1][1] + " x", "en", "s", 0), (22, f"start {item} end", "en", "s", 0), (23, "123 ...", "en", "s", 0), (24, None, None, None, None), (25, texts[2][1].split("\n")[0] + "\n" + prose(rng, 20), "de", "s", 0)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append({r["doc_id"]: r for r in docs.collect()})
    language, lines, near, clean, tokens = seen
    assert set(language) == set(range(26)) - {23, 24}
    first = {}
    for k in sorted(language):
        for n, line in linededup.lines_of(language[k]["text"].encode()):
            first.setdefault(line, (k, n))
    assert lines[20]["text"] == "" and lines[0]["text"] == texts[0][1] and all(r["n_chars"] == len(r["text"]) for r in lines.values())
    assert lines[25]["text"] == texts[25][1].split("\n")[1]
    assert set(range(20)) <= set(near) and sum(not r["text"] for r in near.values()) <= 1
    assert item not in clean[22]["text"] and all(clean[k] == near[k] for k in range(20))
    assert all(len(r["ids"]) == r["n_tokens"] for r in tokens.values()) and set(tokens) == set(clean)
    whole = {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == {k: r["ids_sha256"] for k, r in tokens.items()}


def test_the_language_told_decides(spark, monkeypatch):
    rng = random.Random(23)
    stock = {"en": "the and of that with this have from".split(), "de": "der und die nicht ist ein mit auch".split(), "fr": "le les des une dans est pour qui".split()}
    say = lambda lang: " ".join(rng.choice(stock[lang]) for _ in range(40))
    texts = [(k, say(lang), lang, "s", 0, "own") for k, lang in enumerate(["en", "de", "fr"] * 30)]
    texts += [(100, say("de"), None, "s", 0, "own"), (101, say("fr"), "en", "s", 0, "own"), (None, say("en"), "en", "s", 0, "own"), (7, say("en"), "en", "s", 0, "own"), (102, "123", "en", "s", 0, "own"), (103, None, "en", "s", 0, "own"), (104, "x", "en", "s", 0, "own")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long, score string")
    monkeypatch.setattr(corpus_pipeline, "SURE_SCORE", 0.5)  # so few texts teach little
    out = corpus_pipeline.identify_language(spark, docs, "")
    assert out.columns == docs.columns
    got = {(r["doc_id"], r["text"]): r for r in out.collect()}
    lang = {t[:2]: t[2] for t in texts}
    assert got[texts[90][:2]]["lang"] == "de" and got[texts[91][:2]]["lang"] == "fr" and not any(k in (102, 103) for k, _ in got)
    assert all(r["lang"] == lang[k] and r["score"] == "own" for k, r in got.items() if k[0] not in (100, 101, 104)) and set(lang) - set(got) <= {t[:2] for t in texts[-3:]}
    monkeypatch.setattr(corpus_pipeline, "SURE_SCORE", 2.0)
    kept = {r["text"]: r["lang"] for r in corpus_pipeline.identify_language(spark, docs, "").collect()}
    assert kept[texts[91][1]] == "en" and kept[texts[90][1]] == "de"
    monkeypatch.setattr(corpus_pipeline, "least_score", lambda model: 1.1)
    assert corpus_pipeline.identify_language(spark, docs, "").count() == 0
    assert corpus_pipeline.identify_language(spark, docs.limit(0), "").count() == 0


def test_one_row_of_each_near_duplicate_group_stays(spark):
    rng = random.Random(22)
    a, b, c, d = (prose(rng, 200) for _ in range(4))
    texts = [(None, a), (None, a), (None, b), (4, b), (5, c), (5, c), (5, d), (6, d), (3, d)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in texts], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr) == sorted([(None, a), (4, b), (5, c), (3, d)], key=repr)


def test_every_operator_has_its_query():
    assert {q.split("_")[0] for q in queries()} == {f"op{n}" for n in range(1, 14)} and set(oracle_sql()) <= set(queries())


def test_the_rest_imports_without_this_part(tmp_path):
    root = Path(__file__).resolve().parents[2]
    code = "import sys; sys.modules['candlespark.llm'] = None; import __spark_entry__ as e; assert e.queries() and not any(q.startswith('op') or q == 'pipeline' for q in e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
