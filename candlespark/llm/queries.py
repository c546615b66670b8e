"""The queries op1 to op13: each operator with its production parameters over its whole table."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlespark.llm import bpe, decontaminate, exactdedup, fingerprints, langid, licenses, linededup, periods, secrets, sharding, simhash, spelling, toxicity
from candlespark.llm.common import LOWER, UPPER, learning_bucket, read_table

Query = Callable[[SparkSession, str], DataFrame]


def _held_out(docs: DataFrame, modulus: int, left_out: int) -> DataFrame:
    return docs.withColumn("held_out", F.coalesce(learning_bucket("doc_id", modulus) == left_out, F.lit(False)))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = langid.train(docs, learning_bucket("doc_id", 4) != 2)
    return langid.predict_languages(_held_out(docs, 4, 2), model, keep=["doc_id", "held_out"])


def op2_kd_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.kd_tree_shards(read_table(spark, sf_dir, "documents"), 40)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.duplicate_classes(read_table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    return bpe.encode(read_table(spark, sf_dir, "documents"), path, keep=["doc_id"], ids=False)


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, learning_bucket("doc_id", 3) != 1)
    return toxicity.score_toxicity(_held_out(docs, 3, 1), model, keep=["doc_id", "held_out"])


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(read_table(spark, sf_dir, "documents"), keep=["doc_id"])


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    automata = decontaminate.build(read_table(spark, sf_dir, "benchmark"))
    return decontaminate.scan_contamination(read_table(spark, sf_dir, "documents"), automata, keep=["doc_id"])


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.classify_lines(read_table(spark, sf_dir, "documents"))


def planted_places(doc_id: int | None, n: int) -> np.ndarray | None:
    """Of a tenth of the documents, places that make their words periodic from some word on."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return places


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.find_runs(read_table(spark, sf_dir, "documents"), rearrange=planted_places)
    order = lambda a, b: (b["length"] * a["period"] - a["length"] * b["period"], a["start"] - b["start"], a["period"] - b["period"])

    def before(a: Column, b: Column) -> Column:
        ratio, start, period = (F.signum(x).cast("int") for x in order(a, b))
        return F.when(ratio != 0, ratio).when(start != 0, start).otherwise(period)

    top = F.get(F.array_sort("runs", before), 0)
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.withColumn("top", top).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *(F.col(f"top.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.map_with_next(read_table(spark, sf_dir, "documents"), fingerprints.rotated_edits, fingerprints.ROTATED)


def lost_point(doc_id: int | None, word: bytes) -> int:
    """Of one (document, word) in 97, the code point that the word loses there; else -1."""
    h = zlib.crc32(word, zlib.crc32(b"%d:" % doc_id)) if doc_id is not None else 1
    return -1 if h % 97 else h % len(word.decode())


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(spelling.count_words(read_table(spark, sf_dir, "documents"), edit=lost_point))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


ORACLE: dict[str, str] = {
    "op3_exact_dedup": f"""
        WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents),
        g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256
        FROM n JOIN g USING (norm)
    """,
}

ORACLE["op4_license_scan"] = licenses.oracle()


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
