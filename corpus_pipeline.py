"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Every stage works on all that its predecessor kept, and all but the last return the columns of
``documents``, with ``n_chars`` following the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlespark.llm import bpe, decontaminate, langid, linededup, simhash
from candlespark.llm.common import read_table, shared_path, with_rows


def _with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


#: Told with this score and more, a language overrules the one that a document states.
SURE_SCORE = 0.9


def least_score(model: langid.LanguageModel) -> float:
    """That of a guess: one over the number of languages."""
    return 1 / max(1, sum(map(len, model.members)))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told go: no text, no letter, or a score below that of a guess among the learned languages.

    The others keep their text; ``lang`` becomes the language told where none is stated, or
    where the one stated is another and the score reaches ``SURE_SCORE``. Rows are judged one by
    one, so null and repeated ids do no harm; an empty table gives an empty table.
    """
    model = langid.train(docs)
    name = {c: c if c == "text" else f"c{k}" for k, c in enumerate(docs.columns)}  # or a column score would be replaced
    stated = docs.select(*(F.col(f"`{c}`").alias(a) for c, a in name.items()))
    told = langid.predict_languages(stated, model).where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= least_score(model)))
    lang = F.when(F.col(name["lang"]).isNull() | (F.col("score") >= SURE_SCORE), F.col("lang_pred")).otherwise(F.col(name["lang"]))
    return told.select(*((lang if c == "lang" else F.col(a)).alias(c) for c, a in name.items()))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-equal lines the first stays; a document keeps its other lines."""
    return _with_length(linededup.dedup_lines(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component one row stays: the first by (id, row as written), null ids last."""
    rows = with_rows(docs)
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("__row").alias("row"))
    found = simhash.near_duplicates(rows.select(key.alias("__key"), "text"), id_col="__key")
    first = found.where("__key.row = component_id.row").select(F.col("__key.row").alias("__row"))
    return rows.join(first, "__row", "left_semi").select(docs.columns)


def remove_benchmark_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents lose their benchmark spans; clean ones are untouched."""
    automata = decontaminate.build(read_table(spark, sf_dir, "benchmark"))
    return _with_length(decontaminate.decontaminate(docs, automata))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Token ids of every document, with the digests of ids and of the decoded text."""
    import public_tokenizers

    return bpe.encode(docs, tokenizer or public_tokenizers.path("byte_bpe_50k.json"), keep=[c for c in docs.columns if c != "text"])


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", remove_benchmark_spans),
    ("bpe", encode_tokens),
]

#: No SQL: learned models, similarity components and BPE merges are beyond it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; what is between them is written to the shared folder."""
    folder = shared_path(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
