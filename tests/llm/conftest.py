from __future__ import annotations

import random

import pytest

SYLLABLES = "the an er on re ti es or en at ed nd ha to ou ea nt hi is it ver com".split()


def prose(rng: random.Random, words: int) -> str:
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(words))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text) with nulls, empties, ties, repeated rows, near copies and a long text."""
    rng = random.Random(3)
    base = [prose(rng, 60) for _ in range(12)]
    rows = [(k, t) for k, t in enumerate(base)]
    rows += [(20, base[0]), (21, base[0].upper()), (22, base[1] + " extra"), (23, base[2].replace("the", "tha", 1)), (24, None), (25, ""), (26, "   \n "), (27, "été É ß 日本"), (28, prose(rng, 30_000)), (29, "one"), (29, "one"), (30, "line a\nline b\n" + base[3]), (31, "..!!")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(corpus, "doc_id long, text string")
    # names that operators use inside or give out
    return df.withColumn("score", F.lit("mine")).withColumn("fp", F.lit(1)).withColumn("kept", F.lit("x")).withColumn("n_words", F.lit(0)).repartition(3)
