"""Awkward rows that every corpus operator must take."""

import random

from pyspark.sql import types as T

ODD = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use inside
    T.StructField("key", T.StringType()), T.StructField("fp", T.StringType()), T.StructField("n_words", T.StringType()),
    T.StructField("row_number", T.IntegerType()), T.StructField("hit_words", T.IntegerType()),
    T.StructField("held_out", T.StringType()), T.StructField("text_judged", T.StringType()),
])


def sentence(rng: random.Random, n: int) -> str:
    parts = "th ing er on re an tion es le mar ko du".split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


def odd_texts() -> list[str | None]:
    rng = random.Random(5)
    long = sentence(rng, 20_000)
    plain = sentence(rng, 120)
    return [None, "", " \n\t ", "x" * 5_000, long, plain, plain, plain.replace(" ", "  ", 1), plain.upper(), "a",
            "é ñ 漢字 😀 \x85\x1c.", "word " * 200, "l one two\nl one two\n\nl one two"]


def odd_docs(spark, texts=None):
    texts = odd_texts() if texts is None else texts
    rows = [(None if i % 7 == 3 else i, t, None if i % 2 else "en", "s", None if t is None else len(t),
             "k", None, "n", i, None, "h", "j") for i, t in enumerate(texts)]
    rows += rows[5:6]  # one row twice
    return spark.createDataFrame(rows, ODD)


def rows(df):
    return [tuple(r) for r in df.collect()]
