"""Small tables with everything awkward in them."""

from __future__ import annotations

import random

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def texts() -> list[str | None]:
    rnd = random.Random(5)
    words = ["the", "Of", "and", "ing", "été", "Straße", "日本", "don't", "x9", "42", "über", "naïve", "|", "a,b"]
    base = [" ".join(rnd.choice(words) + str(rnd.randint(0, 30)) for _ in range(n)) for n in (3, 12, 40, 80, 80, 200)]
    near = base[3].split()
    near[50] = "changed"
    long = " ".join(rnd.choice(words) + str(rnd.randint(0, 99999)) for _ in range(30_000))
    return [None, "", "   \n\t ", "one", *base, base[3], " ".join(near), base[3].upper(), long, long, "a\x00b \x1c  c d\r\n", "﻿" + base[1] + "\n\n" + base[2]]


def docs(spark, rows: list | None = None):
    """Documents with nulls in every column, a null id and a repeated row."""
    rows = texts() if rows is None else rows
    data = [(k, t, None if k % 3 else "en", None, None if t is None else len(t)) for k, t in enumerate(rows)]
    if data:
        data += [data[-1], (None, "no id here at all today", None, "src", 5)]
    return spark.createDataFrame(data, DOCS).repartition(3)


def clashing(df):
    """The same rows with columns named like those that operators add."""
    from pyspark.sql import functions as F

    for c in ("score", "row", "block", "bucket", "n", "length", "start", "node", "root", "kind", "part", "key", "a", "b", "words", "gone", "ids", "hits", "found", "entities", "attempts", "stays", "_score", "_found", "_attempts", "_row", "_n_hit", "_n_words", "_items", "_kept", "_id", "_text", "_good"):
        df = df.withColumn(c, F.lit("x"))
    return df


def empty(spark, schema: str = DOCS):
    return spark.createDataFrame([], schema)
