"""Small tables for the training-data operators."""

import random

DOC_SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
              # columns whose names the operators use inside
              "hits string, block string, size string, digest string, t string, fp string, kind string")


def docs(spark, rows, schema=DOC_SCHEMA):
    """rows: (doc_id, text[, source])"""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 0, *["x"] * 7) for r in rows]
    return spark.createDataFrame(full, schema)


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    words = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
             for _ in range(vocabulary)]
    return [rng.choice(words) for _ in range(n)]


# NULL, empty, blank, one word, repeated row, NULL id, very long
EDGE = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "a b"), (5, "a b"), (None, "no id here"),
        (None, "no id here"), (6, "é ü ß 数据 \U0001f600"), (7, "x" * 200_000), (8, "w " * 60_000)]
