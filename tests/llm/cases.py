"""Documents with every defined case, and helpers of the tests of this folder."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, mark string, score string, key string"


def documents(spark, extra=(), seed=3):
    """Random texts with nulls, empty and long texts, repeated rows and clashing column names."""
    rng = random.Random(seed)
    vocabulary = ["the", "of", "and", "that", *("".join(rng.choice(["an", "er", "io", "tul", "ské", "mo"]) for _ in range(rng.randint(1, 4))) for _ in range(300))]
    words = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [(i, words(rng.randint(1, 120)).capitalize() + "." + rng.choice(["", "\n" + words(6), "\t  x"]), rng.choice(["en", "fr", None, "xx"])) for i in range(60)]
    base = words(200)
    near = base.split(" ")
    near[50] = "other"
    rows += [(100, None, "en"), (101, "", None), (102, " \n\t ", "en"), (103, base, "en"), (104, " ".join(near), "en"), (105, base, "en"), (106, base + " ", "de"), (107, words(6000), "en"), (108, "same line here\n" * 40, "en"), (109, "### $$$ " * 60, "en")]
    rows += [(103, base, "en"), (None, base, "en"), (None, "alone " + words(40), "en"), (110, "ünï 😀 one", "en"), (111, "x" * 5000, "en")]
    rows += list(extra)
    return spark.createDataFrame([(i, t, lang, "s", len(t) if t is not None else None, "clash", "clash", "clash") for i, t, lang in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(row):
    return tuple(str(x) for x in row)
